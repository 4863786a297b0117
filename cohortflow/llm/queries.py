"""The registered queries of the training-data operators, over their whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cohortflow.llm import (chat, collocations, fingerprint, jaccard_join, language, mixing, packing, quality, resampling, secret_scan, sharding,
                            suffix_dedup, warc)
from cohortflow.llm.common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one with control strings in its texts; digests of what is read back."""
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                           F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat.format_chat(rows.withColumn("parts", chat.text_parts(F.col("text"))))
    back = chat.read_chat(made)
    turns = F.array_join(F.transform("messages", lambda m: F.concat(m.role, F.lit("\n"), m.text, F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("messages").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                       F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))


def op2_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness."""
    return fingerprint.edited_neighbours(table(spark, sf_dir, "documents"))


def op3_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets are 90 % similar or more."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), n_words=3, percent=90)


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards of near equal bytes."""
    return sharding.kd_shards(table(spark, sf_dir, "documents"), 40, whole_groups=True)


def op5_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids."""
    p = packing.pack_public(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as dictionary-compressed archives, read them back."""
    listed = warc.write_pages(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.read_pages(listed, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_deep_shallow_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents covered by 50-byte strings of smaller documents."""
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


def op8_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans, and all spans, of every document; with the live ones."""
    s = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x.is_base)
    count = lambda kind: F.size(F.filter(base, lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    return s.select("doc_id", *[count(k) for k in secret_scan.BASE_KINDS], F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
                    secret_scan.joined(F.col("spans")).alias("spans"), secret_scan.joined(F.filter("spans", lambda x: x.live)).alias("live_spans"))


def op9_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: sources weigh 3, 1, 2 in turn and share 150 % of all words."""
    return mixing.mix(table(spark, sf_dir, "documents"), corpus_pipeline.MIX_WEIGHTS).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "rate")


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all documents, the base rules and the learned list's verdict."""
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit_rules(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select("doc_id", *quality.STATS[:5], "base_failed", "kept")


def op11_dynamic_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


def op12_mixture_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of every document, learnt from two thirds of them."""
    p = language.predict(table(spark, sf_dir, "documents"))
    shares = F.array_join(F.transform("langs", lambda x: F.concat_ws(":", x.lang, F.format_string("%.4f", x.share))), ",")
    return p.select("doc_id", "held_out", "lang_pred", "score", shares.alias("mixture"))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents drawn to resemble the benchmark texts."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_quartile_digest, op3_token_group_join, op4_kd_sharding, op5_sum_of_squares_packing,
                                   op6_warc_archive, op7_deep_shallow_dedup, op8_secret_ownership, op9_entropy_mix, op10_decision_list,
                                   op11_dynamic_collocations, op12_mixture_language, op13_importance_resample)}
QUERIES["pipeline"] = corpus_pipeline.run

_ESC = r"replace(replace(replace({}, '\', '\b'), '<', '\l'), '#', '\h')"

ORACLE = {
    "op1_chat_format": rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length('### ' || replace({_ESC.format('role')}, ':', '\c') || ': ' || {_ESC.format('text')} || '</turn>' || chr(10))) AS chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       chars::BIGINT AS formatted_chars FROM g""",
    "op11_dynamic_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM w, range(1, 6) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY ALL),
words AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS p, array_to_string(w[cut + 1:], ' ') AS q FROM c, range(1, 5) t(cut) WHERE cut < k),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = p JOIN f y ON y.lang = cuts.lang AND y.phrase = q JOIN words ON words.lang = cuts.lang
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_runs AS (
  SELECT lang, a, unnest(flatten([[array_to_string(w[i:i + s - 1], ' ') FOR i IN range(1, len(w) - s + 2)] FOR s IN range(2, len(w))])) AS phrase FROM c WHERE k > 2
), over_ AS (SELECT lang, phrase, max(a) AS over_a FROM inner_runs GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN over_ ON over_.lang = lowest.lang AND over_.phrase = lowest.phrase WHERE over_a IS NULL OR over_a < a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept
QUALIFY rank <= 2000""",
    "op13_importance_resample": r"""
WITH tab AS (SELECT list(list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS tab
  FROM (SELECT range AS b FROM range(0, 256))),
texts AS (SELECT 0 AS part, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
found AS (SELECT part, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
words AS (SELECT part, doc_id, unnest(ws) AS w FROM found),
bytes AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)),
buckets AS (
  SELECT w, xor(list_reduce([('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(0, len(h) // 2)],
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM bytes, tab
), counts AS (
  SELECT g.range AS bucket, count(*) FILTER (WHERE part = 0) AS s, count(*) FILTER (WHERE part = 1) AS t
  FROM range(0, 10000) g LEFT JOIN (SELECT part, bucket FROM words JOIN buckets USING (w)) x ON x.bucket = g.range GROUP BY ALL
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts
), sums AS (SELECT doc_id, sum(gain)::BIGINT AS g FROM words JOIN buckets USING (w) JOIN gains USING (bucket) WHERE part = 0 GROUP BY doc_id),
scored AS (
  SELECT found.doc_id, len(ws)::BIGINT AS n_features, CASE WHEN len(ws) = 0 THEN 0 ELSE (g - ((g % len(ws)) + len(ws)) % len(ws)) // len(ws) END::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || found.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS luck
  FROM found LEFT JOIN sums USING (doc_id) WHERE part = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + luck DESC, doc_id) AS pos, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, weight + luck AS score, CASE WHEN n_features >= 20 AND pos <= 10 * n // 100 THEN pos END AS rank FROM ranked""",
}
