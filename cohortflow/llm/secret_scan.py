"""Secret scans with corpus-wide ownership frequency.

A scan finds candidate secrets in each text: the base kinds (assignments, access keys, hex runs), and a wider net of
high-entropy tokens and whole private keys (hashed by their bodies).  Candidates are hashed and aggregated over the corpus into the number of
distinct repositories (different texts, or the values of a column) and of distinct owners that hold them.  A text that
several owners hold is a copy and counts for the least of them alone, so copying a document makes no example of its
secrets.  A value of few owners looks live, however many of their documents hold it; a value that different texts of
more owners hold is an example.  Base spans always stay; of the wider net only live-looking values are added.

The texts are read once and not shuffled: only spans and hashes move, values never leave the scan in the clear.

Edge cases: a null text is empty; positions are code points, ends exclusive; a value twice in a document counts once
for its document; rows with a null owner are together one owner, those with a null repository one repository; repeated rows are scanned each; extra columns are
ignored; an empty table gives an empty result; texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import stored

BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run is maximal, so short runs fail as a whole
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PEM = re.compile(r"-----BEGIN ([A-Z ]{0,30}PRIVATE KEY)-----")
_INLINE = r"""[\x20\t"',>#*|]"""  # what quotes and comments put around lines
_BREAK = rf"(?:{_INLINE}|\s|\\[nrt])"  # line breaks also as escapes
#: A key's body without its END line: the headers of encrypted keys, long lines, a short last line.
PEM_RUN = re.compile(rf"""(?:{_BREAK}*(?:Proc-Type|DEK-Info):[^\r\n\\]*)*(?:{_BREAK}*[A-Za-z0-9+/_=-]{{20,}})*"""
                     rf"""(?:{_INLINE}*(?:[\r\n]|\\[nr]){_BREAK}*[A-Za-z0-9+/_-]+={{0,2}}(?=\x20*(?:[\r\n\\"']|\Z)))?""")
PEM_SPACE = re.compile(r"\s|\\[nrt]")


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def private_keys(text: str) -> list[tuple]:
    """("pem", start, end, body without white space) of each private key: up to its END line, or else its base64 run."""
    keys = []
    for m in PEM.finditer(text):
        other = text.find("-----BEGIN ", m.end())
        other = len(text) if other < 0 else other
        last = f"-----END {m[1]}-----"
        stop = text.find(last, m.end(), other)
        end = PEM_RUN.match(text, m.end(), other).end() if stop < 0 else stop + len(last)
        keys.append(("pem", m.start(), end, PEM_SPACE.sub("", text[m.end() : end if stop < 0 else stop])))
    return keys


def find(text: str, least_entropy: float = 3.5) -> tuple[list[tuple], list[tuple]]:
    """(kind, start, end, value) of the base kinds, and of the wider net outside of them."""
    base = [("assign", m.start(), m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 12] if "=" in text or ":" in text else []
    base += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    base += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    base.sort(key=lambda s: (s[1], BASE_KINDS.index(s[0])))
    wide = private_keys(text)
    for m in TOKEN.finditer(text):
        v = m[0]
        mixed = any(c.isdigit() for c in v) and any(c.islower() for c in v) and any(c.isupper() for c in v)
        if mixed and entropy(v) >= least_entropy and not any(s < m.end() and m.start() < e for _, s, e, _ in base + wide):
            wide.append(("token", m.start(), m.end(), v))
    return base, wide


_SPANS = "array<struct<kind:string,start:int,end:int,hash:string>>"


def _scan(batches):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string())]))
    pack = lambda spans: [{"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest()[:32]} for k, s, e, v in spans]
    for b in batches:
        found = [find(t.as_py()) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([*[b.column(n) for n in ("doc_id", "k_hash", "owner", "repo")],
                                          pa.array([pack(x) for x, _ in found], kind), pa.array([pack(y) for _, y in found], kind)],
                                         ["doc_id", "k_hash", "owner", "repo", "base", "wide"])


def scan(docs: DataFrame, owner_col: str, repo_col: str | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k_hash, owner, repo, base, wide) per document."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("k_hash"), F.col(owner_col).cast("string").alias("owner"),
                       (F.col(repo_col) if repo_col else F.xxhash64(text_col)).cast("string").alias("repo"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return slim.mapInArrow(_scan, f"doc_id {dict(slim.dtypes)['doc_id']}, k_hash long, owner string, repo string, base {_SPANS}, wide {_SPANS}")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners): distinct repositories, and distinct owners of different texts, that hold a candidate.

    Copies of a text become one row a candidate before owners are counted; each step is combined before its shuffle."""
    c = found.select(F.explode(F.array_distinct(F.concat("base.hash", "wide.hash"))).alias("hash"), "k_hash", F.coalesce("owner", F.lit("null:")).alias("owner"),
                     F.coalesce("repo", F.lit("null:")).alias("repo"))
    texts = c.groupBy("hash", "repo", "k_hash").agg(F.min("owner").alias("owner"))
    owners = texts.groupBy("hash", "k_hash").agg(F.min("owner").alias("owner")).select("hash", "owner").distinct().groupBy("hash").agg(F.count("owner").alias("n_owners"))
    repos = texts.select("hash", "repo").distinct().groupBy("hash").agg(F.count("repo").alias("n_repos"))
    return repos.join(owners, "hash")


def find_secrets(docs: DataFrame, owner_col: str = "source", repo_col: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 most_owners: int = 2) -> DataFrame:
    """Per document: doc_id, k_hash, base (spans), spans (base and added, with `live`), both ordered by start, kind.

    A candidate is live when different texts of at most `most_owners` owners hold it; without `repo_col` each different
    text is a repository."""
    found = stored(scan(docs, owner_col, repo_col, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "secret-scan")
    has = found.filter((F.size("base") > 0) | (F.size("wide") > 0))
    live = ownership(has).withColumn("live", F.col("n_owners") <= most_owners)
    rows = has.select("rid", F.explode(F.concat(F.transform("base", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"), s.hash.alias("hash"), F.lit(True).alias("is_base"))),
                                                F.transform("wide", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"), s.hash.alias("hash"), F.lit(False).alias("is_base"))))).alias("s"))
    judged = rows.withColumn("hash", F.col("s.hash")).join(live, "hash").filter(F.col("s.is_base") | F.col("live"))
    order = F.array_position(F.array(*[F.lit(k) for k in (*BASE_KINDS, "pem", "token")]), F.col("s.kind"))
    per = judged.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(F.col("s.start").alias("start"), order.alias("rank"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"),
                                                                         F.col("s.is_base").alias("is_base"), "live", "n_repos", "n_owners"))).alias("spans"))
    empty = F.array().cast(per.schema["spans"].dataType)
    return found.join(per, "rid", "left").select("doc_id", "k_hash", F.coalesce("spans", empty).alias("spans"))


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every run of (overlapping) spans, ordered by start, replaced by the mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a, s):
        cut = F.concat(a.out, text.substr(a.at + 1, s.start - a.at), F.lit(mark))
        return F.struct(F.when(s.start >= a["at"], cut).otherwise(a.out).alias("out"), F.greatest(s.end, a["at"]).alias("at"))

    return F.aggregate(spans, start, step, lambda a: F.concat(a.out, text.substr(a["at"] + 1, F.char_length(text))))


def without_live(docs: DataFrame, owner_col: str = "source", repo_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """All rows and columns, live secrets replaced in the texts (and the length column, if there is one, set anew).

    Only the spans of documents that hold live secrets are joined back."""
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null:"))
    found = find_secrets(docs, owner_col, repo_col, id_col, text_col)
    found = found.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null:")).alias("s_id"), F.col("k_hash").alias("s_hash"), F.filter("spans", lambda x: x.live).alias("s_spans"))
    found = found.filter(F.size("s_spans") > 0).dropDuplicates(["s_id", "s_hash"])
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), ident.alias("k_id"), F.xxhash64(F.col(text_col)).alias("k_hash"))
    both = row.join(found, (F.col("k_id") == F.col("s_id")) & (F.col("k_hash") == F.col("s_hash")), "left")
    text = F.col("row").getField(text_col)
    both = both.withColumn("clean", F.when(F.col("s_spans").isNull(), text).otherwise(redact(text, F.col("s_spans"))))
    new = {text_col: F.col("clean")}
    if chars_col in docs.columns:
        kind = dict(docs.dtypes)[chars_col]
        new[chars_col] = F.when(F.col("s_spans").isNull(), F.col("row").getField(chars_col)).otherwise(F.char_length("clean").cast(kind))
    return both.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
