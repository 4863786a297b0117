"""N-gram Jaccard join by a token-group matrix, and the components of its links.

Texts with equal shingle sets are one set (smallest document id), so copies cost nothing.  Then, exactly:

1. *Own tokens.*  A quarter of the shingles, chosen by hash, is counted over all sets.  A set with more shingles that
   no other set holds than its links could miss (n - ceil(t * n)) has no link and is done: the group bound for the
   group "everything else".
2. *Groups.*  The remaining sets are partitioned by the smallest hash of the sampled tokens that another set holds too, where similar sets mostly agree, and by size;
   large groups are cut into blocks of about 250,000 tokens.  The matrix holds a row for every (token, group) of the groups' token unions.
3. *Candidates.*  A set of n shingles, m of them in other groups too, shares at least c = t / (1 + t) * (n + k) with a
   partner of k.  So of the m, taken by how few groups hold them, one of the first m - c + 1 is the partner's; each
   matrix entry knows the least k of its sets.  The (set, group) pairs are entries of these tokens; no pair of sets is
   formed, and of two partners only the larger asks.
4. *Bound and open.*  With the group's union at hand, the overlap bounds what any member can reach; only groups whose
   bound meets the size condition are opened, and overlaps with all members come from one pass over the postings.
   A group first links its own members, then reports one link per query and linked part, which keeps all components.

Each link is decided on exact intersections of 64-bit shingle hashes.  Components follow by alternating star steps.
No step collects a group beyond a block of members and a bounded chunk of queries, and nothing goes to the driver.

Edge cases: a null text is empty; a text without words has no shingles and links with nothing; rows without an id get
their size and a null component, and take no part in links; rows that repeat an id and text are copies; rows of one id
with different texts are one document, which links with whatever one of its texts links with; ties do not matter (sets
are compared by value); extra columns are ignored; an empty table gives an empty result; whole texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import shuffle_width, stored

_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_SAMPLE = np.uint64(3)  # shingles whose hash has these bits zero: a quarter
_NONE = np.uint64(2**63 - 1)
_FLUSH_KEYS = 1_000_000
BLOCK_TOKENS, CHUNK = 250_000, 2048


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MUL[0]
    return x ^ (x >> np.uint64(29))


def shingles(text: str, n: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles (A-Z lower-cased); one for a shorter, non-empty text."""
    words = text.encode().lower().split()  # bytes: only A-Z change, and the six ASCII spaces split
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = _mix(out + h[i : len(h) - k + 1 + i] * _MUL[i % 5] + np.uint64(i))
    return np.unique(out)


def set_hash(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _least(n, percent: int):
    """Shared shingles that a link needs at least, given one set's size."""
    return -(-percent * n // 100)


def _profile(n_words: int, buckets: int):
    """Rows (doc_id, n, hi, lo) of all documents, and packed sampled tokens (bucket, sets, counts, keys)."""
    def run(batches):
        for b in batches:
            ids, rows, seen = b.column(0), [], set()
            keys, sets, sizes, held = [], [], [], 0

            def flush():
                k = np.concatenate(keys)
                of = np.repeat(np.array(sets, np.int64), np.array(sizes))
                to = ((k >> np.uint64(34)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                k, of, to = (k[order] >> np.uint64(2)).astype(np.uint32), of[order], to[order]
                cut = np.flatnonzero(np.diff(to)) + 1
                out = []
                for kk, oo, tt in zip(np.split(k, cut), np.split(of, cut), np.split(to, cut)):
                    starts = np.flatnonzero(np.concatenate([[True], oo[1:] != oo[:-1]]))
                    runs = np.diff(np.concatenate([starts, [len(oo)]])).astype(np.uint32)
                    out.append((int(tt[0]), oo[starts].tobytes(), runs.tobytes(), kk.tobytes()))
                cols = list(zip(*out))
                n = len(out)
                return pa.RecordBatch.from_arrays([
                    pa.nulls(n, ids.type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                    pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names)

            for text in b.column(1):
                s = shingles(text.as_py(), n_words)
                hi, lo = set_hash(s)
                rows.append((len(s), hi, lo))
                if len(s) and lo not in seen:
                    seen.add(lo)
                    some = s[(s & _SAMPLE) == 0]
                    if len(some):
                        keys.append(some)
                        sets.append(lo)
                        sizes.append(len(some))
                        held += len(some)
                if held >= _FLUSH_KEYS:
                    yield flush()
                    keys, sets, sizes, held = [], [], [], 0
            if keys:
                yield flush()
            if rows:
                n = len(rows)
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in cols], pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.binary())] * 3], names)

    names = ["doc_id", "n", "hi", "lo", "bucket", "sets", "counts", "keys"]
    return run


def _own_tokens(pdf, parts: int):
    """Of one bucket: per set, how many of its sampled tokens no other set holds, packed by parts of the sets."""
    import pandas as pd

    sets = np.concatenate([np.repeat(np.frombuffer(s, np.int64), np.frombuffer(c, np.uint32)) for s, c in zip(pdf["sets"], pdf["counts"])])
    keys = np.concatenate([np.frombuffer(k, np.uint32) for k in pdf["keys"]])
    order = np.lexsort((sets, keys))
    keys, sets = keys[order], sets[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])])  # a set sent by several tasks counts once
    keys, sets = keys[new], sets[new]
    alone = np.concatenate([[True], keys[1:] != keys[:-1]]) & np.concatenate([keys[1:] != keys[:-1], [True]])
    rank = _mix(keys.astype(np.uint64) | np.uint64(int(pdf["bucket"].iloc[0])) << np.uint64(32)) >> np.uint64(1)
    rank[alone] = _NONE
    order = np.argsort(sets, kind="stable")
    sets, alone, rank = sets[order], alone[order], rank[order]
    starts = np.flatnonzero(np.concatenate([[True], sets[1:] != sets[:-1]]))
    sets, own, low = sets[starts], np.add.reduceat(alone.astype(np.uint32), starts), np.minimum.reduceat(rank, starts)
    part = sets.view(np.uint64) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order])) + 1
    packed = {k: [x.tobytes() for x in np.split(v[order], cut)] for k, v in (("sets", sets), ("own", own.astype(np.uint32)), ("low", low))}
    return pd.DataFrame({"part": part[order][np.concatenate([[0], cut])].astype(np.int32), **packed})


def _add_own(pdf):
    """Of one part of the sets: own tokens in all buckets, and the smallest hash of a token that is not own."""
    import pandas as pd

    every = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in pdf[c]])
    sets = every("sets", np.int64)
    order = np.argsort(sets, kind="stable")
    sets = sets[order]
    starts = np.flatnonzero(np.concatenate([[True], sets[1:] != sets[:-1]]))
    own, low = np.add.reduceat(every("own", np.uint32)[order].astype(np.int64), starts), np.minimum.reduceat(every("low", np.uint64)[order], starts)
    return pd.DataFrame({"lo": sets[starts], "own": own, "low": low.astype(np.int64)})


def _tokens(n_words: int):
    def run(batches):
        for b in batches:
            keep, size = [], 0
            for i, (rep, name, n, hi, lo, low, text) in enumerate(zip(*(b.column(c).to_pylist() for c in range(6)), b.column(6))):
                s = shingles(text.as_py(), n_words)
                if set_hash(s) == (hi, lo):  # another row may carry the same id
                    keep.append((rep, name, n, low if low != int(_NONE) else int(_mix(s).min() >> np.uint64(1)), s.view(np.int64)))
                    size += len(s)
                if keep and (size >= 500_000 or i == b.num_rows - 1):
                    yield out(b, keep)
                    keep, size = [], 0
            if keep:
                yield out(b, keep)

    def out(b, keep):
        tokens = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(k[4]) for k in keep])]).astype(np.int32), pa.array(np.concatenate([k[4] for k in keep])))
        return pa.RecordBatch.from_arrays([*[pa.array([k[c] for k in keep], kind) for c, kind in ((0, pa.int64()), (1, b.schema.field(1).type), (2, pa.int64()), (3, pa.int64()))], tokens], ["rep", "name", "n", "low", "tokens"])

    return run


def _whole_groups(batches):
    """Tables of whole groups from batches in the order of their first column."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
        gid = t.column(0).to_numpy()
        cut = int(np.searchsorted(gid, gid[-1])) if len(gid) else 0
        if cut:
            yield t.slice(0, cut).combine_chunks()
        held = t.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def _array(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column in order, and the number of each row's."""
    a = _array(column)
    return a.flatten().to_numpy(zero_copy_only=False), np.diff(np.asarray(a.offsets))


def _unions(batches):
    """Rows (gid, n, tokens) by group -> (gid, token, least): each group's token union, with its smallest set's size."""
    for t in _whole_groups(batches):
        token, size = _flat(t.column(2))
        row = np.repeat(np.arange(t.num_rows), size)
        gid, n = t.column(0).to_numpy()[row], t.column(1).to_numpy()[row]
        order = np.lexsort((token, gid))
        gid, token, n = gid[order], token[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], (gid[1:] != gid[:-1]) | (token[1:] != token[:-1])]))
        yield pa.RecordBatch.from_arrays([pa.array(gid[starts]), pa.array(token[starts]), pa.array(np.minimum.reduceat(n, starts))], ["gid", "token", "least"])


def _prefixes(percent: int):
    """Rows (gid, rep, n, tokens, groups) by group, members with null groups, the tokens that the group shares with
    others in rows without rep -> (rep, home, token, n, n_met, rank): each member's tokens to look up elsewhere."""
    def keys(t):
        token, size = _flat(t.column("tokens"))
        gid = np.repeat(t.column("gid").to_numpy(), size)
        return token, size, _mix(token.view(np.uint64) + gid.view(np.uint64) * _MUL[1])

    def run(batches):
        for t in _whole_groups(batches):
            outside = np.asarray(t.column("rep").is_null())
            met, own = t.filter(pa.array(outside)), t.filter(pa.array(~outside))
            if not met.num_rows or not own.num_rows:
                continue
            _, _, there = keys(met)
            order = np.argsort(there)
            there, groups = there[order], _flat(met.column("groups"))[0][order]
            token, size, key = keys(own)
            at = np.minimum(np.searchsorted(there, key), len(there) - 1)
            hit = there[at] == key  # equal hashes of another token would only lengthen the prefix
            row, token, groups = np.repeat(np.arange(own.num_rows), size)[hit], token[hit], groups[at[hit]]
            n, n_met = own.column("n").to_numpy(), np.bincount(row, minlength=own.num_rows)
            least = _least(n, percent)
            first = np.where(n_met >= least, n_met - (percent * (n + least) + 99 + percent) // (100 + percent) + 1, 0)
            order = np.lexsort((token, groups, row))
            row, token = row[order], token[order]
            rank = np.arange(len(row)) - (np.cumsum(n_met) - n_met)[row] + 1
            keep = rank <= first[row]
            row, token, rank = row[keep], token[keep], rank[keep]
            rep, home = (_array(own.column(c)).take(pa.array(row)) for c in ("rep", "gid"))
            yield pa.RecordBatch.from_arrays([rep, home, *[pa.array(x, pa.int64()) for x in (token, n[row], n_met[row], rank)]],
                                             ["rep", "home", "token", "n", "n_met", "rank"])

    return run


def _open_groups(percent: int):
    """Links of one block of members, among themselves and with one chunk of queries."""
    def run(members, queries):
        import pandas as pd

        ids, names, sizes = members["rep"].to_numpy(), members["name"].to_numpy(), members["n"].to_numpy()
        lists = members["tokens"].tolist()
        flat = np.concatenate(lists)
        owner = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        union = flat[starts]
        ends = np.concatenate([starts[1:], [len(flat)]])
        part = list(range(len(ids)))

        def root(i):
            while part[i] != i:
                part[i] = part[part[i]]
                i = part[i]
            return i

        def linked(tokens, n):
            at = np.searchsorted(union, tokens)
            at[at == len(union)] = 0
            at = at[union[at] == tokens]
            smallest = max(int(sizes.min()), _least(n, percent))
            if len(at) * (100 + percent) < percent * (n + smallest):  # the bound: the group stays closed
                return ()
            lo, k = starts[at], ends[at] - starts[at]
            hits = owner[np.repeat(lo - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(int(k.sum()))]
            both = np.bincount(hits, minlength=len(ids))
            return np.flatnonzero(100 * both >= percent * (n + sizes - both))

        a, b = [], []
        for i, (t, n) in enumerate(zip(lists, sizes)):
            for j in linked(np.asarray(t), int(n)):
                x, y = root(i), root(int(j))
                if x != y:
                    part[x] = y
                    a.append(names[i])
                    b.append(names[j])
        for rep, name, t, n in zip(queries["query"], queries["called"], queries["set"], queries["size"]):
            met = {}
            for j in linked(np.asarray(t), int(n)):
                if ids[j] != rep:
                    met.setdefault(root(int(j)), names[j])
            a += [name] * len(met)
            b += met.values()
        return pd.DataFrame({"a": np.array(a, names.dtype), "b": np.array(b, names.dtype)})

    return run


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b), by alternating large-star and small-star."""
    def star(edges, large: bool):
        e = edges if not large else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        j = e.join(m, "u")
        out = j.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else \
            j.select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v")))
        return stored(out.filter(F.col("u") != F.col("v")).distinct(), "links")

    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    for _ in range(rounds):
        edges = star(star(edges, True), False)
        # the links as a set: their number and two order-free sums
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.crc32(F.concat_ws(",", "u", "v").cast("binary")))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now
    raise RuntimeError("components did not settle")


def jaccard_components(docs: DataFrame, n_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; two documents link at percent % Jaccard similarity or more."""
    width = shuffle_width(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    profile = stored(slim.mapInArrow(_profile(n_words, width), f"doc_id {kind}, n long, hi long, lo long, bucket int, sets binary, counts binary, keys binary"), "sets")
    rows = profile.filter("n is not null").select("doc_id", "n", "hi", "lo")
    packed = profile.filter("bucket is not null").select("bucket", "sets", "counts", "keys")
    own = packed.groupBy("bucket").applyInPandas(lambda pdf: _own_tokens(pdf, width), "part int, sets binary, own binary, low binary")
    own = own.groupBy("part").applyInPandas(_add_own, "lo long, own long, low long")
    known = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    sets = known.groupBy("hi", "lo").agg(F.min("doc_id").alias("name"), F.max("n").alias("n"))
    reps = stored(sets.withColumn("rep", F.monotonically_increasing_id()), "set-reps")  # numbered where they are written
    need = F.floor((F.col("n") * percent + 99) / 100)
    left = reps.join(own, "lo", "left").filter(F.coalesce("own", F.lit(0)) <= F.col("n") - need).select("rep", "name", "n", "hi", "lo", F.coalesce("low", F.lit(int(_NONE))).alias("low"))
    texts = left.join(slim, F.col("name") == F.col("doc_id")).select("rep", "name", "n", "hi", "lo", "low", "text")
    sets = stored(texts.mapInArrow(_tokens(n_words), f"rep long, name {kind}, n long, low long, tokens array<long>"), "sets-left")

    # groups: by the smallest token hash, in blocks
    light = sets.select("rep", "low", "n").distinct().withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(1.03))))
    many = light.groupBy("low", "band").agg(F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS)).alias("blocks"))
    grouped = stored(light.join(many, ["low", "band"]).select("rep", F.xxhash64("low", "band", F.pmod(F.xxhash64("rep"), F.col("blocks"))).alias("gid")), "set-groups")
    members = stored(sets.dropDuplicates(["rep"]).join(grouped, "rep").select("rep", "name", "gid", "n", "tokens"), "set-members")
    in_groups = members.select("gid", "n", "tokens").repartition("gid").sortWithinPartitions("gid")
    matrix = stored(in_groups.mapInArrow(_unions, "gid long, token long, least long"), "matrix")

    # candidates: the tokens in the fewest groups; a token of one group only has no other group to offer
    spread = matrix.groupBy("token").agg(F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    shared = stored(matrix.join(spread, "token"), "matrix-shared")
    offered = shared.groupBy("gid").agg(F.collect_list(F.struct("token", "groups")).alias("_s"))  # at most a block's tokens
    offered = offered.select("gid", F.lit(None).cast("long").alias("rep"), F.lit(None).cast("long").alias("n"), F.col("_s.token").alias("tokens"), F.col("_s.groups").alias("groups"))
    asking = members.select("gid", "rep", "n", "tokens", F.lit(None).cast("array<long>").alias("groups"))
    prefix = asking.unionByName(offered).repartition("gid").sortWithinPartitions("gid") \
        .mapInArrow(_prefixes(percent), "rep long, home long, token long, n long, n_met long, rank long")
    # of two partners the one with more shingles asks; a token counts as far as the smallest set there with it allows
    spare = lambda other: F.col("n_met") - F.floor((percent * (F.col("n") + other) + 99 + percent) / (100 + percent)) + 1
    near = (F.col("gid") != F.col("home")) & (F.col("least") <= F.col("n")) & (F.col("rank") <= spare(F.greatest("least", F.ceil(F.col("n") * percent / 100))))
    entry = shared.select(F.col("token").alias("of"), "gid", "least")
    pairs = stored(prefix.join(entry, (F.col("token") == F.col("of")) & near).select("rep", "gid").distinct(), "set-pairs")

    # open: members of a block against chunks of queries
    chunks = pairs.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).cast("int").alias("chunks"))
    queries = pairs.join(chunks, "gid").select("rep", "gid", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int").alias("chunk")) \
        .join(members.select("rep", "name", "n", "tokens"), "rep").select("gid", "chunk", "rep", "name", "n", "tokens").toDF("to", "part", "query", "called", "size", "set")
    busy = grouped.groupBy("gid").agg(F.count(F.lit(1)).alias("held")).join(chunks, "gid", "left").filter("held > 1 or chunks is not null")  # the others have no one to meet
    opened = members.join(busy, "gid").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1))).select("gid", "chunk", "rep", "name", "n", "tokens")
    links = opened.groupBy("gid", "chunk").cogroup(queries.groupBy("to", "part")).applyInPandas(_open_groups(percent), f"a {kind}, b {kind}")

    # an id on different texts ties their sets together, each known by its smallest id
    key = F.struct("hi", "lo")
    several = known.groupBy("doc_id").agg(F.min(key).alias("first"), F.max(key).alias("last")).filter("first <> last").select("doc_id")
    ties = known.join(several, "doc_id", "left_semi").join(reps.select("hi", "lo", "name"), ["hi", "lo"]).select(F.col("doc_id").alias("a"), F.col("name").alias("b"))
    part = components(links.union(ties))

    of_set = reps.join(part, reps["name"] == part["node"], "left").select("hi", "lo", F.coalesce("component", "name").alias("component"))
    out = rows.join(of_set, ["hi", "lo"], "left")
    comp = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.cast(kind).alias("component_id"))


def first_of_each(docs: DataFrame, n_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the rows to keep: of each component the rows with the smallest id, each different text of it once;
    rows without an id stay.  Of rows with equal id and text one stays, whichever Spark meets first."""
    part = jaccard_components(docs, n_words, percent, id_col, text_col)
    stay = part.filter("component_id = doc_id").select(F.col("doc_id").alias("k_id")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("d_id"), F.xxhash64(F.col(text_col)).alias("d_hash"))
    rows = rows.join(stay, F.col("d_id") == F.col("k_id"), "left").filter("k_id is not null or d_id is null")
    again = F.row_number().over(Window.partitionBy("d_id", "d_hash").orderBy(F.lit(1)))
    return rows.withColumn("again", again).filter("again = 1 or d_id is null").select("row.*")
