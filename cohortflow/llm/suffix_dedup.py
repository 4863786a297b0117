"""Suffix-array dedup: remove bytes covered by a string of `span` bytes that also starts in a smaller document.

Copies of a text are settled by its digest: all of a copy that is long enough goes.  For the first document of each text:

1. *Anchors.*  Of every `span - GRAM + 1` consecutive 24-byte grams the one with the least hash is an anchor, so equal
   `span`-byte strings hold the same anchor at the same place.  Anchors are dealt by hash in packed blocks, and those
   that only one document holds are out: no suffix of their surroundings can repeat elsewhere.
2. *Suffixes.*  Around each remaining anchor a snippet of at most 2 * span - GRAM bytes holds every `span`-byte string
   with that anchor.  Equal snippets within a task are one (the smallest document's; the others' strings are repeats).
   Snippets meet by their anchor's hash, where again equal ones are one; the suffixes that start in those which
   share their anchor with a different snippet are sorted (others have no equal string elsewhere).
3. *Deep-shallow sorting.*  Multikey quicksort on symbols of eight bytes orders the suffixes to the shallow depth of 16
   bytes.  Groups still together go into blind tries: a node keeps only the length its strings share and branches
   on the byte after it, until the strings are apart or `span` bytes deep.  Leaves are the equal strings, and every
   suffix whose leaf holds a smaller document marks its `span` bytes.

All groups of a step are worked on at once in numpy.  Each text is shuffled once; the three passes over it share that
exchange.  Snippets are streamed in blocks, cut between anchors.

Edge cases: a null text is empty; texts under `span` bytes keep everything; rows without an id keep everything and
remove nothing; rows with equal ids are not smaller than one another; extra columns are ignored; an empty table
gives an empty result; texts are treated whole, matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import shuffle_width, stored

GRAM, SHALLOW = 24, 16
_FLUSH_KEYS, _FLUSH_BYTES, _BLOCK_ROWS = 1_000_000, 16 << 20, 20_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _symbols(b: np.ndarray) -> np.ndarray:
    """At every position the next eight bytes as one number, most significant first; len(b) - 7 values."""
    v = b.astype(np.uint64)
    for k in (1, 2, 4):
        v = (v[:-k] << np.uint64(8 * k)) | v[k:]
    return v


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every `width` consecutive values, by doubling."""
    n, have = len(x) - width + 1, 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[:n], x[width - have : width - have + n])


def anchors(raw: bytes, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a text."""
    if len(raw) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    v = _symbols(np.frombuffer(raw, np.uint8))
    n = len(raw) - GRAM + 1
    h = v[:n] * _M1
    h ^= h >> np.uint64(32)
    h = (h + v[8 : n + 8]) * _M2
    h ^= h >> np.uint64(29)
    h = (h + v[16 : n + 16]) * _M1
    h ^= h >> np.uint64(32)
    width = span - GRAM + 1
    least = _slide(h, width, np.minimum)  # of the grams of the string that starts here
    # a gram is an anchor if it is the least of some string: the largest of the minima over it equals it
    most = _slide(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, np.maximum)
    at = np.flatnonzero(most == h)
    return at, h[at]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _deal_anchors(span: int, buckets: int):
    """Packed distinct anchors of the documents: (bucket, docs, counts, keys of 32 bits)."""
    def run(batches):
        keys, docs, sizes, held = [], [], [], 0

        def flush():
            h = np.concatenate(keys)
            of = np.repeat(np.array(docs, np.int64), np.array(sizes))
            to = _bucket(h, buckets)
            order = np.argsort(to, kind="stable")
            h, of, to = h[order].astype(np.uint32), of[order], to[order]
            cut = np.flatnonzero(np.diff(to)) + 1
            out = []
            for hh, oo, tt in zip(np.split(h, cut), np.split(of, cut), np.split(to, cut)):
                starts = np.flatnonzero(np.concatenate([[True], oo[1:] != oo[:-1]]))
                runs = np.diff(np.concatenate([starts, [len(oo)]])).astype(np.uint32)
                out.append((int(tt[0]), oo[starts].tobytes(), runs.tobytes(), hh.tobytes()))
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["bucket", "docs", "counts", "keys"])

        for b in batches:
            for doc, text in zip(b.column(0), b.column(1)):
                if not doc.is_valid:
                    continue
                h = np.unique(anchors(text.as_py(), span)[1])
                if len(h):
                    keys.append(h)
                    docs.append(doc.as_py())
                    sizes.append(len(h))
                    held += len(h)
                if held >= _FLUSH_KEYS:
                    yield flush()
                    keys, docs, sizes, held = [], [], [], 0
        if keys:
            yield flush()

    return run


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: per document, its anchors that another document holds too."""
    bucket = int(pdf["bucket"].iloc[0])
    docs = np.concatenate([np.repeat(np.frombuffer(s, np.int64), np.frombuffer(c, np.uint32)) for s, c in zip(pdf["docs"], pdf["counts"])])
    keys = np.concatenate([np.frombuffer(k, np.uint32) for k in pdf["keys"]])
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = np.concatenate([starts[1:], [len(keys)]]) - 1
    both = np.repeat(docs[starts] != docs[ends], ends - starts + 1)
    keys, docs = keys[both], docs[both]
    order = np.argsort(docs, kind="stable")
    keys, docs = (np.uint64(bucket) << np.uint64(32) | keys[order].astype(np.uint64)), docs[order]
    if not len(docs):
        return pd.DataFrame({"doc_id": np.zeros(0, np.int64), "keys": []})
    cut = np.flatnonzero(np.diff(docs)) + 1
    return pd.DataFrame({"doc_id": docs[np.concatenate([[0], cut])], "keys": [k.tobytes() for k in np.split(keys, cut)]})


_ROW = "doc_id long, anchor long, at int, head int, snippet binary, runs binary"


def _snippets(span: int, buckets: int):
    """Rows of a snippet each (the smallest document's of a flush), and rows of settled runs (from, to) per document."""
    def run(batches):
        owner: dict[bytes, list] = {}  # snippet -> [smallest doc, at, head, anchor]
        settled: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush():
            for part in _cut(list(owner.items()), 20_000):
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([v[0] for _, v in part], pa.int64()), "anchor": pa.array([v[3] for _, v in part], pa.int64()),
                    "at": pa.array([v[1] for _, v in part], pa.int32()), "head": pa.array([v[2] for _, v in part], pa.int32()),
                    "snippet": pa.array([k for k, _ in part], pa.binary()), "runs": pa.nulls(len(part), pa.binary())})
            by: dict[int, list] = {}
            for doc, lo, hi in settled:
                by.setdefault(doc, []).append((lo, hi))
            for part in _cut(list(by.items()), 20_000):
                n = len(part)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([d for d, _ in part], pa.int64()), "anchor": pa.array([d for d, _ in part], pa.int64()),
                    "at": pa.nulls(n, pa.int32()), "head": pa.nulls(n, pa.int32()), "snippet": pa.nulls(n, pa.binary()),
                    "runs": pa.array([_merge(np.array(r, np.int64)).astype(np.int32).tobytes() for _, r in part], pa.binary())})

        for b in batches:
            for doc, text, packed in zip(b.column(0), b.column(1), b.column(2)):
                if not packed.is_valid:
                    continue
                doc, raw = doc.as_py(), text.as_py()
                wanted = np.frombuffer(b"".join(packed.as_py()), np.uint64)
                at, h = anchors(raw, span)
                key = (_bucket(h, buckets).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
                here = np.isin(key, wanted)
                for p, a in zip(at[here].tolist(), h[here].view(np.int64).tolist()):
                    lo = max(0, p - span + GRAM)
                    hi = min(len(raw), p + span)
                    head = p - lo
                    s = raw[lo:hi] + bytes((head,))  # the anchor's place is part of the key
                    was = owner.get(s)
                    if was is None:
                        owner[s] = [doc, lo, head, a]
                        size += len(s) + 200
                    elif was[0] == doc:
                        # the same snippet again in one document: its strings share the first one's fate
                        was.append(lo)
                    elif was[0] < doc:
                        settled.append((doc, lo, hi))
                        size += 100
                    else:
                        settled += [(was[0], x, x + hi - lo) for x in (was[1], *was[4:])]
                        owner[s] = [doc, lo, head, a]
                if size >= _FLUSH_BYTES:
                    yield from spread(owner, flush)
                    owner, settled, size = {}, [], 0
        yield from spread(owner, flush)

    def spread(owner, flush):
        yield from flush()
        again = [(k, [v[0], x, v[2], v[3]]) for k, v in owner.items() for x in v[4:]]
        for part in _cut(again, 20_000):
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([v[0] for _, v in part], pa.int64()), "anchor": pa.array([v[3] for _, v in part], pa.int64()),
                "at": pa.array([v[1] for _, v in part], pa.int32()), "head": pa.array([v[2] for _, v in part], pa.int32()),
                "snippet": pa.array([k for k, _ in part], pa.binary()), "runs": pa.nulls(len(part), pa.binary())})

    return run


def _cut(items: list, n: int):
    for i in range(0, len(items), n):
        yield items[i : i + n]


def _merge(runs: np.ndarray) -> np.ndarray:
    """Union of (from, to) pairs, ordered, as pairs."""
    runs = runs.reshape(-1, 2)
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(runs[:, 1])
    new = np.concatenate([[True], runs[1:, 0] > reach[:-1]])
    ends = np.concatenate([np.flatnonzero(new)[1:], [len(runs)]]) - 1
    return np.stack([runs[new, 0], reach[ends]], axis=1)


def equal_groups(buf: np.ndarray, pos: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort suffixes of `buf` (padded by `span` + 8 bytes) by deep-shallow sorting as far as `span` bytes.

    Returns the indexes into `pos` of suffixes whose first `span` bytes are not unique, and their group numbers."""
    sym = _symbols(buf)

    def apart(index, group, key):
        """Order by (group, key); drop what is alone; number the rest anew."""
        order = np.lexsort((key, group))
        index, group, key = index[order], group[order], key[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        alone = new & np.concatenate([new[1:], [True]])
        number = np.cumsum(new) - 1
        return index[~alone], number[~alone]

    index = np.arange(len(pos))
    group = np.zeros(len(pos), np.int64)
    for depth in range(0, SHALLOW, 8):  # multikey quicksort, a symbol at a time
        if not len(index):
            break
        index, group = apart(index, group, sym[pos[index] + depth])
    done_index, done_group, base = [], [], 0
    offsets = [*range(SHALLOW, span - 7, 8), span - 8]
    while len(index):  # a level of all blind tries
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(group)]]))
        first = np.repeat(pos[index[starts]], sizes)
        here = pos[index]
        skip = np.full(len(index), span, np.int64)
        for o in reversed(offsets):
            x = sym[here + o] ^ sym[first + o]
            differ = x != 0
            # the first differing byte of the symbol, from its leading zero bits
            _, e = np.frexp((x[differ] >> np.uint64(8)).astype(np.float64))
            lead = np.where(x[differ] >> np.uint64(8) == 0, 7, (56 - e) // 8)
            skip[differ] = o + np.clip(lead, 0, 7)
        node = np.minimum.reduceat(skip, starts)  # what all strings below share
        leaf = np.repeat(node >= span, sizes)
        done_index.append(index[leaf])
        done_group.append(group[leaf] + base)
        base += int(group[-1]) + 1
        if leaf.all():
            break
        node = np.repeat(node, sizes)[~leaf]
        index, group = index[~leaf], group[~leaf]
        index, group = apart(index, group, buf[pos[index] + node].astype(np.uint64))
    if not done_index:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(done_index), np.concatenate(done_group)


def _sort_block(span: int, rows: list[tuple]):
    """Runs (from, to) per document that the strings of these snippets mark.  rows: (doc, anchor, at, head, snippet).

    Equal snippets are one, the smallest document's; in the others all strings repeat.  A snippet that is alone with
    its anchor has no equal string elsewhere; the suffixes of the rest are sorted."""
    one: dict[bytes, list] = {}
    settled: list[tuple[int, int, int]] = []
    for doc, anchor, at, head, s in rows:
        was = one.get(s)
        if was is None:
            one[s] = [doc, anchor, head, at]
        elif doc == was[0]:
            was.append(at)
        elif doc > was[0]:
            settled.append((doc, at, at + len(s) - 1))
        else:
            settled += [(was[0], x, x + len(s) - 1) for x in was[3:]]
            one[s] = [doc, anchor, head, at]
    several = Counter(v[1] for v in one.values())
    left = [(s, v) for s, v in one.items() if several[v[1]] > 1]
    parts = [np.array(settled, np.int64).reshape(-1, 3)]
    if left:
        heads = np.array([v[2] for _, v in left], np.int64)
        docs = np.array([v[0] for _, v in left], np.int64)
        size = np.array([len(s) - 1 for s, _ in left], np.int64)  # without the place
        starts = np.cumsum(size) - size
        buf = np.frombuffer(b"".join(s[:-1] for s, _ in left) + bytes(span + 8), np.uint8)
        n = np.minimum(heads, size - span) + 1  # strings of `span` bytes that hold the anchor and fit
        of = np.repeat(np.arange(len(size)), n)
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        index, group = equal_groups(buf, starts[of] + within, span)
        if len(index):
            order = np.argsort(group, kind="stable")
            index, group = index[order], group[order]
            mine = docs[of[index]]
            edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            least = np.repeat(np.minimum.reduceat(mine, edge), np.diff(np.concatenate([edge, [len(group)]])))
            index = index[least < mine]
            where, inside = of[index], within[index]
            places = [v[3:] for _, v in left]
            times = np.array([len(x) for x in places])[where]  # a snippet may stand several times in its document
            first = np.cumsum([0, *[len(x) for x in places]])[where]
            every = np.concatenate([np.array(x, np.int64) for x in places])
            nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            begin = every[np.repeat(first, times) + nth] + np.repeat(inside, times)
            parts.append(np.stack([np.repeat(docs[where], times), begin, begin + span], axis=1))
    runs = np.concatenate(parts)
    if not len(runs):
        return
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    cut = np.flatnonzero(np.diff(runs[:, 0])) + 1
    for r in np.split(runs, cut):
        yield int(r[0, 0]), _merge(r[:, 1:]).astype(np.int32).tobytes()


def _sort_suffixes(span: int):
    """A task's snippets, ordered by anchor, in blocks that end between anchors; settled runs pass through."""
    def run(batches):
        held: list[tuple] = []

        def work(rows):
            out = list(_sort_block(span, rows))
            if out:
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in out], pa.int64()), "runs": pa.array([r for _, r in out], pa.binary())})

        for b in batches:
            ready = b.filter(b.column("runs").is_valid())
            if ready.num_rows:
                yield ready.select(["doc_id", "runs"])
            b = b.filter(b.column("snippet").is_valid())
            held += zip(*(b.column(c).to_pylist() for c in ("doc_id", "anchor", "at", "head", "snippet")))
            while len(held) > _BLOCK_ROWS and held[0][1] != held[-1][1]:
                end = min(_BLOCK_ROWS, len(held) - 1)
                while end < len(held) and held[end][1] == held[end - 1][1]:
                    end += 1
                if end == len(held):
                    break
                yield from work(held[:end])
                held = held[end:]
        if held:
            yield from work(held)

    return run


def _apply(span: int):
    def run(batches):
        for b in batches:
            out = []
            for doc, text, first, packed in zip(*(b.column(c) for c in range(4))):
                doc, raw, first = doc.as_py(), text.as_py(), first.as_py()
                if doc is not None and first is not None and first < doc and len(raw) >= span:
                    runs = np.array([[0, len(raw)]])
                else:
                    packed = packed.as_py()
                    runs = _merge(np.frombuffer(b"".join(packed), np.int32).astype(np.int64)) if packed else np.zeros((0, 2), np.int64)
                kept, end = hashlib.sha256(), 0
                for lo, hi in runs.tolist():
                    kept.update(raw[end:lo])
                    end = hi
                kept.update(raw[end:])
                out.append((doc, len(raw), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), kept.hexdigest(), runs.astype(np.int64).ravel()))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.int64()) for c in cols[1:4]], pa.array(cols[4]), pa.array(cols[5], pa.list_(pa.int64()))],
                                                 ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def repeated_spans(docs: DataFrame, span: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (from, to of the removed runs, flat)."""
    if span < GRAM + 8:
        raise ValueError(f"span must be at least {GRAM + 8} bytes")
    n = shuffle_width(docs.sparkSession)
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("raw"))
    marks = stored(slim.select("doc_id", F.unhex(F.md5("raw")).alias("digest"), F.octet_length("raw").alias("n")), "text-digests")
    first = marks.filter("doc_id is not null").groupBy("digest", "n").agg(F.min("doc_id").alias("first"))
    copies = marks.join(first, ["digest", "n"]).filter("first < doc_id").groupBy("doc_id", "digest").agg(F.min("first").alias("first"))
    copies = stored(copies.groupBy("doc_id").agg(F.collect_list(F.struct("digest", "first")).alias("copies")), "text-copies")
    placed = slim.repartition(n, "doc_id")  # the one exchange of the texts; all three passes read it
    held = placed.join(copies.hint("shuffle_hash"), "doc_id", "left")
    mine = F.get(F.filter("copies", lambda c: c.digest == F.unhex(F.md5("raw"))), F.lit(0))["first"]
    held = held.select("doc_id", "raw", F.when(F.col("copies").isNotNull(), mine).alias("first"))
    firsts = held.filter("first is null").select("doc_id", "raw")
    # Left joins, and rows without an id or shared anchors skipped in the tasks: a filter on the id would be pushed below
    # the exchange of one pass only, which would then no longer be the same exchange.
    packed = firsts.mapInArrow(_deal_anchors(span, n), "bucket int, docs binary, counts binary, keys binary")
    shared = packed.groupBy("bucket").applyInPandas(_shared, "doc_id long, keys binary").groupBy("doc_id").agg(F.collect_list("keys").alias("keys"))
    around = firsts.join(shared.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "raw", "keys").mapInArrow(_snippets(span, n), _ROW)
    runs = around.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(_sort_suffixes(span), "doc_id long, runs binary")
    runs = runs.groupBy("doc_id").agg(F.collect_list("runs").alias("runs"))
    out = held.join(runs.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "raw", "first", "runs")
    return out.mapInArrow(_apply(span), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
