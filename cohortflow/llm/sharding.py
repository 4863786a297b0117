"""Sharding by a k-d tree: split at distributed weighted medians along the widest metadata dimension.

Every document has integer coordinates (one per dimension, 24 bits), a weight (its bytes) and a tie-break of 36 bits.
A node that owns k shards splits along its widest dimension at the weighted quantile floor(k/2)/k of the key
(coordinate, tie-break), until every leaf owns one shard, that is, until it has reached the target bytes total/shards.
The quantile is found for all nodes of a level at once by descending the key 15 bits at a time: one partial
aggregate of (node, digit) sums per round.  The driver sees one row per node and round, never rows of the input.

Law: `bytes`.  Leaf sizes differ by a few documents; a document larger than the target makes its own leaf large.

Groups: with `whole_groups` the tree stands over groups of equal texts (weights summed, metadata of the smallest id, a
tie-break from the text), so all copies of a text lie in one shard, whatever their sources and languages.  Only a group
heavier than a leaf's target is divided, by a hash of the id, into parts of about a sixteenth of the target.  Leaves then
differ by up to about the largest undivided group.  Without it every document is placed on its own.

Edge cases: a null text has no bytes (size 16, the framing) and checksum 0, and is a copy of the empty text; null
metadata sorts first; a group of copies larger than a leaf is divided by the tie-break (a hash of the id, then the row's
place in the stored table, so repeated rows divide as well); an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import numbered, stored

KEY_BITS, DIGIT = 60, 15
OVERHEAD = 16


@dataclass
class Node:
    """A tree node: its shards [first, first + k), and once split the dimension and the key threshold."""

    first: int
    k: int
    dim: int = 0
    threshold: int | None = None
    left: "Node | None" = None
    right: "Node | None" = None


def _coordinate(c: Column, lo: Column, hi: Column) -> Column:
    """A value as an integer of 24 bits over the range of its dimension."""
    wide = F.when(hi > lo, (c - lo) / (hi - lo)).otherwise(F.lit(0.0))
    return F.coalesce((wide * F.lit(float(2**24 - 2))).cast("long") + 1, F.lit(0).cast("long"))  # null: 0, first


def _at_leaf(node: Node, value) -> Column:
    """The value of the leaf into which a row falls: one conditional per split, as deep as the tree."""
    if node.threshold is None:
        return value(node)
    return F.when(F.col(f"key{node.dim}") < F.lit(node.threshold), _at_leaf(node.left, value)).otherwise(_at_leaf(node.right, value))


def kd_tree(rows: DataFrame, n_dims: int, shards: int, tolerance: float = 0.002) -> Node:
    """Grow the tree over `rows` (key0, key1, ... long: coordinate and tie-break; weight long).

    tolerance: a median's digit bin of at most this share of the target bytes is not divided further."""
    root = Node(0, shards)
    level = [root]
    none = F.lit(None).cast("long")
    while level := [n for n in level if n.k > 1]:
        spread = [F.max(f"key{d}") - F.min(f"key{d}") for d in range(n_dims)]
        found = {r["node"]: r for r in rows.groupBy(_at_leaf(root, lambda n: F.lit(n.first)).alias("node")).agg(F.sum("weight").alias("w"), F.array(*spread).alias("wide")).collect()}
        state = {}
        for n in level:
            r = found.get(n.first)
            wide = list(r["wide"]) if r else [0] * n_dims
            n.dim = wide.index(max(wide))
            total = int(r["w"]) if r else 0
            # goal: weight for the left side; prefix: the leading bits of the key that hold the median so far
            state[n.first] = {"goal": total * (n.k // 2) / n.k, "tol": tolerance * total / n.k, "prefix": 0, "cut": None if r else 0}
        bits = 0
        while open_ := {n.first: n for n in level if state[n.first]["cut"] is None}:
            def digit(n: Node) -> Column:
                if n.first not in open_:
                    return F.struct(F.lit(n.first).alias("node"), none.alias("digit"))
                key = F.col(f"key{n.dim}")
                found = F.when(F.shiftright(key, KEY_BITS - bits) == F.lit(state[n.first]["prefix"]), F.shiftright(key, KEY_BITS - bits - DIGIT))
                return F.struct(F.lit(n.first).alias("node"), found.alias("digit"))

            digits = rows.groupBy(_at_leaf(root, digit).alias("leaf")).agg(F.sum("weight").alias("w")).select("leaf.*", "w")
            # at most 2^15 rows a node: running sums, and of those only the bin in which the goal falls
            upto = F.sum("w").over(Window.partitionBy("node").orderBy("digit"))
            last = F.max("digit").over(Window.partitionBy("node"))
            goals = F.create_map(*[x for k in open_ for x in (F.lit(k), F.lit(float(state[k]["goal"])))])
            cross = digits.filter("digit IS NOT NULL").select("node", "digit", "w", upto.alias("upto"), last.alias("last"))
            cross = cross.filter((F.col("upto") >= F.element_at(goals, F.col("node"))) | (F.col("digit") == F.col("last")))
            bits += DIGIT
            for r in cross.groupBy("node").agg(F.min(F.struct("digit", "w", "upto")).alias("x")).collect():
                s, x = state[r["node"]], r["x"]
                before, low = int(x["upto"]) - int(x["w"]), int(x["digit"]) << (KEY_BITS - bits)
                if x["w"] <= s["tol"] or bits >= KEY_BITS:
                    # the bin goes to the side that leaves the smaller error
                    s["cut"] = low if s["goal"] - before <= int(x["upto"]) - s["goal"] else low + (1 << (KEY_BITS - bits))
                s["prefix"], s["goal"] = int(x["digit"]), s["goal"] - before
        nxt = []
        for n in level:
            h = n.k // 2
            n.threshold, n.left, n.right = state[n.first]["cut"], Node(n.first, h), Node(n.first + h, n.k - h)
            nxt += [n.left, n.right]
        level = nxt
    return root


_UNIT = ["text_hash", "text_crc32", "size", "part"]


def _parts(slim: DataFrame, shards: int) -> DataFrame:
    """`slim` with `part`: 0, or for a group of equal texts above a leaf's target a part by the id.

    At most `shards` groups are above the target, so their table is small whatever the input is."""
    text = _UNIT[:3]
    groups = slim.groupBy(*text).agg((F.count(F.lit(1)) * F.first("size")).alias("weight"))
    target = (slim.agg(F.sum("size")).first()[0] or 0) / shards
    heavy = groups.filter(F.col("weight") > F.lit(target)).select(*text, F.ceil(F.col("weight") * F.lit(16 / max(target, 1.0))).alias("parts"))
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id", "place"), F.col("parts"))).otherwise(F.lit(0).cast("long"))
    return slim.join(F.broadcast(heavy), text, "left").withColumn("part", part).drop("parts")


def kd_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source",
              lang_col: str | None = "lang", chunks: int = 256, tolerance: float = 0.002, whole_groups: bool = False) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot (gapless within the shard), grown_shard (null: the
    `bytes` law gives no promise about another number of shards).

    Dimensions: language, source, logarithm of the size, checksum of the text.  The texts are read once and never
    shuffled; later passes run over the stored metadata."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    code = lambda c: F.crc32(F.col(c).cast("binary")).cast("double") if c else F.lit(0.0)
    size = (F.octet_length(text) + F.lit(OVERHEAD)).cast("long")
    slim = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
                       code(lang_col).alias("c0"), code(source_col).alias("c1"))
    slim = stored(slim.withColumn("place", F.monotonically_increasing_id()), "shard-meta")
    raw = [F.col("c0"), F.col("c1"), F.log2(F.col("size").cast("double")), F.col("text_crc32").cast("double")]
    ends = slim.agg(*[F.struct(F.min(c), F.max(c)) for c in raw]).first()
    if whole_groups:
        slim = _parts(slim, shards)
        units = slim.groupBy(*_UNIT).agg((F.count(F.lit(1)) * F.first("size")).alias("weight"), F.min(F.struct("doc_id", "c0", "c1")).alias("head"))
        units = units.select(*_UNIT, "weight", "head.c0", "head.c1")
        tie = F.pmod(F.xxhash64(*_UNIT), F.lit(2**36))
    else:
        units = slim.withColumn("weight", F.col("size"))
        tie = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(2**24)) * F.lit(2**12) + F.pmod(F.xxhash64("place"), F.lit(2**12))
    keys = [(_coordinate(c, F.lit(e[0]).cast("double"), F.lit(e[1]).cast("double")) * F.lit(2**36) + tie).alias(f"key{d}") for d, (c, e) in enumerate(zip(raw, ends))]
    rows = stored(units.select(*(_UNIT if whole_groups else ["doc_id", "size", "text_crc32", "place"]), *keys, "weight"), "shard-keys")
    root = kd_tree(rows, len(raw), shards, tolerance)
    out = rows.withColumn("shard", _at_leaf(root, lambda n: F.lit(n.first)).cast("int"))
    if whole_groups:
        out = slim.join(out.select(*_UNIT, "shard"), _UNIT)
    chunk = F.pmod(F.xxhash64("doc_id", "place"), F.lit(chunks)).cast("int")
    out = numbered(out, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("place")], chunk, chunks, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write whole documents into one folder per shard (unique ids), several tasks a shard, ordered by slot."""
    placed = docs.join(shards.select(F.col("doc_id").alias(id_col), "shard", "slot"), id_col)
    block = F.floor(F.col("slot") / F.lit(100_000))
    placed.repartition("shard", block).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
