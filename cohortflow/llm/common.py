"""Helpers shared by the training-data operators: reading tables, shared-folder tables, row keys, packed columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortflow.session import scratch_path

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write `df` to a fresh folder under the shared checkpoint folder and read it back.

    It cuts the lineage like a checkpoint, survives lost executors, and is columnar and compressed.  The shuffle files
    of the write are let go when it ends; nothing reads them again."""
    return _written(df, scratch_path(df.sparkSession, name), *partition_by)


def _written(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """The intermediate tables of one run, in one folder; a table no longer needed is dropped."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.paths = spark, scratch_path(spark, name), {}

    def write(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        out = _written(df, path, *partition_by)
        self.paths[id(out)] = (out, path)  # holds the frame, so that its id stays its own
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table that this run has written; other tables are left alone."""
        _, path = self.paths.pop(id(df), (None, None))
        if path:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def text_slices(sizes: list[int], most: int = 4 << 20):
    """(start, end) of runs of texts of about `most` bytes; a longer text is a run of its own."""
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` as one struct column `row` plus a key (`k_id`, `k_hash`, `k_n`) that is the same in every scan.

    Rows with equal id and text are numbered, so repeated rows keep their own decisions.  The rows move once, by
    the key; a join on the key needs no further exchange."""
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null:"))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), ident.alias("k_id"),
                      F.xxhash64(F.col(text_col)).alias("k_hash"))
    w = Window.partitionBy("k_id", "k_hash").orderBy(F.lit(1))
    return out.withColumn("k_n", F.row_number().over(w))


def numbered(df: DataFrame, group: list[str], order: list[Column], chunk: Column, chunks: int, name: str) -> DataFrame:
    """Add `name`: 0, 1, 2 ... within `group`, gapless, without putting a group into one task.

    Rows are numbered inside (group, chunk); `chunk` is an integer from 0 to `chunks` - 1.  Only the counts, at most
    groups times `chunks` rows, are summed across chunks; with a fixed number of groups that is a fixed bound."""
    cut = df.withColumn("_chunk", chunk)
    counts = cut.groupBy(*group, "_chunk").agg(F.count(F.lit(1)).alias("_in"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_chunk", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*group, "_chunk").orderBy(*order)
    return (cut.withColumn("_rn", F.row_number().over(inside)).join(offsets, [*group, "_chunk"])
            .withColumn(name, (F.col("_off") + F.col("_rn") - 1).cast("long")).drop("_chunk", "_rn", "_off"))
