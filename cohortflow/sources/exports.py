"""SNK-2: named tables as sorted Parquet files with a manifest (rows, columns, checksum) that a reader can verify.

    <folder>/<table>/..     the rows, range-partitioned and sorted by the table's order columns, columns as listed
    <folder>/_manifest/..   one JSON row per table, written after all tables

Count and checksum are observed while a table is written, so they describe what was sent to the writer; `verify`
computes them again from the files.  The checksum is the sum of 64-bit row hashes: it does not depend on the order of
rows or files, and a row that stands twice counts twice.

Edge cases: an empty table has 0 rows and checksum 0; NULLs are hashed like values; without order columns rows stay as
they are dealt; a table that is not there, or has other columns than listed, does not verify.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cohortflow.session import path_exists

MANIFEST = "table string, columns array<string>, order_columns array<string>, n_rows long, checksum string"


def _facts(columns: Sequence[str]) -> tuple[Column, Column]:
    """Row count, and the sum of row hashes (a NULL is hashed with its place, so it cannot move between columns)."""
    values = [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    total = F.sum(F.xxhash64(*values).cast("decimal(38,0)"))
    return F.count(F.lit(1)).alias("n_rows"), F.coalesce(total, F.lit(0).cast("decimal(38,0)")).cast("string").alias("checksum")


def export(spark: SparkSession, tables: Mapping[str, tuple[DataFrame, Sequence[str], Sequence[str]]], path: str) -> DataFrame:
    """Write every {name: (rows, columns, order columns)} and the manifest; return the manifest as it is stored."""
    lines = []
    for name, (df, columns, order) in tables.items():
        rows = df.select(*[F.col(f"`{c}`") for c in columns])
        if order:
            rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        seen = Observation(f"export {name}")
        rows.observe(seen, *_facts(columns)).write.parquet(os.path.join(path, name))
        lines.append((name, list(columns), list(order), seen.get["n_rows"], seen.get["checksum"]))
    spark.createDataFrame(lines, MANIFEST).coalesce(1).write.json(os.path.join(path, "_manifest"))
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(os.path.join(path, "_manifest"))


def verify(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with `verified`: the files have the listed columns in order, as many rows and the same checksum."""
    checked = []
    for line in manifest(spark, path).collect():  # one row a table
        at = os.path.join(path, line["table"])
        good = path_exists(spark, at)
        if good:
            rows = spark.read.parquet(at)
            good = rows.columns == line["columns"]
            if good:
                found = rows.agg(*_facts(rows.columns)).first()
                good = (found["n_rows"], found["checksum"]) == (line["n_rows"], line["checksum"])
        checked.append((*line, good))
    return spark.createDataFrame(checked, f"{MANIFEST}, verified boolean")
