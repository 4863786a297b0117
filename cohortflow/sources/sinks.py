"""Sinks: Parquet / CSV / JSON writers for entity tables, matrices, stat tables and fitted parameters.

Every writer targets a folder (one file per partition, written by executors); nothing passes through the
driver.  ``roundtrip_*`` write into the shared checkpoint folder and read the result back, which is how the
sink queries are checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortflow.session import scratch_path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header row, UTF-8 (no byte-order mark)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def roundtrip_parquet(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    write_parquet(df, path)
    return df.sparkSession.read.parquet(path)


def roundtrip_csv(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    write_csv(df, path)
    return df.sparkSession.read.option("header", True).schema(df.schema).csv(path)


def roundtrip_json(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    write_json(df, path)
    return df.sparkSession.read.schema(df.schema).json(path)
