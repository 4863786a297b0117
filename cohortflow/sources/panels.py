"""Panels as one table on shared storage, a folder per panel.

A tall table is written once with ``partitionBy(panel)``: a reader of one panel opens that panel's files only, a reader
of a time range has its filter in the parquet reader, and nothing is held in executor memory between steps.  A panel
name that is NULL or empty comes back as NULL (that is what a partition folder can hold); an empty table leaves no panel
folder, and reading it gives no rows."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.session import path_exists, scratch_path, session_object

#: fixed values: the characters that stand as %XX in the name of a partition folder
_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")


def write_panels(tall: DataFrame, path: str, panel_col: str = "panel") -> DataFrame:
    """Write `tall` in one pass, a folder per panel, and return the table as read back (same columns and types)."""
    tall.write.partitionBy(panel_col).parquet(path)
    return tall.sparkSession.read.schema(tall.schema).parquet(path).select(*[F.col(f"`{c}`") for c in tall.columns])


def panel_path(path: str, panel: str, panel_col: str = "panel") -> str:
    """The folder of one panel inside a table of `write_panels`."""
    return os.path.join(path, f"{panel_col}=" + _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", panel))


def input_version(spark: SparkSession, path: str) -> str:
    """Newest change, bytes and number of the files of a source: it changes when the files do."""
    if not path_exists(spark, path):
        return "absent"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listStatus(where)
    return f"{max([f.getModificationTime() for f in files], default=0)}-{sum(f.getLen() for f in files)}-{len(files)}"


def stored_panels(spark: SparkSession, sf_dir: str, name: str, sources: list[str], build, panel_col: str = "panel") -> DataFrame:
    """The panels table `name` of a data folder: written by its first user in the session, read by all others.

    It is written anew when one of its sources has changed files."""
    versions = "/".join(input_version(spark, os.path.join(sf_dir, f"{s}.parquet")) for s in sources)
    return session_object(spark, f"panels:{name}:{sf_dir}:{versions}", lambda: write_panels(build(), scratch_path(spark, name), panel_col))

