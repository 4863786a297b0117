"""Session helpers: building a session for local runs and locating the shared scratch folder.

On a cluster the session is created by the caller; `spark.checkpoint.dir` is read from it and must be set.
A temporary checkpoint folder is created only for a `local` master without that setting (tests and benches).
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_STEP = threading.local()


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "cohortflow") -> SparkSession:
    """Local session with the settings every operator assumes (UTC, AQE, no UI)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.  Only a session with a `local` master that names none gets a private
    temporary one; elsewhere the setting is required, because executors would not see a folder of the driver."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(_CHECKPOINT_KEY, None) or sc.getConf().get(_CHECKPOINT_KEY, None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="cohortflow-ckpt-")
        spark.conf.set(_CHECKPOINT_KEY, configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder (for stream inputs, sink round trips)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "cohortflow", f"{name}-{uuid.uuid4().hex[:12]}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder; survives executor loss, unlike a local checkpoint.

    Inside a `step` it is a table of the step instead, compressed and deleted with it."""
    folder = getattr(_STEP, "folder", None)
    if folder and not any(t in df.schema.simpleString() for t in ("void", "interval", "variant")):  # Parquet has no such types
        return _written(df, f"{folder}/{uuid.uuid4().hex[:12]}")
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _written(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """`df` as a table at `path`.  The shuffle files of the write are let go when it ends; nothing reads them again."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """Whatever `cut_lineage` stores inside is deleted when the block ends: nothing lazy may leave it.  A part that the
    session keeps must be made before."""
    outer, _STEP.folder = getattr(_STEP, "folder", None), scratch_path(spark, "step")
    try:
        yield
    finally:
        delete_path(spark, _STEP.folder)
        _STEP.folder = outer


def stored(spark: SparkSession, build: Callable[[], DataFrame], *partition_by: str) -> DataFrame:
    """What `build` returns, as a table under the shared checkpoint folder (of the outer step, if there is one); what was
    stored on the way to it is deleted."""
    outer = getattr(_STEP, "folder", None)
    path = f"{outer}/{uuid.uuid4().hex[:12]}" if outer else scratch_path(spark, "stored")
    with step(spark):
        return _written(build(), path, *partition_by)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan (filters and column pruning reach the reader)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


_MATERIALIZED: dict[tuple[str, str], DataFrame] = {}
_OBJECTS: dict[tuple[str, str], object] = {}


def session_object(spark: SparkSession, key: str, build):
    """A driver-side object (fitted parameters, models) built once per application."""
    k = (spark.sparkContext.applicationId, key)
    if k not in _OBJECTS:
        _OBJECTS[k] = build()
    return _OBJECTS[k]


def is_materialized(spark: SparkSession, key: str) -> bool:
    return (spark.sparkContext.applicationId, key) in _MATERIALIZED


def materialized(spark: SparkSession, key: str, build) -> DataFrame:
    """A derived table computed once per application and reused by later steps (the analogue of writing the
    feature table once and reading it in every later step).  Kept with MEMORY_AND_DISK persistence: blocks
    lost with an executor are recomputed from lineage, so reuse never changes results."""
    k = (spark.sparkContext.applicationId, key)
    if k not in _MATERIALIZED:
        _MATERIALIZED[k] = build().persist(StorageLevel.MEMORY_AND_DISK)
    return _MATERIALIZED[k]
