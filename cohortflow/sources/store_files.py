"""The entity / visit store as files laid out for lookups (JN-5).

    <store>/patients/bucket=ab/..   one row per entity, `bucket` the first hex digits of its id
    <store>/visits/bucket=ab/..     visits by the bucket of their entity

Ids are md5 texts of the codes, so buckets are even, and an id or a code gives its bucket without a look at the data.
Files are ranges of (bucket, id, date): a lookup prunes to one partition folder, inside which the ranges of the ids in
the file footers leave few row groups to read; a hot entity's visits lie in several files.

Edge cases: an unknown code or id gives no rows; an entity without visits gives its row and no visits; a NULL code has
the id of the NULL text and is found by `code=None` only if such an entity was loaded.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "bucket"


def id_of_code(code: str | None) -> str:
    """The surrogate id of a code (`operators.store.surrogate_id` of one column)."""
    return hashlib.md5(("<null>" if code is None else code).encode()).hexdigest()


def write_store(patients: DataFrame, visits: DataFrame, path: str, digits: int = 2, files: int | None = None) -> None:
    """Write both tables in `16 ** digits` buckets, dealt over about `files` ranges (default: the shuffle partitions)."""
    n = files or int(patients.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for df, name, keys in ((patients, "patients", ["id"]), (visits, "visits", ["patient_id", "visit_date", "visit_id"])):
        placed = df.withColumn(BUCKET, F.substring(keys[0], 1, digits))
        placed = placed.repartitionByRange(n, BUCKET, *keys).sortWithinPartitions(BUCKET, *keys)
        placed.write.partitionBy(BUCKET).parquet(os.path.join(path, name))


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the tables; its bucket is text, whatever its digits look like."""
    at = os.path.join(path, name)
    inside = spark.read.option("mergeSchema", False).parquet(at).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inside.fields if f.name != BUCKET)
    return spark.read.schema(f"{kinds}, {BUCKET} string").parquet(at)


def lookup(spark: SparkSession, path: str, code: str | None = None, id: str | None = None, digits: int = 2) -> tuple[DataFrame, DataFrame]:
    """(the entity, its visits) by its id, or by its code where no id is given."""
    key = id if id is not None else id_of_code(code)
    here = F.col(BUCKET) == key[:digits]
    patients, visits = (_table(spark, path, name) for name in ("patients", "visits"))
    return (patients.filter(here & (F.col("id") == key)).drop(BUCKET), visits.filter(here & (F.col("patient_id") == key)).drop(BUCKET))
