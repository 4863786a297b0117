"""Panels stored by folder, the order key of (timestamp, row id), and the plan that reads them."""

from __future__ import annotations

import datetime as dt
import os
import re

from conftest import SMALL
from pyspark.sql import functions as F

from cohortflow.operators import cohort as C
from cohortflow.plans import cohort_queries as Q
from cohortflow.sources import panels as P

ROWS = [
    ("a", 1, 2.0), ("b c/d=e%", 2, None), ("", 3, 1.0), (None, 4, 5.0), ("a", 1, 2.0), ("é", 6, 0.5),
]


def test_panels_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "panel string, row_id long, value double").select("row_id", "panel", "value")
    path = str(tmp_path / "p")
    back = P.write_panels(df, path)
    assert back.dtypes == df.dtypes
    want = sorted((i, p or None, v) for p, i, v in ROWS)
    assert sorted(tuple(r) for r in back.collect()) == want
    for name in ("a", "b c/d=e%", "é"):
        one = spark.read.parquet(P.panel_path(path, name))
        assert one.columns == ["row_id", "value"] and one.count() == sum(r[0] == name for r in ROWS)


def test_empty_panels(spark, tmp_path):
    df = spark.createDataFrame([], "panel string, value double")
    back = P.write_panels(df, str(tmp_path / "p"))
    assert back.dtypes == df.dtypes and back.count() == 0


def test_stored_panels_follow_their_source(spark, tmp_path):
    src = str(tmp_path / "events.parquet")
    build = lambda: spark.read.parquet(src).withColumn("panel", F.lit("p"))
    get = lambda: P.stored_panels(spark, str(tmp_path), "t", ["events"], build).count()
    spark.range(3).write.parquet(src)
    assert get() == 3 and get() == 3
    spark.range(5).write.mode("append").parquet(src)
    assert get() == 8


def test_order_key_orders_like_the_pair(spark):
    t = [None, dt.datetime(1900, 1, 1), dt.datetime(2024, 3, 10, 2, 30, 0, 1), dt.datetime(2024, 3, 10, 2, 30, 0, 2),
         dt.datetime(2024, 3, 10, 3, 30), dt.datetime(9998, 12, 31)]
    ids = [None, -(2**63) + 1, -1, 0, 7, 2**63 - 1]
    rows = [(a, b) for a in t for b in ids]
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            for kind in ("timestamp_ntz", "timestamp"):
                if zone != "UTC" and kind == "timestamp":
                    continue  # an hour without local times would make two input rows equal
                df = spark.createDataFrame(rows, f"ts {kind}, rid long")
                key = C.order_key(df, "ts", "rid")
                out = df.select("ts", "rid", F.row_number().over(_by(key)).alias("k"), F.row_number().over(_by(F.struct("ts", "rid"))).alias("s"))
                assert out.filter("k <> s").count() == 0 and df.select(key).distinct().count() == len(rows)
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    texts = spark.createDataFrame([(None, "b"), (None, "a")], "ts timestamp_ntz, rid string")
    assert texts.orderBy(C.order_key(texts, "ts", "rid")).first().rid == "a"


def _by(c):
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1)).orderBy(c)


def test_features_read_the_time_range_only(spark):
    plan = Q.q_patient_features(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    pushed = re.findall(r"PushedFilters: \[([^\]]*)", plan)
    assert pushed and all("performed_at" in p for p in pushed)


def test_panel_sources_carry_their_own_headers(spark):
    out = Q.q_panel_union(spark, SMALL)
    assert out.count() == spark.read.parquet(os.path.join(SMALL, "events.parquet")).count()
    assert out.filter("panel = 'signup' AND performed_at IS NOT NULL").count() > 0
