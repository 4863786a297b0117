"""Local correctness check: run a registered Spark query and its DuckDB oracle on the same parquet files.

Values are compared exactly after canonical formatting (both sides round their own doubles), rows are
compared as a multiset, columns by sorted name -- the same shape of check the driver performs.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v == 0.0:
            v = 0.0
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "tolist"):
        return repr(v.tolist())
    if isinstance(v, (list, tuple)):
        return repr([_canon(x) for x in v])
    return str(v)


def canon_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_canon(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda t: tuple("" if x is None else x for x in t))


_SPARK_TO_DUCK = {
    "LongType()": "BIGINT", "IntegerType()": "INTEGER", "DoubleType()": "DOUBLE", "StringType()": "VARCHAR",
    "BooleanType()": "BOOLEAN", "TimestampNTZType()": "TIMESTAMP", "DateType()": "DATE",
}


def compare(spark, name: str, query, sql: str, sf_dir: str, con=None) -> dict:
    df = query(spark, sf_dir)
    s_cols = df.columns
    s_types = {f.name: _SPARK_TO_DUCK.get(repr(f.dataType), repr(f.dataType)) for f in df.schema.fields}
    s_rows = [tuple(r) for r in df.collect()]
    con = con or duck(sf_dir)
    rel = con.sql(sql)
    d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    sc, sr = canon_rows(s_cols, s_rows)
    dc, dr = canon_rows(d_cols, d_rows)
    out = {"name": name, "spark_rows": len(sr), "oracle_rows": len(dr), "cols_match": sc == dc,
           "types_match": s_types == d_types}
    if not out["types_match"]:
        out["type_diff"] = {c: (s_types.get(c), d_types.get(c)) for c in set(s_types) | set(d_types) if s_types.get(c) != d_types.get(c)}
    out["values_match"] = out["cols_match"] and sr == dr
    if not out["values_match"]:
        out["spark_cols"] = sc
        out["oracle_cols"] = dc
        diff_s = [r for r in sr if r not in set(dr)][:3]
        diff_d = [r for r in dr if r not in set(sr)][:3]
        out["only_spark"] = diff_s
        out["only_oracle"] = diff_d
    return out
