"""Shared helpers for the registered queries: cached fixture builders and output rounding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from cohortflow.functions.pvalues import r6_sql
from cohortflow.functions.scalar import r6


def round_doubles(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column to 6 decimals (half up, IEEE arithmetic identical to the SQL oracle)."""
    cols = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (DoubleType, FloatType)) and f.name not in exclude
    ]
    if not cols:
        return df
    return df.withColumns({c: r6(F.col(c)) for c in cols})


def rounded_sql(select_sql: str, double_cols: list[str]) -> str:
    """Wrap a SELECT so the named double columns are rounded like ``round_doubles``."""
    if not double_cols:
        return select_sql
    repl = ", ".join(f"{r6_sql(c)} AS {c}" for c in double_cols)
    return f"SELECT * REPLACE ({repl}) FROM ({select_sql}) _r"
