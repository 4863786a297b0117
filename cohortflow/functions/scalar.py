"""Scalar column expressions shared by the operators (all built-in, JVM-side, codegen-friendly)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal / scientific number, optionally signed.  Java's parser also accepts suffixes such as
# '1e3d' and words such as 'NaN'; the guard keeps the lenient cast to what a numeric parser of text
# accepts, so both engines agree.
NUMERIC_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lenient_double(c: str | Column) -> Column:
    """Text -> double; anything that is not a number (including 'NaN') becomes NULL."""
    t = F.trim(col_(c).cast("string"))
    v = F.when(t.rlike(NUMERIC_PATTERN), t.try_cast("double"))
    return F.when(~F.isnan(v), v)


def lenient_timestamp(c: str | Column) -> Column:
    """Text or timestamp -> timestamp without zone; unparseable text becomes NULL."""
    return F.try_to_timestamp(col_(c).cast("string")).cast("timestamp_ntz")


def nan_to_null(c: str | Column) -> Column:
    c = col_(c)
    return F.when(~F.isnan(c), c)


def r6(c: str | Column) -> Column:
    """Round half up to 6 decimals with plain IEEE arithmetic (same bits in Spark and DuckDB)."""
    c = col_(c)
    return F.floor(c * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def rdp(c: str | Column, digits: int) -> Column:
    scale = float(10**digits)
    c = col_(c)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def any_code_pattern(codes: Iterable[str]) -> str:
    """Unanchored, case-sensitive 'contains any of' regex for a list of literal codes."""
    return "|".join(re.escape(c) for c in codes)


def word_flag_pattern(core: str) -> str:
    """Word-bounded, case-insensitive code pattern with an optional '.digits' sub-code."""
    return r"(?i)\b(?:" + core + r")(\.[0-9]+)?\b"


def rule_text(a: str | Column, b: str | Column, null_text: str = "None") -> Column:
    """Two code columns joined by one space; NULL rendered as `null_text` ('' for the flag form)."""
    return F.concat_ws(" ", F.coalesce(col_(a), F.lit(null_text)), F.coalesce(col_(b), F.lit(null_text)))


def clip_keep_null(c: str | Column, lo: Column | float, hi: Column | float) -> Column:
    """Clip to [lo, hi]; NULL stays NULL (least/greatest alone would turn NULL into a bound)."""
    c = col_(c)
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def recode(c: str | Column, mapping: Mapping[str, int], default: int | None = 0, normalize: bool = False) -> Column:
    """Map text codes to numbers; unknown or NULL -> default."""
    key = col_(c).cast("string")
    if normalize:
        key = F.lower(F.trim(key))
    expr = None
    for k, v in mapping.items():
        expr = (F.when(key == F.lit(k), F.lit(v))) if expr is None else expr.when(key == F.lit(k), F.lit(v))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))


def hash_order(seed: int, *cols: str | Column) -> Column:
    """Deterministic pseudo-random order key: md5 of 'seed|id...' (identical text in DuckDB)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col_(c).cast("string") for c in cols]))


def hash_unit(seed: int, *cols: str | Column, offset: int = 0) -> Column:
    """A number in [0, 1) from 8 hex digits of the md5 order key (deterministic, partition-independent)."""
    h = hash_order(seed, *cols)
    digits = F.substring(h, 1 + offset, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)
