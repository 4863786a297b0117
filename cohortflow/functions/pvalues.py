"""Closed-form tail probabilities written as column expressions.

Each formula is also available as DuckDB SQL text (``*_sql``) built from the same constants, so the
oracle computes identical arithmetic.  No SciPy is needed on executors or driver.

* Normal two-sided tail: Q(1/2, z^2/2) with the incomplete gamma below.
* Student t two-sided tail: the regularised incomplete beta I_{df/(df+t^2)}(df/2, 1/2), a continued fraction
  (modified Lentz, folded with ``aggregate`` / ``list_reduce``) for every df, fractional or large.
* Chi-square survival: the regularised upper incomplete gamma Q(dof/2, x/2) by series / continued fraction.

The number of steps grows with the square root of the degrees of freedom, as convergence asks; the factors in front
are written with log1p and the difference of two Lanczos forms, so large degrees of freedom cost no digits.  These
run on a few summary rows, one per feature.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) = erfc(|z|/sqrt 2) = Q(1/2, z^2/2), exact (incomplete gamma), capped at 1."""
    q = _gamma_q(F.lit(0.5), z * z / F.lit(2.0))
    return F.when(z.isNull(), None).when(z * z == 0, F.lit(1.0)).otherwise(F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)))


def normal_two_sided_sql(z: str) -> str:
    q = _gamma_q_sql("0.5::double", f"(({z}) * ({z}) / 2.0::double)")
    return (
        f"(CASE WHEN ({z}) IS NULL THEN NULL WHEN ({z}) * ({z}) = 0 THEN 1.0::double "
        f"ELSE least(greatest({q}, 0.0::double), 1.0::double) END)"
    )


# Lanczos approximation of log-gamma, g = 7, nine coefficients (valid for z >= 0.5).
_LANCZOS_G = 7.0
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
_HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)
_FPMIN = 1e-300
_CF_STEPS = 200


def _steps(a: Column) -> Column:
    """1, 2, ... as many steps as the expansions need at parameter a."""
    return F.sequence(F.lit(1), (F.lit(_CF_STEPS) + F.ceil(F.lit(10.0) * F.sqrt(a))).cast("int"))


def _steps_sql(a: str) -> str:
    return f"range(1, CAST({_CF_STEPS + 1} + ceil(10.0::double * sqrt({a})) AS BIGINT))"


def _log1p_sql(z: str) -> str:
    u = f"(1.0::double + ({z}))"
    return f"(CASE WHEN {u} = 1.0::double THEN ({z}) ELSE ln({u}) * (({z}) / ({u} - 1.0::double)) END)"


def _lanczos(z: Column) -> Column:
    """The sum S of log-gamma(z) = ln(2 pi) / 2 + (z - 1/2) ln(z + 13/2) - (z + 13/2) + ln S."""
    s = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], start=1):
        s = s + F.lit(c) / (z - F.lit(1.0) + F.lit(float(i)))
    return s


def _lanczos_sql(z: str) -> str:
    s = f"{_LANCZOS[0]!r}::double"
    for i, c in enumerate(_LANCZOS[1:], start=1):
        s = f"({s} + {c!r}::double / (({z}) - 1.0::double + {float(i)!r}::double))"
    return s


_SHIFT = _LANCZOS_G - 0.5  # z + _SHIFT is the base of the power above


def _guard(v: Column) -> Column:
    return F.when(F.abs(v) < F.lit(_FPMIN), F.lit(_FPMIN)).otherwise(v)


def _guard_sql(v: str) -> str:
    return f"(CASE WHEN abs({v}) < {_FPMIN!r}::double THEN {_FPMIN!r}::double ELSE {v} END)"


def _betacf(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta (modified Lentz) as an array fold."""
    qab, qap, qam = a + b, a + F.lit(1.0), a - F.lit(1.0)
    d0 = F.lit(1.0) / _guard(F.lit(1.0) - qab * x / qap)
    init = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def step(acc, m):
        m = m.cast("double")
        m2 = F.lit(2.0) * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = F.lit(1.0) / _guard(F.lit(1.0) + aa * acc["d"])
        c = _guard(F.lit(1.0) + aa / acc["c"])
        h = acc["h"] * d * c
        aa2 = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d2 = F.lit(1.0) / _guard(F.lit(1.0) + aa2 * d)
        c2 = _guard(F.lit(1.0) + aa2 / c)
        return F.struct(c2.alias("c"), d2.alias("d"), (h * d2 * c2).alias("h"))

    return F.aggregate(_steps(a + b), init, step)["h"]


def _betacf_sql(a: str, b: str, x: str) -> str:
    qab, qap, qam = f"(({a}) + ({b}))", f"(({a}) + 1.0::double)", f"(({a}) - 1.0::double)"
    d0 = f"(1.0::double / {_guard_sql(f'(1.0::double - {qab} * ({x}) / {qap})')})"
    m = "CAST(m AS DOUBLE)"
    m2 = f"(2.0::double * {m})"
    aa = f"({m} * (({b}) - {m}) * ({x}) / (({qam} + {m2}) * (({a}) + {m2})))"
    d = f"(1.0::double / {_guard_sql(f'(1.0::double + {aa} * acc.d)')})"
    c = _guard_sql(f"(1.0::double + {aa} / acc.c)")
    h = f"(acc.h * {d} * {c})"
    aa2 = f"(-(({a}) + {m}) * ({qab} + {m}) * ({x}) / ((({a}) + {m2}) * ({qap} + {m2})))"
    d2 = f"(1.0::double / {_guard_sql(f'(1.0::double + {aa2} * {d})')})"
    c2 = _guard_sql(f"(1.0::double + {aa2} / {c})")
    body = f"{{'c': {c2}, 'd': {d2}, 'h': ({h} * {d2} * {c2})}}"
    init = f"{{'c': 1.0::double, 'd': {d0}, 'h': {d0}}}"
    return f"(list_reduce({_steps_sql(qab)}, lambda acc, m: {body}, {init})).h"


def _t_tail(t2: Column, df: Column) -> Column:
    """I_x(df/2, 1/2) at x = df / (df + t2), 0 < x < 1 (symmetry picks the fast-converging side)."""
    a, half = df / F.lit(2.0), F.lit(0.5)
    x, y = df / (df + t2), t2 / (df + t2)
    base = a + F.lit(_SHIFT)
    # log-gamma(a + 1/2) - log-gamma(a), without the cancellation of the two
    gap = a * F.log1p(half / base) + half * F.log(base) - half + F.log(_lanczos(a + half) / _lanczos(a))
    front = F.exp(gap - F.lit(0.5 * math.log(math.pi)) - a * F.log1p(t2 / df) + half * F.log(y))
    direct = front * _betacf(a, half, x) / a
    mirrored = F.lit(1.0) - front * _betacf(half, a, y) / half
    return F.when(x < (a + F.lit(1.0)) / (a + F.lit(2.5)), direct).otherwise(mirrored)


def _t_tail_sql(t2: str, df: str) -> str:
    a = f"(({df}) / 2.0::double)"
    x, y = f"(({df}) / (({df}) + {t2}))", f"({t2} / (({df}) + {t2}))"
    base = f"({a} + {_SHIFT!r}::double)"
    gap = (
        f"({a} * {_log1p_sql(f'0.5::double / {base}')} + 0.5::double * ln({base}) - 0.5::double"
        f" + ln({_lanczos_sql(f'{a} + 0.5::double')} / {_lanczos_sql(a)}))"
    )
    front = f"exp({gap} - {0.5 * math.log(math.pi)!r}::double - {a} * {_log1p_sql(f'{t2} / ({df})')} + 0.5::double * ln({y}))"
    direct = f"({front} * {_betacf_sql(a, '0.5::double', x)} / {a})"
    mirrored = f"(1.0::double - {front} * {_betacf_sql('0.5::double', a, y)} / 0.5::double)"
    return f"(CASE WHEN {x} < ({a} + 1.0::double) / ({a} + 2.5::double) THEN {direct} ELSE {mirrored} END)"


def student_t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic with (possibly fractional) degrees of freedom."""
    tail = _t_tail(t * t, df)
    return (
        F.when(t.isNull() | df.isNull() | (df <= 0), None)
        .when(t * t == 0, F.lit(1.0))
        .otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))
    )


def student_t_two_sided_sql(t: str, df: str) -> str:
    t2 = f"(({t}) * ({t}))"
    return (
        f"(CASE WHEN ({t}) IS NULL OR ({df}) IS NULL OR ({df}) <= 0 THEN NULL "
        f"WHEN {t2} = 0 THEN 1.0::double "
        f"ELSE least(greatest({_t_tail_sql(t2, df)}, 0.0::double), 1.0::double) END)"
    )


def _gamma_front(a: Column, x: Column) -> Column:
    """x^a e^-x / gamma(a): with T the base of the Lanczos power and u = (x - T) / T, large terms cancel exactly."""
    base = a + F.lit(_SHIFT)
    u = (x - base) / base
    log = F.when(F.abs(u) < 0.5, F.log1p(u)).otherwise(F.log(x / base))
    return F.exp(a * (log - u) - F.lit(_SHIFT) * u + F.lit(0.5) * F.log(base) - F.lit(_HALF_LOG_2PI) - F.log(_lanczos(a)))


def _gamma_front_sql(a: str, x: str) -> str:
    base = f"(({a}) + {_SHIFT!r}::double)"
    u = f"((({x}) - {base}) / {base})"
    log = f"(CASE WHEN abs({u}) < 0.5 THEN {_log1p_sql(u)} ELSE ln(({x}) / {base}) END)"
    return (
        f"exp(({a}) * ({log} - {u}) - {_SHIFT!r}::double * {u} + 0.5::double * ln({base})"
        f" - {_HALF_LOG_2PI!r}::double - ln({_lanczos_sql(a)}))"
    )


def _gamma_q(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma Q(a, x): series below a + 1, continued fraction above."""
    front = _gamma_front(a, x)
    ser0 = F.struct(a.alias("ap"), (F.lit(1.0) / a).alias("dl"), (F.lit(1.0) / a).alias("sm"))

    def ser_step(acc, _n):
        ap = acc["ap"] + F.lit(1.0)
        dl = acc["dl"] * x / ap
        return F.struct(ap.alias("ap"), dl.alias("dl"), (acc["sm"] + dl).alias("sm"))

    p_series = F.aggregate(_steps(a), ser0, ser_step)["sm"] * front
    b0 = x + F.lit(1.0) - a
    cf0 = F.struct(b0.alias("b"), F.lit(1.0 / _FPMIN).alias("c"), (F.lit(1.0) / _guard(b0)).alias("d"),
                   (F.lit(1.0) / _guard(b0)).alias("h"))

    def cf_step(acc, i):
        i = i.cast("double")
        an = -i * (i - a)
        b = acc["b"] + F.lit(2.0)
        d = F.lit(1.0) / _guard(an * acc["d"] + b)
        c = _guard(b + an / acc["c"])
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"))

    q_cf = F.aggregate(_steps(a), cf0, cf_step)["h"] * front
    return F.when(x < a + F.lit(1.0), F.lit(1.0) - p_series).otherwise(q_cf)


def _gamma_q_sql(a: str, x: str) -> str:
    front = _gamma_front_sql(a, x)
    ser_body = (
        "{'ap': acc.ap + 1.0::double, 'dl': acc.dl * (" + x + ") / (acc.ap + 1.0::double), "
        "'sm': acc.sm + acc.dl * (" + x + ") / (acc.ap + 1.0::double)}"
    )
    ser_init = f"{{'ap': ({a})::double, 'dl': 1.0::double / ({a}), 'sm': 1.0::double / ({a})}}"
    p_series = f"((list_reduce({_steps_sql(a)}, lambda acc, n: {ser_body}, {ser_init})).sm * {front})"
    b0 = f"(({x}) + 1.0::double - ({a}))"
    i = "CAST(i AS DOUBLE)"
    an = f"(-{i} * ({i} - ({a})))"
    b = "(acc.b + 2.0::double)"
    d = f"(1.0::double / {_guard_sql(f'({an} * acc.d + {b})')})"
    c = _guard_sql(f"({b} + {an} / acc.c)")
    cf_body = f"{{'b': {b}, 'c': {c}, 'd': {d}, 'h': (acc.h * {d} * {c})}}"
    cf_init = (
        f"{{'b': {b0}, 'c': {1.0 / _FPMIN!r}::double, 'd': 1.0::double / {_guard_sql(b0)}, "
        f"'h': 1.0::double / {_guard_sql(b0)}}}"
    )
    q_cf = f"((list_reduce({_steps_sql(a)}, lambda acc, i: {cf_body}, {cf_init})).h * {front})"
    return f"(CASE WHEN ({x}) < ({a}) + 1.0::double THEN 1.0::double - {p_series} ELSE {q_cf} END)"


def chi2_sf(x: Column, dof: Column) -> Column:
    """Upper tail of chi-square: Q(dof/2, x/2)."""
    k = dof.cast("double")
    exact = _gamma_q(k / F.lit(2.0), x / F.lit(2.0))
    return (
        F.when(x.isNull() | dof.isNull() | (dof < 1), None)
        .when(x <= 0, F.lit(1.0))
        .otherwise(F.least(F.greatest(exact, F.lit(0.0)), F.lit(1.0)))
    )


def chi2_sf_sql(x: str, dof: str) -> str:
    k = f"(({dof})::double)"
    exact = _gamma_q_sql(f"({k} / 2.0::double)", f"(({x}) / 2.0::double)")
    return (
        f"(CASE WHEN ({x}) IS NULL OR ({dof}) IS NULL OR ({dof}) < 1 THEN NULL "
        f"WHEN ({x}) <= 0 THEN 1.0::double "
        f"ELSE least(greatest({exact}, 0.0::double), 1.0::double) END)"
    )


def r6_sql(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.5) / 1e6)"


def rdp_sql(x: str, digits: int) -> str:
    scale = float(10**digits)
    return f"(floor(({x}) * {scale!r} + 0.5) / {scale!r})"
