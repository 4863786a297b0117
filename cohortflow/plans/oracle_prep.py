"""DuckDB oracle SQL for the preparation queries (parameters fitted in SQL from the same training rows)."""

from __future__ import annotations

from cohortflow.functions.pvalues import rdp_sql
from cohortflow.plans.common import rounded_sql
from cohortflow.plans.prep_queries import (
    BINARY,
    CONTINUOUS,
    K_NEIGHBOURS,
    MISSING_COLS,
    MISSING_THRESHOLD,
    MODEL_FEATURES,
    N_FOLDS,
    SEED,
    TEST_FRACTION,
)
from cohortflow.sources import fixtures as FX

_MISS = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, avg(CASE WHEN {c} IS NULL THEN 1.0::double ELSE 0.0::double END) AS missing_ratio FROM train"
    for c in MISSING_COLS
)
_KEPT = "SELECT feature FROM miss WHERE missing_ratio <= " + repr(MISSING_THRESHOLD) + "::double"


def _hash(*parts: str) -> str:
    return f"md5(concat_ws('|', '{SEED}', {', '.join(parts)}))"


def _unit(*parts: str) -> str:
    return f"(CAST('0x' || substr({_hash(*parts)}, 1, 8) AS BIGINT) / 4294967296.0::double)"


SPLIT = {
    "fx_b": FX.CUSTOMER_FEATURES_SQL,
    "split": f"""SELECT b.* EXCLUDE (rk, n), CASE WHEN rk <= floor(n * {TEST_FRACTION!r}::double + 0.5::double) THEN 'test' ELSE 'train' END AS split
                 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_hash('CAST(row_id AS VARCHAR)')}) AS rk,
                              count(*) OVER (PARTITION BY label) AS n FROM fx_b) b""",
    "train": "SELECT * FROM split WHERE split = 'train'",
    "miss": _MISS,
}

_C = CONTINUOUS
PARAMS = dict(SPLIT)
PARAMS["pm1"] = (
    "SELECT "
    + ", ".join(f"quantile_cont({c}, 0.5) AS med_{c}" for c in _C)
    + ", "
    + ", ".join(
        f"(SELECT arg_max(v, (n, -v)) FROM (SELECT {b}::double AS v, count(*) AS n FROM train WHERE {b} IS NOT NULL GROUP BY 1) x) AS mode_{b}"
        for b in BINARY
    )
    + " FROM train"
)
PARAMS["imp"] = (
    "SELECT s.row_id, s.label, s.split, "
    + ", ".join(f"COALESCE({c}::double, med_{c}) AS {c}" for c in _C)
    + ", "
    + ", ".join(f"COALESCE({b}::double, mode_{b}) AS {b}" for b in BINARY)
    + " FROM split s CROSS JOIN pm1"
)
PARAMS["pm2"] = (
    "SELECT "
    + ", ".join(
        f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}, "
        f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}"
        for c in _C
    )
    + " FROM imp WHERE split = 'train'"
)
PARAMS["cap"] = (
    "SELECT i.row_id, i.label, i.split, "
    + ", ".join(f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, lo_{c}), hi_{c}) END AS {c}" for c in _C)
    + ", "
    + ", ".join(BINARY)
    + " FROM imp i CROSS JOIN pm2"
)
PARAMS["pm3"] = (
    "SELECT "
    + ", ".join(
        f"avg({c}) AS mean_{c}, CASE WHEN stddev_pop({c}) IS NULL OR stddev_pop({c}) = 0 THEN 1.0::double ELSE stddev_pop({c}) END AS scale_{c}"
        for c in _C
    )
    + " FROM cap WHERE split = 'train'"
)
PARAMS["prepared"] = (
    "SELECT c.row_id, c.label, c.split, "
    + ", ".join(f"({c} - mean_{c}) / scale_{c} AS {c}" for c in _C)
    + ", "
    + ", ".join(BINARY)
    + " FROM cap c CROSS JOIN pm3"
)
PARAMS["params"] = "\nUNION ALL\n".join(
    [
        f"SELECT '{c}' AS feature, 'continuous' AS kind, med_{c} AS median, NULL::double AS mode, lo_{c} AS lo, hi_{c} AS hi, "
        f"mean_{c} AS mean, scale_{c} AS scale FROM pm1, pm2, pm3"
        for c in _C
    ]
    + [
        f"SELECT '{b}', 'binary', NULL::double, mode_{b}, NULL::double, NULL::double, NULL::double, NULL::double FROM pm1"
        for b in BINARY
    ]
)
PARAMS["kept_params"] = f"SELECT * FROM params WHERE feature IN ({_KEPT})"

_MF = MODEL_FEATURES
MODEL = dict(PARAMS)
MODEL["mt"] = "SELECT row_id, label, " + ", ".join(f"{rdp_sql(c, 9)} AS {c}" for c in _MF) + " FROM prepared WHERE split = 'train'"
MODEL["mins"] = "SELECT * FROM mt WHERE label = 1"
_DIST = "sqrt(" + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _MF) + ")"
MODEL["knn"] = f"""SELECT * FROM (
    SELECT a.row_id, b.row_id AS nn_row_id, {_DIST} AS dist,
           row_number() OVER (PARTITION BY a.row_id ORDER BY {_DIST}, b.row_id) AS nn_rank
    FROM mins a JOIN mins b ON a.row_id <> b.row_id) x WHERE nn_rank <= {K_NEIGHBOURS}"""
MODEL["cnt"] = "SELECT count(*) FILTER (WHERE label = 1) AS n_min, count(*) FILTER (WHERE label = 0) AS n_maj FROM mt"
MODEL["ranked"] = f"SELECT *, row_number() OVER (ORDER BY {_hash(chr(39) + 'all' + chr(39), chr(39) + 'base' + chr(39), 'CAST(row_id AS VARCHAR)')}) - 1 AS idx FROM mins"
MODEL["slots"] = f"""SELECT s AS slot,
       CAST(floor({_unit("'all'", "'b'", 'CAST(s AS VARCHAR)')} * n_min::double) AS BIGINT) AS idx,
       CAST(floor({_unit("'all'", "'n'", 'CAST(s AS VARCHAR)')} * least({K_NEIGHBOURS}, n_min - 1)::double) + 1 AS INTEGER) AS nn_rank,
       {_unit("'all'", "'g'", 'CAST(s AS VARCHAR)')} AS gap
FROM cnt CROSS JOIN range(0, n_maj - n_min) r(s)"""
MODEL["syn"] = (
    "SELECT 'syn-all-' || CAST(sl.slot AS VARCHAR) AS sample_id, 1 AS label, true AS is_synthetic, "
    + ", ".join(f"r.{c} + sl.gap * (x.{c} - r.{c}) AS {c}" for c in _MF)
    + """ FROM slots sl JOIN ranked r USING (idx)
          JOIN knn k ON k.row_id = r.row_id AND k.nn_rank = sl.nn_rank
          JOIN mins x ON x.row_id = k.nn_row_id"""
)

ORACLE = {
    "stratified_split": FX.cte(**SPLIT) + "SELECT row_id, label, split FROM split",
    "drop_sparse": FX.cte(**SPLIT)
    + rounded_sql(f"SELECT feature, missing_ratio, missing_ratio > {MISSING_THRESHOLD!r}::double AS dropped FROM miss", ["missing_ratio"]),
    "label_encode": FX.cte(**SPLIT)
    + """SELECT s.row_id, s.split, s.segment, CAST(m.code AS INTEGER) AS segment_code FROM split s
         LEFT JOIN (SELECT segment AS cat, dense_rank() OVER (ORDER BY segment) - 1 AS code
                    FROM (SELECT DISTINCT segment FROM train WHERE segment IS NOT NULL) d) m ON s.segment = m.cat""",
    "impute": FX.cte(**PARAMS)
    + rounded_sql(
        """SELECT feature, CASE WHEN kind = 'continuous' THEN 'median' ELSE 'most_frequent' END AS strategy,
                  COALESCE(median, mode) AS fill_value FROM kept_params""",
        ["fill_value"],
    ),
    "winsorize": FX.cte(**PARAMS)
    + rounded_sql(
        "\nUNION ALL\n".join(
            f"""SELECT '{c}' AS feature, lo_{c} AS lo, hi_{c} AS hi,
                       CAST(count(*) FILTER (WHERE split = 'train' AND ({c} < lo_{c} OR {c} > hi_{c})) AS BIGINT) AS n_clipped_train,
                       CAST(count(*) FILTER (WHERE split = 'test' AND ({c} < lo_{c} OR {c} > hi_{c})) AS BIGINT) AS n_clipped_test
                FROM imp CROSS JOIN pm2 WHERE '{c}' IN ({_KEPT}) GROUP BY lo_{c}, hi_{c}"""
            for c in _C
        ),
        ["lo", "hi"],
    ),
    "standardize": FX.cte(**PARAMS)
    + rounded_sql("SELECT feature, mean, scale FROM kept_params WHERE kind = 'continuous'", ["mean", "scale"]),
    "fitted_params": FX.cte(**PARAMS)
    + rounded_sql("SELECT * FROM kept_params", ["median", "mode", "lo", "hi", "mean", "scale"]),
    "apply_params": FX.cte(**PARAMS)
    + rounded_sql(
        "\nUNION ALL\n".join(
            f"SELECT row_id, label, '{c}' AS feature, {c}::double AS value FROM prepared WHERE split = 'test' AND '{c}' IN ({_KEPT})"
            for c in _C + BINARY
        ),
        ["value"],
    ),
    "one_hot": FX.cte(**SPLIT)
    + """SELECT s.row_id, s.split, c.category, COALESCE(CAST(s.segment = c.category AS INTEGER), 0) AS indicator
         FROM split s CROSS JOIN (SELECT DISTINCT segment AS category FROM train WHERE segment IS NOT NULL) c""",
    "class_weights": FX.cte(**SPLIT)
    + rounded_sql(
        """SELECT label, n, t.total / (t.k * n) AS weight, CASE WHEN t.n_pos = 0 THEN NULL ELSE t.n_neg::double / t.n_pos::double END AS scale_pos_weight
           FROM (SELECT label, count(*) AS n FROM train GROUP BY label) c,
                (SELECT count(*) AS total, count(*) FILTER (WHERE label = 0) AS n_neg, count(*) FILTER (WHERE label = 1) AS n_pos,
                        count(DISTINCT label) AS k FROM train) t""",
        ["weight", "scale_pos_weight"],
    ),
    "kfold_assign": FX.cte(**SPLIT)
    + f"""SELECT row_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {_hash("'fold'", 'CAST(row_id AS VARCHAR)')}) - 1) % {N_FOLDS} AS INTEGER) AS fold
          FROM train""",
    "knn_minority": FX.cte(**MODEL) + rounded_sql("SELECT row_id, nn_rank, nn_row_id, dist FROM knn", ["dist"]),
    "smote": FX.cte(**MODEL)
    + rounded_sql(
        "SELECT CAST(row_id AS VARCHAR) AS sample_id, label, false AS is_synthetic, "
        + ", ".join(_MF)
        + " FROM mt UNION ALL SELECT * FROM syn",
        _MF,
    ),
    "fold_summary": FX.cte(**SPLIT)
    + f"""SELECT f AS fold, n_val_0, n_val_1, n_train_0, n_train_1,
                 greatest(n_train_0, n_train_1) AS n_balanced_0, greatest(n_train_0, n_train_1) AS n_balanced_1
          FROM (SELECT fold AS f,
                       CAST(count(*) FILTER (WHERE label = 0) AS BIGINT) AS n_val_0, CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS n_val_1
                FROM (SELECT label, CAST((row_number() OVER (PARTITION BY label ORDER BY {_hash("'fold'", 'CAST(row_id AS VARCHAR)')}) - 1) % {N_FOLDS} AS INTEGER) AS fold FROM train) a
                GROUP BY fold) v
          JOIN (SELECT tf AS f,
                       CAST(count(*) FILTER (WHERE label = 0) AS BIGINT) AS n_train_0, CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS n_train_1
                FROM (SELECT label, CAST((row_number() OVER (PARTITION BY label ORDER BY {_hash("'fold'", 'CAST(row_id AS VARCHAR)')}) - 1) % {N_FOLDS} AS INTEGER) AS fold FROM train) a
                CROSS JOIN range(0, {N_FOLDS}) r(tf) WHERE tf <> fold GROUP BY tf) t USING (f)""",
}
