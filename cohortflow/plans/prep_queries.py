"""Registered preparation queries over fixture B: split, fitted parameters, encodings, folds, k-NN, SMOTE."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.operators import prep as P
from cohortflow.operators.eda import to_tall
from cohortflow.operators.knn import knn_exact
from cohortflow.operators.resample import smote
from cohortflow.plans.common import round_doubles
from cohortflow.plans.eda_queries import b_rows, b_table
from cohortflow.session import cut_lineage, session_object, step, stored
from cohortflow.sources import fixtures as FX
from cohortflow.sources.sinks import roundtrip_parquet

SEED = 42
TEST_FRACTION = 0.2
MISSING_THRESHOLD = 0.6
CONTINUOUS = FX.B_CONTINUOUS
BINARY = ["flag_urgent"]
MISSING_COLS = CONTINUOUS + BINARY + ["segment"]
MODEL_FEATURES = ["qty_mean", "price_mean", "disc_mean", "balance", "late_price_mean", "price_max", "qty_std", "flag_urgent"]
K_NEIGHBOURS = 5
N_FOLDS = 5


def split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.stratified_split(b_table(spark, sf_dir), "row_id", "label", TEST_FRACTION, SEED)


def _ratios(split: DataFrame) -> DataFrame:
    return P.missing_ratios(split.filter(F.col("split") == "train"), MISSING_COLS)


class Prepared:
    """Split + parameters fitted on the training rows (per-feature scalars only on the driver), when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.split = stored(spark, lambda: P.stratified_split(cut_lineage(b_rows(spark, sf_dir)), "row_id", "label", TEST_FRACTION, SEED))
        self.train = self.split.filter(F.col("split") == "train")
        ratios = {r["feature"]: r["missing_ratio"] for r in _ratios(self.split).collect()}  # <= #features
        self.dropped = [f for f in MISSING_COLS if (ratios.get(f) or 0.0) > MISSING_THRESHOLD]
        self.continuous = [c for c in CONTINUOUS if c not in self.dropped]

    @cached_property
    def params(self) -> P.Params:
        with step(self.split.sparkSession):
            return P.fit_preprocessor(self.train, "row_id", "label", self.continuous, BINARY)

    def applied(self) -> DataFrame:
        return P.apply_preprocessor(self.split, self.params)

    def model_train(self) -> DataFrame:
        t = P.apply_preprocessor(self.train, self.params).select("row_id", "label", *MODEL_FEATURES)
        return P.round_features(t, MODEL_FEATURES)


def prepared(spark: SparkSession, sf_dir: str) -> Prepared:
    return session_object(spark, f"prepared:{sf_dir}", lambda: Prepared(spark, sf_dir))


def q_stratified_split(spark, sf_dir):
    return split_table(spark, sf_dir).select("row_id", "label", "split")


def q_drop_sparse(spark, sf_dir):
    r = _ratios(split_table(spark, sf_dir))
    return round_doubles(r.withColumn("dropped", F.col("missing_ratio") > F.lit(MISSING_THRESHOLD)))


def q_label_encode(spark, sf_dir):
    s = split_table(spark, sf_dir)
    mapping = P.fit_label_encoding(s.filter(F.col("split") == "train"), "segment")
    return P.apply_label_encoding(s.select("row_id", "split", "segment"), "segment", mapping, "segment_code")


def q_impute(spark, sf_dir):
    p = prepared(spark, sf_dir).params
    pf = p.to_frame(spark)
    return round_doubles(
        pf.select(
            "feature",
            F.when(F.col("kind") == "continuous", F.lit("median")).otherwise(F.lit("most_frequent")).alias("strategy"),
            F.coalesce("median", "mode").alias("fill_value"),
        )
    )


def q_winsorize(spark, sf_dir):
    pr = prepared(spark, sf_dir)
    p = pr.params
    imputed = P.impute(pr.split, p)
    tall = to_tall(imputed.withColumn("grp", F.col("split")), "row_id", "grp", p.continuous)
    bounds = p.to_frame(spark).filter(F.col("kind") == "continuous").select("feature", "lo", "hi")
    j = tall.join(F.broadcast(bounds), "feature")  # one row per feature
    out_of = (F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))
    counts = j.groupBy("feature", "lo", "hi").agg(
        F.count_if(out_of & (F.col("grp") == "train")).cast("bigint").alias("n_clipped_train"),
        F.count_if(out_of & (F.col("grp") == "test")).cast("bigint").alias("n_clipped_test"),
    )
    return round_doubles(counts)


def q_standardize(spark, sf_dir):
    pf = prepared(spark, sf_dir).params.to_frame(spark)
    return round_doubles(pf.filter(F.col("kind") == "continuous").select("feature", "mean", "scale"))


def q_fitted_params(spark, sf_dir):
    pf = prepared(spark, sf_dir).params.to_frame(spark)
    return round_doubles(roundtrip_parquet(pf, "fitted-params"))


def q_apply_params(spark, sf_dir):
    pr = prepared(spark, sf_dir)
    test = P.apply_preprocessor(pr.split.filter(F.col("split") == "test"), pr.params)
    tall = to_tall(test, "row_id", "label", pr.continuous + BINARY)
    return round_doubles(tall)


def q_one_hot(spark, sf_dir):
    s = split_table(spark, sf_dir)
    cats = P.train_categories(s.filter(F.col("split") == "train"), "segment")
    wide = P.one_hot(s.select("row_id", "split", "segment"), "segment", cats)
    cols = [f"segment_{c}" for c in cats]
    return wide.unpivot(["row_id", "split"], cols, "category", "indicator").withColumn(
        "category", F.regexp_replace("category", "^segment_", "")
    )


def q_class_weights(spark, sf_dir):
    s = split_table(spark, sf_dir)
    return round_doubles(P.class_weights(s.filter(F.col("split") == "train"), "label"))


def fold_table(spark, sf_dir):
    s = split_table(spark, sf_dir)
    return P.kfold_assign(s.filter(F.col("split") == "train"), "row_id", "label", N_FOLDS, SEED)


def q_kfold_assign(spark, sf_dir):
    return fold_table(spark, sf_dir).select("row_id", "label", "fold")


def q_knn_minority(spark, sf_dir):
    t = prepared(spark, sf_dir).model_train().filter(F.col("label") == 1)
    nn = knn_exact(t, "row_id", MODEL_FEATURES, K_NEIGHBOURS)
    return round_doubles(nn.select("row_id", "nn_rank", F.col("nn_id").alias("nn_row_id"), "dist"))


def q_smote(spark, sf_dir):
    t = prepared(spark, sf_dir).model_train()
    return round_doubles(smote(t, "row_id", "label", MODEL_FEATURES, K_NEIGHBOURS, SEED))


def q_fold_summary(spark, sf_dir):
    """Rebalance inside each fold's training part (never across folds) and report class counts."""
    t = prepared(spark, sf_dir).model_train()
    return stored(spark, lambda: _fold_counts(t))


def _fold_counts(t: DataFrame) -> DataFrame:
    t = cut_lineage(t)
    folds = P.kfold_assign(t.select("row_id", "label"), "row_id", "label", N_FOLDS, SEED).select("row_id", "fold")
    tf = cut_lineage(t.join(folds, "row_id"))
    # each row trains every fold except its own
    fit_rows = tf.withColumn("train_fold", F.explode(F.sequence(F.lit(0), F.lit(N_FOLDS - 1)))).filter(
        F.col("train_fold") != F.col("fold")
    )
    bal = smote(fit_rows.drop("fold"), "row_id", "label", MODEL_FEATURES, K_NEIGHBOURS, SEED, group_col="train_fold")
    bal_counts = bal.groupBy(F.col("train_fold").alias("fold")).agg(
        F.count_if((F.col("label") == 0) & ~F.col("is_synthetic")).cast("bigint").alias("n_train_0"),
        F.count_if((F.col("label") == 1) & ~F.col("is_synthetic")).cast("bigint").alias("n_train_1"),
        F.count_if(F.col("label") == 0).cast("bigint").alias("n_balanced_0"),
        F.count_if(F.col("label") == 1).cast("bigint").alias("n_balanced_1"),
    )
    val = tf.groupBy("fold").agg(
        F.count_if(F.col("label") == 0).cast("bigint").alias("n_val_0"),
        F.count_if(F.col("label") == 1).cast("bigint").alias("n_val_1"),
    )
    return val.join(bal_counts, "fold")


QUERIES = {
    "stratified_split": q_stratified_split,
    "drop_sparse": q_drop_sparse,
    "label_encode": q_label_encode,
    "impute": q_impute,
    "winsorize": q_winsorize,
    "standardize": q_standardize,
    "fitted_params": q_fitted_params,
    "apply_params": q_apply_params,
    "one_hot": q_one_hot,
    "class_weights": q_class_weights,
    "kfold_assign": q_kfold_assign,
    "knn_minority": q_knn_minority,
    "smote": q_smote,
    "fold_summary": q_fold_summary,
}
