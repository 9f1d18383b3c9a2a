"""Fraud models (M1-M13): features, stable split, tree / forest pipelines,
metrics, scoring and model comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.schema import (
    COMPARE_TIE, COMPARE_TIE_POINTS, FOREST_TREES, FRAUD, FRAUD_CATEGORICAL,
    FRAUD_INPUT_DEFAULTS, FRAUD_NUMERIC, MODEL_NAMES, MODEL_SEED, TEST_PERCENT, TREE_MAX_DEPTH,
    TX_ID, VERDICT_FRAUD, VERDICT_SAFE,
)

KINDS = ("decision_tree", "random_forest")
NULL_CATEGORY = "nan"  # a missing category is its own value, as in the reference encoder


class OneClassTraining(ValueError):
    """The training split holds a single class, so no fraud probability exists."""


def fraud_features(df: DataFrame) -> DataFrame:
    """M1: the six model inputs plus the label (and the id used for the split)."""
    return df.select(TX_ID, *FRAUD_NUMERIC, *FRAUD_CATEGORICAL, FRAUD)


def hash_bucket(id_col: str = TX_ID):
    """0-99 from the first 32 bits of md5(id); NULL id hashes as empty text."""
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 8), 16, 10)
    return h.cast("bigint") % 100


def split_by_hash(df: DataFrame, id_col: str = TX_ID, test_pct: int = TEST_PERCENT) -> DataFrame:
    """M3: ``is_test`` flag for about ``test_pct`` % of rows, fixed by the id alone —
    the same rows on any partitioning, on any re-run, after any executor loss."""
    return df.withColumn("is_test", hash_bucket(id_col) < test_pct)


def _prepared(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(NULL_CATEGORY))
                           for c in FRAUD_CATEGORICAL})


def build_pipeline(kind: str = "decision_tree", max_bins: int = 256) -> Pipeline:
    """M2 + M4/M5: index (alphabetical, unseen → extra bucket), one-hot with the
    extra bucket dropped (unseen → all zero), assemble with the numeric inputs,
    then the classifier."""
    if kind not in KINDS:
        raise ValueError(f"unknown model kind {kind!r}; expected one of {KINDS}")
    idx = [f"{c}__idx" for c in FRAUD_CATEGORICAL]
    ohe = [f"{c}__ohe" for c in FRAUD_CATEGORICAL]
    stages = [
        StringIndexer(inputCols=FRAUD_CATEGORICAL, outputCols=idx, handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True),
        VectorAssembler(inputCols=ohe + FRAUD_NUMERIC, outputCol="features"),
    ]
    if kind == "decision_tree":
        clf = DecisionTreeClassifier(labelCol=FRAUD, featuresCol="features", maxDepth=TREE_MAX_DEPTH,
                                     maxBins=max_bins, impurity="gini", seed=MODEL_SEED)
    else:
        clf = RandomForestClassifier(labelCol=FRAUD, featuresCol="features", maxDepth=TREE_MAX_DEPTH,
                                     numTrees=FOREST_TREES, featureSubsetStrategy="sqrt",
                                     bootstrap=True, maxBins=max_bins, impurity="gini", seed=MODEL_SEED)
    return Pipeline(stages=stages + [clf])


@dataclass
class FraudModel:
    kind: str
    model: PipelineModel

    @property
    def classifier(self):
        return self.model.stages[-1]

    def feature_names(self) -> list[tuple[str, str | None]]:
        """(source column, category value or None) per vector slot, in order."""
        labels = self.model.stages[0].labelsArray
        out = []
        for c, labs in zip(FRAUD_CATEGORICAL, labels):
            out += [(c, v) for v in labs]
        return out + [(c, None) for c in FRAUD_NUMERIC]


def fit_fraud_model(df: DataFrame, kind: str = "decision_tree", test_pct: int = TEST_PERCENT) -> FraudModel:
    """Fit on the non-test hash split (M3). One-class training data raises.

    Only the model inputs are kept and persisted for the fit: the class check,
    the indexer vocabulary and every tree-growing pass read that cache rather
    than re-running the source plan.
    """
    cols = [*FRAUD_NUMERIC, *FRAUD_CATEGORICAL, FRAUD]
    train = (_prepared(split_by_hash(df, TX_ID, test_pct).where(~F.col("is_test")))
             .select(*cols).persist(StorageLevel.MEMORY_AND_DISK))
    try:
        classes = train.agg(F.count_if(F.col(FRAUD) == 1).alias("p"),
                            F.count_if(F.col(FRAUD) != 1).alias("q")).first()
        if not classes["p"] or not classes["q"]:
            raise OneClassTraining("training split holds a single class; fraud probability undefined")
        return FraudModel(kind, build_pipeline(kind).fit(train))
    finally:
        train.unpersist()


def predict(model: FraudModel, df: DataFrame) -> DataFrame:
    return model.model.transform(_prepared(df))


def test_predictions(model: FraudModel, df: DataFrame, test_pct: int = TEST_PERCENT) -> DataFrame:
    return predict(model, split_by_hash(df, TX_ID, test_pct).where(F.col("is_test")))


# ---------------------------------------------------------------------------
# M6-M8 metrics
# ---------------------------------------------------------------------------
def confusion_counts(df: DataFrame, label: str = FRAUD, prediction: str = "prediction") -> DataFrame:
    """``(label, prediction, n)`` for the pairs that occur (tiny output)."""
    return df.groupBy(F.col(label).cast("int").alias("label"),
                      F.col(prediction).cast("int").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, label: str = FRAUD, prediction: str = "prediction") -> DataFrame:
    """M6: accuracy and support-weighted precision / recall / F1 (0 where undefined),
    over the classes present in the labels or predictions.

    The confusion counts (a few rows) are spread to per-class
    ``(support, predicted, tp)`` contributions and folded: no joins.
    """
    return _metrics_of(confusion_counts(df, label, prediction))


def _metrics_of(cc: DataFrame) -> DataFrame:
    """M6 from ``(label, prediction, n)`` rows."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(zero)
    parts = F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("tp")),
        F.struct(F.col("prediction").alias("cls"), zero.alias("support"), F.col("n").alias("predicted"),
                 zero.alias("tp")))
    per = (cc.select(F.explode(parts).alias("s")).select("s.*").groupBy("cls")
           .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
                F.sum("tp").alias("tp")))
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    per = per.select("support", "tp", p.alias("p"), r.alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    total = F.sum("support")
    return per.agg(
        F.coalesce(F.try_divide(F.sum("tp"), total), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.try_divide(F.sum(F.col("support") * F.col("p")), total), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(F.sum(F.col("support") * F.col("r")), total), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(F.sum(F.col("support") * f1), total), F.lit(0.0)).alias("f1_score"),
    )


def confusion(df: DataFrame, label: str = FRAUD, prediction: str = "prediction") -> DataFrame:
    """M7: confusion counts as rows ``(label, prediction, count)``, rows = truth: the 2×2 matrix
    zero-filled, and a row for every pair with another label that occurs."""
    zero = df.sparkSession.range(4).select(F.floor(F.col("id") / 2).cast("int").alias("label"),
                                           (F.col("id") % 2).cast("int").alias("prediction"), F.lit(0).cast("long").alias("n"))
    seen = df.select(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction"),
                     F.lit(1).cast("long").alias("n"))
    return seen.unionByName(zero).groupBy("label", "prediction").agg(F.sum("n").alias("count"))


def class_counts(df: DataFrame, label: str = FRAUD) -> DataFrame:
    """M8: total, fraud and normal row counts of the full set."""
    return df.agg(F.count(F.lit(1)).alias("total_samples"),
                  F.count_if(F.col(label) == 1).alias("fraud_samples"),
                  F.count_if(F.col(label) == 0).alias("normal_samples"))


def metrics_from_counts(counts: DataFrame, kind: str, classes: DataFrame) -> DataFrame:
    """The row of ``evaluate`` from confusion counts and full-set class counts."""
    m = _metrics_of(counts.where("count > 0").select("label", "prediction", F.col("count").alias("n")))
    row = classes.agg(F.struct(*[F.first(c).alias(c) for c in
                                 ("total_samples", "fraud_samples", "normal_samples")])).scalar()
    return m.select(F.lit(kind).alias("model"), "*", *[row[c].alias(c) for c in
                                                       ("total_samples", "fraud_samples", "normal_samples")])


def evaluate(model: FraudModel, df: DataFrame) -> DataFrame:
    """Metrics row of a fitted model on its held-out split plus full-set counts."""
    m = classification_metrics(test_predictions(model, df))
    counts = class_counts(df).agg(F.struct(*[F.first(c).alias(c) for c in
                                            ("total_samples", "fraud_samples", "normal_samples")])).scalar()
    return m.select(F.lit(model.kind).alias("model"), "*",
                    counts["total_samples"].alias("total_samples"),
                    counts["fraud_samples"].alias("fraud_samples"),
                    counts["normal_samples"].alias("normal_samples"))


# ---------------------------------------------------------------------------
# M9, M10 scoring
# ---------------------------------------------------------------------------
def with_input_defaults(df: DataFrame) -> DataFrame:
    """Missing inputs take the form defaults; absent columns are added."""
    out = df
    for c, v in FRAUD_INPUT_DEFAULTS.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in out.columns else F.lit(v))
    return out


def with_absent_defaults(df: DataFrame) -> DataFrame:
    """What scoring a table of transactions reads: only an absent field (no such column) takes
    the form default. A null category stays null and is scored as the model was trained on it,
    so scoring, evaluation and explanation give a row one verdict; a null number, which no
    training row has, takes the default."""
    out = df
    for c, v in FRAUD_INPUT_DEFAULTS.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(v))
        elif c in FRAUD_NUMERIC:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


def score(model: FraudModel, df: DataFrame, null_is_absent: bool = True) -> DataFrame:
    """M9: class, fraud probability, percent (1 decimal) and verdict per row.

    A table of requests read from records cannot tell a field that was left out from a null
    one, so nulls take the form defaults; for transactions pass ``null_is_absent=False`` (see
    :func:`with_absent_defaults`). ``unseen_category`` marks rows whose category value was not in training
    (it scores as an all-zero one-hot block)."""
    d = with_input_defaults(df) if null_is_absent else with_absent_defaults(df)
    labels = model.model.stages[0].labelsArray
    unseen = F.lit(False)
    for c, labs in zip(FRAUD_CATEGORICAL, labels):
        unseen = unseen | ~F.coalesce(F.col(c).cast("string"), F.lit(NULL_CATEGORY)).isin(*labs)
    given = {f"{c}__given": F.col(c) for c in FRAUD_CATEGORICAL}       # the encoder names missing ones
    scored = predict(model, d.withColumns({"unseen_category": unseen, **given}))
    scored = scored.withColumns({c: F.col(f"{c}__given") for c in FRAUD_CATEGORICAL})
    prob = vector_to_array("probability")[1]
    keep = [c for c in df.columns if c not in ("features", "probability", "rawPrediction", "prediction")]
    out = scored.select(*keep, *[c for c in FRAUD_INPUT_DEFAULTS if c not in keep], "unseen_category",
                        F.col("prediction").cast("int").alias("is_fraud_pred"), prob.alias("probability"))
    return with_verdict(out)


def with_verdict(df: DataFrame) -> DataFrame:
    """M9: percent and verdict text of the columns ``is_fraud_pred`` and ``probability``."""
    return df.withColumns({
        "probability_pct": F.round(F.col("probability") * 100, 1),
        "verdict": F.when(F.col("is_fraud_pred") == 1, VERDICT_FRAUD).otherwise(VERDICT_SAFE),
    })


def encoded(df: DataFrame) -> DataFrame:
    """M2: the model's input vector per row as an array: one slot per category value in
    alphabetical order (a missing category is the value ``nan``), then the numbers. The
    vocabulary is that of ``df``; see ``build_pipeline``."""
    stages = build_pipeline().getStages()[:-1]
    rows = _prepared(df)
    vectors = Pipeline(stages=stages).fit(rows).transform(rows)
    return vectors.select(TX_ID, vector_to_array("features").alias("features"))


# ---------------------------------------------------------------------------
# M13 comparison
# ---------------------------------------------------------------------------
def compare_models(metrics: DataFrame, a: str = "decision_tree", b: str = "random_forest",
                   tie_points: float = COMPARE_TIE_POINTS) -> DataFrame:
    """Per metric the two values in percent, winner (or tie when closer than
    ``tie_points``) and the margin. ``metrics`` holds one row per model."""
    names = ["accuracy", "f1_score", "precision", "recall"]
    piv = metrics.agg(*[F.max(F.when(F.col("model") == m, F.col(n))).alias(f"{n}__{i}")
                        for n in names for i, m in enumerate((a, b))])
    pairs = ", ".join(f"'{n}', {n}__0 * 100, {n}__1 * 100" for n in names)
    long = piv.select(F.expr(f"stack({len(names)}, {pairs}) as (metric, value_a, value_b)"))
    diff = F.col("value_a") - F.col("value_b")
    return long.select(
        "metric", "value_a", "value_b",
        F.when(F.abs(diff) < tie_points, COMPARE_TIE).when(diff > 0, MODEL_NAMES.get(a, a))
         .otherwise(MODEL_NAMES.get(b, b)).alias("winner"),
        F.when(F.abs(diff) < tie_points, 0.0).otherwise(F.abs(diff)).alias("margin"))
