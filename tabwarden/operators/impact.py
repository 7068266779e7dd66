"""Before / after experiment: model quality with and without suspicious features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.functions.expr import ratio
from tabwarden.functions.labels import class_codes
from tabwarden.functions.ordering import running_totals, value_buckets
from tabwarden.functions.types import as_double, col, numeric_columns
from tabwarden.operators import risk
from tabwarden.plans.schemas import DEFAULTS
from tabwarden.sources.sampling import stratified_folds, stratified_split

FOLDS = 5
TEST_SIZE = 0.2
SEED = 42
# Verdict limits on the accuracy drop, and smallest divisor of the stability change.
SIGNIFICANT, MODERATE, STABILITY_FLOOR = 0.1, 0.02, 0.001

# Advice per verdict.
ADVICE = {
    "significant": ("Remove identified leaky features", "Review feature engineering pipeline", "Audit data collection process"),
    "moderate": ("Review suspicious features", "Monitor model performance in production", "Consider partial removal"),
    "minimal": ("Features appear clean", "Maintain monitoring", "Document findings"),
}


def classification_metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy, precision, recall and F1 of class 1; a zero division gives 0."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    counts = predictions.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == F.col(prediction)).alias("hit"),
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return counts.select(
        zero(ratio(F.col("hit"), F.col("n"))).alias("accuracy"),
        zero(ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision"),
        zero(ratio(F.col("tp"), F.col("tp") + F.col("fn"))).alias("recall"),
        zero(ratio(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn"))).alias("f1"),
    )


def roc_auc(predictions: DataFrame, label: str = "label", score: str = "score", target_rows: int | None = None) -> DataFrame:
    """One row: area under the ROC curve, ties counted half, NULL with a single class.

    Rows are grouped by score first; a running total of the negatives over the
    distinct scores replaces the global ranking.
    """
    flat = predictions.select(F.col(score).cast("double").alias("s"), (F.col(label) == 1).alias("y")).where("s is not null")
    flat, ids = value_buckets(flat, ["s"], target_rows)
    by = flat.groupBy("s", "s__b").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))
    run = running_totals(by.withColumn("g", F.lit(0)), ["g"], "s", "s__b", ["neg"], split=ids > 1)
    wins = F.col("pos") * (F.col("upto_neg") - F.col("neg") + F.col("neg") / 2.0)
    return run.agg(ratio(F.sum(wins), F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def _model(kind: str, width: int, rows: int) -> Pipeline:
    if kind == "random_forest":
        last = RandomForestClassifier(numTrees=100, maxDepth=10, seed=SEED, featuresCol="scaled")
    elif kind == "logistic":
        # One unit of L2 penalty against the summed loss; Spark averages the loss over rows.
        last = LogisticRegression(maxIter=1000, regParam=1.0 / max(rows, 1), tol=1e-4, featuresCol="scaled")
    else:
        raise ValueError(f"unknown model type: {kind}")
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=[f"x{i}" for i in range(width)], outputCol="features"),
            StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
            last,
        ]
    )


def _prepared(df: DataFrame, columns: Sequence[str], target: str, key: str) -> DataFrame:
    """Features with missing values as 0, a 0-based label, the split and the folds."""
    coded = class_codes(df, target, "__label")
    flat = coded.select(*[F.coalesce(as_double(df, c), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(columns)], F.col("__label").alias("label"), col(key).alias("key"))
    return stratified_split(flat, "label", "key", TEST_SIZE)


def evaluate(prepared: DataFrame, width: int, kind: str = "random_forest", folds: int = FOLDS) -> dict[str, float]:
    """Metrics of a model on the test side and its cross-validated accuracy on the train side."""
    prepared = prepared.persist()  # read by every fit
    train, test = prepared.where("side = 'train'"), prepared.where("side = 'test'")
    model = _model(kind, width, train.count())
    predicted = model.fit(train).transform(test).withColumn("score", vector_to_array("probability")[1])
    out = classification_metrics(predicted).first().asDict()
    out["roc_auc"] = roc_auc(predicted).first()[0]
    folded = stratified_folds(train, "label", "key", folds).persist()
    scores = []
    for k in range(folds):
        held = model.fit(folded.where(F.col("fold") != k)).transform(folded.where(F.col("fold") == k))
        scores.append(held.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0])
    folded.unpersist()
    prepared.unpersist()
    mean = sum(scores) / folds
    out["cv_accuracy_mean"] = mean
    out["cv_accuracy_std"] = (sum((s - mean) ** 2 for s in scores) / folds) ** 0.5
    return out


def kept_features(columns: Sequence[str], leaky: Sequence[str]) -> list[str]:
    """Columns without the leaky ones; all of them if nothing would be left."""
    return [c for c in columns if c not in set(leaky)] or list(columns)


def compare(metrics: DataFrame) -> DataFrame:
    """One row from two metric rows (stage "before" and "after"): drops, gaps, verdict, advice."""
    at = lambda stage, m: F.max(F.when(F.col("stage") == stage, F.col(m)))
    drop = at("before", "accuracy") - at("after", "accuracy")
    row = metrics.agg(
        drop.alias("accuracy_drop"),
        (at("before", "cv_accuracy_mean") - at("before", "accuracy")).alias("generalization_gap_before"),
        (at("after", "cv_accuracy_mean") - at("after", "accuracy")).alias("generalization_gap_after"),
        ((at("before", "cv_accuracy_std") - at("after", "cv_accuracy_std")) / F.greatest(at("before", "cv_accuracy_std"), F.lit(STABILITY_FLOOR))).alias("stability_improvement"),
    )
    d = F.col("accuracy_drop")
    verdict = F.when(d > SIGNIFICANT, "significant").when(d > MODERATE, "moderate").otherwise("minimal")
    advice = reduce(lambda acc, kv: acc.when(verdict == kv[0], F.array(*map(F.lit, kv[1]))), list(ADVICE.items())[1:], F.when(verdict == "significant", F.array(*map(F.lit, ADVICE["significant"]))))
    return row.select("*", verdict.alias("verdict"), advice.alias("advice"))


METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "cv_accuracy_mean", "cv_accuracy_std")


def run_experiment(
    df: DataFrame, target: str, key: str, time_column: str | None = None, kind: str = "random_forest",
    risk_threshold: float = DEFAULTS["impact_removal"], folds: int = FOLDS,
) -> tuple[DataFrame, DataFrame]:
    """(metrics, removed): a metric row per stage, and the features taken out.

    Fits run on the cluster one after another; only scores come back.
    """
    columns = numeric_columns(df, [target, time_column or "", key])
    if not columns:
        raise ValueError("no numeric features for modelling")
    scored = risk.predict_risk(df.select(*[col(c) for c in dict.fromkeys([*columns, target, key, *([time_column] if time_column else [])])]), target, key, time_column)
    leaky = [r["feature"] for r in scored.where(F.col("risk_score") >= risk_threshold).select("feature").collect() if r["feature"] != key]
    rows = []
    for stage, names in (("before", columns), ("after", kept_features(columns, leaky))):
        m = evaluate(_prepared(df, names, target, key), len(names), kind, folds)
        rows.append((stage, len(names), *[None if m[x] is None else float(m[x]) for x in METRICS]))
    spark = df.sparkSession
    metrics = spark.createDataFrame(rows, "stage string, features int, " + ", ".join(f"{m} double" for m in METRICS))
    return metrics, spark.createDataFrame([(c,) for c in leaky], "feature string")
