"""Suspicious feature names, dominant features, constant features."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.functions.labels import class_codes
from tabwarden.functions.types import as_double, atomic_columns, clean, numeric_columns
from tabwarden.operators import leakage
from tabwarden.operators.profile import column_base
from tabwarden.plans.schemas import DEFAULTS

DETECTOR = "feature"

# Name patterns checked by default, and the longer optional list.
SUSPICIOUS_NAMES = (r".*_future.*", r".*_target.*", r".*_label.*", r".*_outcome.*")
SUSPICIOUS_NAMES_WIDE = (
    r".*_future.*", r".*_target.*", r".*_label.*", r".*_outcome.*", r".*_result.*", r".*_prediction.*",
    r".*_pred.*", r".*_actual.*", r".*_y_.*", r"^y_.*", r".*_next_.*", r".*_tomorrow.*",
)
TREES, DEPTH, SEED = 50, 5, 42
MAX_CLASSES = 10


def suspicious_names(df: DataFrame, target: str | None = None, patterns: Sequence[str] = SUSPICIOUS_NAMES) -> dict[str, list[str]]:
    """Features per pattern; each feature counts for the first pattern it matches."""
    compiled = [(p, re.compile(p, re.IGNORECASE)) for p in patterns]
    out: dict[str, list[str]] = {}
    for c in df.columns:
        hit = next((p for p, rx in compiled if c != target and rx.match(c)), None)
        if hit:
            out.setdefault(hit, []).append(c)
    return out


def constant_features(df: DataFrame, target: str | None = None) -> DataFrame:
    """(feature, unique_count, kind): constant, or near-constant below 1% and 3 values."""
    base = column_base(df, atomic_columns(df, [target] if target else []))
    kind = F.when(F.col("unique_count") <= 1, "constant").when((F.col("unique_pct") < 0.01) & (F.col("unique_count") <= 3), "near_constant")
    return base.select(F.col("column").alias("feature"), "unique_count", kind.alias("kind")).where("kind is not null")


def feature_importance(df: DataFrame, target: str, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> DataFrame | None:
    """(feature, importance) from a random forest; None below two numeric features.

    The forest is trained by Spark over all rows; a numeric target with more
    than ten values makes it a regression.
    """
    names = numeric_columns(df, [target])
    if len(names) < 2:
        return None
    numeric = target in numeric_columns(df)
    distinct = df.select(clean(df, target).alias("v")).where("v is not null").distinct().limit(MAX_CLASSES + 1).count() if numeric else 0
    vector = VectorAssembler(inputCols=[f"x{i}" for i in range(len(names))], outputCol="features")
    features = [F.coalesce(as_double(df, c), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(names)]
    if distinct > MAX_CLASSES:
        model = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, labelCol="y")
        prepared = df.select(*features, as_double(df, target).alias("y")).where("y is not null")
    else:
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="y")
        prepared = class_codes(df, target, "__y").select(*features, F.col("__y").alias("y"))
    fitted = model.fit(vector.transform(prepared).select("features", "y"))
    found = [(c, float(w)) for c, w in zip(names, fitted.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(found, "feature string, importance double")


def detect(
    train: DataFrame, target: str | None, patterns: Sequence[str] = SUSPICIOUS_NAMES,
    importance_threshold: float = DEFAULTS["importance"], check_importance: bool = True,
) -> DataFrame:
    spark = train.sparkSession
    found = [leakage.checked(spark, DETECTOR)]
    for p, names in suspicious_names(train, target, patterns).items():
        found += [(DETECTOR, "suspicious_feature_name", "warning", n, 0, None, None, "Review these features for potential data leakage") for n in names]
    parts = [leakage.rows(spark, found)]
    if target and check_importance and target in train.columns:
        importance = feature_importance(train, target)
        if importance is not None:
            parts.append(
                leakage.finding(
                    importance.where(F.col("importance") >= importance_threshold), DETECTOR, "high_importance_feature", "warning",
                    F.format_string("Investigate why '%s' has such high predictive power", "feature"),
                    feature=F.col("feature"), score=F.round("importance", 4), threshold=importance_threshold,
                )
            )
    constant = constant_features(train, target).where("kind = 'constant'")
    parts.append(leakage.finding(constant, DETECTOR, "constant_feature", "info", "Consider removing constant features", feature=F.col("feature")))
    return leakage.union(parts)
