"""Correlation network of features: edges and nodes as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.functions.labels import numeric_target
from tabwarden.functions.types import as_double, numeric_columns
from tabwarden.operators.profile import pair_moments
from tabwarden.plans.schemas import DEFAULTS

# Node sizes.
TARGET_SIZE, FEATURE_SIZE = 10, 5


def edges(df: DataFrame, target: str, threshold: float = DEFAULTS["network_edge"]) -> DataFrame:
    """(source, target, value): abs correlation of numeric columns at or above the threshold.

    A label target joins in by its code.
    """
    names = numeric_columns(df)
    values = {c: as_double(df, c) for c in names}
    if target not in names:
        df, values[target] = numeric_target(df, target)
        names.append(target)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    strong = pair_moments(df, pairs, values).withColumn("value", F.abs("value")).where(F.col("value") >= threshold)
    return strong.select(F.col("feature_a").alias("source"), F.col("feature_b").alias("target"), "value")


def nodes(df: DataFrame, target: str, scores: DataFrame, high: float = DEFAULTS["network_high_risk"]) -> DataFrame:
    """One row per numeric column and the target, with its risk score and group."""
    names = numeric_columns(df, [target]) + [target]
    base = df.sparkSession.createDataFrame([(c, c == target) for c in names], "id string, is_target boolean")
    joined = base.join(F.broadcast(scores.select(F.col("feature").alias("id"), "risk_score")), "id", "left")
    risk = F.coalesce("risk_score", F.lit(0.0))
    group = F.when(F.col("is_target"), "target").when(risk > high, "high_risk").otherwise("normal")
    size = F.when(F.col("is_target"), F.lit(TARGET_SIZE)).otherwise(F.lit(FEATURE_SIZE))
    return joined.select("id", size.alias("val"), group.alias("group"), risk.alias("risk_score"), "is_target")
