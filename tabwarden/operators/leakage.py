"""Finding rows of the leakage detectors, and their roll-ups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwarden.functions.expr import unranked, worst
from tabwarden.plans.schemas import LEAKAGE

# Statuses and severities, mildest first.
DETECTOR_RANK = {"clean": 0, "skipped": 1, "error": 2, "detected": 3}
SEVERITIES = ("info", "warning", "critical")


def rows(spark: SparkSession, found: Sequence[tuple]) -> DataFrame:
    """Findings known while planning (names, skipped detectors)."""
    return spark.createDataFrame(list(found), LEAKAGE)


def checked(spark: SparkSession, detector: str) -> tuple:
    """Marker that a detector ran; not an issue."""
    return (detector, "checked", "none", None, 0, None, None, None)


def skipped(detector: str, why: str) -> tuple:
    return (detector, "skipped", "info", None, 0, None, None, why)


def failed(detector: str, why: str) -> tuple:
    return (detector, "error", "critical", None, 0, None, None, why)


def finding(
    df: DataFrame, detector: str, leakage_type: str, severity: str, recommendation: Column | str,
    feature: Column | None = None, affected: Column | None = None, score: Column | None = None, threshold: float | None = None,
) -> DataFrame:
    """Each row of ``df`` as a finding."""
    return df.select(
        F.lit(detector).alias("detector"), F.lit(leakage_type).alias("leakage_type"), F.lit(severity).alias("severity"),
        (feature if feature is not None else F.lit(None)).cast("string").alias("feature"),
        (affected if affected is not None else F.lit(0)).cast("long").alias("affected_rows"),
        (score if score is not None else F.lit(None)).cast("double").alias("score"),
        F.lit(threshold).cast("double").alias("threshold"),
        (F.lit(recommendation) if isinstance(recommendation, str) else recommendation).cast("string").alias("recommendation"),
    )


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def issues(found: DataFrame) -> DataFrame:
    return found.where(F.col("severity").isin(*SEVERITIES))


def detector_status(found: DataFrame) -> DataFrame:
    """One row per detector: detected > error > skipped > clean, and its issue count."""
    status = (
        F.when(F.col("leakage_type") == "error", "error")
        .when(F.col("severity").isin("warning", "critical"), "detected")
        .when(F.col("leakage_type") == "skipped", "skipped")
        .otherwise("clean")
    )
    return found.groupBy("detector").agg(
        unranked(DETECTOR_RANK, F.max(worst(DETECTOR_RANK, status))).alias("status"),
        F.count_if(F.col("severity").isin(*SEVERITIES)).alias("issues"),
    )


def report_summary(found: DataFrame) -> DataFrame:
    """One row: overall status (detected > error > all skipped > clean) and counts."""
    s = F.col("status")
    status = (
        F.when(F.count_if(s == "detected") > 0, "leakage_detected")
        .when(F.count_if(s == "error") > 0, "error")
        .when(F.count_if(s != "skipped") == 0, "skipped")
        .otherwise("clean")
    )
    return detector_status(found).agg(
        status.alias("status"),
        (F.count_if(s == "detected") > 0).alias("has_leakage"),
        F.sum("issues").alias("total_issues"),
        F.count("*").alias("detectors_run"),
        F.count_if(s == "clean").alias("detectors_clean"),
        F.count_if(s == "detected").alias("detectors_detected"),
    )


def issues_by_type(found: DataFrame, leakage_type: str | None = None) -> DataFrame:
    out = issues(found)
    return out.where(F.col("leakage_type") == leakage_type) if leakage_type else out.groupBy("leakage_type").agg(F.count("*").alias("issues"))


def recommendations(found: DataFrame) -> DataFrame:
    return issues(found).where("recommendation is not null").select("recommendation").distinct()
