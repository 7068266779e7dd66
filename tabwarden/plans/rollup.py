"""Roll-ups of CHECK_RESULTS: validator status, overall status, scores, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.functions.expr import unranked, worst
from tabwarden.plans.schemas import STATUS_RANK


def validator_status(results: DataFrame) -> DataFrame:
    """One row per validator: its worst status and its raised checks."""
    rank = worst(STATUS_RANK, F.col("status"))
    return (
        results.groupBy("validator")
        .agg(
            F.max(rank).alias("rank"),
            F.count_if(F.col("violations") > 0).alias("issues"),
            F.count_if((F.col("violations") > 0) & (F.col("severity") != "info")).alias("scored_issues"),
        )
        .select("validator", unranked(STATUS_RANK, F.col("rank")).alias("status"), "issues", "scored_issues")
    )


def overall(results: DataFrame) -> DataFrame:
    """One row: any failed > any warning > all skipped > passed."""
    per = validator_status(results)
    status = (
        F.when(F.count_if(F.col("status") == "failed") > 0, "failed")
        .when(F.count_if(F.col("status") == "warning") > 0, "warning")
        .when(F.count_if(F.col("status") != "skipped") == 0, "skipped")
        .otherwise("passed")
    )
    return per.agg(
        status.alias("status"),
        F.sum("issues").alias("total_issues"),
        F.sum("scored_issues").alias("scored_issues"),
        F.count("*").alias("validators_run"),
        F.count_if(F.col("status") == "passed").alias("validators_passed"),
        F.count_if(F.col("status") == "failed").alias("validators_failed"),
        F.count_if(F.col("status") == "warning").alias("validators_warned"),
    )


def quality_score(status: Column, scored_issues: Column) -> Column:
    """0 when failed, 1 when passed, in between 0.05 off per issue down to 0.5."""
    return (
        F.when(status == "failed", F.lit(0.0))
        .when(status == "warning", 1.0 - F.least(F.lit(0.5), scored_issues * F.lit(0.05)))
        .otherwise(F.lit(1.0))
    )


def tiered_score(status: Column, total_issues: Column) -> Column:
    """100, 80 or 45 by status, minus 2 per issue, by at most 15, 30 or 45."""
    base = F.when(status == "warning", 80.0).when(status == "failed", 45.0).otherwise(100.0)
    cap = F.when(status == "warning", 30.0).when(status == "failed", 45.0).otherwise(15.0)
    left = base - F.least(cap, total_issues.cast("double") * 2.0)
    return F.round(F.greatest(F.lit(0.0), left), 1)


def report_summary(results: DataFrame, data: DataFrame) -> DataFrame:
    """Overall status, counts of validators, both scores and the table's width."""
    s = F.col("status")
    return overall(results).select(
        "*",
        F.lit(len(data.columns)).cast("long").alias("data_columns"),
        F.round(quality_score(s, F.col("scored_issues")), 4).alias("quality_score"),
        tiered_score(s, F.col("total_issues")).alias("tiered_score"),
    )


def issues_by_severity(results: DataFrame) -> DataFrame:
    return results.where("violations > 0").groupBy("severity").agg(F.count("*").alias("issues"))
