"""Aggregates over the scan and alert tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RECENT, TREND, TIMELINE_DAYS = 5, 7, 30


def totals(scans: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: scans, open alerts, issues found, mean health."""
    open_ = alerts.agg(F.count_if(F.col("status") == "open").alias("n")).scalar()
    return scans.agg(
        F.count("*").alias("total_scans"), F.coalesce(F.sum("total_issues"), F.lit(0)).alias("total_issues_blocked"), F.avg("quality_score").alias("h")
    ).select("total_scans", open_.alias("active_alerts"), "total_issues_blocked", F.round(F.coalesce("h", F.lit(0.0)), 9).alias("global_health_score"))


def risk_distribution(scans: DataFrame) -> DataFrame:
    return scans.groupBy(F.coalesce("risk_level", F.lit("unknown")).alias("risk_level")).agg(F.count("*").alias("n"))


def timeline(scans: DataFrame, until: datetime | str, days: int = TIMELINE_DAYS) -> DataFrame:
    """(date, score, count) of the last days; the range filter reaches the scan of the table."""
    end = F.lit(str(until)).cast("timestamp_ntz")
    recent = scans.where(F.col("timestamp") >= end - F.expr(f"INTERVAL {days} DAYS"))
    return recent.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("score"), F.count("*").alias("count")
    ).orderBy("date")


def recent_scans(scans: DataFrame, n: int = RECENT) -> DataFrame:
    return scans.select("scan_id", "dataset_name", "scan_type", "quality_score", "timestamp").orderBy(F.desc("timestamp"), F.desc("scan_id")).limit(n)


def history_stats(scans: DataFrame) -> DataFrame:
    """One row: runs by kind and by status, mean quality score, last run."""
    quality, leak = F.col("scan_type") == "quality", F.col("scan_type") == "leakage"
    status = F.col("status")
    return scans.agg(
        F.count("*").alias("total_validations"), F.count_if(quality).alias("quality_validations"), F.count_if(leak).alias("leakage_validations"),
        F.avg(F.when(quality, F.col("quality_score"))).alias("avg_quality_score"),
        F.count_if(status == "passed").alias("passed_count"), F.count_if(status == "warning").alias("warning_count"), F.count_if(status == "failed").alias("failed_count"),
        F.count_if(leak & (status == "clean")).alias("clean_count"), F.count_if(leak & (status == "detected")).alias("leakage_count"),
        F.max("timestamp").alias("last_validation"),
    )


def quality_trend(scans: DataFrame, n: int = TREND) -> DataFrame:
    """(name, value) of the last n quality scans, oldest first."""
    last = scans.where("scan_type = 'quality'").orderBy(F.desc("timestamp"), F.desc("scan_id")).limit(n)
    position = F.row_number().over(Window.orderBy("timestamp", "scan_id"))  # n rows
    return last.select(F.concat(F.lit("#"), position.cast("string")).alias("name"), F.coalesce("quality_score", F.lit(0.0)).alias("value"))
