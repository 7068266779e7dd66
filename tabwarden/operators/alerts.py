"""Alerts as an append-only event table: creation, advice, state, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Score limits of the severities.
CRITICAL, ERROR, WARNING = 0.8, 0.6, 0.4

# What to do per alert type; the severities it applies to (empty: all).
DECISIONS = (
    ("drift", ("critical", "error"), "retrain_model", 9, "Significant drift detected. Model retraining recommended to maintain accuracy.", "High - may prevent prediction degradation"),
    ("drift", (), "investigate", 7, "Investigate root cause of drift in affected features.", "Medium - understanding drift source helps prevention"),
    ("leakage", (), "exclude_feature", 10, "Remove leaky features from model training to prevent overfitting.", "Critical - leaky features cause unrealistic accuracy"),
    ("leakage", (), "retrain_model", 8, "Retrain model after removing leaky features.", "High - ensures model generalizes properly"),
    ("data_quality", ("critical",), "rollback", 9, "Critical quality issues detected. Consider rolling back to previous data version.", "High - prevents bad data from affecting models"),
    ("data_quality", (), "revalidate_data", 7, "Run full data validation after addressing issues.", "Medium - ensures quality is restored"),
    ("regression", (), "investigate", 8, "Quality regression detected. Investigate recent changes to data pipeline.", "High - prevents ongoing quality degradation"),
    ("regression", ("critical",), "notify_team", 9, "Alert data engineering team about critical regression.", "Medium - enables faster response"),
)
SEVERITIES = ("info", "warning", "error", "critical")


def severity_of(score: Column) -> Column:
    return F.when(score >= CRITICAL, "critical").when(score >= ERROR, "error").when(score >= WARNING, "warning").otherwise("info")


def alert_id(*parts: Column) -> Column:
    """Repeatable id from what the alert is about and when."""
    return F.concat(F.lit("ALT_"), F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 10))


def decision_table(spark: SparkSession) -> DataFrame:
    rows = [(t, s, a, p, d, e) for t, ss, a, p, d, e in DECISIONS for s in (ss or SEVERITIES)]
    return spark.createDataFrame(rows, "alert_type string, severity string, action string, priority int, description string, estimated_impact string")


def create_alerts(found: DataFrame) -> DataFrame:
    """Open alerts from rows (alert_type, score or severity, title, message, source, feature, created_at)."""
    severity = F.col("severity") if "severity" in found.columns else severity_of(F.col("score"))
    return found.select(
        alert_id(F.col("alert_type"), F.col("feature"), F.col("source"), F.col("created_at")).alias("alert_id"),
        "alert_type", severity.alias("severity"), "title", "message", F.lit("open").alias("status"), "source", F.array("feature").alias("affected_features"), "created_at",
    )


def with_recommendations(alerts: DataFrame) -> DataFrame:
    """Adds the actions for type and severity, most urgent first (a fixed table of 22 rows)."""
    table = decision_table(alerts.sparkSession)
    entry = F.struct((-F.col("priority")).alias("order"), "action", "priority", "description", "estimated_impact")
    per = table.groupBy("alert_type", "severity").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    picked = F.transform("e", lambda x: F.struct(x["action"].alias("action"), x["priority"].alias("priority"), x["description"].alias("description"), x["estimated_impact"].alias("estimated_impact")))
    per = per.select("alert_type", "severity", picked.alias("recommendations"))
    empty = F.array().cast("array<struct<action:string,priority:int,description:string,estimated_impact:string>>")
    return alerts.join(F.broadcast(per), ["alert_type", "severity"], "left").withColumn("recommendations", F.coalesce("recommendations", empty))


def query_alerts(alerts: DataFrame, status: str | None = None, alert_type: str | None = None, severity: str | None = None, limit: int = 50) -> DataFrame:
    for name, wanted in (("status", status), ("alert_type", alert_type), ("severity", severity)):
        if wanted:
            alerts = alerts.where(F.col(name) == wanted)
    return alerts.orderBy(F.desc("created_at"), "alert_id").limit(limit)


STATUS_EVENTS = T.StructType(
    [
        T.StructField("alert_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("at", T.TimestampNTZType()),
        T.StructField("note", T.StringType()),
    ]
)


def status_event(alerts: DataFrame, status: str, at: Column, note: Column | None = None) -> DataFrame:
    """State changes to append: acknowledged, resolved or ignored."""
    return alerts.select("alert_id", F.lit(status).alias("status"), at.alias("at"), (note if note is not None else F.lit(None)).cast("string").alias("note"))


def current_state(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Alerts with their latest status, and when they were acknowledged and resolved.

    The events are reduced to one row per alert before the join.
    """
    state = events.groupBy("alert_id").agg(
        F.max_by("status", F.struct("at", "status")).alias("new_status"),
        F.max(F.when(F.col("status") == "acknowledged", F.col("at"))).alias("acknowledged_at"),
        F.max(F.when(F.col("status") == "resolved", F.col("at"))).alias("resolved_at"),
        F.max("at").alias("changed_at"),
        F.max_by("note", F.when(F.col("note").isNotNull(), F.col("at"))).alias("resolution_note"),
    )
    out = alerts.join(state, "alert_id", "left")
    return out.withColumn("status", F.coalesce("new_status", "status")).withColumn("updated_at", F.coalesce("changed_at", "created_at")).drop("new_status", "changed_at")


def _alerts_from(found: DataFrame, alert_type: str, source: str, title: Column, message: Column, score: Column, at: Column) -> DataFrame:
    rows = found.select(
        F.lit(alert_type).alias("alert_type"), score.alias("score"), title.alias("title"), message.alias("message"), F.lit(source).alias("source"), F.col("feature"), at.alias("created_at")
    )
    return with_recommendations(create_alerts(rows))


def drift_alerts(drift: DataFrame, at: Column, drift_type: str = "psi") -> DataFrame:
    """Alerts of the drifted features of a drift analysis."""
    score = F.col("drift_score")
    message = F.format_string(
        "Data drift of type '%s' detected in feature '%s' with severity score %.2f. This may affect model predictions and require retraining.", F.lit(drift_type), "feature", score
    )
    return _alerts_from(drift.where("is_drifted"), "drift", "DriftDetector", F.concat(F.lit("Drift detected in feature: "), "feature"), message, score, at)


def leakage_alerts(scored: DataFrame, at: Column, leakage_type: str = "target_leakage", least: float = WARNING) -> DataFrame:
    """Alerts of features at or above a risk score."""
    score = F.col("risk_score")
    message = F.format_string(
        "Potential data leakage detected in feature '%s' (type: %s) with risk score %.0f%%. This feature may be causing unrealistic model performance.", "feature", F.lit(leakage_type), score * 100
    )
    return _alerts_from(scored.where(score >= least), "leakage", "LeakageDetector", F.concat(F.lit("Leakage risk in feature: "), "feature"), message, score, at)


def alert_summary(alerts: DataFrame) -> DataFrame:
    """(dimension, value, n, open, critical_open): totals, and counts by status, severity and type."""
    grouped = alerts.groupingSets([["status"], ["severity"], ["alert_type"], []], "status", "severity", "alert_type").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("status") == "open").alias("open"),
        F.count_if((F.col("status") == "open") & (F.col("severity") == "critical")).alias("critical_open"),
        F.grouping_id().alias("g"),
    )
    g = F.col("g")
    dimension = F.when(g == 3, "status").when(g == 5, "severity").when(g == 6, "alert_type").otherwise("all")
    value = F.when(g == 3, F.col("status")).when(g == 5, F.col("severity")).when(g == 6, F.col("alert_type"))
    return grouped.select(dimension.alias("dimension"), value.alias("value"), "n", "open", "critical_open")


def retained(alerts: DataFrame, n: int) -> DataFrame:
    """The n newest alerts."""
    return alerts.orderBy(F.desc("created_at"), F.desc("alert_id")).limit(n)
