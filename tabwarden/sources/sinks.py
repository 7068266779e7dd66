"""Writers: rule tables, history, alerts, reports, plain tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwarden.operators import alerts, history
from tabwarden.operators.rules import RULE_TABLE, Rule


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [(r.name, r.rule_type, r.column, r.enabled, r.severity, json.dumps(r.parameters, sort_keys=True)) for r in rules]
    return spark.createDataFrame(rows, RULE_TABLE)


def save_rules(spark: SparkSession, rules: Sequence[Rule], path: str) -> None:
    rule_table(spark, rules).write.mode("overwrite").json(path)


def load_rules(spark: SparkSession, path: str, enabled_only: bool = True) -> list[Rule]:
    """Rules of a rule table; one row per rule, so they fit the driver."""
    table = spark.read.schema(RULE_TABLE).json(path)
    rows = (table.where("enabled") if enabled_only else table).orderBy("name").collect()
    return [Rule(r["name"], r["rule_type"], r["column"], r["enabled"], r["severity"], json.loads(r["parameters"] or "{}")) for r in rows]


def append_events(events: DataFrame, path: str, time_column: str) -> None:
    """Append rows to a history table, partitioned by day so that recent reads prune.

    Rebalancing by day keeps files few; a very large day is split again at run time.
    """
    days = events.withColumn("day", F.to_date(time_column)).hint("rebalance", F.col("day"))
    days.write.mode("append").partitionBy("day").parquet(path)


def newest_days(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The days of a history table, newest first, until they hold ``n`` rows; older days are not read.

    Rows per day come from the files' footers: no column is read for them.
    """
    table = spark.read.parquet(path)
    held, first = 0, None
    for row in table.groupBy("day").agg(F.count(F.lit(1)).alias("n")).where("day is not null").orderBy(F.desc("day")).collect():  # one row per day
        held, first = held + row["n"], row["day"]
        if held >= n:
            return table.where(F.col("day") >= F.lit(first)).drop("day")
    return table.drop("day")


def retained_scans(spark: SparkSession, path: str, n: int = history.MAX_SCANS) -> DataFrame:
    """The n newest scans of a history table."""
    return history.newest(newest_days(spark, path, n), n)


def retained_alerts(spark: SparkSession, path: str, n: int = history.MAX_ALERTS) -> DataFrame:
    return alerts.retained(newest_days(spark, path, n), n)


def retained_regressions(spark: SparkSession, path: str, n: int = history.MAX_SCAN_ALERTS) -> DataFrame:
    """The n newest regression alerts of a history table."""
    return alerts.retained(newest_days(spark, path, n), n)


def compact(spark: SparkSession, path: str, into: str, n: int, time_column: str, tie: str) -> None:
    """Rewrite the n newest rows of a history table to a new path."""
    kept = newest_days(spark, path, n).orderBy(F.desc(time_column), F.desc(tie)).limit(n)
    append_events(kept, into, time_column)


def write_reports(report: DataFrame, path: str, scan_id: str, created_at: str) -> None:
    """Append a report's rows under their scan id; nested columns are kept as they are."""
    report.select(F.lit(scan_id).alias("scan_id"), F.lit(created_at).cast("timestamp_ntz").alias("created_at"), "*").write.mode("append").parquet(path)


def write_experiment(comparison: DataFrame, path: str, fmt: str = "both") -> dict[str, str]:
    """Write an experiment comparison as JSON, as text lines, or both."""
    if fmt not in ("json", "text", "both"):
        raise ValueError(f"unknown report format: {fmt}")
    out = {}
    if fmt in ("json", "both"):
        out["json"] = f"{path}/json"
        comparison.write.mode("overwrite").json(out["json"])
    if fmt in ("text", "both"):
        out["text"] = f"{path}/text"
        lines = F.array(
            F.format_string("verdict: %s", "verdict"), F.format_string("accuracy drop: %.4f", "accuracy_drop"),
            F.format_string("generalization gap: %.4f before, %.4f after", "generalization_gap_before", "generalization_gap_after"),
            F.concat(F.lit("advice: "), F.array_join("advice", "; ")),
        )
        comparison.select(F.explode(lines).alias("value")).coalesce(1).write.mode("overwrite").text(out["text"])  # four lines
    return out


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
