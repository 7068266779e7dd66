"""Dataset versions, scan history, differences between scans, regressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabwarden.functions.expr import unranked, worst
from tabwarden.functions.types import atomic_columns, col, family
from tabwarden.plans.schemas import REGRESSION_RANK

# History limits, regression limits, and lengths of the short hashes.
MAX_SCANS, MAX_SCAN_ALERTS, MAX_ALERTS = 1000, 100, 500
ISSUES_CRITICAL, ISSUES_MAJOR = 10, 5
SCORE_CRITICAL, SCORE_MAJOR, SCORE_MINOR = 0.3, 0.15, 0.1
SHORT_HASH, ALERT_HASH = 16, 12

SCANS = T.StructType(
    [
        T.StructField("scan_id", T.StringType()),
        T.StructField("dataset_name", T.StringType()),
        T.StructField("scan_type", T.StringType()),
        T.StructField("version_hash", T.StringType()),
        T.StructField("schema_hash", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("column_names", T.ArrayType(T.StringType())),
        T.StructField("status", T.StringType()),
        T.StructField("total_issues", T.LongType()),
        T.StructField("quality_score", T.DoubleType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
    ]
)


def canonical_schema(df: DataFrame) -> str:
    """JSON of the sorted column names and their type families."""
    types = {f.name: family(f.dataType) for f in sorted(df.schema.fields, key=lambda f: f.name)}
    return json.dumps({"columns": sorted(types), "dtypes": types}, sort_keys=True)


def schema_hash(df: DataFrame) -> str:
    return hashlib.sha256(canonical_schema(df).encode()).hexdigest()[:SHORT_HASH]


def _row_digest(df: DataFrame, names: list[str], portable: bool) -> Column:
    """A long per row. The portable form is md5 over text, reproducible in any engine."""
    if portable:
        text = F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("<null>")) for c in names])
        return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return F.xxhash64(*[x for c in names for x in (col(c).isNull(), col(c))])


def dataset_version(df: DataFrame, portable: bool = False) -> DataFrame:
    """One row: content hash, schema hash, counts, names and types.

    The content hash covers every row and does not depend on row order: row
    digests are summed and xor-ed, both combined per task, so versioning a
    table is one scan with a single-row shuffle.
    """
    names = sorted(atomic_columns(df))
    types = {f.name: family(f.dataType) for f in df.schema.fields}
    d = F.col("d")
    sums = df.select(_row_digest(df, names, portable).alias("d")).agg(
        F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(d.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("total"), F.coalesce(F.bit_xor(d), F.lit(0)).cast("string").alias("mixed")
    )
    content = F.sha2(F.concat_ws("|", F.lit(schema_hash(df)), F.col("row_count").cast("string"), "total", "mixed"), 256)
    return sums.select(
        F.substring(content, 1, SHORT_HASH).alias("version_hash"),
        F.lit(schema_hash(df)).alias("schema_hash"),
        "row_count",
        F.lit(len(df.columns)).cast("long").alias("column_count"),
        F.array(*map(F.lit, df.columns)).alias("column_names"),
        F.create_map(*[F.lit(x) for kv in types.items() for x in kv]).alias("column_dtypes"),
    )


def newest(events: DataFrame, n: int, order: str = "timestamp", tie: str = "scan_id") -> DataFrame:
    """The n newest rows: a distributed top-n, no global sort."""
    return events.orderBy(F.desc(order), F.desc(tie)).limit(n)


def scan_history(scans: DataFrame, limit: int = 50, scan_type: str | None = None, version_hash: str | None = None) -> DataFrame:
    out = scans.where(F.col("scan_type") == scan_type) if scan_type else scans
    out = out.where(F.col("version_hash") == version_hash) if version_hash else out
    return newest(out, limit)


def latest_scan(scans: DataFrame, by: tuple[str, ...] = ("dataset_name", "scan_type")) -> DataFrame:
    """The newest scan of each dataset and type, as one aggregate."""
    rest = [c for c in scans.columns if c not in by]
    return scans.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("timestamp", "scan_id")).alias("s")).select(*by, "s.*")


def scan_diffs(scans: DataFrame) -> DataFrame:
    """Each scan against the previous one of the same dataset and type.

    One scan per run and dataset: a group holds runs, not rows of data.
    """
    w = Window.partitionBy("dataset_name", "scan_type").orderBy("timestamp", "scan_id")
    now = {c: F.col(c) for c in ("scan_id", "schema_hash", "column_names", "row_count", "total_issues", "quality_score")}
    paired = scans.withColumn("p", F.lag(F.struct(*now)).over(w)).where("p is not null")
    change = F.coalesce("quality_score", F.lit(0.0)) - F.coalesce("p.quality_score", F.lit(0.0))
    diff = paired.select(
        F.col("p.scan_id").alias("scan_before_id"), F.col("scan_id").alias("scan_after_id"), "dataset_name", "scan_type", "timestamp",
        (F.col("p.schema_hash") != F.col("schema_hash")).alias("schema_changed"),
        (F.col("row_count") - F.col("p.row_count")).alias("row_count_change"),
        (F.size("column_names") - F.size("p.column_names")).cast("long").alias("column_count_change"),
        F.array_except("column_names", "p.column_names").alias("columns_added"),
        F.array_except("p.column_names", "column_names").alias("columns_removed"),
        (F.col("total_issues") - F.col("p.total_issues")).alias("issues_change"),
        change.alias("quality_score_change"),
    )
    return diff.withColumn("has_regression", (F.col("issues_change") > 0) | (F.col("quality_score_change") < -SCORE_MINOR)).withColumn(
        "regression_severity", _severity(F.col("issues_change"), F.col("quality_score_change"))
    )


def _by_issues(d: Column) -> Column:
    return F.when(d >= ISSUES_CRITICAL, "critical").when(d >= ISSUES_MAJOR, "major").when(d > 0, "minor").otherwise("none")


def _by_score(d: Column) -> Column:
    return F.when(d < -SCORE_CRITICAL, "critical").when(d < -SCORE_MAJOR, "major").when(d < -SCORE_MINOR, "minor").otherwise("none")


def _severity(issues: Column, score: Column) -> Column:
    """The worse of both classes, compared by rank."""
    rank = F.greatest(worst(REGRESSION_RANK, _by_issues(issues)), worst(REGRESSION_RANK, _by_score(score)))
    return unranked(REGRESSION_RANK, rank)


# Advice of a regression alert.
ADVICE = {
    "sources": "Review new data sources for quality issues",
    "changes": "Check recent changes to data pipeline",
    "cause": "Investigate root cause of quality degradation",
    "revert": "Consider reverting to previous data version",
    "schema": "Validate schema changes were intentional",
}


def regression_alerts(diffs: DataFrame) -> DataFrame:
    """One alert per regressed scan: id, severity, message, advice."""
    issues, score = F.col("issues_change"), F.col("quality_score_change")
    more, lower, schema = issues > 0, score < -SCORE_MINOR, F.col("schema_changed")
    parts = F.array(
        F.when(more, F.format_string("%s: %d new issues detected", F.initcap(_by_issues(issues)), issues)),
        F.when(lower, F.format_string("%s: Quality score dropped by %.1f%%", F.initcap(_by_score(score)), F.abs(score) * 100)),
        F.when(schema, F.format_string("Schema changed: +%d columns, -%d columns", F.size("columns_added"), F.size("columns_removed"))),
    )
    advice = F.array(
        F.when(more, ADVICE["sources"]), F.when(more, ADVICE["changes"]), F.when(lower, ADVICE["cause"]), F.when(lower, ADVICE["revert"]), F.when(schema, ADVICE["schema"])
    )
    present = lambda a: F.filter(a, lambda x: x.isNotNull())
    return diffs.where("has_regression").select(
        F.substring(F.md5(F.concat_ws(":", "scan_after_id", "scan_before_id")), 1, ALERT_HASH).alias("alert_id"),
        F.col("regression_severity").alias("severity"), "dataset_name", "scan_type", F.col("timestamp").alias("created_at"),
        F.concat_ws("; ", present(parts)).alias("message"), present(advice).alias("recommendations"), F.lit(False).alias("acknowledged"),
    )
