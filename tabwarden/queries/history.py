"""Versions, scan history, regressions, alerts, dashboard, text.

Scans are derived from the events table: each event type is a dataset, each
hour a scan of it, and values above 100 are its issues.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwarden.operators import alerts, dashboard, drift, history, narrative, profile
from tabwarden.queries.drift import NEW, OLD, priced, psi_open_sql
from tabwarden.queries.profile import rounded
from tabwarden.queries.quality import LABELLED
from tabwarden.queries.registry import query
from tabwarden.queries.risk import _SCORED, scored_types


def scans(t):
    n, bad, top = F.count("*"), F.count_if(F.col("value") > 100), F.max("value")
    hour = F.date_trunc("hour", "ts")
    g = t.events.groupBy(F.col("event_type").alias("dataset_name"), F.date_format(hour, "yyyy-MM-dd HH").alias("h")).agg(
        n.alias("row_count"), bad.alias("total_issues"), top.alias("top"), F.max("ts").alias("timestamp")
    )
    share = F.col("total_issues") / F.col("row_count")
    quality = F.substring("h", 12, 2).cast("int") % 3 != 0
    return g.select(
        F.md5(F.concat_ws("|", "dataset_name", "h")).alias("scan_id"), "dataset_name",
        F.when(quality, "quality").otherwise("leakage").alias("scan_type"),
        F.substring(F.md5(F.col("row_count").cast("string")), 1, 16).alias("version_hash"),
        F.when(F.col("top") > 200, "wide").otherwise("narrow").alias("schema_hash"),
        "row_count",
        F.when(F.col("top") > 200, F.array(F.lit("id"), F.lit("value"), F.lit("tail"))).otherwise(F.array(F.lit("id"), F.lit("value"), F.lit("head"))).alias("column_names"),
        F.when(~quality, F.when(F.col("total_issues") > 0, "detected").otherwise("clean")).when(F.col("total_issues") >= 2, "failed").when(F.col("total_issues") == 1, "warning").otherwise("passed").alias("status"),
        "total_issues",
        F.when(quality, F.round(1 - share, 4)).alias("quality_score"),
        F.when(share >= 0.7, "high").when(share >= 0.4, "medium").when(share > 0, "low").alias("risk_level"),
        "timestamp",
    )


SCANS = """(SELECT md5(event_type || '|' || h) AS scan_id, event_type AS dataset_name, CASE WHEN q THEN 'quality' ELSE 'leakage' END AS scan_type, substr(md5(CAST(n AS VARCHAR)), 1, 16) AS version_hash,
   CASE WHEN top > 200 THEN 'wide' ELSE 'narrow' END AS schema_hash, n AS row_count, CASE WHEN top > 200 THEN ['id', 'value', 'tail'] ELSE ['id', 'value', 'head'] END AS column_names,
   CASE WHEN NOT q THEN CASE WHEN bad > 0 THEN 'detected' ELSE 'clean' END WHEN bad >= 2 THEN 'failed' WHEN bad = 1 THEN 'warning' ELSE 'passed' END AS status, bad AS total_issues,
   CASE WHEN q THEN round(1 - bad / n, 4) END AS quality_score, CASE WHEN bad / n >= 0.7 THEN 'high' WHEN bad / n >= 0.4 THEN 'medium' WHEN bad > 0 THEN 'low' END AS risk_level, ts AS "timestamp"
   FROM (SELECT event_type, strftime(ts, '%Y-%m-%d %H') AS h, CAST(strftime(any_value(ts), '%H') AS INT) % 3 <> 0 AS q, count(*) AS n, count(*) FILTER (WHERE value > 100) AS bad, max(value) AS top, max(ts) AS ts FROM events GROUP BY 1, 2))"""

# -- versions ---------------------------------------------------------------


@query(
    "v1_v2_v3_dataset_version",
    """WITH s AS (SELECT count(*) AS n, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS total, CAST(bit_xor(h) AS VARCHAR) AS mixed FROM (SELECT CAST('0x' || substr(md5(CAST(o_custkey AS VARCHAR) || '|' || CAST(o_orderkey AS VARCHAR) || '|' || o_orderpriority || '|' || o_orderstatus), 1, 15) AS BIGINT) AS h FROM orders)),
       k AS (SELECT substr(sha256('{"columns": ["o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"], "dtypes": {"o_custkey": "int", "o_orderkey": "int", "o_orderpriority": "string", "o_orderstatus": "string"}}'), 1, 16) AS sh)
       SELECT substr(sha256(sh || '|' || CAST(n AS VARCHAR) || '|' || total || '|' || mixed), 1, 16) AS version_hash, sh AS schema_hash, n AS row_count, CAST(4 AS BIGINT) AS column_count, ['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_orderpriority'] AS column_names, '{"o_custkey":"int","o_orderkey":"int","o_orderpriority":"string","o_orderstatus":"string"}' AS column_dtypes FROM s, k""",
)
def _(t):
    return history.dataset_version(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), portable=True).withColumn("column_dtypes", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("column_dtypes")))))


@query("v4_scan_history", f"SELECT scan_id, dataset_name, total_issues, \"timestamp\" FROM {SCANS} WHERE scan_type = 'quality' ORDER BY \"timestamp\" DESC, scan_id DESC LIMIT 50")
def _(t):
    return history.scan_history(scans(t), 50, "quality").select("scan_id", "dataset_name", "total_issues", "timestamp")


@query("v4_latest_scan", f"SELECT dataset_name, scan_type, scan_id, quality_score FROM (SELECT *, row_number() OVER (PARTITION BY dataset_name, scan_type ORDER BY \"timestamp\" DESC, scan_id DESC) AS rn FROM {SCANS}) WHERE rn = 1")
def _(t):
    return history.latest_scan(scans(t)).select("dataset_name", "scan_type", "scan_id", "quality_score")


_DIFF = f"""(SELECT *, coalesce(quality_score, 0) - coalesce(pq, 0) AS dq, total_issues - pi AS di FROM (SELECT *, lag(scan_id) OVER w AS pid, lag(schema_hash) OVER w AS ps, lag(column_names) OVER w AS pc, lag(row_count) OVER w AS pr,
   lag(total_issues) OVER w AS pi, lag(quality_score) OVER w AS pq FROM {SCANS} WINDOW w AS (PARTITION BY dataset_name, scan_type ORDER BY "timestamp", scan_id)) WHERE pid IS NOT NULL)"""
_RANK = """greatest(CASE WHEN di >= 10 THEN 3 WHEN di >= 5 THEN 2 WHEN di > 0 THEN 1 ELSE 0 END, CASE WHEN dq < -0.3 THEN 3 WHEN dq < -0.15 THEN 2 WHEN dq < -0.1 THEN 1 ELSE 0 END)"""


@query(
    "v5_v6_scan_diffs",
    f"""SELECT pid AS scan_before_id, scan_id AS scan_after_id, schema_hash <> ps AS schema_changed, row_count - pr AS row_count_change, CAST(len(column_names) - len(pc) AS BIGINT) AS column_count_change,
       list_filter(column_names, lambda c: NOT list_contains(pc, c)) AS columns_added, list_filter(pc, lambda c: NOT list_contains(column_names, c)) AS columns_removed, di AS issues_change, round(dq, 4) AS quality_score_change,
       di > 0 OR dq < -0.1 AS has_regression, CASE {_RANK} WHEN 3 THEN 'critical' WHEN 2 THEN 'major' WHEN 1 THEN 'minor' ELSE 'none' END AS regression_severity FROM {_DIFF}""",
)
def _(t):
    return rounded(history.scan_diffs(scans(t)).drop("dataset_name", "scan_type", "timestamp"), 4)


_BY_I = "CASE WHEN di >= 10 THEN 'Critical' WHEN di >= 5 THEN 'Major' ELSE 'Minor' END"
_BY_Q = "CASE WHEN dq < -0.3 THEN 'Critical' WHEN dq < -0.15 THEN 'Major' ELSE 'Minor' END"


@query(
    "v7_regression_alerts",
    f"""SELECT substr(md5(scan_id || ':' || pid), 1, 12) AS alert_id, CASE {_RANK} WHEN 3 THEN 'critical' WHEN 2 THEN 'major' ELSE 'minor' END AS severity,
       concat_ws('; ', CASE WHEN di > 0 THEN {_BY_I} || ': ' || di || ' new issues detected' END, CASE WHEN dq < -0.1 THEN {_BY_Q} || ': Quality score dropped by ' || printf('%.1f', abs(dq) * 100) || '%' END,
         CASE WHEN schema_hash <> ps THEN 'Schema changed: +1 columns, -1 columns' END) AS message,
       CAST((di > 0)::INT * 2 + (dq < -0.1)::INT * 2 + (schema_hash <> ps)::INT AS INT) AS advice FROM {_DIFF} WHERE di > 0 OR dq < -0.1""",
)
def _(t):
    out = history.regression_alerts(history.scan_diffs(scans(t)))
    return out.select("alert_id", "severity", "message", F.size("recommendations").alias("advice"))


# -- alerts -----------------------------------------------------------------


def scan_alerts(t):
    """An alert for each scan with issues, scored by their share."""
    s = scans(t).where("total_issues > 0")
    rows = s.select(
        F.when(F.col("scan_type") == "quality", "data_quality").otherwise("leakage").alias("alert_type"), (F.col("total_issues") / F.col("row_count")).alias("score"),
        F.concat(F.lit("Issues in "), "dataset_name").alias("title"), F.format_string("%d issues", "total_issues").alias("message"), F.col("scan_id").alias("source"),
        F.col("dataset_name").alias("feature"), F.col("timestamp").alias("created_at"),
    )
    return alerts.create_alerts(rows)


ALERTS = f"""(SELECT 'ALT_' || substr(md5(type || ':' || dataset_name || ':' || scan_id || ':' || at_text), 1, 10) AS alert_id, type AS alert_type, CASE WHEN score >= 0.8 THEN 'critical' WHEN score >= 0.6 THEN 'error' WHEN score >= 0.4 THEN 'warning' ELSE 'info' END AS severity,
   'Issues in ' || dataset_name AS title, total_issues || ' issues' AS message, 'open' AS status, scan_id AS source, [dataset_name] AS affected_features, "timestamp" AS created_at FROM
   (SELECT *, CASE WHEN scan_type = 'quality' THEN 'data_quality' ELSE 'leakage' END AS type, total_issues / row_count AS score, strftime("timestamp", '%Y-%m-%d %H:%M:%S') || CASE WHEN microsecond("timestamp") % 1000000 = 0 THEN '' ELSE rtrim(strftime("timestamp", '.%f'), '0') END AS at_text FROM {SCANS} WHERE total_issues > 0))"""


@query("w1_create_alerts", f"SELECT * FROM {ALERTS}")
def _(t):
    return scan_alerts(t)




@query(
    "w2_recommended_actions",
    f"""SELECT alert_id, CASE WHEN alert_type = 'leakage' THEN ['exclude_feature', 'retrain_model'] WHEN severity = 'critical' THEN ['rollback', 'revalidate_data'] ELSE ['revalidate_data'] END AS actions,
       CASE WHEN alert_type = 'leakage' THEN [10, 8] WHEN severity = 'critical' THEN [9, 7] ELSE [7] END AS priorities FROM {ALERTS}""",
)
def _(t):
    out = alerts.with_recommendations(scan_alerts(t))
    return out.select("alert_id", F.col("recommendations.action").alias("actions"), F.col("recommendations.priority").alias("priorities"))


@query("w3_alert_query", f"SELECT alert_id, severity, created_at FROM {ALERTS} WHERE status = 'open' AND alert_type = 'leakage' AND severity = 'info' ORDER BY created_at DESC, alert_id LIMIT 50")
def _(t):
    return alerts.query_alerts(scan_alerts(t), "open", "leakage", "info").select("alert_id", "severity", "created_at")


def alert_events(t):
    """Critical alerts are acknowledged after 1 hour and resolved after 2; errors are only acknowledged."""
    a = scan_alerts(t)
    hour = lambda n: F.col("created_at") + F.expr(f"INTERVAL {n} HOURS")
    first = alerts.status_event(a.where("severity in ('critical', 'error')"), "acknowledged", hour(1))
    return first.unionByName(alerts.status_event(a.where("severity = 'critical'"), "resolved", hour(2), F.lit("fixed")))


@query(
    "w4_alert_state",
    f"""SELECT alert_id, CASE severity WHEN 'critical' THEN 'resolved' WHEN 'error' THEN 'acknowledged' ELSE 'open' END AS status, CASE WHEN severity IN ('critical', 'error') THEN created_at + INTERVAL 1 HOUR END AS acknowledged_at,
       CASE WHEN severity = 'critical' THEN created_at + INTERVAL 2 HOUR END AS resolved_at, CASE WHEN severity = 'critical' THEN 'fixed' END AS resolution_note FROM {ALERTS}""",
)
def _(t):
    return alerts.current_state(scan_alerts(t), alert_events(t)).select("alert_id", "status", "acknowledged_at", "resolved_at", "resolution_note")


@query(
    "w5_drift_alerts",
    f"""SELECT 'Drift detected in feature: ' || feature AS title, CASE WHEN psi >= 0.8 THEN 'critical' WHEN psi >= 0.6 THEN 'error' WHEN psi >= 0.4 THEN 'warning' ELSE 'info' END AS severity,
       'Data drift of type ''psi'' detected in feature ''' || feature || ''' with severity score ' || printf('%.2f', psi) || '. This may affect model predictions and require retraining.' AS message,
       CASE WHEN psi >= 0.6 THEN ['retrain_model', 'investigate'] ELSE ['investigate'] END AS actions FROM {psi_open_sql('value', OLD, NEW)}""",
)
def _(t):
    found = drift.analyze_drift(*priced(t), ["value"], histograms=False)
    out = alerts.drift_alerts(found, F.lit("2024-02-01").cast("timestamp_ntz"))
    return out.select("title", "severity", "message", F.col("recommendations.action").alias("actions"))


@query(
    "w5_leakage_alerts",
    f"""SELECT 'Leakage risk in feature: ' || feature AS title, CASE WHEN risk_score >= 0.8 THEN 'critical' WHEN risk_score >= 0.6 THEN 'error' ELSE 'warning' END AS severity,
       'Potential data leakage detected in feature ''' || feature || ''' (type: target_leakage) with risk score ' || printf('%.0f', risk_score * 100) || '%. This feature may be causing unrealistic model performance.' AS message
       FROM {_SCORED} WHERE risk_score >= 0.4""",
)
def _(t):
    return alerts.leakage_alerts(scored_types(t), F.lit("2024-02-01").cast("timestamp_ntz")).select("title", "severity", "message")


@query(
    "w6_alert_summary",
    f"""WITH a AS (SELECT alert_type, severity, CASE severity WHEN 'critical' THEN 'resolved' WHEN 'error' THEN 'acknowledged' ELSE 'open' END AS status FROM {ALERTS})
       SELECT CASE WHEN GROUPING(status) = 0 THEN 'status' WHEN GROUPING(severity) = 0 THEN 'severity' WHEN GROUPING(alert_type) = 0 THEN 'alert_type' ELSE 'all' END AS dimension, coalesce(status, severity, alert_type) AS value,
       count(*) AS n, count(*) FILTER (WHERE status2 = 'open') AS open, count(*) FILTER (WHERE status2 = 'open' AND severity2 = 'critical') AS critical_open
       FROM (SELECT *, status AS status2, severity AS severity2 FROM a) GROUP BY GROUPING SETS ((status), (severity), (alert_type), ())""",
)
def _(t):
    return alerts.alert_summary(alerts.current_state(scan_alerts(t), alert_events(t)))


# -- dashboard --------------------------------------------------------------


@query("b1_b2_totals", f"SELECT count(*) AS total_scans, (SELECT count(*) FROM {ALERTS} WHERE status = 'open') AS active_alerts, CAST(sum(total_issues) AS BIGINT) AS total_issues_blocked, round(avg(quality_score), 9) AS global_health_score FROM {SCANS}")
def _(t):
    return dashboard.totals(scans(t), scan_alerts(t))


@query("b3_risk_distribution", f"SELECT coalesce(risk_level, 'unknown') AS risk_level, count(*) AS n FROM {SCANS} GROUP BY 1")
def _(t):
    return dashboard.risk_distribution(scans(t))


@query("b4_timeline", f"SELECT CAST(\"timestamp\" AS DATE) AS date, round(avg(quality_score), 9) AS score, count(*) AS count FROM {SCANS} WHERE \"timestamp\" >= TIMESTAMP '2024-02-10' - INTERVAL 30 DAY GROUP BY 1")
def _(t):
    return rounded(dashboard.timeline(scans(t), "2024-02-10 00:00:00"), 9)


@query("b5_recent_scans", f"SELECT scan_id, dataset_name, scan_type, quality_score, \"timestamp\" FROM {SCANS} ORDER BY \"timestamp\" DESC, scan_id DESC LIMIT 5")
def _(t):
    return dashboard.recent_scans(scans(t))


@query(
    "b6_history_stats",
    f"""SELECT count(*) AS total_validations, count(*) FILTER (WHERE scan_type = 'quality') AS quality_validations, count(*) FILTER (WHERE scan_type = 'leakage') AS leakage_validations, round(avg(quality_score), 9) AS avg_quality_score,
       count(*) FILTER (WHERE status = 'passed') AS passed_count, count(*) FILTER (WHERE status = 'warning') AS warning_count, count(*) FILTER (WHERE status = 'failed') AS failed_count, count(*) FILTER (WHERE status = 'clean') AS clean_count,
       count(*) FILTER (WHERE status = 'detected') AS leakage_count, max("timestamp") AS last_validation FROM {SCANS}""",
)
def _(t):
    return rounded(dashboard.history_stats(scans(t)), 9)


@query("b6_quality_trend", f"SELECT '#' || row_number() OVER (ORDER BY \"timestamp\", scan_id) AS name, quality_score AS value FROM (SELECT * FROM {SCANS} WHERE scan_type = 'quality' ORDER BY \"timestamp\" DESC, scan_id DESC LIMIT 7)")
def _(t):
    return dashboard.quality_trend(scans(t))


# -- text -------------------------------------------------------------------


def profile_rows(t):
    """Profile of the events' value and user columns, one dataset per event type."""
    x = t.events.select("event_type", F.inline(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for i, c in enumerate(("value", "user_id"))])))
    v = F.col("v")
    return x.groupBy(F.col("event_type").alias("dataset"), "position", "column").agg(
        (F.count_if(v.isNull()) / F.count("*")).alias("missing_pct"), F.count_distinct(v).alias("unique_count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), profile.corrected_skewness(v).alias("skewness")
    ).withColumn("type", F.lit("float"))


def dataset_rows(t):
    risky = F.max("value") > 400
    return t.events.groupBy(F.col("event_type").alias("dataset")).agg(
        F.count("*").alias("rows"), F.lit(6).alias("columns"), (F.count("*") * 8 / 1000000).alias("memory_mb"), F.lit(0).alias("duplicate_rows"), F.lit(0.0).alias("duplicate_pct"), F.lit(100.0).alias("health_score"),
        F.when(risky, F.array(F.lit("outliers"), F.lit("tail"))).otherwise(F.array().cast("array<string>")).alias("risks"),
    )


def _line(c: str) -> str:
    return f"""printf('- {c} (float): %.1f%% missing, %d unique, mean=%.2f, std=%.2f, skewness=%.2f', 100.0 * (count(*) - count({c})) / count(*), count(DISTINCT {c}), avg({c}), stddev_samp({c}), skewness({c}))"""


@query(
    "m1_prompts",
    f"""SELECT event_type AS dataset, '{narrative.INTRO}' || chr(10) || chr(10) || '### Instruction:' || chr(10) || '{narrative.INSTRUCTION}' || chr(10) || chr(10) || '### Input:' || chr(10) ||
       printf('Dataset Name: %s', event_type) || chr(10) || printf('Shape: %d rows x 6 columns', count(*)) || chr(10) || printf('Memory: %.1f MB', count(*) * 8 / 1000000) || chr(10) || 'Duplicate Rows: 0 (0.0%)' || chr(10) || 'Overall Health Score: 100.0/100' || chr(10) || chr(10) ||
       'Column Profiles:' || chr(10) || {_line("value")} || chr(10) || {_line("user_id")} || chr(10) || chr(10) || 'Detected Risks:' || chr(10) || CASE WHEN max(value) > 400 THEN 'outliers, tail' ELSE '{narrative.NO_RISKS}' END || chr(10) || chr(10) || '### Response:' AS prompt
       FROM events GROUP BY event_type""",
)
def _(t):
    return narrative.prompts(profile_rows(t), dataset_rows(t))


def responses(t):
    """Response texts made from the conversations: some with sections, some without."""
    body = F.concat(
        F.lit("1. Narrative Summary:\n"), F.regexp_replace("text", r"\n\n", "\n"), F.lit("\n\n2. Top Critical Risks:\n1. first\n2. second\n- third\n\n3. Actionable Recommendations:\n- act on "), F.col("role"),
        F.lit("\n\n4. Executive Summary:\nrole "), F.col("role"),
    )
    return t.conversations.select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).otherwise(body).alias("text"))


@query(
    "m2_parsed_responses",
    """SELECT conv_id, turn, md5(CASE WHEN role = 'user' THEN CASE WHEN length(text) > 0 THEN substr(text, 1, 500) || '...' ELSE 'Insight summary unavailable.' END ELSE regexp_replace(regexp_replace(replace(text, chr(10) || chr(10), chr(10)), '^\\s+', ''), '\\s+$', '') END) AS narrative,
       CASE WHEN role = 'user' THEN [] ELSE ['first', 'second', 'third'] END AS top_risks, CASE WHEN role = 'user' THEN [] ELSE ['act on ' || role] END AS recommendations,
       CASE WHEN role = 'user' THEN 'Summary unavailable.' ELSE 'role ' || role END AS executive_summary FROM conversations""",
)
def _(t):
    out = narrative.parse_responses(responses(t))
    return out.select("conv_id", "turn", F.md5("narrative").alias("narrative"), "top_risks", "recommendations", "executive_summary")


@query(
    "m3_fallback_text",
    f"""SELECT 'Insights temporarily unavailable. (Error: offline)' AS narrative, ['Column ''quality'' has over 30% missing values.', 'Column ''toxic'' has over 30% missing values.'] AS top_risks,
       ['Evaluate if ''quality'' can be imputed or if it should be dropped.', 'Evaluate if ''toxic'' can be imputed or if it should be dropped.'] AS recommendations, 'fallback-rules' AS model_name
       FROM {LABELLED} HAVING count(quality) < 0.7 * count(*)""",
)
def _(t):
    df = t.labelled.select("doc_id", "quality", "toxic")
    return narrative.fallback(profile.findings(df), "offline")


@query(
    "s15_problem_examples",
    """SELECT event_type AS dataset, CASE WHEN abs(skewness(value)) > 2.0 THEN 'feature_skew' ELSE 'healthy' END AS problem,
       'Dataset ' || event_type || ' (' || count(*) || ' rows, health 100.0/100): ' || CASE WHEN abs(skewness(value)) > 2.0 THEN 'column ''value'' is strongly skewed.' ELSE 'all columns look fine, ''value'' included.' END AS narrative,
       [CASE WHEN abs(skewness(value)) > 2.0 THEN 'A few large values dominate averages and linear models' ELSE 'No critical risks' END] AS top_risks FROM events GROUP BY 1""",
)
def _(t):
    """Texts written from the event profiles, read back by the response parser."""
    made = narrative.problem_examples(profile_rows(t), dataset_rows(t))
    return narrative.parse_responses(made, "output").select("dataset", "problem", "narrative", "top_risks")
