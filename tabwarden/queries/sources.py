"""Readers, samples, splits and sinks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwarden.operators import history, impact
from tabwarden.operators.rules import Rule, rules_checks
from tabwarden.plans import checks, rollup
from tabwarden.queries.history import ALERTS, SCANS, scan_alerts, scans
from tabwarden.queries.quality import _STATUS, all_of, brief, expect, n_if, orders_report
from tabwarden.queries.registry import query
from tabwarden.sources import readers, sampling, sinks
from tabwarden.sources.storage import scratch_path

CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query("s1_s13_csv_round_trip", CUSTOMER)
def _(t):
    path = scratch_path(t.spark, "customer") + ".csv"
    sinks.write_csv(t.customer, path)
    return readers.load(t.spark, path, schema=t.customer.schema)


@query("s2_json_round_trip", "SELECT doc_id, md5(text) AS text, lang, source, n_chars FROM documents")
def _(t):
    path = scratch_path(t.spark, "documents") + ".json"
    t.documents.write.json(path)
    return readers.load(t.spark, path, schema=t.documents.schema).withColumn("text", F.md5("text"))


@query("s3_s4_load_by_extension", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    return readers.load(t.spark, f"{t.sf_dir}/nation.parquet")


@query("s4_inferred_csv", "SELECT p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size, round(sum(p_retailprice), 2) AS price FROM part GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "part")
    sinks.write_csv(t.part, path)
    df = readers.load(t.spark, path)  # no extension: read as CSV, types inferred
    return df.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"), F.round(F.sum("p_retailprice"), 2).alias("price"))


@query("s5_train_test_pair", "SELECT 'train' AS side, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer UNION ALL SELECT 'test', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer")
def _(t):
    path = f"{t.sf_dir}/customer.parquet"
    both = readers.with_side(*readers.load_train_test(t.spark, path, path))
    return both.groupBy("side").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query("s6_sample_rows", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem ORDER BY md5(CAST(l_orderkey AS VARCHAR)), l_orderkey, l_partkey LIMIT 500")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber")
    return df.orderBy(F.md5(F.col("l_orderkey").cast("string")), "l_orderkey", "l_partkey").limit(500)


@query("s6_sample_exact_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500")
def _(t):
    return sampling.sample_rows(t.orders, "o_orderkey", 500).select("o_orderkey", "o_totalprice")


@query("s6_sample_fraction", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 15) AS BIGINT) < CAST(0.1 * 1152921504606846976 AS BIGINT)")
def _(t):
    return sampling.sample_fraction(t.lineitem, "l_orderkey", 0.1).select("l_orderkey", "l_partkey", "l_linenumber")


@query("s8_rule_table", all_of(expect("price", "o_totalprice", "warning", n_if("o_totalprice > 300000"), "orders"), expect("status", "o_orderstatus", "error", n_if("o_orderstatus NOT IN ('F')"), "orders")))
def _(t):
    path = scratch_path(t.spark, "rules")
    rules = [
        Rule("price", "range", "o_totalprice", parameters={"max": 300000}),
        Rule("status", "in_list", "o_orderstatus", severity="error", parameters={"values": ["F"]}),
        Rule("off", "range", "o_totalprice", enabled=False, parameters={"max": 1}),
    ]
    sinks.save_rules(t.spark, rules, path)
    return brief(checks.run(t.orders, rules_checks(t.orders, sinks.load_rules(t.spark, path))))


@query("s9_scan_history", f"SELECT scan_id, dataset_name, total_issues FROM {SCANS} ORDER BY \"timestamp\" DESC, scan_id DESC LIMIT 1000")
def _(t):
    path = scratch_path(t.spark, "scans")
    sinks.append_events(scans(t).where("scan_type = 'quality'"), path, "timestamp")
    sinks.append_events(scans(t).where("scan_type <> 'quality'"), path, "timestamp")
    return sinks.retained_scans(t.spark, path, history.MAX_SCANS).select("scan_id", "dataset_name", "total_issues")


@query("s10_alert_history", f"SELECT alert_id, severity FROM {ALERTS} ORDER BY created_at DESC, alert_id DESC LIMIT 500")
def _(t):
    path = scratch_path(t.spark, "alerts")
    sinks.append_events(scan_alerts(t), path, "created_at")
    return sinks.retained_alerts(t.spark, path, history.MAX_ALERTS).select("alert_id", "severity")


@query("s11_report_tables")
def _(t):
    path = scratch_path(t.spark, "reports")
    sinks.write_reports(orders_report(t), path, "scan-1", "2001-08-02 00:00:00")
    return t.spark.read.parquet(path)


@query("s11_report_status", f"SELECT 'scan-1' AS scan_id, TIMESTAMP '2001-08-02' AS created_at, validator, status, issues FROM {_STATUS}")
def _(t):
    """Status of each validator, from the report that was written and read again."""
    path = scratch_path(t.spark, "reports")
    sinks.write_reports(orders_report(t), path, "scan-1", "2001-08-02 00:00:00")
    back = t.spark.read.parquet(path)
    return rollup.validator_status(back).select(F.lit(back.first()["scan_id"]).alias("scan_id"), F.lit(back.first()["created_at"]).alias("created_at"), "validator", "status", "issues")


@query(
    "s12_experiment_report",
    """WITH m AS (SELECT o_orderstatus = 'F' AS before, avg((o_totalprice > 200000)::INT) AS a, avg((o_totalprice > 150000)::INT) AS c FROM orders GROUP BY 1),
       d AS (SELECT b.a - f.a AS d, b.c - b.a AS gb, f.c - f.a AS ga FROM (SELECT * FROM m WHERE before) b, (SELECT * FROM m WHERE NOT before) f),
       v AS (SELECT *, CASE WHEN d > 0.1 THEN 'significant' WHEN d > 0.02 THEN 'moderate' ELSE 'minimal' END AS v FROM d)
       SELECT unnest(['verdict: ' || v, printf('accuracy drop: %.4f', d), printf('generalization gap: %.4f before, %.4f after', gb, ga), 'advice: ' || CASE v
         WHEN 'significant' THEN 'Remove identified leaky features; Review feature engineering pipeline; Audit data collection process'
         WHEN 'moderate' THEN 'Review suspicious features; Monitor model performance in production; Consider partial removal'
         ELSE 'Features appear clean; Maintain monitoring; Document findings' END]) AS value FROM v""",
)
def _(t):
    path = scratch_path(t.spark, "experiment")
    over = lambda v: F.avg((F.col("o_totalprice") > v).cast("double"))
    stages = t.orders.groupBy(F.when(F.col("o_orderstatus") == "F", "before").otherwise("after").alias("stage")).agg(
        over(200000).alias("accuracy"), over(150000).alias("cv_accuracy_mean"), F.stddev_pop("o_totalprice").alias("cv_accuracy_std")
    )
    files = sinks.write_experiment(impact.compare(stages), path)
    return t.spark.read.text(files["text"])


