"""Detectors, risk, experiment, history and alerts on planted cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwarden.operators import alerts, contamination, drift, feature, history, impact, leakage, narrative, network, risk, target, temporal
from tabwarden.plans import engine
from tabwarden.sources import readers, sampling, sinks, synthetic
from tabwarden.sources.storage import scratch_path


@pytest.fixture(scope="module")
def leaky(spark):
    rng = np.random.default_rng(42)
    y = rng.integers(0, 2, 500)
    pdf = pd.DataFrame({"id": np.arange(500), "clean": rng.normal(size=500), "leaky": y + rng.normal(scale=0.01, size=500), "moderate": 0.3 * y + 0.7 * rng.normal(size=500), "target": y})
    return spark.createDataFrame(pdf).cache()


def test_copied_rows_are_contamination(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(100, 2)), rng.normal(size=(100, 2))
    b[:20] = a[:20]
    mk = lambda m: spark.createDataFrame(pd.DataFrame(m, columns=["f1", "f2"]))
    row = contamination.exact_duplicates(mk(a), mk(b)).first()
    assert row["exact_duplicates"] == 20 and row["affected_test_rows"] == 20 and row["duplicate_ratio"] == 0.2
    found = contamination.detect(mk(a), mk(b))
    assert {r["leakage_type"] for r in leakage.issues(found).collect()} == {"train_test_contamination"}
    assert leakage.detector_status(contamination.detect(mk(a), None)).first()["status"] == "skipped"


def test_null_position_matters_in_row_identity(spark):
    a = spark.createDataFrame([(None, 5)], "x int, y int")
    b = spark.createDataFrame([(5, None)], "x int, y int")
    assert contamination.exact_duplicates(a, b).first()["exact_duplicates"] == 0


def test_noisy_copy_of_target_is_flagged(leaky):
    found = leakage.issues(target.detect(leaky.drop("id"), "target", 0.9)).collect()
    assert {r["feature"] for r in found if r["severity"] == "critical"} == {"leaky"}
    assert leakage.detector_status(target.detect(leaky, None)).first()["status"] == "skipped"
    assert leakage.detector_status(target.detect(leaky, "ghost")).first()["status"] == "error"


def test_suspicious_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "feature1 int, sales_future int, outcome_label int")
    hits = feature.suspicious_names(df, patterns=feature.SUSPICIOUS_NAMES_WIDE)
    assert sorted(c for names in hits.values() for c in names) == ["outcome_label", "sales_future"]


def test_temporal_overlap(spark):
    ts = lambda d, n: spark.range(n).select((F.lit(d).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id"))).alias("timestamp"), F.col("id").alias("feature"))
    row = temporal.split_overlap(ts("2024-01-01", 100), ts("2024-01-03", 50), "timestamp").first()
    assert row["temporal_overlap"] == 50 and row["future_in_train"] == 51
    assert leakage.detector_status(temporal.detect(spark.createDataFrame([(1, 2)], "a int, b int"))).first()["status"] == "skipped"


def test_drifted_features(spark):
    rng = np.random.default_rng(5)
    a = spark.createDataFrame(pd.DataFrame({"f1": rng.normal(size=500), "f2": rng.normal(size=500), "f3": rng.normal(size=500)}))
    b = spark.createDataFrame(pd.DataFrame({"f1": rng.normal(5, 2, 100), "f2": rng.normal(-3, 2, 100), "f3": rng.normal(size=100)}))
    got = {r["feature"]: r["is_drifted"] for r in drift.analyze_drift(a, b).collect()}
    assert got["f1"] and got["f2"] and not got["f3"]
    same = drift.analyze_drift(a, a, histograms=False).collect()
    assert not any(r["is_drifted"] for r in same) and all(r["p_value"] == 1.0 for r in same)


def test_upper_gamma_known_values():
    # Chi-squared survival values from published tables.
    for x, k, p in ((3.841, 1, 0.05), (5.991, 2, 0.05), (18.307, 10, 0.05), (124.342, 100, 0.05), (6.635, 1, 0.01)):
        assert abs(drift.upper_gamma(k / 2, x / 2) - p) < 2e-5
    assert drift.upper_gamma(2.0, 0.0) == 1.0


def test_risk_orders_leaky_above_clean(leaky):
    rows = {r["feature"]: r for r in risk.predict_risk(leaky, "target", "id").collect()}
    assert rows["leaky"]["correlation_abs"] > 0.8 and rows["leaky"]["risk_score"] > rows["clean"]["risk_score"]
    assert rows["id"]["high_cardinality_risk"] == 1.0
    nodes = {r["id"]: r for r in network.nodes(leaky, "target", risk.score_signals(risk.signals(leaky, "target", "id"))).collect()}
    assert nodes["target"]["group"] == "target" and nodes["target"]["val"] == 10


def test_no_numeric_features_gives_an_empty_score_table(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1)], "category string, target int")
    assert risk.overall_risk(risk.score_signals(risk.signals(df, "target", "target"))).first()["overall_risk"] == "low"


def test_importance_and_experiment(leaky):
    weights = {r["feature"]: r["importance"] for r in feature.feature_importance(leaky.drop("id"), "target").collect()}
    assert weights["leaky"] > 0.5 and abs(sum(weights.values()) - 1) < 1e-6
    metrics, removed = impact.run_experiment(leaky, "target", "id", kind="logistic", risk_threshold=0.0, folds=2)
    by = {r["stage"]: r for r in metrics.collect()}
    assert by["before"]["accuracy"] > 0.95 and impact.kept_features(["a"], ["a"]) == ["a"]
    assert {r["feature"] for r in removed.collect()} == {"clean", "leaky", "moderate"} and by["after"]["features"] == 3
    with pytest.raises(ValueError):
        impact._model("tree", 2, 10)


def test_churn_table_leaks_three_features(spark):
    df = synthetic.churn_table(spark, 2000)
    assert len(df.columns) == 14 and df.count() == 2000
    row = df.agg(F.corr("churn_risk_score", "churned"), F.corr("age", "churned"), F.avg("churned")).first()
    assert row[0] > 0.99 and abs(row[1]) < 0.2 and 0.3 < row[2] < 0.9
    assert synthetic.churn_table(spark, 50).collect() == synthetic.churn_table(spark, 50).collect()


def test_leakage_run_isolates_errors(spark, leaky):
    def broken(*_):
        raise ValueError("no")

    cfg = engine.LeakageConfig(run=("target",), target="target", custom=[("custom", broken)])
    status = {r["detector"]: r["status"] for r in leakage.detector_status(engine.leakage_run(leaky, None, cfg)).collect()}
    assert status == {"target": "detected", "custom": "error"} and engine.quick_check(leaky, None, cfg)


def _scan(spark, rows):
    base = ("d", "quality", "v", "s", 10, ["a", "b"])
    full = [(f"s{i}", *base, "passed", issues, score, None, ts) for i, (issues, score, ts) in enumerate(rows)]
    return spark.createDataFrame(full, "scan_id string, dataset_name string, scan_type string, version_hash string, schema_hash string, row_count long, column_names array<string>, status string, total_issues long, quality_score double, risk_level string, timestamp string").withColumn(
        "timestamp", F.col("timestamp").cast("timestamp_ntz")
    )


@pytest.mark.parametrize("issues, score, severity", [(3, 0.9, "none"), (15, 0.5, "critical"), (6, 0.8, "minor"), (5, 0.6, "major"), (5, 0.45, "critical"), (11, 0.8, "major")])
def test_regression_severity_is_the_worse_of_both(spark, issues, score, severity):
    diff = history.scan_diffs(_scan(spark, [(5, 0.8, "2024-01-01"), (issues, score, "2024-01-02")])).first()
    assert diff["regression_severity"] == severity and diff["has_regression"] == (severity != "none")


def test_version_hash_ignores_row_order_but_not_content(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a int, b string")
    h = lambda d: history.dataset_version(d).first()["version_hash"]
    assert h(a) == h(a.repartition(3).orderBy(F.desc("a"))) and h(a) != h(a.distinct()) and h(a) != h(a.withColumn("b", F.lit("x")))
    assert history.schema_hash(a) == history.schema_hash(a.select("b", "a")) != history.schema_hash(a.select("a"))


def test_alert_severities_actions_and_state(spark):
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    d = spark.createDataFrame([("f", 0.75, True), ("g", 0.1, False)], "feature string, drift_score double, is_drifted boolean")
    drifted = alerts.drift_alerts(d, at).collect()
    assert [(r["severity"], [x["action"] for x in r["recommendations"]]) for r in drifted] == [("error", ["retrain_model", "investigate"])]
    leaks = alerts.leakage_alerts(spark.createDataFrame([("f", 0.9)], "feature string, risk_score double"), at)
    assert leaks.first()["severity"] == "critical" and [x["priority"] for x in leaks.first()["recommendations"]] == [10, 8]
    both = alerts.drift_alerts(d, at).unionByName(leaks)
    total = {(r["dimension"], r["value"]): r for r in alerts.alert_summary(both).collect()}
    assert total["all", None]["n"] == 2 and total["all", None]["critical_open"] == 1
    done = alerts.current_state(both, alerts.status_event(leaks, "resolved", at)).where("status = 'resolved'")
    assert done.count() == 1


def test_history_files(spark):
    path = scratch_path(spark, "scans")
    sinks.append_events(_scan(spark, [(1, 0.9, "2024-01-01"), (2, 0.8, "2024-01-02"), (3, 0.7, "2024-01-03")]), path, "timestamp")
    assert [r["scan_id"] for r in sinks.retained_scans(spark, path, 2).collect()] == ["s2", "s1"]
    into = scratch_path(spark, "compact")
    sinks.compact(spark, path, into, 1, "timestamp", "scan_id")
    assert spark.read.parquet(into).count() == 1


def test_formats():
    assert [readers.detect_format(p) for p in ("a/b.CSV", "x.jsonl", "y.parquet", "plain", "z.csv.gz")] == ["csv", "json", "parquet", "csv", "csv"]
    with pytest.raises(ValueError):
        readers.detect_format("t.xlsx")


def test_split_keeps_class_shares(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 10 < 9, "common").alias("y"))
    got = {(r["y"], r["side"]): r["count"] for r in sampling.stratified_split(df, "y", "id").groupBy("y", "side").count().collect()}
    assert got == {("rare", "test"): 20, ("rare", "train"): 80, ("common", "test"): 160, ("common", "train"): 640, (None, "test"): 20, (None, "train"): 80}
    folds = sampling.stratified_folds(df, "y", "id", 5).groupBy("y", "fold").count().collect()
    assert len(folds) == 15 and {r["count"] for r in folds if r["y"] == "rare"} == {20}


def test_response_without_sections_and_empty(spark):
    df = spark.createDataFrame([("",), ("just text",), ("2. Top Critical Risks:\n- a\n2. b\n\n4. Executive Summary: fine",)], "text string")
    empty, plain, part = narrative.parse_responses(df).collect()
    assert empty["narrative"] == narrative.NO_NARRATIVE and plain["narrative"] == "just text..."
    assert part["top_risks"] == ["a", "b"] and part["executive_summary"] == "fine" and part["recommendations"] == []


def test_problem_examples(spark):
    profiles = spark.createDataFrame(
        [("a", 0, "x", "float", 0.5, 3, 1.0, 1.0, 0.1, 0.2), ("b", 0, "x", "float", 0.0, 3, 1.0, 1.0, 0.1, 0.99), ("b", 1, "y", "float", 0.6, 3, 1.0, 1.0, 9.0, 0.0), ("c", 0, "x", "string", 0.0, 3, None, None, None, None), ("d", 0, "x", "string", 0.0, 3, None, None, None, None)],
        "dataset string, position int, column string, type string, missing_pct double, unique_count long, mean double, std double, skewness double, target_correlation double",
    )
    datasets = spark.createDataFrame([(d, 10, 2, 0.1, 0, 0.2 if d == "d" else 0.0, 90.0, ["r"]) for d in "abcd"], "dataset string, rows int, columns int, memory_mb double, duplicate_rows int, duplicate_pct double, health_score double, risks array<string>")
    got = {r["dataset"]: r for r in narrative.problem_examples(profiles, datasets).collect()}
    assert {d: r["problem"] for d, r in got.items()} == {"a": "high_missingness", "b": "multi_issue", "c": "healthy", "d": "duplicate_contamination"}
    assert "'x'" in got["b"]["output"] and got["a"]["input"].startswith("Dataset Name: a\n") and "50.0% missing" in got["a"]["input"]


def test_registered_runs_notice_near_copies_alone(spark, tmp_path):
    """The only leak is that test rows nearly repeat train rows: the quick check and the issue list must say so."""
    import __spark_entry__ as entry
    from tabwarden.queries.leakage import split_run
    from tabwarden.queries.registry import Tables

    rng = np.random.default_rng(3)
    price, net = rng.uniform(100, 1000, 400), rng.uniform(1, 90, 400)
    row = pd.DataFrame({"l_orderkey": rng.integers(1, 10**6, 400), "l_partkey": rng.integers(1, 10**6, 400), "l_extendedprice": price, "l_discount": 1 - net / price})
    days = pd.to_timedelta(rng.permutation(400) % 100, unit="D")
    pdf = pd.concat([row.assign(l_shipdate=pd.Timestamp(start) + days) for start in ("1992-01-01", "1998-06-01")])
    spark.createDataFrame(pdf).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/lineitem.parquet")
    others = leakage.detector_status(split_run(Tables(spark, str(tmp_path)), run=("target", "feature", "temporal")))
    assert others.where("status = 'detected'").isEmpty()
    queries = entry.queries()
    assert queries["l17_quick_check"](spark, str(tmp_path)).first().has_leakage
    assert "near_duplicate_contamination" in {r.entry for r in queries["l18_issues_and_recommendations"](spark, str(tmp_path)).collect()}


def test_retention_reads_the_newest_days_only(spark, tmp_path):
    """Ten days of four rows: the newest ten rows lie in three days, and no older day is listed in the plan."""
    from pyspark.sql import functions as F

    from tabwarden.sources import sinks

    path = str(tmp_path / "history")
    rows = spark.range(40).select(F.col("id").alias("k"), F.timestamp_seconds(F.col("id") * 21_600).cast("timestamp_ntz").alias("timestamp"))
    sinks.append_events(rows, path, "timestamp")
    got = sinks.newest_days(spark, path, 10)
    assert sorted(r.k for r in got.collect()) == list(range(28, 40))
    days = {r.f.split("day=")[1][:10] for r in got.select(F.input_file_name().alias("f")).collect()}
    assert len(days) == 3 and "PartitionFilters: [isnotnull(day" in got._jdf.queryExecution().toString()
    assert sinks.newest_days(spark, path, 1_000).count() == 40
    sinks.compact(spark, path, str(tmp_path / "kept"), 10, "timestamp", "k")
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == list(range(30, 40))
