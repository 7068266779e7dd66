"""Small hand-made frames with known answers, one per behaviour."""

import math

import pytest
from pyspark.sql import functions as F

from tabwarden.functions import types
from tabwarden.operators import accuracy, completeness, consistency, contract, profile, rules, timeliness
from tabwarden.operators.consistency import ConsistencyRule
from tabwarden.operators.rules import Rule
from tabwarden.plans import checks, engine, rollup


def result(df, cs):
    return {(r["check"], r["column"]): r for r in checks.run(df, cs).collect()}


def test_missing_threshold_fails_at_10_and_passes_at_50_percent(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 2), (None, 3), (4.0, 4), (5.0, 5)], "a double, b long")
    assert result(df, completeness.completeness_checks(df, 0.1))["missing", "a"]["status"] == "warning"
    assert result(df, completeness.completeness_checks(df, 0.5))["missing", "a"]["status"] == "passed"


def test_missing_kinds_and_severities(spark):
    df = spark.createDataFrame([(float("nan"), " \t\n", "-", None), (None, "", "x", None), (1.0, "v", "?", None)], "a double, b string, c string, d int")
    r = {x["column"]: x for x in completeness.column_missing(df, sentinels="default").collect()}
    assert (r["a"]["missing_count"], r["b"]["missing_count"], r["c"]["missing_count"], r["d"]["missing_count"]) == (2, 2, 2, 3)
    assert r["b"]["standard_nulls"] == 0 and r["b"]["additional_missing"] == 2
    got = result(df, completeness.completeness_checks(df, columns=["a", "d", "nope"]))
    assert got["missing", "a"]["severity"] == "error" and got["all_missing", "d"]["status"] == "failed" and got["unknown_column", "nope"]["status"] == "warning"


def test_date_order_rule_and_detection(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-01-05"), ("2024-02-10", "2024-02-01"), ("2024-03-01", None)], "s string, e string").select(
        F.to_date("s").alias("start_date"), F.to_date("e").alias("end_date")
    )
    got = result(df, consistency.consistency_checks(df))
    assert list(got) == [("auto_start_date_before_end_date", None)] and got["auto_start_date_before_end_date", None]["violations"] == 1


def test_expression_counts_null_as_violation_and_comparison_skips_it(spark):
    df = spark.createDataFrame([(1, 2), (3, None), (5, 4)], "a int, b int")
    rs = [ConsistencyRule("cmp", "comparison", ("a", "b")), ConsistencyRule("exp", "expression", ("a", "b"), "a <= b")]
    got = result(df, consistency.rule_checks(df, rs))
    assert got["cmp", None]["violations"] == 1 and got["exp", None]["violations"] == 2


def test_bad_rules_become_rows(spark):
    df = spark.createDataFrame([(1,)], "a int")
    rs = [ConsistencyRule("one", "comparison", ("a",)), ConsistencyRule("op", "comparison", ("a", "a"), parameters={"operator": "~"}), ConsistencyRule("odd", "mystery", ("a",)), ConsistencyRule("gone", "comparison", ("a", "z"))]
    got = result(df, consistency.rule_checks(df, rs))
    assert [got[n, None]["status"] for n in ("one", "op", "odd", "gone")] == ["failed", "failed", "warning", "warning"]


def test_age_range_and_nan(spark):
    df = spark.createDataFrame([(25.0,), (30.0,), (150.0,), (35.0,), (-5.0,), (float("nan"),)], "age double")
    got = result(df, accuracy.rule_checks(df, [accuracy.AccuracyRule("age", "range", {"min": 0, "max": 120})]))
    assert got["range_below", "age"]["violations"] == 1 and got["range_above", "age"]["violations"] == 1


def test_outliers(spark):
    df = spark.createDataFrame([(float(i % 10),) for i in range(99)] + [(100.0,), (None,)], "v double")
    for method in ("zscore", "iqr", "mad"):
        assert result(df, accuracy.outlier_checks(df, ["v"], method))[f"outliers_{method}", "v"]["violations"] == 1
    flat = spark.createDataFrame([(1.0,)] * 5, "v double")
    for method in ("zscore", "iqr", "mad"):
        assert result(flat, accuracy.outlier_checks(flat, ["v"], method))[f"outliers_{method}", "v"]["violations"] == 0
    with pytest.raises(ValueError):
        accuracy.outlier_masks(df, ["v"], "forest")


def test_email_pattern_is_anchored_at_start_only_for_user_patterns(spark):
    df = spark.createDataFrame([("a@b.com",), ("bad",), (None,), ("ab-tail",)], "e string")
    got = result(df, rules.rules_checks(df, [Rule("mail", "email", "e"), Rule("ab", "pattern", "e", parameters={"pattern": "ab"}), Rule("re", "pattern", "e", parameters={"pattern": "("})]))
    assert got["mail", "e"]["violations"] == 2 and got["ab", "e"]["violations"] == 2 and got["re", "e"]["status"] == "failed"


def test_card_nulls_pass_and_unique_counts_later_copies(spark):
    df = spark.createDataFrame([("4111 1111-1111 1111",), (None,), ("12",), ("12",), (None,)], "c string")
    got = result(df, rules.rules_checks(df, [Rule("card", "credit_card", "c"), Rule("once", "unique", "c")]))
    assert got["card", "c"]["violations"] == 2 and got["once", "c"]["violations"] == 2
    dup = contract.duplicate_frame(df, "c").first()
    assert dup["violations"] == 4 and dup["total"] == 5


def test_contract_from_dict(spark):
    df = spark.createDataFrame([(1, "x", 1.5, "A"), (2, None, 2.5, "D")], "id int, name string, value double, category string")
    spec = {
        "columns": [
            {"name": "id", "dtype": "int", "nullable": False, "unique": True}, {"name": "name", "dtype": "string", "nullable": False},
            {"name": "value", "dtype": ["int", "float"]}, {"name": "category", "dtype": "category", "allowed_values": ["A", "B", "C"], "description": "kind"},
        ],
        "allow_extra_columns": True,
    }
    got = result(df, contract.contract_checks(df, spec))
    assert {k: v["violations"] for k, v in got.items() if v["violations"]} == {("not_null", "name"): 1, ("allowed_values", "category"): 1}


def test_no_contract_is_skipped_and_not_scored(spark):
    df = spark.createDataFrame([(1,)], "a int")
    row = rollup.report_summary(checks.run(df, contract.contract_checks(df, None)), df).first()
    assert row["status"] == "skipped" and row["quality_score"] == 1.0


def test_freshness_and_future(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-02 00:04:00",), ("2024-01-02 00:06:00",), ("junk",)], "created_at string")
    got = result(df, timeliness.timeliness_checks(df, "2024-01-02 00:00:00"))
    assert got["freshness", "created_at"]["status"] == "passed" and got["future", "created_at"]["violations"] == 1
    assert got["future", "created_at"]["total"] == 3
    none = spark.createDataFrame([(1,)], "a int")
    assert checks.run(none, timeliness.timeliness_checks(none, "2024-01-02")).first()["status"] == "skipped"


def test_names_with_dots_and_spaces(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "y")], "`a.b` double, `c d` string")
    assert {r["column"]: r["missing_count"] for r in completeness.column_missing(df).collect()} == {"a.b": 1, "c d": 0}
    assert {r["column"] for r in profile.column_base(df).collect()} == {"a.b", "c d"}
    assert profile.numeric_profile(df).first()["column"] == "a.b"
    assert types.numeric_columns(df) == ["a.b"]


@pytest.mark.parametrize("rows", [[], [(1.0, "x", True)], [(None, None, None)], [(float("inf"), "x", True), (float("nan"), "", False)]])
def test_edge_tables_survive(spark, rows):
    df = spark.createDataFrame(rows, "v double, s string, b boolean")
    cfg = engine.QualityConfig(reference_time="2024-01-01", rules=[Rule("r", "range", "v", parameters={"min": 0})])
    assert checks.issues(engine.quality_run(df, cfg)).count() >= 0
    assert rollup.overall(engine.quality_run(df, cfg)).count() == 1
    assert profile.column_base(df).count() == 3 and profile.health_score(df).count() == 1
    profile.numeric_profile(df).collect(), profile.top_values(df).collect(), profile.duplicate_rows(df).collect()


def test_run_reports_plugins_and_broken_validators(spark):
    df = spark.createDataFrame([(1,), (2,)], "a int")

    def broken(_):
        raise ValueError("no luck")

    cfg = engine.QualityConfig(run=("completeness",), custom=[("odd", lambda d: [checks.row_check("odd", "is_odd", "a", "warning", F.col("a") % 2 == 1)]), ("broken", broken)])
    status = {r["validator"]: r["status"] for r in rollup.validator_status(engine.quality_run(df, cfg)).collect()}
    assert status == {"completeness": "passed", "odd": "warning", "broken": "failed"}


def test_constant_column_correlation_is_zero_and_single_value_std(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (3.0, 5.0, 6.5)], "a double, k double, b double")
    got = {(r["feature_a"], r["feature_b"]): r["value"] for r in profile.correlation_pairs(df).collect()}
    assert got["a", "k"] == 0.0 and got["a", "b"] > 0.99
    one = profile.numeric_profile(df.limit(1)).where("column = 'a'").first()
    assert one["std"] == 0.0 and one["skewness"] == 0.0 and one["kurtosis"] == 0.0


def test_constant_histogram_and_ties(spark):
    df = spark.createDataFrame([(4.0, "b"), (4.0, "a"), (4.0, "a"), (4.0, "b")], "v double, s string")
    h = profile.numeric_histogram(df).where("n > 0").collect()
    assert len(h) == 1 and h[0]["bin"] == 10 and math.isclose(h[0]["low"], 4.0)
    assert [r["value"] for r in profile.top_values(df).orderBy("rank").collect()] == ["a", "b"]


def test_numpy_histogram_edges(spark):
    import numpy as np

    v = np.round(np.linspace(0, 1, 101) ** 2, 3)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = [r["n"] for r in profile.numeric_histogram(df).orderBy("bin").collect()]
    assert got == np.histogram(v, 20)[0].tolist()
