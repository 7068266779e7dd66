"""Many classes, skipped features, infinities, mixed types and users' errors."""

import math

from tabwarden.functions.expr import among
from tabwarden.operators import accuracy, consistency, drift, feature, profile
from tabwarden.operators.consistency import ConsistencyRule
from tabwarden.plans import checks
from tabwarden.sources import sampling


def test_split_of_many_classes(spark, monkeypatch):
    monkeypatch.setattr(sampling, "SLICE_ROWS", 50)
    df = spark.range(6_000).selectExpr("id", "nullif(cast(id % 1500 as int), 3) as y")
    for limit in (100_000, 10):
        monkeypatch.setattr(sampling, "BROADCAST_CLASSES", limit)
        got = sampling.stratified_split(df, "y", "id", 0.25).groupBy("y", "side").count().collect()
        assert len(got) == 2 * 1500 and all(r["count"] == (1 if r["side"] == "test" else 3) for r in got)


def test_categories_beyond_a_hundred(spark):
    a, b = spark.range(9_000).selectExpr("concat('a', id % 300) as c"), spark.range(9_000).selectExpr("concat('b', id % 300) as c")
    row = drift.chi2_drift(a, b, ["c"]).first()
    assert row["status"] == "tested" and row["has_drift"] and row["new_categories"] == 300
    row = drift.chi2_drift(a, b, ["c"], max_categories=100).first()
    assert row["status"] == "skipped" and row["chi2"] is None and row["has_drift"] is None


def test_constant_and_empty_sides_are_rows(spark):
    a = spark.range(100).selectExpr("1.0D as k", "cast(id as double) as e")
    b = spark.range(100).selectExpr("cast(id as double) as k", "cast(null as double) as e")
    assert {r["feature"]: r["status"] for r in drift.numeric_drift(a, b).collect()} == {"k": "skipped", "e": "skipped"}
    assert {r["feature"]: r["status"] for r in drift.analyze_drift(a, b, histograms=False).collect()} == {"k": "tested", "e": "skipped"}


def test_infinite_and_missing_numbers(spark):
    df = spark.createDataFrame([(float(i % 7), float(i)) for i in range(200)] + [(math.inf, 1.0), (math.nan, 2.0)], "a double, b double")
    masks = accuracy.outlier_masks(df, ["a"])
    assert df.where(masks["a"]).count() == 1
    assert profile.correlation_pairs(df, ["a", "b"], fill=None).first()["value"] is None
    bins = profile.numeric_histogram(df, ["a"], bins=6).collect()
    assert sum(r["n"] for r in bins) == 200 and all(math.isfinite(r["low"]) for r in bins)


def test_listed_values(spark):
    df = spark.createDataFrame([(1, "F"), (2, "O"), (None, None)], "n int, s string")
    found = lambda c, v: [r[0] for r in df.orderBy(df.n.asc_nulls_last()).select(among(df, c, v)).collect()]
    assert found("s", ["F", None]) == [True, False, None]
    assert found("n", ["A", "2", None]) == [False, True, None]
    assert found("n", ["A"]) == found("n", []) == [False, False, None]


def test_errors_stay_in_their_check(spark):
    df = spark.range(10).selectExpr("id", "cast(id as string) as s")
    rules = [
        ConsistencyRule("divides", "expression", (), "1 / (id % 2) >= 0"),
        ConsistencyRule("casts", "expression", (), "cast(concat('x', s) as int) > 0"),
        ConsistencyRule("fine", "expression", (), "id < 9"),
        ConsistencyRule("lost", "referential", ("id",), parameters={"reference_table": "nowhere", "reference_column": "id"}),
        ConsistencyRule("column", "referential", ("id",), parameters={"reference_column": "nothing"}),
    ]
    got = {r["check"]: (r["status"], r["violations"]) for r in checks.run(df, consistency.rule_checks(df, rules)).collect()}
    assert got == {"divides": ("failed", 1), "casts": ("failed", 1), "fine": ("failed", 1), "lost": ("failed", 1), "column": ("failed", 1)}


def test_importance_of_fractional_and_many_named_targets(spark):
    df = spark.range(600).selectExpr("cast(id % 4 as double) as a", "cast(id % 5 as double) as b", "(id % 4) / 10 as y", "concat('c', id % 150) as name")
    few = {r["feature"]: r["importance"] for r in feature.feature_importance(df.select("a", "b", "y"), "y").collect()}
    assert few["a"] > few["b"]
    assert feature.feature_importance(df.select("a", "b", "name"), "name").count() == 2
