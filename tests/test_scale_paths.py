"""The paths for large data, forced on small tables, against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwarden.functions import attach, moments, ordering, selection
from tabwarden.functions.labels import code_table, label_codes
from tabwarden.functions.ordering import order_buckets, running_totals, value_buckets
from tabwarden.operators import contamination, drift, impact, near_vectors, profile, rank_correlation, risk, temporal, timeliness
from tabwarden.plans import checks


@pytest.fixture(scope="module")
def skewed(spark):
    """4,000 rows; a third of them share one value."""
    rng = np.random.default_rng(7)
    n = 4000
    x = np.where(rng.random(n) < 0.34, 5.0, np.round(rng.gamma(2.0, 4.0, n), 3))
    pdf = pd.DataFrame({"id": np.arange(n), "x": x, "y": np.round(rng.normal(size=n) + x / 10, 2), "z": rng.integers(0, 7, n).astype(float)})
    pdf.loc[::11, "y"] = np.nan
    return spark.createDataFrame(pdf).repartition(5).cache(), pdf


@pytest.mark.parametrize("limit", [3, 40, 10_000])
def test_exact_quantiles(skewed, limit):
    df, pdf = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = selection.exact_quantiles(df, {c: F.nanvl(F.col(c), F.lit(None)) for c in ("x", "y", "z")}, probs, limit)
    for c in ("x", "y", "z"):
        assert np.allclose(got[c], np.quantile(pdf[c].dropna(), probs), rtol=1e-13)


def test_order_statistics_of_large_longs(spark):
    base = 2**60
    df = spark.range(3000).select((F.lit(base) + (F.col("id") * 7919) % 3000).alias("v"))
    got = selection.order_statistics(df, {"v": F.col("v")}, {"v": [0, 1, 1499, 2999]}, 50)
    assert got == {("v", r): base + r for r in (0, 1, 1499, 2999)}


ADVERSARIAL = {
    "neighbours": [2.0**53 + 2 * k for k in range(400)] + [2.0**53 - k for k in range(400)],
    "cluster": [1e300, -1e300] + [1e-300 * (1 + k * 2.0**-52) for k in range(700)],
    "one_value": [0.1] * 900 + [math.nextafter(0.1, 1)] * 30 + [-0.1] * 7,
    "powers": [s * 2.0**e * m for e in range(-1074, 1024, 7) for s in (-1, 1) for m in (1.0, 1.0 - 2.0**-53)],
    "zeros_and_infinities": [0.0, -0.0] * 100 + [math.inf, -math.inf] * 50 + [5e-324, -5e-324, 1.7976931348623157e308] * 9,
    "full_range": [float(x) for x in np.random.default_rng(2).integers(0, 2**64, 800, dtype=np.uint64).view(np.float64) if x == x],
}


@pytest.mark.parametrize("name", ADVERSARIAL)
def test_radix_selection_of_adversarial_values(spark, name, monkeypatch):
    """Every rank asked for is exact, every class that is ordered is under the limit, and 64 / BITS rounds do."""
    values = np.array(ADVERSARIAL[name])
    sizes, rounds = [], []
    picked, digits = selection._picked, selection._Columns.digits
    monkeypatch.setattr(selection, "_picked", lambda cols, classes: (sizes.extend(c.count for cs in classes.values() for c in cs), picked(cols, classes))[1])
    monkeypatch.setattr(selection._Columns, "digits", lambda self, classes: (rounds.append(1), digits(self, classes))[1])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (math.nan,)], "v double").repartition(3)
    ranks = sorted({0, 1, len(values) // 3, len(values) // 2, len(values) - 2, len(values) - 1})
    got = selection.order_statistics(df, {"v": F.col("v")}, {"v": ranks}, 20)
    assert [got["v", r] for r in ranks] == np.sort(values)[ranks].tolist()
    assert max(sizes, default=0) <= 20 and len(rounds) <= 64 // selection.BITS


def test_radix_selection_of_longs_and_decimals_over_their_whole_range(spark):
    longs = [-(2**63), 2**63 - 1, 2**53, 2**53 + 1, 2**53 + 2, -1, 0, 1] * 40
    df = spark.createDataFrame([(v, str(v % 10**15)) for v in longs], "v long, t string").withColumn("d", F.col("t").cast("decimal(30,3)"))
    got = selection.order_statistics(df, {"v": F.col("v"), "d": F.col("d")}, {"v": [0, 40, 200, 319], "d": [0, 160, 319]}, 10)
    assert got == {**{("v", r): sorted(longs)[r] for r in (0, 40, 200, 319)}, **{("d", r): float(sorted(v % 10**15 for v in longs)[r]) for r in (0, 160, 319)}}


def test_keys_order_like_doubles(spark):
    values = sorted({float(v) for vs in ADVERSARIAL.values() for v in vs})
    rows = selection.order_keys(spark.createDataFrame([(v, v) for v in values], "v double, k double"), ["k"]).collect()
    by = sorted((r["v"], r["k"]) for r in rows)
    assert all(a[1] < b[1] for a, b in zip(by, by[1:])) and all(selection.value_of(k) == v for v, k in by)


def test_quantiles_of_empty_and_null(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert selection.exact_quantiles(df, {"v": F.col("v")}, [0.5]) == {"v": None}
    assert selection.exact_quantiles(df.where("false"), {"v": F.col("v")}, [0.5]) == {"v": None}


def test_running_totals_across_buckets(skewed):
    df, pdf = skewed
    cut, ids = value_buckets(df.select("x"), ["x"], target_rows=300)
    assert ids > 5
    counts = cut.groupBy(F.lit(0).alias("g"), "x", "x__b").agg(F.count("*").alias("n"))
    got = {r["x"]: r["upto_n"] for r in running_totals(counts, ["g"], "x", "x__b", ["n"]).collect()}
    want = pdf["x"].value_counts().sort_index().cumsum()
    assert got == want.to_dict()


def test_hot_order_value_is_split_by_key(skewed):
    df, _ = skewed
    cut = order_buckets(df.select("id", "x"), "x", "id", target_rows=300)
    sizes = cut.groupBy("bucket").count().collect()
    assert max(r["count"] for r in sizes) < 900 and len(sizes) > 8
    ordered = cut.groupBy("bucket").agg(F.min(F.struct("x", "id")).alias("lo"), F.max(F.struct("x", "id")).alias("hi")).orderBy("bucket").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(ordered, ordered[1:]))


def test_nested_buckets_are_small_ordered_and_deterministic(spark, monkeypatch):
    """Two and more levels: 5,000 rows, a third of them one value, in buckets of about 8 by passes of 20 parts."""
    monkeypatch.setattr(ordering, "FAN", 20)
    rng = np.random.default_rng(3)
    rows = [(i, float(v)) for i, v in enumerate(np.where(rng.random(5000) < 0.34, 5.0, rng.normal(5, 1e-6, 5000)))]
    df = spark.createDataFrame(rows, "id long, x double").repartition(4)
    cut = order_buckets(df, "x", "id", target_rows=8)
    got = cut.collect()
    assert sorted((r["id"], r["x"]) for r in got) == rows and sorted(map(tuple, got)) == sorted(map(tuple, cut.collect()))
    sizes = pd.Series([r["bucket"] for r in got]).value_counts()
    assert sizes.max() <= 16 and len(sizes) > 20 * 20
    ends = cut.groupBy("bucket").agg(F.min(F.struct("x", "id")).alias("lo"), F.max(F.struct("x", "id")).alias("hi")).orderBy("bucket").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(ends, ends[1:]))
    counts, ids = value_buckets(df.select("x"), ["x"], target_rows=8)
    assert ids > 400
    per = counts.groupBy("x__b").agg(F.count("*").alias("n"), F.countDistinct("x").alias("d"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("x__b").collect()
    assert all(r["n"] <= 16 or r["d"] == 1 for r in per) and all(a["hi"] < b["lo"] for a, b in zip(per, per[1:]))


def test_next_value_across_buckets(skewed):
    df, pdf = skewed
    got = risk.with_next(df.select("id", "x", "z"), "z", "x", "id", "nxt", target_rows=300).select("id", "nxt").toPandas().set_index("id")["nxt"].sort_index()
    s = pdf.sort_values(["x", "id"])
    want = s["z"].shift(-1).set_axis(s["id"]).sort_index()
    pd.testing.assert_series_equal(got, want, check_names=False)


def test_ks_with_buckets_equals_plain(skewed):
    df, pdf = skewed
    a, b = df.where("id % 3 = 0"), df.where("id % 3 <> 0").withColumn("y", F.col("y") + 0.2)
    plain = {r["feature"]: r["ks"] for r in drift.ks_statistic(a, b, ["x", "y", "z"]).collect()}
    cut = {r["feature"]: r["ks"] for r in drift.ks_statistic(a, b, ["x", "y", "z"], target_rows=150).collect()}
    assert plain.keys() == cut.keys() and all(math.isclose(plain[k], cut[k], abs_tol=1e-12) for k in plain)
    u, v = np.sort(pdf.x[pdf.id % 3 == 0]), np.sort(pdf.x[pdf.id % 3 != 0])
    at = np.unique(pdf.x)
    want = np.max(np.abs(np.searchsorted(u, at, "right") / len(u) - np.searchsorted(v, at, "right") / len(v)))
    assert math.isclose(plain["x"], want, abs_tol=1e-12)


@pytest.mark.parametrize("method", ["spearman", "kendall"])
@pytest.mark.parametrize("target_rows", [None, 300])
def test_rank_correlation(skewed, method, target_rows):
    df, pdf = skewed
    fn = rank_correlation.spearman_pairs if method == "spearman" else rank_correlation.kendall_pairs
    got = {(r["feature_a"], r["feature_b"]): r["value"] for r in fn(df, ["x", "y", "z"], target_rows).collect()}
    for (a, b), value in got.items():
        p = pdf[[a, b]].dropna()
        if method == "spearman":
            want = p.rank().corr().iloc[0, 1]
        else:
            x, y = p[a].to_numpy(), p[b].to_numpy()
            c = d = 0
            for i in range(len(x) - 1):
                s = np.sign(x[i + 1 :] - x[i]) * np.sign(y[i + 1 :] - y[i])
                c, d = c + (s > 0).sum(), d + (s < 0).sum()
            n0 = len(x) * (len(x) - 1) / 2
            tie = lambda v: sum(t * (t - 1) / 2 for t in pd.Series(v).value_counts())
            want = (c - d) / math.sqrt((n0 - tie(x)) * (n0 - tie(y)))
        assert math.isclose(value, want, abs_tol=1e-9), (a, b)


@pytest.mark.parametrize("target_rows", [None, 300])
def test_spearman_of_complete_columns(skewed, target_rows):
    df, pdf = skewed
    got = rank_correlation.spearman_pairs(df, ["x", "z", "id"], target_rows).collect()
    for r in got:
        assert math.isclose(r["value"], pdf[[r["feature_a"], r["feature_b"]]].rank().corr().iloc[0, 1], abs_tol=1e-9)
    assert len(got) == 3


def test_time_order_across_buckets(spark):
    df = spark.range(2000).select(F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"))
    assert temporal.time_order(df, "ts", "seq", target_rows=100).first()["is_time_sorted"]
    swapped = df.withColumn("ts", F.when(F.col("seq") == 777, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).otherwise(F.col("ts")))
    row = temporal.time_order(swapped, "ts", "seq", target_rows=100).first()
    assert not row["is_time_sorted"] and row["steps_down"] == 1 and row["rows"] == 2000


def test_auc_across_buckets(skewed):
    df, pdf = skewed
    pred = df.select((F.col("z") > 3).cast("int").alias("label"), F.col("x").alias("score"))
    cut, plain = impact.roc_auc(pred, target_rows=300).first()[0], impact.roc_auc(pred).first()[0]
    r = pdf["x"].rank()
    pos = pdf["z"] > 3
    want = (r[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert math.isclose(plain, want, abs_tol=1e-12) and math.isclose(cut, want, abs_tol=1e-12)


def test_rank_bins_equal_quantile_cut_of_ranks(skewed):
    df, pdf = skewed
    bins = risk.rank_bins(df, {"x": F.col("x"), "z": F.col("z")}, "id")
    got = df.select("id", bins["x"].alias("x"), bins["z"].alias("z")).toPandas().sort_values("id")
    for c in ("x", "z"):
        want = pd.qcut(pdf[c].rank(method="first"), 10, labels=False)
        assert (got[c].to_numpy() == want.to_numpy()).all()


def _brute_near(train, test, t):
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    return int(((unit(test) @ unit(train).T).max(axis=1) >= t).sum())


@pytest.mark.parametrize("threshold", [0.9, 0.99, 0.9999])
@pytest.mark.parametrize("group_rows", [5, 50_000])
def test_near_duplicates_equal_brute_force(spark, threshold, group_rows):
    rng = np.random.default_rng(3)
    cols = [f"c{i}" for i in range(5)]
    train, test = rng.normal(size=(300, 5)), rng.normal(size=(200, 5))
    train[:100] = train[0] + rng.normal(scale=0.01, size=(100, 5))  # a third in one spot
    test[:60] = train[0] + rng.normal(scale=0.02, size=(60, 5))
    test[60:70] = train[200:210] * 3.0
    test[70] = 0.0
    mk = lambda m: spark.createDataFrame(pd.DataFrame(m, columns=cols))
    got = contamination.near_duplicate_rows(mk(train), mk(test), cols, threshold, group_rows).agg(F.sum("n")).first()[0]
    assert got == _brute_near(train, test, threshold)


def test_near_duplicates_at_reference_threshold_of_integers(spark):
    a = spark.createDataFrame([(1, 2, 3), (10, 0, 0)], "a int, b int, c int")
    b = spark.createDataFrame([(2, 4, 6), (0, 0, 0), (0, 1, 0)], "a int, b int, c int")
    assert contamination.near_duplicates(a, b).first().asDict() == {"near_duplicates": 1, "test_rows": 3}


def test_label_codes_over_the_limit(spark):
    df = spark.createDataFrame([(c,) for c in "pear fig apple kiwi fig lime".split()] + [(None,)], "v string")
    small = {r["value"]: r["code"] for r in code_table(df, "v").collect()}
    large = {r["value"]: r["code"] for r in code_table(df, "v", max_rows=2).collect()}
    assert small == large == {"apple": 0, "fig": 1, "kiwi": 2, "lime": 3, "pear": 4}
    coded = {r["v"]: r["c"] for r in label_codes(df, "v", "c", max_rows=2).collect()}
    assert coded[None] == -1 and coded["fig"] == 1


@pytest.mark.parametrize("limit_hours", [0.001, 0.5, 100.0])
def test_gaps_equal_sorted_differences(spark, monkeypatch, limit_hours):
    rng = np.random.default_rng(11)
    t = np.sort(np.concatenate([rng.integers(0, 10**11, 300), np.full(150, 5 * 10**10), rng.integers(0, 10**8, 300)]))
    df = spark.createDataFrame([(int(x),) for x in t], "t long").select(F.expr("timestampadd(MICROSECOND, t, timestamp_ntz'2024-01-01')").alias("ts"))
    monkeypatch.setattr(timeliness, "CHUNK", 4)  # several levels of chunks
    got = timeliness.gap_statistics(df, "ts", limit_hours)
    gaps = np.diff(t) / timeliness.HOUR
    assert math.isclose(got["max_gap_hours"], gaps.max()) and math.isclose(got["avg_gap_hours"], gaps.mean())
    assert got["large_gap_count"] == (gaps > limit_hours).sum()


def test_results_do_not_depend_on_partitioning(skewed):
    df, _ = skewed
    one = drift.psi_open(df.where("id < 2000"), df.where("id >= 2000"), ["x", "y"]).orderBy("feature").collect()
    other = drift.psi_open(df.where("id < 2000").repartition(1), df.where("id >= 2000").repartition(13), ["x", "y"]).orderBy("feature").collect()
    assert [round(r["psi"], 12) for r in one] == [round(r["psi"], 12) for r in other]


def test_kendall_of_a_million_distinct_values(spark):
    """Ranks of a known order: y falls in blocks of 8 and rises between them, so the share of discordant pairs is known."""
    n = 1_000_000
    df = spark.range(n, numPartitions=8).selectExpr("cast(id as double) as a", "cast(id - id % 8 + 7 - id % 8 as double) as b")
    value = rank_correlation.kendall_pairs(df, ["a", "b"], target_rows=200_000).first()["value"]
    assert math.isclose(value, 1 - 2 * (n / 8 * 28) / (n * (n - 1) / 2), abs_tol=1e-12)
    text = rank_correlation.concordant_weight(spark.createDataFrame([("a", "b", 0, 1.0, 0, 1)], "feature_a string, feature_b string, r long, y double, yb long, n long"), ["feature_a", "feature_b"], 3, 1)._jdf.queryExecution().toString()
    assert "Pandas" not in text and "Python" not in text


def test_moments_of_many_columns(spark, monkeypatch):
    """200 columns with gaps, one constant, one infinite, one far from zero: no row is copied per pair."""
    monkeypatch.setattr(moments, "BLOCK", 64)
    rng = np.random.default_rng(11)
    m = rng.normal(size=(900, 200)) + np.arange(200) * 1e3
    m[:, 1] = m[:, 0] * 2 + rng.normal(size=900)
    m[:, 2], m[5, 3], m[:, 4] = 0.1, np.inf, 1e9 + m[:, 1]
    pdf = pd.DataFrame(m, columns=[f"c{i}" for i in range(200)])
    gaps = rng.random(m.shape) < 0.1
    rows = [tuple(None if g else float(v) for v, g in zip(r, k)) for r, k in zip(m, gaps)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(200))).repartition(5)
    out = profile.correlation_pairs(df, fill=None)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["feature_a"], r["feature_b"]): r["value"] for r in out.collect()}
    assert len(got) == 200 * 199 // 2
    known = pdf.where(~gaps).sub(pdf.median())

    def want(a, b):
        both = known[[a, b]].dropna().to_numpy()
        return np.corrcoef(both[:, 0], both[:, 1])[0, 1]

    for (a, b), value in got.items():
        if {a, b} & {"c2", "c3"} and not (a == "c3" or b == "c3") or "c2" in (a, b):
            assert value is None
        elif "c3" in (a, b):
            other = b if a == "c3" else a
            assert (value is None) == (not gaps[5, int(other[1:])] and not gaps[5, 3])
        else:
            assert math.isclose(value, want(a, b), abs_tol=1e-9), (a, b)


def test_two_thousand_checks_are_one_scan(spark):
    df = spark.range(500).selectExpr("id", "id % 7 AS m", "if(id % 5 = 0, NULL, id) AS v", "1 AS raised").repartition(3)
    many = [checks.row_check("rules", f"above_{k}", "id", "warning", F.col("id") > k) for k in range(1_990)]
    many += [checks.row_check("rules", f"total_{k}", "v", "error", F.col("v") > k, total=F.count("v")) for k in (10, 400)]
    many.append(checks.Check("rules", "sum", "m", "error", F.sum("m"), message="an aggregate that is no row check"))
    out = checks.run(df, many)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1
    got = {r["check"]: (r["violations"], r["total"]) for r in out.collect()}
    assert all(got[f"above_{k}"] == (max(499 - k, 0), 500) for k in range(1_990))
    assert got["total_10"] == (sum(1 for i in range(500) if i % 5 and i > 10), 400) and got["total_400"] == (sum(1 for i in range(500) if i % 5 and i > 400), 400)
    assert got["sum"] == (sum(i % 7 for i in range(500)), 500)
    assert {r["violations"] for r in checks.run(df.limit(0), many[:-1]).collect()} == {0}


def test_failing_expressions_are_found_by_halves(spark, monkeypatch):
    df = spark.range(50).withColumn("t", F.concat(F.lit("x"), F.col("id").cast("string")))
    bad = {3, 40}
    many = [checks.row_check("rules", f"r{k}", "t", "error", F.col("t").cast("int") > 0 if k in bad else F.col("id") < 0, may_fail=True) for k in range(64)]
    got = {r["check"]: r["violations"] for r in checks.run(df, many).collect()}
    assert {k for k, v in got.items() if v} == {f"r{k}" for k in bad}


def brute_near(train, test, threshold):
    def unit(v):
        v = np.array([0.0 if x is None or x != x else x for x in v], float) if v is not None else None
        return None if v is None or not np.any(v) or np.isinf(v).any() else v / np.linalg.norm(v / np.abs(v).max()) / np.abs(v).max()

    known = [u for u in map(unit, train) if u is not None]
    return sum(u is not None and any(len(u) == len(k) and u @ k >= threshold for k in known) for u in map(unit, test))


@pytest.mark.parametrize("tile, threshold", [(8, 0.95), (1024, 0.8)])
def test_near_vectors_match_brute_force(spark, monkeypatch, tile, threshold):
    monkeypatch.setattr(near_vectors, "TILE", tile)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 24))
    near = lambda n, s: [list(map(float, centers[k % 6] + s * rng.normal(size=24))) for k in range(n)]
    train = near(120, 0.3) + [[1e200] * 24, [0.0] * 24, [1.0, 2.0], None] + [near(1, 0.1)[0]] * 40
    test = near(90, 0.5) + near(60, 1.0) + train[:5] + [[1e-200] * 24, [math.inf] + [1.0] * 23, [2.0, 4.0], [1.0, math.nan], [], None] + [list(map(float, rng.normal(size=24))) for _ in range(60)]
    side = lambda rows: spark.createDataFrame([(v,) for v in rows], "v array<double>").repartition(3)
    out = contamination.near_duplicates(side(train), side(test), columns=["v"], threshold=threshold).first()
    assert out["near_duplicates"] == brute_near(train, test, threshold) and out["test_rows"] == len(test)
    assert contamination.near_duplicates(side(train).limit(0), side(test), columns=["v"]).first()["near_duplicates"] == 0
    wide = lambda rows: spark.createDataFrame([tuple(v) for v in rows if v is not None and len(v) == 24], ", ".join(f"c{i} double" for i in range(24)))
    assert contamination.near_duplicates(wide(train), wide(test), threshold=threshold).first()["near_duplicates"] == brute_near([v for v in train if v and len(v) == 24], [v for v in test if v and len(v) == 24], threshold)


def test_compared_pairs_of_near_vectors_grow_with_the_rows(spark):
    """Random vectors, and a dense region of a third of both sides that its representatives settle: pairs in tiles per row stay level."""
    def pairs(n):
        rng = np.random.default_rng(n)
        draw = lambda m: [list(map(float, v)) for v in np.concatenate((rng.normal(size=(2 * m // 3, 32)), 1 + 0.05 * rng.normal(size=(m // 3, 32))))]
        side = lambda rows: spark.createDataFrame([(v,) for v in rows], "v array<double>").repartition(3)
        m = near_vectors.Matcher(side(draw(n)), side(draw(n)), 0.95)
        left = m.test.join(m.represented(m.test, m.shared(m.test, "a")), ["h1", "h2"], "left_anti")
        return m.shared(left, "b").agg(F.sum(F.col("ct") * F.col("cr"))).first()[0] or 0

    small, large = pairs(600), pairs(2_400)
    assert large <= 8 * max(small, 600) and large < 0.05 * 2_400 * 2_400


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_facts_reach_a_frequent_key_without_moving_its_rows(spark, monkeypatch, how):
    """One key holds half of 20,000 rows; no task after the join has more than its share."""
    monkeypatch.setattr(attach, "MAX_BROADCAST", 10)
    monkeypatch.setattr(attach, "HOT_ROWS", 500)
    rows = spark.range(20_000, numPartitions=8).selectExpr("id", "if(id % 2 = 0, 7, if(id % 31 = 0, NULL, id)) AS k")
    facts = spark.range(15_000).selectExpr("id AS k", "id * 10 AS fact")
    assert [r.k for r in attach.frequent_keys(rows.where("k is not null"), ["k"]).collect()] == [7]
    out = attach.attached(rows, facts, ["k"], how)
    want = sorted(map(repr, rows.join(facts, "k", how).select(*out.columns).collect()))
    assert sorted(map(repr, out.collect())) == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in attach.attached(rows, facts, ["k"], how).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) <= 20_000 / 4


def _written(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


@pytest.mark.parametrize("open_, task_cover, cover, candidates", [(8_192, 256, 1_024, 16), (8_192, 3, 2, 16), (0, 3, 2, 16), (0, 1, 1, 1)])
def test_near_vectors_after_the_cover_match_brute_force(spark, monkeypatch, open_, task_cover, cover, candidates):
    """Settled by the cover, by a scan of train, by sketches of what the cover leaves, and by tiles of what these leave; as rows and as a number."""
    monkeypatch.setattr(near_vectors, "CANDIDATES", candidates, raising=False)
    monkeypatch.setattr(near_vectors, "OPEN", open_)
    monkeypatch.setattr(near_vectors, "TASK_COVER", task_cover)
    monkeypatch.setattr(near_vectors, "COVER", cover)
    rng = np.random.default_rng(8)
    train = np.concatenate((rng.normal(size=(300, 12)), 1 + 0.1 * rng.normal(size=(300, 12))))
    test = np.concatenate((train[:40] + 0.15 * rng.normal(size=(40, 12)), train[:5], train[:5], 1 + 0.3 * rng.normal(size=(200, 12)), rng.normal(size=(60, 12)), np.zeros((2, 12))))
    names = [f"c{i}" for i in range(12)]
    mk = lambda m: spark.createDataFrame(pd.DataFrame(m, columns=names)).repartition(3)
    want = _brute_near(train, test, 0.95)
    rows = contamination.near_duplicate_rows(mk(train), mk(test), names, 0.95).collect()
    assert sum(r.n for r in rows) == want == contamination.near_duplicates(mk(train), mk(test)).first().near_duplicates
    assert len({tuple(r.unit) for r in rows}) == len(rows) and {r.n for r in rows} >= {1, 2}


def test_sparse_vectors_are_not_copied(spark, monkeypatch, tmp_path):
    """Vectors that no cover settles are sketched: what the search writes is a small part of their 1.6 MB."""
    for name in ("OPEN", "LISTED_BYTES"):
        monkeypatch.setattr(near_vectors, name, 0, raising=False)
    monkeypatch.setattr(near_vectors, "scratch_path", lambda *_: str(tmp_path / "kept"))
    rng = np.random.default_rng(9)
    train, test = rng.normal(size=(1_500, 64)), rng.normal(size=(1_600, 64))
    test[:300] = train[:300] + rng.uniform(0.1, 0.5, (300, 1)) * rng.normal(size=(300, 64))
    side = lambda m: spark.createDataFrame([(v.tolist(),) for v in m], "v array<double>").repartition(3)
    want = _brute_near(train, test, 0.95)
    assert 50 < want < 300 and contamination.near_duplicates(side(train), side(test), columns=["v"]).first().near_duplicates == want
    assert 0 < _written(tmp_path / "kept") < 160_000


def _line_rows(spark, folder):
    """Keys beside prices, as in lineitem: 6,000 rows of two periods."""
    rng = np.random.default_rng(6)
    n = 6_000
    pdf = pd.DataFrame({
        "l_orderkey": rng.integers(1, 10**6, n), "l_partkey": rng.integers(1, 10**5, n), "l_suppkey": rng.integers(1, 10**4, n), "l_linenumber": rng.integers(1, 8, n), "l_quantity": rng.integers(1, 51, n) * 1.0,
        "l_extendedprice": rng.uniform(900, 10**5, n).round(2), "l_discount": rng.integers(0, 11, n) / 100, "l_tax": rng.integers(0, 9, n) / 100, "l_returnflag": rng.choice(["A", "N", "R"], n), "l_linestatus": rng.choice(["F", "O"], n),
        "l_shipdate": pd.Timestamp("1995-01-01") + pd.to_timedelta(rng.integers(0, 2_000, n), unit="D"),
    })
    spark.createDataFrame(pdf).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz")).write.parquet(f"{folder}/lineitem.parquet")
    early = (pdf["l_shipdate"] < "1998-01-01").to_numpy()
    m = pdf.assign(net=pdf["l_extendedprice"] * (1 - pdf["l_discount"]))[["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "net"]].to_numpy(float)
    return m[early], m[~early]


#: A row that each run gives for lines whose periods share directions.
_SAID = {
    "l16_detector_status": {"detector": "contamination", "status": "detected", "issues": 1},
    "l19_fail_fast_run": {"detector": "contamination", "status": "detected"},
    "l17_l18_report_summary": {"status": "leakage_detected", "has_leakage": True, "total_issues": 2, "detectors_run": 4, "detectors_clean": 2, "detectors_detected": 2},
    "l17_quick_check": {"has_leakage": True},
    "l18_issues_and_recommendations": {"leakage_type": "near_duplicate_contamination", "issues": 1},
}


@pytest.mark.parametrize("name", _SAID)
def test_leakage_runs_keep_no_copy_of_their_vectors(spark, monkeypatch, tmp_path, name):
    """The cover settles rows that lean one way: what the search for near copies writes is a small part of their 384 kB of vectors."""
    import __spark_entry__ as entry

    train, test = _line_rows(spark, tmp_path / "in")
    assert _brute_near(train, test, 0.95) > 0
    monkeypatch.setattr(near_vectors, "scratch_path", lambda *_: str(tmp_path / "kept"))
    out = [r.asDict() for r in entry.queries()[name](spark, str(tmp_path / "in")).collect()]
    assert 0 < _written(tmp_path / "kept") < 40_000
    assert _SAID[name] in out
