"""Drift of lineitem and orders between an early and a late period."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwarden.operators import drift
from tabwarden.plans import engine
from tabwarden.queries.profile import rounded
from tabwarden.queries.quality import all_of
from tabwarden.queries.registry import query

CUT = "1998-01-01"
NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"]
REF = f"(SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUT}')"
CUR = f"(SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '{CUT}')"


def periods(t):
    cut = F.lit(CUT).cast("timestamp_ntz")
    return t.lineitem.where(F.col("l_shipdate") < cut), t.lineitem.where(F.col("l_shipdate") >= cut)


def priced(t):
    """Two classes of events with shifted values, so that something does drift."""
    old = t.events.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    new = t.events.where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).withColumn("value", F.col("value") * 1.5)
    return old, new


OLD = "(SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-15')"
NEW = "(SELECT event_id, ts, user_id, event_type, value * 1.5 AS value, props FROM events WHERE ts >= TIMESTAMP '2024-01-15')"


def psi_open_sql(c: str, ref: str, cur: str) -> str:
    return f"""(WITH e AS (SELECT [quantile_cont({c}, 0.1), quantile_cont({c}, 0.2), quantile_cont({c}, 0.3), quantile_cont({c}, 0.4), quantile_cont({c}, 0.5),
        quantile_cont({c}, 0.6), quantile_cont({c}, 0.7), quantile_cont({c}, 0.8), quantile_cont({c}, 0.9)] AS q FROM {ref}),
      b AS (SELECT 0 AS side, len(list_filter(q, lambda k: {c} >= k)) AS bin FROM {ref}, e UNION ALL SELECT 1, len(list_filter(q, lambda k: {c} >= k)) FROM {cur}, e),
      s AS (SELECT g.bin, greatest((SELECT count(*) FROM b WHERE side = 0 AND b.bin = g.bin) / (SELECT count(*) FROM b WHERE side = 0), 0.0001) AS e,
        greatest((SELECT count(*) FROM b WHERE side = 1 AND b.bin = g.bin) / (SELECT count(*) FROM b WHERE side = 1), 0.0001) AS a FROM range(0, 10) g(bin))
      SELECT '{c}' AS feature, sum((e - a) * ln(e / a)) AS psi FROM s)"""


def psi_closed_sql(c: str, ref: str, cur: str) -> str:
    return f"""(WITH e AS (SELECT list_sort(list_distinct([CAST(min({c}) AS DOUBLE), quantile_cont({c}, 0.1), quantile_cont({c}, 0.2), quantile_cont({c}, 0.3), quantile_cont({c}, 0.4), quantile_cont({c}, 0.5),
        quantile_cont({c}, 0.6), quantile_cont({c}, 0.7), quantile_cont({c}, 0.8), quantile_cont({c}, 0.9), CAST(max({c}) AS DOUBLE)])) AS q FROM {ref}),
      b AS (SELECT side, least(len(list_filter(q, lambda k: v >= k)), len(q) - 1) AS bin FROM (SELECT 0 AS side, {c} AS v FROM {ref} UNION ALL SELECT 1, {c} FROM {cur}), e WHERE v >= q[1] AND v <= q[len(q)]),
      k AS (SELECT unnest(range(1, len(q))) AS bin, len(q) - 1 AS k FROM e),
      s AS (SELECT k.bin, ((SELECT count(*) FROM b WHERE side = 0 AND b.bin = k.bin) + 1) / ((SELECT count(*) FROM b WHERE side = 0) + k) AS e,
        ((SELECT count(*) FROM b WHERE side = 1 AND b.bin = k.bin) + 1) / ((SELECT count(*) FROM b WHERE side = 1) + k) AS a FROM k)
      SELECT '{c}' AS feature, sum((a - e) * ln(a / e)) AS psi FROM s)"""


def ks_sql(c: str, ref: str, cur: str) -> str:
    return f"""(WITH v AS (SELECT x, count(*) FILTER (WHERE s = 0) AS a, count(*) FILTER (WHERE s = 1) AS b FROM
        (SELECT {c} AS x, 0 AS s FROM {ref} UNION ALL SELECT {c}, 1 FROM {cur}) WHERE x IS NOT NULL GROUP BY x),
      r AS (SELECT sum(a) OVER (ORDER BY x) / sum(a) OVER () - sum(b) OVER (ORDER BY x) / sum(b) OVER () AS g FROM v)
      SELECT '{c}' AS feature, CAST((SELECT sum(a) FROM v) AS BIGINT) AS n0, CAST((SELECT sum(b) FROM v) AS BIGINT) AS n1, max(abs(g)) AS ks FROM r)"""


_P = """CASE WHEN ks * sqrt(n0::DOUBLE * n1 / (n0 + n1)) < 0.3 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 101),
   lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * (ks * ks * n0 * n1 / (n0 + n1))))))) END"""


@query("d1_psi_open_bins", "SELECT feature, round(psi, 6) AS psi FROM (" + all_of(*[f"SELECT * FROM {psi_open_sql(c, REF, CUR)}" for c in NUMS]) + ")")
def _(t):
    ref, cur = periods(t)
    return rounded(drift.psi_open(ref, cur, NUMS), 6)


@query("d2_psi_closed_bins", "SELECT feature, round(psi, 6) AS psi FROM (" + all_of(*[f"SELECT * FROM {psi_closed_sql(c, REF, CUR)}" for c in [*NUMS, "l_linenumber"]]) + ")")
def _(t):
    ref, cur = periods(t)
    return rounded(drift.psi_closed(ref, cur, [*NUMS, "l_linenumber"]), 6)


@query(
    "d3_d4_kolmogorov_smirnov",
    f"SELECT feature, n0, n1, round(ks, 8) AS ks, round(p, 6) AS p_value FROM (SELECT *, {_P} AS p FROM (" + all_of(*[f"SELECT * FROM {ks_sql(c, REF, CUR)}" for c in NUMS], f"SELECT * FROM {ks_sql('l_orderkey', REF, CUR)}") + "))",
)
def _(t):
    ref, cur = periods(t)
    ks = drift.ks_statistic(ref, cur, [*NUMS, "l_orderkey"])
    ks = ks.withColumn("p_value", F.round(drift.ks_p_value(F.col("ks"), F.col("n0"), F.col("n1")), 6))
    return ks.withColumn("ks", F.round("ks", 8))


# Upper tail of the chi-squared distribution: one minus the series of the lower incomplete gamma function, far past its largest term.
_TAIL = """CASE WHEN chi2 <= 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, CAST(chi2 / 2 + 40 * sqrt(chi2) + 200 AS BIGINT)),
   lambda n: exp((dof / 2.0 + n) * ln(chi2 / 2) - chi2 / 2 - lgamma(dof / 2.0 + n + 1))))) END"""

@query("d3_nested_buckets", f"SELECT feature, n0, n1, round(ks, 8) AS ks FROM {ks_sql('value', OLD, NEW)}")
def _(t):
    """The value buckets of 8 rows, cut in two levels."""
    old, new = priced(t)
    return drift.ks_statistic(old, new, ["value"], target_rows=8).withColumn("ks", F.round("ks", 8))


_CHI = """(WITH c AS (SELECT x, count(*) FILTER (WHERE s = 0) AS a, count(*) FILTER (WHERE s = 1) AS b FROM (SELECT {c} AS x, 0 AS s FROM {ref} UNION ALL SELECT {c}, 1 FROM {cur}) GROUP BY x),
   e AS (SELECT *, (a + 1) / ((SELECT sum(a) FROM c) + (SELECT count(*) FROM c)) * (SELECT sum(b) FROM c) AS x0 FROM c),
   q AS (SELECT sum((b - x0) * (b - x0) / x0) AS chi2, count(*) - 1 AS dof, count(*) FILTER (WHERE a > 0) AS train_categories, count(*) FILTER (WHERE b > 0) AS test_categories, count(*) FILTER (WHERE a = 0) AS new_categories FROM e),
   p AS (SELECT *, """ + _TAIL + """ AS p FROM q)
   SELECT '{c}' AS feature, round(chi2, 6) AS chi2, dof, train_categories, test_categories, new_categories, round(p, 6) AS p_value, p < 0.05 AS has_drift, 'tested' AS status, CAST(NULL AS VARCHAR) AS reason FROM p)"""


@query("d5_d9_category_drift", all_of(*[f"SELECT * FROM {_CHI.format(c=c, ref=REF, cur=CUR)}" for c in ("l_returnflag", "l_linestatus")], "SELECT * FROM " + _CHI.format(c="x", ref="(SELECT event_type || CASE WHEN value > 300 THEN '!' ELSE '' END AS x FROM " + OLD + ")", cur="(SELECT event_type || CASE WHEN value > 300 THEN '!' ELSE '' END AS x FROM " + NEW + ")")))
def _(t):
    ref, cur = periods(t)
    old, new = priced(t)
    tag = F.concat("event_type", F.when(F.col("value") > 300, "!").otherwise("")).alias("x")
    out = drift.chi2_drift(ref, cur, ["l_returnflag", "l_linestatus"]).unionByName(drift.chi2_drift(old.select(tag), new.select(tag), ["x"]))
    return rounded(out, 6)


@query("d6_density_histograms", all_of(*[f"""SELECT '{c}' AS feature, CAST(g.bin AS INT) AS bin, round(coalesce(a, 0) / (SELECT count(*) FROM {OLD}) / ((hi - lo) / 20), 8) AS reference,
    round(coalesce(b, 0) / (SELECT count(*) FROM {NEW}) / ((hi - lo) / 20), 8) AS current FROM range(0, 20) g(bin) LEFT JOIN
    (SELECT len(list_filter(range(1, 20), lambda i: {c} >= lo + i * ((hi - lo) / 20))) AS bin, count(*) FILTER (WHERE s = 0) AS a, count(*) FILTER (WHERE s = 1) AS b
     FROM (SELECT {c}, 0 AS s FROM {OLD} UNION ALL SELECT {c}, 1 FROM {NEW}), (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM (SELECT {c} FROM {OLD} UNION ALL SELECT {c} FROM {NEW})) GROUP BY 1) h ON h.bin = g.bin,
    (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM (SELECT {c} FROM {OLD} UNION ALL SELECT {c} FROM {NEW}))""" for c in ("value", "user_id")]))
def _(t):
    old, new = priced(t)
    return rounded(drift.density_histograms(old, new, ["value", "user_id"]), 8)


_D7 = "(SELECT p.feature, psi, ks, " + _P + " AS p_value FROM (" + all_of(*[f"SELECT * FROM {psi_open_sql(c, OLD, NEW)}" for c in ("value", "user_id")]) + ") p JOIN (" + all_of(*[f"SELECT * FROM {ks_sql(c, OLD, NEW)}" for c in ("value", "user_id")]) + ") k USING (feature))"


@query("d7_drift_verdict", f"SELECT feature, round(psi, 6) AS drift_score, round(ks, 6) AS ks, round(p_value, 6) AS p_value, psi >= 0.2 OR p_value <= 0.05 AS is_drifted, CAST(20 AS INT) AS bins FROM {_D7}")
def _(t):
    out = drift.analyze_drift(*priced(t), ["value", "user_id"])
    return rounded(out.withColumn("bins", F.size("distribution_current")).select("feature", "drift_score", "ks", "p_value", "is_drifted", "bins"), 6)


@query(
    "d8_split_drift",
    "SELECT p.feature, round(ks, 4) AS ks, round(" + _P + ", 4) AS p_value, 'tested' AS status, CAST(NULL AS VARCHAR) AS reason, round(psi, 4) AS psi, (" + _P + ") < 0.05 OR psi > 0.2 AS has_drift, round(train_mean, 4) AS train_mean, round(test_mean, 4) AS test_mean, round(train_std, 4) AS train_std, round(test_std, 4) AS test_std FROM ("
    + all_of(*[f"SELECT * FROM {psi_closed_sql(c, OLD, NEW)}" for c in ("value", "user_id", "event_id")]) + ") p JOIN ("
    + all_of(*[f"SELECT * FROM {ks_sql(c, OLD, NEW)}" for c in ("value", "user_id", "event_id")]) + ") k USING (feature) JOIN ("
    + all_of(*[f"SELECT '{c}' AS feature, (SELECT avg({c}) FROM {OLD}) AS train_mean, (SELECT avg({c}) FROM {NEW}) AS test_mean, (SELECT stddev_samp({c}) FROM {OLD}) AS train_std, (SELECT stddev_samp({c}) FROM {NEW}) AS test_std" for c in ("value", "user_id", "event_id")])
    + ") m USING (feature)",
)
def _(t):
    old, new = priced(t)
    return rounded(drift.numeric_drift(old, new))


@query("d10_drift_summary", f"""SELECT count(*) FILTER (WHERE d) > 0 AS drift_detected, count(*) FILTER (WHERE d) AS drifted_features_count, count(*) AS total_features_analyzed,
   coalesce(list(feature ORDER BY feature) FILTER (WHERE d), []) AS drifted_features, round(avg(psi), 6) AS overall_drift_score FROM (SELECT *, psi >= 0.2 OR p_value <= 0.05 AS d FROM {_D7})""")
def _(t):
    return rounded(drift.drift_summary(drift.analyze_drift(*priced(t), ["value", "user_id"], histograms=False)), 6)


@query("d11_drift_findings", f"SELECT 'value' AS feature, 'warning' AS severity, 'data_drift' AS leakage_type, round(psi, 4) AS score FROM {psi_closed_sql('value', OLD, NEW)}")
def _(t):
    old, new = priced(t)
    found = engine.drift_findings(old.select("value", "event_type"), new.select("value", "event_type"), None)
    return found.where("leakage_type <> 'checked'").select("feature", "severity", "leakage_type", F.round("score", 4).alias("score"))


_MANY = "(WITH c AS (SELECT x, count(*) FILTER (WHERE s = 0) AS a, count(*) FILTER (WHERE s = 1) AS b FROM (SELECT 'u' || user_id AS x, 0 AS s FROM " + OLD + " UNION ALL SELECT 'u' || user_id, 1 FROM " + NEW + """) GROUP BY x),
   e AS (SELECT *, (a + 1) / ((SELECT sum(a) FROM c) + (SELECT count(*) FROM c)) * (SELECT sum(b) FROM c) AS x0 FROM c)
   SELECT 'x' AS feature, round(sum((b - x0) * (b - x0) / x0), 4) AS chi2, count(*) - 1 AS dof, 'tested' AS status FROM e)"""


@query("d5_many_categories", f"SELECT * FROM {_MANY} UNION ALL SELECT 'gone', NULL, NULL, 'skipped'")
def _(t):
    """More categories than any limit, and a feature that one side lacks altogether."""
    pick = lambda df: df.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("x"), F.lit(None).cast("string").alias("gone"))
    old, new = (pick(df) for df in priced(t))
    out = drift.chi2_drift(old, new, ["x", "gone"])
    return out.select("feature", F.round("chi2", 4).alias("chi2"), "dof", "status")


@query("d8_skipped_features", "SELECT 'steady' AS feature, 'skipped' AS status, 'constant on one side' AS reason UNION ALL SELECT 'gone', 'skipped', 'fewer than 10 values'")
def _(t):
    old, new = priced(t)
    pick = lambda df, v: df.select(v.alias("steady"), F.when(F.col("value") < 0, F.col("value")).alias("gone"))
    return drift.numeric_drift(pick(old, F.lit(1.0)), pick(new, F.col("value"))).select("feature", "status", "reason")
