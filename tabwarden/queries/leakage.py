"""Contamination, target, feature and temporal leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwarden.operators import contamination, feature, leakage, target, temporal
from tabwarden.operators import network
from tabwarden.plans import engine
from tabwarden.queries.drift import CUR, REF, periods
from tabwarden.queries.profile import LINE_NUM, rounded
from tabwarden.queries.quality import LABELLED, all_of
from tabwarden.queries.registry import query

KEYS = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_linenumber"]
_K = ", ".join(KEYS)


@query(
    "l1_l4_exact_duplicates",
    f"""SELECT count(*) FILTER (WHERE a > 0 AND b > 0) AS exact_duplicates, CAST(sum(b) FILTER (WHERE a > 0) AS BIGINT) AS affected_test_rows,
       CAST(sum(a) AS BIGINT) AS train_rows, CAST(sum(b) AS BIGINT) AS test_rows, CAST(6 AS BIGINT) AS columns_checked,
       round(count(*) FILTER (WHERE a > 0 AND b > 0) / sum(b), 4) AS duplicate_ratio FROM
       (SELECT {_K}, count(*) FILTER (WHERE s = 1) AS a, count(*) FILTER (WHERE s = 0) AS b FROM (SELECT *, 1 AS s FROM {REF} UNION ALL SELECT *, 0 FROM {CUR}) GROUP BY ALL)""",
)
def _(t):
    return contamination.exact_duplicates(*periods(t), columns=KEYS)


_LABEL_COLS = "lang, source, quality, toxic"


@query(
    "l1_duplicates_with_nulls",
    f"""SELECT count(*) FILTER (WHERE a > 0 AND b > 0) AS exact_duplicates, CAST(sum(b) FILTER (WHERE a > 0) AS BIGINT) AS affected_test_rows FROM
       (SELECT {_LABEL_COLS}, count(*) FILTER (WHERE n_chars < 2000) AS a, count(*) FILTER (WHERE n_chars >= 2000) AS b FROM {LABELLED} GROUP BY {_LABEL_COLS})""",
)
def _(t):
    df = t.labelled
    out = contamination.exact_duplicates(df.where("n_chars < 2000"), df.where("n_chars >= 2000"), columns=_LABEL_COLS.split(", "))
    return out.select("exact_duplicates", "affected_test_rows")


@query("l2_duplicated_test_rows", f"SELECT l_orderkey, l_partkey, l_shipdate FROM {CUR} c WHERE EXISTS (SELECT 1 FROM {REF} r WHERE r.l_partkey = c.l_partkey AND r.l_quantity = c.l_quantity)")
def _(t):
    train, test = periods(t)
    return contamination.duplicated_test_rows(train, test, columns=["l_partkey", "l_quantity"]).select("l_orderkey", "l_partkey", "l_shipdate")


_UNIT = """(SELECT p_partkey, p_brand, p_size / n AS a, p_retailprice / n AS b, p_partkey / n AS c FROM
   (SELECT *, sqrt(p_size * p_size + p_retailprice * p_retailprice + p_partkey::DOUBLE * p_partkey) AS n FROM part))"""


@query(
    "l3_near_duplicates",
    f"""SELECT count(*) AS near_duplicates, (SELECT count(*) FROM part WHERE p_brand >= 'Brand#2') AS test_rows FROM {_UNIT} x
       WHERE p_brand >= 'Brand#2' AND EXISTS (SELECT 1 FROM {_UNIT} y WHERE y.p_brand < 'Brand#2' AND x.a * y.a + x.b * y.b + x.c * y.c >= 0.9999999)""",
)
def _(t):
    train, test = t.part.where("p_brand < 'Brand#2'"), t.part.where("p_brand >= 'Brand#2'")
    return contamination.near_duplicates(train, test, columns=["p_size", "p_retailprice", "p_partkey"], threshold=0.9999999)


# Every second vector is train. Test holds the others, and of every tenth train vector two copies: one whose components are
# turned a little (cosine near 0.96) and one turned more (near 0.93).
_TURN = "list_transform(e, lambda x, i: x * (1 + {} * (i % 3 - 1)))"


@query(
    "l3_near_duplicates_embeddings",
    f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
       tr AS (SELECT e FROM v WHERE vec_id % 2 = 0),
       te AS (SELECT e FROM v WHERE vec_id % 2 = 1 UNION ALL SELECT {_TURN.format(0.35)} FROM v WHERE vec_id % 10 = 0 UNION ALL SELECT {_TURN.format(0.5)} FROM v WHERE vec_id % 10 = 0),
       tu AS (SELECT list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM tr), eu AS (SELECT list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM te)
       SELECT count(*) AS near_duplicates, (SELECT count(*) FROM te) AS test_rows FROM eu WHERE EXISTS (SELECT 1 FROM tu WHERE list_dot_product(tu.u, eu.u) >= 0.95)""",
)
def _(t):
    rows = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    turned = lambda k: F.transform("e", lambda x, i: x * (1 + k * ((i + 1) % 3 - 1)))
    some = rows.where("vec_id % 10 = 0")
    test = rows.where("vec_id % 2 = 1").select("e").unionByName(some.select(turned(0.35).alias("e"))).unionByName(some.select(turned(0.5).alias("e")))
    return contamination.near_duplicates(rows.where("vec_id % 2 = 0").select("e"), test, columns=["e"])


_NO_PRICE = [c for c in LINE_NUM if c != "l_extendedprice"]
# A feature computed from the target: its share of the order price after discount.
LEAKY = "(SELECT *, l_extendedprice * (1 - l_discount) AS net_price, l_linestatus = 'F' AS is_final FROM lineitem)"


def leaky(t):
    return t.lineitem.withColumn("net_price", F.col("l_extendedprice") * (1 - F.col("l_discount")))


@query(
    "l5_target_correlation",
    "SELECT * FROM (" + all_of(*[f"SELECT '{c}' AS feature, 'critical' AS severity, round(abs(corr({c}, l_extendedprice)), 4) AS score FROM {LEAKY}" for c in [*_NO_PRICE, "net_price"]]) + ") WHERE score >= 0.95",
)
def _(t):
    found = target.detect(leaky(t), "l_extendedprice")
    return found.where("leakage_type = 'target_leakage'").select("feature", "severity", "score")


@query(
    "l6_label_target_correlation",
    "SELECT * FROM (" + all_of(*[f"SELECT '{c}' AS feature, round(abs(corr({c}, CASE WHEN s = 'hi' THEN 1 ELSE 0 END)), 4) AS score FROM (SELECT *, CASE WHEN value > 50 THEN 'hi' ELSE 'lo' END AS s, CASE WHEN value > 50 THEN 10 ELSE 1 END AS echo FROM events)" for c in ("event_id", "user_id", "value", "echo")]) + ") WHERE score >= 0.6",
)
def _(t):
    df = t.events.withColumn("s", F.when(F.col("value") > 50, "hi").otherwise("lo")).withColumn("echo", F.when(F.col("value") > 50, 10).otherwise(1))
    return target.detect(df, "s", correlation_threshold=0.6).where("leakage_type = 'target_leakage'").select("feature", "score")


def _mi(c: str, y: str, src: str) -> str:
    q = ", ".join(f"quantile_cont({c}, {i / 10})" for i in range(1, 10))
    return f"""(WITH e AS (SELECT list_distinct([{q}]) AS q FROM {src}), b AS (SELECT len(list_filter(q, lambda k: {c} >= k)) AS x, {y} AS y FROM {src}, e),
      j AS (SELECT x, y, count(*) AS n FROM b GROUP BY ALL), m AS (SELECT n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM j)
      SELECT '{c}' AS feature, greatest(sum(n / t * ln(n::DOUBLE * t / (nx::DOUBLE * ny))), 0.0) AS mi, -sum(n / t * ln(ny / t)) AS h FROM m)"""


_MI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]


@query(
    "l7_mutual_information_labels",
    "SELECT feature, round(mi, 6) AS mi, round(mi / h, 6) AS target_share, round(mi / max(mi) OVER (), 6) AS normalized FROM (" + all_of(*[f"SELECT * FROM {_mi(c, 'l_returnflag', 'lineitem')}" for c in _MI_COLS]) + ")",
)
def _(t):
    return rounded(target.mutual_information(t.lineitem, "l_returnflag", _MI_COLS), 6)


_PRICE_BIN = "(SELECT *, len(list_filter((SELECT [" + ", ".join(f"quantile_cont(l_extendedprice, {i / 10})" for i in range(1, 10)) + "] FROM lineitem), lambda k: l_extendedprice >= k)) AS yb FROM lineitem)"


@query(
    "l7_mutual_information_numeric",
    "SELECT feature, round(mi, 6) AS mi, round(mi / h, 6) AS target_share, round(mi / max(mi) OVER (), 6) AS normalized FROM (" + all_of(*[f"SELECT * FROM {_mi(c, 'yb', _PRICE_BIN)}" for c in ("l_quantity", "l_discount")]) + ")",
)
def _(t):
    return rounded(target.mutual_information(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount"]), 6)


@query(
    "l8_l10_feature_findings",
    """SELECT feature, leakage_type, severity FROM (
       SELECT 'price_future' AS feature, 'suspicious_feature_name' AS leakage_type, 'warning' AS severity, 1 AS k UNION ALL SELECT 'order_outcome_label', 'suspicious_feature_name', 'warning', 1
       UNION ALL SELECT 'fixed', 'constant_feature', 'info', (count(DISTINCT 1) <= 1)::INT FROM orders
       UNION ALL SELECT 'o_orderstatus', 'constant_feature', 'info', (count(DISTINCT o_orderstatus) <= 1)::INT FROM orders) WHERE k = 1""",
)
def _(t):
    df = t.orders.withColumn("price_future", F.col("o_totalprice") * 2).withColumn("order_outcome_label", F.col("o_orderstatus")).withColumn("fixed", F.lit(1))
    return leakage.issues(feature.detect(df, "o_orderpriority", check_importance=False)).select("feature", "leakage_type", "severity")


@query(
    "l10_constant_features",
    """SELECT feature, unique_count, CASE WHEN unique_count <= 1 THEN 'constant' ELSE 'near_constant' END AS kind FROM (
       SELECT 'l_returnflag' AS feature, count(DISTINCT l_returnflag) AS unique_count, count(*) AS n FROM lineitem UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus), count(*) FROM lineitem
       UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber), count(*) FROM lineitem UNION ALL SELECT 'l_tax', count(DISTINCT l_tax), count(*) FROM lineitem
       UNION ALL SELECT 'zero', 1, count(*) FROM lineitem) WHERE unique_count <= 1 OR (unique_count / n < 0.01 AND unique_count <= 3)""",
)
def _(t):
    return feature.constant_features(t.lineitem.withColumn("zero", F.lit(0)).drop("l_orderkey"), None)


@query("l9_feature_importance")
def _(t):
    """Forest importances; the net price carries most of the weight."""
    return feature.feature_importance(leaky(t).select(*_NO_PRICE, "net_price", "l_extendedprice"), "l_extendedprice")


@query("l9_top_feature", f"SELECT feature FROM ({all_of(*[f"SELECT '{c}' AS feature, abs(corr({c}, l_extendedprice)) AS r FROM {LEAKY}" for c in [*_NO_PRICE, 'net_price']])}) ORDER BY r DESC LIMIT 1")
def _(t):
    """The most important feature of the forest: the one most correlated with the target, computed from it."""
    found = feature.feature_importance(leaky(t).select(*_NO_PRICE, "net_price", "l_extendedprice"), "l_extendedprice")
    return found.orderBy(F.desc("importance"), "feature").limit(1).select("feature")


@query("l11_time_ranges", f"SELECT 'train' AS side, min(l_shipdate) AS earliest, max(l_shipdate) AS latest, count(*) AS rows FROM {REF} UNION ALL SELECT 'test', min(l_shipdate), max(l_shipdate), count(*) FROM {CUR}")
def _(t):
    return temporal.time_ranges(*periods(t), "l_shipdate")


_TR, _TE = "(SELECT * FROM lineitem WHERE l_returnflag <> 'R')", "(SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1996-06-01')"


@query(
    "l12_l13_split_overlap",
    f"SELECT (SELECT count(*) FROM {_TE} WHERE l_shipdate < (SELECT max(l_shipdate) FROM {_TR})) AS temporal_overlap, (SELECT count(*) FROM {_TR} WHERE l_shipdate > (SELECT min(l_shipdate) FROM {_TE})) AS future_in_train",
)
def _(t):
    train = t.lineitem.where("l_returnflag <> 'R'")
    test = t.lineitem.where("l_returnflag = 'R' AND l_shipdate >= timestamp_ntz'1996-06-01'")
    return temporal.split_overlap(train, test, "l_shipdate")


@query(
    "l14_l15_temporal_findings",
    """SELECT 'price_next' AS feature, 'look_ahead_bias' AS leakage_type FROM (SELECT 1) UNION ALL SELECT 'o_custkey', 'look_ahead_bias'
       UNION ALL SELECT NULL, 'temporal_ordering' FROM (SELECT count(*) FILTER (WHERE o_orderdate < p) AS down, count(*) FILTER (WHERE o_orderdate > p) AS up FROM
       (SELECT o_orderdate, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS p FROM orders)) WHERE down > 0 AND up > 0""",
)
def _(t):
    df = t.orders.withColumn("price_next", F.col("o_totalprice"))
    return leakage.issues(temporal.detect(df, None, look_ahead=["o_custkey"], sequence="o_orderkey")).select("feature", "leakage_type")


_TIME_ORDER = """SELECT count(*) AS rows, count(*) FILTER (WHERE ts < p) AS steps_down, count(*) FILTER (WHERE ts > p) AS steps_up,
       count(*) FILTER (WHERE ts < p) = 0 OR count(*) FILTER (WHERE ts > p) = 0 AS is_time_sorted FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS p FROM events)"""


@query("l15_time_order", _TIME_ORDER)
def _(t):
    return temporal.time_order(t.events, "ts", "event_id")


@query("l15_time_order_nested", _TIME_ORDER)
def _(t):
    """The same in buckets of 8 rows, cut in two levels."""
    return temporal.time_order(t.events, "ts", "event_id", target_rows=8)


def net_periods(t):
    return (df.withColumn("net_price", F.col("l_extendedprice") * (1 - F.col("l_discount"))) for df in periods(t))


def split_run(t, **kw):
    return engine.leakage_run(*net_periods(t), engine.LeakageConfig(target="l_extendedprice", check_importance=False, **kw))


_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice * (1 - l_discount)"]


def _units(src: str) -> str:
    """The numeric features of a run as vectors of length 1."""
    v = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in _NUMERIC) + "]"
    return f"(SELECT list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM (SELECT {v} AS v FROM {src}))"


_FEATURES = "* EXCLUDE (l_extendedprice), l_extendedprice * (1 - l_discount)"
_COPIES = f"(SELECT count(*) FROM (SELECT {_FEATURES} FROM {REF} INTERSECT SELECT {_FEATURES} FROM {CUR}))"
_NEAR = f"(SELECT count(*) FROM (SELECT 1 FROM {_units(REF)} a, {_units(CUR)} b WHERE list_dot_product(a.u, b.u) >= 0.95 LIMIT 1))"
_CORRELATED = "(" + " + ".join(f"(coalesce((SELECT round(abs(corr({c}, l_extendedprice)), 4) FROM {REF}), 0) >= 0.95)::INT" for c in _NUMERIC) + ")"
_BEFORE = f"(SELECT count(*) FROM {CUR} WHERE l_shipdate < (SELECT max(l_shipdate) FROM {REF}))"
_CONSTANT = "(SELECT " + " + ".join(f"(count(DISTINCT {c}) <= 1)::INT" for c in [*_NUMERIC, "l_returnflag", "l_linestatus", "l_shipdate"]) + f" FROM {REF})"
#: Findings of each kind: a detector has found something if one of them is more than information.
_FOUND = f"""(SELECT 'contamination' AS detector, 1 AS k, 'train_test_contamination' AS leakage_type, ({_COPIES} > 0)::INT AS n, true AS counts
   UNION ALL SELECT 'contamination', 1, 'near_duplicate_contamination', ({_NEAR} > 0)::INT, true
   UNION ALL SELECT 'target', 2, 'target_leakage', {_CORRELATED}, true
   UNION ALL SELECT 'feature', 3, 'constant_feature', {_CONSTANT}, false
   UNION ALL SELECT 'temporal', 4, 'temporal_overlap', ({_BEFORE} > 0)::INT, true)"""
_RUN = f"(SELECT detector, k, CASE WHEN sum(n) FILTER (WHERE counts) > 0 THEN 'detected' ELSE 'clean' END AS status, CAST(sum(n) AS BIGINT) AS issues FROM {_FOUND} GROUP BY detector, k)"


@query("l16_detector_status", f"SELECT detector, status, issues FROM {_RUN}")
def _(t):
    return leakage.detector_status(split_run(t))


@query(
    "l17_l18_report_summary",
    f"""SELECT CASE WHEN count(*) FILTER (WHERE status = 'detected') > 0 THEN 'leakage_detected' ELSE 'clean' END AS status, count(*) FILTER (WHERE status = 'detected') > 0 AS has_leakage, CAST(sum(issues) AS BIGINT) AS total_issues,
       count(*) AS detectors_run, count(*) FILTER (WHERE status = 'clean') AS detectors_clean, count(*) FILTER (WHERE status = 'detected') AS detectors_detected FROM {_RUN}""",
)
def _(t):
    return leakage.report_summary(split_run(t))


@query("l18_issues_and_recommendations", f"SELECT leakage_type, CAST(n AS BIGINT) AS issues FROM {_FOUND} WHERE n > 0")
def _(t):
    return leakage.issues_by_type(split_run(t))


@query("l17_quick_check", f"SELECT count(*) > 0 AS has_leakage FROM {_RUN} WHERE status = 'detected'")
def _(t):
    cfg = engine.LeakageConfig(target="l_extendedprice", check_importance=False)
    found = engine.quick_check(*net_periods(t), cfg)
    return t.spark.createDataFrame([(found,)], "has_leakage boolean")


@query("l19_fail_fast_run", f"SELECT detector, status FROM {_RUN} WHERE k <= coalesce((SELECT min(k) FROM {_RUN} WHERE status = 'detected'), 4)")
def _(t):
    """Stops after the first detector that finds something."""
    return leakage.detector_status(split_run(t, fail_fast=True)).select("detector", "status")


@query(
    "n1_correlation_edges",
    "SELECT * FROM (" + all_of(*[f"SELECT '{a}' AS source, '{b}' AS target, round(abs(corr({a}, {b})), 6) AS value FROM {LEAKY}" for i, a in enumerate(["l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "net_price"]) for b in ["l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "net_price"][i + 1 :]]) + ") WHERE value >= 0.3",
)
def _(t):
    df = leaky(t).select("l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "net_price")
    return rounded(network.edges(df, "l_extendedprice"), 6)
