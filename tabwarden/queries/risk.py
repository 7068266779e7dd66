"""Risk signals, scores, network nodes and the impact experiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwarden.operators import impact, network, risk
from tabwarden.queries.profile import rounded
from tabwarden.queries.quality import LABELLED, all_of
from tabwarden.queries.registry import query
from tabwarden.sources.sampling import stratified_folds, stratified_split

COLS = ["l_quantity", "l_extendedprice", "l_discount"]
RANKED_KEY = "row_id"
# lineitem has no single-column key; order key, part and line number together identify a row.
LINES = "(SELECT *, l_orderkey * 100000000 + l_partkey * 10 + l_linenumber AS row_id FROM lineitem)"


def lines(t):
    return t.lineitem.withColumn("row_id", F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 10 + F.col("l_linenumber"))


def _qbin(c: str) -> str:
    return f"greatest(ceil((row_number() OVER (ORDER BY {c}, event_id) - 1) * 10 / (count(*) OVER () - 1)), 1) - 1"


EVENT_BINS = f"(SELECT *, {_qbin('value')} AS vb, {_qbin('user_id')} AS ub FROM events)"


def _abs_corr(a: str, b: str, src: str, where: str = "true") -> str:
    return f"(SELECT coalesce(abs(CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END), 0) FROM {src} WHERE {where})"


@query("x1_target_correlation_signal", all_of(*[f"SELECT '{c}' AS feature, round({_abs_corr(c, 'k', '(SELECT *, dense_rank() OVER (ORDER BY l_returnflag) AS k FROM lineitem)')}, 6) AS correlation_abs FROM (SELECT 1)" for c in COLS]))
def _(t):
    out = risk.correlation_signals(lines(t), "l_returnflag", "row_id", COLS)
    return rounded(out.select("feature", "correlation_abs"), 6)


@query("x2_rank_bins", f"SELECT CAST(vb AS INT) AS value_bin, CAST(ub AS INT) AS user_bin, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM {EVENT_BINS} GROUP BY 1, 2")
def _(t):
    bins = risk.rank_bins(t.events, {"value": F.col("value"), "user_id": F.col("user_id")}, "event_id")
    return t.events.groupBy(bins["value"].alias("value_bin"), bins["user_id"].alias("user_bin")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


_CELLS = f"(SELECT 'value' AS feature, vb AS bin, k AS cls, count(*) AS n FROM (SELECT *, dense_rank() OVER (ORDER BY event_type) - 1 AS k FROM {EVENT_BINS}) GROUP BY 2, 3 UNION ALL SELECT 'user_id', ub, k, count(*) FROM (SELECT *, dense_rank() OVER (ORDER BY event_type) - 1 AS k FROM {EVENT_BINS}) GROUP BY 2, 3)"


@query("x3_contingency", f"SELECT feature, CAST(bin AS INT) AS bin, CAST(cls AS INT) AS cls, n FROM {_CELLS}")
def _(t):
    return risk.contingency(t.events, "event_type", "event_id", ["value", "user_id"])


@query(
    "x4_mutual_info_proxy",
    f"""SELECT feature, round(chi2, 6) AS chi2, round(least(chi2 / (t * 10), 1), 6) AS mutual_info_proxy, round(sqrt(chi2 / (t * 4)), 6) AS cramers_v FROM
       (SELECT feature, max(t) AS t, max(t) * (sum(n * n / (r * c)) - 1) AS chi2 FROM (SELECT feature, n::DOUBLE AS n, sum(n) OVER (PARTITION BY feature, bin)::DOUBLE AS r, sum(n) OVER (PARTITION BY feature, cls)::DOUBLE AS c, sum(n) OVER (PARTITION BY feature) AS t FROM {_CELLS}) GROUP BY 1)""",
)
def _(t):
    table = risk.contingency(t.events, "event_type", "event_id", ["value", "user_id"])
    return rounded(risk.association(table, t.events.count()), 6)


def _half(s: int) -> str:
    return f"(CAST('0x' || substr(md5('{s}:' || CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 2 = 1)"


_HALVES = "[" + ", ".join(_abs_corr("value", "user_id", "events", _half(s)) for s in range(5)) + "]"


@query(
    "x5_correlation_stability",
    f"""WITH r AS (SELECT unnest({_HALVES}) AS r) SELECT 'value' AS feature, round(var_pop(r), 8) AS correlation_variance, round(1 - least(2 * stddev_pop(r), 1), 6) AS correlation_stability FROM r""",
)
def _(t):
    out = risk.correlation_signals(t.events, "user_id", "event_id", ["value"])
    return out.select("feature", F.round("correlation_variance", 8).alias("correlation_variance"), F.round("correlation_stability", 6).alias("correlation_stability"))


@query(
    "x6_lag_signals",
    all_of(
        *[
            f"""SELECT feature, round(cur, 6) AS current_correlation, round(fut, 6) AS future_correlation, round(fut / (cur + 0.001), 5) AS future_correlation_ratio, CAST((fut > cur * 1.1)::INT AS DOUBLE) AS temporal_suspicion FROM
            (SELECT '{c}' AS feature, abs(corr({c}, value)) AS cur, abs(corr({c}, nxt)) AS fut FROM (SELECT *, lead(value) OVER (ORDER BY ts, event_id) AS nxt FROM events))"""
            for c in ("user_id", "event_id")
        ]
    ),
)
def _(t):
    out = risk.lag_signals(t.events, "value", "ts", "event_id", ["user_id", "event_id"])
    return out.select("feature", *[F.round(c, 6).alias(c) for c in ("current_correlation", "future_correlation")], F.round("future_correlation_ratio", 5).alias("future_correlation_ratio"), "temporal_suspicion")


@query("x7_unique_ratio", all_of(*[f"SELECT '{c}' AS feature, round(count(DISTINCT {c}) / count(*), 6) AS unique_ratio, CAST((count(DISTINCT {c}) / count(*) > 0.9)::INT AS DOUBLE) AS high_cardinality_risk FROM events" for c in ("event_id", "user_id")]))
def _(t):
    return rounded(risk.signals(t.events, "value", "event_id").select("feature", "unique_ratio", "high_cardinality_risk"), 6)


@query("x8_missing_pattern", all_of(*[f"SELECT '{c}' AS feature, round({_abs_corr(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END', 'n_chars', LABELLED)}, 6) AS missing_pattern_correlation FROM (SELECT 1)" for c in ("quality", "toxic")]))
def _(t):
    return rounded(risk.correlation_signals(t.labelled, "n_chars", "doc_id", ["quality", "toxic"]).select("feature", "missing_pattern_correlation"), 6)


@query("x9_signal_table", f"""SELECT 'user_id' AS feature, round({_abs_corr('user_id', 'value', 'events')}, 6) AS correlation_abs, round(count(DISTINCT user_id) / count(*), 6) AS unique_ratio, CAST(0 AS DOUBLE) AS missing_pattern_correlation,
    (SELECT round(abs(corr(user_id, nxt)) / (abs(corr(user_id, value)) + 0.001), 5) FROM (SELECT *, lead(value) OVER (ORDER BY ts, event_id) AS nxt FROM events)) AS future_correlation_ratio FROM events
    UNION ALL SELECT 'event_id', round({_abs_corr('event_id', 'value', 'events')}, 6), 1, 0, (SELECT round(abs(corr(event_id, nxt)) / (abs(corr(event_id, value)) + 0.001), 5) FROM (SELECT *, lead(value) OVER (ORDER BY ts, event_id) AS nxt FROM events)) FROM (SELECT 1)""")
def _(t):
    s = risk.signals(t.events, "value", "event_id", "ts")
    return s.select("feature", *[F.round(c, 6).alias(c) for c in ("correlation_abs", "unique_ratio", "missing_pattern_correlation")], F.round("future_correlation_ratio", 5).alias("future_correlation_ratio"))


def leaky_documents(t):
    """Labelled documents with one feature that repeats the target."""
    d = t.documents.join(t.labels, "doc_id").withColumn("echo", F.col("quality") + F.col("n_chars") / 1e9)
    return d.select("doc_id", "n_chars", "toxic", "echo", "quality")


@query("x10_x11_x12_risk_scores")
def _(t):
    return risk.predict_risk(leaky_documents(t), "quality", "doc_id").select("feature", "risk_score", "risk_level", "risk_percentage", "recommendations")


# Scores made from the tables, to check the decision logic on its own.
_SCORED = """(SELECT event_type AS feature, round(abs(corr(value, event_id)) * 20, 6) AS risk_score, max(value) / 400 AS correlation_abs, CAST((max(value) > 360)::INT AS DOUBLE) AS temporal_suspicion,
   CAST((min(value) < 0.02)::INT AS DOUBLE) AS high_cardinality_risk, min(value) * 20 AS correlation_stability FROM events GROUP BY 1)"""


def scored_types(t):
    g = t.events.groupBy(F.col("event_type").alias("feature")).agg(
        F.round(F.abs(F.corr("value", "event_id")) * 20, 6).alias("risk_score"), (F.max("value") / 400).alias("correlation_abs"),
        (F.max("value") > 360).cast("double").alias("temporal_suspicion"), (F.min("value") < 0.02).cast("double").alias("high_cardinality_risk"),
        (F.min("value") * 20).alias("correlation_stability"),
    )
    return g.withColumn("risk_level", risk.risk_level(F.col("risk_score")))


_LEVEL = "CASE WHEN risk_score >= 0.7 THEN 'high' WHEN risk_score >= 0.4 THEN 'medium' ELSE 'low' END"
_A = {k: v.replace("'", "''") for k, v in risk.ADVICE.items()}


@query(
    "x13_recommendations",
    f"""SELECT feature, risk_level, CASE WHEN risk_level = 'low' THEN ['{_A["safe"]}'] WHEN len(p) = 0 THEN ['{_A["review"]}'] ELSE p END AS recommendations FROM
       (SELECT feature, {_LEVEL} AS risk_level, list_filter([CASE WHEN correlation_abs > 0.9 THEN '{_A["target"]}' WHEN correlation_abs > 0.7 THEN '{_A["correlated"]}' END,
         CASE WHEN temporal_suspicion > 0 THEN '{_A["temporal"]}' END, CASE WHEN high_cardinality_risk > 0 THEN '{_A["identifier"]}' END,
         CASE WHEN correlation_stability < 0.5 THEN '{_A["unstable"]}' END], lambda x: x IS NOT NULL) AS p FROM {_SCORED})""",
)
def _(t):
    return risk.advise(scored_types(t)).select("feature", "risk_level", "recommendations")


@query(
    "x14_overall_risk",
    f"""SELECT CASE WHEN count(*) FILTER (WHERE l = 'high') > 0 THEN 'high' WHEN count(*) FILTER (WHERE l = 'medium') > 0 THEN 'medium' ELSE 'low' END AS overall_risk,
       coalesce(list(feature ORDER BY feature) FILTER (WHERE l = 'high'), []) AS high_risk_features, coalesce(list(feature ORDER BY feature) FILTER (WHERE l = 'medium'), []) AS medium_risk_features
       FROM (SELECT feature, {_LEVEL} AS l FROM {_SCORED})""",
)
def _(t):
    return risk.overall_risk(scored_types(t))


@query("n2_network_nodes")
def _(t):
    d = leaky_documents(t)
    return network.nodes(d, "quality", risk.predict_risk(d, "quality", "doc_id"))


# -- splits and the experiment ----------------------------------------------

_HASH = "CAST('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 15) AS BIGINT)"


@query(
    "s7_stratified_split",
    f"""SELECT o_orderstatus, CASE WHEN rn <= round(0.2 * n) THEN 'test' ELSE 'train' END AS side, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM
       (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_HASH.format(k="o_orderkey")}) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) GROUP BY 1, 2""",
)
def _(t):
    return stratified_split(t.orders, "o_orderstatus", "o_orderkey").groupBy("o_orderstatus", "side").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(
    "s7_stratified_split_many_classes",
    f"""SELECT c, CASE WHEN rn <= round(0.2 * n) THEN 'test' ELSE 'train' END AS side, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM
       (SELECT *, row_number() OVER (PARTITION BY c ORDER BY {_HASH.format(k="o_orderkey")}) AS rn, count(*) OVER (PARTITION BY c) AS n FROM
        (SELECT o_orderkey, o_custkey % 5000 AS c FROM orders)) GROUP BY 1, 2""",
)
def _(t):
    df = t.orders.withColumn("c", F.col("o_custkey") % 5000)
    return stratified_split(df, "c", "o_orderkey").groupBy("c", "side").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(
    "i5_stratified_folds",
    f"""SELECT o_orderstatus, CAST((rn > round(0.2 * n))::INT + (rn > round(0.4 * n))::INT + (rn > round(0.6 * n))::INT + (rn > round(0.8 * n))::INT AS INT) AS fold, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM
       (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_HASH.format(k="o_orderkey")}) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) GROUP BY 1, 2""",
)
def _(t):
    return stratified_folds(t.orders, "o_orderstatus", "o_orderkey").groupBy("o_orderstatus", "fold").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def predicted_orders(t):
    """A hand-made classifier of order status, as input for the metrics."""
    return t.orders.select(
        (F.col("o_orderstatus") == "F").cast("int").alias("label"), (F.col("o_totalprice") > 250000).cast("int").alias("prediction"), F.round(F.col("o_totalprice") / 1000).alias("score")
    )


_PRED = "(SELECT (o_orderstatus = 'F')::INT AS label, (o_totalprice > 250000)::INT AS prediction, round(o_totalprice / 1000) AS score FROM orders)"


@query(
    "i3_classification_metrics",
    f"""SELECT round(count(*) FILTER (WHERE label = prediction) / count(*), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM {_PRED},
       (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn FROM {_PRED}) GROUP BY tp, fp, fn""",
)
def _(t):
    return rounded(impact.classification_metrics(predicted_orders(t)), 6)


@query(
    "i4_roc_auc",
    f"""SELECT round((sum(r) FILTER (WHERE label = 1) - p * (p + 1) / 2) / (p * q), 6) AS roc_auc FROM
       (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM {_PRED}),
       (SELECT sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS q FROM {_PRED}) GROUP BY p, q""",
)
def _(t):
    return rounded(impact.roc_auc(predicted_orders(t)), 6)


_METRIC_ROWS = """(SELECT CASE WHEN o_orderstatus = 'F' THEN 'before' ELSE 'after' END AS stage, avg((o_totalprice > 200000)::INT) AS accuracy, avg((o_totalprice > 150000)::INT) AS cv_accuracy_mean,
   stddev_pop(o_totalprice / 1000000) AS cv_accuracy_std FROM orders GROUP BY 1)"""


@query(
    "i6_i7_impact_comparison",
    f"""SELECT *, CASE verdict WHEN 'significant' THEN ['Remove identified leaky features', 'Review feature engineering pipeline', 'Audit data collection process']
       WHEN 'moderate' THEN ['Review suspicious features', 'Monitor model performance in production', 'Consider partial removal'] ELSE ['Features appear clean', 'Maintain monitoring', 'Document findings'] END AS advice FROM
       (SELECT round(d, 6) AS accuracy_drop, round(gb, 6) AS generalization_gap_before, round(ga, 6) AS generalization_gap_after, round(st, 6) AS stability_improvement,
       CASE WHEN d > 0.1 THEN 'significant' WHEN d > 0.02 THEN 'moderate' ELSE 'minimal' END AS verdict FROM (SELECT
       b.accuracy - a.accuracy AS d, b.cv_accuracy_mean - b.accuracy AS gb, a.cv_accuracy_mean - a.accuracy AS ga, (b.cv_accuracy_std - a.cv_accuracy_std) / greatest(b.cv_accuracy_std, 0.001) AS st
       FROM (SELECT * FROM {_METRIC_ROWS} WHERE stage = 'before') b, (SELECT * FROM {_METRIC_ROWS} WHERE stage = 'after') a))""",
)
def _(t):
    over = lambda v: F.avg((F.col("o_totalprice") > v).cast("int"))
    m = t.orders.groupBy(F.when(F.col("o_orderstatus") == "F", "before").otherwise("after").alias("stage")).agg(
        over(200000).alias("accuracy"), over(150000).alias("cv_accuracy_mean"), F.stddev_pop(F.col("o_totalprice") / 1000000).alias("cv_accuracy_std")
    )
    return rounded(impact.compare(m), 6)


@query("i1_i2_impact_experiment")
def _(t):
    metrics, removed = impact.run_experiment(leaky_documents(t), "quality", "doc_id", kind="logistic", folds=3)
    listed = removed.agg(F.array_sort(F.collect_list("feature")).alias("removed"))
    return impact.compare(metrics).select("*", listed.scalar().alias("removed"))
