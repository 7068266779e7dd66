"""Profiles, histograms, correlations, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwarden.operators import profile, rank_correlation
from tabwarden.queries.quality import LABELLED, all_of
from tabwarden.queries.registry import query

LINE_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_ALL = [*LINE_NUM, "l_returnflag", "l_linestatus", "l_shipdate"]
FAMILY = {"l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "datetime", "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float"}


@query(
    "e1_e2_table_header",
    f"""SELECT count(*) AS rows, CAST(7 AS BIGINT) AS columns, CAST(4 AS BIGINT) AS int_columns, CAST(0 AS BIGINT) AS float_columns, CAST(3 AS BIGINT) AS string_columns,
       CAST(0 AS BIGINT) AS bool_columns, CAST(0 AS BIGINT) AS datetime_columns, 2 * count(*) - count(quality) - count(toxic) AS total_missing,
       CAST(sum(strlen(text) + strlen(lang) + strlen(source) + 8 + 8 + 4 + 4) AS BIGINT) AS logical_bytes FROM {LABELLED}""",
)
def _(t):
    return profile.table_header(t.labelled)


@query(
    "e3_duplicate_rows",
    """SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, CAST(sum(n) AS BIGINT) AS total_rows, round(sum(n - 1) / sum(n), 6) AS duplicate_pct
       FROM (SELECT l_quantity, l_discount, l_tax, l_returnflag, l_shipdate, count(*) AS n FROM lineitem GROUP BY ALL)""",
)
def _(t):
    df = t.lineitem.select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    return profile.duplicate_rows(df).withColumn("duplicate_pct", F.round("duplicate_pct", 6))


@query(
    "e3_duplicate_documents",
    """SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, CAST(sum(n) AS BIGINT) AS total_rows
       FROM (SELECT text, lang, count(*) AS n FROM documents GROUP BY ALL)""",
)
def _(t):
    return profile.duplicate_rows(t.documents, ["text", "lang"]).select("duplicate_rows", "total_rows")


@query(
    "e4_column_base",
    all_of(
        *[
            f"""SELECT '{c}' AS "column", '{FAMILY.get(c, "int")}' AS type, count({c}) AS count, count(*) - count({c}) AS missing_count,
               CAST(0 AS DOUBLE) AS missing_pct, count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) / count(*), 6) AS unique_pct FROM lineitem"""
            for c in LINE_ALL
        ]
    ),
)
def _(t):
    return profile.column_base(t.lineitem).withColumn("unique_pct", F.round("unique_pct", 6))


@query(
    "e4_column_base_text",
    all_of(
        *[
            f"""SELECT '{c}' AS "column", count({c}) AS count, round((count(*) - count({c})) / count(*), 6) AS missing_pct, count(DISTINCT {c}) AS unique_count FROM {LABELLED}"""
            for c in ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")
        ]
    ),
)
def _(t):
    return profile.column_base(t.labelled).select("column", "count", F.round("missing_pct", 6).alias("missing_pct"), "unique_count")


def _num(c: str, src: str) -> str:
    q1, q3 = f"quantile_cont({c}, 0.25)", f"quantile_cont({c}, 0.75)"
    return f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
      CAST(min({c}) AS DOUBLE) AS min, round({q1}, 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round({q3}, 4) AS p75, CAST(max({c}) AS DOUBLE) AS max,
      round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis,
      (SELECT count(*) FROM {src}, (SELECT {q1} AS a, {q3} AS b FROM {src}) WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outliers_count FROM {src}"""


def rounded(df, digits=4, skip=()):
    return df.select(*[F.round(c, digits).alias(c) if d == "double" and c not in skip else F.col(c) for c, d in df.dtypes])


@query("e5_e6_e7_e8_numeric_profile", all_of(*[_num(c, "lineitem") for c in LINE_NUM]))
def _(t):
    return rounded(profile.numeric_profile(t.lineitem))


@query("e5_e6_e7_e8_numeric_profile_events", _num("value", "events"))
def _(t):
    return rounded(profile.numeric_profile(t.events, ["value"]))


def _hist(c: str, src: str) -> str:
    return f"""SELECT '{c}' AS feature, CAST(b.bin AS INT) AS bin, round(lo + b.bin * ((hi - lo) / 20), 6) AS low, round(CASE WHEN b.bin = 19 THEN hi ELSE lo + (b.bin + 1) * ((hi - lo) / 20) END, 6) AS high, coalesce(n, 0) AS n
      FROM (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM {src}), range(0, 20) b(bin)
      LEFT JOIN (SELECT len(list_filter(range(1, 20), lambda i: {c} >= lo + i * ((hi - lo) / 20))) AS bin, count(*) AS n
        FROM {src}, (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM {src}) WHERE {c} IS NOT NULL GROUP BY 1) h ON h.bin = b.bin"""


@query("e9_histogram", all_of(*[_hist(c, "lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")]))
def _(t):
    return rounded(profile.numeric_histogram(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]), 6)


_VC = """(SELECT 'source' AS feature, source AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY 2
   UNION ALL SELECT 'text', text, count(*) FROM documents GROUP BY 2)"""


@query("e10_top_values", f"SELECT * FROM (SELECT feature, md5(value) AS value, n, CAST(row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS INT) AS rank FROM {_VC}) WHERE rank <= 10")
def _(t):
    return profile.top_values(t.documents).withColumn("value", F.md5("value"))


@query("e11_category_balance", f"SELECT feature, count(*) AS categories, max(n) AS largest, min(n) AS smallest, round(max(n) / min(n), 6) AS imbalance_ratio FROM {_VC} GROUP BY 1")
def _(t):
    return profile.category_balance(t.documents).withColumn("imbalance_ratio", F.round("imbalance_ratio", 6))


@query("e12_category_histogram", f"SELECT feature, list(value ORDER BY n DESC, value) AS labels, list(n ORDER BY n DESC, value) AS counts FROM {_VC} WHERE feature <> 'text' GROUP BY 1")
def _(t):
    return profile.category_histogram(t.documents, ["lang", "source"], 20)


def _pairs(names, fn, src):
    return all_of(*[f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round({fn(a, b)}, 6) AS value FROM {src}" for i, a in enumerate(names) for b in names[i + 1 :]])


@query("e13_pearson_matrix", _pairs(LINE_NUM, lambda a, b: f"corr({a}, {b})", "lineitem"))
def _(t):
    return rounded(profile.correlation_pairs(t.lineitem), 6)


@query("e13_pearson_with_nulls", _pairs(["doc_id", "n_chars", "quality", "toxic"], lambda a, b: f"corr({a}, {b})", LABELLED))
def _(t):
    return rounded(profile.correlation_pairs(t.labelled), 6)


def _spearman(a: str, b: str, src: str) -> str:
    avg_rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"
    return f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr(x, y), 6) AS value FROM (SELECT {avg_rank(a)} AS x, {avg_rank(b)} AS y FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


_RANKED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("e14_spearman", all_of(*[_spearman(a, b, "lineitem") for i, a in enumerate(_RANKED) for b in _RANKED[i + 1 :]]))
def _(t):
    return rounded(rank_correlation.correlation_matrix(t.lineitem, "spearman", _RANKED), 6)


@query("e14_spearman_with_nulls", all_of(_spearman("n_chars", "quality", LABELLED), _spearman("n_chars", "toxic", LABELLED), _spearman("quality", "toxic", LABELLED)))
def _(t):
    return rounded(rank_correlation.correlation_matrix(t.labelled, "spearman", ["n_chars", "quality", "toxic"]), 6)


_KENDALL = """WITH g AS (SELECT {a} AS x, {b} AS y, count(*) AS n FROM {src} GROUP BY ALL),
  pq AS (SELECT sum(CASE WHEN (p.x - q.x) * (p.y - q.y) > 0 THEN p.n * q.n ELSE 0 END) AS c, sum(CASE WHEN (p.x - q.x) * (p.y - q.y) < 0 THEN p.n * q.n ELSE 0 END) AS d FROM g p JOIN g q ON p.x < q.x),
  t AS (SELECT (SELECT sum(n) * (sum(n) - 1) / 2 FROM g) AS n0, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM g GROUP BY x)) AS n1, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM g GROUP BY y)) AS n2)
  SELECT '{a}' AS feature_a, '{b}' AS feature_b, round((c - d) / (sqrt(n0 - n1) * sqrt(n0 - n2)), 6) AS value FROM pq, t"""


@query("e14_kendall", all_of("(" + _KENDALL.format(a="l_quantity", b="l_discount", src="lineitem") + ")", "(" + _KENDALL.format(a="l_quantity", b="l_tax", src="lineitem") + ")", "(" + _KENDALL.format(a="l_discount", b="l_tax", src="lineitem") + ")"))
def _(t):
    return rounded(rank_correlation.correlation_matrix(t.lineitem, "kendall", ["l_quantity", "l_discount", "l_tax"]), 6)


@query(
    "e15_missing_stats",
    all_of(*[f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count, round((count(*) - count({c})) / count(*), 4) AS missing_ratio FROM {LABELLED}""" for c in ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")]),
)
def _(t):
    from tabwarden.operators.completeness import missing_summary

    return missing_summary(t.labelled).select("column", "missing_count", "missing_ratio")


@query(
    "e16_missing_matrix",
    f"""WITH s AS (SELECT * FROM {LABELLED} ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 250)
       SELECT 'quality' AS "column", list(quality IS NULL ORDER BY doc_id) AS mask FROM s UNION ALL SELECT 'toxic', list(toxic IS NULL ORDER BY doc_id) FROM s
       UNION ALL SELECT 'lang', list(lang IS NULL ORDER BY doc_id) FROM s""",
)
def _(t):
    return profile.missing_matrix(t.labelled.select("doc_id", "lang", "quality", "toxic"), "doc_id", 250)


@query("e17_class_balance", f"""SELECT CAST(quality AS VARCHAR) AS class, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM {LABELLED} WHERE quality IS NOT NULL GROUP BY 1""")
def _(t):
    return rounded(profile.class_balance(t.labelled, "quality"), 6)


@query(
    "e18_health_score",
    f"""WITH d AS (SELECT sum(n - 1) / sum(n) AS dup FROM (SELECT lang, source, quality, toxic, count(*) AS n FROM {LABELLED} GROUP BY ALL)),
       m AS (SELECT ((count(*) - count(quality)) + (count(*) - count(toxic))) / count(*) / 4 AS miss FROM {LABELLED})
       SELECT round(dup, 6) AS duplicate_pct, round(miss, 6) AS avg_missing_pct, round(greatest(0.0, least(100.0, 100 - 100 * dup - 50 * miss)), 4) AS health_score FROM d, m""",
)
def _(t):
    df = profile.health_score(t.labelled.select("lang", "source", "quality", "toxic"))
    return df.select(F.round("duplicate_pct", 6).alias("duplicate_pct"), F.round("avg_missing_pct", 6).alias("avg_missing_pct"), F.round("health_score", 4).alias("health_score"))


@query(
    "e19_findings",
    f"""WITH b AS (SELECT count(*) AS n, count(quality) AS q, count(toxic) AS x, count(DISTINCT text) AS d FROM {LABELLED}),
        p AS (SELECT sum(k - 1) / sum(k) AS dup FROM (SELECT text, lang, quality, toxic, count(*) AS k FROM {LABELLED} GROUP BY ALL))
       SELECT 'quality' AS "column", 'missing' AS risk, round((n - q) / n, 6) AS value, 'Column ''quality'' has over 30% missing values.' AS message, 'Evaluate if ''quality'' can be imputed or if it should be dropped.' AS recommendation FROM b WHERE (n - q) / n > 0.3
       UNION ALL SELECT 'toxic', 'missing', round((n - x) / n, 6), 'Column ''toxic'' has over 30% missing values.', 'Evaluate if ''toxic'' can be imputed or if it should be dropped.' FROM b WHERE (n - x) / n > 0.3
       UNION ALL SELECT 'text', 'identifier', round(d / n, 6), 'Column ''text'' appears to be a unique ID/hash (95%+ unique).', NULL FROM b WHERE d / n > 0.95 AND d > 50
       UNION ALL SELECT NULL, 'duplication', round(dup, 6), printf('High duplication detected: %.1f%%', dup * 100), 'Consider dropping exact duplicates.' FROM p WHERE dup > 0.05""",
)
def _(t):
    return rounded(profile.findings(t.labelled.select("text", "lang", "quality", "toxic")), 6)


@query(
    "e20_summary",
    all_of(
        *[
            f"""SELECT "column", metric, round(value, 4) AS value FROM (UNPIVOT (SELECT '{c}' AS "column", CAST(count({c}) AS DOUBLE) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min,
              CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS p25, CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS p50, CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM orders)
              ON COLUMNS(* EXCLUDE "column") INTO NAME metric VALUE value)"""
            for c in ("o_orderkey", "o_custkey", "o_totalprice")
        ],
        *[f"""SELECT '{c}', 'unique', CAST(count(DISTINCT {c}) AS DOUBLE) FROM orders""" for c in ("o_orderstatus", "o_orderpriority")],
    ),
)
def _(t):
    return rounded(profile.summary(t.orders))


_TARGET_ABS = [c for c in LINE_NUM if c != "l_extendedprice"]


@query("e21_target_correlation_ranking", all_of(*[f"SELECT '{c}' AS feature, round(abs(corr({c}, l_extendedprice)), 4) AS correlation FROM lineitem" for c in _TARGET_ABS]))
def _(t):
    return profile.target_correlations(t.lineitem, "l_extendedprice")


@query("e21_point_biserial_ranking", all_of(*[f"SELECT '{c}' AS feature, round(abs(corr({c}, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)), 4) AS correlation FROM lineitem" for c in LINE_NUM]))
def _(t):
    return profile.target_correlations(t.lineitem, "l_linestatus")


@query(
    "e_full_profile",
    f"""SELECT 'value' AS "column", count(value) AS count, count(DISTINCT value) AS unique_count, round(avg(value), 4) AS mean, CAST(20 AS INT) AS bins, CAST(NULL AS INT) AS tops, CAST(NULL AS DOUBLE) AS imbalance FROM events
       UNION ALL SELECT 'event_type', count(event_type), count(DISTINCT event_type), NULL, NULL, CAST(5 AS INT), (SELECT round(max(n) / min(n), 6) FROM (SELECT count(*) AS n FROM events GROUP BY event_type)) FROM events
       UNION ALL SELECT 'ts', count(ts), count(DISTINCT ts), NULL, NULL, NULL, NULL FROM events""",
)
def _(t):
    p = profile.full_profile(t.events.select("value", "event_type", "ts"))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return p.select("column", "count", "unique_count", F.round("mean", 4).alias("mean"), size("histogram").alias("bins"), size("top_values").alias("tops"), F.round("imbalance_ratio", 6).alias("imbalance"))


_INF = "(SELECT event_id, CASE WHEN event_id % 1000 = 7 THEN 'Infinity'::DOUBLE WHEN event_id % 1000 = 8 THEN 'NaN'::DOUBLE ELSE value END AS v, user_id AS w FROM events)"


def _with_infinity(t):
    v = F.when(F.col("event_id") % 1000 == 7, F.lit(float("inf"))).when(F.col("event_id") % 1000 == 8, F.lit(float("nan"))).otherwise(F.col("value"))
    return t.events.select("event_id", v.alias("v"), F.col("user_id").cast("double").alias("w"))


@query(
    "e13_pearson_with_infinity",
    "SELECT 'event_id' AS feature_a, 'w' AS feature_b, round(corr(event_id, user_id), 6) AS value FROM events UNION ALL SELECT 'event_id', 'v', NULL UNION ALL SELECT 'v', 'w', NULL",
)
def _(t):
    return profile.correlation_pairs(_with_infinity(t), ["event_id", "v", "w"], fill=None).withColumn("value", F.round("value", 6))


@query(
    "e9_histogram_with_infinity",
    f"""SELECT 'v' AS feature, CAST(g.bin AS INT) AS bin, coalesce(n, 0) AS n FROM range(0, 10) g(bin) LEFT JOIN
       (SELECT len(list_filter(range(1, 10), lambda i: v >= lo + i * ((hi - lo) / 10))) AS bin, count(*) AS n FROM (SELECT v FROM {_INF} WHERE isfinite(v)),
        (SELECT min(v) AS lo, max(v) AS hi FROM {_INF} WHERE isfinite(v)) GROUP BY 1) h ON h.bin = g.bin""",
)
def _(t):
    return profile.numeric_histogram(_with_infinity(t), ["v"], bins=10).select("feature", "bin", "n")
