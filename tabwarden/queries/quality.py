"""Contract, completeness, consistency, accuracy, timeliness, rules, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.functions.types import as_timestamp, clean
from tabwarden.operators import accuracy, completeness, consistency, contract, rules, timeliness
from tabwarden.operators.consistency import ConsistencyRule
from tabwarden.operators.rules import Rule
from tabwarden.plans import checks, engine, rollup
from tabwarden.queries.registry import query

LABELLED = "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def brief(results: DataFrame) -> DataFrame:
    """Comparable columns of CHECK_RESULTS."""
    return results.select("check", F.coalesce("column", F.lit("")).alias("column"), "severity", "status", "violations", "total")


def expect(check: str, column: str, severity: str, violations: str, source: str, total: str = "count(*)") -> str:
    """Oracle for one check row."""
    bad = {"info": "passed", "warning": "warning"}.get(severity, "failed")
    return f"""SELECT "check", "column", severity, CASE WHEN violations > 0 THEN '{bad}' ELSE 'passed' END AS status,
      violations, total FROM (SELECT '{check}' AS "check", '{column}' AS "column", '{severity}' AS severity,
      CAST({violations} AS BIGINT) AS violations, CAST({total} AS BIGINT) AS total FROM {source})"""


def all_of(*parts: str) -> str:
    return "\nUNION ALL\n".join(parts)


def n_if(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


# -- predicates -------------------------------------------------------------


@query(
    "p1_p2_columns_by_family",
    """SELECT 'l_discount' AS "column", 'float' AS family, count(l_discount) AS non_null FROM lineitem UNION ALL
       SELECT 'l_extendedprice', 'float', count(l_extendedprice) FROM lineitem UNION ALL
       SELECT 'l_linenumber', 'int', count(l_linenumber) FROM lineitem UNION ALL
       SELECT 'l_orderkey', 'int', count(l_orderkey) FROM lineitem UNION ALL
       SELECT 'l_partkey', 'int', count(l_partkey) FROM lineitem UNION ALL
       SELECT 'l_quantity', 'float', count(l_quantity) FROM lineitem UNION ALL
       SELECT 'l_suppkey', 'int', count(l_suppkey) FROM lineitem""",
)
def _(t):
    """Numeric columns shared by two sides, without an excluded one and the target."""
    from tabwarden.functions.types import common_columns, families

    df = t.lineitem
    fams = families(df)
    names = [c for c in common_columns(df, t.lineitem, exclude=["l_tax"], target="l_returnflag") if fams[c] in ("int", "float")]
    aggs = [F.count(clean(df, c)).alias(f"n{i}") for i, c in enumerate(names)]
    rows = [F.struct(F.lit(c).alias("column"), F.lit(fams[c]).alias("family"), F.col(f"n{i}").alias("non_null")) for i, c in enumerate(names)]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


@query(
    "p3_requested_columns",
    f"""SELECT 'unknown_column' AS "check", 'no_such_column' AS "column", 'warning' AS status, CAST(1 AS BIGINT) AS violations UNION ALL
       SELECT 'missing', 'quality', 'failed', {n_if("quality IS NULL")} FROM {LABELLED} UNION ALL
       SELECT 'all_missing', 'quality', 'passed', 0 UNION ALL
       SELECT 'empty_rows', '', 'failed', {n_if("quality IS NULL")} FROM {LABELLED} UNION ALL
       SELECT 'min_valid_rows', '', 'passed', 0""",
)
def _(t):
    df = t.labelled
    got = checks.run(df, completeness.completeness_checks(df, columns=["quality", "no_such_column"]))
    return brief(got).select("check", "column", "status", "violations")


@query(
    "p4_null_predicate",
    f"""SELECT lang, {n_if("quality IS NULL")} AS missing, {n_if("quality IS NOT NULL")} AS present FROM {LABELLED} GROUP BY lang""",
)
def _(t):
    df = t.labelled
    q = clean(df, "quality")
    return df.groupBy("lang").agg(F.count_if(q.isNull()).alias("missing"), F.count_if(q.isNotNull()).alias("present"))


@query(
    "p5_fill_zero",
    f"""SELECT source, round(avg(coalesce(quality, 0)), 6) AS mean_quality FROM {LABELLED} GROUP BY source""",
)
def _(t):
    df = t.labelled
    return df.groupBy("source").agg(F.round(F.avg(F.coalesce(clean(df, "quality"), F.lit(0))), 6).alias("mean_quality"))


@query(
    "p6_factorize",
    """WITH c AS (SELECT DISTINCT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events)
       SELECT code, event_type, count(*) AS n FROM events JOIN c USING (event_type) GROUP BY ALL""",
)
def _(t):
    from tabwarden.functions.labels import label_codes

    return label_codes(t.events, "event_type", "code").groupBy("code", "event_type").agg(F.count("*").alias("n"))


@query(
    "p7_parse_timestamps",
    """SELECT count(*) AS total, count(TRY_CAST(x AS TIMESTAMP)) AS parsed, min(TRY_CAST(x AS TIMESTAMP)) AS earliest
       FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS x FROM orders)""",
)
def _(t):
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    df = t.orders.select(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(text).alias("x"))
    ts = as_timestamp(df, "x")
    return df.agg(F.count(F.lit(1)).alias("total"), F.count(ts).alias("parsed"), F.min(ts).alias("earliest"))


@query(
    "p8_detect_time_column",
    """SELECT 'events' AS "table", 'ts' AS time_column, count(ts) AS rows_analyzed FROM events UNION ALL
       SELECT 'orders', 'o_orderdate', count(o_orderdate) FROM orders UNION ALL
       SELECT 'customer', '', count(*) FROM customer""",
)
def _(t):
    from functools import reduce

    from tabwarden.functions.types import detect_time_column

    parts = []
    for name in ("events", "orders", "customer"):
        df = getattr(t, name)
        c = detect_time_column(df)
        counted = F.count(as_timestamp(df, c)) if c else F.count(F.lit(1))
        parts.append(df.agg(counted.alias("rows_analyzed")).select(F.lit(name).alias("table"), F.lit(c or "").alias("time_column"), "rows_analyzed"))
    return reduce(DataFrame.unionByName, parts)


@query(
    "p9_size_guards",
    """SELECT 'nation' AS "table", count(*) AS n, 'passed' AS status FROM nation UNION ALL
       SELECT 'embeddings', count(*), 'passed' FROM embeddings UNION ALL
       SELECT 'region_empty', count(*), 'warning' FROM region WHERE r_name IS NULL""",
)
def _(t):
    from functools import reduce

    parts = []
    for name, df in (("nation", t.nation), ("embeddings", t.embeddings), ("region_empty", t.region.where("r_name IS NULL"))):
        parts.append(engine.size_guards(df).select(F.lit(name).alias("table"), "n", "status"))
    return reduce(DataFrame.unionByName, parts)


# -- contract ---------------------------------------------------------------

ORDERS_CONTRACT = {
    "columns": [
        {"name": "o_orderkey", "dtype": "int", "nullable": False, "unique": True},
        {"name": "o_orderstatus", "dtype": "string", "allowed_values": ["O", "F"]},
        {"name": "o_custkey", "dtype": "string", "unique": True},
        {"name": "o_totalprice", "dtype": "numeric", "min_value": 2000, "max_value": 400000},
        {"name": "o_orderpriority", "dtype": "string", "pattern": r"\d-(URGENT|HIGH|LOW)"},
        {"name": "o_clerk", "dtype": "string"},
    ],
    "strict_column_order": True,
    "min_rows": 1000000,
    "max_rows": 100,
}


@query(
    "q1_infer_contract",
    all_of(
        *[
            f"""SELECT '{c}' AS "column", CAST({i} AS INT) AS position, '{f}' AS dtype, count(*) > count({c}) AS nullable, count(DISTINCT {c}) = count({c}) AS "unique" FROM {LABELLED}"""
            for i, (c, f) in enumerate(
                [("doc_id", "int"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "int"), ("quality", "int"), ("toxic", "int")]
            )
        ]
    ),
)
def _(t):
    return contract.infer_contract(t.labelled)


_DUP = "(SELECT coalesce(sum(n) FILTER (WHERE n > 1), 0) AS bad, sum(n) AS total FROM (SELECT {c}, count(*) AS n FROM {t} GROUP BY 1))"


@query(
    "q2_q3_q4_q5_q6_contract_shape",
    all_of(
        expect("min_rows", "", "error", "CASE WHEN count(*) < 1000000 THEN 1 ELSE 0 END", "orders", "1"),
        expect("max_rows", "", "error", "CASE WHEN count(*) > 100 THEN 1 ELSE 0 END", "orders", "1"),
        expect("missing_columns", "", "error", "1", "(SELECT 1)", "1"),
        expect("unexpected_columns", "", "warning", "1", "(SELECT 1)", "1"),
        expect("column_order", "", "warning", "1", "(SELECT 1)", "1"),
        expect("type", "o_orderkey", "error", "0", "(SELECT 1)", "1"),
        expect("type", "o_orderstatus", "error", "0", "(SELECT 1)", "1"),
        expect("type", "o_custkey", "error", "1", "(SELECT 1)", "1"),
        expect("type", "o_totalprice", "error", "0", "(SELECT 1)", "1"),
        expect("type", "o_orderpriority", "error", "0", "(SELECT 1)", "1"),
    ),
)
def _(t):
    shape = ["min_rows", "max_rows", "missing_columns", "unexpected_columns", "column_order", "type"]
    cs = [c for c in contract.contract_checks(t.orders, ORDERS_CONTRACT) if c.check in shape]
    return brief(checks.run(t.orders, cs))


@query(
    "q7_q8_q9_q10_q11_q12_contract_values",
    all_of(
        expect("not_null", "o_orderkey", "error", n_if("o_orderkey IS NULL"), "orders"),
        expect("unique", "o_orderkey", "error", "bad", _DUP.format(c="o_orderkey", t="orders"), "total"),
        expect("unique", "o_custkey", "error", "bad", _DUP.format(c="o_custkey", t="orders"), "total"),
        expect("allowed_values", "o_orderstatus", "error", n_if("o_orderstatus NOT IN ('O','F')"), "orders"),
        expect("min_value", "o_totalprice", "error", n_if("o_totalprice < 2000"), "orders"),
        expect("max_value", "o_totalprice", "error", n_if("o_totalprice > 400000"), "orders"),
        expect("pattern", "o_orderpriority", "error", n_if("NOT regexp_matches(o_orderpriority, '^(\\d-(URGENT|HIGH|LOW))')"), "orders"),
    ),
)
def _(t):
    shape = ["min_rows", "max_rows", "missing_columns", "unexpected_columns", "column_order", "type"]
    cs = [c for c in contract.contract_checks(t.orders, ORDERS_CONTRACT) if c.check not in shape]
    return brief(checks.run(t.orders, cs))


@query(
    "q9_q10_actual_bounds",
    """SELECT 'l_quantity' AS "column", min(l_quantity) AS actual_min, max(l_quantity) AS actual_max FROM lineitem UNION ALL
       SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice) FROM lineitem""",
)
def _(t):
    return contract.actual_bounds(t.lineitem, ["l_quantity", "l_extendedprice"])


@query(
    "q11_invalid_value_sample",
    """SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT','5-LOW')
       GROUP BY 1 ORDER BY n DESC, value LIMIT 10""",
)
def _(t):
    return contract.invalid_values(t.orders, "o_orderpriority", allowed=["1-URGENT", "5-LOW"])


@query(
    "q12_invalid_pattern_sample",
    """SELECT p_name AS value, count(*) AS n FROM part WHERE NOT regexp_matches(p_name, '^((small|large) \\w+$)')
       GROUP BY 1 ORDER BY n DESC, value LIMIT 10""",
)
def _(t):
    return contract.invalid_values(t.part, "p_name", pattern=r"(small|large) \w+$")


@query(
    "q13_violating_rows",
    """SELECT 'min_value' AS "check", o_orderkey, CAST(o_totalprice AS VARCHAR) AS value FROM
         (SELECT * FROM orders WHERE o_totalprice < 2000 ORDER BY o_orderkey LIMIT 10)
       UNION ALL SELECT 'allowed_values', o_orderkey, o_orderstatus FROM
         (SELECT * FROM orders WHERE o_orderstatus NOT IN ('O','F') ORDER BY o_orderkey LIMIT 10)
       UNION ALL SELECT 'pattern', o_orderkey, o_orderpriority FROM
         (SELECT * FROM orders WHERE NOT regexp_matches(o_orderpriority, '^(\\d-(URGENT|HIGH|LOW))') ORDER BY o_orderkey LIMIT 10)""",
)
def _(t):
    keep = ("min_value", "allowed_values", "pattern")
    cs = [c for c in contract.contract_checks(t.orders, ORDERS_CONTRACT) if c.check in keep]
    return checks.violating_rows(t.orders, cs, ["o_orderkey"], 10)


# -- completeness -----------------------------------------------------------


@query(
    "c1_column_missing",
    all_of(
        *[
            f"""SELECT '{c}' AS "column", '{f}' AS dtype, {n_if(m)} AS missing_count, {n_if(c + " IS NULL")} AS standard_nulls,
               {n_if(m)} - {n_if(c + " IS NULL")} AS additional_missing, count(*) AS total_count,
               round({n_if(m)} / count(*), 4) AS missing_ratio, round(1 - {n_if(m)} / count(*), 4) AS completeness FROM {LABELLED}"""
            for c, f, m in [
                ("doc_id", "int", "doc_id IS NULL"),
                ("text", "string", "text IS NULL OR NOT regexp_matches(text, '\\S')"),
                ("lang", "string", "lang IS NULL OR lang IN ('en','fr') OR NOT regexp_matches(lang, '\\S')"),
                ("source", "string", "source IS NULL OR NOT regexp_matches(source, '\\S')"),
                ("n_chars", "int", "n_chars IS NULL"),
                ("quality", "int", "quality IS NULL"),
                ("toxic", "int", "toxic IS NULL"),
            ]
        ]
    ),
)
def _(t):
    return completeness.column_missing(t.labelled, sentinels=["en", "fr"])


@query(
    "c2_c3_c6_completeness_checks",
    all_of(
        f"""SELECT 'missing' AS "check", 'quality' AS "column", 'error' AS severity, 'failed' AS status, {n_if("quality IS NULL")} AS violations, count(*) AS total FROM {LABELLED}""",
        f"""SELECT 'missing', 'lang', 'warning', 'passed', 0, count(*) FROM {LABELLED}""",
        f"""SELECT 'missing', 'toxic', 'error', 'passed', 0, count(*) FROM {LABELLED}""",
        *[f"""SELECT 'all_missing', '{c}', 'critical', 'passed', 0, count(*) FROM {LABELLED}""" for c in ("lang", "quality", "toxic")],
        f"""SELECT 'empty_rows', '', 'error', 'passed', 0, count(*) FROM {LABELLED}""",
        "SELECT 'min_valid_rows', '', 'critical', 'passed', 0, 1",
    ),
)
def _(t):
    df = t.labelled
    return brief(checks.run(df, completeness.completeness_checks(df, columns=["lang", "quality", "toxic"], column_thresholds={"toxic": 0.9})))


@query(
    "c4_overall_completeness",
    f"""SELECT 2 * count(*) AS total_cells, 2 * count(*) - count(quality) - count(toxic) AS total_missing,
       round(1 - (2 * count(*) - count(quality) - count(toxic)) / (2 * count(*)), 4) AS overall_completeness FROM {LABELLED}""",
)
def _(t):
    return completeness.overall_completeness(t.labelled, ["quality", "toxic"])


@query(
    "c5_row_completeness",
    f"""WITH m AS (SELECT (quality IS NULL)::INT + (toxic IS NULL)::INT + (lang IS NULL)::INT AS m FROM {LABELLED})
       SELECT count(*) AS total_rows, {n_if("m = 3")} AS rows_with_all_missing, {n_if("m > 0")} AS rows_with_any_missing,
       {n_if("m = 0")} AS rows_complete, round(avg(m), 2) AS avg_missing_per_row FROM m""",
)
def _(t):
    return completeness.row_completeness(t.labelled, ["quality", "toxic", "lang"])


@query(
    "c7_co_missing_pairs",
    f"""SELECT 'quality' AS column_a, 'toxic' AS column_b, {n_if("quality IS NULL AND toxic IS NULL")} AS both_missing,
       {n_if("quality IS NULL OR toxic IS NULL")} AS either_missing,
       round({n_if("quality IS NULL AND toxic IS NULL")} / {n_if("quality IS NULL OR toxic IS NULL")}, 4) AS jaccard FROM {LABELLED}""",
)
def _(t):
    return completeness.co_missing_pairs(t.labelled)


@query(
    "c8_missing_summary",
    all_of(
        *[
            f"""SELECT '{c}' AS "column", '{f}' AS dtype, count(*) - count({c}) AS missing_count, count(*) AS total_count,
               round((count(*) - count({c})) / count(*), 4) AS missing_ratio, round(count({c}) / count(*), 4) AS completeness FROM {LABELLED}"""
            for c, f in [("doc_id", "int"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "int"), ("quality", "int"), ("toxic", "int")]
        ]
    ),
)
def _(t):
    return completeness.missing_summary(t.labelled)


# -- consistency ------------------------------------------------------------


@query(
    "k1_comparison_rules",
    all_of(
        *[
            expect(f"cmp{i}", "", "error", n_if(f"NOT ({a} {op} {b})"), f"(SELECT * FROM {LABELLED})")
            for i, (a, op, b) in enumerate([("toxic", "<=", "quality"), ("toxic", "<", "quality"), ("toxic", ">=", "quality"), ("toxic", ">", "quality"), ("toxic", "=", "quality"), ("toxic", "<>", "quality")])
        ]
    ),
)
def _(t):
    df = t.labelled
    rs = [ConsistencyRule(f"cmp{i}", "comparison", ("toxic", "quality"), parameters={"operator": op}) for i, op in enumerate(["<=", "<", ">=", ">", "==", "!="])]
    return brief(checks.run(df, consistency.rule_checks(df, rs)))


@query(
    "k2_expression_rules",
    all_of(
        expect("price", "", "error", n_if("NOT coalesce(l_extendedprice * (1 - l_discount) >= l_quantity * 900, false)"), "lineitem"),
        expect("mean_tax", "", "warning", "CASE WHEN avg(l_tax) < 0.01 THEN 0 ELSE count(*) END", "lineitem"),
        expect("broken", "", "error", "1", "(SELECT 1)", "1"),
    ),
)
def _(t):
    df = t.lineitem
    rs = [
        ConsistencyRule("price", "expression", ("l_extendedprice",), "l_extendedprice * (1 - l_discount) >= l_quantity * 900"),
        ConsistencyRule("mean_tax", "expression", ("l_tax",), "avg(l_tax) < 0.01", "warning", {"scalar": True}),
        ConsistencyRule("broken", "expression", ("l_tax",), "no_such_column < 0.01"),
    ]
    return brief(checks.run(df, consistency.rule_checks(df, rs)))


@query("k3_custom_rule", expect("late_day", "", "error", n_if("extract(day FROM o_orderdate) >= 28"), "orders"))
def _(t):
    rule = ConsistencyRule("late_day", "custom", ("o_orderdate",), lambda df: F.dayofmonth("o_orderdate") < 28)
    return brief(checks.run(t.orders, consistency.rule_checks(t.orders, [rule])))


@query(
    "k4_k5_references",
    all_of(
        expect("flags", "l_returnflag", "error", n_if("l_returnflag NOT IN ('A','N')"), "lineitem"),
        expect("orders", "l_orderkey", "error", n_if("l_orderkey NOT IN (SELECT o_orderkey FROM orders)"), "lineitem"),
        expect("self", "l_suppkey", "error", n_if("l_suppkey NOT IN (SELECT l_linenumber FROM lineitem)"), "lineitem"),
    ),
)
def _(t):
    df = t.lineitem
    rs = [
        ConsistencyRule("flags", "referential", ("l_returnflag",), parameters={"reference_values": ["A", "N"]}),
        ConsistencyRule("orders", "referential", ("l_orderkey",), parameters={"reference_table": "orders", "reference_column": "o_orderkey"}),
        ConsistencyRule("self", "referential", ("l_suppkey",), parameters={"reference_column": "l_linenumber"}),
    ]
    return brief(checks.run(df, consistency.rule_checks(df, rs, {"orders": t.orders})))


@query(
    "k5_missing_references",
    """SELECT o_custkey AS value, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1""",
)
def _(t):
    return consistency.missing_references(t.orders, "o_custkey", t.supplier, "s_suppkey")


_SPANS = """(SELECT o_custkey, min(o_orderdate) AS start_date, max(o_orderdate) AS end_date,
   min(o_totalprice) AS low_price, max(o_totalprice) AS high_price FROM orders GROUP BY o_custkey)"""


@query(
    "k6_k7_detected_ranges",
    all_of(
        expect("auto_start_date_before_end_date", "", "warning", n_if("start_date > end_date"), _SPANS),
        expect("auto_low_price_leq_high_price", "", "warning", n_if("low_price > high_price"), _SPANS),
    ),
)
def _(t):
    spans = t.orders.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("start_date"), F.max("o_orderdate").alias("end_date"),
        F.min("o_totalprice").alias("low_price"), F.max("o_totalprice").alias("high_price"),
    )
    return brief(checks.run(spans, consistency.consistency_checks(spans)))


@query(
    "k8_rule_totals",
    f"""SELECT CAST(3 AS BIGINT) AS total_rules,
        CAST((bad1 = 0)::INT + (bad2 = 0)::INT AS BIGINT) AS rules_passed, CAST((bad1 > 0)::INT + (bad2 > 0)::INT + 1 AS BIGINT) AS rules_failed,
        CAST((bad1 > 0)::INT + (bad2 > 0)::INT + 1 AS BIGINT) AS issues_found
        FROM (SELECT {n_if("l_discount > l_tax")} AS bad1, {n_if("l_quantity < 1")} AS bad2 FROM lineitem)""",
)
def _(t):
    df = t.lineitem
    rs = [
        ConsistencyRule("a", "comparison", ("l_discount", "l_tax")),
        ConsistencyRule("b", "expression", ("l_quantity",), "l_quantity >= 1"),
        ConsistencyRule("c", "comparison", ("l_discount", "l_no_such")),
    ]
    return consistency.rule_totals(checks.run(df, consistency.rule_checks(df, rs)))


# -- accuracy ---------------------------------------------------------------


@query(
    "a1_a2_a3_a8_accuracy_rules",
    all_of(
        expect("range_below", "p_size", "error", n_if("p_size < 5"), "part"),
        expect("range_above", "p_size", "error", n_if("p_size > 45"), "part"),
        expect("pattern", "p_name", "warning", n_if("NOT regexp_matches(p_name, '(?i)^(RED|small)')"), "part"),
        expect("domain", "p_type", "error", n_if("p_type NOT IN ('ECONOMY','STANDARD')"), "part"),
        expect("format_email", "p_name", "error", "count(*)", "part"),
        """SELECT 'nosuch:p_type', '', 'info', 'skipped', 0, count(*) FROM part""",
    ),
)
def _(t):
    rs = [
        accuracy.AccuracyRule("p_size", "range", {"min": 5, "max": 45}),
        accuracy.AccuracyRule("p_name", "pattern", {"pattern": "RED|small"}, "warning"),
        accuracy.AccuracyRule("p_type", "domain", {"values": ["ECONOMY", "STANDARD"]}),
        accuracy.AccuracyRule("p_name", "format", {"format": "email"}),
        accuracy.AccuracyRule("p_type", "nosuch", {}),
    ]
    return brief(checks.run(t.part, accuracy.rule_checks(t.part, rs)))


_Z = "abs((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events)) > 3"
_IQR = """value < (SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) FROM events)
   OR value > (SELECT quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) FROM events)"""
_MAD = """abs(0.6745 * (value - (SELECT median(value) FROM events)) /
   (SELECT median(abs(value - (SELECT median(value) FROM events))) FROM events)) > 3.5"""

for _name, _method, _cond in (("a4_outliers_zscore", "zscore", _Z), ("a5_outliers_iqr", "iqr", _IQR), ("a6_outliers_mad", "mad", _MAD)):

    @query(_name, expect(f"outliers_{_method}", "value", "warning", n_if(_cond), "events"))
    def _(t, method=_method):
        return brief(checks.run(t.events, accuracy.outlier_checks(t.events, ["value"], method)))


@query("a7_outlier_rows", f"SELECT event_id, value FROM events WHERE {_MAD}")
def _(t):
    return accuracy.with_outlier_flag(t.events, "value", "mad").where("is_outlier").select("event_id", "value")


# -- timeliness -------------------------------------------------------------


@query(
    "t1_freshness",
    """SELECT max(ts) AS latest, min(ts) AS oldest, round(date_diff('microsecond', max(ts), TIMESTAMP '2024-02-01') / 3600000000.0, 2) AS data_age_hours,
       round(date_diff('microsecond', min(ts), max(ts)) / 3600000000.0, 2) AS data_span_hours, count(ts) AS rows_analyzed FROM events""",
)
def _(t):
    return timeliness.freshness(t.events, "ts", "2024-02-01 00:00:00")


@query(
    "t1_t2_t3_t4_timeliness_checks",
    all_of(
        expect("freshness", "o_orderdate", "warning", "CASE WHEN date_diff('microsecond', max(o_orderdate), TIMESTAMP '2000-01-01') > 24 * 3600000000 THEN 1 ELSE 0 END", "orders", "1"),
        expect("future", "o_orderdate", "error", n_if("o_orderdate > TIMESTAMP '2000-01-01 00:05:00'"), "orders"),
        expect("gaps", "o_orderdate", "warning", n_if("gap > 20 * 3600000000"), "(SELECT date_diff('microsecond', lag(o_orderdate) OVER (ORDER BY o_orderdate), o_orderdate) AS gap FROM orders)", "count(*) - 1"),
        """SELECT 'freshness', '', 'info', 'skipped', 0, count(*) FROM customer""",
    ),
)
def _(t):
    a = checks.run(t.orders, timeliness.timeliness_checks(t.orders, "2000-01-01 00:00:00", max_gap_hours=20))
    b = checks.run(t.customer, timeliness.timeliness_checks(t.customer, "2000-01-01 00:00:00"))
    return brief(a.unionByName(b))


@query(
    "t3_temporal_gaps",
    """SELECT round(max(gap) / 3600000000.0, 2) AS max_gap_hours, round(avg(gap) / 3600000000.0, 2) AS avg_gap_hours,
       count(*) FILTER (WHERE gap > 0.2 * 3600000000) AS large_gap_count
       FROM (SELECT date_diff('microsecond', lag(ts) OVER (ORDER BY ts), ts) AS gap FROM events)""",
)
def _(t):
    return timeliness.temporal_gaps(t.events, "ts", 0.2)


# -- rules ------------------------------------------------------------------


def _rx(pattern: str, value: str) -> str:
    return n_if(f"NOT regexp_matches({value}, '^(?:{pattern})')")


# Derived columns that hit both sides of each format rule, from the customer table.
_CUST = """(SELECT *,
  replace(c_name, '#', '') || '@' || lower(c_mktsegment) || CASE WHEN c_nationkey < 20 THEN '.com' ELSE '' END AS email,
  '555-' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') AS phone,
  '4' || lpad(CAST(c_custkey AS VARCHAR), CASE WHEN c_nationkey < 12 THEN 12 ELSE 11 END, '0') AS card,
  '1999-' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-0' || CAST(c_custkey AS VARCHAR) AS day,
  substr(md5(c_name),1,8) || '-' || substr(md5(c_name),9,4) || '-' || substr(md5(c_name),13,4) || '-' || substr(md5(c_name),17,4) || '-' || substr(md5(c_name),21,12) AS uid,
  '10.0.' || CAST(c_nationkey AS VARCHAR) || '.' || CAST(c_custkey AS VARCHAR) AS ip,
  CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE lpad(CAST(c_custkey AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-1234' END AS ssn,
  lpad(CAST(c_custkey AS VARCHAR), 5, '0') || CASE WHEN c_nationkey < 5 THEN '-12' ELSE '' END AS zip
  FROM customer)"""


def customer_formats(t) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    h = F.md5("c_name")
    return t.customer.select(
        "*",
        F.concat(F.regexp_replace("c_name", "#", ""), F.lit("@"), F.lower("c_mktsegment"), F.when(F.col("c_nationkey") < 20, ".com").otherwise("")).alias("email"),
        F.concat(F.lit("555-"), F.lpad(s("c_nationkey"), 3, "0"), F.lit("-"), F.lpad(s("c_custkey"), 4, "0")).alias("phone"),
        F.concat(F.lit("4"), F.when(F.col("c_nationkey") < 12, F.lpad(s("c_custkey"), 12, "0")).otherwise(F.lpad(s("c_custkey"), 11, "0"))).alias("card"),
        F.concat(F.lit("1999-"), F.lpad(s("c_nationkey"), 2, "0"), F.lit("-0"), s("c_custkey")).alias("day"),
        F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)).alias("uid"),
        F.concat(F.lit("10.0."), s("c_nationkey"), F.lit("."), s("c_custkey")).alias("ip"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lpad(s("c_custkey"), 3, "0"), F.lit("-"), F.lpad(s("c_nationkey"), 2, "0"), F.lit("-1234"))).alias("ssn"),
        F.concat(F.lpad(s("c_custkey"), 5, "0"), F.when(F.col("c_nationkey") < 5, "-12").otherwise("")).alias("zip"),
    )


@query(
    "r1_r2_r3_r4_r6_r7_r8_r9_format_rules",
    all_of(
        expect("email", "email", "warning", _rx(rules.EMAIL, "email"), _CUST),
        expect("phone_us", "phone", "warning", _rx(rules.PHONE["us"], "phone"), _CUST),
        expect("phone_international", "phone", "warning", _rx(rules.PHONE["international"], "phone"), _CUST),
        expect("phone_basic", "phone", "warning", _rx(rules.PHONE["basic"], "phone"), _CUST),
        expect("card", "card", "error", _rx(rules.CREDIT_CARD, "regexp_replace(card, '[\\s\\-]', '', 'g')"), _CUST),
        expect("date_iso", "day", "warning", _rx(rules.DATE["iso"], "day"), _CUST),
        expect("date_us", "day", "warning", _rx(rules.DATE["us"], "day"), _CUST),
        expect("date_eu", "day", "warning", _rx(rules.DATE["eu"], "day"), _CUST),
        expect("uuid", "uid", "warning", _rx(rules.UUID, "uid"), _CUST),
        expect("ip", "ip", "warning", _rx(rules.IP_V4, "ip"), _CUST),
        expect("ssn", "ssn", "critical", _rx(rules.SSN, "ssn"), _CUST),
        expect("zip", "zip", "warning", _rx(rules.ZIP_CODE, "zip"), _CUST),
    ),
)
def _(t):
    df = customer_formats(t)
    rs = [
        Rule("email", "email", "email"),
        *[Rule(f"phone_{k}", "phone", "phone", parameters={"format": k}) for k in ("us", "international", "basic")],
        Rule("card", "credit_card", "card", severity="error"),
        *[Rule(f"date_{k}", "date", "day", parameters={"format": k}) for k in ("iso", "us", "eu")],
        Rule("uuid", "uuid", "uid"),
        Rule("ip", "ip_address", "ip"),
        Rule("ssn", "ssn", "ssn", severity="critical"),
        Rule("zip", "zip_code", "zip"),
    ]
    return brief(checks.run(df, rules.rules_checks(df, rs)))


@query(
    "r5_r10_page_rules",
    all_of(
        expect("url", "url", "warning", _rx(rules.URL.replace("{1,256}", "+"), "url"), "pages"),
        expect("https", "url", "error", n_if("NOT regexp_matches(url, '^(?:https://)')"), "pages"),
        expect("doctype", "html", "warning", n_if("NOT regexp_matches(html, '^(?:<!DOCTYPE html>)')"), "pages"),
        expect("no_pattern", "url", "error", "1", "(SELECT 1)", "1"),
    ),
)
def _(t):
    rs = [
        Rule("url", "url", "url"),
        Rule("https", "pattern", "url", severity="error", parameters={"pattern": "https://"}),
        Rule("doctype", "pattern", "html", parameters={"pattern": "<!DOCTYPE html>"}),
        Rule("no_pattern", "pattern", "url"),
    ]
    return brief(checks.run(t.pages, rules.rules_checks(t.pages, rs)))


@query(
    "r11_r12_r13_value_rules",
    all_of(
        expect("range", "quality", "warning", n_if("quality < 1 OR quality > 1"), LABELLED),
        expect("in_list", "lang", "error", n_if("lang NOT IN ('en','de')"), LABELLED),
        expect("not_in_list", "source", "warning", n_if("source IN ('src0','src1')"), LABELLED),
    ),
)
def _(t):
    df = t.labelled
    rs = [
        Rule("range", "range", "quality", parameters={"min": 1, "max": 1}),
        Rule("in_list", "in_list", "lang", severity="error", parameters={"values": ["en", "de"]}),
        Rule("not_in_list", "not_in_list", "source", parameters={"values": ["src0", "src1"]}),
    ]
    return brief(checks.run(df, rules.rules_checks(df, rs)))


@query(
    "r14_conditional_rules",
    all_of(
        expect("row", "o_totalprice", "warning", n_if("o_orderstatus = 'F' AND o_totalprice > 300000"), "orders", n_if("o_orderstatus = 'F'")),
        expect("once", "o_custkey", "warning", "count(*) - count(DISTINCT o_custkey)", "(SELECT * FROM orders WHERE o_orderstatus = 'F')"),
        expect("mean", "o_totalprice", "error", "CASE WHEN abs(avg(o_totalprice) - 100) > 1 THEN 1 ELSE 0 END", "(SELECT * FROM orders WHERE o_orderstatus = 'F')", "1"),
    ),
)
def _(t):
    on = {"condition_column": "o_orderstatus", "condition_value": "F"}
    rs = [
        Rule("row", "conditional", "o_totalprice", parameters={**on, "target_rule": "range", "target_parameters": {"max": 300000}}),
        Rule("once", "conditional", "o_custkey", parameters={**on, "target_rule": "unique"}),
        Rule("mean", "conditional", "o_totalprice", severity="error", parameters={**on, "target_rule": "aggregate", "target_parameters": {"aggregation": "mean", "expected": 100}}),
    ]
    return brief(checks.run(t.orders, rules.rules_checks(t.orders, rs)))


@query(
    "r15_unique_rule",
    all_of(
        expect("source", "source", "warning", "count(*) - count(DISTINCT source)", "documents"),
        expect("text", "text", "warning", "count(*) - count(DISTINCT text)", "documents"),
        expect("quality", "quality", "warning", "count(*) - (SELECT count(*) FROM (SELECT DISTINCT quality FROM " + LABELLED + "))", LABELLED),
    ),
)
def _(t):
    df = t.labelled
    rs = [Rule(c, "unique", c) for c in ("source", "text", "quality")]
    return brief(checks.run(df, rules.rules_checks(df, rs)))


_REDUCTIONS = {
    "sum": "sum(value)", "mean": "avg(value)", "min": "min(value)", "max": "max(value)", "median": "median(value)",
    "std": "stddev_samp(value)", "var": "var_samp(value)", "count": "count(value)", "nunique": "count(DISTINCT value)",
    "skew": "skewness(value)", "kurt": "kurtosis(value)",
}


@query(
    "r16_aggregate_rules",
    all_of(*[expect(k, "value", "warning", f"CASE WHEN abs({e} - 50) > 0.05 * 50 THEN 1 ELSE 0 END", "events", "1") for k, e in _REDUCTIONS.items()]),
)
def _(t):
    rs = [Rule(k, "aggregate", "value", parameters={"aggregation": k, "expected": 50, "tolerance": 0.05}) for k in _REDUCTIONS]
    return brief(checks.run(t.events, rules.rules_checks(t.events, rs)))


@query(
    "r17_rule_loop",
    all_of(
        expect("on", "o_totalprice", "warning", n_if("o_totalprice > 100000"), "orders"),
        expect("ghost", "o_ghost", "warning", "1", "(SELECT 1)", "1"),
        """SELECT 'odd', '', 'info', 'skipped', 0, count(*) FROM orders""",
    ),
)
def _(t):
    rs = [
        Rule("on", "range", "o_totalprice", parameters={"max": 100000}),
        Rule("off", "range", "o_totalprice", enabled=False, parameters={"max": 1}),
        Rule("ghost", "range", "o_ghost", parameters={"max": 1}),
        Rule("odd", "telepathy", "o_totalprice"),
    ]
    return brief(checks.run(t.orders, rules.rules_checks(t.orders, rs)))


# -- roll-ups ---------------------------------------------------------------

_REPORT = """(SELECT * FROM (VALUES
   ('schema', 'error', 0), ('schema', 'error', 0)) v(validator, severity, violations))"""


def orders_report(t) -> DataFrame:
    """The flagship report: one fused scan plus one shuffle for uniqueness."""
    cfg = engine.QualityConfig(
        contract={"columns": [{"name": "o_orderkey", "dtype": "int", "nullable": False, "unique": True}], "allow_extra_columns": True},
        consistency=[ConsistencyRule("positive", "expression", ("o_totalprice",), "o_totalprice > 0")],
        rules=[Rule("price", "range", "o_totalprice", parameters={"min": 1000, "max": 500000})],
        reference_time="2001-08-02 00:00:00",
        outlier_method="zscore",
    )
    return engine.quality_run(t.orders, cfg)


_VALIDATORS = """(
  SELECT 'schema' AS validator, (SELECT CASE WHEN count(*) > count(DISTINCT o_orderkey) OR count(*) > count(o_orderkey) THEN 1 ELSE 0 END FROM orders) AS bad, 'failed' AS worst
  UNION ALL SELECT 'completeness', 0, 'warning'
  UNION ALL SELECT 'consistency', (SELECT CASE WHEN count(*) FILTER (WHERE NOT o_totalprice > 0) > 0 THEN 1 ELSE 0 END FROM orders), 'failed'
  UNION ALL SELECT 'accuracy', (SELECT (sum(CASE WHEN abs(o_orderkey - mk) / sk > 3 THEN 1 ELSE 0 END) > 0)::INT + (sum(CASE WHEN abs(o_custkey - mc) / sc > 3 THEN 1 ELSE 0 END) > 0)::INT
      + (sum(CASE WHEN abs(o_totalprice - mp) / sp > 3 THEN 1 ELSE 0 END) > 0)::INT
      FROM orders, (SELECT avg(o_orderkey) mk, stddev_pop(o_orderkey) sk, avg(o_custkey) mc, stddev_pop(o_custkey) sc, avg(o_totalprice) mp, stddev_pop(o_totalprice) sp FROM orders)), 'warning'
  UNION ALL SELECT 'timeliness', (SELECT CASE WHEN date_diff('hour', max(o_orderdate), TIMESTAMP '2001-08-02') > 24 THEN 1 ELSE 0 END FROM orders), 'warning'
  UNION ALL SELECT 'rules', (SELECT CASE WHEN count(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 500000) > 0 THEN 1 ELSE 0 END FROM orders), 'warning')"""

_STATUS = f"(SELECT validator, CASE WHEN bad > 0 THEN worst ELSE 'passed' END AS status, CAST(bad AS BIGINT) AS issues FROM {_VALIDATORS})"


@query("g1_validator_status", f"SELECT validator, status, issues FROM {_STATUS}")
def _(t):
    return rollup.validator_status(orders_report(t)).select("validator", "status", "issues")


_OVERALL = f"""(SELECT CASE WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (WHERE status = 'warning') > 0 THEN 'warning' ELSE 'passed' END AS status,
   CAST(sum(issues) AS BIGINT) AS total_issues, count(*) AS validators_run, {n_if("status = 'passed'")} AS validators_passed,
   {n_if("status = 'failed'")} AS validators_failed, {n_if("status = 'warning'")} AS validators_warned FROM {_STATUS})"""


@query(
    "g2_g3_g4_g6_report_summary",
    f"""SELECT *, total_issues AS scored_issues, CAST(6 AS BIGINT) AS data_columns, CAST(CASE status WHEN 'failed' THEN 0 WHEN 'warning' THEN 1 - least(0.5, 0.05 * total_issues) ELSE 1 END AS DOUBLE) AS quality_score,
      CAST(greatest(0, CASE status WHEN 'warning' THEN 80 WHEN 'failed' THEN 45 ELSE 100 END -
        least(CASE status WHEN 'warning' THEN 30 WHEN 'failed' THEN 45 ELSE 15 END, 2 * total_issues)) AS DOUBLE) AS tiered_score FROM {_OVERALL}""",
)
def _(t):
    return rollup.report_summary(orders_report(t), t.orders)


@query("g5_issues_by_severity", f"SELECT CASE worst WHEN 'failed' THEN 'error' ELSE worst END AS severity, CAST(sum(bad) AS BIGINT) AS issues FROM {_VALIDATORS} WHERE bad > 0 GROUP BY 1")
def _(t):
    return rollup.issues_by_severity(orders_report(t))


@query("g7_fail_fast_run", "SELECT 'schema' AS validator, CASE WHEN count(*) < 1000000 THEN 'failed' ELSE 'passed' END AS status FROM orders")
def _(t):
    """Stops after the first validator that did not pass."""
    cfg = engine.QualityConfig(contract=ORDERS_CONTRACT, fail_fast=True, reference_time="2001-08-02 00:00:00")
    return rollup.validator_status(engine.quality_run(t.orders, cfg)).select("validator", "status")


@query("g8_error_isolation", expect("ghost", "", "error", "1", "(SELECT 1)", "1") + " UNION ALL " + expect("fine", "", "error", n_if("NOT o_totalprice > 2000"), "orders"))
def _(t):
    rs = [
        ConsistencyRule("ghost", "expression", (), "no_such_function(o_totalprice) > 0"),
        ConsistencyRule("fine", "expression", ("o_totalprice",), "o_totalprice > 2000"),
    ]
    return brief(checks.run(t.orders, consistency.rule_checks(t.orders, rs)))


@query(
    "g8_data_errors",
    all_of(
        expect("divides", "", "error", "1", "(SELECT 1)", "1"),
        expect("fine", "", "error", n_if("NOT o_totalprice > 2000"), "orders"),
        expect("lost", "", "error", "1", "(SELECT 1)", "1"),
        expect("customers", "o_custkey", "error", n_if("o_custkey NOT IN (SELECT s_suppkey FROM supplier)"), "orders"),
        expect("listed", "o_orderstatus", "error", n_if("o_orderstatus <> 'F'"), "orders"),
        expect("mismatch", "o_totalprice", "error", "0", "(SELECT 1)", "0"),
        expect("allowed_values", "o_orderkey", "error", "count(o_orderkey)", "orders"),
    ),
)
def _(t):
    """Errors that only a value raises, wrong types, a NULL in a list and a table that is not there stay in their checks."""
    cfg = engine.QualityConfig(
        run=("schema", "consistency", "rules"),
        contract={"columns": [{"name": "o_orderkey", "dtype": "string", "allowed_values": ["A", "B"]}], "allow_extra_columns": True},
        consistency=[
            ConsistencyRule("divides", "expression", (), "1 / (o_orderkey % 2) >= 0"),
            ConsistencyRule("fine", "expression", ("o_totalprice",), "o_totalprice > 2000"),
            ConsistencyRule("lost", "referential", ("o_custkey",), parameters={"reference_table": "nowhere", "reference_column": "x"}),
            ConsistencyRule("customers", "referential", ("o_custkey",), parameters={"reference_table": "supplier", "reference_column": "s_suppkey"}),
        ],
        rules=[
            Rule("listed", "in_list", "o_orderstatus", severity="error", parameters={"values": ["F", None]}),
            Rule("mismatch", "conditional", "o_totalprice", severity="error", parameters={"condition_column": "o_orderkey", "condition_value": "abc", "target_rule": "range", "target_parameters": {"min": 0}}),
        ],
        tables={"supplier": t.supplier},
    )
    names = ["divides", "fine", "lost", "customers", "listed", "mismatch", "allowed_values"]
    return brief(engine.quality_run(t.orders, cfg).where(F.col("check").isin(names)))


_INF = "(SELECT event_id, CASE WHEN event_id % 1000 = 7 THEN 'Infinity'::DOUBLE WHEN event_id % 1000 = 8 THEN 'NaN'::DOUBLE ELSE value END AS v, value AS w FROM events)"


def _with_infinity(t):
    v = F.when(F.col("event_id") % 1000 == 7, F.lit(float("inf"))).when(F.col("event_id") % 1000 == 8, F.lit(float("nan"))).otherwise(F.col("value"))
    return t.events.select("event_id", v.alias("v"), F.col("value").alias("w"))


@query(
    "a4_outliers_with_infinity",
    expect("outliers_zscore", "v", "warning", "count(*) FILTER (WHERE NOT isnan(v) AND (isinf(v) OR abs((v - m) / s) > 3))", f"{_INF}, (SELECT avg(v) AS m, stddev_pop(v) AS s FROM {_INF} WHERE isfinite(v))", "count(*) FILTER (WHERE NOT isnan(v))"),
)
def _(t):
    df = _with_infinity(t)
    return brief(checks.run(df, accuracy.outlier_checks(df, ["v"])))
