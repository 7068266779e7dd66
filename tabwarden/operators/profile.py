"""Column profiles, correlations and health score of one table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabwarden.functions.expr import fingerprint, md5_order, ratio, value_identity
from tabwarden.functions.longform import long_values, names_table, with_bin
from tabwarden.functions.moments import pair_products
from tabwarden.functions.selection import exact_quantiles
from tabwarden.functions.types import (
    as_double,
    atomic_columns,
    categorical_columns,
    clean,
    col,
    families,
    numeric_columns,
)
from tabwarden.plans.schemas import DEFAULTS

BINS = 20
QUARTILES = (0.25, 0.5, 0.75)

# Fixed widths in bytes used for the logical table size.
WIDTHS = {
    T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8,
    T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16,
}


def corrected_skewness(v: Column) -> Column:
    """Sample skewness with bias correction; 0 up to 2 values or without spread."""
    n = F.count(v).cast("double")
    g1 = F.coalesce(F.skewness(v), F.lit(0.0))
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)).otherwise(F.lit(0.0))


def corrected_kurtosis(v: Column) -> Column:
    """Sample excess kurtosis with bias correction; 0 up to 3 values or without spread."""
    n = F.count(v).cast("double")
    g2 = F.kurtosis(v)
    scale = (n - 1) / F.when(n > 3, (n - 2) * (n - 3))
    return F.when((n > 3) & g2.isNotNull(), scale * ((n + 1) * g2 + 6)).otherwise(F.lit(0.0))


def table_header(df: DataFrame) -> DataFrame:
    """One row: rows, columns, columns per family, missing cells, logical bytes."""
    fams = families(df)
    atoms = atomic_columns(df)
    missing = reduce(lambda a, b: a + b, [clean(df, c).isNull().cast("long") for c in atoms], F.lit(0).cast("long"))
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        if fams[f.name] == "string":
            size = size + F.coalesce(F.octet_length(col(f.name)), F.lit(0)).cast("long")
        else:
            size = size + F.lit(WIDTHS.get(type(f.dataType), 0)).cast("long")
    counts = [F.lit(sum(v == fam for v in fams.values())).cast("long").alias(f"{fam}_columns") for fam in ("int", "float", "string", "bool", "datetime")]
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(missing), F.lit(0)).alias("total_missing"),
        F.coalesce(F.sum(size), F.lit(0)).alias("logical_bytes"),
    ).select("rows", F.lit(len(fams)).cast("long").alias("columns"), *counts, "total_missing", "logical_bytes")


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Copies beyond the first of whole rows; the shuffle carries 16 bytes per distinct row."""
    names = list(columns or atomic_columns(df))
    groups = df.groupBy(fingerprint(names).alias("row")).agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
    ).select("duplicate_rows", "total_rows", F.coalesce(ratio(F.col("duplicate_rows"), F.col("total_rows")), F.lit(0.0)).alias("duplicate_pct"))


def column_base(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Per column: type family, count, missing, distinct values and their shares.

    Exact distinct counts group all columns at once by (column, value identity):
    one shuffle of fixed-width rows, already combined per task. ``approximate``
    uses sketches inside one scan instead.
    """
    names = list(columns or atomic_columns(df))
    fams = families(df)
    if approximate:
        aggs = [F.count(F.lit(1)).alias("total")]
        for i, c in enumerate(names):
            aggs += [F.count(clean(df, c)).alias(f"c{i}"), F.approx_count_distinct(clean(df, c)).alias(f"u{i}")]
        rows = [F.struct(F.lit(c).alias("column"), F.lit(fams[c]).alias("type"), F.col(f"c{i}").alias("count"), F.col(f"u{i}").alias("unique_count"), F.col("total")) for i, c in enumerate(names)]
        per = df.agg(*aggs).select(F.inline(F.array(*rows)))
    else:
        parts = []
        for text in (False, True):
            mine = [c for c in names if (fams[c] == "string") == text]
            if mine:
                ids = [F.when(clean(df, c).isNotNull(), value_identity(clean(df, c), text)) for c in mine]
                by_value = long_values(df, ids, nulls=True).groupBy("g", "v").agg(F.count("*").alias("n"))
                counted = by_value.groupBy("g").agg(
                    F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("count"),
                    F.count_if(F.col("v").isNotNull()).alias("unique_count"),
                    F.sum("n").alias("total"),
                )
                table = df.sparkSession.createDataFrame([(i, c, fams[c]) for i, c in enumerate(mine)], "g int, column string, type string")
                zero = F.lit(0).cast("long")  # an empty table has no rows for a column
                parts.append(F.broadcast(table).join(counted, "g", "left").select("column", "type", *[F.coalesce(F.col(x), zero).alias(x) for x in ("count", "unique_count", "total")]))
        per = reduce(DataFrame.unionByName, parts)
    missing = F.col("total") - F.col("count")
    return per.select(
        "column", "type", "count", missing.alias("missing_count"),
        F.coalesce(ratio(missing, F.col("total")), F.lit(0.0)).alias("missing_pct"),
        "unique_count",
        F.coalesce(ratio(F.col("unique_count"), F.col("total")), F.lit(0.0)).alias("unique_pct"),
    )


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: moments, quartiles, corrected skewness and kurtosis, IQR outliers.

    Quartiles come first (a few numbers per column); everything else, the
    outlier count included, is then one grouped aggregate over all columns.
    """
    names = list(columns or numeric_columns(df))
    v = {c: as_double(df, c) for c in names}
    quart = exact_quantiles(df, v, QUARTILES)
    names = [c for c in names if quart[c] is not None]
    if not names:
        schema = "column string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double, skewness double, kurtosis double, outliers_count long"
        return df.sparkSession.createDataFrame([], schema)
    known = []
    for i, c in enumerate(names):
        q1, _, q3 = quart[c]
        known.append((i, c, *quart[c], q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)))
    table = F.broadcast(df.sparkSession.createDataFrame(known, "g int, column string, p25 double, p50 double, p75 double, low double, high double"))
    x = F.col("v")
    rows = long_values(df, [v[c] for c in names]).join(table.select("g", "low", "high"), "g")
    grouped = rows.groupBy("g").agg(
        F.count("*").alias("count"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"), corrected_skewness(x).alias("skewness"),
        corrected_kurtosis(x).alias("kurtosis"), F.count_if((x < F.col("low")) | (x > F.col("high"))).alias("outliers_count"),
    )
    return grouped.join(table, "g").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max", "skewness", "kurtosis", "outliers_count"
    )


def bin_edges(low: float, high: float, bins: int = BINS) -> list[float]:
    """Equal-width edges; a constant column is widened by half a unit each way."""
    if low == high:
        low, high = low - 0.5, high + 0.5
    return [float(e) for e in np.linspace(low, high, bins + 1)]


def bin_of(v: Column, edges: Sequence[float]) -> Column:
    """Number of inner edges at or below the value; compares, so edges are exact."""
    return reduce(lambda a, b: a + b, [(v >= F.lit(e)).cast("int") for e in edges[1:-1]], F.lit(0))


def edge_table(df: DataFrame, edges: dict[str, Sequence[float]]) -> DataFrame:
    """(feature, bin, low, high) for every bin: columns x bins rows."""
    rows = [(c, i, float(e[i]), float(e[i + 1])) for c, e in edges.items() for i in range(len(e) - 1)]
    return df.sparkSession.createDataFrame(rows, "feature string, bin int, low double, high double")


def finite(rows: DataFrame) -> DataFrame:
    """Long-form rows without infinite values."""
    return rows.where(F.abs("v") < float("inf"))


def bounds(df: DataFrame, values: dict[str, Column]) -> dict[str, tuple[float, float]]:
    """Smallest and largest finite value of each column that has any."""
    rows = finite(long_values(df, list(values.values()))).groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    names = list(values)
    return {names[r["g"]]: (r["lo"], r["hi"]) for r in rows}


def numeric_histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = BINS) -> DataFrame:
    """(feature, bin, low, high, n), empty bins included; the last bin is closed. Infinite values are in no bin."""
    values = {c: as_double(df, c) for c in (columns or numeric_columns(df))}
    edges = {c: bin_edges(lo, hi, bins) for c, (lo, hi) in bounds(df, values).items()}
    names = list(edges)
    inner = {g: edges[c][1:-1] for g, c in enumerate(names)}
    counts = with_bin(finite(long_values(df, [values[c] for c in names])), inner).groupBy("g", "bin").agg(F.count("*").alias("n"))
    counts = counts.join(F.broadcast(names_table(df, names)), "g").drop("g")
    return edge_table(df, edges).join(counts, ["feature", "bin"], "left").select("feature", "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def value_counts(df: DataFrame, columns: Sequence[str] | None = None, texts: bool = True) -> DataFrame:
    """(feature, value, n) of all categorical columns, combined per task before the shuffle.

    Without ``texts`` a value is its 128-bit identity, so that long texts are counted without moving them.
    """
    names = list(columns or categorical_columns(df))
    value = lambda c: clean(df, c).cast("string")
    entries = [F.struct(F.lit(c).alias("feature"), (value(c) if texts else F.when(value(c).isNotNull(), value_identity(value(c), True))).alias("value")) for c in names]
    return df.select(F.inline(F.array(*entries))).where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """The k most frequent values per column, ties by value.

    The rank filter is pushed below the window's shuffle, so each task sends at
    most k rows per column.
    """
    w = Window.partitionBy("feature").orderBy(F.desc("n"), "value")
    return value_counts(df, columns).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def category_balance(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per categorical column: distinct values and most to least frequent ratio."""
    return value_counts(df, columns, texts=False).groupBy("feature").agg(
        F.count("*").alias("categories"), F.max("n").alias("largest"), F.min("n").alias("smallest")
    ).select("*", (F.col("largest") / F.col("smallest")).alias("imbalance_ratio"))


def category_histogram(df: DataFrame, columns: Sequence[str] | None = None, k: int = BINS) -> DataFrame:
    """Per categorical column: the k most frequent labels and their counts, as arrays."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "value", "n")))
    return top_values(df, columns, k).groupBy("feature").agg(ordered.alias("e")).select(
        "feature", F.col("e.value").alias("labels"), F.col("e.n").alias("counts")
    )


def pair_moments(df: DataFrame, pairs: Sequence[tuple[str, str]], values: dict[str, Column]) -> DataFrame:
    """(feature_a, feature_b, n, value): Pearson over the complete rows of each pair.

    All pairs come from cross products of blocks of rows, so a row is never copied per pair. ``value`` is
    NULL without spread, or where a value is infinite.
    """
    schema = "feature_a string, feature_b string, n long, value double"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    at = {c: i for i, c in enumerate(names)}
    products = pair_products(df, [values[c] for c in names], [(at[a], at[b]) for a, b in pairs])
    value = F.when((F.col("odd") == 0) & (F.col("cxx") > 0) & (F.col("cyy") > 0), F.col("cxy") / (F.sqrt("cxx") * F.sqrt("cyy")))
    named = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "p int, feature_a string, feature_b string")
    joined = F.broadcast(named).join(products.select("p", "n", F.when(value.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))).alias("value")), "p", "left")
    return joined.select("feature_a", "feature_b", F.coalesce("n", F.lit(0)).alias("n"), "value")


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None, fill: float | None = 0.0) -> DataFrame:
    """(feature_a, feature_b, value) for a < b in column order."""
    names = list(columns or numeric_columns(df))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    out = pair_moments(df, pairs, {c: as_double(df, c) for c in names}).drop("n")
    return out if fill is None else out.fillna(fill, ["value"])


def missing_matrix(df: DataFrame, key: str, size: int = 250) -> DataFrame:
    """Missing flags of a repeatable sample of rows, one ordered array per column.

    The sample is the ``size`` smallest md5 of the key: a distributed top-n.
    """
    names = [c for c in df.columns if c != key]
    picked = df.orderBy(md5_order(key), col(key)).limit(size)
    entries = [F.struct(F.lit(c).alias("column"), col(key).alias("k"), clean(df, c).isNull().alias("missing")) for c in names]
    ordered = F.array_sort(F.collect_list(F.struct("k", "missing")))
    return picked.select(F.inline(F.array(*entries))).groupBy("column").agg(ordered.alias("e")).select("column", F.col("e.missing").alias("mask"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Counts per class and their shares of all rows, missing targets included in the total."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    v = clean(df, target)
    return df.groupBy(v.cast("string").alias("class")).agg(F.count("*").alias("n")).where("class is not null").select(
        "class", "n", ratio(F.col("n"), total).alias("share")
    )


def health_score(df: DataFrame) -> DataFrame:
    """100 minus 100 per duplicated share minus 50 per mean missing share, within 0..100."""
    base = df.agg(
        *[F.count(clean(df, c)).alias(f"c{i}") for i, c in enumerate(atomic_columns(df))], F.count(F.lit(1)).alias("n")
    )
    names = atomic_columns(df)
    shares = [F.coalesce(ratio(F.col("n") - F.col(f"c{i}"), F.col("n")), F.lit(0.0)) for i in range(len(names))]
    avg_missing = reduce(lambda a, b: a + b, shares, F.lit(0.0)) / F.lit(float(max(len(names), 1)))
    dup = duplicate_rows(df).select("duplicate_pct").scalar()
    score = F.lit(100.0) - dup * 100 - F.col("avg_missing_pct") * 50
    return base.select(avg_missing.alias("avg_missing_pct")).select(
        dup.alias("duplicate_pct"), "avg_missing_pct", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("health_score")
    )


def findings(df: DataFrame) -> DataFrame:
    """Risk and advice rows: duplication, heavily missing columns, id-like text."""
    base = column_base(df)
    dup = duplicate_rows(df).where("duplicate_pct > 0.05").select(
        F.lit(None).cast("string").alias("column"),
        F.lit("duplication").alias("risk"),
        F.col("duplicate_pct").alias("value"),
        F.concat(F.lit("High duplication detected: "), F.format_string("%.1f%%", F.col("duplicate_pct") * 100)).alias("message"),
        F.lit("Consider dropping exact duplicates.").alias("recommendation"),
    )
    missing = base.where("missing_pct > 0.3").select(
        "column", F.lit("missing").alias("risk"), F.col("missing_pct").alias("value"),
        F.format_string("Column '%s' has over 30%% missing values.", F.col("column")).alias("message"),
        F.format_string("Evaluate if '%s' can be imputed or if it should be dropped.", F.col("column")).alias("recommendation"),
    )
    ids = base.where("type = 'string' and unique_pct > 0.95 and unique_count > 50").select(
        "column", F.lit("identifier").alias("risk"), F.col("unique_pct").alias("value"),
        F.format_string("Column '%s' appears to be a unique ID/hash (95%%+ unique).", F.col("column")).alias("message"),
        F.lit(None).cast("string").alias("recommendation"),
    )
    return dup.unionByName(missing).unionByName(ids)


def summary(df: DataFrame) -> DataFrame:
    """Long (column, metric, value): describe for numeric columns, distinct counts for text."""
    num = numeric_profile(df).select(
        "column",
        F.explode(F.create_map(*[x for m in ("count", "mean", "std", "min", "p25", "p50", "p75", "max") for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "value"),
    )
    cats = categorical_columns(df)
    if not cats:
        return num
    cat = column_base(df, cats).select("column", F.lit("unique").alias("metric"), F.col("unique_count").cast("double").alias("value"))
    return num.unionByName(cat)


def target_values(df: DataFrame, target: str) -> Column | None:
    """Target as a number: itself, or a 0/1 indicator for a label with two values; else None."""
    if target in numeric_columns(df):
        return as_double(df, target)
    labels = [r[0] for r in df.select(clean(df, target).alias("v")).where("v is not null").distinct().orderBy("v").limit(3).collect()]
    if len(labels) != 2:
        return None
    v = clean(df, target)
    return F.when(v.isNotNull(), (v == F.lit(labels[0])).cast("double"))


def target_correlations(df: DataFrame, target: str, min_pairs: int = DEFAULTS["min_pairs"]) -> DataFrame:
    """abs correlation of each numeric feature with the target, strongest first."""
    y = target_values(df, target) if target in df.columns else None
    names = numeric_columns(df, [target])
    if y is None:
        names = []
    values = {c: as_double(df, c) for c in names} | {target: y}
    out = pair_moments(df, [(c, target) for c in names], values).where((F.col("n") >= min_pairs) & F.col("value").isNotNull())
    return out.select(F.col("feature_a").alias("feature"), F.round(F.abs("value"), 4).alias("correlation")).orderBy(F.desc("correlation"), "feature")


def full_profile(df: DataFrame) -> DataFrame:
    """One nested row per column: base counts, numeric statistics, top values, histogram."""
    hist = numeric_histogram(df).groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("bin", "low", "high", "n"))).alias("histogram"))
    tops = top_values(df).groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("top_values"))
    return (
        column_base(df)
        .join(F.broadcast(numeric_profile(df).drop("count")), "column", "left")
        .join(F.broadcast(hist.withColumnRenamed("feature", "column")), "column", "left")
        .join(F.broadcast(tops.withColumnRenamed("feature", "column")), "column", "left")
        .join(F.broadcast(category_balance(df).select(F.col("feature").alias("column"), "imbalance_ratio")), "column", "left")
    )
