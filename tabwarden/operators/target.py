"""Features that encode the target: correlation and mutual information."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwarden.functions.expr import ratio
from tabwarden.functions.longform import long_values, names_table, with_bin
from tabwarden.functions.selection import exact_quantiles
from tabwarden.functions.types import as_double, clean, numeric_columns
from tabwarden.operators import leakage
from tabwarden.operators.profile import bin_of, target_correlations
from tabwarden.plans.schemas import DEFAULTS

DETECTOR = "target"
MI_BINS = 10
# A numeric target with more distinct values than this is binned.
MAX_CLASSES = 10


def quantile_bin(v: Column, inner: Sequence[float]) -> Column:
    """Bin by distinct inner quantile borders; a missing value is bin -1."""
    cuts = sorted(set(inner))
    return F.when(v.isNull(), F.lit(-1)).otherwise(bin_of(v, [0.0, *cuts, 0.0]))


def target_classes(df: DataFrame, target: str, bins: int = MI_BINS) -> Column:
    """Class label of a row's target as text; continuous targets become quantile bins."""
    if target in numeric_columns(df):
        distinct = df.select(clean(df, target).alias("v")).where("v is not null").distinct().limit(MAX_CLASSES + 1).count()
        if distinct > MAX_CLASSES:
            v = as_double(df, target)
            cuts = exact_quantiles(df, {target: v}, [i / bins for i in range(1, bins)])[target]
            return quantile_bin(v, cuts or []).cast("string")
    return F.coalesce(clean(df, target).cast("string"), F.lit("<missing>"))


def mutual_information(df: DataFrame, target: str, columns: Sequence[str] | None = None, bins: int = MI_BINS) -> DataFrame:
    """(feature, mi, target_share, normalized) from decile bins of each feature.

    ``target_share`` is MI divided by the target's entropy: 1 when the feature
    determines the target. ``normalized`` divides by the largest MI, so the
    best feature always has 1. The joint table has bins x classes rows per feature.
    """
    names = [c for c in (columns or numeric_columns(df, [target])) if c != target]
    v = {c: F.coalesce(as_double(df, c), F.lit(0.0)) for c in names}
    cuts = exact_quantiles(df, v, [i / bins for i in range(1, bins)])
    edges = {g: sorted(set(cuts[c] or [])) for g, c in enumerate(names)}
    rows = with_bin(long_values(df, [v[c] for c in names], [target_classes(df, target, bins).alias("y")]), edges, "x")
    joint = rows.groupBy("g", "x", "y").agg(F.count("*").alias("n")).join(F.broadcast(names_table(df, names)), "g")
    sets = [[F.col("feature"), F.col("x"), F.col("y")], [F.col("feature"), F.col("x")], [F.col("feature"), F.col("y")], [F.col("feature")]]
    sums = joint.groupingSets(sets, "feature", "x", "y").agg(F.sum("n").cast("double").alias("n"), F.grouping("x").alias("no_x"), F.grouping("y").alias("no_y"))
    over = lambda no_x, no_y: F.sum(F.when((F.col("no_x") == no_x) & (F.col("no_y") == no_y), F.col("n") * F.log("n")))
    total = F.max("n")
    # n ln n summed over the cells, the bins, the classes and the whole give both entropies; no group holds the classes of a feature.
    mi = (over(0, 0) - over(0, 1) - over(1, 0) + over(1, 1)) / total
    h = (over(1, 1) - over(1, 0)) / total
    per = sums.groupBy("feature").agg(F.greatest(mi, F.lit(0.0)).alias("mi"), F.greatest(h, F.lit(0.0)).alias("h"))
    top = F.max("mi").over(Window.partitionBy(F.lit(0)))  # one row per feature
    return per.select(
        "feature", "mi", F.coalesce(ratio(F.col("mi"), F.col("h")), F.lit(0.0)).alias("target_share"), F.coalesce(ratio(F.col("mi"), top), F.lit(0.0)).alias("normalized")
    )


def detect(
    train: DataFrame, target: str | None, correlation_threshold: float = DEFAULTS["target_correlation"],
    mi_threshold: float = DEFAULTS["mutual_info"],
) -> DataFrame:
    spark = train.sparkSession
    if target is None:
        return leakage.rows(spark, [leakage.skipped(DETECTOR, "no target column")])
    if target not in train.columns:
        return leakage.rows(spark, [leakage.failed(DETECTOR, f"target column '{target}' not found")])
    high = target_correlations(train, target).where(F.col("correlation") >= correlation_threshold)
    parts = [
        leakage.rows(spark, [leakage.checked(spark, DETECTOR)]),
        leakage.finding(
            high, DETECTOR, "target_leakage", "critical", F.format_string("Investigate if '%s' contains future/target information", "feature"),
            feature=F.col("feature"), score=F.col("correlation"), threshold=correlation_threshold,
        ),
    ]
    if numeric_columns(train, [target]):
        known = mutual_information(train, target).where(F.col("target_share") >= mi_threshold)
        parts.append(
            leakage.finding(
                known, DETECTOR, "potential_target_leakage", "warning", F.format_string("Review feature '%s' for potential target leakage", "feature"),
                feature=F.col("feature"), score=F.round("target_share", 4), threshold=mi_threshold,
            )
        )
    return leakage.union(parts)
