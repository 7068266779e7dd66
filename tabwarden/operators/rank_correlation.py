"""Spearman and Kendall correlation from joint value counts.

Rows are first collapsed to (pair, x, y, n). Ranks then come from running
totals over the distinct values, and Kendall's concordant pairs are counted by
running totals between the parts of the x range that a digit of the rank tells
apart, so no pair of rows is formed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.functions.attach import attached
from tabwarden.functions.longform import long_values
from tabwarden.functions.ordering import running_totals, value_buckets
from tabwarden.functions.types import as_double, numeric_columns
from tabwarden.operators.profile import correlation_pairs, pair_moments
from tabwarden.sources.storage import checkpointed

# Bits of a rank that one pass over the joint counts tells apart.
DIGIT = 3


def _joint_counts(df: DataFrame, columns: Sequence[str] | None, target_rows: int | None) -> tuple[DataFrame, int]:
    """(feature_a, feature_b, x, y, xb, yb, n) over rows where both are present, and the bucket count."""
    names = list(columns or numeric_columns(df))
    flat = df.select(*[as_double(df, c).alias(f"c{i}") for i, c in enumerate(names)])
    flat, buckets = value_buckets(flat, [f"c{i}" for i in range(len(names))], target_rows)
    entries = [
        F.when(
            F.col(f"c{i}").isNotNull() & F.col(f"c{j}").isNotNull(),
            F.struct(
                F.lit(names[i]).alias("feature_a"), F.lit(names[j]).alias("feature_b"),
                F.col(f"c{i}").alias("x"), F.col(f"c{j}").alias("y"),
                F.col(f"c{i}__b").alias("xb"), F.col(f"c{j}__b").alias("yb"),
            ),
        )
        for i in range(len(names))
        for j in range(i + 1, len(names))
    ]
    joint = (
        flat.select(F.explode(F.array(*entries)).alias("e")).where("e is not null").select("e.*")
        .groupBy("feature_a", "feature_b", "x", "y", "xb", "yb").agg(F.count("*").alias("n"))
    )
    return joint, buckets


def _spearman_complete(flat: DataFrame, names: Sequence[str], distinct: Sequence[int], target_rows: int | None) -> DataFrame:
    """Pairs of columns without missing values: each column is ranked once.

    A rank table is broadcast only when the column has few distinct values;
    otherwise frequent values get their ranks where their rows are, and the
    other rows by a join.
    """
    cut, buckets = value_buckets(flat, [f"c{i}" for i in range(len(names))], target_rows)
    out = flat
    for i in range(len(names)):
        counts = cut.groupBy(F.lit(0).alias("one"), f"c{i}", F.col(f"c{i}__b").alias("b")).agg(F.count("*").alias("m"))
        totals = running_totals(counts, ["one"], f"c{i}", "b", ["m"], split=buckets > 1)
        # Average rank of a tied value: rows before it, plus half of its own and a half.
        ranks = totals.select(f"c{i}", (F.col("upto_m") - (F.col("m") - 1) / 2.0).alias(f"r{i}"))
        out = attached(out, ranks, [f"c{i}"], size=distinct[i])
    values = {n: F.col(f"r{i}") for i, n in enumerate(names)}
    return pair_moments(out, [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]], values).drop("n").fillna(0.0, ["value"])


def spearman_pairs(df: DataFrame, columns: Sequence[str] | None = None, target_rows: int | None = None) -> DataFrame:
    """Pearson of average ranks, per pair over its complete rows."""
    names = list(columns or numeric_columns(df))
    flat = df.select(*[as_double(df, c).alias(f"c{i}") for i, c in enumerate(names)])
    sizes = long_values(flat, [F.col(c) for c in flat.columns], nulls=True).groupBy("g").agg(
        F.count_if(F.col("v").isNull()).alias("missing"), F.approx_count_distinct("v").alias("distinct")
    )
    by = {r["g"]: r for r in sizes.collect()}  # one row per column
    if any(r["missing"] for r in by.values()) or not by:
        return _spearman_with_missing(df, names, target_rows)
    return _spearman_complete(flat, names, [by[i]["distinct"] for i in range(len(names))], target_rows)


def _spearman_with_missing(df: DataFrame, columns: Sequence[str], target_rows: int | None) -> DataFrame:
    """Each pair is ranked over its own complete rows, from its joint value counts."""
    joint, buckets = _joint_counts(df, columns, target_rows)
    pair = ["feature_a", "feature_b"]
    ranked = joint
    for v, b, r in (("x", "xb", "rx"), ("y", "yb", "ry")):
        marginal = joint.groupBy(*pair, v, b).agg(F.sum("n").alias("m"))
        totals = running_totals(marginal, pair, v, b, ["m"], split=buckets > 1)
        ranks = totals.select(*pair, v, (F.col("upto_m") - (F.col("m") - 1) / 2.0).alias(r))
        ranked = ranked.join(ranks, [*pair, v])
    middle = joint.groupBy(*pair).agg(((F.sum("n") + 1) / 2.0).alias("mid"))
    d = ranked.join(F.broadcast(middle), pair).withColumn("dx", F.col("rx") - F.col("mid")).withColumn("dy", F.col("ry") - F.col("mid"))
    n = F.col("n")
    return d.groupBy(*pair).agg(
        F.coalesce(
            F.try_divide(F.sum(n * F.col("dx") * F.col("dy")), F.sqrt(F.sum(n * F.col("dx") * F.col("dx")) * F.sum(n * F.col("dy") * F.col("dy")))),
            F.lit(0.0),
        ).alias("value")
    )


def _dense_ranks(joint: DataFrame, pair: Sequence[str], buckets: int) -> DataFrame:
    """(pair, x, r): the place of each distinct x of a pair, from 0."""
    distinct = joint.select(*pair, "x", "xb").distinct().withColumn("one", F.lit(1).cast("long"))
    return running_totals(distinct, [*pair], "x", "xb", ["one"], split=buckets > 1).select(*pair, "x", (F.col("upto_one") - 1).alias("r"))


def concordant_weight(ranked: DataFrame, pair: Sequence[str], bits: int, buckets: int) -> DataFrame:
    """(pair, p): sum of n_i * n_j over pairs of rows with r_i < r_j and y_i < y_j; ranks have at most ``bits`` bits.

    Two ranks part at exactly one digit of DIGIT bits: above it they agree, and there one has the smaller
    digit. For each digit, rows that agree above it are a node; along a node's y, running totals of every
    digit's weight say how much of the smaller digits lies below a row. A node is cut by y into buckets,
    so no window holds more than a bucket of one node, down to nodes of single values.
    """
    digits = range(math.ceil(max(bits, 1) / DIGIT))
    at = ranked.withColumn("level", F.explode(F.array(*map(F.lit, digits))))
    at = at.select(*pair, "level", F.expr(f"shiftright(r, (level + 1) * {DIGIT})").alias("node"), F.expr(f"shiftright(r, level * {DIGIT}) & {(1 << DIGIT) - 1}").alias("digit"), "yb", "y", "n")
    node = [*pair, "level", "node"]
    each = [f"w{d}" for d in range(1 << DIGIT)]
    sides = at.groupBy(*node, "yb", "y").agg(*(F.sum(F.when(F.col("digit") == d, F.col("n")).otherwise(0)).alias(w) for d, w in enumerate(each)))
    # a node of one digit holds no such pair
    run = running_totals(sides, node, "y", "yb", each[:-1], split=buckets > 1)
    below = [F.col(f"upto_{w}") - F.col(w) for w in each[:-1]]
    weight = sum((F.col(each[d]).cast("double") * sum(below[1:d], below[0]) for d in range(1, len(each))), F.lit(0.0))
    return run.groupBy(*pair).agg(F.sum(weight).alias("p"))


def kendall_pairs(df: DataFrame, columns: Sequence[str] | None = None, target_rows: int | None = None) -> DataFrame:
    """Kendall's tau-b per pair, from the weight of its concordant pairs and its ties."""
    joint, buckets = _joint_counts(df, columns, target_rows)
    joint = checkpointed(joint)
    pair = ["feature_a", "feature_b"]
    ranks = _dense_ranks(joint, pair, buckets)
    most = ranks.agg(F.max("r")).first()[0]
    ranked = joint.join(ranks, [*pair, "x"]).select(*pair, "r", "y", "yb", "n")
    concordant = concordant_weight(ranked, pair, int(most or 0).bit_length(), buckets)

    def ties(keys: list[str], name: str) -> DataFrame:
        m = joint.groupBy(*pair, *keys).agg(F.sum("n").cast("double").alias("m"))
        return m.groupBy(*pair).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias(name))

    size = joint.groupBy(*pair).agg(F.sum("n").cast("double").alias("rows")).withColumn("n0", F.col("rows") * (F.col("rows") - 1) / 2)
    all_ = size
    for keys, name in ((["x"], "n1"), (["y"], "n2"), (["x", "y"], "n3")):
        all_ = all_.join(F.broadcast(ties(keys, name)), pair)
    all_ = all_.join(F.broadcast(concordant), pair, "left").fillna(0.0, ["p"])
    q = F.col("n0") - F.col("n1") - F.col("n2") + F.col("n3") - F.col("p")
    bottom = F.sqrt((F.col("n0") - F.col("n1")) * (F.col("n0") - F.col("n2")))
    return all_.select(*pair, F.coalesce(F.try_divide(F.col("p") - q, bottom), F.lit(0.0)).alias("value"))


def correlation_matrix(df: DataFrame, method: str = "pearson", columns: Sequence[str] | None = None) -> DataFrame:
    """(feature_a, feature_b, value) for each pair of numeric columns."""
    if method == "pearson":
        return correlation_pairs(df, columns)
    if method == "spearman":
        return spearman_pairs(df, columns)
    if method == "kendall":
        return kendall_pairs(df, columns)
    raise ValueError(f"unknown correlation method {method}")
