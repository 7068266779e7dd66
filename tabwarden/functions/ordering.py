"""Global order in bounded groups.

A window without ``partitionBy`` sends the whole table to one task. Here the
order column is cut into buckets of about equal size, at values proposed by a
sketch and then fixed as literals, so every branch of a plan, and every retry
after a lost executor, sees the same buckets. Windows run inside a bucket;
what crosses a bucket border is carried by a table with one row per bucket.

A value frequent enough to fill several buckets gets buckets of its own, cut
again by the tie-breaking key, so no single value can overload one task.

One pass cuts into at most FAN buckets. Those still too large are cut again by
quantiles of their own, and so on, so buckets stay of one size however large
the table is.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwarden.sources.storage import checkpointed

TARGET_ROWS = 1_000_000
#: Parts that one pass cuts a bucket into.
FAN = 1_000
#: Cut points (8 bytes each) up to which their table is broadcast.
MAX_BROADCAST = 4_000_000
_EXACT = float(2**53)


def _splits(edges: list[float]) -> tuple[list[float], list[float]]:
    """Strictly increasing cut points, and the values that repeat among the edges."""
    hot = sorted({e for e in edges if edges.count(e) > 1 and abs(e) < _EXACT})
    cuts = set(edges) | {math.nextafter(h, math.inf) for h in hot}
    return [-math.inf, *sorted(cuts), math.inf], hot


def _bucketize(df: DataFrame, source: str, out: str, splits: list[float]) -> DataFrame:
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0).cast("long"))
    b = Bucketizer(splits=splits, inputCol=source, outputCol=out, handleInvalid="keep")
    return b.transform(df).withColumn(out, F.col(out).cast("long"))


def _first_cut(df: DataFrame, source: str, out: str, parts: int, measured: DataFrame) -> DataFrame:
    probs = [i / parts for i in range(1, parts)]
    edges = [float(e) for e in measured.agg(F.percentile_approx(source, probs, max(10_000, 10 * parts))).first()[0] or []]
    return _bucketize(df, source, out, _splits(edges)[0])


def _place(df: DataFrame, source: str, edges: str, out: str) -> DataFrame:
    """Add twice the number of edges below the value, plus one if it equals the next; the edges are ascending and distinct."""
    df = df.withColumn(out, F.lit(0))
    step = 1 << FAN.bit_length() - 1
    while step:  # halving; a column per step, so that no expression is worked out twice
        df = df.withColumn(out, F.col(out) + F.when(F.get(edges, F.col(out) + F.lit(step - 1)) < F.col(source), step).otherwise(0))
        step >>= 1
    return df.withColumn(out, 2 * F.col(out) + F.coalesce((F.get(edges, F.col(out)) == F.col(source)).cast("int"), F.lit(0)))


def refined(df: DataFrame, source: str, bucket: str, target: int) -> DataFrame:
    """Cut the buckets of more than ``target`` rows by quantiles of ``source`` of their own, until each is small or of one value.

    ``bucket`` keeps rising with ``source``. The cut points are checkpointed, so that all users of the
    result see the same ones.
    """
    probs = [i / FAN for i in range(1, FAN)]
    while True:
        sized = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("__n"), F.min(source).alias("__lo"), F.max(source).alias("__hi"), F.percentile_approx(source, probs, 10 * FAN).alias("__e"))
        stride = F.greatest(F.lit(1), F.floor(F.lit(float(FAN) * target) / F.col("__n")))  # no more parts than rows call for
        some = F.array_distinct(F.filter("__e", lambda x, i: i % stride == 0))
        wide = checkpointed(sized.where((F.col("__n") > target) & (F.col("__lo") < F.col("__hi"))).select(bucket, some.alias("__e")))
        many = wide.count()
        if not many:
            return df
        names = df.columns
        cut = _place(df.join(F.broadcast(wide) if many * FAN <= MAX_BROADCAST else wide, bucket, "left"), source, "__e", "__p")
        df = cut.withColumn(bucket, F.col(bucket) * F.lit(2 * FAN) + F.col("__p")).select(names)


def order_buckets(
    df: DataFrame, order: str, key: str | None = None, target_rows: int | None = None, out: str = "bucket", source: DataFrame | None = None
) -> DataFrame:
    """Add a long ``out`` column that rises with (order, key); rows with NULL order are dropped.

    ``order`` must be numeric (use microseconds for time). ``key`` breaks ties
    and, when numeric, splits values that fill more than one bucket. ``source``
    is a cheaper frame with the same order column to take the first cut points
    from, such as the rows before a grouping.
    """
    target = target_rows or TARGET_ROWS
    base = df.where(F.col(order).isNotNull()).withColumn("__o", F.col(order).cast("double"))
    measured = base if source is None else source.where(F.col(order).isNotNull()).withColumn("__o", F.col(order).cast("double"))
    n = measured.count()
    k = math.ceil(n / target) if n else 1
    if k <= 1:
        return base.withColumn(out, F.lit(0).cast("long")).drop("__o")
    base = _first_cut(base, "__o", out, min(FAN, k), measured)
    if k > FAN:
        base = refined(base, "__o", out, 2 * target)
    if key is not None and dict(df.dtypes)[key] in ("bigint", "int", "smallint", "tinyint", "double", "float"):
        base = _split_by_key(base, key, out, target)
    return base.drop("__o")


def _split_by_key(base: DataFrame, key: str, out: str, target: int) -> DataFrame:
    """Buckets of one value with over twice the rows are cut by the key; the others keep their order around them."""
    sized = base.groupBy(out).agg(F.count(F.lit(1)).alias("__n"), F.min("__o").alias("__lo"), F.max("__o").alias("__hi"))
    hot = checkpointed(sized.where((F.col("__n") > 2 * target) & (F.col("__lo") == F.col("__hi"))).select(out, F.lit(True).alias("__hot")))
    many = hot.count()
    if not many:
        return base
    names = base.columns
    base = base.join(F.broadcast(hot) if many <= MAX_BROADCAST else hot, out, "left").withColumn("__k", F.when(F.col("__hot"), F.col(key).cast("double")))
    return refined(base.withColumn(out, F.col(out) * F.lit(2 * FAN)), "__k", out, 2 * target).select(names)


def value_buckets(df: DataFrame, columns: list[str], target_rows: int | None = None) -> tuple[DataFrame, int]:
    """Add ``<name>__b`` per numeric column, an order-preserving bucket of its value.

    Returns the frame and about how many bucket ids are in use; small tables
    have one. A value filling several buckets gets one of its own, where
    grouping by value leaves a single row of it.
    """
    target = target_rows or TARGET_ROWS
    n = df.count()
    k = math.ceil(n / target) if n else 1
    if k <= 1 or not columns:
        for c in columns:
            df = df.withColumn(c + "__b", F.lit(0).cast("long"))
        return df, 1
    parts = min(FAN, k)
    probs = [i / parts for i in range(1, parts)]
    row = df.agg(
        *[F.percentile_approx(F.col(f"`{c}`").cast("double"), probs, max(10_000, 10 * parts)).alias(f"e{i}") for i, c in enumerate(columns)]
    ).first()
    ids = 1
    for i, c in enumerate(columns):
        splits, _ = _splits([float(e) for e in (row[f"e{i}"] or [])])
        ids = max(ids, len(splits))
        names = [*df.columns, c + "__b"]
        df = _bucketize(df.withColumn("__v", F.col(f"`{c}`").cast("double")), "__v", c + "__b", splits)
        if k > FAN:
            df = refined(df, "__v", c + "__b", 2 * target)
        df = df.select(*[f"`{x}`" for x in names])
    return df, max(ids, k)


def running_totals(
    counts: DataFrame, groups: list[str], value: str, bucket: str, measures: list[str], split: bool = True
) -> DataFrame:
    """Add ``upto_<measure>``: the total up to and including the value, within each group.

    ``counts`` has one row per (group, value). The window runs inside a bucket;
    totals of the earlier buckets come from a table with one row per group and
    bucket. With ``split=False`` there is a single bucket and that step is left out.
    """
    inner = Window.partitionBy(*groups, bucket).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = counts
    for m in measures:
        local = local.withColumn(f"upto_{m}", F.sum(m).over(inner))
    if not split:
        return local
    outer = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*groups, bucket).agg(*[F.sum(m).alias(f"t_{m}") for m in measures])
    before = totals.select(
        *groups, bucket, *[F.coalesce(F.sum(f"t_{m}").over(outer), F.lit(0)).alias(f"before_{m}") for m in measures]
    )
    joined = local.join(before, [*groups, bucket])
    for m in measures:
        joined = joined.withColumn(f"upto_{m}", F.col(f"upto_{m}") + F.col(f"before_{m}")).drop(f"before_{m}")
    return joined
