"""Time leakage: overlapping splits, look-ahead columns, row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwarden.functions.ordering import order_buckets
from tabwarden.functions.types import SPLIT_TIME_NAMES, as_timestamp, col, detect_time_column, micros
from tabwarden.operators import leakage

DETECTOR = "temporal"

# Name parts that point at the future.
LOOK_AHEAD = ("_next", "_future", "_forward", "_tomorrow", "_t+")


def time_ranges(train: DataFrame, test: DataFrame, time_column: str) -> DataFrame:
    """(side, earliest, latest, rows) of both sides."""
    def one(df: DataFrame, side: str) -> DataFrame:
        return df.select(F.lit(side).alias("side"), as_timestamp(df, time_column).alias("ts"))

    both = one(train, "train").unionByName(one(test, "test"))
    return both.groupBy("side").agg(F.min("ts").alias("earliest"), F.max("ts").alias("latest"), F.count("ts").alias("rows"))


def split_overlap(train: DataFrame, test: DataFrame, time_column: str) -> DataFrame:
    """One row: test rows before the end of train, train rows after the start of test.

    Each side's bound is a scalar subquery over the other side, so no rows are joined.
    """
    end = train.agg(F.max(as_timestamp(train, time_column)).alias("m")).scalar()
    start = test.agg(F.min(as_timestamp(test, time_column)).alias("m")).scalar()
    early = test.select(as_timestamp(test, time_column).alias("ts")).agg(F.count_if(F.col("ts") < end).alias("overlap"))
    late = train.select(as_timestamp(train, time_column).alias("ts")).agg(F.count_if(F.col("ts") > start).alias("future"))
    return early.select(F.col("overlap").alias("temporal_overlap"), late.scalar().alias("future_in_train"))


def look_ahead_columns(df: DataFrame, time_column: str | None, extra: Sequence[str] = ()) -> list[str]:
    named = [c for c in df.columns if c != time_column and any(p in c.lower() for p in LOOK_AHEAD)]
    return sorted(set(named) | {c for c in extra if c in df.columns})


def time_order(df: DataFrame, time_column: str, sequence: str, target_rows: int | None = None) -> DataFrame:
    """One row: steps down, steps up and whether time is monotone in ``sequence`` order.

    Rows sharing a sequence value are one step with a range of times. Steps are
    compared inside sequence buckets; borders are compared on one row per bucket.
    """
    rows = df.select(col(sequence).alias("seq"), micros(as_timestamp(df, time_column)).alias("t")).where("seq is not null and t is not null")
    steps = (
        rows.groupBy("seq").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n"))
    )
    w = Window.partitionBy("bucket").orderBy("seq")
    local = order_buckets(steps, "seq", target_rows=target_rows, source=rows).withColumn("p_lo", F.lag("lo").over(w)).withColumn("p_hi", F.lag("hi").over(w))
    down, up = F.col("lo") < F.col("p_hi"), F.col("hi") > F.col("p_lo")
    per = local.groupBy("bucket").agg(
        F.count_if(down).alias("down"), F.count_if(up).alias("up"), F.sum("n").alias("n"),
        F.min_by(F.struct("lo", "hi"), "seq").alias("first"), F.max_by(F.struct("lo", "hi"), "seq").alias("last"),
    )
    border = Window.partitionBy(F.lit(0)).orderBy("bucket")  # one row per bucket
    chained = per.withColumn("prev", F.lag("last").over(border))
    total = chained.agg(
        (F.sum("down") + F.count_if(F.col("first.lo") < F.col("prev.hi"))).alias("steps_down"),
        (F.sum("up") + F.count_if(F.col("first.hi") > F.col("prev.lo"))).alias("steps_up"),
        F.sum("n").alias("rows"),
    )
    return total.select("rows", "steps_down", "steps_up", ((F.col("steps_down") == 0) | (F.col("steps_up") == 0)).alias("is_time_sorted"))


def detect(
    train: DataFrame, test: DataFrame | None = None, time_column: str | None = None, look_ahead: Sequence[str] = (), sequence: str | None = None
) -> DataFrame:
    spark = train.sparkSession
    name = time_column or detect_time_column(train, SPLIT_TIME_NAMES)
    if not name or name not in train.columns:
        return leakage.rows(spark, [leakage.skipped(DETECTOR, "no time column")])
    found = [leakage.checked(spark, DETECTOR)]
    found += [(DETECTOR, "look_ahead_bias", "warning", c, 0, None, None, "Verify these features don't contain future information") for c in look_ahead_columns(train, name, look_ahead)]
    parts = [leakage.rows(spark, found)]
    if test is not None and name in test.columns:
        both = split_overlap(train, test, name)
        parts += [
            leakage.finding(both.where("temporal_overlap > 0"), DETECTOR, "temporal_overlap", "critical", "Ensure proper time-based train/test split", affected=F.col("temporal_overlap")),
            leakage.finding(both.where("future_in_train > 0"), DETECTOR, "future_in_train", "critical", "Remove future data from training set", affected=F.col("future_in_train")),
        ]
    if sequence:
        unsorted = time_order(train, name, sequence).where("rows >= 2 and not is_time_sorted")
        parts.append(leakage.finding(unsorted, DETECTOR, "temporal_ordering", "info", "Consider sorting data by time for time-series analysis"))
    return leakage.union(parts)
