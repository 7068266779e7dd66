"""Repeatable samples, splits and folds, decided by a hash of the row's key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwarden.functions.expr import md5_order
from tabwarden.functions.types import clean, col

HASH_DIGITS = 15  # 60 bits
#: Rows of a class in one slice of the hash range, about, if the table were one class.
SLICE_ROWS = 100_000
#: Up to so many cut lists (16 bytes for each class and share) are broadcast.
BROADCAST_CLASSES = 100_000


def key_hash(key: str) -> Column:
    """First 60 bits of the key's md5 as a long; the same in every engine."""
    return F.conv(F.substring(md5_order(key), 1, HASH_DIGITS), 16, 10).cast("long")


def sample_fraction(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """A fixed share of the keys; the same rows on every run and partitioning, no shuffle."""
    return df.where(key_hash(key) < F.lit(int(fraction * 16**HASH_DIGITS)))


def sample_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """Exactly n rows (all when n covers the table): a distributed top-n by key hash."""
    return df.orderBy(md5_order(key), col(key)).limit(n)


def _cuts(rows: DataFrame, shares: Sequence[float], total: int) -> DataFrame:
    """(class, cuts): for each class the hash at the end of each share, -1 for an empty one. ``rows`` are (class, h).

    The hashes of a class fall evenly into slices of the hash range, so counting the slices tells which
    one holds a cut, and only that one is put in order.
    """
    slices = max(1, math.ceil(total / SLICE_ROWS))
    sliced = rows.withColumn("slice", F.floor(F.col("h").cast("double") / float(16**HASH_DIGITS) * slices))
    of_class = Window.partitionBy("class")
    counted = sliced.groupBy("class", "slice").agg(F.count("*").alias("n")).withColumns({
        "upto": F.sum("n").over(of_class.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)),
        "size": F.sum("n").over(of_class),
    })
    wanted = F.array(*[F.struct(F.lit(j).alias("j"), F.bround(F.lit(float(s)) * F.col("size")).cast("long").alias("k")) for j, s in enumerate(shares)])
    spots = counted.select("class", "slice", "upto", "n", F.explode(wanted).alias("w")).select("class", "slice", "w.j", "w.k", (F.col("w.k") - F.col("upto") + F.col("n")).alias("r"), "n", "upto")
    inside = spots.where((F.col("r") >= 1) & (F.col("r") <= F.col("n")))
    held = inside.groupBy(F.col("class").alias("c"), F.col("slice").alias("s")).agg(F.collect_list(F.struct("j", "r")).alias("spots"))
    place = F.row_number().over(Window.partitionBy("class", "slice").orderBy("h"))
    found = sliced.join(held, sliced["class"].eqNullSafe(F.col("c")) & (sliced["slice"] == F.col("s"))).withColumn("place", place)
    found = found.select("class", "place", "h", F.explode("spots").alias("x")).where("place = x.r").select("class", F.col("x.j").alias("j"), "h")
    classes = counted.select("class").distinct().withColumn("h", F.lit(-1).cast("long")).withColumn("j", F.explode(F.array(*[F.lit(j) for j in range(len(shares))])))
    best = found.unionByName(classes).groupBy("class", "j").agg(F.max("h").alias("h"))
    ordered = F.array_sort(F.collect_list(F.struct("j", "h")))
    return best.groupBy("class").agg(ordered["h"].alias("cuts"))


def stratified_parts(df: DataFrame, target: str, key: str, shares: Sequence[float], out: str = "part") -> DataFrame:
    """Number the rows of each class 0..k by cumulative ``shares`` of its key hashes.

    Each part has its exact share of every class, for any number of classes. The cut points are one row
    per class; up to BROADCAST_CLASSES of them reach the rows without a shuffle, more by a join that
    Spark splits where a class is large.
    """
    rows = df.select(clean(df, target).alias("class"), key_hash(key).alias("h"))
    cuts = _cuts(rows, shares, df.count()).select(F.col("class").alias("__class"), F.col("cuts").alias("__cuts"))
    few = rows.select("class").distinct().limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES
    joined = df.join(F.broadcast(cuts) if few else cuts, clean(df, target).eqNullSafe(F.col("__class")), "left")
    number = F.aggregate("__cuts", F.lit(0), lambda acc, c: acc + (key_hash(key) > c).cast("int"))
    return joined.withColumn(out, number).drop("__class", "__cuts")


def stratified_split(df: DataFrame, target: str, key: str, test_size: float = 0.2, out: str = "side") -> DataFrame:
    """Adds ``side``: "test" for ``test_size`` of each class, else "train"."""
    return stratified_parts(df, target, key, [test_size], "__part").withColumn(out, F.when(F.col("__part") == 0, "test").otherwise("train")).drop("__part")


def stratified_folds(df: DataFrame, target: str, key: str, folds: int = 5, out: str = "fold") -> DataFrame:
    """Adds ``fold`` 0..folds-1, of equal size within each class."""
    return stratified_parts(df, target, key, [i / folds for i in range(1, folds)], out)
