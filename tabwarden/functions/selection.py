"""Exact order statistics without sorting the table.

A global sort, or an exact ``percentile`` over a column of mostly distinct
values, would put the column into one task. Instead every value is read as a
64-bit key that orders like it, and a wanted rank is found by radix: the keys
between the least and the greatest of a class are cut into 2^BITS equal parts,
one scan counts each part exactly and notes its least and greatest key, and the
part that holds the rank is the next class. A round takes BITS bits off what a
class can span, or more, so no distribution of values needs more than 64 / BITS
rounds; a class of one key is known, and a class under the limit has its values
counted and ordered.
"""

from __future__ import annotations

import dataclasses
import math
import struct
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabwarden.functions.longform import long_values, with_class

# Most distinct values one aggregation buffer or one ordered group may hold.
MAX_DISTINCT = 200_000
#: Bits that a round takes off a class.
BITS = 8
_MANTISSA = 52
_LEAST_NORMAL = -1022


def order_keys(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Doubles replaced by longs that order like them: their bits, mirrored below zero. Both zeros are 0; NULL and NaN give NULL.

    In steps, so that logarithm and power are worked out once per value.
    """
    rest = [c for c in df.columns if c not in names]
    exponent = lambda c: F.least(F.greatest(F.floor(F.log2(F.abs(c))), F.lit(_LEAST_NORMAL)), F.lit(1023)).cast("int")
    df = df.select(*rest, *names, *(exponent(F.col(c)).alias(f"{c}_e") for c in names))
    df = df.select(*df.columns, *((F.abs(F.col(c)) / F.pow(F.lit(2.0), F.col(f"{c}_e"))).alias(f"{c}_m") for c in names))
    return df.select(*rest, *(_bits(F.col(c), F.col(f"{c}_e"), F.col(f"{c}_m")).alias(c) for c in names))


def _bits(value: Column, e: Column, m: Column) -> Column:
    a = F.abs(value)
    # the logarithm may be off by one next to a power of two
    e, m = e + F.when(m >= 2, 1).when(m < 1, -1).otherwise(0), F.when(m >= 2, m / 2).when(m < 1, m * 2).otherwise(m)
    bits = (
        F.when(a == 0, F.lit(0).cast("long"))
        .when(a == float("inf"), F.lit(2047 << _MANTISSA))
        .when(a < 2.0**_LEAST_NORMAL, (a * 2.0**537 * 2.0**537).cast("long"))
        .otherwise((e + 1023).cast("long") * F.lit(1 << _MANTISSA) + ((m - 1) * 2.0**_MANTISSA).cast("long"))
    )
    return F.when(F.isnan(value), F.lit(None)).when(value < 0, -bits).otherwise(bits)


def value_of(key: int) -> float:
    """The double of a key."""
    (v,) = struct.unpack("<d", struct.pack("<q", abs(key)))
    return -v if key < 0 else v


@dataclasses.dataclass
class _Class:
    """Keys lo to hi of a column: ``count`` rows, after ``before`` smaller ones, and the ranks wanted among them."""

    lo: int
    hi: int
    before: int
    count: int
    ranks: list[int]

    @property
    def shift(self) -> int:
        return max((self.hi - self.lo).bit_length() - BITS, 0)


class _Columns:
    """The columns as keys k0, k1, ...: integral columns are their own keys."""

    def __init__(self, df: DataFrame, cols: dict[str, Column]) -> None:
        self.names = list(cols)
        flat = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols.values())])
        self.integral = [isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) for f in flat.schema.fields]
        flat = flat.select(*[F.col(f"c{i}").cast("long" if whole else "double").alias(f"k{i}") for i, whole in enumerate(self.integral)])
        self.flat = order_keys(flat, [f"k{i}" for i, whole in enumerate(self.integral) if not whole])

    def value(self, g: int, key: int) -> float:
        return key if self.integral[g] else value_of(key)

    def rows(self, only) -> DataFrame:
        """(g, v): column number and key of every value of the columns in ``only``."""
        return long_values(self.flat, [F.col(f"k{g}") if g in only else F.lit(None).cast("long") for g in range(len(self.names))])

    def classed(self, classes: dict[int, list[_Class]]) -> DataFrame:
        """(g, v, p): the rows inside the classes, disjoint ones of each column, with their class's place p.

        The table of classes has one row per column, so broadcasting it is bounded by the width of the table.
        """
        width = max(len(c) for c in classes.values())
        spec = "g int, " + ", ".join(f"lo{j} long" for j in range(width)) + ", hi array<long>"
        data = []
        for g, cs in classes.items():
            cs.sort(key=lambda c: c.lo)
            data.append((g, *[c.lo for c in cs], *[None] * (width - len(cs)), [c.hi for c in cs]))
        table = F.broadcast(self.flat.sparkSession.createDataFrame(data, spec))
        place = sum((F.coalesce((F.col("v") >= F.col(f"lo{j}")).cast("int"), F.lit(0)) for j in range(width)), F.lit(-1))
        return self.rows(classes).join(table, "g").withColumn("p", place).where((F.col("p") >= 0) & (F.col("v") <= F.get("hi", F.col("p")))).select("g", "v", "p")

    def digits(self, classes: dict[int, list[_Class]]):
        """Per column, class and part of the class: rows, least and greatest key."""
        for cs in classes.values():
            cs.sort(key=lambda c: c.lo)
        spans = self.flat.sparkSession.createDataFrame([(g, [c.lo for c in cs], [c.shift for c in cs]) for g, cs in classes.items()], "g int, los array<long>, shifts array<int>")
        part = F.expr("shiftright(v - get(los, p), get(shifts, p))")
        return self.classed(classes).join(F.broadcast(spans), "g").groupBy("g", "p", part.alias("d")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()


def _sizes(cols: _Columns) -> dict[int, object]:
    """Rows, and the ends of the negative and the other keys of each column, one scan."""
    below = F.col("v") < 0
    rows = cols.rows(set(range(len(cols.names)))).groupBy("g").agg(
        F.count("*").alias("n"), F.count_if(below).alias("n_below"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.max(F.when(below, F.col("v"))).alias("hi_below"), F.min(F.when(~below, F.col("v"))).alias("lo_above"),
    )
    return {r["g"]: r for r in rows.collect()}


def _first_classes(size, ranks: Sequence[int]) -> list[_Class]:
    """Negative keys and the others: neither spans more than a long."""
    low, n = size["n_below"], size["n"]
    out = []
    if low:
        out.append(_Class(size["lo"], size["hi_below"], 0, low, [r for r in ranks if r < low]))
    if low < n:
        out.append(_Class(size["lo_above"], size["hi"], low, n - low, [r for r in ranks if r >= low]))
    return [c for c in out if c.ranks]


def _select(cols: _Columns, sizes: dict[int, object], ranks: dict[int, list[int]], limit: int) -> dict[tuple[int, int], float]:
    """{(g, rank): value}."""
    found: dict[tuple[int, int], float] = {}
    small: dict[int, list[_Class]] = {}
    open_ = {g: _first_classes(sizes[g], r) for g, r in ranks.items()}
    while True:
        wide: dict[int, list[_Class]] = {}
        for g, classes in open_.items():
            for c in classes:
                if c.lo == c.hi:
                    found.update({(g, r): cols.value(g, c.lo) for r in c.ranks})
                elif c.count <= limit:
                    small.setdefault(g, []).append(c)
                else:
                    wide.setdefault(g, []).append(c)
        if not wide:
            break
        parts: dict[tuple[int, int], list] = {}
        for row in cols.digits(wide):
            parts.setdefault((row["g"], row["p"]), []).append(row)
        open_ = {g: [part for p, c in enumerate(classes) for part in _holding(c, sorted(parts[g, p], key=lambda r: r["d"]))] for g, classes in wide.items()}
    found.update(_picked(cols, small))
    return found


def _holding(c: _Class, parts: list) -> list[_Class]:
    """The parts of a class that hold a wanted rank."""
    out, ends = [], list(accumulate((r["n"] for r in parts), initial=c.before))
    for row, before, end in zip(parts, ends, ends[1:]):
        ranks = [r for r in c.ranks if before <= r < end]
        if ranks:
            out.append(_Class(row["lo"], row["hi"], before, row["n"], ranks))
    return out


def _picked(cols: _Columns, classes: dict[int, list[_Class]]) -> dict[tuple[int, int], float]:
    """Values at the wanted ranks of small classes: value counts, ordered per class."""
    if not classes:
        return {}
    inside = cols.classed(classes)
    wanted = [(g, p, r, r - c.before) for g, cs in classes.items() for p, c in enumerate(cs) for r in c.ranks]
    running = inside.groupBy("g", "p", "v").agg(F.count("*").alias("n")).withColumn(
        "upto", F.sum("n").over(Window.partitionBy("g", "p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    )
    hits = running.join(F.broadcast(cols.flat.sparkSession.createDataFrame(wanted, "g int, p int, r long, o long")), ["g", "p"]).where((F.col("upto") > F.col("o")) & (F.col("upto") - F.col("n") <= F.col("o")))
    return {(row["g"], row["r"]): cols.value(row["g"], row["v"]) for row in hits.select("g", "r", "v").collect()}  # one row per wanted rank


def class_counts(df: DataFrame, cols: dict[str, Column], values: dict[str, Sequence[float]]) -> dict[str, dict[float, tuple[int, int]]]:
    """Per column and given value: rows below it and rows equal to it, one scan."""
    names = list(cols)
    edges = {g: sorted({float(v) for v in values[n]}) for g, n in enumerate(names) if values.get(n)}
    if not edges:
        return {}
    flat = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(cols.values())])
    rows = with_class(long_values(flat, [F.col(f"c{g}") if g in edges else F.lit(None) for g in range(len(names))]), edges)
    got = {(r["g"], r["p"]): r["n"] for r in rows.groupBy("g", "p").agg(F.count("*").alias("n")).collect()}
    out: dict[str, dict[float, tuple[int, int]]] = {}
    for g, e in edges.items():
        counts = [got.get((g, p), 0) for p in range(2 * len(e) + 1)]
        ends = list(accumulate(counts))
        out[names[g]] = {v: (ends[2 * i], counts[2 * i + 1]) for i, v in enumerate(e)}
    return out


def order_statistics(
    df: DataFrame, cols: dict[str, Column], ranks: dict[str, Sequence[int]], max_distinct: int | None = None
) -> dict[tuple[str, int], float]:
    """Exact value at each 0-based rank of each column's ascending non-null values; integral columns give integers."""
    wanted = {n: sorted(set(r)) for n, r in ranks.items() if len(r)}
    if not wanted:
        return {}
    c = _Columns(df, {n: cols[n] for n in wanted})
    sizes = _sizes(c)
    found = _select(c, sizes, {g: wanted[n] for g, n in enumerate(c.names) if g in sizes}, max_distinct or MAX_DISTINCT)
    return {(c.names[g], r): v for (g, r), v in found.items()}


def rank_positions(n: int, prob: float) -> tuple[int, int, float]:
    """Lower rank, upper rank and weight of the linear-interpolated quantile."""
    h = (n - 1) * prob
    lo = min(math.floor(h), n - 1)
    return lo, min(lo + 1, n - 1), h - lo


def exact_quantiles(
    df: DataFrame, cols: dict[str, Column], probs: Sequence[float], max_distinct: int | None = None
) -> dict[str, list[float] | None]:
    """Exact linear-interpolated quantiles per column; None for an all-null column.

    All columns share each scan of the radix selection.
    """
    if not cols:
        return {}
    c = _Columns(df, cols)
    sizes = _sizes(c)
    ranks = {g: sorted({x for p in probs for x in rank_positions(r["n"], p)[:2]}) for g, r in sizes.items()}
    at = _select(c, sizes, ranks, max_distinct or MAX_DISTINCT)
    out: dict[str, list[float] | None] = {n: None for n in c.names}
    for g, size in sizes.items():
        values = []
        for p in probs:
            lo, hi, w = rank_positions(size["n"], p)
            a, b = float(at[g, lo]), float(at[g, hi])
            values.append(a if a == b else a + (b - a) * w)
        out[c.names[g]] = values
    return out
