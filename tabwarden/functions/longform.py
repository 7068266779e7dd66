"""Several columns as (g, v) rows, with per-column parameters joined on.

One grouped aggregate over (g, v) serves any number of columns with the same
small generated code. Expressions repeated per column would soon exceed the
size the JVM compiles, and then run many times slower.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_values(df: DataFrame, values: Sequence[Column], keep: Sequence[Column] = (), nulls: bool = False) -> DataFrame:
    """(keep..., g, v): g is the position in ``values``; all must share one type."""
    rows = df.select(*keep, F.posexplode(F.array(*values)).alias("g", "v"))
    return rows if nulls else rows.where("v is not null")


def _edge_table(rows: DataFrame, edges: dict[int, Sequence[float]], width: int, kind: str) -> DataFrame:
    filled = [(g, *[float(x) if kind == "double" else x for x in e], *[None] * (width - len(e))) for g, e in edges.items()]
    return rows.sparkSession.createDataFrame(filled, "g int, " + ", ".join(f"e{j} {kind}" for j in range(width)))


def with_bin(rows: DataFrame, edges: dict[int, Sequence[float]], out: str = "bin") -> DataFrame:
    """Adds the number of edges at or below v; keeps the columns listed in ``edges``.

    The edge table has one row per column, so broadcasting it is bounded by the
    width of the table.
    """
    width = max((len(e) for e in edges.values()), default=0)
    table = _edge_table(rows, edges, max(width, 1), "double")
    hit = [F.coalesce((F.col("v") >= F.col(f"e{j}")).cast("int"), F.lit(0)) for j in range(width)]
    joined = rows.join(F.broadcast(table), "g").withColumn(out, reduce(lambda a, b: a + b, hit, F.lit(0)))
    return joined.drop(*[f"e{j}" for j in range(max(width, 1))])


def with_class(rows: DataFrame, edges: dict[int, Sequence[float]], out: str = "p") -> DataFrame:
    """Adds the class 0..2k of v among k edges: odd classes equal an edge, even ones lie between."""
    width = max((len(e) for e in edges.values()), default=0)
    table = _edge_table(rows, edges, max(width, 1), "double")
    d = F.col("v").cast("double")
    hit = [F.coalesce((d >= F.col(f"e{j}")).cast("int") + (d > F.col(f"e{j}")).cast("int"), F.lit(0)) for j in range(width)]
    joined = rows.join(F.broadcast(table), "g").withColumn(out, reduce(lambda a, b: a + b, hit, F.lit(0)))
    return joined.drop(*[f"e{j}" for j in range(max(width, 1))])


def names_table(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(g, feature), one row per column."""
    return df.sparkSession.createDataFrame(list(enumerate(names)), "g int, feature string")
