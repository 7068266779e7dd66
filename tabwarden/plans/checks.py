"""Checks, and how a set of them becomes one scan.

A row check is a boolean expression; its violations are counted. All row and
aggregate checks over one table share a single ``agg`` - one scan, one tiny
shuffle, whatever the number of checks. Checks that must shuffle by value
(uniqueness, foreign keys) bring their own one-row frame and are unioned on.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.plans.schemas import CHECK_RESULTS

# Aggregates side by side in one select; beyond this the generated code stops compiling well, and rows name the checks they raise.
SIDE_BY_SIDE = 300


@dataclass(frozen=True)
class Check:
    """One measured expectation.

    ``violations`` is an aggregate (usually ``count_if``) and ``total`` the
    aggregate it is measured against (default: all rows). The check is raised
    when the ratio is strictly above ``threshold``; above ``error_above`` its
    severity becomes error.
    """

    validator: str
    check: str
    column: str | None
    severity: str
    violations: Column | None = None
    total: Column | None = None
    threshold: float = 0.0
    error_above: float | None = None
    message: str = ""
    frame: DataFrame | None = None  # one row: violations, total
    row_predicate: Column | None = None  # for listing violating rows
    skipped: bool = False
    may_fail: bool = False  # a user's expression: a value may raise an error


def row_check(
    validator: str, check: str, column: str | None, severity: str, violation: Column, message: str = "", **kw
) -> Check:
    """A check that counts the rows where ``violation`` is true (NULL is no violation)."""
    return Check(
        validator, check, column, severity, F.count_if(violation), message=message, row_predicate=violation, **kw
    )


def note(validator: str, check: str, column: str | None, severity: str, raised: bool, message: str = "") -> Check:
    """A finding known from the schema alone; reported beside the data checks."""
    return Check(validator, check, column, severity, F.lit(int(raised)).cast("long"), F.lit(1).cast("long"), message=message)


def skip(validator: str, check: str, message: str) -> Check:
    return Check(validator, check, None, "info", F.lit(0).cast("long"), message=message, skipped=True)


def guarded(validator: str, check: str, column: str | None, build: Callable[[], Check | list[Check]]) -> list[Check]:
    """Build checks; an analysis error becomes a failed row instead of ending the run."""
    try:
        built = build()
        return built if isinstance(built, list) else [built]
    except (PySparkException, re.error, ValueError, KeyError, TypeError) as e:
        condition = e.getCondition() if isinstance(e, PySparkException) else None
        return [note(validator, check, column, "error", True, condition or f"{type(e).__name__}: {e}")]


# What is known of a check before any data is read; joined to its counts.
_FACTS = "i int, validator string, check string, column string, severity string, threshold double, error_above double, message string, skipped boolean"


def _fused(df: DataFrame, checks: list[tuple[int, Check]]) -> DataFrame:
    """(i, violations, total) of checks that are no frames: one scan, whatever their number."""
    if len(checks) > SIDE_BY_SIDE:
        return _named_by_rows(df, checks)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in checks:
        aggs.append(c.violations.cast("long").alias(f"v{i}"))
        if c.total is not None:
            aggs.append(c.total.cast("long").alias(f"t{i}"))
    counts = [F.struct(F.col(f"v{i}").alias("violations"), F.col(f"t{i}" if c.total is not None else "n").alias("total")) for i, c in checks]
    numbers = F.array(*[F.lit(i) for i, _ in checks])
    pairs = F.arrays_zip(numbers.alias("i"), F.array(*counts).alias("m"))
    return df.agg(*aggs).select(F.explode(pairs).alias("x")).select("x.i", "x.m.violations", "x.m.total")


def _named_by_rows(df: DataFrame, checks: list[tuple[int, Check]]) -> DataFrame:
    """As ``_fused``, with the row checks as numbers: every row lists those it violates, and -1 once.

    The numbers are counted by one grouped aggregate, combined in each task before its tiny shuffle. The
    group of -1 has every row once, so the other aggregates are read from it.
    """
    by_row = [(i, c) for i, c in checks if c.row_predicate is not None]
    other = [(f"v{i}", c.violations) for i, c in checks if c.row_predicate is None] + [(f"t{i}", c.total) for i, c in checks if c.total is not None]
    raised = F.array_compact(F.array(F.lit(-1), *[F.when(c.row_predicate, F.lit(i)) for i, c in by_row]))
    key = "raised"
    while key in {c.lower() for c in df.columns}:
        key += "_"
    counts = df.select("*", F.explode(raised).alias(key)).groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[c.cast("long").alias(name) for name, c in other])
    whole = F.col(key) == -1
    once = lambda name: F.max(F.when(whole, F.col(name))).alias(name)
    row = counts.agg(F.map_from_entries(F.collect_list(F.struct(key, "n"))).alias("by"), once("n"), *[once(name) for name, _ in other])
    zero = F.lit(0).cast("long")
    violations = [F.coalesce(F.try_element_at("by", F.lit(i)), zero) if c.row_predicate is not None else F.col(f"v{i}") for i, c in checks]
    totals = [F.col(f"t{i}") if c.total is not None else F.coalesce("n", zero) for i, c in checks]
    found = F.array(*[F.struct(F.lit(i).alias("i"), v.alias("violations"), t.alias("total")) for (i, _), v, t in zip(checks, violations, totals)])
    return row.select(F.explode(found).alias("x")).select("x.*")


def _tried(df: DataFrame, checks: list[Check]) -> list[Check]:
    """Checks with users' expressions that raise on some value become failed rows.

    All of them are tried in one scan. While one fails, halves are tried, so a few bad expressions among
    many cost a few scans each.
    """
    def error(some: list[Check]) -> str | None:
        try:
            df.agg(*[c.violations.cast("long").alias(f"v{i}") for i, c in enumerate(some)]).collect()
            return None
        except PySparkException as e:
            return e.getCondition() or type(e).__name__

    def failing(some: list[Check]) -> dict[int, str]:
        why = error(some) if some else None
        if why is None:
            return {}
        if len(some) == 1:
            return {id(some[0]): why}
        half = len(some) // 2
        return failing(some[:half]) | failing(some[half:])

    found = failing([c for c in checks if c.may_fail])
    return [note(c.validator, c.check, c.column, "error", True, found[id(c)]) if found.get(id(c)) else c for c in checks]


def run(df: DataFrame, checks: Iterable[Check]) -> DataFrame:
    """CHECK_RESULTS of all checks: one scan for the fused ones, one shuffle for each frame."""
    numbered = list(enumerate(_tried(df, list(checks))))
    if not numbered:
        return df.sparkSession.createDataFrame([], CHECK_RESULTS)
    plain = [(i, c) for i, c in numbered if c.frame is None]
    parts = [_fused(df, plain)] if plain else []
    for i, c in numbered:
        if c.frame is not None:
            parts.append(c.frame.select(F.lit(i).alias("i"), F.col("violations").cast("long").alias("violations"), F.col("total").cast("long").alias("total")))
    facts = [(i, c.validator, c.check, c.column, c.severity, float(c.threshold), c.error_above, c.message, c.skipped) for i, c in numbered]
    known = df.sparkSession.createDataFrame(facts, _FACTS)
    share = F.coalesce(F.try_divide(F.col("violations").cast("double"), F.col("total").cast("double")), F.lit(0.0))
    measured = reduce(DataFrame.unionByName, parts).join(F.broadcast(known), "i").withColumn("ratio", share)
    raised = F.col("ratio") > F.col("threshold")
    severity = F.when(F.col("ratio") > F.col("error_above"), "error").otherwise(F.col("severity"))
    status = (
        F.when(F.col("skipped"), "skipped")
        .when(~raised | (severity == "info"), "passed")
        .when(severity == "warning", "warning")
        .otherwise("failed")
    )
    return measured.select(
        "validator", "check", "column", severity.alias("severity"), status.alias("status"),
        F.when(raised, F.col("violations")).otherwise(F.lit(0)).cast("long").alias("violations"), "total", "ratio", "threshold", "message",
    )


def issues(results: DataFrame) -> DataFrame:
    """The raised checks only."""
    return results.where(F.col("violations") > 0)


def violating_rows(df: DataFrame, checks: Iterable[Check], key_cols: list[str], limit: int = 10) -> DataFrame:
    """Keys of violating rows, at most ``limit`` per check, lowest keys first.

    The per-check cap is applied on the map side (window group limit), so only
    ``limit`` rows per check and partition are shuffled.
    """
    from pyspark.sql.window import Window

    from tabwarden.functions.types import col

    row_checks = [c for c in checks if c.row_predicate is not None]
    hits = F.array(
        *[
            F.when(
                c.row_predicate,
                F.struct(
                    F.lit(c.check).alias("check"),
                    (col(c.column).cast("string") if c.column else F.lit(None).cast("string")).alias("value"),
                ),
            )
            for c in row_checks
        ]
    )
    keys = [col(k).alias(k) for k in key_cols]
    w = Window.partitionBy("check").orderBy(*[F.col(k) for k in key_cols])
    return (
        df.select(*keys, F.explode(hits).alias("hit"))
        .where("hit is not null")
        .select(F.col("hit.check").alias("check"), *key_cols, F.col("hit.value").alias("value"))
        .withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= limit)
        .drop("rn")
    )
