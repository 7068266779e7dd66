"""Missing values: per column, per row, and columns missing together."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.functions.types import clean, col, families
from tabwarden.plans.checks import Check, note
from tabwarden.plans.schemas import DEFAULTS

VALIDATOR = "completeness"

# Texts that may stand for a missing value (opt-in).
SENTINELS = (
    "", "null", "NULL", "None", "none", "N/A", "n/a", "NA", "na", "NaN", "nan",
    "-", "--", ".", "?", "#N/A", "#NA", "#VALUE!", "#REF!", "(blank)", "(empty)",
)


def is_missing(df: DataFrame, name: str, blank: bool = True, sentinels: Sequence[Any] | str | None = None) -> Column:
    """NULL or NaN; for text also blank; optionally a listed sentinel."""
    out = clean(df, name).isNull()
    text = families(df)[name] == "string"
    if blank and text:
        out = out | ~col(name).rlike(r"\S")  # stops at the first visible character
    values = SENTINELS if sentinels == "default" else sentinels
    if values:
        values = [v for v in values if isinstance(v, str) == text]
        if values:
            out = out | F.coalesce(clean(df, name).isin(list(values)), F.lit(False))
    return out


def split_columns(df: DataFrame, columns: Sequence[str] | None, exclude: Sequence[str]) -> tuple[list[str], list[str]]:
    """Known columns to check, and requested names the table does not have."""
    wanted = [c for c in (columns or df.columns) if c not in exclude]
    return [c for c in wanted if c in df.columns], [c for c in wanted if c not in df.columns]


def completeness_checks(
    df: DataFrame,
    threshold: float = DEFAULTS["missing_threshold"],
    column_thresholds: dict[str, float] | None = None,
    columns: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    sentinels: Sequence[Any] | str | None = None,
    min_valid_rows: float = DEFAULTS["min_valid_rows_ratio"],
) -> list[Check]:
    known, unknown = split_columns(df, columns, exclude)
    out = [note(VALIDATOR, "unknown_column", c, "warning", True, "column not found") for c in unknown]
    limits = column_thresholds or {}
    for c in known:
        missing = is_missing(df, c, sentinels=sentinels)
        out.append(
            Check(
                VALIDATOR, "missing", c, "warning", F.count_if(missing), threshold=limits.get(c, threshold),
                error_above=DEFAULTS["missing_error_ratio"], row_predicate=missing,
                message="missing values above threshold",
            )
        )
        n = F.count(F.lit(1))
        out.append(
            Check(
                VALIDATOR, "all_missing", c, "critical",
                F.when((n > 0) & (F.count_if(missing) == n), n).otherwise(F.lit(0)), message="column is entirely missing",
            )
        )
    if known:
        empty_row = _row_missing(df, known) == len(known)
        out.append(Check(VALIDATOR, "empty_rows", None, "error", F.count_if(empty_row), row_predicate=empty_row, message="all values missing"))
        n = F.count(F.lit(1))
        valid = F.try_divide(F.count_if(~empty_row).cast("double"), n.cast("double"))
        out.append(
            Check(
                VALIDATOR, "min_valid_rows", None, "critical",
                F.when(valid < min_valid_rows, F.lit(1)).otherwise(F.lit(0)), F.lit(1), message="too few rows with any value",
            )
        )
    return out


def column_missing(df: DataFrame, columns: Sequence[str] | None = None, sentinels: Sequence[Any] | str | None = None) -> DataFrame:
    """Per column: nulls, other missing values, missing ratio and completeness."""
    known, _ = split_columns(df, columns, ())
    aggs, rows = [F.count(F.lit(1)).alias("n")], []
    for i, c in enumerate(known):
        null = clean(df, c).isNull()
        aggs += [F.count_if(null).alias(f"s{i}"), F.count_if(is_missing(df, c, sentinels=sentinels)).alias(f"m{i}")]
        share = F.coalesce(F.try_divide(F.col(f"m{i}").cast("double"), F.col("n").cast("double")), F.lit(0.0))
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(families(df)[c]).alias("dtype"),
                F.col(f"m{i}").alias("missing_count"),
                F.col(f"s{i}").alias("standard_nulls"),
                (F.col(f"m{i}") - F.col(f"s{i}")).alias("additional_missing"),
                F.col("n").alias("total_count"),
                F.round(share, 4).alias("missing_ratio"),
                F.round(1 - share, 4).alias("completeness"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def missing_summary(df: DataFrame) -> DataFrame:
    """Nulls per column, worst first."""
    out = column_missing(df).select(
        "column", "dtype", F.col("standard_nulls").alias("missing_count"), "total_count"
    )
    share = F.coalesce(F.try_divide(F.col("missing_count").cast("double"), F.col("total_count").cast("double")), F.lit(0.0))
    return out.select(
        "*", F.round(share, 4).alias("missing_ratio"), F.round(1 - share, 4).alias("completeness")
    ).orderBy(F.desc("missing_ratio"), "column")


def overall_completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    per = column_missing(df, columns)
    cells = F.sum("total_count")
    return per.agg(
        cells.alias("total_cells"),
        F.sum("missing_count").alias("total_missing"),
        F.round(1 - F.coalesce(F.try_divide(F.sum("missing_count").cast("double"), cells.cast("double")), F.lit(0.0)), 4).alias(
            "overall_completeness"
        ),
    )


def _row_missing(df: DataFrame, columns: Sequence[str]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + clean(df, c).isNull().cast("int")
    return total


def row_completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    known, _ = split_columns(df, columns, ())
    n = df.select(_row_missing(df, known).alias("m"))
    return n.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("m") == len(known)).alias("rows_with_all_missing"),
        F.count_if(F.col("m") > 0).alias("rows_with_any_missing"),
        F.count_if(F.col("m") == 0).alias("rows_complete"),
        F.round(F.avg("m"), 2).alias("avg_missing_per_row"),
    )


def co_missing_pairs(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    threshold: float = DEFAULTS["co_missing_jaccard"],
    min_rows: int = DEFAULTS["co_missing_min_rows"],
) -> DataFrame:
    """Pairs of columns whose missing rows overlap (Jaccard above threshold).

    Rows are first collapsed to their distinct missingness masks with counts;
    pairs are then formed over the missing columns of the masks, not over the rows.
    """
    known, _ = split_columns(df, columns, ())
    flags = [clean(df, c).isNull().alias(f"f{i}") for i, c in enumerate(known)]
    masks = df.select(*flags).groupBy(*[f"f{i}" for i in range(len(known))]).agg(F.count("*").alias("n"))
    if len(known) < 2:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, both_missing long, either_missing long, jaccard double")
    holes = F.array_compact(F.array(*[F.when(F.col(f"f{i}"), F.lit(i)) for i in range(len(known))]))
    missing = masks.select("n", holes.alias("holes"))
    total, *alone = masks.agg(F.coalesce(F.sum("n"), F.lit(0)), *[F.coalesce(F.sum(F.when(F.col(f"f{i}"), F.col("n"))), F.lit(0)) for i in range(len(known))]).first()
    if total < min_rows:
        missing = missing.limit(0)
    # only pairs missing together in a mask are formed; the rest of a union follows from the columns' own counts
    both = missing.select("n", "holes", F.explode("holes").alias("i")).select("n", "i", F.explode(F.filter("holes", lambda j: j > F.col("i"))).alias("j"))
    per = both.groupBy("i", "j").agg(F.sum("n").alias("both_missing"))
    table = F.broadcast(df.sparkSession.createDataFrame([(i, c, int(k)) for i, (c, k) in enumerate(zip(known, alone))], "i int, name string, k long"))
    side = lambda i, c, k: table.select(F.col("i").alias(i), F.col("name").alias(c), F.col("k").alias(k))
    out = per.join(side("i", "column_a", "ka"), "i").join(side("j", "column_b", "kb"), "j").withColumn("either_missing", F.col("ka") + F.col("kb") - F.col("both_missing"))
    jaccard = F.try_divide(F.col("both_missing").cast("double"), F.col("either_missing").cast("double"))
    return out.select("column_a", "column_b", "both_missing", "either_missing", F.round(jaccard, 4).alias("jaccard"), jaccard.alias("j")).where(
        F.col("j") > threshold
    ).drop("j")
