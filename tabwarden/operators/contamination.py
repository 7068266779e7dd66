"""Rows shared by train and test: exact copies and near copies."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwarden.functions.attach import attached
from tabwarden.functions.expr import fingerprint, ratio
from tabwarden.functions.types import as_double, common_columns, numeric_columns
from tabwarden.operators import leakage
from tabwarden.operators.near_vectors import RECALL, Matcher
from tabwarden.plans.schemas import DEFAULTS

DETECTOR = "contamination"
# Train vectors compared in one join group before the group is salted.
GROUP_ROWS = 50_000
# Up to so many columns near rows are found on an exact grid; every further one would triple a row's neighbouring cells.
GRID_COLUMNS = 4


def check_columns(
    train: DataFrame, test: DataFrame, target: str | None = None, columns: Sequence[str] | None = None, exclude: Sequence[str] = ()
) -> list[str]:
    shared = common_columns(train, test, exclude, target)
    return [c for c in columns if c in shared] if columns else shared


def rounded_for_match(df: DataFrame, columns: Sequence[str], digits: int | None) -> DataFrame:
    """Columns to compare; doubles optionally rounded so equal-looking values match."""
    if digits is None:
        return df.select(*[F.col(f"`{c}`") for c in columns])
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) if kinds[c] in ("double", "float") else F.col(f"`{c}`")).alias(c) for c in columns])


def exact_duplicates(
    train: DataFrame, test: DataFrame, target: str | None = None, columns: Sequence[str] | None = None,
    exclude: Sequence[str] = (), round_digits: int | None = None,
) -> DataFrame:
    """One row: distinct rows on both sides, test rows affected, ratios, sizes.

    Both tables are grouped together by a 16-byte row identity. The groups are
    combined per task before the shuffle, so a row copied a billion times is
    one record per task.
    """
    names = check_columns(train, test, target, columns, exclude)

    def side(df: DataFrame, in_train: int) -> DataFrame:
        return rounded_for_match(df, names, round_digits).select(fingerprint(names).alias("row"), F.lit(in_train).alias("t"))

    groups = side(train, 1).unionByName(side(test, 0)).groupBy("row").agg(F.sum("t").alias("a"), (F.count("*") - F.sum("t")).alias("b"))
    shared = (F.col("a") > 0) & (F.col("b") > 0)
    return groups.agg(
        F.count_if(shared).alias("exact_duplicates"),
        F.coalesce(F.sum(F.when(shared, F.col("b"))), F.lit(0)).alias("affected_test_rows"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("train_rows"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("test_rows"),
    ).select(
        "*",
        F.lit(len(names)).cast("long").alias("columns_checked"),
        F.coalesce(F.round(ratio(F.col("exact_duplicates"), F.col("test_rows")), 4), F.lit(0.0)).alias("duplicate_ratio"),
    )


def duplicated_test_rows(train: DataFrame, test: DataFrame, target: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The test rows that also occur in train.

    Train is reduced to distinct identities first; a semi join then keeps each
    test row at most once. Test rows of a frequent identity are not moved.
    """
    names = check_columns(train, test, target, columns)
    known = train.select(fingerprint(names).alias("__row")).distinct()
    both = ["__row.a", "__row.b"]
    rows = test.withColumn("__row", fingerprint(names)).withColumns({"__a": F.col(both[0]), "__b": F.col(both[1])}).drop("__row")
    return attached(rows, known.select(F.col(both[0]).alias("__a"), F.col(both[1]).alias("__b")), ["__a", "__b"], "left_semi").drop("__a", "__b")


def _unit_vector(df: DataFrame, names: Sequence[str]) -> Column:
    v = F.array(*[F.coalesce(as_double(df, c), F.lit(0.0)) for c in names])
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))  # zero vectors match nothing


def _cell(unit: Column, width: float) -> Column:
    return F.transform(unit, lambda x: F.floor(x / F.lit(width)))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def vector_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of the columns that hold arrays of numbers."""
    return [c for c in columns if isinstance(t := df.schema[c].dataType, T.ArrayType) and isinstance(t.elementType, T.NumericType)]


def near_duplicate_rows(
    train: DataFrame, test: DataFrame, columns: Sequence[str], threshold: float = DEFAULTS["near_duplicate_threshold"],
    group_rows: int = GROUP_ROWS, recall: float = RECALL,
) -> DataFrame:
    """(unit, n): test vectors with some train vector at cosine >= threshold, with row counts.

    ``columns`` are numeric columns, which together make a row's vector, or one column of arrays. A missing
    component counts as 0; a vector that is null, zero or holds an infinity matches nothing, nor do vectors
    of different lengths. Up to GRID_COLUMNS columns are searched on a grid that misses no pair; wider
    vectors by sign hashing, where a pair just at the threshold is missed with a chance of 1 - ``recall``
    and every pair found is checked exactly.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    if not vector_columns(train, columns) and len(columns) <= GRID_COLUMNS:
        return _near_on_grid(train, test, columns, threshold, group_rows)
    return _matcher(train, test, columns, threshold, recall).matched().groupBy("h1", "h2").agg(F.first("unit").alias("unit"), F.sum("n").alias("n")).select("unit", "n")


def _matcher(train: DataFrame, test: DataFrame, columns: Sequence[str], threshold: float, recall: float = RECALL) -> Matcher:
    arrays = vector_columns(train, columns)
    if arrays and len(columns) > 1:
        raise ValueError("near copies take numeric columns or one column of arrays")

    def side(df: DataFrame) -> DataFrame:
        return df.select((F.col(f"`{columns[0]}`") if arrays else F.array(*[as_double(df, c) for c in columns])).alias("v"))

    return Matcher(side(train), side(test), threshold, recall)


def near_duplicate_counts(train: DataFrame, test: DataFrame, columns: Sequence[str], threshold: float = DEFAULTS["near_duplicate_threshold"]) -> DataFrame:
    """(n): row counts that add up to those of ``near_duplicate_rows``, without the vectors."""
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    if not vector_columns(train, columns) and len(columns) <= GRID_COLUMNS:
        return near_duplicate_rows(train, test, columns, threshold).select("n")
    return _matcher(train, test, columns, threshold).matched(keep=False).select("n")


def _near_on_grid(train: DataFrame, test: DataFrame, columns: Sequence[str], threshold: float, group_rows: int) -> DataFrame:
    """Near rows of few columns, exactly. On unit vectors the threshold is a distance r = sqrt(2(1-t)).

    1. Space is cut into cells of diameter r. A test row in a cell that holds a
       train row is matched, whatever the cell's size; this settles the dense,
       heavily repeated regions by one equi-join on distinct cells.
    2. The other test vectors look at the neighbouring cells of a grid of width
       r. A semi join stops at the first match; cells with many train vectors
       are salted.
    """
    d = len(columns)
    r = math.sqrt(2 * (1 - threshold))
    fine = r / math.sqrt(d) * (1 - 1e-9)
    tr = train.select(_unit_vector(train, columns).alias("unit")).where("unit is not null").distinct()
    te = test.select(_unit_vector(test, columns).alias("unit")).where("unit is not null").groupBy("unit").agg(F.count("*").alias("n"))

    occupied = tr.select(_cell(F.col("unit"), fine).alias("cell")).distinct()
    te = te.withColumn("cell", _cell(F.col("unit"), fine))
    matched = te.join(occupied, "cell", "left_semi").select("unit", "n")
    rest = te.join(occupied, "cell", "left_anti").select("unit", "n")

    train_cells = tr.withColumn("g", _cell(F.col("unit"), r))
    salts = train_cells.groupBy("g").agg(F.ceil(F.count("*") / F.lit(float(group_rows))).alias("salts"))
    train_cells = train_cells.join(salts, "g").withColumn("salt", F.pmod(F.xxhash64("unit"), F.col("salts"))).select("g", "salt", F.col("unit").alias("other"))
    near = rest
    for i in range(d):
        here = F.floor(F.col("unit")[i] / F.lit(r))
        near = near.withColumn(f"g{i}", F.explode(F.array(here - 1, here, here + 1)))
    looks = near.select("unit", "n", F.array(*[f"g{i}" for i in range(d)]).alias("g")).join(salts, "g").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    a, b = looks.alias("a"), train_cells.alias("b")
    hit = (F.col("a.g") == F.col("b.g")) & (F.col("a.salt") == F.col("b.salt")) & (_dot(F.col("a.unit"), F.col("b.other")) >= threshold)
    found = a.join(b, hit, "left_semi").select("unit", "n").distinct()
    return matched.unionByName(found)


def near_duplicates(
    train: DataFrame, test: DataFrame, target: str | None = None, columns: Sequence[str] | None = None,
    threshold: float = DEFAULTS["near_duplicate_threshold"],
) -> DataFrame | None:
    """One row: near-duplicate test rows and test rows; None below two numeric columns.

    Asked for one column of arrays alone, compares these vectors.
    """
    shared = check_columns(train, test, target, columns)
    names = [c for c in shared if c in numeric_columns(train) and c in numeric_columns(test)]
    arrays = [c for c in vector_columns(train, shared) if c in vector_columns(test, shared)]
    if columns and len(shared) == len(arrays) == 1:
        names = arrays
    elif len(names) < 2:
        return None
    found = near_duplicate_counts(train, test, names, threshold)
    total = test.agg(F.count(F.lit(1)).alias("n")).scalar()
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("near_duplicates")).select("near_duplicates", total.alias("test_rows"))


def detect(
    train: DataFrame, test: DataFrame | None, target: str | None = None, columns: Sequence[str] | None = None,
    threshold: float = DEFAULTS["near_duplicate_threshold"], check_near: bool = True,
) -> DataFrame:
    """Findings: exact copies, and near copies whether or not there are exact ones."""
    spark = train.sparkSession
    if test is None:
        return leakage.rows(spark, [leakage.skipped(DETECTOR, "no test data")])
    exact = exact_duplicates(train, test, target, columns)
    row = exact.first()
    out = [leakage.rows(spark, [leakage.checked(spark, DETECTOR)])]
    if row["train_rows"] == 0 or row["test_rows"] == 0:
        return leakage.rows(spark, [(DETECTOR, "data_error", "warning", None, 0, None, None, "one side is empty")])
    if row["exact_duplicates"] > 0:
        out.append(
            leakage.rows(spark, [(
                DETECTOR, "train_test_contamination", "critical", None, row["exact_duplicates"], row["duplicate_ratio"], None,
                "Remove duplicate rows from train set or use group-aware splitting",
            )])
        )
    if check_near:
        near = near_duplicates(train, test, target, columns, threshold)
        if near is not None:
            hits = near.where("near_duplicates > 0")
            out.append(
                leakage.finding(
                    hits, DETECTOR, "near_duplicate_contamination", "warning", "Review near-duplicate rows and consider more strict splitting",
                    affected=F.col("near_duplicates"), score=ratio(F.col("near_duplicates"), F.col("test_rows")), threshold=threshold,
                )
            )
    return leakage.union(out)
