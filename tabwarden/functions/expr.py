"""Small expression helpers: row identity, guarded division, correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.functions.types import clean, col, families


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, NULL when the denominator is 0 (ANSI-safe)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def _number(x) -> float | int | None:
    try:
        return x if isinstance(x, (int, float)) and not isinstance(x, bool) else float(str(x))
    except ValueError:
        return None


def among(df: DataFrame, column: str, values: Sequence) -> Column:
    """Whether a value is listed, NULL for a missing one.

    A NULL in the list matches nothing. Listed values are read in the column's family, so a text that is
    no number is simply not among the values of a numeric column.
    """
    v, fam = clean(df, column), families(df)[column]
    listed = [x for x in values if x is not None]
    if fam in ("int", "float"):
        listed = [x for x in map(_number, listed) if x is not None]
    elif fam == "string":
        listed = [str(x) for x in listed]
    return v.isin(listed) if listed else F.when(v.isNotNull(), F.lit(False))


def fingerprint(names: Sequence[str]) -> Column:
    """128-bit row identity over the named columns, NULLs equal to each other.

    ``xxhash64`` skips NULLs, so each value is preceded by its null flag;
    otherwise (NULL, 5) and (5, NULL) would collide. Two differently salted
    64-bit hashes keep accidental collisions out of reach at 10^12 rows, and the
    shuffle key stays 16 bytes however wide the row is.
    """
    parts: list[Column] = []
    for n in names:
        parts += [col(n).isNull(), col(n)]
    return F.struct(
        F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b")
    )


def value_identity(c: Column, is_text: bool) -> Column:
    """Fixed-width identity of one value, for distinct counts over long text."""
    if not is_text:
        return F.struct(F.xxhash64(c).alias("a"), F.lit(0).cast("long").alias("b"))
    return F.struct(F.xxhash64(F.lit(1), c).alias("a"), F.xxhash64(F.lit(2), c).alias("b"))


def md5_order(key: str) -> Column:
    """Repeatable pseudo-random ordering value of a key."""
    return F.md5(col(key).cast("string"))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: correlation over rows where both are present, NULL if degenerate.

    ``corr`` itself divides by zero on a constant column under ANSI mode; the
    moments are taken over pair-complete rows so all three use the same rows.
    """
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))


def pair_count(x: Column, y: Column) -> Column:
    return F.count_if(x.isNotNull() & y.isNotNull())


def worst(ranks: dict[str, int], label: Column) -> Column:
    """Integer rank of a severity label, by a literal map."""
    out = F.lit(None).cast("int")
    for name, rank in ranks.items():
        out = F.when(label == name, F.lit(rank)).otherwise(out)
    return out


def unranked(ranks: dict[str, int], rank: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, r in ranks.items():
        out = F.when(rank == r, F.lit(name)).otherwise(out)
    return out


def one_row_to_rows(agg: DataFrame, structs: list[Column]) -> DataFrame:
    """Turn the single row of a fused aggregate into one row per struct."""
    return agg.select(F.inline(F.array(*structs)))
