"""Type families, missing-value normalisation and name lists."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names taken as a time column when no column has a time type.
FRESHNESS_TIME_NAMES = (
    "timestamp", "datetime", "date", "time", "created_at", "updated_at",
    "created", "modified", "event_time", "event_date",
)
SPLIT_TIME_NAMES = (
    "timestamp", "datetime", "date", "time", "created_at",
    "event_time", "event_date", "ts", "dt",
)


def col(name: str) -> Column:
    """Column by exact name, safe for names with dots, spaces or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def family(dtype: T.DataType) -> str:
    """Type family of a Spark type: int, float, string, bool, datetime or nested."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "nested"


# Names a contract may use for a type, with the families they accept.
FAMILY_ALIASES = {
    "int": ("int",),
    "float": ("float",),
    "string": ("string",),
    "bool": ("bool",),
    "datetime": ("datetime",),
    "category": ("string",),
    "numeric": ("int", "float"),
}


def families(df: DataFrame) -> dict[str, str]:
    return {f.name: family(f.dataType) for f in df.schema.fields}


def columns_in(df: DataFrame, wanted: Iterable[str], exclude: Iterable[str] = ()) -> list[str]:
    """Columns whose family is in ``wanted``, in table order, without ``exclude``."""
    wanted, skip = set(wanted), set(exclude)
    return [n for n, fam in families(df).items() if fam in wanted and n not in skip]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return columns_in(df, ("int", "float"), exclude)


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return columns_in(df, ("string", "bool"), exclude)


def atomic_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return columns_in(df, ("int", "float", "string", "bool", "datetime"), exclude)


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN folded into NULL, so both count as missing."""
    c = col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(c), F.lit(None)).otherwise(c)
    return c


def as_double(df: DataFrame, name: str) -> Column:
    return clean(df, name).cast("double")


def common_columns(
    left: DataFrame, right: DataFrame, exclude: Sequence[str] = (), target: str | None = None
) -> list[str]:
    """Sorted names present on both sides, without ``exclude`` and the target."""
    skip = set(exclude) | ({target} if target else set())
    return sorted((set(left.columns) & set(right.columns)) - skip)


def detect_time_column(df: DataFrame, names: Sequence[str] = FRESHNESS_TIME_NAMES) -> str | None:
    """First column of a time type, else the first with a common time name."""
    typed = columns_in(df, ("datetime",))
    if typed:
        return typed[0]
    return next((c for c in df.columns if c.lower() in names), None)


def as_timestamp(df: DataFrame, name: str) -> Column:
    """Time value of a column; text that does not parse becomes NULL."""
    fam = families(df)[name]
    if fam == "datetime":
        return col(name).cast("timestamp_ntz")
    if fam == "string":
        return F.try_to_timestamp(col(name)).cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, as a long."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ts)
