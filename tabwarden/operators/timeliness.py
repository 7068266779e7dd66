"""Freshness, future timestamps and gaps in time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwarden.functions.types import as_timestamp, detect_time_column, micros
from tabwarden.plans.checks import Check, row_check, skip
from tabwarden.plans.schemas import DEFAULTS

VALIDATOR = "timeliness"
HOUR = 3_600_000_000  # microseconds
# Rows one ordered group may hold when gaps are folded: grid cells per chunk.
CHUNK = 65_536


def _at(moment: datetime | str) -> Column:
    text = moment if isinstance(moment, str) else moment.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp_ntz")


def hours(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(float(HOUR))


def freshness(df: DataFrame, time_column: str, reference: datetime | str) -> DataFrame:
    """One row: latest, oldest, age and span in hours, rows with a time."""
    ts = as_timestamp(df, time_column)
    return df.agg(F.max(ts).alias("latest"), F.min(ts).alias("oldest"), F.count(ts).alias("rows_analyzed")).select(
        "latest",
        "oldest",
        F.round(hours(_at(reference), F.col("latest")), 2).alias("data_age_hours"),
        F.round(hours(F.col("latest"), F.col("oldest")), 2).alias("data_span_hours"),
        "rows_analyzed",
    )


def _boundary_gaps(times: DataFrame, start: int, span: int, width: int, limit: int) -> tuple[int, int]:
    """(largest gap, gaps above limit) between consecutive non-empty grid cells.

    Cells aggregate to (first, last) with a map-side combine. They are then
    chained in chunks of at most 65,536 cells, and the chunks in turn, so no
    ordered group grows with the data.
    """
    cell = F.expr(f"(t - {start}L) div {width}L")
    level = times.groupBy(cell.alias("id")).agg(
        F.min("t").alias("first"), F.max("t").alias("last"),
        F.lit(0).cast("long").alias("widest"), F.lit(0).cast("long").alias("above"),
    )
    top = span // width
    while True:
        w = Window.partitionBy("chunk").orderBy("id")
        gap = F.col("first") - F.lag("last").over(w)
        level = (
            level.withColumn("chunk", F.expr(f"id div {CHUNK}L"))
            .withColumn("gap", gap)
            .groupBy("chunk")
            .agg(
                F.min("first").alias("first"), F.max("last").alias("last"),
                F.greatest(F.max("widest"), F.coalesce(F.max("gap"), F.lit(0))).alias("widest"),
                (F.sum("above") + F.count_if(F.col("gap") > limit)).alias("above"),
            )
            .withColumnRenamed("chunk", "id")
        )
        if top < CHUNK:
            break
        top //= CHUNK
    row = level.first()
    return row["widest"], row["above"]


def gap_statistics(df: DataFrame, time_column: str, max_gap_hours: float) -> dict[str, float | int] | None:
    """Exact largest and mean gap, and the number of gaps above the limit; None below 2 times.

    Two times in the same cell of width w lie less than w apart. With w equal
    to the limit, every gap above the limit shows at a cell border. If none
    does, the largest gap is at least the mean gap and at least the widest
    border seen, so a second grid of that width shows it at a border too.
    """
    times = df.select(micros(as_timestamp(df, time_column)).alias("t")).where("t is not null")
    n, lo, hi = times.agg(F.count("*"), F.min("t"), F.max("t")).first()
    if n < 2:
        return None
    span, limit = hi - lo, int(max_gap_hours * HOUR)
    width = max(limit, 1)
    widest, above = _boundary_gaps(times, lo, span, width, limit)
    if widest < width and span > 0:
        finer = max(widest, span // (n - 1), 1)
        widest, _ = _boundary_gaps(times, lo, span, finer, limit)
    return {"max_gap_hours": widest / HOUR, "avg_gap_hours": span / (n - 1) / HOUR, "large_gap_count": above, "rows": n}


def temporal_gaps(df: DataFrame, time_column: str, max_gap_hours: float) -> DataFrame:
    """One row: max_gap_hours, avg_gap_hours, large_gap_count (no row below 2 times)."""
    stats = gap_statistics(df, time_column, max_gap_hours)
    rows = [] if stats is None else [(round(stats["max_gap_hours"], 2), round(stats["avg_gap_hours"], 2), stats["large_gap_count"])]
    return df.sparkSession.createDataFrame(rows, "max_gap_hours double, avg_gap_hours double, large_gap_count long")


def timeliness_checks(
    df: DataFrame,
    reference: datetime | str,
    time_column: str | None = None,
    max_age_hours: float = DEFAULTS["max_data_age_hours"],
    max_gap_hours: float | None = None,
) -> list[Check]:
    name = time_column or detect_time_column(df)
    if not name or name not in df.columns:
        return [skip(VALIDATOR, "freshness", "no time column found")]
    ts, ref = as_timestamp(df, name), _at(reference)
    age = hours(ref, F.max(ts))
    later = ref + F.expr(f"INTERVAL {DEFAULTS['future_buffer_minutes']} MINUTES")
    out = [
        Check(VALIDATOR, "freshness", name, "warning", F.when(age > max_age_hours, F.lit(1)).otherwise(F.lit(0)), F.lit(1), message=f"older than {max_age_hours} hours"),
        row_check(VALIDATOR, "future", name, "error", ts > later, "timestamps in the future", total=F.count(ts)),
    ]
    if max_gap_hours:
        stats = gap_statistics(df, name, max_gap_hours) or {"large_gap_count": 0, "rows": 1}
        out.append(
            Check(
                VALIDATOR, "gaps", name, "warning", F.lit(stats["large_gap_count"]).cast("long"),
                F.lit(max(stats["rows"] - 1, 1)).cast("long"), message=f"gaps above {max_gap_hours} hours",
            )
        )
    return out
