"""Label codes, and targets as numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwarden.functions.attach import attached
from tabwarden.functions.ordering import running_totals
from tabwarden.functions.selection import MAX_DISTINCT
from tabwarden.functions.types import as_double, clean, numeric_columns
from tabwarden.sources.storage import checkpointed

# Labels written into the plan as literals; more are joined on.
MAX_LITERAL_LABELS = 100


def code_table(df: DataFrame, column: str, max_rows: int = MAX_DISTINCT) -> DataFrame:
    """(value, code): 0-based position of each distinct value in sorted order.

    Up to ``max_rows`` values are ranked in one window. More are range
    partitioned; the layout is checkpointed, because partition numbers must be
    the same for the ranks and for the offsets added to them.
    """
    values = df.select(clean(df, column).alias("value")).where("value is not null").distinct()
    if values.count() <= max_rows:
        return values.withColumn("code", F.row_number().over(Window.orderBy("value")).cast("long") - 1)
    laid_out = checkpointed(values.repartitionByRange("value").withColumn("part", F.spark_partition_id()).withColumn("one", F.lit(1)))
    return running_totals(laid_out, [], "value", "part", ["one"]).select("value", (F.col("upto_one") - 1).cast("long").alias("code"))


def label_codes(df: DataFrame, column: str, out: str, max_rows: int = MAX_DISTINCT) -> DataFrame:
    """The table with the code of each label; missing labels get -1."""
    codes = code_table(df, column, max_rows).select(F.col("value").alias("__v"), F.col("code").alias("__c"))
    joined = attached(df.withColumn("__v", clean(df, column)), codes, ["__v"], "left")
    return joined.withColumn(out, F.coalesce("__c", F.lit(-1).cast("long"))).drop("__v", "__c")


def class_codes(df: DataFrame, target: str, out: str) -> DataFrame:
    """The rows with a target, and its class as a 0-based code that tells MLlib the number of classes.

    A missing text label is a class of its own; rows with a missing numeric target are left out.
    """
    known = df.where(clean(df, target).isNotNull()) if target in numeric_columns(df) else df
    coded = label_codes(known, target, out)
    low, high = coded.agg(F.min(out), F.max(out)).first()
    count = 0 if low is None else high - min(low, 0) + 1
    code = (F.col(out) - F.lit(min(low or 0, 0))).cast("double")
    return coded.withColumn(out, code.alias(out, metadata={"ml_attr": {"type": "nominal", "num_vals": max(int(count), 2)}}))


def numeric_target(df: DataFrame, target: str, out: str = "__target") -> tuple[DataFrame, Column]:
    """The target as a double: itself when numeric, else its label code (missing -1)."""
    if target in numeric_columns(df):
        return df, as_double(df, target)
    v = clean(df, target)
    labels = [r[0] for r in df.select(v.alias("v")).where("v is not null").distinct().orderBy("v").limit(MAX_LITERAL_LABELS + 1).collect()]
    if len(labels) > MAX_LITERAL_LABELS:
        coded = label_codes(df, target, out)
        return coded, F.col(out).cast("double")
    code = F.when(v.isNull(), F.lit(-1.0))
    for i, label in enumerate(labels):
        code = code.when(v == F.lit(label), F.lit(float(i)))
    return df, code
