"""Readers by format or file extension."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("csv", "json", "parquet")


def detect_format(path: str) -> str:
    """Format by extension; a path without one is read as CSV, as is text without a marker."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = re.search(r"\.([A-Za-z0-9]+)(?:\.(?:gz|bz2|zst|snappy))?$", name)
    if suffix is None:
        return "csv"
    kind = {"jsonl": "json", "ndjson": "json", "pq": "parquet"}.get(suffix.group(1).lower(), suffix.group(1).lower())
    if kind not in FORMATS:
        raise ValueError(f"unknown file format: {suffix.group(1)}")
    return kind


def load(
    spark: SparkSession, path: str, fmt: str = "auto", schema: T.StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """Read a table. Give a schema for CSV and JSON: inferring one costs a full extra pass."""
    kind = detect_format(path) if fmt == "auto" else fmt
    if kind not in FORMATS:
        raise ValueError(f"unsupported format: {kind}")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        return reader.option("header", True).option("inferSchema", schema is None).option("multiLine", multi_line).option("escape", '"').csv(path)
    if kind == "json":
        return reader.option("multiLine", multi_line).json(path)
    return reader.parquet(path)


def load_train_test(spark: SparkSession, train: str, test: str, **options) -> tuple[DataFrame, DataFrame]:
    return load(spark, train, **options), load(spark, test, **options)


def with_side(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both tables in one, with a ``side`` column."""
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
