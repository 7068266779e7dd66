"""Intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabwarden.sources.storage import scratch_path


class Tables:
    """Written tables of one run of an operator.

    A loop that checkpoints carries Spark's size estimates along, and these grow with each join of each
    round; a written table has the size of its files. A name used again alternates between two paths, so a
    loop holds two versions of a table, however long it runs.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.base, self.times = spark, scratch_path(spark, label), {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        n = self.times[name] = self.times.get(name, -1) + 1
        path = f"{self.base}/{name}-{n % 2}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
