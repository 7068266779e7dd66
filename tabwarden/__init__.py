"""Data-quality, drift and leakage analytics as Spark DataFrame operators."""
