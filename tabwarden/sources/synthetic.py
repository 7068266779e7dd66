"""Seeded synthetic customer table with three features that leak the target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the generated population.
CONTRACTS = (("Month-to-month", 0.5, 0.4), ("One year", 0.8, 0.2), ("Two year", 1.0, 0.1))  # label, cumulative share, churn effect
BASE_CHURN, PER_TICKET, PER_MONTH, SECURITY = 0.25, 0.05, 0.003, 0.1
MEAN_TENURE, TICKETS = 24.0, 2.0


def _pick(u: Column, column: int) -> Column:
    out = F.when(u < CONTRACTS[0][1], F.lit(CONTRACTS[0][column]))
    for c in CONTRACTS[1:-1]:
        out = out.when(u < c[1], F.lit(c[column]))
    return out.otherwise(F.lit(CONTRACTS[-1][column]))


def _poisson(u: Column, mean: float, most: int = 20) -> Column:
    """Inverse of the cumulative Poisson distribution, by comparing with its steps."""
    import math

    total, out = 0.0, F.lit(0)
    for k in range(most):
        total += math.exp(-mean) * mean**k / math.factorial(k)
        out = out + (u > F.lit(total)).cast("int")
    return out


def churn_table(spark: SparkSession, rows: int = 5000, seed: int = 42) -> DataFrame:
    """14 columns; cancellation_survey_score, final_bill_amount and churn_risk_score leak ``churned``."""
    u = lambda i: F.rand(seed + i)
    base = spark.range(1, rows + 1).select(
        F.col("id").alias("customer_id"),
        F.least(F.greatest((-F.log(F.lit(1.0) - u(0)) * MEAN_TENURE).cast("int"), F.lit(1)), F.lit(72)).alias("tenure_months"),
        F.least(F.greatest((F.randn(seed + 1) * 15 + 45).cast("int"), F.lit(18)), F.lit(80)).alias("age"),
        u(2).alias("u_contract"), (u(3) * 100 + 20).alias("monthly"), (u(4) * 0.2 + 0.9).alias("factor"),
        (u(5) < 0.8).cast("int").alias("has_internet_service"), (u(6) < 0.6).cast("int").alias("has_streaming_service"), (u(7) < 0.4).cast("int").alias("has_security_service"),
        _poisson(u(8), TICKETS).alias("support_tickets_last_6mo"), u(9).alias("u_churn"), (u(10) * 4 + 1).alias("score"), (u(11) * 0.8 + 0.1).alias("part"), (F.randn(seed + 12) * 0.02).alias("noise"),
    )
    chance = (
        F.lit(BASE_CHURN) + _pick(F.col("u_contract"), 2) + F.col("support_tickets_last_6mo") * PER_TICKET - F.col("tenure_months") * PER_MONTH - F.col("has_security_service") * SECURITY
    )
    churned = (F.col("u_churn") < F.greatest(F.lit(0.05), F.least(F.lit(0.95), chance))).cast("int")
    out = base.withColumn("churned", churned)
    gone = F.col("churned") == 1
    return out.select(
        "customer_id", "tenure_months", "age", _pick(F.col("u_contract"), 0).alias("contract_type"), F.round("monthly", 2).alias("monthly_charges"),
        F.round(F.col("tenure_months") * F.col("monthly") * F.col("factor"), 2).alias("total_charges"),
        "has_internet_service", "has_streaming_service", "has_security_service", "support_tickets_last_6mo",
        F.round(F.when(gone, F.col("score")).otherwise(0.0), 2).alias("cancellation_survey_score"),
        F.round(F.when(gone, F.col("monthly") * F.col("part")).otherwise(F.col("monthly")), 2).alias("final_bill_amount"),
        F.round(F.col("churned") + F.col("noise"), 4).alias("churn_risk_score"), "churned",
    )
