"""Result shapes, severities and default thresholds."""

from __future__ import annotations

from pyspark.sql import types as T

# Severities and statuses, from mildest to worst.
SEVERITY_RANK = {"info": 0, "warning": 1, "error": 2, "critical": 3}
STATUS_RANK = {"skipped": 0, "passed": 1, "warning": 2, "failed": 3}
RISK_RANK = {"low": 0, "medium": 1, "high": 2}
REGRESSION_RANK = {"none": 0, "minor": 1, "major": 2, "critical": 3}

CHECK_RESULTS = T.StructType(
    [
        T.StructField("validator", T.StringType()),
        T.StructField("check", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("violations", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("ratio", T.DoubleType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("message", T.StringType()),
    ]
)

LEAKAGE = T.StructType(
    [
        T.StructField("detector", T.StringType()),
        T.StructField("leakage_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("affected_rows", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("recommendation", T.StringType()),
    ]
)

# Default thresholds of every family.
DEFAULTS = {
    "missing_threshold": 0.05,
    "missing_error_ratio": 0.5,
    "min_valid_rows_ratio": 0.1,
    "co_missing_jaccard": 0.8,
    "co_missing_min_rows": 10,
    "zscore_threshold": 3.0,
    "iqr_multiplier": 1.5,
    "mad_threshold": 3.5,
    "max_data_age_hours": 24.0,
    "future_buffer_minutes": 5,
    "near_duplicate_threshold": 0.95,
    "target_correlation": 0.95,
    "mutual_info": 0.9,
    "importance": 0.5,
    "min_pairs": 10,
    "psi": 0.2,
    "ks_p": 0.05,
    "chi2_p": 0.05,
    "psi_bins": 10,
    "risk_high": 0.7,
    "risk_medium": 0.4,
    "impact_removal": 0.6,
    "network_edge": 0.3,
    "network_high_risk": 0.6,
}
