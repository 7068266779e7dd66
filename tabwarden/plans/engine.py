"""Whole runs: which checks and detectors apply, in which order, with what outcome."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.operators import accuracy, completeness, consistency, contract, leakage, rules, timeliness
from tabwarden.plans import checks
from tabwarden.plans.checks import Check, guarded
from tabwarden.plans.schemas import CHECK_RESULTS, DEFAULTS


@dataclass(frozen=True)
class QualityConfig:
    """What a quality run covers. ``custom`` are (name, DataFrame -> list[Check]) plug-ins."""

    run: Sequence[str] = ("schema", "completeness", "consistency", "accuracy", "timeliness", "rules")
    contract: Any = None
    missing_threshold: float = DEFAULTS["missing_threshold"]
    consistency: Sequence[consistency.ConsistencyRule] = ()
    accuracy: Sequence[accuracy.AccuracyRule] = ()
    rules: Sequence[rules.Rule] = ()
    reference_time: datetime | str | None = None
    time_column: str | None = None
    max_gap_hours: float | None = None
    outlier_method: str = "zscore"
    outlier_threshold: float | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)  # referenced by foreign keys
    fail_fast: bool = False
    custom: Sequence[tuple[str, Callable[[DataFrame], list[Check]]]] = field(default_factory=tuple)


def size_guards(df: DataFrame) -> DataFrame:
    """One row: row count and what it means for the checks that follow."""
    n = F.col("n")
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        "n",
        F.when(F.lit(not df.columns), "error").when(n == 0, "warning").when(n == 1, "info").otherwise("info").alias("severity"),
        F.when(F.lit(not df.columns), "failed").when(n == 0, "warning").otherwise("passed").alias("status"),
        F.when(n == 0, "table is empty").when(n == 1, "single row: statistics are unreliable").otherwise("").alias("message"),
    )


def plan_checks(df: DataFrame, cfg: QualityConfig) -> list[tuple[str, list[Check]]]:
    """Checks per validator; one failing to plan becomes a failed row of its own."""
    when = cfg.reference_time or datetime.now(timezone.utc).replace(tzinfo=None)
    builders: dict[str, Callable[[], list[Check]]] = {
        "schema": lambda: contract.contract_checks(df, cfg.contract),
        "completeness": lambda: completeness.completeness_checks(df, cfg.missing_threshold),
        "consistency": lambda: consistency.consistency_checks(df, cfg.consistency, tables=cfg.tables),
        "accuracy": lambda: accuracy.accuracy_checks(df, cfg.accuracy, method=cfg.outlier_method, threshold=cfg.outlier_threshold),
        "timeliness": lambda: timeliness.timeliness_checks(df, when, cfg.time_column, max_gap_hours=cfg.max_gap_hours),
        "rules": lambda: rules.rules_checks(df, cfg.rules),
    }
    for name, build in cfg.custom:
        builders[name] = lambda b=build: b(df)
    names = [n for n in builders if n in cfg.run or n in dict(cfg.custom)]
    return [(n, guarded(n, "plan", None, builders[n])) for n in names]


def quality_run(df: DataFrame, cfg: QualityConfig) -> DataFrame:
    """CHECK_RESULTS of a run.

    All validators share one fused scan. With ``fail_fast`` they run as jobs in
    order instead and the run stops after the first one that did not pass.
    """
    planned = plan_checks(df, cfg)
    if not cfg.fail_fast:
        return checks.run(df, [c for _, cs in planned for c in cs])
    done: list[DataFrame] = []
    for _, cs in planned:
        rows = checks.run(df, cs).collect()  # a few rows of results, not data
        done.append(df.sparkSession.createDataFrame(rows, CHECK_RESULTS))
        if any(r["status"] in ("failed", "warning") for r in rows):
            break
    return reduce(DataFrame.unionByName, done)


@dataclass(frozen=True)
class LeakageConfig:
    """What a leakage run covers. ``custom`` are (name, (train, test, target) -> findings) plug-ins."""

    run: Sequence[str] = ("contamination", "target", "feature", "temporal")  # "drift" is opt-in
    target: str | None = None
    time_column: str | None = None
    sequence: str | None = None
    columns: Sequence[str] | None = None
    check_importance: bool = True
    fail_fast: bool = False
    custom: Sequence[tuple[str, Callable[[DataFrame, DataFrame | None, str | None], DataFrame]]] = field(default_factory=tuple)


def drift_findings(train: DataFrame, test: DataFrame | None, target: str | None) -> DataFrame:
    """One warning per drifted feature, numeric or categorical."""
    from tabwarden.operators import drift

    spark = train.sparkSession
    if test is None:
        return leakage.rows(spark, [leakage.skipped("drift", "no test data")])
    numeric = drift.numeric_drift(train, test, target=target).where("has_drift").select("feature", F.col("psi").alias("score"))
    shared = [c for c in drift.common_columns(train, test, target=target) if c in drift.categorical_columns(train) and c in drift.categorical_columns(test)]
    parts = [numeric]
    if shared:
        parts.append(drift.chi2_drift(train, test, shared).where("has_drift").select("feature", F.col("chi2").alias("score")))
    drifted = reduce(DataFrame.unionByName, parts)
    return leakage.union([
        leakage.rows(spark, [leakage.checked(spark, "drift")]),
        leakage.finding(drifted, "drift", "data_drift", "warning", "Review distribution changes and consider retraining model", feature=F.col("feature"), score=F.col("score")),
    ])


def leakage_run(train: DataFrame, test: DataFrame | None, cfg: LeakageConfig) -> DataFrame:
    """Findings of all configured detectors; one that cannot be planned becomes an error row."""
    from pyspark.errors import PySparkException

    from tabwarden.operators import contamination, feature, target, temporal

    detectors: dict[str, Callable[[], DataFrame]] = {
        "contamination": lambda: contamination.detect(train, test, cfg.target, cfg.columns),
        "target": lambda: target.detect(train, cfg.target),
        "feature": lambda: feature.detect(train, cfg.target, check_importance=cfg.check_importance),
        "temporal": lambda: temporal.detect(train, test, cfg.time_column, sequence=cfg.sequence),
        "drift": lambda: drift_findings(train, test, cfg.target),
    }
    for name, find in cfg.custom:
        detectors[name] = lambda f=find: f(train, test, cfg.target)
    done: list[DataFrame] = []
    for name, find in detectors.items():
        if name not in cfg.run and name not in dict(cfg.custom):
            continue
        try:
            found = find()
        except (PySparkException, ValueError, KeyError, TypeError) as e:
            found = leakage.rows(train.sparkSession, [leakage.failed(name, type(e).__name__)])
        done.append(found)
        if cfg.fail_fast and not leakage.detector_status(found).where("status = 'detected'").isEmpty():
            break
    return leakage.union(done)


def quick_check(train: DataFrame, test: DataFrame | None, cfg: LeakageConfig) -> bool:
    """Whether any detector finds leakage."""
    return not leakage.detector_status(leakage_run(train, test, cfg)).where("status = 'detected'").isEmpty()
