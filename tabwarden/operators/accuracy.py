"""Ranges, patterns, domains, formats and statistical outliers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.functions.expr import among
from tabwarden.functions.longform import long_values
from tabwarden.functions.selection import exact_quantiles
from tabwarden.functions.types import as_double, clean, numeric_columns
from tabwarden.operators.contract import pattern_checks
from tabwarden.plans.checks import Check, note, row_check, skip
from tabwarden.plans.schemas import DEFAULTS

VALIDATOR = "accuracy"

# Named formats.
FORMATS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone_us": r"^\+?1?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}$",
    "url": r"^https?://[^\s/$.?#].[^\s]*$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "iso_date": r"^\d{4}-\d{2}-\d{2}$",
}

MIN_VALUES = 3
MAD_SCALE = 0.6745


@dataclass(frozen=True)
class AccuracyRule:
    column: str
    rule_type: str  # range | pattern | domain | format | outlier
    parameters: dict[str, Any] = field(default_factory=dict)
    severity: str = "error"


def rule_checks(df: DataFrame, rules: Sequence[AccuracyRule], case_sensitive: bool = False) -> list[Check]:
    out: list[Check] = []
    for r in rules:
        if r.column not in df.columns:
            out.append(note(VALIDATOR, r.rule_type, r.column, "warning", True, "column not found"))
            continue
        v, p = clean(df, r.column), r.parameters
        if r.rule_type == "range":
            if p.get("min") is not None:
                out.append(row_check(VALIDATOR, "range_below", r.column, r.severity, v < F.lit(p["min"]), f"values below {p['min']}"))
            if p.get("max") is not None:
                out.append(row_check(VALIDATOR, "range_above", r.column, r.severity, v > F.lit(p["max"]), f"values above {p['max']}"))
        elif r.rule_type == "pattern" and p.get("pattern"):
            out += pattern_checks(VALIDATOR, "pattern", r.column, r.severity, p["pattern"], ignore_case=not case_sensitive)
        elif r.rule_type == "domain" and p.get("values"):
            out.append(row_check(VALIDATOR, "domain", r.column, r.severity, ~among(df, r.column, p["values"]), "values not in domain"))
        elif r.rule_type == "format" and p.get("format") in FORMATS:
            out += pattern_checks(VALIDATOR, "format_" + p["format"], r.column, r.severity, FORMATS[p["format"]], ignore_case=not case_sensitive)
        elif r.rule_type == "outlier":
            out += outlier_checks(df, [r.column], **p)
        else:
            out.append(skip(VALIDATOR, f"{r.rule_type}:{r.column}", "rule type or parameters not supported"))
    return out


def outlier_masks(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "zscore", threshold: float | None = None
) -> dict[str, Column]:
    """Boolean outlier expression per numeric column, with its bounds as literals.

    The bounds are a handful of numbers per column (moments, or exact quantiles
    found by selection), so using them costs no join and no further shuffle.
    Moments are of the finite values, so an infinite one is itself an outlier.
    Columns with fewer than 3 values or no spread get no mask.
    """
    names = list(columns or numeric_columns(df))
    v = {n: as_double(df, n) for n in names}
    out: dict[str, Column] = {}
    if not names:
        return out
    if method == "zscore":
        t = threshold if threshold is not None else DEFAULTS["zscore_threshold"]
        rows = long_values(df, [v[n] for n in names]).where(F.abs("v") < float("inf")).groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
        for r in rows.collect():  # one row per column
            if r["n"] >= MIN_VALUES and r["s"]:
                n = names[r["g"]]
                out[n] = F.abs((v[n] - F.lit(r["m"])) / F.lit(r["s"])) > F.lit(float(t))
        return out
    counts = {r["g"]: r["n"] for r in long_values(df, [v[n] for n in names]).groupBy("g").agg(F.count("*").alias("n")).collect()}
    names = [n for i, n in enumerate(names) if counts.get(i, 0) >= MIN_VALUES]
    if method == "iqr":
        t = threshold if threshold is not None else DEFAULTS["iqr_multiplier"]
        for n, q in exact_quantiles(df, {n: v[n] for n in names}, [0.25, 0.75]).items():
            q1, q3 = q
            spread = q3 - q1
            out[n] = (v[n] < F.lit(q1 - t * spread)) | (v[n] > F.lit(q3 + t * spread))
        return out
    if method == "mad":
        t = threshold if threshold is not None else DEFAULTS["mad_threshold"]
        med = {n: q[0] for n, q in exact_quantiles(df, {n: v[n] for n in names}, [0.5]).items()}
        dev = {n: F.abs(v[n] - F.lit(med[n])) for n in names}
        for n, q in exact_quantiles(df, dev, [0.5]).items():
            if q[0]:
                out[n] = F.abs(F.lit(MAD_SCALE) * (v[n] - F.lit(med[n])) / F.lit(q[0])) > F.lit(float(t))
        return out
    raise ValueError(f"unknown outlier method {method}")


def outlier_checks(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "zscore", threshold: float | None = None
) -> list[Check]:
    names = list(columns or numeric_columns(df))
    masks = outlier_masks(df, names, method, threshold)
    none = F.lit(False)
    return [
        row_check(VALIDATOR, f"outliers_{method}", n, "warning", masks.get(n, none), "statistical outliers", total=F.count(as_double(df, n)))
        for n in names
    ]


def with_outlier_flag(df: DataFrame, column: str, method: str = "zscore", threshold: float | None = None, out: str = "is_outlier") -> DataFrame:
    """The table with a boolean outlier column; missing values are no outliers."""
    mask = outlier_masks(df, [column], method, threshold).get(column, F.lit(False))
    return df.withColumn(out, F.coalesce(mask, F.lit(False)))


def accuracy_checks(
    df: DataFrame, rules: Sequence[AccuracyRule] = (), check_outliers: bool = True, method: str = "zscore", threshold: float | None = None
) -> list[Check]:
    return rule_checks(df, rules) + (outlier_checks(df, None, method, threshold) if check_outliers else [])
