"""Declarative column rules kept as a table: 16 rule types."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwarden.functions.expr import among
from tabwarden.functions.types import as_double, clean, col
from tabwarden.operators.contract import duplicate_frame, start_anchored
from tabwarden.plans.checks import Check, guarded, note, row_check, skip

VALIDATOR = "rules"

# Patterns of the format rules.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = {
    "us": r"^\+?1?[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}$",
    "international": r"^\+?[1-9]\d{1,14}$",
    "basic": r"^[\d\s\-\+\(\)]{7,20}$",
}
CREDIT_CARD = r"^(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})$"
DATE = {
    "iso": r"^\d{4}-\d{2}-\d{2}$",
    "us": r"^\d{2}/\d{2}/\d{4}$",
    "eu": r"^\d{2}-\d{2}-\d{4}$",
}
URL = r"^https?://(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b(?:[-a-zA-Z0-9()@:%_\+.~#?&//=]*)$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"
IP_V4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$"
SSN = r"^\d{3}-\d{2}-\d{4}$"
ZIP_CODE = r"^\d{5}(?:-\d{4})?$"

RULE_TABLE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("rule_type", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("severity", T.StringType()),
        T.StructField("parameters", T.StringType()),  # JSON object
    ]
)


@dataclass(frozen=True)
class Rule:
    name: str
    rule_type: str
    column: str
    enabled: bool = True
    severity: str = "warning"
    parameters: dict[str, Any] = field(default_factory=dict)


def _format_pattern(rule_type: str, p: dict[str, Any]) -> str | None:
    fixed = {"email": EMAIL, "url": URL, "uuid": UUID, "ip_address": IP_V4, "ssn": SSN, "zip_code": ZIP_CODE}
    if rule_type == "phone":
        return PHONE.get(p.get("format", "basic"), PHONE["basic"])
    if rule_type == "date":
        return DATE.get(p.get("format", "iso"), DATE["iso"])
    if rule_type == "credit_card":
        return CREDIT_CARD
    if rule_type == "pattern":
        return p.get("pattern")
    return fixed.get(rule_type)


PATTERN_TYPES = ("email", "phone", "credit_card", "date", "url", "uuid", "ip_address", "ssn", "zip_code", "pattern")


def row_violation(df: DataFrame, rule_type: str, column: str, p: dict[str, Any]) -> Column | None:
    """Boolean expression that is true on rows breaking the rule; None if it is no row rule."""
    v = clean(df, column)
    if rule_type in PATTERN_TYPES:
        pattern = _format_pattern(rule_type, p)
        if not pattern:
            raise ValueError("rule needs a 'pattern' parameter")
        re.compile(pattern)
        text = col(column).cast("string")
        if rule_type == "credit_card":
            text = F.regexp_replace(text, r"[\s\-]", "")
        return ~text.rlike(start_anchored(pattern))
    if rule_type == "range":
        bad = F.lit(False)
        if p.get("min") is not None:
            bad = bad | (v < F.lit(p["min"]))
        if p.get("max") is not None:
            bad = bad | (v > F.lit(p["max"]))
        return bad & v.isNotNull()
    if rule_type == "in_list":
        return ~among(df, column, p.get("values", []))
    if rule_type == "not_in_list":
        return among(df, column, p.get("values", []))
    return None


# Reductions an aggregate rule may name.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp,
    "count": F.count, "nunique": F.count_distinct, "median": F.median, "prod": F.product,
    "skew": None, "kurt": None,
}


def _aggregate_value(df: DataFrame, column: str, how: str) -> tuple[Column, DataFrame]:
    """Aggregate expression and the frame it runs over."""
    v = as_double(df, column)
    if how == "median":
        from tabwarden.functions.selection import exact_quantiles

        q = exact_quantiles(df, {column: v}, [0.5])[column]
        return F.lit(q[0] if q else None).cast("double"), df
    if how == "nunique":
        distinct = df.select(clean(df, column).alias("v")).where("v is not null").distinct()
        return F.count(F.lit(1)).cast("double"), distinct
    if how in ("skew", "kurt"):
        from tabwarden.operators.profile import corrected_kurtosis, corrected_skewness

        return (corrected_skewness(v) if how == "skew" else corrected_kurtosis(v)), df
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregation {how}")
    return AGGREGATES[how](v).cast("double"), df


def _aggregate_check(df: DataFrame, rule: Rule) -> list[Check]:
    p = rule.parameters
    if p.get("expected") is None:
        return []
    how, expected, tol = p.get("aggregation", "sum"), float(p["expected"]), float(p.get("tolerance", 0.01))
    actual, over = _aggregate_value(df, rule.column, how)
    off = F.abs(actual - F.lit(expected)) > F.lit(tol * abs(expected))
    bad = F.when(off, F.lit(1)).otherwise(F.lit(0)).cast("long")
    msg = f"{how} expected {expected:.2f}"
    if over is df:
        return [Check(VALIDATOR, rule.name, rule.column, rule.severity, bad, F.lit(1), message=msg)]
    one = over.agg(bad.alias("violations"), F.lit(1).cast("long").alias("total"))
    return [Check(VALIDATOR, rule.name, rule.column, rule.severity, frame=one, message=msg)]


def _unique_check(df: DataFrame, rule: Rule) -> list[Check]:
    frame = duplicate_frame(df, rule.column, keep_first=True)
    return [Check(VALIDATOR, rule.name, rule.column, rule.severity, frame=frame, message="repeated values")]


def _conditional(df: DataFrame, rule: Rule) -> list[Check]:
    p = rule.parameters
    on, value, sub = p.get("condition_column"), p.get("condition_value"), p.get("target_rule")
    if not on or value is None or not sub:
        return []
    when = among(df, on, [value])
    params = p.get("target_parameters", {})
    bad = row_violation(df, sub, rule.column, params)
    msg = f"when {on}={value}: {sub}"
    if bad is not None:
        return [row_check(VALIDATOR, rule.name, rule.column, rule.severity, when & bad, msg, total=F.count_if(when))]
    inner = Rule(rule.name, sub, rule.column, True, rule.severity, params)
    subset = df.where(when)
    built = _build(subset, inner)
    # Aggregates over the subset need their own scan.
    return [
        c if c.frame is not None else Check(
            c.validator, c.check, c.column, c.severity, message=msg,
            frame=subset.agg(c.violations.alias("violations"), (c.total if c.total is not None else F.count(F.lit(1))).cast("long").alias("total")),
        )
        for c in built
    ]


def _build(df: DataFrame, rule: Rule) -> list[Check]:
    if rule.rule_type == "unique":
        return _unique_check(df, rule)
    if rule.rule_type == "aggregate":
        return _aggregate_check(df, rule)
    if rule.rule_type == "conditional":
        return _conditional(df, rule)
    bad = row_violation(df, rule.rule_type, rule.column, rule.parameters)
    if bad is None:
        return [skip(VALIDATOR, rule.name, f"unknown rule type {rule.rule_type}")]
    return [row_check(VALIDATOR, rule.name, rule.column, rule.severity, bad, rule.rule_type)]


def rules_checks(df: DataFrame, rules: Sequence[Rule]) -> list[Check]:
    """Checks of the enabled rules; a rule on an unknown column becomes a warning."""
    out: list[Check] = []
    for r in rules:
        if not r.enabled:
            continue
        if r.column not in df.columns:
            out.append(note(VALIDATOR, r.name, r.column, "warning", True, "column not found"))
            continue
        out += guarded(VALIDATOR, r.name, r.column, lambda r=r: _build(df, r))
    return out
