"""Rules across columns: comparisons, expressions, callables, references."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.functions.expr import among
from tabwarden.functions.types import clean, columns_in, numeric_columns
from tabwarden.plans.checks import Check, guarded, note, row_check

VALIDATOR = "consistency"


@dataclass(frozen=True)
class ConsistencyRule:
    """``condition`` is a Spark SQL boolean expression or a callable DataFrame -> Column.

    An expression that contains an aggregate must be marked ``scalar=True``; it
    is evaluated once and all rows pass or fail with it.
    """

    name: str
    rule_type: str = "expression"  # comparison | expression | custom | referential
    columns: Sequence[str] = ()
    condition: str | Callable[[DataFrame], Column] | None = None
    severity: str = "error"
    parameters: dict[str, Any] = field(default_factory=dict)


_PASSES: dict[str, Callable[[Column, Column], Column]] = {
    "<=": lambda a, b: a <= b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def _comparison(df: DataFrame, rule: ConsistencyRule) -> list[Check]:
    if len(rule.columns) != 2:
        raise ValueError(f"a comparison takes 2 columns, got {len(rule.columns)}")
    op = rule.parameters.get("operator", "<=")
    if op not in _PASSES:
        raise ValueError(f"unknown operator {op}")
    a, b = (clean(df, c) for c in rule.columns)
    # NOT (a op b) is NULL when either side is missing, so such rows are skipped.
    return [row_check(VALIDATOR, rule.name, None, rule.severity, ~_PASSES[op](a, b), f"{rule.columns[0]} {op} {rule.columns[1]}")]


def _expression(df: DataFrame, rule: ConsistencyRule) -> list[Check]:
    if rule.condition is None:
        raise ValueError("rule has no condition")
    text = rule.condition if isinstance(rule.condition, str) else rule.name
    cond = F.expr(rule.condition) if isinstance(rule.condition, str) else rule.condition(df)
    if rule.parameters.get("scalar"):
        bad = F.when(F.coalesce(cond, F.lit(False)), F.lit(0).cast("long")).otherwise(F.count(F.lit(1)))
        return [Check(VALIDATOR, rule.name, None, rule.severity, bad, message=text)]
    df.select(cond)  # analysis errors surface here, per rule
    return [replace(row_check(VALIDATOR, rule.name, None, rule.severity, ~F.coalesce(cond, F.lit(False)), text), may_fail=True)]


def missing_references(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Distinct child values absent from the parent, with their row counts.

    The child is counted per value before the join, so a value that makes up a
    third of the rows reaches the join as one row.
    """
    values = child.groupBy(clean(child, column).alias("value")).agg(F.count("*").alias("n")).where("value is not null")
    known = parent.select(clean(parent, parent_column).alias("value")).where("value is not null").distinct()
    return values.join(known, "value", "left_anti")


def reference_frame(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    total = child.agg(F.count(F.lit(1)).alias("total"))
    bad = missing_references(child, column, parent, parent_column)
    return bad.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
        "violations", F.lit(None).cast("long").alias("t")
    ).select("violations", total.scalar().alias("total"))


def _referential(df: DataFrame, rule: ConsistencyRule, tables: dict[str, DataFrame]) -> list[Check]:
    values = rule.parameters.get("reference_values")
    ref_col = rule.parameters.get("reference_column")
    if values is None and ref_col is None:
        raise ValueError("a referential rule needs reference_values or reference_column")
    table = rule.parameters.get("reference_table")
    if not values and table and table not in tables:
        raise ValueError(f"unknown reference table {table}")
    parent = tables[table] if not values and table else df
    if not values and ref_col not in parent.columns:
        raise ValueError(f"unknown reference column {ref_col}")
    out = []
    for c in rule.columns:
        if values:
            out.append(row_check(VALIDATOR, rule.name, c, rule.severity, ~among(df, c, values), "not in reference values"))
        else:
            out.append(Check(VALIDATOR, rule.name, c, rule.severity, frame=reference_frame(df, c, parent, ref_col), message=f"not in {ref_col}"))
    return out


def rule_checks(df: DataFrame, rules: Sequence[ConsistencyRule], tables: dict[str, DataFrame] | None = None) -> list[Check]:
    out: list[Check] = []
    for rule in rules:
        absent = [c for c in rule.columns if c not in df.columns]
        if absent:
            out.append(note(VALIDATOR, rule.name, None, "warning", True, "missing columns: " + ",".join(absent)))
            continue
        if rule.rule_type == "comparison":
            out += guarded(VALIDATOR, rule.name, None, lambda r=rule: _comparison(df, r))
        elif rule.rule_type == "referential":
            out += guarded(VALIDATOR, rule.name, None, lambda r=rule: _referential(df, r, tables or {}))
        elif rule.rule_type in ("expression", "custom"):
            out += guarded(VALIDATOR, rule.name, None, lambda r=rule: _expression(df, r))
        else:
            out.append(note(VALIDATOR, rule.name, None, "warning", True, f"unknown rule type {rule.rule_type}"))
    return out


# Name parts that mark the low and the high end of a range.
DATE_RANGE_NAMES = (("start", "end"), ("begin", "end"), ("from", "to"), ("created", "updated"))
NUMBER_RANGE_NAMES = (("min", "max"), ("low", "high"), ("lower", "upper"))


def _range_rules(names: list[str], markers, label: str) -> list[ConsistencyRule]:
    out = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if any(lo in a.lower() and hi in b.lower() for lo, hi in markers):
                out.append(ConsistencyRule(f"auto_{a}_{label}_{b}", "comparison", (a, b), severity="warning", parameters={"operator": "<="}))
    return out


def detected_rules(df: DataFrame) -> list[ConsistencyRule]:
    """Range rules implied by column names, in column order."""
    return _range_rules(columns_in(df, ("datetime",)), DATE_RANGE_NAMES, "before") + _range_rules(
        numeric_columns(df), NUMBER_RANGE_NAMES, "leq"
    )


def consistency_checks(
    df: DataFrame, rules: Sequence[ConsistencyRule] = (), auto_detect: bool = True, tables: dict[str, DataFrame] | None = None
) -> list[Check]:
    return rule_checks(df, [*rules, *(detected_rules(df) if auto_detect else [])], tables)


def rule_totals(results: DataFrame, validator: str = VALIDATOR) -> DataFrame:
    """Rules passed and failed, from CHECK_RESULTS; a rule over several columns counts once."""
    per = results.where(F.col("validator") == validator).groupBy("check").agg(
        F.count_if(F.col("violations") > 0).alias("issues"), F.max("total").alias("rows")
    )
    return per.agg(
        F.count("*").alias("total_rules"),
        F.count_if(F.col("issues") == 0).alias("rules_passed"),
        F.count_if(F.col("issues") > 0).alias("rules_failed"),
        F.coalesce(F.sum("issues"), F.lit(0)).alias("issues_found"),
    )
