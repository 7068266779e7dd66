"""Schema contracts: declared columns, types and value constraints."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.functions.expr import among, value_identity
from tabwarden.functions.types import FAMILY_ALIASES, as_double, clean, col, families
from tabwarden.operators.profile import column_base
from tabwarden.plans.checks import Check, note, row_check, skip

VALIDATOR = "schema"


@dataclass(frozen=True)
class ColumnContract:
    name: str
    dtype: str | Sequence[str] = "string"
    nullable: bool = True
    unique: bool = False
    min_value: float | None = None
    max_value: float | None = None
    allowed_values: Sequence[Any] | None = None
    pattern: str | None = None


@dataclass(frozen=True)
class TableContract:
    columns: Sequence[ColumnContract] = field(default_factory=tuple)
    allow_extra_columns: bool = False
    strict_column_order: bool = False
    min_rows: int = 0
    max_rows: int | None = None

    @classmethod
    def from_dict(cls, spec: dict[str, Any]) -> TableContract:
        cols = [ColumnContract(**{k: v for k, v in c.items() if k != "description"}) for c in spec.get("columns", [])]
        rest = {k: v for k, v in spec.items() if k != "columns"}
        return cls(columns=tuple(cols), **rest)


def infer_contract(df: DataFrame) -> DataFrame:
    """Per column: position, type family, has nulls, all non-null values distinct."""
    places = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(df.columns)], "column string, position int")
    return column_base(df).join(F.broadcast(places), "column").select(
        "column", "position", F.col("type").alias("dtype"), (F.col("missing_count") > 0).alias("nullable"), (F.col("unique_count") == F.col("count")).alias("unique")
    )


def expected_families(dtype: str | Sequence[str]) -> list[str]:
    names = [dtype] if isinstance(dtype, str) else list(dtype)
    return sorted({f for n in names for f in FAMILY_ALIASES.get(n, (n,))})


def duplicate_frame(df: DataFrame, name: str, keep_first: bool = False) -> DataFrame:
    """One row (violations, total): rows in a duplicated value group, nulls equal.

    With ``keep_first`` only the second and later copies count. Grouping
    combines on the map side, so one very frequent value is one row per task.
    """
    v = clean(df, name)
    if families(df)[name] == "string":
        v = F.when(v.isNotNull(), value_identity(v, True))  # long text travels as 16 bytes
    groups = df.groupBy(v.alias("v")).agg(F.count("*").alias("n"))
    bad = F.col("n") - 1 if keep_first else F.when(F.col("n") > 1, F.col("n")).otherwise(F.lit(0))
    return groups.agg(
        F.coalesce(F.sum(bad), F.lit(0)).alias("violations"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
    )


def _column_checks(df: DataFrame, c: ColumnContract, fam: str) -> list[Check]:
    out: list[Check] = []
    v = clean(df, c.name)
    if not c.nullable:
        out.append(row_check(VALIDATOR, "not_null", c.name, "error", v.isNull(), "nulls in a non-nullable column"))
    if c.unique:
        out.append(
            Check(VALIDATOR, "unique", c.name, "error", frame=duplicate_frame(df, c.name), message="duplicate values in a unique column")
        )
    if fam in ("int", "float"):
        if c.min_value is not None:
            out.append(row_check(VALIDATOR, "min_value", c.name, "error", v < F.lit(c.min_value), f"values below {c.min_value}"))
        if c.max_value is not None:
            out.append(row_check(VALIDATOR, "max_value", c.name, "error", v > F.lit(c.max_value), f"values above {c.max_value}"))
    if c.allowed_values is not None:
        out.append(row_check(VALIDATOR, "allowed_values", c.name, "error", ~among(df, c.name, c.allowed_values), "values not in allowed set"))
    if c.pattern is not None and fam == "string":
        out += pattern_checks(VALIDATOR, "pattern", c.name, "error", c.pattern)
    return out


def start_anchored(pattern: str, ignore_case: bool = False) -> str:
    """Java regex that must match from the start of the value."""
    return ("(?i)" if ignore_case else "") + "^(?:" + pattern + ")"


def pattern_checks(validator: str, check: str, column: str, severity: str, pattern: str, ignore_case: bool = False) -> list[Check]:
    try:
        re.compile(pattern)
    except re.error as e:
        return [note(validator, check + "_invalid", column, "error", True, f"invalid pattern: {e}")]
    bad = ~col(column).cast("string").rlike(start_anchored(pattern, ignore_case))
    return [row_check(validator, check, column, severity, bad, f"values not matching {pattern}")]


def contract_checks(df: DataFrame, contract: TableContract | dict[str, Any] | None) -> list[Check]:
    """All checks of a contract: presence, order, types, row count, constraints."""
    if contract is None:
        return [skip(VALIDATOR, "contract", "no contract given")]
    if isinstance(contract, dict):
        contract = TableContract.from_dict(contract)
    fams = families(df)
    declared = [c.name for c in contract.columns]
    n = F.count(F.lit(1))
    out = [
        Check(VALIDATOR, "min_rows", None, "error", F.when(n < contract.min_rows, F.lit(1)).otherwise(F.lit(0)), F.lit(1), message=f"fewer than {contract.min_rows} rows")
    ]
    if contract.max_rows is not None:
        out.append(
            Check(VALIDATOR, "max_rows", None, "error", F.when(n > contract.max_rows, F.lit(1)).otherwise(F.lit(0)), F.lit(1), message=f"more than {contract.max_rows} rows")
        )
    missing = sorted(set(declared) - set(df.columns))
    extra = sorted(set(df.columns) - set(declared))
    out.append(note(VALIDATOR, "missing_columns", None, "error", bool(missing), ",".join(missing)))
    if not contract.allow_extra_columns:
        out.append(note(VALIDATOR, "unexpected_columns", None, "warning", bool(extra), ",".join(extra)))
    if contract.strict_column_order:
        present = [c for c in df.columns if c in declared]
        out.append(note(VALIDATOR, "column_order", None, "warning", present != declared[: len(present)], ",".join(present)))
    for c in contract.columns:
        if c.name not in fams:
            continue
        want = expected_families(c.dtype)
        out.append(note(VALIDATOR, "type", c.name, "error", fams[c.name] not in want, f"{fams[c.name]}, expected {'/'.join(want)}"))
        out += _column_checks(df, c, fams[c.name])
    return out


def invalid_values(df: DataFrame, name: str, allowed: Sequence[Any] | None = None, pattern: str | None = None, limit: int = 10) -> DataFrame:
    """Most frequent distinct values that break an allowed list or a pattern."""
    v = clean(df, name)
    bad = ~v.isin(list(allowed)) if allowed is not None else ~v.cast("string").rlike(start_anchored(pattern or ""))
    return (
        df.where(bad)
        .groupBy(v.cast("string").alias("value"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "value")
        .limit(limit)
    )


def actual_bounds(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Observed minimum and maximum of numeric columns, one scan."""
    aggs, structs = [], []
    for i, n in enumerate(names):
        aggs += [F.min(as_double(df, n)).alias(f"lo{i}"), F.max(as_double(df, n)).alias(f"hi{i}")]
        structs.append(F.struct(F.lit(n).alias("column"), F.col(f"lo{i}").alias("actual_min"), F.col(f"hi{i}").alias("actual_max")))
    return df.agg(*aggs).select(F.inline(F.array(*structs)))
