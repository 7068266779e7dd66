"""Audit of how filters interact: contingency tensors of pass and fail.

Five filters give every document a cell of a 2x2x2x2x2 tensor. The counts of each part are contracted with
selectors (pass, fail, all) along each axis, which gives every step of every order of the filters, and the
Shapley value of each filter, from 32 numbers.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from tabwarden.llm.arrow import flat_bytes, slices
from tabwarden.llm.tables import Tables
from tabwarden.llm.words import HEAD, SPACE, Runs, among, fingerprints, first_of_each, long_column, sums

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 200, 50, 2
MEASURES = ("docs", "good", "toxic")
SLICE_BYTES = 1 << 19
_CAPITAL, _MARK = among("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), among("#$%&*|")
#: Rows pass, fail, all: what a step takes of an axis whose places are pass (0) and fail (1).
_SELECT = np.array([[1, 0], [0, 1], [1, 1]], np.int64)
_PASS, _FAIL, _ALL = range(3)


def text_bits(text: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(failed filters A to D as bits 0 to 3, fingerprints) of texts; null counts as empty."""
    raw, off = flat_bytes(text)
    words = Runs(raw, off, SPACE)
    n = np.diff(words.off)
    row = words.row()
    order, begin, _ = first_of_each(row, words.hashes())
    kinds = np.bincount(row[order][begin], minlength=len(n)) if len(row) else np.zeros(len(n), np.int64)
    failed = (n < LEAST_WORDS, 100 * kinds < LEAST_DISTINCT_PERCENT * n, 100 * sums(_CAPITAL[raw], off) > MOST_CAPITALS_PERCENT * sums(HEAD[raw], off), sums(_MARK[raw], off) > 0)
    return sum(f.astype(np.int64) << k for k, f in enumerate(failed)), fingerprints(raw, off)


_TEXT = StructType([StructField("id", LongType()), StructField("part", StringType()), *(StructField(c, LongType()) for c in ("bits", "f1", "f2"))])


def _text_map(batches):
    for batch in batches:
        at = 0
        for ids, text in slices([batch], SLICE_BYTES):
            bits, prints = text_bits(text)
            yield pa.RecordBatch.from_arrays([ids, batch.slice(at, len(ids)).column(2), long_column(bits), long_column(prints[:, 0]), long_column(prints[:, 1])], names=_TEXT.names)
            at += len(ids)


def tensors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, cell, docs, good, toxic): the documents of each part and cell; bit k of a cell is set if filter k failed.

    Rows with the smallest id of their text pass the filter of copies. To find them, equal (text, id) are
    counted together before the texts' smallest ids are looked up, so a text of a third of all rows spreads
    over many tasks; the lookup joins on (text, id), which no text makes hot.
    """
    write = Tables(docs.sparkSession, "filter-audit")
    src = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"))
    marks = labels.where(labels[id_col].isNotNull()).groupBy(labels[id_col].cast("bigint").alias("id")).agg(
        F.max((labels["quality"] == 1).cast("int")).alias("good"), F.max((labels["toxic"] == 1).cast("int")).alias("toxic"))
    flag = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c)
    rows = src.mapInArrow(_text_map, _TEXT).join(marks, "id", "left")
    rows = write(rows.groupBy("f1", "f2", "id", "part", "bits").agg(F.count(F.lit(1)).alias("docs"), flag("good"), flag("toxic")), "rows")
    first = rows.groupBy("f1", "f2").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    cell = (F.col("bits") + F.when(copy, 1 << 4).otherwise(0)).cast("int").alias("cell")
    return rows.join(first, ["f1", "f2", "id"], "left").groupBy("part", cell).agg(*(F.sum(m).alias(m) for m in MEASURES))


def contracted(tensor: np.ndarray) -> np.ndarray:
    """Counts for every choice of pass, fail or all along each axis: (..., 2 x 5) becomes (..., 3 x 5)."""
    return np.einsum("...abcde,ia,jb,kc,ld,me->...ijklm", tensor, *[_SELECT] * 5)


def _steps() -> list[tuple[str, int, int, dict[str, tuple[int, ...]]]]:
    """(order, step, filter, choices of its contractions) of every step of every order."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        for step, f in enumerate(order):
            choice = {name: [_ALL] * len(FILTERS) for name in ("kept", "removed", "failing", "alone")}
            choice["alone"] = [_PASS] * len(FILTERS)
            for before in order[:step]:
                choice["kept"][before] = choice["removed"][before] = _PASS
            choice["kept"][f] = _PASS
            for name in ("removed", "failing", "alone"):
                choice[name][f] = _FAIL
            out.append(("".join(FILTERS[k] for k in order), step + 1, f, {k: tuple(v) for k, v in choice.items()}))
    return out


_RESULT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_AUDIT = StructType([StructField("part", StringType()), StructField("filter_order", StringType()), StructField("step", IntegerType()), *(StructField(c, LongType()) for c in _RESULT)])


def _audit_map(batches):
    steps = _steps()
    at = {name: np.array([s[3][name] for s in steps]).T for name in steps[0][3]}
    which = np.array([s[2] for s in steps])
    orders, numbers = pa.array([s[0] for s in steps]), pa.array([s[1] for s in steps], pa.int32())
    for batch in batches:
        for k in range(len(batch)):
            flat = np.array([batch.column(c)[k].as_py() for c in range(1, 4)], np.int64)
            # bit 0 of a cell is the last axis of the reshaped counts
            full = contracted(flat.reshape(3, *[2] * 5).transpose(0, 5, 4, 3, 2, 1))
            took = lambda m, name: full[(m, *at[name])]  # noqa: E731, B023
            removed = took(0, "removed")
            shapley = np.bincount(which, removed, minlength=len(FILTERS)).astype(np.int64)[which]
            cols = [took(0, "kept"), removed, took(0, "failing") - removed, took(0, "alone"), took(1, "removed"), took(2, "removed"), shapley]
            part = pa.array([batch.column(0)[k].as_py()] * len(steps), pa.string())
            yield pa.RecordBatch.from_arrays([part, orders, numbers, *map(long_column, cols)], names=_AUDIT.names)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters fail a text with A: under LEAST_WORDS words; B: distinct words under LEAST_DISTINCT_PERCENT percent
    of its words; C: capitals A-Z over MOST_CAPITALS_PERCENT percent of its characters; D: any of ``#$%&*|``;
    E: the text of a row with a smaller id, anywhere in the table. shapley sums what a filter removes over all
    orders.

    Null text counts as empty, a null part as the empty one. A row with a null id is nobody's copy and makes
    none; rows that repeat id and text are not copies of each other. A document is good or toxic if any label
    row of its id says so; without one it is neither. No rows give no rows.
    """
    cells = tensors(docs, labels, id_col, text_col, part_col)
    full = [F.sum(F.when(F.col("cell") == c, F.col(m)).otherwise(0)).alias(f"{m}_{c}") for m in MEASURES for c in range(1 << len(FILTERS))]
    wide = cells.groupBy("part").agg(*full)
    packed = wide.select("part", *(F.array(*(f"{m}_{c}" for c in range(1 << len(FILTERS)))).alias(m) for m in MEASURES))
    return packed.mapInArrow(_audit_map, _AUDIT)
