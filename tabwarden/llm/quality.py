"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of each text go into a forest of shallow trees; every path from a root to a node becomes a
conjunctive rule, a lasso logistic regression picks and weighs the rules, and the chosen ones are
compiled into one Spark column expression.
"""

from __future__ import annotations

import dataclasses
import math
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.llm.arrow import flat_bytes, with_text_columns
from tabwarden.llm.near_text import word_hashes
from tabwarden.llm.toxicity import bounded_sample
from tabwarden.sources.storage import checkpointed

STATISTICS = tuple("stat_" + s for s in (
    "chars", "words", "word_length", "longest_word", "upper", "digits", "spaces", "sentence_marks", "shouts", "symbols", "bars", "beyond_ascii",
    "lines", "line_length", "distinct_words", "top_word", "repeated_neighbours",
))
PER_CLASS = 4_000
#: Training rows of one task. Each iteration of the fit is a job, and its stages and broadcasts cost the driver memory, however few rows a task has.
FIT_ROWS = 8_192
SLICE_BYTES = 1 << 20
#: Byte classes: letters, capitals, digits, blanks, line ends, marks of a sentence, shouts, symbols, bars, heads of longer characters, their rest.
_CLASSES = 11
_CLASS = np.full(256, 7, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 0, 1, 2, 3, 4
_CLASS[[ord(c) for c in ".,;:'\"-()"]], _CLASS[[ord("!"), ord("?")]], _CLASS[ord("|")], _CLASS[192:], _CLASS[128:192] = 5, 6, 8, 9, 10


@dataclasses.dataclass(frozen=True)
class Rules:
    """Weighted conjunctions of (statistic, is_greater, threshold)."""

    rules: list[tuple[tuple[tuple[str, bool, float], ...], float]]
    bias: float


def _row_sums(values: np.ndarray, begins: np.ndarray, counts: np.ndarray, how) -> np.ndarray:
    out = np.zeros(len(counts), np.int64)
    some = counts > 0
    if some.any():
        out[some] = how.reduceat(values, begins[some])
    return out


def statistics_of(text: pa.StringArray) -> np.ndarray:
    """One row of STATISTICS for each text; shares are of characters, words or neighbours."""
    raw, off = flat_bytes(text)
    rows, size = len(off) - 1, np.diff(off)
    owner = np.repeat(np.arange(rows), size)
    c = np.bincount(owner * _CLASSES + _CLASS[raw], minlength=rows * _CLASSES).reshape(rows, _CLASSES).astype(np.float64)
    chars = c.sum(axis=1) - c[:, 10]
    words, n = word_hashes(raw, off)
    ends = np.cumsum(n)
    begins = ends - n
    same = np.zeros(len(words), np.int64)
    same[1:] = words[1:] == words[:-1]
    same[begins[n > 0]] = 0
    again = _row_sums(same, begins, n, np.add)
    for a, b in zip(begins, ends):
        words[a:b].sort()
    fresh = np.ones(len(words), bool)
    fresh[1:] = words[1:] != words[:-1]
    fresh[begins[n > 0]] = True
    at = np.flatnonzero(fresh)
    run = np.diff(np.append(at, len(words)))
    kinds = np.diff(np.concatenate(([0], np.cumsum(fresh)))[np.append(begins, len(words))]) if rows else n
    top = _row_sums(run, np.concatenate(([0], np.cumsum(kinds)))[:-1], kinds, np.maximum)
    blank = np.isin(_CLASS[raw], (3, 4))
    gaps = np.flatnonzero(np.concatenate((blank, [True])))
    bound = np.unique(np.concatenate((gaps, off)))
    stretch = np.diff(bound) - blank[np.minimum(bound[:-1], len(raw) - 1)] if len(raw) else np.diff(bound)
    which = np.searchsorted(off, bound[:-1], side="right") - 1
    longest = np.zeros(rows)
    np.maximum.at(longest, np.minimum(which, rows - 1), stretch)
    per_char, per_word = np.maximum(chars, 1), np.maximum(n, 1)
    solid = chars - c[:, 3] - c[:, 4]
    return np.column_stack(
        (chars, n, solid / per_word, longest, c[:, 1] / per_char, c[:, 2] / per_char, (c[:, 3] + c[:, 4]) / per_char, c[:, 5] / per_char, c[:, 6] / per_char, c[:, 7] / per_char, c[:, 8] / per_char, c[:, 9] / per_char,
         c[:, 4] + 1, chars / (c[:, 4] + 1), kinds / per_word, top / per_word, again / per_word)
    )


def with_statistics(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document: the columns ``keep`` and STATISTICS; a null text counts as empty."""
    judge = lambda text: [pa.array(np.ascontiguousarray(c)) for c in statistics_of(text).T]
    return with_text_columns(docs, text_col, keep, ", ".join(f"{s} double" for s in STATISTICS), lambda: judge, SLICE_BYTES)


def tree_paths(debug: str, names: tuple[str, ...]) -> list[tuple[tuple[str, bool, float], ...]]:
    """All paths from a root to a node in a printed forest, each as its conditions; equal ones once."""
    found, path = {}, []
    for line in debug.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if line.lstrip().startswith("Tree "):
            path, base = [], len(line) - len(line.lstrip())
        elif m:
            path = path[: len(m[1]) - base - 2] + [(names[int(m[2])], m[3] == ">", float(m[4]))]
            found[tuple(sorted(set(path)))] = None
    return list(found)


def _holds(rule: tuple[tuple[str, bool, float], ...]) -> Column:
    out = F.lit(True)
    for name, greater, cut in rule:
        out = out & (F.col(name) > cut if greater else F.col(name) <= cut)
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, trees: int = 24, depth: int = 3, lasso: float = 0.002, seed: int = 7) -> Rules:
    """Fit on at most ``per_class`` labelled rows of each class. With one class only, or none, the rules say its share."""
    picked = F.broadcast(bounded_sample(labels, id_col, label_col, per_class))
    rows = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias("text")).join(picked, id_col)
    data = checkpointed(with_statistics(rows, "text", ["label"]).withColumn("label", F.col("label").cast("double")))
    sizes = {r["label"]: r["c"] for r in data.groupBy("label").agg(F.count(F.lit(1)).alias("c")).collect()}
    pos, neg = sizes.get(1.0, 0), sizes.get(0.0, 0)
    if not pos or not neg:
        return Rules([], 30.0 if pos else -30.0)
    weighted = data.coalesce(math.ceil((pos + neg) / FIT_ROWS)).withColumn("weight", F.when(F.col("label") == 1, (pos + neg) / (2.0 * pos)).otherwise((pos + neg) / (2.0 * neg)))
    vectors = checkpointed(VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(weighted).select("features", "label", "weight", *STATISTICS))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, weightCol="weight", featureSubsetStrategy="0.5", seed=seed).fit(vectors)
    paths = tree_paths(forest.toDebugString, STATISTICS)
    if not paths:
        return Rules([], float(np.log(pos / neg)))
    held = vectors.select("label", "weight", array_to_vector(F.array(*(_holds(p).cast("double") for p in paths))).alias("features"))
    fit = LogisticRegression(weightCol="weight", elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=80).fit(checkpointed(held))
    chosen = [(p, float(w)) for p, w in zip(paths, fit.coefficients.toArray()) if w]
    return Rules(chosen, float(fit.intercept))


def compiled(model: Rules) -> Column:
    """The score of a row of STATISTICS as one column expression."""
    total = F.lit(model.bias)
    for rule, weight in model.rules:
        total = total + F.when(_holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score(docs: DataFrame, model: Rules, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document: the columns ``keep``, score (0 to 1), predicted (1 from 0.5 on).

    Null and empty texts are scored like any other: their statistics are 0, with one line. Repeated rows
    keep a row each; other columns are ignored, and columns in ``keep`` with the name of a result give way to it.
    """
    kept = [c for c in keep if c.lower() not in ("score", "predicted")]
    row = F.struct(F.lit(0).alias("none"), *(docs[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(kept)))
    out = with_statistics(docs.select(docs[text_col].alias("text"), row.alias("row")), "text", ["row"]).withColumn("score", compiled(model))
    return out.select(*(F.col("row").getField(f"k{i}").alias(c) for i, c in enumerate(kept)), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
