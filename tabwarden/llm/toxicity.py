"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

N-grams of 4 to 6 letters are hashed into buckets; a feature is the presence of a bucket in a text. Each
feature's value is its naive Bayes log-count ratio r between toxic and clean texts; logistic regression
is fitted on these values, so a bucket's final weight is coefficient times r.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.llm.arrow import flat_chars, lists, slices, with_text_columns
from tabwarden.llm.language import _letters
from tabwarden.sources.storage import checkpointed

ORDERS = (4, 5, 6)
BUCKET_BITS = 20
#: Most features the classifier keeps, the most telling first.
FEATURES = 3_072
#: Training reads at most this many labelled rows of each class.
PER_CLASS = 4_000
SLICE_BYTES = 1 << 20
_MULT = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)


@dataclasses.dataclass(frozen=True)
class Model:
    buckets: list[int]
    weights: list[float]
    bias: float


def _buckets(chars: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of the n-gram at each place, and whether it lies within one row."""
    c = _letters()[chars]
    for n in ORDERS:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n * 0x632BE5AB & 0xFFFFFFFF, np.uint32)
        for j in range(n):
            h += c[j : j + m] * _MULT[j]
            h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        ok = np.ones(m, bool)
        for j in range(1, n):
            cut = off[1:-1] - j
            ok[cut[(cut >= 0) & (cut < m)]] = False
        yield h >> np.uint32(32 - BUCKET_BITS), ok


def present(text: pa.StringArray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every feature present, each once, by row. ``table`` maps buckets to features, -1 for none."""
    chars, off = flat_chars(text)
    width = 1 << BUCKET_BITS
    found = []
    for h, ok in _buckets(chars, off):
        f = table[h] if table is not None else h.astype(np.int32)
        ok &= f >= 0
        at = np.flatnonzero(ok)
        row = np.searchsorted(off, at, side="right") - 1
        found.append(row * width + f[at])
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both // width, both % width


def _count_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for label, text in slices(batches, SLICE_BYTES):
        row, f = present(text)
        y = label.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        for k in (0, 1):
            counts[k] += np.bincount(f[y == k], minlength=counts.shape[1])
    some = np.flatnonzero(counts.sum(axis=0))
    for at in range(0, len(some), 1 << 16):
        f = some[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int64)), pa.array(counts[1, f]), pa.array(counts[0, f])], names=["bucket", "p", "q"])


def _table(buckets: list[int]) -> np.ndarray:
    t = np.full(1 << BUCKET_BITS, -1, np.int32)
    t[np.array(buckets, np.int64)] = np.arange(len(buckets))
    return t


def _present_map(buckets: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(buckets)
        for label, text in slices(batches, SLICE_BYTES):
            row, f = present(text, table)
            off = np.searchsorted(row, np.arange(len(label) + 1))
            yield pa.RecordBatch.from_arrays([label.cast(pa.int64()), lists(f.astype(np.int32), off)], names=["label", "features"])

    return run


def bounded_sample(labels: DataFrame, id_col: str, label_col: str, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each class 0 and 1, the first by a hash of the id: (id_col, label)."""
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias(id_col), F.col(label_col).cast("int").alias("label")).distinct()
    order = F.xxhash64(F.col(id_col))
    return rows.where("label = 1").orderBy(order, id_col).limit(per_class).unionByName(rows.where("label = 0").orderBy(order, id_col).limit(per_class))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, features: int = FEATURES, reg: float = 0.001) -> Model:
    """Fit on at most ``per_class`` labelled rows of each class, both weighing alike. With one class only, or none, the model says its share."""
    picked = F.broadcast(bounded_sample(labels, id_col, label_col, per_class))
    rows = checkpointed(docs.select(F.col(id_col).cast("bigint").alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(picked, id_col).select("label", "text"))
    sizes = {r["label"]: r["c"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("c")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return Model([], [], 30.0 if pos else -30.0)
    counted = rows.mapInArrow(_count_map, "bucket bigint, p bigint, q bigint").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    rate_p, rate_q = (F.col("p") + 1) / F.lit(pos + 2.0), (F.col("q") + 1) / F.lit(neg + 2.0)
    both = (F.col("p") + F.col("q") + 2) / F.lit(pos + neg + 4.0)
    gain = lambda a, b: a * F.log(a / b) + (1 - a) * F.log((1 - a) / (1 - b))
    told = pos * gain(rate_p, both) + neg * gain(rate_q, both)
    top = counted.select("bucket", F.log(rate_p / rate_q).alias("r"), told.alias("told")).orderBy(F.desc("told"), "bucket").limit(features).collect()
    buckets, r = [t["bucket"] for t in top], [t["r"] for t in top]
    # presence of each bucket, then its log-count ratio in its place
    named = CountVectorizerModel.from_vocabulary([str(k) for k in range(len(r))], inputCol="features", outputCol="present").setBinary(True)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(r), inputCol="present", outputCol="scaled")
    weight = F.when(F.col("label") == 1, (pos + neg) / (2.0 * pos)).otherwise((pos + neg) / (2.0 * neg))
    data = rows.mapInArrow(_present_map(buckets), "label bigint, features array<int>").select(F.col("label").cast("double").alias("label"), F.col("features").cast("array<string>").alias("features"), weight.alias("weight"))
    data = checkpointed(scaled.transform(named.transform(data)).select("label", "weight", "scaled"))
    fit = LogisticRegression(featuresCol="scaled", weightCol="weight", regParam=reg, elasticNetParam=0.0, standardization=False, maxIter=100).fit(data)
    return Model(buckets, [float(w) * x for w, x in zip(fit.coefficients.toArray(), r)], float(fit.intercept))


def _scorer(model: Model):
    def start():
        table, weights = _table(model.buckets), np.array([*model.weights, 0.0])

        def judge(text: pa.StringArray) -> list[pa.Array]:
            row, f = present(text, table)
            z = np.bincount(row, weights[f], minlength=len(text)) + model.bias
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            return [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]

        return judge

    return start


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document: the columns ``keep``, score (0 to 1), predicted (1 from 0.5 on).

    Null and empty texts have no feature and get the score of the bias. Repeated rows keep a row each; other
    columns are ignored, and columns in ``keep`` with the name of a result give way to it.
    """
    return with_text_columns(docs, text_col, keep, "score double, predicted int", _scorer(model), SLICE_BYTES)
