"""Moments of many pairs of columns by cross products of blocks of rows.

A task multiplies each of its Arrow batches with itself: with values centred and missing ones set to 0,
four products of matrices hold the counts, sums and products of all pairs over their complete rows. It
gives one row per pair at its end; these are merged by the formula for joined samples, so what is shuffled
grows with tasks and pairs, never with rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTS = "p int, n long, odd long, ux double, uy double, mx double, my double, cxx double, cyy double, cxy double"
#: Columns multiplied at once; wider tables go block by block.
BLOCK = 256
_ROWS = 8_192


class _Sums:
    """Running cross products of one task."""

    def __init__(self, width: int, a: np.ndarray, b: np.ndarray) -> None:
        self.a, self.b, self.center = a, b, np.full(width, np.nan)
        self.n, self.odd, self.x, self.y, self.xx, self.yy, self.xy = (np.zeros(len(a)) for _ in range(7))
        blocks = [slice(at, at + BLOCK) for at in range(0, width, BLOCK)]
        self.tiles = []
        for one in blocks:
            for two in blocks:
                own = np.flatnonzero((a >= one.start) & (a < one.stop) & (b >= two.start) & (b < two.stop))
                if len(own):
                    self.tiles.append((one, two, own, a[own] - one.start, b[own] - two.start))

    def add(self, values: np.ndarray, known: np.ndarray) -> None:
        finite = np.isfinite(values) & known
        fresh = np.isnan(self.center) & finite.any(axis=0)
        for j in np.flatnonzero(fresh):
            # the middle value: rows that are all alike have no spread at all
            self.center[j] = np.median(values[finite[:, j], j])
        v = np.where(finite, values - np.nan_to_num(self.center), 0.0)
        m, strange, squares = known.astype(np.float64), (known & ~finite).astype(np.float64), v * v
        for one, two, own, i, j in self.tiles:
            x, y, mx, my = v[:, one], v[:, two], m[:, one], m[:, two]
            self.n[own] += (mx.T @ my)[i, j]
            self.x[own] += (x.T @ my)[i, j]
            self.y[own] += (mx.T @ y)[i, j]
            self.xx[own] += (squares[:, one].T @ my)[i, j]
            self.yy[own] += (mx.T @ squares[:, two])[i, j]
            self.xy[own] += (x.T @ y)[i, j]
            if strange.any():
                self.odd[own] += (strange[:, one].T @ my)[i, j] + (mx.T @ strange[:, two])[i, j]

    def rows(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.n)
        n, x, y = self.n[some], self.x[some], self.y[some]
        center = np.nan_to_num(self.center)
        mean = [center[self.a[some]], center[self.b[some]], x / n, y / n]  # a mean is its centre and what lies between
        spread = [np.maximum(self.xx[some] - x * x / n, 0.0), np.maximum(self.yy[some] - y * y / n, 0.0), self.xy[some] - x * y / n]
        cols = [pa.array(some.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(self.odd[some].astype(np.int64)), *map(pa.array, mean), *map(pa.array, spread)]
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _PARTS.split(", ")])


def _products(width: int, a: np.ndarray, b: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(width, a, b)
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                part = batch.slice(at, _ROWS)
                known = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in part.columns])
                sums.add(np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns]).astype(np.float64), known)
        yield sums.rows()

    return run


def _merged(parts: Column) -> dict[str, Column]:
    """Moments of the joined samples. Means are taken from the first one's centre: none of their digits is lost, and equal ones stay equal."""
    total = lambda f: F.aggregate(parts, F.lit(0.0), lambda acc, s: acc + f(s))
    head = F.element_at(parts, 1)
    n = total(lambda s: s["n"].cast("double"))
    off = {"mx": lambda s: (s["ux"] - head["ux"]) + s["mx"], "my": lambda s: (s["uy"] - head["uy"]) + s["my"]}
    mean = {c: total(lambda s, c=c: s["n"] * off[c](s)) / n for c in off}
    joint = lambda held, c, d: total(lambda s: s[held] + s["n"] * (off[c](s) - F.col(c)) * (off[d](s) - F.col(d)))
    return {**mean, "cxx": joint("cxx", "mx", "mx"), "cyy": joint("cyy", "my", "my"), "cxy": joint("cxy", "mx", "my")}


def pair_products(df: DataFrame, columns: Sequence[Column], pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """(p, n, odd, cxx, cyy, cxy) of each pair of columns over the rows where both are known.

    ``odd`` counts infinite and NaN values among these rows; they are left out of the sums. A pair without
    such rows is no row of the result.
    """
    a, b = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    flat = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    parts = flat.mapInArrow(_products(len(columns), a, b), _PARTS)
    held = F.struct("n", "ux", "uy", "mx", "my", "cxx", "cyy", "cxy")
    # as many structs as tasks, in an order that does not depend on which task ended first
    grouped = parts.groupBy("p").agg(F.sum("n").alias("n"), F.sum("odd").alias("odd"), F.array_sort(F.collect_list(held)).alias("parts"))
    merged = _merged(F.col("parts"))
    centred = grouped.withColumns({c: merged[c] for c in ("mx", "my")})
    return centred.select("p", "n", "odd", *[merged[c].alias(c) for c in ("cxx", "cyy", "cxy")])
