"""Vectors of one table that lie near a vector of another, by sign hashing.

The signs of a vector against random planes give it one bucket in each of several tables; vectors at a
cosine of the threshold share a bucket in at least one of them with a stated chance. What meets in a bucket
is compared exactly. Equal vectors are one class from the start. A class is first compared with one train
vector of each of its buckets, which settles dense regions at the cost of one comparison per class and
table; the classes left go through their buckets whole, in tiles of matrix products that return the
classes found, never the pairs.

Buckets first hold sketches alone: a vector's hash and the signs against SKETCH planes of its own, 26 bytes a
table however wide it is. Pairs whose sketches differ in few signs are candidates. They meet as vectors of one
byte a component, which with their rounding errors bound the cosine; only vectors of pairs that may be near
are moved whole, and compared exactly. A test vector with more than CANDIDATES in a bucket, none of which was
near, is looked for in the other ways.

Before any of that, test is compared with a few train vectors that lie apart from each other. In columns that
lean one way, such as keys beside prices, they settle nearly all rows in one scan and nothing is moved. If few
vectors stay open, train is scanned for these; only if many do are they hashed.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.sources.storage import scratch_path

#: Chance that a pair just at the threshold shares a bucket.
RECALL = 0.99999
#: Most vectors of one side of a tile.
TILE = 1_024
#: Tasks that the rows of one bucket are dealt to when they look up its facts.
SALTS = 16
#: Rows that compare themselves with one representative in one task.
REPRESENTED = 65_536
#: Cost of a vector that meets another one by chance, in units of a bucket entry.
MEETING_COST = 8
#: Most vectors of train that test is compared with first, of one task and in all, and most open ones that train is scanned for.
TASK_COVER, COVER, OPEN = 256, 1_024, 8_192
#: Bytes that either may take, and those of the open ones that a task lists.
HELD_BYTES, LISTED_BYTES = 1 << 22, 1 << 19
#: Signs of a sketch, and train vectors of a bucket that a test vector is a candidate with.
SKETCH, CANDIDATES = 128, 16
#: Chance that the sketches of a pair at the threshold differ too much, as a share of the chance to miss it.
SKETCH_SHARE = 0.5
#: Cost of comparing two sketches, in units of a bucket entry.
COMPARE_COST = 0.0004
#: Sketches that one task compares at a time, vectors in a slot of a table, and hashes that a task may hold.
CELLS, SLOT, HELD_IDS = 1 << 18, 1 << 18, 1 << 20
_ENTRY = np.dtype([("k", "<u2"), ("h", "<i8"), ("a", "<u8"), ("b", "<u8")])
_SLICE = 4_096
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


@functools.lru_cache(maxsize=4)
def _planes(seed: int, width: int, n: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((width, n))


def tables_for(bits: int, threshold: float, recall: float = RECALL) -> int:
    """Tables that give a pair at the threshold a common bucket with the chance ``recall``."""
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if same >= recall else math.ceil(math.log(1 - recall) / math.log1p(-same))


def best_bits(n: int, threshold: float, recall: float = RECALL, cost: float = MEETING_COST) -> int:
    """Bits of a bucket's name at which entries and chance meetings of ``n`` vectors cost least together."""
    return min(range(1, 41), key=lambda b: tables_for(b, threshold, recall) * (1 + cost * n / 2.0**b))


def most_flips(signs: int, threshold: float, miss: float) -> int:
    """Signs in which a pair at the threshold differs at most, but for the chance ``miss``."""
    flip, kept = math.acos(threshold) / math.pi, 0.0
    for k in range(signs):
        kept += math.comb(signs, k) * flip**k * (1 - flip) ** (signs - k)
        if kept >= 1 - miss:
            return k
    return signs


def _rows(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and the rows of a list column filled up with zeros."""
    lens = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lens), int(lens.max(initial=0))))
    out[np.arange(out.shape[1]) < lens[:, None]] = col.flatten().to_numpy(zero_copy_only=False)
    return lens, out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[2]
    h = (h ^ (h >> np.uint64(27))) * _ODD[3]
    return h ^ (h >> np.uint64(33))


def _identity(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hash of each row's bits."""
    raw = np.ascontiguousarray(x + 0.0).view(np.uint64)
    place = _mixed(np.arange(1, x.shape[1] + 1, dtype=np.uint64) * _ODD[salt])
    return _mixed((_mixed(raw ^ place) * (place | np.uint64(1))).sum(axis=1, dtype=np.uint64) + np.uint64(x.shape[1]))


def _directed(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places, h1, h2, units) of the vectors that have a direction, by length: two hashes of the bits, and the vectors over their norms.

    A missing component is 0. Null, zero and infinite vectors have no direction.
    """
    there = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False))
    lens, m = _rows(col.drop_null())
    for width in np.unique(lens[lens > 0]).tolist():
        rows = np.flatnonzero(lens == width)
        x = m[rows, :width]
        x[np.isnan(x)] = 0.0
        peak = np.abs(x).max(axis=1)
        fit = (peak > 0) & np.isfinite(peak)
        rows, x, peak = rows[fit], x[fit], peak[fit]
        h1, h2 = (_identity(x, salt).view(np.int64) for salt in (0, 1))
        # a power of two first: squares of large or small components stay finite
        x = np.ldexp(x, -np.frexp(peak)[1][:, None])
        yield there[rows], h1, h2, x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), _SLICE):
            yield batch.slice(at, _SLICE)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.reshape(-1)))


def _unit_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, unit) of vectors."""
    for part in _slices(batches):
        for _, h1, h2, x in _directed(part.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), _lists(x)], names=["h1", "h2", "unit"])


def _near_any(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each row of x is near some row of y."""
    hit = np.zeros(len(x), bool)
    for at in range(0, len(y), TILE):
        rest = np.flatnonzero(~hit)
        hit[rest] = (x[rest] @ y[at : at + TILE].T >= threshold).any(axis=1)
    return hit


def _cover_map(near: float, most: int):
    """(unit) of vectors that are not near each other, at most ``most`` of a task: every vector is near one of them unless they are so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = {}, most
        for part in _slices(batches):
            for _, _, _, x in _directed(part.column(0)):
                width, picked = x.shape[1], []
                x = x[~_near_any(x, held[width], near)] if width in held else x
                while len(x) and room and len(picked) + len(held.get(width, ())) < max(1, HELD_BYTES // (8 * width)):
                    picked.append(x[0])
                    room, x = room - 1, x[x @ x[0] < near]
                if picked:
                    held[width] = np.concatenate((held[width], picked)) if width in held else np.array(picked)
                    yield pa.RecordBatch.from_arrays([_lists(np.array(picked))], names=["unit"])
            if not room:
                return

    return run


def _settle_map(cover: dict[int, np.ndarray], threshold: float, keep: bool):
    """(h1, h2, unit, n, near) of vectors: near those that are near the cover. Without ``keep`` the near ones are one row of their number.

    So are the others of a task once they take more than LISTED_BYTES.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = LISTED_BYTES
        for part in _slices(batches):
            for _, h1, h2, x in _directed(part.column(0)):
                near = _near_any(x, cover[x.shape[1]], threshold) if x.shape[1] in cover else np.zeros(len(x), bool)
                for hit in (True, False):
                    rows = np.flatnonzero(near == hit)
                    if not len(rows):
                        continue
                    if not hit:
                        left -= 8 * x.shape[1] * len(rows)
                    if keep if hit else left >= 0:
                        ids, first, n = np.unique(np.column_stack((h1[rows], h2[rows])), axis=0, return_index=True, return_counts=True)
                        cols = [pa.array(ids[:, 0]), pa.array(ids[:, 1]), _lists(x[rows[first]]), pa.array(n.astype(np.int64))]
                    else:
                        cols = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.float64())), pa.array([len(rows)], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([hit] * len(cols[0]))], names=["h1", "h2", "unit", "n", "near"])

    return run


def _unsettled_map(cover: dict[int, np.ndarray], threshold: float):
    """The vectors with a direction that are not near the cover, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            stay = np.zeros(len(part), bool)
            for places, _, _, x in _directed(part.column(0)):
                stay[places] = ~_near_any(x, cover[x.shape[1]], threshold) if x.shape[1] in cover else True
            yield part.filter(pa.array(stay))

    return run


def _search_map(wanted: dict[int, tuple[np.ndarray, np.ndarray]], threshold: float):
    """(h1, h2) of the wanted vectors that are near some vector of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = dict(wanted)
        for part in _slices(batches):
            for _, _, _, x in _directed(part.column(0)):
                ids, units_ = open_.get(x.shape[1], (None, ()))
                if len(units_) and (hit := _near_any(units_, x, threshold)).any():
                    open_[x.shape[1]] = ids[~hit], units_[~hit]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[hit, 0]), pa.array(ids[hit, 1])], names=["h1", "h2"])

    return run


def _vector_map(ids: np.ndarray | None, keep: bool = True):
    """(h1, h2, unit, n) of the vectors whose first hash is among the ascending ``ids``, or of all; without ``keep`` the unit is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            for _, h1, h2, x in _directed(part.column(0)):
                rows = np.arange(len(h1)) if ids is None else np.flatnonzero(ids[np.minimum(np.searchsorted(ids, h1), len(ids) - 1)] == h1) if len(ids) else np.arange(0)
                if len(rows):
                    pair, first, n = np.unique(np.column_stack((h1[rows], h2[rows])), axis=0, return_index=True, return_counts=True)
                    unit = _lists(x[rows[first]]) if keep else pa.nulls(len(n), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), unit, pa.array(n.astype(np.int64))], names=["h1", "h2", "unit", "n"])

    return run


_VECTOR = "h1 bigint, h2 bigint, unit array<double>, n bigint"


def _sketch_map(bits: int, tables: int, slot_bits: int, side: int, seed: int):
    """(g, side, data): the vectors of a batch dealt by table and first bits of their bucket, as entries of the rest of its bits, hash and sketch."""
    low = bits - slot_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, h1, _, x in _directed(batch.column(0)):
                h, first = np.unique(h1, return_index=True)
                signs = x[first] @ _planes(seed, x.shape[1], bits * tables + SKETCH) >= 0
                sketch = np.packbits(signs[:, -SKETCH:], axis=1).view("<u8")
                keys = (signs[:, :-SKETCH].reshape(-1, bits).astype(np.float64) @ (2.0 ** np.arange(bits))).astype(np.int64).reshape(len(h), tables)
                for table in range(tables):
                    order = np.argsort(keys[:, table], kind="stable")
                    key, out = keys[order, table], np.empty(len(h), _ENTRY)
                    out["k"], out["h"], out["a"], out["b"] = key & ((1 << low) - 1), h[order], sketch[order, 0], sketch[order, 1]
                    slots, starts = np.unique(key >> low, return_index=True)
                    data = [out[i:j].tobytes() for i, j in zip(starts, [*starts[1:], len(h)])]
                    yield pa.RecordBatch.from_arrays([pa.array((table << slot_bits) + slots), pa.array([side] * len(data), pa.int32()), pa.array(data, pa.binary())], names=["g", "side", "data"])

    return run


def _meet_map(half: int, whole: int):
    """(t, r, more) of a slot: hashes of test and train vectors of one bucket whose sketches differ in at most ``whole`` signs, and ``half`` of the first half."""
    schema = pa.schema([("t", pa.int64()), ("r", pa.int64()), ("more", pa.bool_())])

    def entries(t: pa.Table, side: int) -> np.ndarray:
        e = np.frombuffer(b"".join(t.filter(pc.equal(t["side"], side))["data"].to_pylist()), _ENTRY)
        e = e[np.lexsort((e["h"], e["k"]))]
        return e[np.append(True, (e["k"][1:] != e["k"][:-1]) | (e["h"][1:] != e["h"][:-1]))] if len(e) else e

    def run(t: pa.Table) -> pa.Table:
        one, two = entries(t, 0), entries(t, 1)
        keys = np.intersect1d(one["k"], two["k"])
        ends = [np.searchsorted(e["k"], keys, how) for e in (one, two) for how in ("left", "right")]
        (a1, b1), (a2, b2) = ((np.ascontiguousarray(e["a"]), np.ascontiguousarray(e["b"])) for e in (one, two))
        found = []
        for at, end, lo, hi in zip(*ends):
            step = max(1, CELLS // (hi - lo))
            for i in range(at, end, step):
                here = a1[i : min(i + step, end)]
                flips = np.bitwise_count(here[:, None] ^ a2[None, lo:hi])
                hit = np.flatnonzero(flips <= half)
                if len(hit):
                    p, q = np.divmod(hit, hi - lo)
                    n = flips.reshape(-1)[hit].astype(np.int64) + np.bitwise_count(b1[i + p] ^ b2[lo + q])
                    p, q, n = (v[n <= whole] for v in (p, q, n))
                    order = np.lexsort((n, p))
                    p, q = p[order], q[order]
                    rank = np.arange(len(p)) - np.searchsorted(p, p)
                    more = np.isin(p, p[rank >= CANDIDATES])
                    found.append((i + p[rank < CANDIDATES], lo + q[rank < CANDIDATES], more[rank < CANDIDATES]))
        if not found:
            return schema.empty_table()
        p, q, more = (np.concatenate(v) for v in zip(*found))
        return pa.Table.from_arrays([pa.array(one["h"][p]), pa.array(two["h"][q]), pa.array(more)], schema=schema)

    return run


def _byte_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, q, scale, error): units rounded to ``scale`` times the bytes ``q``, and how far that is from them."""
    for part in _slices(batches):
        for _, h1, _, x in _directed(part.column(0)):
            h, first = np.unique(h1, return_index=True)
            x = x[first]
            scale = np.abs(x).max(axis=1) / 127
            q = np.rint(x / scale[:, None]).astype(np.int8)
            error = np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1)) + 1e-9
            raw = pa.array([row.tobytes() for row in q], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(h), raw, pa.array(scale), pa.array(error)], names=["h", "q", "scale", "error"])


def _close_map(threshold: float):
    """(t, r) of the pairs that may reach the threshold by their rounded units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            get = lambda c: part.column(c).to_numpy(zero_copy_only=False)  # noqa: E731,B023
            lens = [pc.binary_length(part.column(c)).to_numpy(zero_copy_only=False) for c in ("q", "q2")]
            stay = np.zeros(len(part), bool)
            for width in np.unique(lens[0]).tolist():
                rows = np.flatnonzero((lens[0] == width) & (lens[1] == width))
                x, y = (np.frombuffer(b"".join(part.column(c).take(pa.array(rows)).to_pylist()), np.int8).reshape(len(rows), width).astype(np.float64) for c in ("q", "q2"))
                one, two = get("error")[rows], get("error2")[rows]
                stay[rows] = np.einsum("ij,ij->i", x, y) * get("scale")[rows] * get("scale2")[rows] + one + two + one * two >= threshold
            yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(stay)) for c in ("t", "r")], names=["t", "r"])

    return run


def _code_map(bits: int, tables: int, seed: int):
    """(h1, h2, codes): the bucket in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _SLICE):
                part = batch.slice(at, _SLICE)
                lens, m = _rows(part.column(2))
                codes = np.zeros((len(lens), tables), np.int64)
                for width in np.unique(lens).tolist():
                    rows = np.flatnonzero(lens == width)
                    signs = (m[rows, :width] @ _planes(seed, width, bits * tables) >= 0).reshape(len(rows), tables, bits)
                    codes[rows] = (signs * (1 << np.arange(bits))).sum(axis=2) + (width << 41)
                held = pa.ListArray.from_arrays(pa.array((np.arange(len(lens) + 1) * tables).astype(np.int32)), pa.array(codes.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), held], names=["h1", "h2", "codes"])

    return run


def _tile_map(threshold: float):
    """Rows come sorted by tile; gives the test classes (side 0) near some train vector (side 1) of their tile."""
    keys = ("table", "key", "bt", "br")

    def near(t: pa.Table) -> pa.RecordBatch:
        side = t["side"].to_numpy()
        _, m = _rows(t["unit"].combine_chunks())
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        hit = one[(m[one] @ m[two].T >= threshold).any(axis=1)] if len(one) and len(two) else one[:0]
        return pa.RecordBatch.from_arrays([pa.array(t[c].to_numpy()[hit]) for c in ("h1", "h2")], names=["h1", "h2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not len(batch):
                continue
            key = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys])
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(batch)]):
                if last is not None and (key[a] != last).any():
                    yield near(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = key[a]
        if held:
            yield near(pa.Table.from_batches(held))

    return run


def _vectors(df: DataFrame, column: str = "v") -> DataFrame:
    return df.select(F.col(column).cast("array<double>").alias("v"))


def units(vectors: DataFrame, column: str = "v") -> DataFrame:
    """(h1, h2, unit, n): the distinct vectors with a direction, and their rows. Null, zero and infinite vectors have none."""
    return _vectors(vectors, column).mapInArrow(_unit_map, "h1 bigint, h2 bigint, unit array<double>").groupBy("h1", "h2").agg(F.first("unit").alias("unit"), F.count(F.lit(1)).alias("n"))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


class Matcher:
    """One search of test classes near train classes; tables between the steps are written to the shared folder."""

    def __init__(self, train: DataFrame, test: DataFrame, threshold: float, recall: float = RECALL, seed: int = 1) -> None:
        self.spark, self.base, self.threshold = train.sparkSession, scratch_path(train.sparkSession, "near-vectors"), threshold
        self.recall, self.seed, self.sides = recall, seed, (_vectors(train), _vectors(test))

    @functools.cached_property
    def train(self) -> DataFrame:
        """The classes of train."""
        return self._written(units(self.sides[0]), "train")

    @functools.cached_property
    def test(self) -> DataFrame:
        """The classes of test."""
        return self._written(units(self.sides[1]), "test")

    @functools.cached_property
    def codes(self):
        bits = best_bits(self.train.count(), self.threshold, self.recall)
        return _code_map(bits, tables_for(bits, self.threshold, self.recall), self.seed)

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def _keyed(self, classes: DataFrame) -> DataFrame:
        """(h1, h2, table, key) of the buckets of classes."""
        coded = classes.select("h1", "h2", "unit").mapInArrow(self.codes, "h1 bigint, h2 bigint, codes array<bigint>")
        return coded.select("h1", "h2", F.posexplode("codes").alias("table", "key"))

    def shared(self, left: DataFrame, name: str) -> DataFrame:
        """(table, key, ct, cr, rep): the buckets with test classes of ``left`` and train classes, their numbers, and one of the latter."""
        of_test = self._keyed(left).groupBy("table", "key").agg(F.count(F.lit(1)).alias("ct"))
        of_train = self._keyed(self.train).groupBy("table", "key").agg(F.count(F.lit(1)).alias("cr"), F.min(F.struct("h1", "h2")).alias("rep"))
        return self._written(of_test.join(of_train, ["table", "key"]).select("table", "key", "ct", "cr", "rep"), name)

    def _met(self, classes: DataFrame, shared: DataFrame) -> DataFrame:
        """The buckets of classes with the facts of ``shared``; rows of one bucket look them up in SALTS tasks."""
        salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return self._keyed(classes).withColumn("salt", F.pmod("h1", F.lit(SALTS)).cast("int")).join(salted, ["table", "key", "salt"]).drop("salt")

    def represented(self, left: DataFrame, shared: DataFrame) -> DataFrame:
        """(h1, h2) of the classes near the representative of one of their buckets."""
        share = F.pmod(F.xxhash64("h1", "h2"), F.ceil(F.col("ct") / REPRESENTED))
        pairs = self._met(left, shared).select("h1", "h2", F.col("rep.h1").alias("r1"), F.col("rep.h2").alias("r2"), F.ceil(F.col("ct") / REPRESENTED).alias("parts"), share.alias("part")).distinct()
        reps = shared.select(F.col("rep.h1").alias("r1"), F.col("rep.h2").alias("r2"), F.ceil(F.col("ct") / REPRESENTED).alias("parts")).distinct()
        reps = reps.join(self.train.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("unit").alias("other")), ["r1", "r2"])
        reps = reps.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        both = pairs.join(left.select("h1", "h2", "unit"), ["h1", "h2"]).join(reps, ["r1", "r2", "parts", "part"])
        return self._written(both.where((F.size("unit") == F.size("other")) & (_dot("unit", "other") >= self.threshold)).select("h1", "h2").distinct(), "represented")

    def tiles(self, left: DataFrame, shared: DataFrame) -> DataFrame:
        """Rows of both sides dealt into tiles of at most TILE x TILE: (table, key, bt, br, side, h1, h2, unit)."""
        sized = shared.select("table", "key", F.ceil(F.col("ct") / TILE).cast("int").alias("nt"), F.ceil(F.col("cr") / TILE).cast("int").alias("nr"))
        spot = lambda n: F.pmod(F.xxhash64("h1", "h2"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        place = ("table", "key", "bt", "br", "side", "h1", "h2", "unit")
        one = self._met(left, sized).join(left.select("h1", "h2", "unit"), ["h1", "h2"]).withColumn("bt", spot("nt")).withColumn("br", every("nr")).withColumn("side", F.lit(0))
        two = self._met(self.train, sized).join(self.train.select("h1", "h2", "unit"), ["h1", "h2"]).withColumn("br", spot("nr")).withColumn("bt", every("nt")).withColumn("side", F.lit(1))
        return one.select(*place).unionByName(two.select(*place))

    def cover(self) -> dict[int, np.ndarray]:
        """Train vectors that are not near each other, at most COVER of them, by length: they settle the dense regions of test."""
        near = math.cos(math.acos(self.threshold) / 2)
        picked = self.sides[0].mapInArrow(_cover_map(near, TASK_COVER), "unit array<double>").repartition(1).mapInArrow(_cover_map(near, COVER), "unit array<double>")
        units_ = [np.array(r.unit) for r in picked.collect()]  # HELD_BYTES of each length
        return {w: np.stack([u for u in units_ if len(u) == w]) for w in {len(u) for u in units_}}

    def matched(self, keep: bool = True) -> DataFrame:
        """(h1, h2, unit, n) of the test vectors with a train vector at the threshold or above; one may have several rows.

        Without ``keep`` those near the cover are known by their number only.
        """
        key, cover = ["h1", "h2"], self.cover()
        rows = self._written(self.sides[1].mapInArrow(_settle_map(cover, self.threshold, keep), "h1 bigint, h2 bigint, unit array<double>, n bigint, near boolean"), "settled")
        near, rest = rows.where("near").drop("near"), rows.where("not near").drop("near")
        size = rest.agg(F.count(F.lit(1)).alias("n"), F.count("h1").alias("listed"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.size("unit")), F.lit(0)).alias("cells")).first()
        if size["listed"] < size["n"] or size["n"] > OPEN or 8 * size["cells"] > HELD_BYTES:
            if (near.agg(F.sum("n")).first()[0] or 0) < size["rows"]:  # the cover is of little help: not asked again in each scan
                return self.hashed(keep)
            return near.unionByName(Matcher(self.sides[0], self.sides[1].mapInArrow(_unsettled_map(cover, self.threshold), "v array<double>"), self.threshold, self.recall, self.seed).hashed(keep))
        return near.unionByName(self.searched(rest)) if size["n"] else near

    def searched(self, open_: DataFrame) -> DataFrame:
        """The rows of ``open_`` that are near train, by a scan of train: at most OPEN rows and HELD_BYTES of vectors."""
        by_width: dict[int, list] = {}
        for r in open_.select("h1", "h2", "unit").dropDuplicates(["h1", "h2"]).collect():
            by_width.setdefault(len(r.unit), []).append(r)
        wanted = {w: (np.array([(r.h1, r.h2) for r in rs], np.int64), np.array([r.unit for r in rs])) for w, rs in by_width.items()}
        found = self._written(self.sides[0].mapInArrow(_search_map(wanted, self.threshold), "h1 bigint, h2 bigint").distinct(), "searched")
        return open_.join(F.broadcast(found), ["h1", "h2"], "left_semi")

    def _of(self, side: int, ids: DataFrame) -> DataFrame:
        """The vectors of a side (0: train) with the hashes ``ids``, and with others if these are many."""
        many = ids.count() > HELD_IDS
        return self.sides[side].mapInArrow(_vector_map(None if many else np.sort(ids.toArrow().column(0).to_numpy())), _VECTOR)

    def hashed(self, keep: bool = True) -> DataFrame:
        """(h1, h2, unit, n) of the test vectors with a train vector at the threshold or above, by sketches in buckets; one may have several rows."""
        key, miss = ["h1", "h2"], (1 - self.recall) * SKETCH_SHARE
        sizes = [s.count() for s in self.sides]
        bits = best_bits(sizes[0], self.threshold, self.recall, COMPARE_COST)
        tables = tables_for(bits, self.threshold, self.recall + miss)
        slot_bits = min(bits, max(bits - 16, math.ceil(math.log2(max(sum(sizes) / SLOT, 1)))))
        entries = [self.sides[1 - side].mapInArrow(_sketch_map(bits, tables, slot_bits, side, self.seed), "g bigint, side int, data binary") for side in (0, 1)]
        meet = _meet_map(most_flips(SKETCH // 2, self.threshold, miss / 2), most_flips(SKETCH, self.threshold, miss / 2))
        met = entries[0].unionByName(entries[1]).groupBy("g").applyInArrow(meet, "t bigint, r bigint, more boolean")
        pairs = self._written(met.groupBy("t", "r").agg(F.max("more").alias("more")), "pairs")
        one, two = (s.mapInArrow(_byte_map, "h bigint, q binary, scale double, error double") for s in reversed(self.sides))
        rounded = pairs.select("t", "r").join(one.withColumnRenamed("h", "t"), "t").join(two.toDF("r", "q2", "scale2", "error2"), "r")
        close = self._written(rounded.mapInArrow(_close_map(self.threshold), "t bigint, r bigint").distinct(), "close")
        test = self._of(1, close.select("t").distinct())
        train = self._of(0, close.select("r").distinct()).select(F.col("h1").alias("r"), F.col("unit").alias("other"))
        both = close.join(test.withColumnRenamed("h1", "t"), "t").join(train, "r")
        hit = both.where((F.size("unit") == F.size("other")) & (_dot("unit", "other") >= self.threshold))
        found = self._written(hit.select(F.col("t").alias("h1"), "h2").distinct(), "found")
        near = self.sides[1].mapInArrow(_vector_map(None, keep), _VECTOR).join(found, key, "left_semi")
        some = pairs.where("more").select("t").distinct().join(found.select(F.col("h1").alias("t")), "t", "left_anti")
        some = self._written(some, "crowded")
        if some.isEmpty():
            return near
        open_ = self._of(1, some).join(some.withColumnRenamed("t", "h1"), "h1", "left_semi").select(*key, "unit", "n")
        open_ = self._written(open_.groupBy(*key).agg(F.first("unit").alias("unit"), F.sum("n").alias("n")), "open")
        size = open_.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("unit")), F.lit(0)).alias("cells")).first()
        if size["n"] <= OPEN and 8 * size["cells"] <= HELD_BYTES:
            return near.unionByName(self.searched(open_))
        rest = Matcher(*self.sides, self.threshold, self.recall, self.seed)
        rest.test = open_
        return near.unionByName(rest.tiled())

    def tiled(self) -> DataFrame:
        """(h1, h2, unit, n) of the test classes with a train vector at the threshold or above, by sign hashing and tiles of whole vectors."""
        key = ["h1", "h2"]
        known = self.train.select(*key)
        left = self._written(self.test.join(known, key, "left_anti"), "left")
        near = self.represented(left, self.shared(left, "shared"))
        open_ = self._written(left.join(near, key, "left_anti"), "open")
        tiles = self.tiles(open_, self.shared(open_, "shared-open")).repartition("table", "key", "bt", "br").sortWithinPartitions("table", "key", "bt", "br")
        found = self._written(tiles.mapInArrow(_tile_map(self.threshold), "h1 bigint, h2 bigint").distinct(), "found")
        return self._written(self.test.join(known, key, "left_semi").unionByName(left.join(near.unionByName(found), key, "left_semi")), "matched")

