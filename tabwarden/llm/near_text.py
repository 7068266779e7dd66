"""Near-duplicate documents: MinHash bands, odd sketches, exact check on full shingle sets.

Words are runs of bytes other than space and \\x09-\\x0D with A-Z lower-cased; a document's set holds
the 64-bit hashes of its distinct shingles. Equal sets form one class, so copies cost one row each.
MinHash values are cut into bands; documents meeting in a band are candidates. An odd sketch folds the
(position, MinHash) samples into a parity bitmap: the population count of the XOR of two bitmaps gives
the size of the samples' symmetric difference, and candidates far below the threshold go unread.
All others are decided on their full sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tabwarden.llm.arrow import constants, flat_bytes, gathered, lists, mixed, rows_as_lists, runs, slices
from tabwarden.llm.components import connected_components
from tabwarden.llm.tables import Tables

SHINGLE = 5
PERCENT = 75
BANDS, BAND_ROWS = 32, 4
SAMPLES = 256
SKETCH_WORDS = 16  # 1,024 bits
#: Sketches may underrate a pair by this much similarity (over five deviations of 256 samples) before it is passed over.
SLACK = 0.2
TILE = 512
#: Most rounds of checks against one representative; what they leave open is searched in tiles.
ROUNDS = 8
#: They end when fewer than one check in so many makes a link.
WORTH = 20
#: Up to so many ids (16 bytes each) are broadcast to pick out their texts; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Pairs of one leader that are checked in one task.
LEADER_ROWS = 256
SLICE_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
_BYTE = constants(11, 256)
_STEP = np.uint64(0x9E6C63D0676A9A99)
_BASE = constants(17, 2)


def _powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), _STEP, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the number of words of each row."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    inside = ~_SPACE[raw]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < len(raw)]
    opens[heads] = inside[heads]
    starts = np.flatnonzero(opens)
    counts = np.diff(np.searchsorted(starts, off))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    kept = _LOWER[raw[inside]]
    at = np.cumsum(inside)[starts] - 1  # start of each word among the kept bytes
    lens = np.diff(np.append(at, len(kept)))
    place = np.arange(len(kept)) - np.repeat(at, lens)
    h = np.add.reduceat(_BYTE[kept] * _powers(int(lens.max()))[place], at)
    return mixed(h + lens.astype(np.uint64) * _BASE[0]), counts


def shingle_sets(text: pa.StringArray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and n + 1 offsets."""
    words, counts = word_hashes(*flat_bytes(text))
    ends = np.cumsum(counts)
    begins = ends - counts
    mult = constants(23, width)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    off = np.concatenate(([0], np.cumsum(n)))
    first = np.repeat(begins - off[:-1], n) + np.arange(off[-1])
    length = np.repeat(np.minimum(counts, width), n)
    h = length.astype(np.uint64) * _BASE[1]
    padded = np.append(words, np.zeros(width, np.uint64))
    for j in range(width):
        h += np.where(j < length, padded[first + j], 0) * mult[j]
    mixed(h)
    for a, b in zip(off[:-1], off[1:]):
        if b - a > 1:
            h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[off[:-1][n > 0]] = True
    return h[fresh], np.concatenate(([0], np.cumsum(fresh)))[off]


def _feature_map(width: int, bands: int, band_rows: int, seed: int):
    k = max(SAMPLES, bands * band_rows)
    mul, add, fold, bit = constants(seed, k), constants(seed + 1, k), constants(seed + 2, band_rows), constants(seed + 3, 1)[0]
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, text in slices(batches, SLICE_BYTES):
            sets, off = shingle_sets(text, width)
            n = np.diff(off)
            some = np.flatnonzero(n)
            at = off[:-1][some]
            rows = len(some)
            f1, f2 = _prints(sets, off)
            keys, sketch = np.zeros((len(n), bands), np.uint64), np.zeros((len(n), SKETCH_WORDS), np.uint64)
            if rows:
                sig = np.empty((k, rows), np.uint64)
                for j in range(k):
                    sig[j] = np.minimum.reduceat(sets * mul[j] + add[j], at)
                sig >>= np.uint64(20)
                own = np.arange(rows)
                part = np.zeros((rows, SKETCH_WORDS), np.uint64)
                for j in range(k):
                    place = mixed(sig[j] * bit + np.uint64(j)) >> np.uint64(64 - (SKETCH_WORDS * 64).bit_length() + 1)
                    part[own, place >> np.uint64(6)] ^= np.uint64(1) << (place & np.uint64(63))
                sketch[some] = part
                for b in range(bands):
                    h = np.full(rows, b + 1, np.uint64) * _BASE[0]
                    for i in range(band_rows):
                        h += sig[b * band_rows + i] * fold[i]
                    keys[some, b] = mixed(h)
            cols = [ids.cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(f1), pa.array(f2), rows_as_lists(keys.view(np.int64)), rows_as_lists(sketch.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def _prints(sets: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set; 0 for an empty one."""
    f1, f2 = np.zeros(len(off) - 1, np.uint64), np.zeros(len(off) - 1, np.uint64)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        at = off[:-1][some]
        f1[some] = np.add.reduceat(mixed(sets * np.uint64(3) + np.uint64(1)), at)
        f2[some] = np.add.reduceat(mixed(sets * np.uint64(5) + np.uint64(7)), at)
    return f1.view(np.int64), f2.view(np.int64)


def _set_map(width: int):
    schema = pa.schema([("id", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("n", pa.int64()), ("members", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, text in slices(batches, SLICE_BYTES * 4):
            sets, off = shingle_sets(text, width)
            f1, f2 = _prints(sets, off)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(f1), pa.array(f2), pa.array(np.diff(off).astype(np.int64)), lists(sets.view(np.int64), off)], schema=schema)

    return run


def features(docs: DataFrame, id_col: str, text_col: str, width: int = SHINGLE, bands: int = BANDS, band_rows: int = BAND_ROWS, seed: int = 1) -> DataFrame:
    """One row per document: id, n (size of its set), f1 and f2 (fingerprint of the set), bands, sketch."""
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_feature_map(width, bands, band_rows, seed), "id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>, sketch array<bigint>")


def sketch_limit(percent: int, samples: int) -> int:
    """Most differing bits of a pair that may still reach the threshold."""
    bits = SKETCH_WORDS * 64
    differing = 2 * samples * (1 - max(0.0, percent / 100 - SLACK))
    return math.ceil(bits / 2 * (1 - (1 - 2 / bits) ** differing)) + 10


def _differing(a: str, b: str):
    return F.expr("+".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(SKETCH_WORDS)))


def _sets_of(docs: DataFrame, id_col: str, text_col: str, width: int, broadcast_ids: int, classes: DataFrame, repeated: DataFrame | None, write: Tables) -> Callable[[DataFrame], DataFrame]:
    """The function from (node) to a written table (node, members) of their full sets.

    A class is read from the text of its smallest id. Ids of several rows may stand for several sets, so
    texts are told apart by the set they give.
    """
    of = classes.select("node", F.col("node_id").alias("id"), "f1", "f2", "n")

    def sets(nodes: DataFrame) -> DataFrame:
        need = write(nodes.join(of, "node"), "need")
        few = need.count() <= broadcast_ids
        sized = F.broadcast if few else lambda x: x
        texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).join(sized(need.select("id").distinct()), "id", "left_semi")
        made = texts.mapInArrow(_set_map(width), "id bigint, f1 bigint, f2 bigint, n bigint, members array<bigint>")
        if repeated is not None:
            made = made.dropDuplicates(["id", "f1", "f2", "n"])
        return write(made.join(sized(need), ["id", "f1", "f2", "n"]).select("node", "members"), "sets")

    return sets


def verified(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, write: Tables, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. The set of an ``a`` of many pairs is copied, so that its pairs spread over tasks."""
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    heads = write(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / LEADER_ROWS).cast("int").alias("parts")).where("parts > 1"), "leaders")
    heads = F.broadcast(heads) if heads.count() <= broadcast_ids else heads
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(heads, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    sa = sets.join(heads.withColumnRenamed("a", "node"), "node", "left").select(F.col("node").alias("a"), F.col("members").alias("sa"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    sb = sets.select(F.col("node").alias("b"), F.col("members").alias("sb"))
    both = dealt.join(sb, "b").join(sa, ["a", "part"]).select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("bigint").alias("common"), (F.size("sa") + F.size("sb")).cast("bigint").alias("total"))
    return write(both.where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("total") - F.col("common"))).select("a", "b").distinct(), "links")


def _open_buckets(members: DataFrame, comps: DataFrame, turn: int, write: Tables) -> DataFrame:
    """Rows (key, node, comp) of the buckets that span several components, with the largest of these and one of its members."""
    named = write(members.select("key", "node").join(comps, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp")), "named")
    draw = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
    per = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.min_by("node", draw).alias("leader"))
    top = F.max(F.struct("c", (-F.col("comp")).alias("low"), "leader")).alias("top")
    per = per.groupBy("key").agg(F.sum("c").alias("rows"), top, F.count(F.lit(1)).alias("comps")).where("comps > 1")
    heads = write(per.select("key", "rows", F.col("top.c").alias("most"), (-F.col("top.low")).alias("major"), "top.leader"), "heads")
    return write(named.join(heads, "key"), "open")


def _tiled(rows: DataFrame) -> DataFrame:
    """Rows of open buckets dealt into tiles of at most TILE x TILE: those outside the largest component (side 0) meet all (side 1)."""
    rows = rows.withColumns({"nr": F.ceil(F.col("rows") / TILE).cast("int"), "nl": F.ceil((F.col("rows") - F.col("most")) / TILE).cast("int")})
    spot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("comp <> major").withColumn("bl", spot("nl")).withColumn("br", every("nr")).withColumn("side", F.lit(0))
    right = rows.withColumn("br", spot("nr")).withColumn("bl", every("nl")).withColumn("side", F.lit(1))
    return left.unionByName(right).select("key", "bl", "br", "side", "node", "comp", "major")


def _near(t: pa.Table, limit: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, differing bits) of the pairs of a tile whose sketches are near, and the places of the left rows.

    Pairs are of different components and in the first band both share.
    """
    num = lambda c: t[c].to_numpy()
    wide = lambda c: t[c].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
    side, node, comp, n, sketch, bands = num("side"), num("node"), num("comp"), num("n"), wide("sketch"), wide("bands")
    major, key = int(num("major")[0]), int(num("key")[0])
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    a, b, apart = [], [], []
    for i in left:
        ok = (comp[right] != comp[i]) & ((comp[right] == major) | (node[right] > node[i]))
        ok &= 100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i])
        j = right[ok]
        if len(j):
            d = np.bitwise_count((sketch[j] ^ sketch[i]).view(np.uint64)).sum(axis=1, dtype=np.int64)
            j, d = j[d <= limit], d[d <= limit]
            same = bands[j] == bands[i]
            first = bands[i][same.argmax(axis=1)] == key
            a.append(np.full(first.sum(), i)), b.append(j[first]), apart.append(d[first])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b), np.concatenate(apart), left) if a else (empty, empty, empty, left)


def _near_map(limit: int, percent: int):
    """Of each tile the rows that are near another one, once per side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ("key", "bl", "br")):
            a, b, _, _ = _near(t, limit, percent)
            if len(a):
                yield from t.take(pa.array(np.unique(np.concatenate((a, b))))).combine_chunks().to_batches()

    return run


def _link_map(limit: int, percent: int):
    """Links of each tile, decided on the full sets: one for each row and component it is linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ("key", "bl", "br")):
            a, b, apart, _ = _near(t, limit, percent)
            node, comp = t["node"].to_numpy(), t["comp"].to_numpy()
            sets = t["members"].combine_chunks()
            flat, off = sets.flatten().to_numpy(), np.concatenate(([0], np.cumsum(pc.list_value_length(sets).to_numpy())))
            found = []
            for i in np.unique(a):
                own = np.sort(flat[off[i] : off[i + 1]])
                j = b[a == i][np.argsort(apart[a == i], kind="stable")]
                done: set = set()
                for at in range(0, len(j), 64):
                    some = np.array([k for k in j[at : at + 64].tolist() if comp[k] not in done], np.int64)
                    if not len(some):
                        continue
                    values, starts = gathered(flat, off, some)
                    place = np.minimum(np.searchsorted(own, values), len(own) - 1)
                    common = np.add.reduceat((own[place] == values).astype(np.int64), starts[:-1])
                    union = len(own) + np.diff(starts) - common
                    for k in some[100 * common >= percent * union].tolist():
                        if comp[k] not in done:
                            done.add(comp[k])
                            found.append((node[i], node[k]))
            if found:
                x, y = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return run


def _across(rows: DataFrame, looks: DataFrame, sets_of: Callable[[DataFrame], DataFrame], limit: int, percent: int, write: Tables) -> DataFrame:
    """Links between components that share a bucket, searched whole.

    First the tiles are reduced to rows with a partner by sketch, then full sets are attached to these and
    decide. Both steps give at most a row per row and tile, not the tile's pairs.
    """
    tiles = _tiled(rows).join(looks, "node")
    keys = ("key", "bl", "br")
    sorted_ = lambda df: df.repartition(*keys).sortWithinPartitions(*keys)
    schema = "node bigint, key bigint, bl int, br int, side int, comp bigint, major bigint, n bigint, sketch array<bigint>, bands array<bigint>"
    near = write(sorted_(tiles.select(*(c.split()[0] for c in schema.split(", ")))).mapInArrow(_near_map(limit, percent), schema), "near")
    full = near.join(sets_of(near.select("node").distinct()), "node")
    return write(sorted_(full).mapInArrow(_link_map(limit, percent), "a bigint, b bigint").distinct(), "links")


def _contracted(comps: DataFrame, links: DataFrame, write: Tables) -> DataFrame:
    """Components after more links between documents."""
    named = lambda c: comps.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    ends = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = connected_components(ends).select(F.col("node").alias("component"), F.col("component").alias("root"))
    fresh = joined.select(F.col("component").alias("node"), "component").join(comps, "node", "left_anti")
    return write(comps.unionByName(fresh).join(joined, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "comps")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, band_rows: int = BAND_ROWS, rounds: int = ROUNDS, broadcast_ids: int = BROADCAST_IDS, seed: int = 1
) -> DataFrame:
    """One row per document: ``id_col``, n_shingles, component_id, kept.

    Documents are linked when 100 * |A and B| >= percent * |A or B| on their full sets; ``component_id``
    is the smallest id reachable. A null or blank text has no shingle and links with nothing; a text with
    fewer than ``width`` words is one shingle. Rows that repeat an id are documents of their own, with
    that id; several may be kept if their texts differ. A null id links with nothing: component_id is
    null and kept is true. Other columns are ignored. A pair at the threshold is missed by all bands with
    a chance of 5e-6.

    Buckets are never expanded into all pairs. In each round every document outside its bucket's largest
    component is checked with one member of that component, the nearest by sketch of those its buckets
    offer; links are contracted. When a round finds few, buckets that still span several components are
    searched whole, in tiles.
    """
    out = _marked(docs, id_col, text_col, width, percent, bands, band_rows, rounds, broadcast_ids, seed)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def _marked(docs: DataFrame, id_col: str, text_col: str, width: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, band_rows: int = BAND_ROWS, rounds: int = ROUNDS, broadcast_ids: int = BROADCAST_IDS, seed: int = 1) -> DataFrame:
    """(id, n, f1, f2, component_id, kept) of every row; n, f1 and f2 tell its set."""
    write = Tables(docs.sparkSession, "near-text")
    limit = sketch_limit(percent, max(SAMPLES, bands * band_rows))
    feats = write(features(docs, id_col, text_col, width, bands, band_rows, seed), "features")
    grouped = feats.where("n > 0 and id is not null").groupBy("f1", "f2", "n").agg(F.min("id").alias("node_id"), F.min_by(F.struct("bands", "sketch"), "id").alias("x"))
    # written before it is read, so a class keeps its number
    classes = write(grouped.select(F.monotonically_increasing_id().alias("node"), "f1", "f2", "n", "node_id", "x.bands", "x.sketch"), "classes")
    repeated = write(feats.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id"), "repeated")
    repeated = None if repeated.isEmpty() else repeated
    keyed = classes.select("node", F.explode("bands").alias("key"))
    shared = write(keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("key"), "shared")
    rows = keyed.join(shared, "key")
    comps = write(classes.limit(0).select("node", F.col("node").alias("component")), "comps")
    sets_of = _sets_of(docs, id_col, text_col, width, broadcast_ids, classes, repeated, write)
    looks = classes.select("node", "n", "sketch")
    look = lambda c: looks.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"k{c}"))
    for turn in range(rounds):
        rows = _open_buckets(rows, comps, turn, write)
        pairs = rows.where("comp <> major").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct().join(look("b"), "b").join(look("a"), "a")
        pairs = pairs.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", _differing("ka", "kb").alias("apart")).where(f"apart <= {limit}")
        pairs = write(pairs.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("x")).select("x.a", "b"), "pairs")
        links = verified(pairs, sets_of, percent, write, broadcast_ids)
        tried, found = pairs.count(), links.count()
        if found:
            comps = _contracted(comps, links, write)
        if found * WORTH <= tried:
            break
    rows = _open_buckets(rows, comps, rounds, write)
    links = _across(rows, classes.select("node", "n", "sketch", "bands"), sets_of, limit, percent, write)
    if not links.isEmpty():
        comps = _contracted(comps, links, write)
    named = write(classes.select("f1", "f2", "n", "node", "node_id").join(comps, "node", "left").select("f1", "f2", "n", "node_id", F.coalesce("component", "node").alias("component")), "classes-named")
    low = write(named.groupBy("component").agg(F.min("node_id").alias("component_id")), "smallest")
    named = write(named.join(low, "component").select("f1", "f2", "n", "component_id"), "classes-marked")
    own = feats.select("id", "n", "f1", "f2").join(named, ["f1", "f2", "n"], "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return own.select("id", "n", "f1", "f2", comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def _with_set_map(fields: list[StructField], width: int):
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, text in slices([batch], SLICE_BYTES):
                sets, off = shingle_sets(text, width)
                f1, f2 = _prints(sets, off)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(off).astype(np.int64)), pa.array(f1), pa.array(f2), *batch.slice(at, len(ids)).columns[2:]], names=names)
                at += len(ids)

    return run


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, broadcast_ids: int = BROADCAST_IDS, width: int = SHINGLE, **options) -> DataFrame:
    """The kept documents with all their columns; rows with a null id all stay.

    Of rows that repeat an id and are near each other one stays, the first by a hash of the row; others
    with that id stay if they are kept on their own.
    """
    write = Tables(docs.sparkSession, "near-text-drop")
    marks = write(_marked(docs, id_col, text_col, width, broadcast_ids=broadcast_ids, **options).where("id is not null"), "marks")
    per = marks.groupBy("id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows")).where("not kept or rows > 1")
    name = "marked_id"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    per = write(per.select(F.col("id").alias(name), (F.col("rows") > 1).alias(f"{name}_rows")), "ids")
    sized = F.broadcast if per.count() <= broadcast_ids else lambda x: x
    own = docs[id_col].cast("bigint") == F.col(name)
    single = docs.join(sized(per.select(name)), own, "left_anti")
    several = per.where(F.col(f"{name}_rows")).select(name)
    if several.isEmpty():
        return single
    # rows that share an id are told apart by their sets
    row = F.struct(*(docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)))
    src = docs.join(sized(several), own, "left_semi").select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"), row.alias("row"))
    fields = [src.schema["id"], *(StructField(c, LongType()) for c in ("n", "f1", "f2")), src.schema["row"]]
    rows = src.mapInArrow(_with_set_map(fields, width), StructType(fields))
    kept = marks.where("kept").select("id", "n", "f1", "f2", "component_id").distinct()
    first = rows.join(kept, ["id", "n", "f1", "f2"]).groupBy("id", F.when(F.col("n") > 0, F.col("component_id")).alias("component")).agg(F.min_by("row", F.struct(F.xxhash64("row"), "n", "f1", "f2")).alias("row"))
    return single.unionByName(first.select(*(F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns))))
