"""Exact top-k search and near-duplicates of embedding vectors."""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.llm.arrow import constants, lists, mixed, runs
from tabwarden.llm.components import connected_components
from tabwarden.llm.tables import Tables

#: Rows of a tile's sides in the search, as far as their vectors take no more than SHARD_BYTES. Smaller ones are used while there are few tiles.
SHARD_ROWS, QUERY_ROWS, LEAST_ROWS = 32_768, 8_192, 1_024
SHARD_BYTES = 1 << 26
#: Scores that are computed at once.
CELLS = 1 << 22
MERGE = 16
SCALE = 256
_LONG = 2**63

COSINE = 0.95
#: Chance that a pair just at the threshold shares a bucket in some table.
RECALL = 0.9999
LEAST_BITS = 12
#: Bits of a bucket's name beyond the logarithm of the vectors: strangers meet in one of 2^SPARE_BITS of a table's buckets.
SPARE_BITS = 4
TILE = 1_024


def _usable(vec: str) -> F.Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vec).isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column; shorter rows are filled with zeros."""
    lens = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lens.max()) if len(lens) else 0
    out = np.zeros((len(lens), width))
    out[np.arange(width) < lens[:, None]] = flat
    return out


def _widened(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m


def _whole(x: float) -> int:
    """floor(SCALE * x) of any finite double."""
    return int(x) * SCALE if abs(x) >= 2**53 else math.floor(x * SCALE)


def sort_key(v: int) -> bytes:
    """Bytes that compare like the integers, whatever their size."""
    if -_LONG <= v < _LONG:
        return b"\x80" + (v + _LONG).to_bytes(8, "big")
    n = (abs(v).bit_length() + 7) // 8
    if v > 0:
        return b"\x81" + n.to_bytes(2, "big") + v.to_bytes(n, "big")
    return b"\x7f" + (0xFFFF - n).to_bytes(2, "big") + ((1 << 8 * n) - 1 + v).to_bytes(n, "big")


def _fast_top(q: np.ndarray, c: np.ndarray, own: np.ndarray, k: int, bits: int):
    """(query row, candidate, score) of the best k by one product of doubles, exact within the limit of ``bits``."""
    score = (q @ c.T).astype(np.int64)
    rank = (score << bits) - np.arange(c.shape[0])  # one number orders by score, then by id
    rank[own] = np.iinfo(np.int64).min
    n = min(k, c.shape[0])
    best = np.argpartition(rank, c.shape[0] - n, axis=1)[:, c.shape[0] - n :]
    rows, best = np.repeat(np.arange(len(q)), n), best.reshape(-1)
    keep = ~own[rows, best]
    return rows[keep], best[keep], score[rows[keep], best[keep]].tolist()


def _exact_top(q: np.ndarray, c: np.ndarray, own: np.ndarray, k: int):
    """As ``_fast_top`` for any finite components, given as they are: Python's integers, one product at a time."""
    sides = [[[_whole(x) for x in row] for row in m.tolist()] for m in (q, c)]
    rows, best, scores = [], [], []
    for i, a in enumerate(sides[0]):
        found = ((-sum(x * y for x, y in zip(a, b)), j) for j, b in enumerate(sides[1]) if not own[i, j])
        for low, j in heapq.nsmallest(k, found):
            rows.append(i), best.append(j), scores.append(-low)
    return np.array(rows, np.int64), np.array(best, np.int64), scores


def _tile_top(k: int):
    """Best k candidates of each query in one tile of queries and shards."""
    schema = pa.schema([("query_id", pa.int64()), ("low", pa.binary()), ("vec_id", pa.int64()), ("score", pa.int64()), ("tile", pa.int32())])

    def run(key, queries: pa.Table, shards: pa.Table) -> pa.Table:
        if not len(queries) or not len(shards):
            return schema.empty_table()
        qid, first = np.unique(queries["id"].to_numpy(), return_index=True)
        order = np.argsort(shards["id"].to_numpy(), kind="stable")
        cid = shards["id"].to_numpy()[order]
        q, c = _matrix(queries["vec"].combine_chunks())[first], _matrix(shards["vec"].combine_chunks())[order]
        width = max(q.shape[1], c.shape[1], 1)
        q, c = _widened(q, width), _widened(c, width)
        bits = int(len(cid)).bit_length()
        # components up to this size on both sides have exact products of doubles
        most = math.sqrt(2.0 ** min(53, 62 - bits) / width) / SCALE - 1
        small_q, small_c = np.abs(q).max(axis=1) < most, np.abs(c).max(axis=1) < most
        blocks = [(np.flatnonzero(small_q), np.flatnonzero(small_c)), (np.flatnonzero(small_q), np.flatnonzero(~small_c)), (np.flatnonzero(~small_q), np.arange(len(cid)))]
        got: list[tuple[np.ndarray, np.ndarray, list[int]]] = []
        for n, (rows, cols) in enumerate(blocks):
            if not len(rows) or not len(cols):
                continue
            side = np.floor(c[cols] * SCALE) if n == 0 else c[cols]
            step = max(1, CELLS // len(cols))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                own = cid[cols][None, :] == qid[some][:, None]
                i, j, scores = _fast_top(np.floor(q[some] * SCALE), side, own, k, bits) if n == 0 else _exact_top(q[some], side, own, k)
                got.append((qid[some[i]], cid[cols[j]], scores))
        scores = [x for _, _, s in got for x in s]
        ids = [np.concatenate([g[m] for g in got]) for m in (0, 1)]
        held = [min(max(x, -_LONG), _LONG - 1) for x in scores]
        cols = [pa.array(ids[0], pa.int64()), pa.array([sort_key(-x) for x in scores], pa.binary()), pa.array(ids[1], pa.int64()), pa.array(held, pa.int64()), pa.array([key[1].as_py()] * len(scores), pa.int32())]
        return pa.Table.from_arrays(cols, schema=schema)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k candidates with the highest integer inner product for each query: query_id, rank, vec_id, score.

    Components become floor(256 * x), of any finite size. Ranks follow the exact products; a product that
    does not fit a long is given as the nearest long. Ties go to the smaller id. A row whose id is the
    query's own is no candidate; rows that repeat an id are candidates each, queries that repeat one are
    asked once. Null ids and vectors that are null or hold null, NaN or infinity take no part; a shorter
    vector counts as filled up with zeros. Fewer candidates give fewer rows, none gives none.

    Queries and candidates are dealt into blocks of a bounded size in bytes; each tile of two blocks is one
    matrix product in one task, keeps k rows per query, and the lists are merged in a tree of MERGE lists
    at a time. Vectors so large that doubles could round are multiplied by integers, apart from the others.
    """
    kind = "float" if vectors.schema[vec_col].dataType.simpleString() == queries.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    ready = lambda df: df.where(F.col(id_col).isNotNull() & _usable(vec_col)).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))
    cand, asked = ready(vectors), ready(queries)
    size = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()

    def blocks(sized, most: int) -> int:
        rows = max(1, min(most, SHARD_BYTES // (8 * max(sized["width"] or 0, 1))))
        return max(1, math.ceil(sized["n"] / rows), min(64, math.ceil(sized["n"] / LEAST_ROWS)))

    shards, groups = blocks(size(cand), SHARD_ROWS), blocks(size(asked), QUERY_ROWS)
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("g", deal(groups)).withColumn("s", every(shards))
    right = cand.withColumn("s", deal(shards)).withColumn("g", every(groups))
    lists_ = left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInArrow(_tile_top(k), "query_id bigint, low binary, vec_id bigint, score bigint, tile int")
    while True:
        shards = math.ceil(shards / MERGE)
        step = F.floor(F.col("tile") / MERGE).cast("int").alias("tile")
        merged = lists_.groupBy("query_id", step).agg(F.slice(F.array_sort(F.collect_list(F.struct("low", "vec_id", "score"))), 1, k).alias("best"))
        if shards == 1:
            return merged.select("query_id", F.posexplode("best").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
        lists_ = merged.select("query_id", F.explode("best").alias("x"), "tile").select("query_id", "x.low", "x.vec_id", "x.score", "tile")


@functools.lru_cache(maxsize=4)
def _planes(seed: int, width: int, n: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((width, n))


def tables_for(bits: int, cosine: float, recall: float) -> int:
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - same))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by the power of two next to their largest component: cosines stay, squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def _codes(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """The bucket of each row in each table."""
    width = x.shape[1]
    signs = (x @ _planes(seed, width, bits * tables) >= 0).reshape(len(x), tables, bits)
    return mixed((signs * (np.uint64(1) << np.arange(bits, dtype=np.uint64))).sum(axis=2, dtype=np.uint64) + np.uint64(width << 40))


def _hash_map(bits: int, tables: int, seed: int):
    schema = pa.schema([("id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("codes", pa.list_(pa.int64())), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                lens = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
                m = _matrix(part.column(1))
                codes, keys = np.zeros((len(m), tables), np.uint64), np.zeros((2, len(m)), np.uint64)
                for width in np.unique(lens).tolist():
                    rows = np.flatnonzero(lens == width)
                    x = m[rows, :width] + 0.0
                    raw = np.ascontiguousarray(x).view(np.uint64)
                    m[rows, :width] = x = _scaled(x)
                    for j in (0, 1):
                        keys[j, rows] = mixed((mixed(raw * constants(31 + j, width)) * np.uint64(0x9E3779B97F4A7C15)).sum(axis=1, dtype=np.uint64) + np.uint64(width))
                    codes[rows] = _codes(x, bits, tables, seed)
                vec = [m[i, : lens[i]].astype("<f8").tobytes() for i in range(len(m))]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), lists(codes.reshape(-1).view(np.int64), np.arange(len(m) + 1) * tables), pa.array(vec, pa.binary())], schema=schema)

    return run


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place each place reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _links_in_tile(node, mult, side, codes_of, vec, table: int, within: bool, cosine: float):
    """(links to add, root) of each row of a tile; a pair counts in the first table whose bucket it shares."""
    x = np.stack([np.frombuffer(v, "<f8") for v in vec])
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    one, two = (np.arange(len(node)),) * 2 if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    dots = x[one] @ x[two].T
    near = dots / (norm[one][:, None] * norm[two][None, :]) >= cosine
    if within:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    a, b = one[i], two[j]
    add = np.zeros(len(node), np.int64)
    if table and len(a):
        rows, place = np.unique(np.concatenate((a, b)), return_inverse=True)
        codes = codes_of(x[rows])[:, :table]
        pa_, pb = place[: len(a)], place[len(a) :]
    for at in range(0, len(a), 1 << 16):
        p, q = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        fresh = ~(codes[pa_[at : at + (1 << 16)]] == codes[pb[at : at + (1 << 16)]]).any(axis=1) if table else np.ones(len(p), bool)
        np.add.at(add, p[fresh], mult[q[fresh]])
        np.add.at(add, q[fresh], mult[p[fresh]])
    return add, node[_local_roots(len(node), a, b)]


def _tile_map(cosine: float, bits: int, tables: int, seed: int):
    """Rows come sorted by (table, key, bi, bj); each run of equal keys is one tile. Buckets in other tables are worked out again, for near pairs only."""

    def emit(t: pa.Table) -> pa.RecordBatch:
        node = t["node"].to_numpy()
        order = np.argsort(node, kind="stable")
        t, node = t.take(pa.array(order)), node[order]
        within = t["bi"][0].as_py() == t["bj"][0].as_py()
        add, root = _links_in_tile(node, t["mult"].to_numpy(), t["side"].to_numpy(), lambda x: _codes(x, bits, tables, seed), t["vec"].to_pylist(), t["table"][0].as_py(), within, cosine)
        keep = (add > 0) | (root != node)
        return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(add[keep]), pa.array(root[keep])], names=["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs(batches, ("table", "key", "bi", "bj")):
            yield emit(tile)

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, cosine: float = COSINE, recall: float = RECALL, seed: int = 3) -> DataFrame:
    """One row per vector: ``id_col``, n_links, component_id, kept.

    Two vectors are linked when their cosine in double precision is at least ``cosine``, whatever their
    size: each is scaled by a power of two first. Vectors of
    different lengths are never linked; nor are null ids, and vectors that are null, zero or hold null or
    non-finite components. Equal vectors form one class, known by a hash, and count with their number. Rows
    that repeat an id count as vectors of their own. Other columns are ignored. No rows give no rows.

    Signs against random planes give a bucket in each of several tables; their number follows from
    ``recall``, the length of a code from the number of vectors. Buckets are compared in tiles of at most
    TILE x TILE by matrix products; a tile returns one row per vector, never its pairs.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fit = F.col("id").isNotNull() & _usable("v") & F.exists("v", lambda x: x != 0)
    usable = rows.where(fit)
    total = usable.count()
    bits = min(40, max(LEAST_BITS, math.ceil(math.log2(max(total, 1))) + SPARE_BITS))
    tables = tables_for(bits, cosine, recall)
    write = Tables(vectors.sparkSession, "near-vectors")
    feats = write(usable.mapInArrow(_hash_map(bits, tables, seed), "id bigint, h1 bigint, h2 bigint, codes array<bigint>, vec binary"), "features")
    grouped = feats.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("mult"), F.min_by(F.struct("codes", "vec"), "id").alias("x"))
    classes = write(grouped.select("h1", "h2", "node", "mult", "x.*"), "classes")
    keyed = classes.select("h1", "h2", F.posexplode("codes").alias("table", "key"))
    crowded = keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    crowded = write(crowded.select("table", "key", F.ceil(F.col("c") / TILE).cast("int").alias("nb")), "crowded")
    met = keyed.join(crowded, ["table", "key"]).join(classes.select("h1", "h2", "mult", "vec"), ["h1", "h2"])
    spread = met.withColumns({"b": F.pmod(F.xxhash64("h1", "h2"), F.col("nb")).cast("int"), "o": F.explode(F.sequence(F.lit(0), F.col("nb") - 1))})
    ends = F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), (F.col("b") > F.col("o")).cast("int").alias("side")
    tiles = spread.select("table", "key", *ends, F.col("h1").alias("node"), "mult", "vec").repartition("table", "key", "bi", "bj").sortWithinPartitions("table", "key", "bi", "bj")
    found = write(tiles.mapInArrow(_tile_map(cosine, bits, tables, seed), "node bigint, links bigint, root bigint"), "found")
    links = found.groupBy(F.col("node").alias("h1")).agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("root").alias("a"), F.col("node").alias("b"))).withColumnRenamed("node", "h1")
    named = classes.select("h1", "h2", "node", "mult").join(comps, "h1", "left").join(links, "h1", "left")
    named = write(named.select("h1", "h2", "node", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "h1").alias("component")), "named")
    low = write(named.groupBy("component").agg(F.min("node").alias("component_id")), "smallest")
    own = feats.select("id", "h1", "h2").join(write(named.join(low, "component").select("h1", "h2", "n_links", "component_id"), "results"), ["h1", "h2"])
    out = own.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    rest = rows.where(~F.coalesce(fit, F.lit(False))).select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(rest)
