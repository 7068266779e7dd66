"""Vector search and near-duplicates against brute force."""

import math

import numpy as np
import pytest

from conftest import SF
from tabwarden.llm import vectors

NAN, INF = float("nan"), float("inf")


def table(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id bigint, embedding array<{kind}>, node string").repartition(3)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_links(rows):
    parent, n = {}, {k: 0 for k in range(len(rows))}
    for k in range(len(rows)):
        parent[k] = k

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ok = [k for k, (i, v) in enumerate(rows) if i is not None and usable(v) and any(v)]
    for a in ok:
        for b in ok:
            va, vb = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if a < b and len(va) == len(vb) and va @ vb / (np.sqrt(va @ va) * np.sqrt(vb @ vb)) >= 0.95:
                n[a] += 1
                n[b] += 1
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    group = {}
    for k, (i, _) in enumerate(rows):
        group.setdefault(root(k), []).append(i)
    return sorted((rows[k][0], n[k], None if rows[k][0] is None else min(group[root(k)])) for k in range(len(rows)))


def clustered(seed=0, width=16):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for size, spread in ((60, 0.05), (40, 0.12), (30, 0.2), (25, 0.0)):
        center = rng.standard_normal(width)
        for _ in range(size):
            rows.append((i, [float(x) for x in center + spread * rng.standard_normal(width)]))
            i += 1
    rows += [(1000 + k, [float(x) for x in rng.standard_normal(width)]) for k in range(60)]
    return rows


ODD = [(2000, None), (2001, [0.0] * 16), (2002, [1.0, None] + [0.0] * 14), (2003, [NAN] * 16), (2004, [INF] + [1.0] * 15), (2005, []), (2006, [1.0, 2.0]), (2007, [2.0, 4.0])]


@pytest.mark.parametrize("tile", [8, 1024])
def test_near_duplicates_match_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    rows = clustered() + ODD
    out = vectors.near_duplicates(table(spark, rows)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == brute_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_near_duplicates_of_given_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    near = rows + [(10_000 + i, [x * 1.5 + 1e-3 for x in v]) for i, v in rows[:40]]
    out = vectors.near_duplicates(table(spark, near)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == brute_links(near)


def test_near_duplicates_without_rows(spark):
    assert vectors.near_duplicates(table(spark, [])).count() == 0
    out = vectors.near_duplicates(table(spark, [(None, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])])).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in out) == [(0, 0, None), (1, 1, 1), (2, 1, 1)]


def brute_top(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and usable(v)]
    out = []
    for q, v in ok:
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in ok if c != q)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(found)]
    return sorted(set(out))


@pytest.mark.parametrize("least", [8, 1024])
def test_search_matches_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(vectors, "LEAST_ROWS", least)
    monkeypatch.setattr(vectors, "MERGE", 3)
    rows = [r for r in clustered() if r[0] != 100] + [(3000 + i, [0.25] * 16) for i in range(10)] + [(3050, [0.25] * 16), (100, [0.25] * 16)] + ODD
    df = table(spark, rows, "float")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    out = vectors.top_k(df, df.where("vec_id % 50 = 0"), 5).collect()
    assert sorted(tuple(r) for r in out) == brute_top(rows)


def test_search_few_rows_large_components_and_repeats(spark):
    assert vectors.top_k(table(spark, []), table(spark, [])).count() == 0
    two = table(spark, [(0, [1.0]), (1, [2.0])])
    assert [tuple(r) for r in vectors.top_k(two, two.where("vec_id = 0")).collect()] == [(0, 1, 1, 256 * 512)]
    alone = table(spark, [(50, [1.0])])
    assert vectors.top_k(alone, alone).count() == 0
    big = table(spark, [(0, [4e5, 1e300]), (1, [4e5, -3.0]), (2, [4e5, -4.0])])
    out = vectors.top_k(big, big.where("vec_id = 0")).collect()
    assert [r.vec_id for r in sorted(out, key=lambda r: r.rank)] == [1, 2]
    assert [tuple(r)[1:] for r in sorted(out)] == [(1, 1, -(2**63)), (2, 2, -(2**63))]  # such scores fit no long
    again = table(spark, [(0, [1.0]), (0, [1.0]), (1, [1.0]), (1, [1.0])])
    assert sorted((r["rank"], r.vec_id) for r in vectors.top_k(again, again.where("vec_id = 0")).collect()) == [(1, 1), (2, 1)]


def test_number_of_tables_follows_recall():
    assert vectors.tables_for(12, 0.95, 0.9999) > vectors.tables_for(12, 0.95, 0.99) > vectors.tables_for(8, 0.95, 0.99)


def whole(x):
    from fractions import Fraction

    return math.floor(Fraction(x) * 256)


@pytest.mark.parametrize("size", [1.0, 1e6, 1e12, 1e200, 1e-200, 1.5e308])
def test_search_is_exact_for_all_finite_sizes(spark, size):
    """One vector in three is multiplied by ``size``; ranks and scores follow Python's integers."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.uniform(-1, 1, 6) * (size if i % 3 == 0 else 1)]) for i in range(120)] + [(500, [1.0, 0.0]), (501, [1e6, 0.0]), (502, [6e5, 0.0])]
    df = table(spark, rows)
    got = sorted(tuple(r) for r in vectors.top_k(df, df.where("vec_id % 50 = 0")).collect())
    ints = {i: [whole(x) for x in v] for i, v in rows}
    want = []
    for q in (i for i in ints if i % 50 == 0):
        found = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:5]
        want += [(q, n + 1, i, min(max(-low, -(2**63)), 2**63 - 1)) for n, (low, i) in enumerate(found)]
    assert got == sorted(want)


def test_scores_of_the_axis_vectors(spark):
    df = table(spark, [(0, [1.0, 0.0]), (1, [1e6, 0.0]), (2, [6e5, 0.0])])
    assert sorted(tuple(r) for r in vectors.top_k(df, df.where("vec_id = 0")).collect()) == [(0, 1, 1, 65_536_000_000), (0, 2, 2, 39_321_600_000)]


def test_keys_compare_like_integers():
    values = sorted({s * (2**e + d) for e in (0, 1, 62, 63, 64, 70, 128, 700) for d in (-1, 0, 1) for s in (-1, 1)})
    assert sorted(values, key=vectors.sort_key) == values


def test_wide_vectors_take_smaller_shards(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_BYTES", 8 * 40 * 10)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.standard_normal(40)]) for i in range(60)]
    df = table(spark, rows)
    assert sorted(tuple(r) for r in vectors.top_k(df, df.where("vec_id % 50 = 0")).collect()) == brute_top(rows)


@pytest.mark.parametrize("size", [1e12, 1e200, 1e-200, 1e308, 1e-307])
def test_links_of_all_finite_sizes(spark, size):
    near = [(1, [size, size]), (2, [size, 1.0001 * size]), (3, [-size, size]), (4, [1.0, 1.0]), (5, [1.0, -1.0001])]
    out = vectors.near_duplicates(table(spark, near)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == [(1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 2, 1), (5, 0, 5)]
