"""Near-duplicate documents against brute force."""

import itertools
import random
import re

import pytest

from conftest import SF
from tabwarden.llm import near_text
from tabwarden.llm.components import connected_components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """(id -> set of sizes, id -> component) for rows (id, text)."""
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            lo, hi = sorted((root(i), root(j)))
            parent[hi] = lo
    return [(i, len(s), root(i), i == root(i)) for i, s in sets]


def got(df):
    return sorted((r[0], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


def planted(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "a b c d"), (7, "a b c"), (8, "a b c d e"), (9, "é É"), (10, "é é")]
    base = [word() for _ in range(60)]
    n = 100
    for _ in range(40):  # a large group around one text, some at the edge of the threshold
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        rows.append((n, " ".join(w)))
        n += 1
    for _ in range(15):  # exact copies, written differently
        rows.append((n, "\n".join(x.upper() for x in base)))
        n += 1
    for _ in range(30):  # a passage that strangers share
        rows.append((n, " ".join(base[:20] + [word() for _ in range(rng.choice((5, 8, 30)))])))
        n += 1
    rows.append((n, "x" * 200_000))
    rows.append((n + 1, " ".join(word() for _ in range(30_000))))
    return rows


@pytest.mark.parametrize("options", [{}, {"rounds": 0}, {"broadcast_ids": 0}])
def test_planted_groups(spark, monkeypatch, options):
    monkeypatch.setattr(near_text, "TILE", 8)
    rows = planted()
    df = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id bigint, text string, node int, key string, component int").repartition(5)
    assert got(near_text.near_duplicates(df, **options)) == sorted(brute(rows))


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(near_text.near_duplicates(docs)) == sorted(brute(rows))


def test_no_rows_null_ids_and_repeated_rows(spark):
    schema = "doc_id bigint, text string"
    assert got(near_text.near_duplicates(spark.createDataFrame([], schema))) == []
    text = "a b c d e f g"
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (3, text), (None, None)], schema)
    out = near_text.near_duplicates(df).collect()
    by = {r.doc_id: (r.component_id, r.kept) for r in out}
    assert by == {None: (None, True), 5: (3, False), 3: (3, True)}
    kept = near_text.drop_near_duplicates(spark.createDataFrame([(5, text), (5, text), (None, text), (9, "other words in this one here")], schema))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, text), (5, text), (9, "other words in this one here")]


def test_drop_keeps_columns_and_agrees_on_both_joins(spark):
    df = spark.createDataFrame([(i, t, i) for i, t in planted(2)], "doc_id bigint, text string, kept int")
    kept = {r[0] for r in brute([(r.doc_id, r.text) for r in df.collect()]) if r[3]}
    for limit in (0, 500_000):
        out = near_text.drop_near_duplicates(df, broadcast_ids=limit)
        assert out.columns == df.columns
        assert {r.doc_id for r in out.collect()} == kept


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7), (None, 4)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    assert out == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_rows(rows):
    """As ``brute`` with every row a document of its own: (id, size, smallest id reachable, kept) of each."""
    named = [(k, t) for k, (_, t) in enumerate(rows)]
    group = {}
    for k, _, root, _ in brute(named):
        group.setdefault(root, []).append(rows[k][0])
    return sorted((rows[k][0], n, min(group[root]), rows[k][0] == min(group[root])) for k, n, root, _ in brute(named))


def test_rows_of_one_id_with_several_texts(spark):
    """They are documents of their own: none is lost, and they join no groups."""
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    one, two, three, four = (text() for _ in range(4))
    near = lambda t: t + " tail"
    rows = [(5, one), (5, two), (5, near(one)), (3, near(two)), (9, three), (9, three), (9, four), (2, None), (2, ""), (7, near(one) + " more"), (8, four)]
    df = spark.createDataFrame([(i, t, k, "m") for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, place int, marked_id string").repartition(3)
    assert got(near_text.near_duplicates(df)) == brute_rows(rows)
    kept = near_text.drop_near_duplicates(df)
    assert kept.columns == df.columns
    out = sorted((r.doc_id, r.text or "") for r in kept.collect())
    assert len(out) == 5 and {i for i, _ in out} == {2, 3, 5, 8, 9}
    assert (9, three) in out and (8, four) in out and (3, near(two)) in out and dict(out)[5] in (one, near(one))
    assert sorted(tuple(r) for r in kept.collect()) == sorted(tuple(r) for r in near_text.drop_near_duplicates(df).collect())


def test_a_leader_of_many_pairs_is_spread(spark, monkeypatch):
    monkeypatch.setattr(near_text, "LEADER_ROWS", 3)
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert got(near_text.near_duplicates(df)) == brute(rows)
