"""Filter audit against filters applied one after another."""

import itertools

import numpy as np
import re

from conftest import SF
from tabwarden.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, labels):
    """Every order of the filters, applied to the rows left by the one before."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    parts = {}
    for i, text, part in rows:
        text = text or ""
        w = WORD.findall(text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text), "E": i is not None and least[text] < i}
        parts.setdefault(part or "", []).append((fails, i in good, i in toxic))
    out = []
    for part, docs in parts.items():
        removed_of = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for s, f in enumerate(order):
                lost, stay = [d for d in left if d[0][f]], [d for d in left if not d[0][f]]
                failing = sum(d[0][f] for d in docs)
                removed_of[f] += len(lost)
                steps.append((part, "".join(order), s + 1, len(stay), len(lost), failing - len(lost), sum(d[0][f] and sum(d[0].values()) == 1 for d in docs), sum(d[1] for d in lost), sum(d[2] for d in lost), f))
                left = stay
        out += [(*s[:-1], removed_of[s[-1]]) for s in steps]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, p, 5, 6, True) for i, t, p in rows], "doc_id bigint, text string, source string, id int, part int, good boolean").repartition(3)


def label_frame(spark, labels):
    return spark.createDataFrame([(i, q, t, 0) for i, q, t in labels], "doc_id bigint, quality int, toxic int, docs int")


def test_orders_match_filters_in_sequence(spark):
    long = " ".join(f"w{k}" for k in range(220))
    texts = [long, "x " * 300, "ABC " + long, long + " #", "AB CD | x", long, "", None, "É" * 10, "a b " * 120, "x" * 100_000]
    rows = [(k, texts[k * k % len(texts)], [None, "", "hot", "hot", "cold"][k % 5]) for k in range(60)]
    rows += [(None, long, "hot"), (None, long, "hot"), (7, texts[49 % len(texts)], "other"), (-5, long, "cold"), (-5, long, "cold"), (-5, long, "hot")]
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 60, 4)] + [(4, 0, 0), (4, 1, 1), (None, 1, 1), (8, None, None)]
    out = audit.audit(frame(spark, rows), label_frame(spark, [(i, q, None if t is None else int(t)) for i, q, t in labels])).collect()
    assert sorted(tuple(r) for r in out) == plain(rows, labels)


def test_given_documents_and_no_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    want = plain([(r.doc_id, r.text, r.source) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert sorted(tuple(r) for r in audit.audit(docs, labels).collect()) == want
    assert audit.audit(docs.limit(0), labels).count() == 0
    assert {r.good_lost for r in audit.audit(docs, labels.limit(0)).collect()} == {0}


def test_contraction_is_the_sum_over_the_chosen_places():
    t = np.random.default_rng(1).integers(0, 9, (4, 2, 2, 2, 2, 2))
    full = audit.contracted(t)
    for choice in itertools.product(range(3), repeat=5):
        pick = tuple(slice(None) if c == 2 else slice(c, c + 1) for c in choice)
        assert (full[(slice(None), *choice)] == t[(slice(None), *pick)].sum(axis=(1, 2, 3, 4, 5))).all()


def test_one_text_in_half_of_the_rows_spreads_over_tasks(spark):
    rows = spark.range(4_000).selectExpr("id AS doc_id", "if(id % 2 = 0, 'the same text', concat('text ', id)) AS text", "'hot' AS source").repartition(8)
    cells = audit.tensors(rows, label_frame(spark, [])).collect()
    assert {(r.part, r.cell >> 4, r.docs) for r in cells} == {("hot", 0, 2_001), ("hot", 1, 1_999)}
