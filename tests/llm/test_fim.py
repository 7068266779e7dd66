"""Fill-in-middle against slices of tokens, and exact round trips."""

import hashlib
import re

from hypothesis import given
from hypothesis import strategies as st

from conftest import SF
from tabwarden.llm import fim

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plain(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [(None, "null id"), (1, None), (2, ""), (3, "<P>"), (4, "a<M>b"), (5, "<S"), (6, "P>"), (7, "é日本\U0001f600 x"), (8, "word"), (9, "\n\r\x00  "), (10, "ab " * 200_000), (11, "same"), (11, "same"), (-3, "negative id"), (2**62, "<p> lower case")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1.0, "y") for i, t in rows], "doc_id bigint, text string, form string, n double, output string").repartition(3)


def test_odd_texts_match_slices_and_come_back(spark):
    rows = ODD + [(100 + k, f"some words, number {k}; and more") for k in range(200)]
    made = fim.transform(frame(spark, rows))
    key = lambda r: repr(r)
    assert sorted((tuple(r) for r in made.collect()), key=key) == sorted((plain(*r) for r in rows), key=key)
    assert {r.form for r in made.collect()} == {"plain", "psm", "spm"}
    back = fim.restore(made).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    assert fim.transform(frame(spark, [])).count() == 0 and fim.restore(made.limit(0)).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = sorted(tuple(r) for r in fim.transform(docs).collect())
    assert made == sorted(plain(r.doc_id, r.text) for r in docs.collect())


def test_restore_of_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, None, "old"), (2, "psm", "<P>a<S>c<M>b", "old"), (3, None, "x<P>", "old")], "k int, form string, output string, text string")
    out = fim.restore(df)
    assert out.columns == ["text", "k", "form"] and sorted((r.k, r.text) for r in out.collect()) == [(1, None), (2, "abc"), (3, "x<P>")]


@given(st.binary(max_size=60), st.data())
def test_rotation_exchanges_two_blocks(data, draw):
    a, b, c = sorted(draw.draw(st.integers(0, len(data))) for _ in range(3))
    buf = bytearray(data)
    fim.rotate(buf, a, b, c)
    assert bytes(buf) == data[:a] + data[b:c] + data[a:b] + data[c:]
    fim.rotate(buf, a, a + c - b, c)
    assert bytes(buf) == data


@given(st.text(max_size=40).filter(lambda t: not any(m in t for m in ("<P>", "<S>", "<M>"))), st.data(), st.sampled_from(["psm", "spm"]))
def test_every_cut_comes_back(text, draw, form):
    body = text.encode("utf-8", "ignore")
    low, high = sorted(draw.draw(st.integers(0, len(body))) for _ in range(2))
    assert fim.restored(fim.transformed(body, low, high, form), form) == body
