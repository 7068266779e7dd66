"""Packing and SentencePiece encoding against the libraries and round trips."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF
from tabwarden.llm import packing, pieces

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "   ", "  a  b ", "日本語 テスト 😀\x00", "x" * 500, "\n\n a\tb", "It's DON'T <|endoftext|> 12ab34 ,.!", "ΣΑΣ É é x\x1cy\x85z", "a\u0301 e\u0301x", "ǅ İ ẞ ﬁ", "don't|won't", "§·¿a", "<|startoftext|>x"]


@pytest.fixture(scope="module")
def given_texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def word_ids(texts):
    return [e.ids for e in tokenizers.Tokenizer.from_file(WORDS).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_word_ids_are_the_librarys(given_texts):
    texts = ODD + given_texts
    flat, off = packing.WordTokens(WORDS, known_bytes=10_000).encode(pa.array(texts, pa.string()))
    assert [flat[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == word_ids(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=5))
def test_word_ids_of_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    flat, off = TOKENS.encode(pa.array(texts, pa.string()))
    assert [flat[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == word_ids(texts)


TOKENS = packing.WordTokens(WORDS)


class Counted:
    """A merge model that counts the words it is given."""

    def __init__(self, model):
        self.model, self.calls = model, 0

    def tokenize(self, word):
        self.calls += 1
        return self.model.tokenize(word)


def test_a_large_vocabulary_is_looked_up_once():
    words = packing.WordTokens(WORDS)
    words.model = Counted(words.model)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    names = ["".join(letters[[i % 26, i // 26 % 26, i // 676 % 26, i // 17576]]) for i in range(150_000)]
    texts = pa.array([" ".join(names[i : i + 5000]).title() + "." for i in range(0, len(names), 5000)])
    first = [words.encode(texts.slice(i, 5)) for i in range(0, len(texts), 5)]
    calls, words.model.calls = words.model.calls, 0
    again = [words.encode(texts.slice(i, 5)) for i in range(0, len(texts), 5)]
    assert words.model.calls == 0 and calls == len(names) + 1 and words.held() <= packing.KNOWN_BYTES
    assert all((a == b).all() for one, two in zip(first, again) for a, b in zip(one, two))


def test_forgotten_words_come_back(given_texts):
    words = packing.WordTokens(WORDS, known_bytes=10_000)
    texts = ODD + given_texts[:40]
    for _ in range(2):
        got = [words.encode(pa.array([t], pa.large_string())) for t in texts]
        assert [flat.tolist() for flat, _ in got] == word_ids(texts)


def check_pieces(found, sizes, window=4096):
    """Each token lies in one piece; sequences have no gap and fit. Returns the padding."""
    docs, seqs = {}, {}
    for d, start, n, s, at in found:
        assert n > 0
        docs.setdefault(d, []).append((start, n))
        seqs.setdefault(s, []).append((at, n))
    for d, size in enumerate(sizes):
        end = 0
        for start, n in sorted(docs.get(d, [])):
            assert start == end
            end += n
        assert end == size
    padding = 0
    for parts in seqs.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= window
        padding += 0 if end & (end - 1) == 0 else window - end
    return padding


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 9000), max_size=60))
def test_packing_of_any_sizes(sizes):
    padding = check_pieces(packing.pack(sizes), sizes)
    assert padding <= 64 * (sum(sizes) // 4096 + 1)


def test_first_window_is_the_tightest():
    rooms = packing.Rooms(16)
    for room, name in ((9, 0), (4, 1), (7, 2), (4, 3)):
        rooms.put(room, name)
    assert [rooms.tightest(n) for n in (5, 4, 1, 8, 1)] == [(7, 2), (4, 3), (4, 1), (9, 0), None]


def test_packed_documents(spark, given_texts):
    texts = ODD + given_texts
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id bigint, text string, length int").repartition(3)
    rows = packing.pack_documents(df, WORDS, pack_tokens=20_000).collect()
    ids = [np.array([*x, 2], "<u4") for x in word_ids(texts)]
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id]) for r in rows)
    padding = check_pieces([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in rows], [len(x) for x in ids])
    assert padding < 0.02 * sum(map(len, ids))
    assert packing.pack_documents(df.limit(0), WORDS).count() == 0
    again = packing.pack_documents(spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id bigint, text string"), WORDS)
    assert again.count() == 3


LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
PIECE_IDS = {LIBRARY.id_to_piece(i): i for i in range(LIBRARY.get_piece_size())}


def encoded(texts, rate, seed=1):
    v = pieces.vocabulary(PIECES)
    flat, off = pieces.encode_rows(v, pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), seed, rate)
    return v, flat, off


def test_without_dropout_as_the_library(given_texts):
    texts = ODD + given_texts
    _, flat, off = encoded(texts, 0.0)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert [flat[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [sp.encode(t or "") for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=4), st.sampled_from([0.0, 0.1, 0.5, 1.0]))
def test_every_text_comes_back(texts, rate):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ["a▁b ▁▁ c▁"]
    v, flat, off = encoded(texts, rate)
    assert pieces.decode_rows(v, flat.astype(np.int64), off).to_pylist() == texts
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert [sp.decode(flat[a:b].tolist()) for a, b in zip(off[:-1], off[1:])] == texts


def test_matrix_and_agenda_agree(given_texts, monkeypatch):
    texts = ODD + given_texts[:20]
    _, flat, off = encoded(texts, 0.3)
    monkeypatch.setattr(pieces, "MATRIX_CHARS", 0)
    _, flat2, off2 = encoded(texts, 0.3)
    assert flat.tolist() == flat2.tolist() and off.tolist() == off2.tolist()


def test_dropout_varies_with_seed_place_and_document(given_texts):
    text = "thanedble " * 200
    _, flat, off = encoded([text, text], 0.2)
    one, two = flat[: off[1]].tolist(), flat[off[1] :].tolist()
    assert one != two
    assert encoded([text, text], 0.2)[1].tolist() == flat.tolist()
    assert encoded([text, text], 0.2, seed=2)[1].tolist() != flat.tolist()
    assert len(encoded([text], 0.0)[1]) < len(encoded([text], 0.2)[1]) < len(encoded([text], 1.0)[1])
    assert len(encoded([text], 1.0)[1]) == len(text) + 1


def test_each_occurrence_draws_its_own_dropout():
    word, rate, n = "thanedble", 0.1, 20_000
    v, flat, off = encoded([" ".join([word] * 200)] * (n // 200), rate)
    cut = np.flatnonzero(np.isin(flat, [i for p, i in PIECE_IDS.items() if p.startswith(pieces.BLANK)]))
    seen = {tuple(x.tolist()) for x in np.split(flat, cut[1:])}
    assert len(cut) == n and len(seen) > 16

    # every (pair, place) is skipped at about the rate, none never and none in whole sixteenths
    occurrence = pieces.mixed(np.arange(n, dtype=np.uint64))
    pairs = np.random.default_rng(1).integers(0, v.size, (300, 2))
    shares = [pieces._skipped(rate, occurrence, pieces._draw(1, a, b, place)).mean() for place, (a, b) in enumerate(pairs.tolist())]
    assert 0.085 < min(shares) and max(shares) < 0.115


def test_first_merge_is_skipped_at_the_rate():
    """A word of two characters that form a piece comes apart in about ``rate`` of its occurrences."""
    v = pieces.vocabulary(PIECES)
    letters = [p[1] for p in PIECE_IDS if len(p) == 2 and p[0] == pieces.BLANK and p[1].isascii() and p[1].isalpha()]
    assert len(letters) >= 5
    for c in letters:
        _, flat, _ = encoded([" ".join([c] * 500)] * 20, 0.1)
        apart = np.count_nonzero(flat == v.single[pieces.BLANK]) / 10_000
        assert 0.085 < apart < 0.115, (c, apart)


def test_encode_and_decode_frames(spark, given_texts):
    texts = ODD + given_texts[:50]
    df = spark.createDataFrame([(i, t, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, source string, ids int")
    coded = pieces.encode(df.drop("ids"), PIECES, keep=("source",))
    back = pieces.decode(coded, PIECES, keep=("source",)).collect()
    assert len(back) == len(texts) and all(r.decoded == (r.source or "") for r in back)
    assert pieces.encode(df.limit(0).drop("ids"), PIECES).count() == 0
    again = pieces.encode(spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id bigint, text string"), PIECES).collect()
    assert again[1].ids == again[2].ids
    assert [r.decoded for r in pieces.decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>"), PIECES).collect()] == [""]
