"""SentencePiece BPE with seeded merge-dropout, and its decoding.

Text becomes a blank, then the text with blanks written as U+2581. Starting from single characters the
best-scored pair of neighbours that forms a vocabulary piece is merged, leftmost first among equals,
until none is left. With dropout a candidate is skipped for good when a keyed hash of (seed, occurrence,
left piece, right piece, place) falls below the rate; an occurrence is a word of a document, by the
document's id and the word's place there, so each draws on its own. Occurrences share the merging as long
as their draws agree, and part at the first that differs. Characters outside the vocabulary become byte
pieces, a literal U+2581 too, so decoding gives back every text.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.llm.arrow import flat_chars, gathered, lists, mixed, slices

BLANK = "▁"
#: Longer words take the heap instead of the matrix; the result is the same.
MATRIX_CHARS = 40
#: Occurrences that are merged at once.
MATRIX_ROWS = 1 << 16
SLICE_BYTES = 1 << 22


class Vocabulary:
    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        pieces = list(proto.pieces)
        normal = {p.piece: i for i, p in enumerate(pieces) if p.type == 1}
        self.size = len(pieces)
        self.scores = np.array([p.score for p in pieces], np.float64)
        self.bytes = np.zeros(256, np.int64)
        surface = []
        for i, p in enumerate(pieces):
            if p.type == 6:
                self.bytes[int(p.piece[1:-1], 16)] = i
                surface.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                surface.append(p.piece.replace(BLANK, " ").encode() if p.type == 1 else b"")
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_off = np.concatenate(([0], np.cumsum([len(s) for s in surface])))
        self.single = {p: i for p, i in normal.items() if len(p) == 1}
        pairs = {}
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = normal.get(p[:cut]), normal.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = i
        self.pairs = pairs
        keys = np.array(sorted(pairs), np.int64)
        self.keys, self.merged = np.append(keys, np.iinfo(np.int64).max), np.array([*(pairs[k] for k in keys.tolist()), -1], np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that two neighbours form, -1 for none. Negative symbols are characters outside the vocabulary."""
        key = np.where((left < 0) | (right < 0), -1, left * self.size + right)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], -1)


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _draw(seed: int, left, right, place) -> np.ndarray:
    """The part of a candidate's hash that all occurrences share."""
    u = lambda x: np.atleast_1d(x).astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        return u(left) * np.uint64(0xC2B2AE3D27D4EB4F) + u(right) * np.uint64(0x165667B19E3779F9) + u(place) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed & 0xFFFFFFFFFFFFFFFF)


def _skipped(rate: float, occurrence: np.ndarray, draw: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(occurrence * np.uint64(0x9E3779B97F4A7C15) + draw) <= np.uint64(min(int(rate * 2.0**64), 2**64 - 1))


def _merge_matrix(v: Vocabulary, sym: np.ndarray, node: np.ndarray, occurrence: np.ndarray, seed: int, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge occurrences of words of one length to the end: final symbols, padded, their numbers, and the row of each occurrence.

    ``sym`` has a row for each word and ``node`` the row of each occurrence. A row is a state of merging; a
    round merges or skips its best candidate, so it has up to two rows after it. Symbols from -2^31 up to
    below 0 are characters outside the vocabulary.
    """
    length = sym.shape[1]
    last = length - 1
    sym = sym.astype(np.int32)
    place = np.broadcast_to(np.arange(length, dtype=np.int16), sym.shape)
    size = np.full(len(sym), length)

    def candidates(left, right):
        piece = v.joined(left.astype(np.int64), right.astype(np.int64))
        return piece.astype(np.int32), np.where(piece >= 0, v.scores[piece], -np.inf)

    piece, rank = candidates(sym[:, :-1], sym[:, 1:])
    leaf, open_ = np.zeros(len(node), np.int64), np.arange(len(node))
    finals, sizes, leaves = [], [], 0
    while len(sym):
        own = np.arange(len(sym))
        best = rank.argmax(axis=1) if last else np.zeros(len(sym), np.int64)
        done = rank[own, best] == -np.inf if last else np.ones(len(sym), bool)
        if done.any():
            finals.append(sym[done]), sizes.append(size[done])
            name = leaves + np.cumsum(done) - 1
            leaves += len(sizes[-1])
            ends = done[node]
            leaf[open_[ends]] = name[node[ends]]
            open_, node, occurrence = open_[~ends], node[~ends], occurrence[~ends]
            if not len(node):
                break
        after = 2 * node
        if rate > 0:
            draw = _draw(seed, sym[own, best], sym[own, np.minimum(best + 1, last)], place[own, best])
            after += _skipped(rate, occurrence, draw[node])
        taken = np.zeros(2 * len(sym), bool)
        taken[after] = True
        node = (np.cumsum(taken) - 1)[after]
        rows = np.flatnonzero(taken)
        skip, rows = rows % 2 == 1, rows // 2
        best = best[rows]
        sym, place, piece, rank, size = sym[rows], place[rows], piece[rows], rank[rows], size[rows] - ~skip
        rank[skip, best[skip]] = -np.inf
        own = np.flatnonzero(~skip)
        if not len(own):
            continue
        at = best[own]
        joined = sym[own]
        joined[np.arange(len(own)), at] = piece[own, at]
        shift = np.minimum(np.arange(length) + (np.arange(length) > at[:, None]), last)
        sym[own], place[own] = np.take_along_axis(joined, shift, 1), np.take_along_axis(place[own], shift, 1)
        if last > 1:
            gap = np.minimum(np.arange(last) + (np.arange(last) >= at[:, None]), last - 1)
            piece[own], rank[own] = np.take_along_axis(piece[own], gap, 1), np.take_along_axis(rank[own], gap, 1)
        rank[own, last - 1] = -np.inf
        for ok, col in ((at > 0, at - 1), (at < size[own] - 1, at)):
            r, c = own[ok], col[ok]
            piece[r, c], rank[r, c] = candidates(sym[r, c], sym[r, c + 1])
    return np.concatenate(finals), np.concatenate(sizes), leaf


def merge_word(v: Vocabulary, sym: list[int], occurrence: np.uint64, seed: int, rate: float) -> list[int]:
    """One word by an agenda: a heap of candidates, best score first, then leftmost."""
    size = {i: s for i, s in enumerate(sym)}
    after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
    agenda: list = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(sym) and size[i] >= 0 and size[j] >= 0:
            piece = v.pairs.get(size[i] * v.size + size[j], -1)
            if piece >= 0:
                heapq.heappush(agenda, (-v.scores[piece], i, size[i], size[j], piece))

    for i in range(len(sym) - 1):
        offer(i)
    while agenda:
        _, i, a, b, piece = heapq.heappop(agenda)
        j = after[i] if i in size else len(sym)
        if j >= len(sym) or size[i] != a or size[j] != b:
            continue
        if rate > 0 and _skipped(rate, occurrence, _draw(seed, a, b, i))[0]:
            continue
        size[i] = piece
        del size[j]
        after[i] = after[j]
        if after[j] < len(sym):
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [size[i] for i in sorted(size)]


def _chars(v: Vocabulary, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the characters of words, ragged: a piece, or minus code point minus 1. A blank is the piece U+2581."""
    chars, off = flat_chars(words)
    kinds, back = np.unique(chars, return_inverse=True)
    known = [v.single.get(BLANK if c == 32 else chr(c), -1 - c) if c != ord(BLANK) else -1 - c for c in kinds.tolist()]
    return np.array(known, np.int64)[back] if len(chars) else np.zeros(0, np.int64), off


def merge_words(v: Vocabulary, words: pa.StringArray, pick: np.ndarray, occurrences: np.ndarray, seed: int, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the outcomes of ``words[pick]``, ragged, and the outcome of each of ``pick``. Without dropout a word has one."""
    sym, off = _chars(v, words)
    lens = np.diff(off)
    parts, owner, outcome, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(pick), np.int64), 1
    order = np.argsort(pick, kind="stable")
    order = order[np.argsort(np.minimum(lens, MATRIX_CHARS + 1).astype(np.int16)[pick[order]], kind="stable")]
    sizes_of = np.minimum(lens[pick[order]], MATRIX_CHARS + 1)
    for length in np.unique(sizes_of[sizes_of > 0]).tolist():
        same = order[np.searchsorted(sizes_of, length) : np.searchsorted(sizes_of, length, side="right")]
        if length > MATRIX_CHARS:
            before = -1
            for i in same.tolist():
                if rate > 0 or pick[i] != before:
                    before = pick[i]
                    ids = merge_word(v, sym[off[before] : off[before + 1]].tolist(), occurrences[i], seed, rate)
                    parts.append(np.array(ids, np.int64))
                    owner.append(np.full(len(ids), count))
                    count += 1
                outcome[i] = count - 1
            continue
        for at in range(0, len(same), MATRIX_ROWS):
            some = same[at : at + MATRIX_ROWS]
            new = np.concatenate(([True], pick[some][1:] != pick[some][:-1]))
            final, sizes, leaf = _merge_matrix(v, sym[off[pick[some][new]][:, None] + np.arange(length)], np.cumsum(new) - 1, occurrences[some], seed, rate)
            parts.append(final[np.arange(length) < sizes[:, None]].astype(np.int64))
            owner.append(np.repeat(count + np.arange(len(sizes)), sizes))
            outcome[some] = count + leaf
            count += len(sizes)
    flat, own = np.concatenate(parts), np.concatenate(owner)
    unknown = np.flatnonzero(flat < 0)
    if len(unknown):
        spelt = [v.bytes[np.frombuffer(chr(-1 - c).encode(), np.uint8)] for c in flat[unknown].tolist()]
        times = np.ones(len(flat), np.int64)
        times[unknown] = [len(s) for s in spelt]
        first = np.cumsum(times) - times
        flat, own = np.repeat(flat, times), np.repeat(own, times)
        flat[np.concatenate([first[i] + np.arange(len(s)) for i, s in zip(unknown.tolist(), spelt)])] = np.concatenate(spelt)
    return flat.astype(np.int32), np.searchsorted(own, np.arange(count + 1)), outcome


def _encode_words(v: Vocabulary, words: pa.StringArray, counts: np.ndarray, names: np.ndarray, seed: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of rows given as words with their leading blanks, ``counts`` words each."""
    coded = words.dictionary_encode()
    ends = np.cumsum(counts)
    occurrence = np.zeros(len(words), np.uint64)
    if rate > 0:
        ordinal = np.arange(len(words)) - np.repeat(ends - counts, counts)
        occurrence = mixed(np.repeat(names, counts) + ordinal.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    flat, off, outcome = merge_words(v, coded.dictionary, coded.indices.to_numpy().astype(np.int64), occurrence, seed, rate)
    ids, at = gathered(flat, off, outcome)
    return ids, at[np.concatenate(([0], ends))]


def encode_rows(v: Vocabulary, ids: pa.Array, text: pa.StringArray, seed: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, and n + 1 offsets. Words are cut before a blank that follows another character."""
    text = pc.fill_null(text, "")
    names = mixed(pc.fill_null(ids.cast(pa.int64()), 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(seed & 0xFFFFFFFF))
    plain = pc.invert(pc.match_substring_regex(text, "^$|^ |  | $")).to_numpy(zero_copy_only=False)
    flats, sizes, order = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], []
    at = np.flatnonzero(plain)
    if len(at):
        split = pc.split_pattern(text.take(pa.array(at)), " ")
        flat, off = _encode_words(v, pc.binary_join_element_wise(pa.scalar(""), split.flatten(), " "), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64), names[at], seed, rate)
        flats.append(flat), sizes.append(np.diff(off)), order.append(at)
    at = np.flatnonzero(~plain)
    if len(at):
        rows = [re.findall(" +[^ ]*", " " + t) if t else [] for t in text.take(pa.array(at)).to_pylist()]
        flat, off = _encode_words(v, pa.array([w for r in rows for w in r], pa.string()), np.array([len(r) for r in rows], np.int64), names[at], seed, rate)
        flats.append(flat), sizes.append(np.diff(off)), order.append(at)
    off = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
    return gathered(np.concatenate(flats), off, np.argsort(np.concatenate(order))) if order else (flats[0], off)


def decode_rows(v: Vocabulary, flat: np.ndarray, off: np.ndarray) -> pa.StringArray:
    """Texts of rows of ids; the blank put first in encoding goes."""
    raw, at = gathered(v.surface, v.surface_off, flat)
    ends = at[off]
    keep = np.ones(len(raw), bool)
    heads = ends[:-1][ends[:-1] < ends[1:]]
    keep[heads[raw[heads] == 32]] = False
    return pa.Array.from_buffers(pa.string(), len(off) - 1, [None, pa.py_buffer(np.concatenate(([0], np.cumsum(keep)))[ends].astype(np.int32)), pa.py_buffer(raw[keep].tobytes())])


def _encode_map(path: str, seed: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            at = 0
            for ids, text in slices([batch], SLICE_BYTES):
                flat, off = encode_rows(v, ids, text, seed, rate)
                rest = batch.slice(at, len(ids)).columns[2:]
                yield pa.RecordBatch.from_arrays([ids, lists(flat, off), *rest], names=["id", "ids", *batch.schema.names[2:]])
                at += len(ids)

    return run


def _decode_map(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                ids = pc.fill_null(part.column(1), pa.scalar([], part.column(1).type))
                off = np.concatenate(([0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))))
                text = decode_rows(v, ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), off)
                yield pa.RecordBatch.from_arrays([part.column(0), text, *part.columns[2:]], names=["id", "decoded", *batch.schema.names[2:]])

    return run


def _kept(df: DataFrame, keep: tuple[str, ...]) -> str:
    return "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", *, rate: float = 0.1, seed: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``id_col``, ids (array<int>) and the columns in ``keep``.

    ``rate`` 0 gives the segmentation of the model itself. A null or empty text has no ids. Equal seeds, ids
    and texts give equal results on any cluster; repeated rows come out alike. Columns outside ``keep`` are
    ignored.
    """
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("_text"), *keep)
    return src.mapInArrow(_encode_map(model, seed, rate), f"id bigint, ids array<int>{_kept(src, keep)}").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids", *, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row: ``id_col``, decoded and the columns in ``keep``; null ids give an empty text."""
    src = tokens.select(F.col(id_col).cast("bigint").alias("id"), F.col(ids_col).cast("array<int>").alias("_ids"), *keep)
    return src.mapInArrow(_decode_map(model), f"id bigint, decoded string{_kept(src, keep)}").withColumnRenamed("id", id_col)
