"""Packing of token sequences by best-fit decreasing.

Documents are tokenized, cut into full windows and a rest; the rests of a pack, longest first, go to the
open window with the least room that still holds them. A segment tree over the room finds that window.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.llm.arrow import gathered, released, slices

WINDOW = 4096
#: A pack, within which rests share windows, ends with the document that reaches this many tokens.
PACK_TOKENS = 6_000_000
#: Room below this is left as padding; larger room is filled with a cut of another rest.
LEAST_CUT = 64
SLICE_BYTES = 1 << 20
#: Looked-up words are forgotten when they fill about so much memory.
KNOWN_BYTES = 24 << 20
_ENTRY_BYTES = 48
_SIMPLE = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<marks>[!-/:-@\[-`{-~]*)$"


class WordTokens:
    """Ids of a word-level BPE file for whole columns.

    No token of such a file spans blanks, so each distinct stretch of text between ASCII blanks is looked
    up once. Stretches of plain letters with marks behind them go to the library's merge model; all
    others through its whole chain.
    """

    def __init__(self, path: str, known_bytes: int = KNOWN_BYTES) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.known, self.flat, self.off = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.known_bytes = known_bytes
        spell = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelt = {c: spell.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7}

    def held(self) -> int:
        """Bytes of the known words, with those of the hash table that a look-up makes of them."""
        return 2 * self.known.nbytes + self.flat.nbytes + self.off.nbytes + _ENTRY_BYTES * len(self.known)

    def _learn(self, words: pa.StringArray) -> None:
        """Add words that are not known yet."""
        ids, tokenize, ends = array("I"), self.model.tokenize, []
        for word in words.to_numpy(zero_copy_only=False).tolist():
            if word:
                ids.extend([t.id for t in tokenize(word if word.isascii() else word.translate(self.spelt))])
            ends.append(len(ids))
        self.known = pa.concat_arrays([self.known, words])
        self.off = np.concatenate((self.off, len(self.flat) + np.array(ends, np.int64)))
        self.flat = np.concatenate((self.flat, np.frombuffer(ids, np.uint32)))

    def _picks(self, words: pa.StringArray) -> np.ndarray:
        """Where the distinct ``words`` lie among the known ones, which they join."""
        at = pc.index_in(words, value_set=self.known)
        if at.null_count:
            n = len(self.known)
            self._learn(words.filter(at.is_null()))
            new, at = at.is_null().to_numpy(zero_copy_only=False), pc.fill_null(at, 0).to_numpy().copy()
            at[new] = np.arange(n, len(self.known))
            if self.held() > self.known_bytes:  # all but these are forgotten
                self.flat, self.off = gathered(self.flat, self.off, at)
                self.known, at = words, np.arange(len(words))
            return at
        return at.to_numpy()

    def distinct(self, stretches: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each stretch as a ragged array."""
        stretches = stretches.cast(pa.string())
        parts = pc.extract_regex(stretches, _SIMPLE)
        simple = pc.and_(parts.is_valid(), pc.invert(pc.match_substring(stretches, "<|")))
        halves = pa.concat_arrays([pc.if_else(simple, pc.utf8_lower(parts.field("word")), ""), pc.if_else(simple, parts.field("marks"), "")]).dictionary_encode()
        picks = self._picks(halves.dictionary)[halves.indices.to_numpy()].reshape(2, -1)
        flat, off, odd = self.flat, self.off, np.flatnonzero(~simple.to_numpy(zero_copy_only=False))
        if len(odd):  # theirs lie behind those of the known words
            ids = [e.ids for e in self.whole.encode_batch_fast(stretches.take(pa.array(odd)).to_pylist(), add_special_tokens=False)]
            picks[0, odd] = len(off) - 1 + np.arange(len(odd))
            off = np.concatenate((off, len(flat) + np.cumsum([len(x) for x in ids])))
            flat = np.concatenate((flat, *(np.array(x, np.uint32) for x in ids)))
        ids, at = gathered(flat, off, picks.T.reshape(-1))
        return ids, at[::2]

    def encode(self, text: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows (uint32), and n + 1 offsets."""
        split = pc.ascii_split_whitespace(pc.fill_null(text, ""))
        words = split.flatten().dictionary_encode()
        flat, off = self.distinct(words.dictionary)
        ids, at = gathered(flat, off, words.indices.to_numpy())
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))))
        return ids, at[ends]


@functools.cache
def word_tokens(path: str) -> WordTokens:
    """One for each worker process, whatever the number of its tasks."""
    return WordTokens(path)


class Rooms:
    """Open windows by the room they have left: a segment tree counts them, a stack per room names them."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.names: dict[int, list[int]] = {}

    def _add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.tree[i] += by
            i >>= 1

    def put(self, room: int, name: int) -> None:
        self.names.setdefault(room, []).append(name)
        self._add(room, 1)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the window with the least room of at least ``size``: (room, name)."""
        i, tree = size + self.leaves, self.tree
        while not tree[i]:
            while i & 1:  # a right child: go up
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i <<= 1
            if not tree[i]:
                i += 1
        room = i - self.leaves
        self._add(room, -1)
        return room, self.names[room].pop()


def pack(sizes: list[int], window: int = WINDOW, least_cut: int = LEAST_CUT) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with the given numbers of tokens.

    All pieces but the last cuts come from best-fit decreasing. Then windows with at least ``least_cut``
    tokens of room are filled from the emptiest one, and the last of these becomes sequences whose
    lengths are powers of two, which need no padding.
    """
    pieces, rests, sequence = [], [], 0
    for d, n in enumerate(sizes):
        for start in range(0, n - window + 1, window):
            pieces.append((d, start, window, sequence, 0))
            sequence += 1
        if n % window:
            rests.append((n % window, d))
    rests.sort(key=lambda r: (-r[0], r[1]))
    windows: list[list[tuple[int, int, int]]] = []
    room: list[int] = []
    rooms = Rooms(window)
    for size, d in rests:
        found = rooms.tightest(size)
        if found is None:
            left, w = window, len(windows)
            windows.append([])
            room.append(window)
        else:
            left, w = found
        windows[w].append((d, sizes[d] - size, size))
        room[w] = left - size
        if room[w]:
            rooms.put(room[w], w)
    loose = sorted((w for w in range(len(windows)) if room[w] >= least_cut), key=lambda w: room[w])
    last: list[tuple[int, int, int]] = []
    while loose:
        giver = loose.pop()
        while loose and windows[giver]:
            w = loose[0]
            d, start, size = windows[giver].pop()
            part = min(size, room[w])
            windows[w].append((d, start + size - part, part))
            room[w] -= part
            if size > part:
                windows[giver].append((d, start, size - part))
            if not room[w]:
                loose.pop(0)
        if windows[giver]:
            last, windows[giver] = windows[giver], []
    for held in windows:
        at = 0
        for d, start, size in held:
            pieces.append((d, start, size, sequence, at))
            at += size
        sequence += bool(held)
    total = sum(size for _, _, size in last)
    for bit in reversed(range(total.bit_length())):
        length, at = total & 1 << bit, 0
        while at < length:
            d, start, size = last.pop()
            part = min(size, length - at)
            pieces.append((d, start, part, sequence, at))
            at += part
            if size > part:
                last.append((d, start + part, size - part))
        sequence += bool(length)
    return pieces


class _Held:
    """Tokens of the documents of a pack: one flat array per slice, and where each document lies."""

    def __init__(self) -> None:
        self.names, self.sizes, self.starts, self.slices, self.flats, self.tokens = [], [], [], [], [], 0

    def add(self, names: list, flat: np.ndarray, off: np.ndarray) -> None:
        self.names += names
        self.starts += off[:-1].tolist()
        self.sizes += np.diff(off).tolist()
        self.slices += [len(self.flats)] * len(names)
        self.flats.append(flat)
        self.tokens += int(off[-1] - off[0])

    def crc32(self, d: int, start: int, length: int) -> int:
        at = self.starts[d] + start
        return zlib.crc32(self.flats[self.slices[d]][at : at + length].data)


def _pack_map(path: str, end_id: int, window: int, pack_tokens: int):
    schema = pa.schema([("id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])

    def packed(part: int, group: int, held: _Held) -> pa.RecordBatch:
        d, start, length, sequence, offset = zip(*pack(held.sizes, window))
        crc = [held.crc32(*piece) for piece in zip(d, start, length)]
        first = (part << 40) + (group << 24)
        cols = [held.names[k] for k in d], start, length, crc, [held.sizes[k] for k in d], [first + s for s in sequence], offset
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, group, held = word_tokens(path), TaskContext.get().partitionId(), 0, _Held()
        for ids, text in slices(batches, SLICE_BYTES):
            flat, off = words.encode(text)
            flat = np.insert(flat, off[1:], np.uint32(end_id)).astype("<u4", copy=False)
            off = off + np.arange(len(off))
            names, at = ids.to_pylist(), 0
            while at < len(names):
                # the document that reaches the limit is the pack's last
                to = min(len(names), max(at + 1, int(np.searchsorted(off, off[at] + pack_tokens - held.tokens))))
                held.add(names[at:to], flat, off[at : to + 1])
                at = to
                if held.tokens >= pack_tokens:
                    yield packed(part, group, held)
                    held, group = _Held(), group + 1
        if held.names:
            yield packed(part, group, held)

    return released(run)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 2, window: int = WINDOW, pack_tokens: int = PACK_TOKENS) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Rows share windows with rows of their own task, in packs of about ``pack_tokens`` tokens, so nothing is
    shuffled and a task's memory is bounded however large its input. A null text counts as empty: its one
    token is ``end_id``. Repeated rows are packed once each. Sequence ids are unique, not consecutive.
    """
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = src.mapInArrow(_pack_map(tokenizer, end_id, window, pack_tokens), "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("id", id_col)
