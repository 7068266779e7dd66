"""Helpers for ``mapInArrow``: text columns as flat numpy arrays, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def flat_bytes(text: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in one array, and the n + 1 offsets of the rows. Null counts as empty."""
    if text.null_count:
        text = pc.fill_null(text, "")
    _, offsets, data = text.buffers()
    width = np.int64 if pa.types.is_large_string(text.type) else np.int32
    off = np.frombuffer(offsets, width)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def flat_chars(text: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """As ``flat_bytes`` for code points (uint32)."""
    raw, off = flat_bytes(text)
    chars = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return chars, heads[off]


def slices(batches: Iterable[pa.RecordBatch], max_bytes: int) -> Iterator[tuple[pa.Array, pa.StringArray]]:
    """(ids, texts) of at most ``max_bytes`` of text each, or of one row that is longer. Column 0 is the id, column 1 the text."""
    for batch in batches:
        ids, text = batch.column(0), batch.column(1)
        if not len(batch):
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield ids.slice(at, to - at), text.slice(at, to - at)
            at = to


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, giving memory that Arrow keeps for later back at a task's end: workers serve task after task."""

    def to_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return to_the_end


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def rows_as_lists(matrix: np.ndarray) -> pa.ListArray:
    n, width = matrix.shape
    return lists(np.ascontiguousarray(matrix).reshape(-1), np.arange(n + 1) * width)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers from a seed."""
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def gathered(flat: np.ndarray, offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries ``picks`` of a ragged array (flat, offsets), one after another, and n + 1 offsets."""
    lens = (offsets[1:] - offsets[:-1])[picks]
    off = np.concatenate(([0], np.cumsum(lens)))
    return flat[np.repeat(offsets[:-1][picks] - off[:-1], lens) + np.arange(off[-1])], off


def with_text_columns(df: DataFrame, text_col: str, keep: Sequence[str], added: str, per_slice: Callable[[], Callable[[pa.StringArray], list[pa.Array]]], max_bytes: int) -> DataFrame:
    """The columns ``keep`` of ``df`` and those of the schema ``added``, computed from the text.

    ``per_slice`` is called once in each task and returns the function from a slice of texts to its columns.
    A column of ``keep`` with the name of an added one gives way to it.
    """
    new = StructType.fromDDL(added)
    taken = {n.lower() for n in new.names}
    kept = [c for c in keep if c.lower() not in taken]
    src = df.select(F.lit(0).alias("none"), df[text_col].cast("string").alias("text"), *(df[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(kept)))
    fields = [StructField(c, f.dataType, f.nullable) for c, f in zip(kept, src.schema.fields[2:])]
    names = [*kept, *new.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = per_slice()
        for batch in batches:
            at = 0
            for _, text in slices([batch], max_bytes):
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(text)).columns[2:], *fn(text)], names=names)
                at += len(text)

    return src.mapInArrow(released(run), StructType([*fields, *new.fields]))


def runs(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Rows with equal ``keys``, of batches that come sorted by them."""
    held, last = [], None
    for batch in batches:
        if not len(batch):
            continue
        key = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in keys])
        cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        for at, to in zip([0, *cut.tolist()], [*cut.tolist(), len(batch)]):
            if last is not None and (key[at] != last).any():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, to - at))
            last = key[at]
    if held:
        yield pa.Table.from_batches(held)
