"""Fill-in-middle by rotating blocks in place.

A text is cut at two token borders. Its bytes go into a bytearray in reading order, each segment behind its
sentinel, and one rotation of two neighbouring blocks, made of three reversals, gives the form: prefix,
suffix, middle (psm) or suffix, prefix, middle (spm). The rotation the other way and the removal of the
sentinels give back the text exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tabwarden.llm.arrow import flat_bytes, slices
from tabwarden.llm.words import HEAD

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Percent of the texts that are cut, and of these in the form spm.
CUT_PERCENT, SPM_PERCENT = 90, 20
SLICE_BYTES = 1 << 19
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])


def rotate(buf: bytearray, begin: int, cut: int, end: int) -> None:
    """Exchange the blocks [begin, cut) and [cut, end) in place: reverse each, then both together."""
    for a, b in ((begin, cut), (cut, end), (begin, end)):
        buf[a:b] = buf[a:b][::-1]


def transformed(text: bytes, cut1: int, cut2: int, form: str) -> bytes:
    """The output for a text cut before bytes ``cut1`` and ``cut2``."""
    if form == PLAIN:
        return text
    buf = bytearray(text)
    buf[cut2:cut2] = SUFFIX
    buf[cut1:cut1] = MIDDLE
    buf[0:0] = PREFIX
    middle, suffix = len(PREFIX) + cut1, len(PREFIX) + len(MIDDLE) + cut2
    rotate(buf, middle if form == PSM else 0, suffix, len(buf))
    return bytes(buf)


def restored(output: bytes, form: str) -> bytes:
    """The text, from output and form alone: the blocks go back and the sentinels come out."""
    if form == PLAIN:
        return output
    buf = bytearray(output)
    second = buf.index(MIDDLE) if form == PSM else buf.index(PREFIX)
    first = buf.index(SUFFIX)
    rotate(buf, first, second, len(buf))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = buf.index(mark)
        del buf[at : at + len(mark)]
    return bytes(buf)


def cut_places(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every token ([A-Za-z]+ or any other character), and the offsets of the rows among them."""
    letter = _LETTER[raw]
    start = HEAD[raw]
    start[1:] &= ~(letter[1:] & letter[:-1])
    start[off[:-1][off[:-1] < len(raw)]] = True
    at = np.flatnonzero(start)
    return at, np.searchsorted(at, off)


def drawn(doc_id: int | None, n: int, seed: int = 1) -> tuple[int, int, int, int]:
    """(tokens of the prefix, of prefix and middle, hash for the choice to cut, for the form)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h = [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4)]
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    return min(a, b), max(a, b), h[2], h[3]


def _transform_map(fields: list[StructField], cut_percent: int, spm_percent: int, seed: int):
    names = [f.name for f in fields]

    def rows(ids: pa.Array, text: pa.StringArray):
        raw, off = flat_bytes(text)
        token, token_off = cut_places(raw, off)
        heads = np.concatenate(([0], np.cumsum(HEAD[raw])))
        data = raw.tobytes()
        for k, doc_id in enumerate(ids.to_pylist()):
            a, b = int(off[k]), int(off[k + 1])
            t0, t1 = int(token_off[k]), int(token_off[k + 1])
            n, body = t1 - t0, data[a:b]
            low, high, h3, h4 = drawn(doc_id, n, seed)
            plain = not n or h3 % 100 >= cut_percent or PREFIX in body or SUFFIX in body or MIDDLE in body
            form = PLAIN if plain else SPM if h4 % 100 < spm_percent else PSM
            cut1, cut2 = (int(token[t0 + x]) if x < n else b for x in (low, high))
            yield n, form, None if plain else int(heads[cut1] - heads[a]), None if plain else int(heads[cut2] - heads[cut1]), transformed(body, cut1 - a, cut2 - a, form)

    def run(batches):
        for batch in batches:
            at = 0
            for ids, text in slices([batch], SLICE_BYTES):
                n, form, prefix, middle, out = zip(*rows(ids, text))
                cols = [pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array([o.decode() for o in out], pa.string())]
                yield pa.RecordBatch.from_arrays([ids, *cols, *batch.slice(at, len(ids)).columns[2:]], names=names)
                at += len(ids)

    return run


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = 1) -> DataFrame:
    """One row per document: ``id_col``, n (tokens), form, prefix_chars, middle_chars, output.

    Cuts and form follow from sha256 of ``seed:id`` alone, so equal ids draw alike on any cluster and
    repeated rows come out alike; a null id draws as the empty one. A text that is null (as if empty), empty
    or holds a sentinel already, or that is not drawn, is plain: its output is the text, and the lengths are
    null. Other columns are ignored. Rows are transformed where they are read; nothing is shuffled.
    """
    src = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))
    fields = [StructField("id", LongType()), StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())]
    return src.mapInArrow(_transform_map(fields, cut_percent, spm_percent, seed), StructType(fields)).withColumnRenamed("id", id_col)


def restore(rows: DataFrame, form_col: str = "form", output_col: str = "output") -> DataFrame:
    """``rows`` with the column ``output_col`` replaced by ``text``, rebuilt from output and form.

    A null output gives a null text; a null form counts as plain. A column named text of ``rows`` gives way.
    """
    others = [c for c in rows.columns if c not in (output_col, "text")]
    src = rows.select(rows[output_col].cast("string").alias("_output"), F.coalesce(rows[form_col].cast("string"), F.lit(PLAIN)).alias("_form"), *(rows[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(others)))
    fields = [StructField("text", StringType()), *(StructField(c, f.dataType) for c, f in zip(others, src.schema.fields[2:]))]
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            at = 0
            for form, output in slices([batch.select([1, 0])], SLICE_BYTES):
                data = output.cast(pa.binary()).to_pylist()
                back = [None if o is None else restored(o, f).decode() for o, f in zip(data, form.to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(back, pa.string()), *batch.slice(at, len(back)).columns[2:]], names=names)
                at += len(back)

    return src.mapInArrow(run, StructType(fields))
