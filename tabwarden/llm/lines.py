"""Quality rules with cross-document line frequency.

Every text gets four counts that decide by themselves, and the hashes of its normalised lines: words with
A-Z lower-cased and digits written as 0, one blank between them. A line found in more than a limit of
distinct documents of one host is removed from all of its documents; a document that loses more than a
share of its words this way is depleted and rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tabwarden.llm.arrow import constants, flat_bytes, lists, mixed, slices
from tabwarden.llm.tables import Tables
from tabwarden.llm.words import HEAD, LINE_END, SPACE, Runs, among, fingerprints, first_of_each, long_column, powers, sums

#: A line of more distinct documents of its host than this is removed.
MOST_DOCUMENTS = 10
#: A document that keeps a smaller share of its words, in percent, is rejected.
LEAST_PERCENT = 50
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 50, 50, 3
#: Up to so many frequent lines (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_LINES = 500_000
#: Rows of one line are dealt to so many tasks where frequent lines are joined by a shuffle.
SALTS = 64
SLICE_BYTES = 1 << 19

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = among("#*$%&|<>")
_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] += 32
_NORMAL[48:58] = 48
_WINDOW = constants(79, WINDOW)


def _repeated_words(row: np.ndarray, word: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Words of each row that lie in a window found twice or more in it."""
    n = max(len(word) - WINDOW + 1, 0)
    h = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        h += word[j : j + n] * _WINDOW[j]
    whole = np.flatnonzero(row[:n] == row[WINDOW - 1 :]) if n else np.zeros(0, np.int64)
    order, begin, size = first_of_each(row[whole], h[whole])
    again = whole[order][np.repeat(size > 1, size)]
    marked = np.zeros(len(word), bool)
    for j in range(WINDOW):
        marked[again + j] = True
    return sums(marked, off)


def measures(text: pa.StringArray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """(COUNTS as rows, fingerprints, (line hash, its words, offsets), line hash of every line with a word) of texts; null counts as empty.

    The distinct normalised lines of a text come with the words of all their occurrences in it.
    """
    raw, off = flat_bytes(text)
    words = Runs(raw, off, SPACE)
    row = words.row()
    lines = Runs(raw, off, LINE_END)
    line = np.searchsorted(lines.start, words.start, side="right") - 1
    held = np.bincount(line, minlength=len(lines.start)) if len(line) else np.zeros(len(lines.start), np.int64)
    full = np.flatnonzero(held)
    line_row = lines.row()[full]
    _, begin, _ = first_of_each(line_row, lines.hashes()[full])
    n_lines = np.bincount(line_row, minlength=len(off) - 1)
    kinds = np.diff(np.searchsorted(begin, np.concatenate(([0], np.cumsum(n_lines)))))
    n_words = np.diff(words.off)
    counts = np.stack([n_words, sums(HEAD[raw] & words.inside, off), sums(_SYMBOL[raw], off), n_lines - kinds, _repeated_words(row, words.hashes(), words.off)])
    at = np.concatenate(([0], np.cumsum(held[full])))[:-1]
    place = np.arange(len(line)) - np.repeat(at, held[full])
    normal = np.zeros(0, np.uint64)
    if len(full):
        normal = mixed(np.add.reduceat(words.hashes(_NORMAL) * powers(int(held.max()))[place], at) + held[full].astype(np.uint64))
    order, begin, _ = first_of_each(line_row, normal)
    per = np.add.reduceat(held[full][order], begin) if len(full) else np.zeros(0, np.int64)
    line_off = np.searchsorted(line_row[order][begin], np.arange(len(off)))
    return counts, fingerprints(raw, off), (normal[order][begin].view(np.int64), per.astype(np.int64), line_off), normal


_ADDED = [*(StructField(c, LongType()) for c in COUNTS), StructField("text_hash", LongType()), StructField("lines", ArrayType(LongType())), StructField("line_words", ArrayType(LongType()))]


def _measured(rows: DataFrame) -> DataFrame:
    """``rows`` (text first) with the text replaced by its measures."""
    names = [*rows.columns[1:], *(f.name for f in _ADDED)]

    def run(batches):
        for batch in batches:
            at = 0
            for _, text in slices([pa.RecordBatch.from_arrays([batch.column(0)] * 2, names=["id", "text"])], SLICE_BYTES):
                counts, prints, (line, per, off), _ = measures(text)
                rest = batch.slice(at, len(text)).columns[1:]
                yield pa.RecordBatch.from_arrays([*rest, *map(long_column, counts), long_column(prints[:, 0]), lists(line, off), lists(per, off)], names=names)
                at += len(text)

    return rows.mapInArrow(run, StructType([*rows.schema.fields[1:], *_ADDED]))


def frequent_lines(measured: DataFrame, most_documents: int = MOST_DOCUMENTS) -> DataFrame:
    """(host, line) of the lines in more than ``most_documents`` distinct documents of their host.

    Texts that are equal are one document. Each (host, line, text) is made distinct first, so a line in a
    third of all documents is counted in many tasks, and only partial counts meet.
    """
    seen = measured.select("host", F.explode("lines").alias("line"), "text_hash").distinct()
    return seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > most_documents).select("host", "line")


def _removed(measured: DataFrame, frequent: DataFrame) -> DataFrame:
    """(rid, gone, removed_words): the frequent lines of each document that has some, and their words."""
    each = measured.select("rid", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("rid", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("w"))
    if frequent.count() <= BROADCAST_LINES:
        hit = each.join(F.broadcast(frequent), ["host", "line"])
    else:
        salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hit = each.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")).join(salted, ["host", "line", "salt"])
    return hit.groupBy("rid").agg(F.collect_list("line").alias("gone"), F.sum("w").alias("removed_words"))


def _judged(rows: DataFrame, most_documents: int, least_percent: int) -> DataFrame:
    """``rows`` (columns text, host, row) with counts, gone, removed_words, base_failed and kept; text is dropped."""
    write = Tables(rows.sparkSession, "line-rules")
    measured = write(_measured(rows.select("text", "host", "row")).withColumn("rid", F.monotonically_increasing_id()), "measured")
    frequent = write(frequent_lines(measured, most_documents), "frequent")
    out = measured.drop("lines", "line_words").join(_removed(measured, frequent), "rid", "left")
    out = out.withColumns({"removed_words": F.coalesce("removed_words", F.lit(0).cast("bigint")), "base_failed": base_failed(F.col("n_words"), F.col("n_repeat_words"))})
    depleted = (F.col("n_words") - F.col("removed_words")) * 100 < F.col("n_words") * least_percent
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < LEAST_WORDS) | (n_repeat_words * 100 > n_words * MOST_REPEATED_PERCENT)


def _host(docs: DataFrame, host_col: str) -> Column:
    return F.coalesce(docs[host_col].cast("string"), F.lit(""))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *, most_documents: int = MOST_DOCUMENTS, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """One row per document: ``id_col``, COUNTS, base_failed, kept, removed_words.

    n_symbols counts ``#*$%&|<>``; n_dup_lines lines with a word that equal an earlier line as they are;
    n_repeat_words words in a window of WINDOW words found twice or more. A document fails the base rules
    with fewer than LEAST_WORDS words, or with over MOST_REPEATED_PERCENT percent repeated words; else it is
    kept unless its host's frequent lines hold so many of its words that under ``least_percent`` stay.

    Null text counts as empty, with no word; null host as a host of its own with the empty one. Equal texts
    are one document to the limit, so copies do not make a line frequent; repeated rows keep a row each,
    null ids too. Other columns are ignored. No rows give no rows.
    """
    rows = docs.select(docs[text_col].cast("string").alias("text"), _host(docs, host_col).alias("host"), docs[id_col].cast("bigint").alias("row"))
    return _judged(rows, most_documents, least_percent).select(F.col("row").alias(id_col), *COUNTS, "base_failed", "kept", "removed_words")


def _without_map(fields: list[StructField]):
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            at = 0
            for gone, text in slices([batch], SLICE_BYTES):
                where, texts = text.is_valid().to_pylist(), text.to_pylist()
                for i, hashes in enumerate(gone.to_pylist()):
                    if hashes and where[i]:
                        parts = texts[i].split("\n")
                        full = [k for k, p in enumerate(parts) if p.strip(" \t\n\v\f\r")]
                        known = measures(pa.array([texts[i]], pa.string()))[3].view(np.int64)
                        out = set(np.flatnonzero(np.isin(known, np.array(hashes))).tolist())
                        drop = {full[k] for k in out}
                        texts[i] = "\n".join(p for k, p in enumerate(parts) if k not in drop)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.slice(at, len(text)).columns[2:]], names=names)
                at += len(text)

    return run


def cleaned(docs: DataFrame, text_col: str = "text", host_col: str = "source", *, most_documents: int = MOST_DOCUMENTS, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns, and without the frequent lines of their host."""
    rows = docs.select(docs[text_col].cast("string").alias("text"), _host(docs, host_col).alias("host"), F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns)).alias("row"))
    kept = _judged(rows, most_documents, least_percent).where("kept")
    src = kept.select(F.coalesce("gone", F.array().cast("array<bigint>")).alias("gone"), F.col("row").getField(text_col).cast("string").alias("text"), "row")
    fields = [src.schema["text"], src.schema["row"]]
    out = src.mapInArrow(_without_map(fields), StructType(fields))
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
