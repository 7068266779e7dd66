"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent 1- to 3-grams of a language's letters, words padded with a blank. A
document's own list is compared with each profile: each n-gram adds the distance between its two ranks,
or the profile's length if the profile lacks it. The language with the least sum wins.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.llm.arrow import flat_chars, slices, with_text_columns

PROFILE = 300
#: Training reads about this many documents of each language, chosen by a hash of their id.
PER_LANGUAGE = 1_500
UNKNOWN = "und"
SLICE_BYTES = 1 << 20
_BLANK = 32


@functools.cache
def _letters() -> np.ndarray:
    """Lower-cased letter of each code point; a blank for everything else."""
    out = np.full(0x110000, _BLANK, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def grams(text: pa.StringArray) -> Iterator[np.ndarray]:
    """Sorted codes of all n-grams of each row."""
    chars, off = flat_chars(text)
    rows = len(off) - 1
    at = off + np.arange(rows + 1)  # a blank stands before each row and at the end
    c = np.full(len(chars) + rows + 3, _BLANK, np.uint64)
    inner = np.ones(len(chars) + rows, bool)
    inner[at[:-1]] = False
    c[: len(inner)][inner] = _letters()[chars]
    letter = c != _BLANK
    bits = np.uint64(21)
    two = (c[:-1] << bits) | c[1:]
    three = (two[:-1] << bits) | c[2:]
    ok2, ok3 = letter[:-1] | letter[1:], letter[1:-1]
    for a, b in zip(at[:-1], at[1:]):
        e = b  # the blank that ends a row starts the next one
        out = np.concatenate((c[a:e][letter[a:e]], two[a:e][ok2[a:e]], three[a:e][ok3[a:e]]))
        out.sort()
        yield out


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    fresh = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[fresh], np.diff(np.append(fresh, len(codes)))


def _top(codes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent codes, most frequent first, ties by code."""
    most = int(counts.max())
    keys = (most - counts).astype(np.uint16 if most < 1 << 16 else np.int64)
    return codes[np.argsort(keys, kind="stable")[:k]]


def _count_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text in slices([batch], SLICE_BYTES):
            by: dict[str, list] = {}
            for name, codes in zip(lang.to_pylist(), grams(text)):
                by.setdefault(name, []).append(codes)
            for name, parts in by.items():
                codes = np.sort(np.concatenate(parts))
                if len(codes):
                    codes, counts = _counted(codes)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "c"])


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = PER_LANGUAGE, size: int = PROFILE) -> dict[str, list[int]]:
    """The ``size`` most frequent n-grams of each language, from about ``per_language`` whole documents of each."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["l"]: r["c"] for r in known.groupBy(F.col(lang_col).cast("string").alias("l")).agg(F.count(F.lit(1)).alias("c")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[x for name, c in counts.items() for x in (F.lit(name), F.lit(min(1.0, per_language / c)))])
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = known.where(draw < share[F.col(lang_col).cast("string")]).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counted = sample.mapInArrow(_count_map, "lang string, gram bigint, c bigint").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    part = F.pmod(F.xxhash64("gram"), F.lit(32))
    best = counted.groupBy("lang", part.alias("part")).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "gram"))), 1, size).alias("top"))
    found: dict[str, list] = {}
    for row in best.collect():  # at most 32 * size n-grams for each language
        found.setdefault(row["lang"], []).extend((t["c"], t["gram"]) for t in row["top"])
    return {name: [g for _, g in sorted(rows)[:size]] for name, rows in sorted(found.items())}


def _identifier(profiles: dict[str, list[int]], size: int):
    names = sorted(profiles)

    def start():
        known = np.unique(np.concatenate([np.array(profiles[n], np.uint64) for n in names])) if names else np.zeros(0, np.uint64)
        ranks = np.full((len(names), len(known) + 1), -1, np.int32)
        for i, n in enumerate(names):
            ranks[i, np.searchsorted(known, np.array(profiles[n], np.uint64))] = np.arange(len(profiles[n]))

        def judge(text: pa.StringArray) -> list[pa.Array]:
            langs, scores = [], np.zeros(len(text))
            for i, codes in enumerate(grams(text)):
                if not len(codes) or not names:
                    langs.append(UNKNOWN)
                    continue
                top = _top(*_counted(codes), size)
                at = np.searchsorted(known, top)
                at[known[np.minimum(at, len(known) - 1)] != top] = len(known)
                r = ranks[:, at]
                apart = np.where(r < 0, size, np.abs(r - np.arange(len(top), dtype=np.int32))).sum(axis=1) / (size * len(top))
                best = int(apart.argmin())
                langs.append(names[best])
                rest = min(np.delete(apart, best), default=1.0)
                scores[i] = (rest - apart[best]) / rest if rest > 0 else 0.0
            return [pa.array(langs, pa.string()), pa.array(scores)]

        return judge

    return start


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", keep: Sequence[str] = ("doc_id",), size: int = PROFILE) -> DataFrame:
    """One row per document: the columns ``keep``, lang_pred, score.

    ``score`` is how much farther the second nearest profile is, relative to its distance: 0 (a tie, won by
    the name that sorts first) to 1. A text that is null or holds no letter is ``und`` with score 0; so is
    every text if there is no profile. Repeated rows keep a row each; other columns are ignored, and columns
    in ``keep`` with the name of a result give way to it.
    """
    return with_text_columns(docs, text_col, keep, "lang_pred string, score double", _identifier(profiles, size), SLICE_BYTES)
