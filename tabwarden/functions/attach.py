"""Facts per key joined to rows, without sending the rows of a frequent key to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.sources.storage import checkpointed

#: Facts up to this number are broadcast whole.
MAX_BROADCAST = 200_000
#: A key is frequent with more rows than this and more than one row in HOT_SHARE; so at most HOT_SHARE keys are.
HOT_ROWS, HOT_SHARE = 1_000_000, 100_000


def frequent_keys(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The keys of ``rows`` with so many rows that their task would last; counted exactly, combined in each task first."""
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    floor = max(HOT_ROWS, rows.count() // HOT_SHARE)
    return checkpointed(counts.where(F.col("__n") > floor).select(*key))


def attached(rows: DataFrame, facts: DataFrame, key: Sequence[str], how: str = "inner", size: int | None = None) -> DataFrame:
    """``rows`` joined with ``facts`` on ``key``: ``inner``, ``left`` or ``left_semi``.

    ``facts`` has one row per key. Few facts are broadcast. Of many, those of frequent keys are broadcast
    to their rows, which stay where they are; all other rows meet their facts by a shuffle in which no key
    is frequent. NULL keys match nothing. ``size`` is the number of facts, if it is known.
    """
    if (facts.count() if size is None else size) <= MAX_BROADCAST:
        return rows.join(F.broadcast(facts), list(key), how)
    hot = frequent_keys(rows.where(" and ".join(f"`{k}` is not null" for k in key)), key)
    if hot.isEmpty():
        return rows.join(facts, list(key), how)
    some = F.broadcast(facts.join(F.broadcast(hot), list(key), "left_semi"))
    still = rows.join(F.broadcast(hot), list(key), "left_semi").join(some, list(key), how)
    return still.unionByName(rows.join(F.broadcast(hot), list(key), "left_anti").join(facts, list(key), how))
