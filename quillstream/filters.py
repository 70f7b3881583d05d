"""A filter of bounded size over keys: what it clears need not be shuffled; what it passes by chance falls out in the join behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter.
FILTER_BITS = 1 << 24


def _bit(digest: Column) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(FILTER_BITS).cast("long"))


def hit_filter(hits: DataFrame) -> DataFrame:
    """(word, mask): the Bloom filter of the column ``digest``, at most ``FILTER_BITS`` / 64 rows."""
    at = _bit(F.col("digest"))
    bits = hits.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("mask"))
    return bits.groupBy("word").agg(F.bit_or("mask").alias("mask"))


def probed(rows: DataFrame, words: DataFrame, digest: str, name: str) -> DataFrame:
    """``rows`` with the column ``name``: whether the filter ``words`` (of ``hit_filter``) lets the column ``digest`` pass."""
    mark = "__"
    while any(c.lower().startswith(mark) for c in rows.columns):
        mark += "_"
    word, mask = mark + "word", mark + "mask"
    words = F.broadcast(words.select(F.col("word").alias(word), F.col("mask").alias(mask)))
    at = _bit(F.col(digest))
    set_ = F.call_function("shiftrightunsigned", F.col(mask), at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return rows.withColumn(word, F.shiftright(at, 6)).join(words, word, "left").withColumn(name, F.coalesce(set_, F.lit(False))).drop(word, mask)
