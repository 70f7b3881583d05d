"""Mixing sources to target weights (op 7).

Every document gets a hash-random key. Within its source the key's range is cut into even buckets (the
hash is uniform, so bucket bounds need no sampling); buckets are sorted in parallel, bucket totals are
prefix-summed in a small second table, and both sums together give a document's place in its source's
random order. The mix takes ``floor(target / source size)`` whole epochs and then documents in that order
up to the source's exact budget, cutting the last one.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of its own, last in
order; rows that repeat a doc_id are documents of their own, ordered by size and digest of the text; rows
equal in id, source and text are interchangeable, and ``mix`` gives the words of all of them out through one
of them; a source of size 0 has target 0; an empty table gives an empty result; very long texts are one
document as any other; further columns are ignored, or kept by ``mix``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, body, free_names, settle

#: Rows that a bucket of a source's random order holds, at any number of rows.
BUCKET_ROWS = 2_000


def targets(sizes: list[tuple[str | None, int]], share: float, weights: tuple[int, ...], epochs: float) -> list[tuple[str | None, int, float]]:
    """(source, size, target) by water-filling: shares go by weight, at most ``epochs`` times the size, and the excess is reshared."""
    order = sorted(sizes, key=lambda s: (s[0] is None, [ord(c) for c in s[0] or ""]))
    weight = [weights[i % len(weights)] for i in range(len(order))]
    left, free, got = share * sum(n for _, n in order), set(range(len(order))), [0.0] * len(order)
    while free:
        unit = left / sum(weight[i] for i in free)
        full = {i for i in free if unit * weight[i] > epochs * order[i][1]}
        if not full:
            for i in free:
                got[i] = unit * weight[i]
            break
        for i in sorted(full):
            got[i] = epochs * order[i][1]
            left -= got[i]
        free -= full
    return [(s, n, float(t)) for (s, n), t in zip(order, got, strict=True)]


def _marks(text_col: str) -> tuple[Column, Column]:
    """Two digests that tell the texts of rows with the same id apart."""
    return tuple(F.xxhash64(F.lit(salt), body(text_col)) for salt in (101, 202))


def plan(docs: DataFrame, id_col: str = "doc_id", share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), epochs: float = 2.0, seed: int = 17, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, source, key, mark_a, mark_b, size, source_size, target, budget, before, taken."""
    spark = docs.sparkSession
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"))
    rows = settle(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(body(text_col), F.lit(WORD)).cast("long").alias("size"), key.alias("key"), *(m.alias(n) for m, n in zip(_marks(text_col), ("mark_a", "mark_b"), strict=True)))
    )
    # A row per source: its number is bounded by the sources, not by the documents.
    per_source = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    found = per_source.collect()
    counts = {r["source"]: r["n"] for r in found}
    goal = targets([(r["source"], r["size"]) for r in found], share, weights, epochs)
    per = spark.createDataFrame(
        [(s, n, t, int(round(t)), max(1, -(-counts[s] // BUCKET_ROWS))) for s, n, t in goal],
        "source string, source_size long, target double, budget long, buckets int",
    )
    same = rows["source"].eqNullSafe(per["source"])
    unit = F.shiftrightunsigned("key", 11) / F.lit(float(1 << 53))
    dealt = rows.join(per, same).drop(per["source"]).withColumn("bucket", F.floor(unit * F.col("buckets")).cast("int"))
    # The keys are unsigned in the bucket rule; sort them the same way.
    order = [F.shiftrightunsigned("key", 1), F.col("key"), F.col("id"), F.col("size"), F.col("mark_a"), F.col("mark_b")]
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(sums.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)).alias("start")))
    within = Window.partitionBy("source", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(starts, placed["source"].eqNullSafe(starts["source"]) & (placed["bucket"] == starts["bucket"])).drop(starts["source"], starts["bucket"])
    whole = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    rest = F.col("budget") - whole * F.col("source_size")
    before = F.col("within") + F.col("start")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return placed.select("id", "source", "key", "mark_a", "mark_b", "size", "source_size", "target", "budget", before.alias("before"), (whole * F.col("size") + part).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each document once per epoch that takes it whole, and the last one of a source cut to the words its budget has left.

    Rows find their place by id, source and text digests, so rows that only share an id keep their own words.
    """
    i, s, a, b, own, size, words = free_names(docs, "id", "source", "a", "b", "taken", "size", "words")
    keys = [i, s, a, b]
    took = plan(docs, id_col, text_col=text_col, source_col=source_col, **options).filter("taken > 0")
    took = took.groupBy("id", "source", "mark_a", "mark_b").agg(F.sum("taken").alias(own), F.first("size").alias(size))
    took = settle(took.select(*(F.col(c).alias(k) for c, k in zip(("id", "source", "mark_a", "mark_b"), keys, strict=True)), own, size))
    # Null ids and sources are values of their own; copies of a row merge in their task before they move.
    value = lambda c: F.struct(c.isNull().alias("none"), c.alias("value"))
    marks = _marks(text_col)
    rows = docs.withColumns({i: value(F.col(f"`{id_col}`")), s: value(F.col(f"`{source_col}`")), a: marks[0], b: marks[1]}).dropDuplicates(keys)
    rows = rows.join(took.withColumns({i: value(F.col(i)), s: value(F.col(s))}), keys)
    spans = F.sequence(F.lit(0).cast("long"), F.floor((F.col(own) - 1) / F.col(size)).cast("long"))
    rows = rows.withColumn(words, F.explode(F.transform(spans, lambda k: F.least(F.col(size), F.col(own) - k * F.col(size)))))
    # Pieces that end with a word, separators before it included.
    pieces = F.split(body(text_col), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.lit(1), F.col(words)).cast("int")), "")
    text = F.when(F.col(words) < F.col(size), cut).otherwise(F.col(f"`{text_col}`"))
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
