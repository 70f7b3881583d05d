"""Exact deduplication with a log-structured merge index (op 9), in DataFrame operations only.

* Memtable and flush: each task sorts the digests of its rows and flushes them as one sorted run, a
  Parquet file with a Bloom filter on the digest, into level 0.
* Compaction: runs of a level merge into the next; a digest keeps its smallest and largest identifier
  and its row count. Copies meet in their task before they are shuffled.
* The merged level tells the hits (digests seen more than once). Their filter, one bit a digest in a table
  of at most ``filters.FILTER_BITS`` / 64 words, is sent to the tasks that read texts: what it clears is never
  shuffled, and a false hit costs only its own shuffle.
* Hits receive byte verification: rows are grouped by digest *and* text, copies of a task first, so a text
  moves once a task however many copies there are. Texts that share a digest without being equal fall
  apart again.
* Decisions go back to the rows by digest. Digests of more than a ``HOT_SHARE``-th of all rows, fewer than
  ``HOT_SHARE`` by count, are sent to every task, so that no task receives all rows of a digest.

Defined cases: a null text is the empty text; a null doc_id sorts below all others; rows that repeat a
doc_id count one by one in group_size and share ``kept``, ``drop_copies`` returns one of them; very long
texts are texts as any other; an empty table gives an empty result; columns beside the id and the text are
carried through ``drop_copies`` and otherwise ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..filters import hit_filter, probed
from .common import body, free_names, settle, table_path

#: Digests with more than this share of the rows are broadcast.
HOT_SHARE = 10_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _write_run(df: DataFrame, path: str) -> None:
    df.sortWithinPartitions("digest").write.option("parquet.bloom.filter.enabled#digest", "true").parquet(path)


def flush(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> None:
    """Write the digests of ``docs`` as sorted runs, one for each task, with Bloom filters."""
    rows = docs.select(F.col(id_col).alias("id"), digest(body(text_col)).alias("digest"))
    _write_run(rows, path)


def compact(spark: SparkSession, runs: list[str], path: str, levelled: bool = False) -> None:
    """Merge ``runs`` into a run of the next level: per digest its smallest and largest id and its rows.

    ``levelled``: the runs are themselves compacted (their counts add up).
    """
    rows = spark.read.parquet(*runs)
    if not levelled:
        rows = rows.select("digest", F.col("id").alias("min_id"), F.col("id").alias("max_id"), F.lit(1).cast("long").alias("rows"))
    merged = rows.groupBy("digest").agg(F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"), F.sum("rows").alias("rows"))
    _write_run(merged, path)


class Index:
    """The merged index of a table: ``keys`` (id, digest) of every row, ``groups`` (digest, keep_id,
    group_size) of copies, and ``collided`` (digest, body, keep_id, group_size) of texts that share a digest
    without being equal, None where there are none."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", digest=sha256):
        spark = docs.sparkSession
        level0, level1 = table_path(spark, "runs-0"), table_path(spark, "runs-1")
        flush(docs, level0, id_col, text_col, digest)
        compact(spark, [level0], level1)
        self.keys = spark.read.parquet(level0)
        self._words = settle(hit_filter(spark.read.parquet(level1).filter("rows > 1").select("digest")))
        self._hot_rows = self.keys.count() // HOT_SHARE + 1
        rows = docs.select(F.col(f"`{id_col}`").alias("id"), body(text_col).alias("body")).withColumn("digest", digest(F.col("body")))
        pick = F.max("id") if keep == "largest" else F.min("id")
        texts = self.probed(rows, "digest", "hit").filter("hit").groupBy("digest", "body").agg(pick.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        per_digest = texts.select("digest", "keep_id", "group_size").groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.first("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        verified = settle(per_digest.filter("group_size > 1"))
        self.groups = verified.filter("texts = 1").drop("texts")
        clashing = verified.filter("texts > 1").select("digest")
        self.collided = None if clashing.isEmpty() else settle(texts.join(clashing, "digest", "left_semi"))

    def probed(self, rows: DataFrame, digest: str, name: str) -> DataFrame:
        """``rows`` with the column ``name``: whether the filter lets the digest pass. No shuffle; the filter's size is bounded."""
        return probed(rows, self._words, digest, name)

    def told(self, rows: DataFrame, digest: str, keep_id: str, group_size: str) -> DataFrame:
        """``rows`` with the id that stays and the size of their group; null where a row is alone. Hot digests meet by broadcast: at most ``HOT_SHARE`` of them."""
        known = self.groups.select(F.col("digest").alias(digest), F.col("keep_id").alias(keep_id), F.col("group_size").alias(group_size))
        hot = known.filter(F.col(group_size) > self._hot_rows)
        cold = known.filter(F.col(group_size) <= self._hot_rows)
        rest = rows.join(F.broadcast(hot.select(digest)), digest, "left_anti").join(cold, digest, "left")
        return rest.unionByName(rows.join(F.broadcast(hot), digest))

    def parted(self, rows: DataFrame, digest: str, text: str, keep_id: str, group_size: str) -> DataFrame:
        """As ``told``, and with the text for digests that different texts share."""
        if self.collided is None:
            return self.told(rows, digest, keep_id, group_size)
        wide = self.collided.select(F.col("digest").alias(digest), F.col("body").alias(text), F.col("keep_id").alias(keep_id), F.col("group_size").alias(group_size))
        own = self.told(rows.join(wide.select(digest).distinct(), digest, "left_anti"), digest, keep_id, group_size)
        return own.unionByName(rows.join(wide, [digest, text]))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", digest=sha256) -> DataFrame:
    """One row per document: id, digest, keep_id, group_size, kept."""
    index = Index(docs, id_col, text_col, keep, digest)
    if index.collided is None:
        out = index.told(index.keys, "digest", "keep_id", "group_size")
    else:
        rows = docs.select(F.col(f"`{id_col}`").alias("id"), body(text_col).alias("body")).withColumn("digest", digest(F.col("body")))
        out = index.parted(rows, "digest", "body", "keep_id", "group_size")
    alone = F.col("group_size").isNull()
    return out.select(
        "id",
        "digest",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", digest=sha256) -> DataFrame:
    """``docs`` without the copies: of equal texts the row with the largest (or smallest) id stays, once. Texts that the filter clears are not shuffled."""
    index = Index(docs, id_col, text_col, keep, digest)
    d, b, k, n, hit = free_names(docs, "digest", "body", "keep", "size", "hit")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = index.probed(docs.withColumn(b, body(text_col)).withColumn(d, digest(F.col(b))), d, hit)
    told = index.parted(rows.filter(hit), d, b, k, n)
    kept = told.filter(F.col(n).isNull() | F.col(f"`{id_col}`").eqNullSafe(F.col(k)))
    # Rows that repeat the id that stays: only then one of them is picked.
    repeated = index.told(index.keys, "digest", "keep", "size").filter("size is not null and id <=> keep").groupBy("digest").count().filter("count > 1")
    if index.collided is not None or not repeated.isEmpty():
        kept = kept.dropDuplicates([d, b])
    return rows.filter(~F.col(hit)).select(*columns).unionByName(kept.select(*columns))
