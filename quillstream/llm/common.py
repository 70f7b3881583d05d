"""Helpers shared by the corpus operators: shared storage, sizing, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import settle, shared_folder, table_path

__all__ = ["WORD", "body", "free_names", "input_bytes", "read_again", "settle", "shards_for", "shared_folder", "table_path"]

#: Every white-space byte of the word rule ``[^\x20\x09-\x0D]+``; ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` with a prefix that no column of ``df`` begins with, so that helper columns never clash."""
    mark = "__"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    return [mark + n for n in names]


def read_again(df: DataFrame) -> DataFrame:
    """The same rows on one execution of the plan: what several actions read of it is shuffled once, and made anew if lost."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes that a plan reads; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shards_for(df: DataFrame, bytes_each: int) -> int:
    """Shards such that each holds about ``bytes_each`` of the input, and no fewer than the session's shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return max(least, -(-size // bytes_each) if size < 1 << 56 else 1)


def body(text: str = "text") -> Column:
    """The text of a document; null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))
