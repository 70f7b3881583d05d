"""Input tables and the carriers that the catalogue's queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import md5_mod

#: The moment that queries take for now; publication dates of the article carrier count back from it.
NOW = "2024-01-31 00:00:00"
TOKENS = r"[^\p{L}\p{N}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to all cores: for much work a row on a narrow table, whose few small files would be one task's."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles over documents and labels: id, source, lang, body, title, is_suppressed, score, tab, published_at, tags.

    Columns that a query does not select cost nothing: they are projections over one scan.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    key = F.col("doc_id").cast("string")
    words = F.filter(F.split(F.lower("text"), TOKENS), lambda w: F.length(w) >= 9)
    return docs.join(labels.select("doc_id", "toxic"), "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        "source",
        "lang",
        F.col("text").alias("body"),
        F.substring("text", 1, 60).alias("title"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_suppressed"),
        F.nullif(md5_mod(key, 11), F.lit(0)).cast("int").alias("score"),
        F.concat(F.lit("tab"), md5_mod(F.concat(F.lit("t"), key), 8).cast("string")).alias("tab"),
        (F.lit(NOW).cast("timestamp_ntz") - F.make_interval(hours=F.pmod("doc_id", F.lit(720)).cast("int"))).alias("published_at"),
        F.slice(F.array_sort(F.array_distinct(words)), 1, 8).alias("tags"),
    )


# The same in SQL, for the oracle.
def sql_md5_mod(text: str, n: int) -> str:
    words = [f"('0x' || substr(md5({text}), {i}, 8))::BIGINT" for i in (1, 9, 17, 25)]
    out = "0::BIGINT"
    for w in words:
        out = f"(({out} * 4294967296 + {w}) % {n})"
    return out


ARTICLES_SQL = f"""articles AS (
    SELECT d.doc_id AS id, source, lang, text AS body, substr(text, 1, 60) AS title,
           coalesce(toxic = 1, false) AS is_suppressed,
           nullif({sql_md5_mod("d.doc_id::VARCHAR", 11)}, 0)::INTEGER AS score,
           'tab' || ({sql_md5_mod("'t' || d.doc_id::VARCHAR", 8)})::VARCHAR AS tab,
           TIMESTAMP '{NOW}' - to_hours((d.doc_id % 720)::INTEGER) AS published_at,
           list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 9)))[1:8] AS tags
    FROM documents d LEFT JOIN labels l USING (doc_id))"""
PUBLISHED_SQL = "NOT is_suppressed AND score >= 6"


def stamp(c: str):
    """A timestamp as text, so that engines compare alike."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def sql_stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
