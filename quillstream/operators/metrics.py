"""Counts, traffic statistics and rule-based assignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import md5_mod


def tag_counts(rows: DataFrame, least: int = 3) -> DataFrame:
    return rows.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def overview(events: DataFrame) -> DataFrame:
    """Active users, sessions (user and day), views, mean events a session as text 'Md Ss'."""
    per_session = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("span"))
    seconds = F.floor(F.avg(F.col("span")) / 1_000_000).cast("long")
    out = per_session.agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("views"), seconds.alias("s"))
    return out.select("users", "sessions", "views", F.concat(F.floor(F.col("s") / 60).cast("string"), F.lit("m "), (F.col("s") % 60).cast("string"), F.lit("s")).alias("mean_session"))


def daily_active(events: DataFrame) -> DataFrame:
    """Distinct users per day with the height of a bar: at least 4, 100 for the largest day. One row per day reaches the window."""
    days = events.groupBy(F.to_date("ts").alias("day")).agg(F.countDistinct("user_id").alias("users"))
    most = F.greatest(F.lit(1), F.max("users").over(Window.partitionBy(F.lit(0))))
    return days.withColumn("bar", F.greatest(F.lit(4), F.round(F.col("users") / most * 100).cast("int")))


def top_k(rows: DataFrame, by: str, measure: Column, k: int = 5) -> DataFrame:
    return rows.groupBy(by).agg(measure.alias("value")).orderBy(F.desc("value"), by).limit(k).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("value"), by)))


def assign_by_rules(rules: list[tuple[Column, Column]], fallback: Column) -> Column:
    """The value of the first rule that holds."""
    first, *rest = rules
    return reduce(lambda w, r: w.when(F.coalesce(r[0], F.lit(False)), r[1]), rest, F.when(F.coalesce(first[0], F.lit(False)), first[1])).otherwise(fallback)


def keyword_category(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Ordered keyword rules, whole words, first match wins."""
    return assign_by_rules([(F.lower(text).rlike(rf"\b(?:{words})\b"), F.lit(name)) for name, words in rules], F.lit(default))


def author_for(key: Column, names: list[str]) -> Column:
    """A stable author by hash; none without a key."""
    return F.when(F.coalesce(key, F.lit("")) != "", F.element_at(F.array(*map(F.lit, names)), (md5_mod(key, len(names)) + 1).cast("int")))


def validate_keys(rows: DataFrame, key: str, dimension: DataFrame, dimension_key: str, default: Column) -> DataFrame:
    """Unknown keys become the default. An empty dimension switches the check off."""
    known = dimension.select(F.col(dimension_key).alias("__known")).distinct()
    any_row = known.agg((F.count(F.lit(1)) > 0).alias("__any"))
    joined = rows.join(known, F.col(key) == F.col("__known"), "left").join(any_row, F.lit(True))
    return joined.withColumn(key, F.when(F.col("__any") & F.col("__known").isNull(), default).otherwise(F.col(key))).drop("__known", "__any")


def referrer_class(host: Column, sources: dict[str, str]) -> Column:
    """The name of the source whose domain the host is or ends with."""
    return assign_by_rules([((host == d) | host.endswith(f".{d}"), F.lit(n)) for d, n in sources.items()], F.lit("other"))


def status_histogram(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(F.substring_index(status, ":", 1).alias("status")).agg(F.count(F.lit(1)).alias("n"))
