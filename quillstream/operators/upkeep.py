"""Upkeep of a stored collection: lookups, decoration, selectors of backfills, orphans, listings read until they end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .reads import newest_first, page

# Phrases of job postings; names of countries and regions in titles.
JOBS = ["individual contractor", "national consultant", "international consultant", "national professional officer", "international professional officer", "national expert", "international expert", "vacancy announcement", "job opening", "call for applications", "hiring an ", "ic - individual", "- ic -", "- ic:", "terms of reference for a consultant", "terms of reference for consultant", "lta for individual", "programme officer", "programme associate", "project officer", "programme analyst", "field officer"]
COUNTRIES = ["nigeria", "kenya", "ghana", "ethiopia", "tanzania", "uganda", "south africa", "zimbabwe", "mozambique", "zambia", "malawi", "angola", "cameroon", "senegal", "ivory coast", "cote d'ivoire", "mali", "burkina faso", "niger", "guinea", "benin", "togo", "sierra leone", "liberia", "gambia", "guinea-bissau", "cape verde", "mauritania", "rwanda", "burundi", "somalia", "djibouti", "eritrea", "south sudan", "comoros", "seychelles", "madagascar", "mauritius", "dr congo", "congo", "central african", "gabon", "equatorial guinea", "sao tome", "chad", "botswana", "lesotho", "namibia", "swaziland", "eswatini", "egypt", "morocco", "algeria", "tunisia", "libya", "sudan", "africa", "eastern and southern africa", "western and central africa", "mid east,north africa", "north africa"]


def holds_any(text: Column, phrases: list[str]) -> Column:
    """A phrase stands anywhere in the text, also within a word."""
    return F.lower(text).rlike("|".join(rf"\Q{p}\E" for p in phrases))


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """None or one row by key."""
    return rows.filter(F.col(key) == value).limit(1)


def admin_list(rows: DataFrame, query: str | None, number: int = 1, size: int = 20, title: str = "title") -> DataFrame:
    """Every row, also hidden ones, with a title like the query, whose '%' and '_' stay wildcards; at most 100 a page."""
    if query:
        rows = rows.filter(F.col(title).ilike(f"%{query}%"))
    return page(rows, number, max(1, min(100, size)))


def featured(published: DataFrame, flag: str = "is_featured") -> DataFrame:
    """The newest featured row, or where there is none the newest of all: one scan."""
    return published.orderBy(F.coalesce(F.col(flag), F.lit(False)).desc(), *newest_first()).limit(1)


def decorate(rows: DataFrame, key: str, dimension: DataFrame, dimension_key: str, label: str, to: str) -> DataFrame:
    """``to`` holds the dimension's label, or the key itself where the dimension has none."""
    names = dimension.select(F.col(dimension_key).alias("__key"), F.col(label).alias("__label")).dropDuplicates(["__key"])
    return rows.join(names, F.col(key) == F.col("__key"), "left").withColumn(to, F.coalesce("__label", F.col(key).cast("string"))).drop("__key", "__label")


def by_vocabulary(rows: DataFrame, asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(asked, row) for asked slugs of a closed vocabulary (slug, tag): rows with the slug's tag; a slug that is not in it finds nothing."""
    wanted = asked.join(vocabulary, F.col("asked") == F.col("slug")).select("asked", "tag")
    return rows.withColumn("tag", F.explode(F.array_distinct("tags"))).join(wanted, "tag").drop("tag")


def enabled(registry: DataFrame, flag: str = "enabled") -> DataFrame:
    return registry.filter(F.coalesce(F.col(flag), F.lit(False)))


def once_per_session(visits: DataFrame, session: str, source: str) -> DataFrame:
    return visits.filter(F.col(source).isNotNull()).select(session, source).distinct()


def new_urls(current: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Keys that a batch inserts; updates are not announced."""
    return batch.select(key).distinct().join(current.select(key), key, "left_anti")


def until_few_new(rows: DataFrame, least: int = 50, cap: int | None = None) -> DataFrame:
    """Rows (page, position, id) of a listing read page by page: each id at its first place, pages up to the first with fewer than ``least`` new ids, that one included."""
    first = rows.groupBy("id").agg(F.min(F.struct("page", "position")).alias("at")).select("id", "at.page", "at.position")
    pages = rows.select("page").distinct().join(first.groupBy("page").agg(F.count(F.lit(1)).alias("new")), "page", "left")
    last = pages.filter(F.coalesce("new", F.lit(0)) < least).agg(F.min("page").alias("last"))
    out = first.join(last, F.lit(True)).filter(F.col("last").isNull() | (F.col("page") <= F.col("last"))).select("page", "position", "id")
    return out if cap is None else out.orderBy("page", "position").limit(cap)


def orphan_summary(orphans: DataFrame, expected: int, size: str = "bytes") -> DataFrame:
    """(n, megabytes, suspicious): suspicious where the number is off the expected one by more than the larger of 20 and 2 %."""
    out = orphans.agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum(size), F.lit(0)) / 1024 / 1024, 1).alias("megabytes"))
    return out.withColumn("suspicious", F.abs(F.col("n") - expected) > F.greatest(F.lit(20.0), F.lit(0.02 * expected)))


def deletable(orphans: DataFrame, backup: DataFrame, path: str = "path", size: str = "bytes") -> DataFrame:
    """Orphans that the backup holds in the same size."""
    return orphans.join(backup.select(path, F.col(size).alias("__held")), path).filter(F.col(size) == F.col("__held")).drop("__held")


def or_original(new: Column, original: Column) -> Column:
    """A missing or blank translation falls back to the original."""
    return F.coalesce(F.when(F.trim(new) != "", new), original)


def needs(rules: dict[str, Column]) -> Column:
    """The sorted names of the rules that hold: which backfills select a row."""
    return F.array_sort(F.filter(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull()))


def dedupe_images(images: Column, most_bits: int = 24) -> Column:
    """An item's images (url, hash) without those whose URL, file stem or close hash came before; a null hash is close to none."""
    from ..functions.values import differing_bits, hex_words

    # Stems and the words of hashes are made once an image, not once a pair.
    made = F.transform(images, lambda x: F.struct(x.alias("image"), T.image_stem(x["url"]).alias("stem"), hex_words(x["hash"]).alias("words")))
    same = lambda x, y: (x["image"]["url"] == y["image"]["url"]) | (x["stem"] == y["stem"]) | F.coalesce(differing_bits(x["words"], y["words"]) <= most_bits, F.lit(False))
    kept = T.let(made, lambda all_: F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, F.lit(1), i), lambda y: same(x, y))))
    return F.transform(kept, lambda x: x["image"])


def reprocess(rows: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """All stages in order; a row tells the last one in ``stage``."""
    for name, stage in stages:
        rows = stage(rows).withColumn("stage", F.lit(name))
    return rows


def drop_retired(dimension: DataFrame, key: str, retired: list[str]) -> DataFrame:
    return dimension.filter(~F.col(key).isin(retired))


def recent_runs(stats: DataFrame, order: list[Column], k: int = 10) -> DataFrame:
    return stats.orderBy(*order).limit(k)


def log_report(logs: DataFrame) -> DataFrame:
    """(file, published, dropped, mean_score, percent) of (file, value) logs with 'published score=N' and 'dropped score=N' lines; the mean is over both."""
    scores = lambda word: F.transform(F.regexp_extract_all("value", F.lit(rf"(?m)\b{word}\b[^\n]*?score=(\d+)"), F.lit(1)), lambda x: x.cast("double"))
    made = logs.select("file", scores("published").alias("p"), scores("dropped").alias("d"))
    both, n = F.concat("p", "d"), F.size("p") + F.size("d")
    mean = F.round(F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0)), 2)
    return made.select("file", F.size("p").cast("long").alias("published"), F.size("d").cast("long").alias("dropped"), mean.alias("mean_score"), F.round(100.0 * F.size("p") / F.nullif(n, F.lit(0)), 1).alias("percent"))


def first_free(items: Column, used: Column) -> Column:
    """The first item that is not in use, null where all are."""
    return F.get(F.filter(items, lambda x: ~F.array_contains(used, x)), F.lit(0))


def fallback_photo(steps: list[Column], used: Column) -> Column:
    """(url, step): the first picture not in use of the first step that has one; a step is the list that a search gave (null: it failed, or was not asked)."""
    firsts = [F.get(F.filter(s, lambda x: ~F.array_contains(used, x) & (x != "")), F.lit(0)) for s in steps]
    return F.coalesce(*(F.when(u.isNotNull(), F.struct(u.alias("url"), F.lit(k + 1).alias("step"))) for k, u in enumerate(firsts)))


def rewrite_status(old: Column, new: Column) -> Column:
    """What a backfill of addresses does with a row: nothing without an address or where the rule leaves it as it is, so that a second run changes nothing."""
    return F.when(F.coalesce(old, F.lit("")) == "", "none").when(new.eqNullSafe(old), "skipped").otherwise("changed")


def range_start(now: Column, chip: str) -> Column | None:
    """The start of a range that a reader picks; an unknown one is no filter."""
    days = {"24h": 1, "week": 7, "month": 30, "year": 365}.get(chip)
    return None if days is None else now - F.expr(f"interval {days} days")

