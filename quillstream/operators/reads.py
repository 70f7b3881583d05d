"""The read side: visibility, listings, top-k with fallback, neighbours, recommendations, key resolution."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import table_path
from ..tables import spread

PAGE_SIZE, LEAST_SCORE = 12, 6
#: Sets of tab and sectors with more than one of so many rows meet their candidates by broadcast; there are fewer than that.
FREQUENT = 500
LIST_COLUMNS = ["id", "source", "title", "score", "tab", "published_at"]


def published(articles: DataFrame, least_score: int = LEAST_SCORE) -> DataFrame:
    """The one place that says what readers see. A null score is not visible."""
    return articles.filter(~F.col("is_suppressed") & (F.col("score") >= least_score) & F.col("title").isNotNull())


def newest_first() -> list[Column]:
    return [F.col("published_at").desc_nulls_last(), F.col("id").desc()]


def page(rows: DataFrame, number: int = 1, size: int = PAGE_SIZE, order: list[Column] | None = None) -> DataFrame:
    """Page ``number`` (from 1) in a total order."""
    return rows.orderBy(*(order or newest_first())).offset((max(1, number) - 1) * size).limit(size)


def page_with_total(rows: DataFrame, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """A page with the exact count of all rows: one row of count joined to at most a page of rows."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return page(rows, number, size).join(total, F.lit(True))


def listing(rows: DataFrame, tab: str | None = None, source: str | None = None, tag: str | None = None, exclude: list[int] | None = None, region: str | None = None, everywhere: str = "everywhere", number: int = 1) -> DataFrame:
    """Filters that are given apply; a region of ``everywhere`` and an empty exclusion are no filters."""
    if tab is not None:
        rows = rows.filter(F.col("tab") == tab)
    if source is not None:
        rows = rows.filter(F.col("source") == source)
    if tag is not None:
        rows = rows.filter(F.array_contains("tags", tag))
    if exclude:
        rows = rows.filter(~F.col("id").isin(exclude))
    if region is not None and region != everywhere:
        rows = rows.filter(F.col("region") == region)
    return page(rows, number)


def catch_all(rows: DataFrame, tag: str, tab: str) -> DataFrame:
    """Rows with the tag, or of the tab without any tag."""
    return rows.filter(F.coalesce(F.array_contains("tags", tag), F.lit(False)) | ((F.col("tab") == tab) & (F.size("tags") == 0)))


def top_with_fallback(window: DataFrame, everything: DataFrame, k: int, order: list[Column], fallback_order: list[Column]) -> DataFrame:
    """The k first of the window; if it has fewer, the k first of everything instead. One plan, no trip to the driver."""
    first = window.orderBy(*order).limit(k).withColumn("fallback", F.lit(False))
    rest = everything.orderBy(*fallback_order).limit(k).withColumn("fallback", F.lit(True))
    enough = first.agg((F.count(F.lit(1)) >= k).alias("enough"))
    return first.unionByName(rest).join(enough, F.lit(True)).filter(F.col("fallback") != F.col("enough")).drop("enough")


def next_in_order(rows: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """(id, next_id): the next older row that is not a tombstone, null at the end. Cut by day to keep windows small.

    The order is total, so the successor of a day's last row is the first row of the next earlier day.
    """
    if tombstones is not None:
        rows = rows.join(tombstones, "id", "left_anti")
    rows = rows.select("id", "published_at", F.to_date("published_at").alias("day"))
    own = rows.withColumn("next_id", F.lead("id").over(Window.partitionBy("day").orderBy(*newest_first())))
    firsts = rows.groupBy("day").agg(F.max(F.struct("published_at", "id")).alias("first"))
    after = firsts.select(F.lead("day").over(Window.orderBy(F.col("day").desc())).alias("older"), "day").filter("older is not null")
    bridge = after.join(firsts.select(F.col("day").alias("older"), F.col("first.id").alias("across")), "older").select("day", "across")
    return own.join(bridge, "day", "left").select("id", F.coalesce("next_id", "across").alias("next_id"))


def latest_per_group(rows: DataFrame, group: str, order: list[Column], n: int = 3, among: int | None = None) -> DataFrame:
    """The first n of each group, of the ``among`` first rows over all where given."""
    if among:
        rows = rows.orderBy(*order).limit(among)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= n)


def _scored(weights: tuple[int, int, int], tags: Column, sectors: Column, tab: Column, other: Callable[[str], Column] = F.col) -> Column:
    """What a candidate (``other`` of tags, sectors, tab) shares with an item; a tag that the candidate repeats counts each time."""
    none = F.array().cast("array<string>")
    count = lambda own, theirs: F.size(F.filter(F.coalesce(theirs, none), lambda t: F.array_contains(F.coalesce(own, none), t)))
    return weights[0] * count(tags, other("tags")) + weights[1] * count(sectors, other("sectors")) + weights[2] * F.coalesce((other("tab") == tab).cast("int"), F.lit(0))


def _kept(rows: DataFrame) -> DataFrame:
    path = table_path(rows.sparkSession, "similar")
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def similar(rows: DataFrame, now: Column, k: int = 5, newest: int = 50, days: int = 60, weights: tuple[int, int, int] = (2, 3, 1)) -> DataFrame:
    """(id, other_id, weight, rank): recommendations for every row, by shared tags, sectors and tab.

    Candidates of a row are the ``newest`` of the last ``days`` in its tab or with one of its sectors; a row with neither
    tab nor sectors meets the ``newest`` of all. The newest of a union lie among the newest of each part, so each tab and
    each sector keeps its ``newest`` + 1 rows (a row's own is passed over), and the union is made once for all rows that
    have the same tab and sectors. A row scores its candidates where it lies: pairs are never shuffled. What many rows
    share comes by broadcast (fewer than ``FREQUENT`` sets), the rest by a join in which no key has more than one of
    ``FREQUENT`` rows.
    """
    none = F.array().cast("array<string>")
    spots = F.array_distinct(F.concat(F.when(F.col("tab").isNotNull(), F.array(F.concat(F.lit("tab "), "tab"))).otherwise(none), F.transform(F.coalesce("sectors", none), lambda x: F.concat(F.lit("sector "), x))))
    rows = _kept(spread(rows.select("id", "published_at", "tab", "sectors", "tags", F.array_sort(spots).alias("spots")).withColumn("asking", F.when(F.size("spots") > 0, F.col("spots")).otherwise(F.array(F.lit("all"))))))
    fresh = rows.filter(F.col("published_at") >= now - F.expr(f"interval {days} days"))
    posts = fresh.select(F.explode(F.concat("spots", F.array(F.lit("all")))).alias("spot"), "id", "published_at")
    lists = posts.withColumn("n", F.row_number().over(Window.partitionBy("spot").orderBy(*newest_first()))).filter(F.col("n") <= newest + 1)
    lists = _kept(lists.groupBy("spot").agg(F.collect_list(F.struct(F.col("published_at").alias("at"), F.col("id").alias("other_id"))).alias("near")))
    sets = rows.groupBy("asking").agg(F.count(F.lit(1)).alias("n"))
    union = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("near"))), asc=False), 1, newest + 1)
    near = sets.select("asking", "n", F.explode("asking").alias("spot")).join(lists, "spot").groupBy("asking").agg(F.first("n").alias("n"), union.alias("near"))
    listed = lists.select(F.explode("near.other_id").alias("other_id")).distinct()
    told = rows.select(F.col("id").alias("other_id"), "tab", "sectors", "tags").join(listed, "other_id")
    candidate = F.struct("at", "other_id", "tab", "sectors", "tags")
    met = near.select("asking", "n", F.inline("near")).join(told, "other_id").groupBy("asking").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(candidate), asc=False).alias("candidates"))
    met = _kept(met.join(rows.agg(F.count(F.lit(1)).alias("all_rows")), F.lit(True)).select("asking", "candidates", (F.col("n") * FREQUENT > F.col("all_rows")).alias("frequent")))
    frequent, rest = (met.filter(c).drop("frequent") for c in ("frequent", "not frequent"))
    asked = rows.select("id", "tab", "sectors", "tags", "asking")
    pairs = asked.join(F.broadcast(frequent), "asking").unionByName(asked.join(F.broadcast(frequent.select("asking")), "asking", "left_anti").join(rest, "asking"))
    others = F.slice(F.filter("candidates", lambda c: c["other_id"] != F.col("id")), 1, newest)
    scored = F.transform(others, lambda c: F.struct(_scored(weights, F.col("tags"), F.col("sectors"), F.col("tab"), c.getField).alias("weight"), c["at"].alias("at"), c["other_id"].alias("other_id")))
    best = F.slice(F.sort_array(F.filter(scored, lambda c: c["weight"] > 0), asc=False), 1, k)
    # An outer generator: for an inner one the optimizer would score all candidates once more, to see whether any is left.
    found = pairs.select("id", F.posexplode_outer(best).alias("pos", "c")).filter("c is not null")
    return found.select("id", "c.other_id", "c.weight", (F.col("pos") + 1).alias("rank"))


def similar_to(rows: DataFrame, now: Column, tab: str | None, sectors: list[str], tags: list[str], own: int, k: int = 5, newest: int = 50, days: int = 60, weights: tuple[int, int, int] = (2, 3, 1)) -> DataFrame:
    """Recommendations for one item: as ``similar``; an item without tab and sectors meets the newest of all."""
    text = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    near = rows.filter((F.col("id") != own) & (F.col("published_at") >= now - F.expr(f"interval {days} days")))
    parts = [*([F.col("tab") == tab] if tab else []), *([F.arrays_overlap("sectors", text(sectors))] if sectors else [])]
    if parts:
        near = near.filter(reduce(lambda a, b: a | b, parts))
    near = near.orderBy(*newest_first()).limit(newest).withColumn("weight", _scored(weights, text(tags), text(sectors), F.lit(tab)))
    return near.filter("weight > 0").orderBy(F.desc("weight"), *newest_first()).limit(k)


def spellings(key: Column) -> Column:
    """A key as it came and, where it differs, percent-decoded."""
    return F.array_distinct(F.filter(F.array(key, F.try_url_decode(F.replace(key, F.lit("+"), F.lit("%2B")))), lambda k: k.isNotNull()))


def by_keys(rows: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """(asked, row) for every spelling of the asked keys."""
    return asked.withColumn("__key", F.explode(spellings(F.col("asked")))).join(rows, F.col("__key") == F.col(key)).drop("__key")


def resolve_keys(asked: DataFrame, current: DataFrame, history: DataFrame, least_base: int = 8) -> DataFrame:
    """(asked, key, how): where a key of old leads, never to itself.

    In order: the history, by the key as it came or decoded; the newest key that is its base, or the base
    plus six signs; the same for its ASCII form. A way whose newest key is the asked one leads nowhere.
    """
    from ..functions.text import to_ascii

    raw = F.col("asked")
    kept = history.join(current, "item").select("old_key", "key", "at")
    by_history = by_keys(kept, "old_key", asked).select("asked", "key", "at", F.lit(1).alias("order"))
    stem = F.when(F.col("key").rlike("(?s)^.+-.{6}$"), F.regexp_extract("key", "(?s)^(.+)-.{6}$", 1))
    based = current.select("key", "at", F.explode(F.filter(F.array(F.col("key"), stem), lambda s: s.isNotNull())).alias("base"))
    plain = F.regexp_replace(F.lower(to_ascii(F.element_at(spellings(raw), -1), turkish=False)), "[^a-z0-9-]", "")
    bases = F.transform(F.array(raw, plain), lambda s: F.regexp_replace(s, "-[0-9a-f]{6}$", ""))
    tries = asked.select("asked", F.posexplode(F.array_distinct(bases)).alias("i", "base")).filter(F.length("base") >= least_base)
    by_base = tries.join(based, "base").select("asked", "key", "at", (F.col("i") + 2).alias("order"))
    found = by_history.unionByName(by_base).groupBy("asked", "order").agg(F.max_by("key", F.struct("at", "key")).alias("key")).filter("asked <> key")
    best = found.groupBy("asked").agg(F.min_by(F.struct("key", "order"), "order").alias("x"))
    how = F.when(F.col("x.order") == 1, "history").when(F.col("x.order") == 2, "base").when(F.col("x.order") == 3, "folded").otherwise("none")
    return asked.join(best, "asked", "left").select("asked", F.col("x.key").alias("key"), how.alias("how"))


def category_label(tab: Column, tags: Column, generic: list[str], geographic: str) -> Column:
    """The tab's own label; generic tabs show the first tag that does not match ``geographic``, else their own label."""
    topic = F.get(F.filter(tags, lambda t: ~t.rlike(geographic)), F.lit(0))
    return F.when(tab.isin(generic), F.coalesce(topic, tab)).otherwise(tab)


def sector_label(tab: Column, sectors: Column, tags: Column, generic: list[str], default_tab: str, geographic: str, generic_sectors: list[str]) -> Column:
    """As ``category_label`` with sectors: a generic tab, or none, shows the first sector that is not generic, then (in ``default_tab``) its own label, then the first topic tag."""
    sector = F.get(F.filter(sectors, lambda s: ~s.isin(generic_sectors)), F.lit(0))
    topic = F.get(F.filter(tags, lambda t: ~t.rlike(geographic)), F.lit(0))
    return F.when(tab.isNull() | tab.isin(generic), F.coalesce(sector, F.when(tab == default_tab, tab), topic, tab)).otherwise(tab)
