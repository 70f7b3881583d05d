"""Walks over a mirror of pages: listings page by page until a rule stops, indexes of site maps to their children.

The mirror is a table (url, content), so it may lie wherever Spark reads. Pages are parsed by the registry's
rules in one pass over the mirror; what is walked afterwards is the small table of listing pages with their
items, one step for all sources at once. The number of steps has the bound ``most_pages``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import parse_date
from ..sources import rules
from ..sources.html import absolute
from ..storage import settle

MOST_PAGES = 20


def listing_pages(mirror: DataFrame, sites: DataFrame, registry: DataFrame) -> DataFrame:
    """(source, url, following, items) of the mirror's pages (source, url, html): items are (position, link) that the registry accepts, each once; ``sites`` (source, parameter) tells whose pages are numbered by a parameter instead of linked."""
    found = settle(rules.read(mirror.select("source", "url", "html"), registry))
    rows = rules.listing(found, registry, keys=("source", "url")).groupBy("source", "url").agg(F.array_sort(F.collect_list(F.struct(F.col("row").alias("position"), "link"))).alias("items"))
    heads = found.filter("row = 0").select("source", "url", absolute(F.col("url"), F.col("values")["next"]).alias("following"))
    return heads.join(rows, ["source", "url"], "left").select("source", "url", "following", F.coalesce("items", F.array().cast("array<struct<position: int, link: string>>")).alias("items")).join(F.broadcast(sites.select("source", "parameter")), "source", "left")


def scan(pages: DataFrame, starts: DataFrame, least: int = 1, most_pages: int = MOST_PAGES, known: DataFrame | None = None) -> DataFrame:
    """(source, page, position, link): the new items of each source, from its first page (``starts``: source, url) on.

    A page is followed by the next one only if it gave at least ``least`` items that neither ``known`` (source,
    link) nor an earlier page of the walk holds; the page that stops the walk still counts. An item belongs to
    the page where it stood first. What is sent to all tasks has a row a source and page read. A page that the mirror does not hold, or that was read before, ends the walk.
    """
    frontier = settle(starts.select("source", F.col("url").alias("base"), "url", F.lit(1).alias("page")))
    seen = settle(known.select("source", "link").distinct()) if known is not None else None
    read, out = [], []
    for number in range(1, most_pages + 1):
        at = settle(frontier.join(pages, ["source", "url"]))
        items = at.select("source", "page", F.explode("items").alias("i")).select("source", "page", "i.position", "i.link")
        new = items if seen is None else items.join(seen, ["source", "link"], "left_anti").select(*items.columns)
        new = settle(new)
        out.append(new)
        read.append(frontier.select("source", "url"))
        enough = new.groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("source")
        by_number = F.concat("base", "parameter", F.lit(str(number + 1)))
        after = at.join(F.broadcast(enough), "source").select("source", "base", F.when(F.col("parameter").isNotNull(), by_number).otherwise(F.col("following")).alias("url"), F.lit(number + 1).alias("page")).filter("url is not null")
        for done in read:
            after = after.join(F.broadcast(done), ["source", "url"], "left_anti").select("source", "base", "url", "page")
        frontier = settle(after)
        if frontier.isEmpty():
            break
        seen = settle(new.select("source", "link") if seen is None else seen.unionByName(new.select("source", "link")))
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    return every.select("source", "page", "position", "link")


_LOC = r"(?s)<(?:\w+:)?{0}>(.*?)</(?:\w+:)?{0}>"


def index_children(mirror: DataFrame, most: int) -> DataFrame:
    """(source, index, url, turn): of each index of site maps in the mirror (source, url, html) the ``most`` newest children, newest first (then the later ones)."""
    entries = mirror.select("source", F.col("url").alias("index"), F.posexplode(F.regexp_extract_all("html", F.lit(_LOC.format("sitemap")), F.lit(1))).alias("at", "entry"))
    loc = F.trim(F.regexp_extract("entry", r"(?s)<loc>(.*?)</loc>", 1))
    when = parse_date(F.nullif(F.trim(F.regexp_extract("entry", r"(?s)<lastmod>(.*?)</lastmod>", 1)), F.lit("")))
    order = Window.partitionBy("source", "index").orderBy(F.col("when").desc_nulls_last(), F.desc("at"))
    return entries.select("source", "index", "at", loc.alias("url"), when.alias("when")).withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= most).select("source", "index", "url", "turn")


def hop(mirror: DataFrame, starts: DataFrame, most: int, cutoff=None) -> DataFrame:
    """(source, link, published_at): the entries of the newest children of each index in ``starts`` (source, url), each link once and by its newest date; with ``cutoff`` only dated entries from then on."""
    indexes = mirror.join(F.broadcast(starts.select("source", "url")), ["source", "url"])
    children = index_children(indexes, most).select("source", "url").distinct()
    pages = mirror.join(children, ["source", "url"])
    entries = pages.select("source", F.explode(F.regexp_extract_all("html", F.lit(_LOC.format("url")), F.lit(1))).alias("entry"))
    text = lambda tag: F.nullif(F.trim(F.regexp_extract("entry", rf"(?s)<(?:\w+:)?{tag}>(.*?)</(?:\w+:)?{tag}>", 1)), F.lit(""))
    rows = entries.select("source", text("loc").alias("link"), F.coalesce(parse_date(text("publication_date")), parse_date(text("lastmod"))).alias("published_at")).filter("link is not null")
    rows = rows.groupBy("source", "link").agg(F.max("published_at").alias("published_at"))
    return rows if cutoff is None else rows.filter(F.col("published_at") >= cutoff)
