"""Feeds, site maps, JSON interfaces, vocabularies, logs, listings and feed writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import escape_xml
from ..functions.values import parse_date, rfc822

ITEM = "title string, link struct<_VALUE: string, _href: string>, guid string, pubDate string, date string, published string, updated string, description string"


def read_feed(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """Entries of RSS ('item') or Atom ('entry') files, both kinds where no tag is given, with link, published_at; one per link. An undated entry is kept."""
    read = lambda tag: spark.read.format("xml").option("rowTag", tag).schema(ITEM).load(path)
    return feed_entries(read(row_tag) if row_tag else read("item").unionByName(read("entry")))


def feed_entries(raw: DataFrame) -> DataFrame:
    """The link is the element's text, else its address, else the guid."""
    own = [F.nullif(F.trim(c), F.lit("")) for c in (F.col("link._VALUE"), F.col("link._href"))]
    link = F.coalesce(*own, F.trim("guid"))
    when = F.coalesce(*(parse_date(c) for c in ("pubDate", "date", "published", "updated")))
    return raw.select(link.alias("link"), F.trim("title").alias("title"), "description", when.alias("published_at")).filter(F.col("link").startswith("http")).dropDuplicates(["link"])


def recent_entries(entries: DataFrame, cutoff: Column, keep_undated: bool = True) -> DataFrame:
    """A feed keeps undated entries, a site map drops them."""
    fresh = F.col("published_at") >= cutoff
    return entries.filter(fresh | F.col("published_at").isNull() if keep_undated else fresh)


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(loc, published_at) of url entries; compressed files are read as they are."""
    raw = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string, publication_date string, `news:news` struct<`news:publication_date`: string>").load(path)
    raw = raw.withColumn("news_date", F.col("`news:news`.`news:publication_date`"))
    return raw.select(F.trim("loc").alias("loc"), F.coalesce(parse_date("news_date"), parse_date("publication_date"), parse_date("lastmod")).alias("published_at"))


def last_children(index: DataFrame, k: int, position: str = "position") -> DataFrame:
    """The last k children of a site-map index, latest first."""
    return index.orderBy(F.desc(position)).limit(k)


def read_notices(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """Procurement notices of a JSON interface, an object of notices by id or a list of them: one per id, open ones only."""
    notice = "struct<id: string, noticetitle: string, bid_description: string, deadline: string, country: string>"
    raw = spark.read.schema("procnotices string").option("multiLine", True).json(path)
    listed = F.ltrim("procnotices").startswith("[")
    every = F.when(listed, F.from_json("procnotices", f"array<{notice}>")).otherwise(F.map_values(F.from_json("procnotices", f"map<string, {notice}>")))
    rows = raw.select(F.explode(every).alias("n")).select("n.*").dropDuplicates(["id"])
    rows = rows.withColumn("deadline_at", parse_date("deadline")).filter(F.col("deadline_at") > now)
    return rows.select("id", F.coalesce(F.nullif("noticetitle", F.lit("")), "bid_description").alias("title"), "country", "deadline_at")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(term, place) of a Markdown word list: blank and heading lines go, terms part at commas, remarks in brackets go; first place of each."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    lines = lines.filter(~F.trim("value").rlike("^#") & (F.trim("value") != ""))
    terms = lines.select("line", F.posexplode(F.split("value", ",")).alias("at", "term"))
    clean = F.trim(F.regexp_replace(F.regexp_replace("term", r"\([^)]*\)", ""), r"[*]{2}|^\s*[-*]\s+", ""))
    return terms.select(clean.alias("term"), (F.col("line").cast("long") * 100_000 + F.col("at")).alias("place")).filter(F.length("term") > 1).groupBy("term").agg(F.min("place").alias("place"))


def read_logs(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """Per file how often each pattern stands in it."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return files.select("file", *(F.regexp_count("value", F.lit(p)).alias(n) for n, p in patterns.items()))


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of the files under a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))


def read_delimited(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Delimited rows with a header; ':XX:' flags and rows blank in every column go, repeated rows once, by (id, version) where both are there."""
    rows = spark.read.csv(path, sep=sep, header=True)
    rows = rows.select(*(F.trim(F.regexp_replace(F.col(f"`{c}`"), ":[A-Z]{2}:", "")).alias(c) for c in rows.columns))
    filled = F.coalesce(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in rows.columns)).isNotNull()
    return rows.filter(filled).dropDuplicates(["id", "version"] if {"id", "version"} <= set(rows.columns) else None)


def html_table(rows: DataFrame, order: list[Column], most: int = 10_000) -> DataFrame:
    """One row: an HTML table of all rows, for embedded data sets; none under 2 rows, an error over ``most``, since a table is one value."""
    n = rows.limit(most + 1).count()
    if n > most:
        raise ValueError(f"a table holds at most {most} rows")
    cells = F.concat_ws("", *(F.concat(F.lit("<td>"), F.coalesce(escape_xml(F.col(f"`{c}`").cast("string")), F.lit("")), F.lit("</td>")) for c in rows.columns))
    numbered = rows.select(F.row_number().over(Window.orderBy(*order)).alias("n"), F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("tr"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "tr"))), lambda x: x["tr"]), "")
    return numbered.agg(F.count(F.lit(1)).alias("n"), F.concat(F.lit("<table>"), body, F.lit("</table>")).alias("html")).filter("n >= 2").select("html")


def feed_items(rows: DataFrame, base: str) -> DataFrame:
    """(id, item): RSS items; the description falls back to nothing."""
    link = F.concat(F.lit(f"{base}/item/"), F.col("id").cast("string"))
    item = F.concat(F.lit("<item><title>"), escape_xml("title"), F.lit("</title><link>"), link, F.lit("</link><description>"), F.coalesce(escape_xml("description"), F.lit("")), F.lit("</description><pubDate>"), rfc822("published_at"), F.lit("</pubDate></item>"))
    return rows.select("id", item.alias("item"))


def feed_channel(rows: DataFrame, title: str, base: str, most: int = 50) -> DataFrame:
    """One row: an RSS channel of the newest ``most`` rows, which bound it."""
    from ..operators.reads import newest_first

    newest = rows.orderBy(*newest_first()).limit(most)
    items = feed_items(newest, base).join(newest.select("id", F.unix_micros(F.col("published_at").cast("timestamp")).alias("at")), "id")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "id", "item")), asc=False), lambda x: x["item"]), "")
    head = F.concat(F.lit('<rss version="2.0"><channel><title>'), escape_xml(F.lit(title)), F.lit(f"</title><link>{base}</link>"))
    return items.agg(F.concat(head, body, F.lit("</channel></rss>")).alias("xml"))


def news_sitemap(rows: DataFrame, base: str, name: str, language: str, since: Column, most: int = 1000, title_size: int = 110) -> DataFrame:
    """One row: a site map of news, the newest ``most`` of the rows since a moment, which bound it; titles are cut before they are escaped."""
    from ..operators.reads import newest_first

    newest = rows.filter(F.col("published_at") >= since).orderBy(*newest_first()).limit(most)
    head = F.lit(f"<news:publication><news:name>{name}</news:name><news:language>{language}</news:language></news:publication>")
    entry = F.concat(F.lit(f"<url><loc>{base}/item/"), F.col("id").cast("string"), F.lit("</loc><news:news>"), head, F.lit("<news:publication_date>"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit("</news:publication_date><news:title>"), escape_xml(F.substring(F.coalesce("title", F.lit("")), 1, title_size)), F.lit("</news:title></news:news></url>"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("published_at", "id", entry.alias("entry"))), asc=False), lambda x: x["entry"]), "")
    outer = '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:news="http://www.google.com/schemas/sitemap-news/0.9">'
    return newest.agg(F.concat(F.lit(outer), body, F.lit("</urlset>")).alias("xml"))


def write_manifest(objects: DataFrame, path: str) -> None:
    """(path, bytes) of objects as CSV with a header."""
    objects.select("path", "bytes").write.csv(path, header=True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, bytes long").csv(path, header=True)


def read_sitemap_index(spark: SparkSession, path: str) -> DataFrame:
    """(loc, position) of a site-map index; ``last_children`` picks those to follow."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<sitemap>\s*.*?<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("position", "loc"))
    return raw.select("loc", "position")


def structured_data(rows: DataFrame) -> DataFrame:
    """(id, json): nested structured data; null keys are left out, trail positions are renumbered."""
    trail = F.transform(F.filter(F.array("tab", "source"), lambda x: x.isNotNull()), lambda x, i: F.struct((i + 1).alias("position"), x.alias("name")))
    body = F.struct(F.lit("NewsArticle").alias("type"), F.col("title").alias("headline"), F.date_format("published_at", "yyyy-MM-dd").alias("date"), F.nullif(F.array_join("tags", ", "), F.lit("")).alias("keywords"), F.coalesce("author", "source").alias("author"), trail.alias("trail"))
    return rows.select("id", F.to_json(body).alias("json"))
