"""Catalogue: walks over a mirror, versions of a table, backfills with a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, crawl, gates, ledger
from ..operators.snapshots import Snapshot
from ..sources import rules
from ..storage import table_path
from ..tables import table
from .traffic import ORACLE as TRAFFIC

SITES = 7


def _site(n: int = SITES) -> F.Column:
    return F.concat(F.lit("s"), F.pmod("page_id", F.lit(n)).cast("string"))


def crawl_listing(spark: SparkSession, d: str) -> DataFrame:
    """Listings of several sites, each page of the table one page of its site: linked pages, numbered pages, a link back to a page that was read."""
    number = F.floor(F.col("page_id") / SITES).cast("int") + 1
    base = F.concat(F.lit("https://"), F.col("source"), F.lit(".example/list"))
    at = lambda n: F.when(n == 1, base).otherwise(F.concat(base, F.lit("?page="), n.cast("string")))
    following = F.when((F.col("source") == "s2") & (number == 4), base).otherwise(at(number + 1))
    linked = F.when(F.pmod("page_id", F.lit(SITES)) % 2 == 0, F.concat(F.col("html"), F.lit('<a class="next" href="'), following, F.lit('">on</a>'))).otherwise(F.col("html"))
    mirror = table(spark, d, "pages").withColumn("source", _site()).select("source", at(number).alias("url"), linked.alias("html"))
    sites = spark.createDataFrame([(f"s{k}", "?page=" if k % 2 else None, f"https://s{k}.example/list") for k in range(SITES)], "source string, parameter string, url string")
    own = [r for k in range(SITES) for r in ((f"s{k}", "row", None, 0, "nav li", None), (f"s{k}", "field", "href", 0, "a", "@href"), (f"s{k}", "next", None, 0, "a.next", None))]
    pages = crawl.listing_pages(mirror, sites, spark.createDataFrame(own, rules.RULES_DDL))
    known = pages.select("source", F.explode("items.link").alias("link")).filter("link like '%.example/t%'")
    return crawl.scan(pages, sites.select("source", "url"), least=2, most_pages=6, known=known)


def crawl_hop(spark: SparkSession, d: str) -> DataFrame:
    """Indexes of site maps with the pages as children: the three newest of each are followed."""
    pages = table(spark, d, "pages").withColumn("source", _site(5))
    child = F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), F.col("page_id").cast("string"), F.lit(".xml"))
    dated = F.when(F.col("page_id") % 11 == 0, "").otherwise(F.concat(F.lit("<lastmod>2024-01-"), F.lpad((F.col("page_id") * 7 % 28 + 1).cast("string"), 2, "0"), F.lit("</lastmod>")))
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)">'), F.lit(1)))
    urls = F.transform(links, lambda x, i: F.concat(F.lit("<url><loc> https://"), F.col("source"), F.lit(".example"), x, F.lit(" </loc>"), F.when(i % 3 == 2, "").otherwise(F.concat(F.lit("<news:publication_date>2024-02-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit("</news:publication_date>"))), F.lit("</url>")))
    maps = pages.select("source", child.alias("url"), F.concat(F.lit("<urlset>"), F.array_join(urls, ""), F.lit("</urlset>")).alias("html"))
    entry = F.concat(F.lit("<sitemap><loc>"), child, F.lit("</loc>"), dated, F.lit("</sitemap>"))
    listed = pages.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("e")))), lambda x: x["e"]), "").alias("body"))
    indexes = listed.select("source", F.concat(F.lit("https://"), F.col("source"), F.lit(".example/index.xml")).alias("url"), F.concat(F.lit("<sitemapindex>"), F.col("body"), F.lit("</sitemapindex>")).alias("html"))
    mirror = maps.unionByName(indexes)
    starts = indexes.select("source", "url")
    return crawl.hop(mirror, starts, 3).select("source", "link", F.date_format("published_at", "yyyy-MM-dd").alias("day"))


def snapshot_upsert(spark: SparkSession, d: str) -> DataFrame:
    """``upsert_restricted`` as the second and third version of a table in buckets."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderpriority").alias("slug"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"))
    current = rows.filter("o_orderkey % 5 <> 0")
    batch = rows.filter("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_totalprice", F.lit("new").alias("slug"))
    kept = Snapshot.create(current, table_path(spark, "snapshot"), ["o_orderkey"], 16)
    rule = lambda now, new: changes.upsert(now, new, "o_orderkey", ["slug"], F.lit("2024-01-31"))
    for part in (batch.filter("o_orderkey % 4 = 1"), batch.filter("o_orderkey % 4 <> 1")):
        kept.merge(part, current.schema, rule)
    return kept.read(current.schema)


def _reruns(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    new = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.concat(F.lit("<h2>Q</h2> "), F.col("text"))).when(k % 5 == 2, F.concat(F.lit("<h2>Q</h2> "), F.substring("text", 1, 200), F.lit("."))).when(k % 5 == 3, F.col("text")).otherwise(F.concat(F.lit("<h2>Q</h2> "), F.col("text"), F.lit(" and")))
    source = F.when(k % 11 == 0, F.concat(F.col("text"), F.lit(" [...] more."))).when(k % 2 == 0, F.concat(F.col("text"), F.lit("."))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 600).alias("current"), source.alias("source"), new.alias("new"))


def rerun_truncated(spark: SparkSession, d: str) -> DataFrame:
    outcome = ledger.rerun_outcome("current", "source", "new", gates.finalise("new", F.lit(False)))
    return _reruns(spark, d).select("doc_id", outcome.alias("outcome"), F.length(ledger.rerun("current", outcome, "new")).alias("length"))


def ledger_runs(spark: SparkSession, d: str) -> DataFrame:
    """A run that breaks off, one that goes on, one that finds nothing, one after some inputs changed: how many rows each settled, and the statuses."""
    rows, book = _reruns(spark, d), ledger.Ledger(spark, table_path(spark, "ledger"))
    outcome = lambda _: ledger.rerun_outcome("current", "source", "new", gates.finalise("new", F.lit(False)))
    work = lambda part, slices: book.run(part, "doc_id", "rerun", 1, ["current", "source"], outcome, slices)
    settled = [("first", work(rows.filter("doc_id % 3 = 0"), 1)), ("second", work(rows, 3)), ("third", work(rows, 1))]
    statuses = book.histogram("rerun", 1).select("status", F.col("n").cast("long").alias("n"))
    changed = rows.withColumn("current", F.when(F.col("doc_id") % 10 == 0, F.concat("current", F.lit("!"))).otherwise(F.col("current")))
    settled.append(("pending after a change", book.pending(changed, "doc_id", "rerun", 1, ["current", "source"]).count()))
    settled.append(("pending in a new version", book.pending(rows, "doc_id", "rerun", 2, ["current", "source"]).count()))
    return statuses.unionByName(spark.createDataFrame(settled, "status string, n long"))


QUERIES = {f.__name__: f for f in (crawl_listing, crawl_hop, snapshot_upsert, rerun_truncated, ledger_runs)}

_ITEMS = "regexp_extract_all(html, '<li><a href=\"([^\"]*)\">[^<]*</a>', 1)"
_PLAIN = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '<[^>]+>', ' ', 'g'), E' \\t\\n\\r')"
_WORDS = lambda c: f"len(regexp_extract_all({_PLAIN(c)}, '\\S+'))"
_CUT = lambda c: f"({_PLAIN(c)} <> '' AND right(rtrim(regexp_replace(rtrim({c}), '\\n+(?:Source|Kaynak)[^\\n]*$', '')), 1) NOT IN (" + ", ".join("'" + c + "'" for c in gates.ENDINGS) + "))"
_RERUN = rf"""r AS (SELECT doc_id, substr(text, 1, 600) AS current, CASE WHEN doc_id % 11 = 0 THEN text || ' [...] more.' WHEN doc_id % 2 = 0 THEN text || '.' ELSE text END AS source,
        CASE doc_id % 5 WHEN 1 THEN '<h2>Q</h2> ' || text WHEN 2 THEN '<h2>Q</h2> ' || substr(text, 1, 200) || '.' WHEN 3 THEN text WHEN 4 THEN '<h2>Q</h2> ' || text || ' and' END AS new FROM documents),
    o AS (SELECT *, CASE WHEN NOT coalesce({_CUT('current')}, false) THEN 'skip:not-truncated' WHEN contains(source, '[...]') OR contains(source, '[…]') OR {_CUT('source')} THEN 'skip:source-truncated'
        WHEN len(regexp_extract_all(source, '\S+')) < 60 THEN 'skip:original-too-thin' WHEN coalesce(new, '') = '' THEN 'fail:no-translation'
        WHEN {_PLAIN('new')} = '' THEN 'fail:quality-empty' WHEN right(rtrim(regexp_replace(new, '<[^>]+>', ' ', 'g')), 1) NOT IN ({", ".join("'" + c + "'" for c in gates.ENDINGS)}) THEN 'fail:quality-truncated' WHEN NOT regexp_matches(new, '(?i)<h2[ >]') THEN 'fail:quality-headings'
        WHEN {_WORDS('new')} < {_WORDS('current')} THEN 'fail:shorter-than-current' ELSE 'ok:' || {_WORDS('current')} || '->' || {_WORDS('new')} || 'w' END AS outcome FROM r)"""
ORACLE = {
    "crawl_listing": f"""WITH RECURSIVE raw AS (SELECT page_id % {SITES} AS site, page_id // {SITES} + 1 AS n, unnest({_ITEMS}) AS x, unnest(range(1, len({_ITEMS}) + 1)) AS pos FROM pages),
        pg AS (SELECT site, n, list({{'pos': pos, 'link': 'https://s' || site || '.example' || x}} ORDER BY pos) AS items FROM (SELECT site, n, x, min(pos) AS pos FROM raw GROUP BY ALL) GROUP BY site, n),
        every AS (SELECT page_id % {SITES} AS site, page_id // {SITES} + 1 AS n FROM pages),
        listed AS (SELECT e.site, e.n, coalesce(list_filter(items, lambda i: NOT regexp_matches(i.link, '[.]example/t')), []) AS items FROM every e LEFT JOIN pg USING (site, n)),
        walk AS (SELECT site, 1::BIGINT AS n, items AS new, list_transform(items, lambda i: i.link) AS seen FROM listed WHERE n = 1
                 UNION ALL SELECT w.site, l.n, list_filter(l.items, lambda i: NOT list_contains(w.seen, i.link)), list_concat(w.seen, list_transform(l.items, lambda i: i.link))
                 FROM walk w JOIN listed l ON l.site = w.site AND l.n = w.n + 1 WHERE len(w.new) >= 2 AND w.n < 6 AND NOT (w.site = 2 AND w.n = 4))
        SELECT 's' || site AS source, n AS page, i.pos AS position, i.link AS link FROM (SELECT site, n, unnest(new) AS i FROM walk)""",
    "crawl_hop": """WITH c AS (SELECT page_id, page_id % 5 AS site, html, CASE WHEN page_id % 11 <> 0 THEN page_id * 7 % 28 + 1 END AS day FROM pages QUALIFY row_number() OVER (PARTITION BY page_id % 5 ORDER BY CASE WHEN page_id % 11 <> 0 THEN page_id * 7 % 28 + 1 END DESC NULLS LAST, page_id DESC) <= 3),
        d AS (SELECT page_id, site, unnest(x) AS x, unnest(range(len(x))) AS i FROM (SELECT page_id, site, (SELECT list(y ORDER BY k) FROM (SELECT y, min(k) AS k FROM (SELECT unnest(t) AS y, unnest(range(len(t))) AS k FROM (SELECT regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS t)) GROUP BY y)) AS x FROM c))
        SELECT 's' || site AS source, 'https://s' || site || '.example' || x AS link, max(CASE WHEN i % 3 <> 2 THEN '2024-02-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') END) AS day FROM d GROUP BY ALL""",
    "snapshot_upsert": TRAFFIC["upsert_restricted"],
    "rerun_truncated": f"WITH {_RERUN} SELECT doc_id, outcome, length(CASE WHEN outcome LIKE 'ok:%' THEN new ELSE current END)::INTEGER AS length FROM o",
    "ledger_runs": f"""WITH {_RERUN} SELECT CASE WHEN outcome LIKE 'ok:%' THEN 'ok' ELSE outcome END AS status, count(*) AS n FROM o GROUP BY 1 UNION ALL SELECT 'first', count(*) FILTER (doc_id % 3 = 0) FROM o UNION ALL SELECT 'second', count(*) FILTER (doc_id % 3 <> 0) FROM o
        UNION ALL SELECT 'third', 0 UNION ALL SELECT 'pending after a change', count(*) FILTER (doc_id % 10 = 0) FROM o UNION ALL SELECT 'pending in a new version', count(*) FROM o""",
}
