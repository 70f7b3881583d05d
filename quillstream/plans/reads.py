"""Catalogue: listings, top-k, neighbours, recommendation, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import md5_mod
from ..operators import metrics, reads, search
from ..storage import settle
from ..tables import ARTICLES_SQL, NOW, PUBLISHED_SQL, articles, sql_md5_mod, sql_stamp, stamp, table

LIST_SQL = f"id, source, title, score, tab, {sql_stamp('published_at')} AS published_at"


def _list(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("id", "source", "title", "score", "tab", stamp("published_at").alias("published_at"), *more)


def _published(spark, d):
    return reads.published(articles(spark, d))


def published_listing_page(spark: SparkSession, d: str) -> DataFrame:
    return _list(reads.page_with_total(_published(spark, d)), "total")


def listing_by_tab_page2(spark: SparkSession, d: str) -> DataFrame:
    return _list(reads.listing(_published(spark, d), tab="tab3", number=2))


def listing_by_tag(spark: SparkSession, d: str) -> DataFrame:
    return _list(reads.listing(_published(spark, d), tag="thanedble", region="everywhere").unionByName(reads.listing(_published(spark, d), tag="aeronreth")))


def listing_catch_all_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _list(reads.page(reads.catch_all(_published(spark, d), "ofonrereer", "tab5")))


def listing_exclude_ids(spark: SparkSession, d: str) -> DataFrame:
    return _list(reads.listing(_published(spark, d), exclude=list(range(0, 400, 3))))




def top_recent_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = _published(spark, d)
    recent = rows.filter(F.col("published_at") >= F.lit(NOW).cast("timestamp_ntz") - F.expr("interval 48 hours"))
    order = [F.col("score").desc_nulls_last(), *reads.newest_first()]
    few = reads.top_with_fallback(recent.filter("tab = 'tab0'"), rows, 5, order, reads.newest_first()).withColumn("block", F.lit("narrow"))
    many = reads.top_with_fallback(recent, rows, 5, order, reads.newest_first()).withColumn("block", F.lit("wide"))
    return _list(few.unionByName(many), "fallback", "block")


def _views(spark, d):
    seen = table(spark, d, "events").filter("event_type = 'view'")
    return seen.groupBy(F.pmod(F.col("event_id") * 31, F.lit(1000)).alias("id")).agg(F.count(F.lit(1)).alias("views"))


def top_viewed_window(spark: SparkSession, d: str) -> DataFrame:
    rows = _published(spark, d).join(_views(spark, d), "id", "left").withColumn("views", F.coalesce("views", F.lit(0)).cast("long"))
    recent = rows.filter(F.col("published_at") >= F.lit(NOW).cast("timestamp_ntz") - F.expr("interval 14 days"))
    order = [F.col("views").desc_nulls_last(), *reads.newest_first()]
    return _list(reads.top_with_fallback(recent, rows, 5, order, order), "views", "fallback")


def next_item(spark: SparkSession, d: str) -> DataFrame:
    gone = articles(spark, d).filter("id % 17 = 0").select("id")
    return reads.next_in_order(_published(spark, d), gone)


def latest_per_group(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    order = [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc()]
    return reads.latest_per_group(rows, "o_custkey", order, 3, 400).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


def _with_sectors(rows: DataFrame) -> DataFrame:
    key = F.col("id").cast("string")
    return rows.withColumn("sectors", F.array(*(F.concat(F.lit("sector"), md5_mod(F.concat(F.lit(salt), key), n).cast("string")) for salt, n in (("a", 9), ("b", 23)))))


def similar_items(spark: SparkSession, d: str) -> DataFrame:
    out = reads.similar(_with_sectors(_published(spark, d)), F.lit(NOW).cast("timestamp_ntz"), days=20)
    return out.select("id", "other_id", F.col("weight").cast("long").alias("weight"), F.col("rank").cast("long").alias("rank"))


def similar_bare(spark: SparkSession, d: str) -> DataFrame:
    """Recommendations where some items have no tab, some no sectors, some neither, and most share a tag by their ids."""
    rows = _with_sectors(_published(spark, d)).withColumns({"tab": F.when(F.col("id") % 2 == 0, F.col("tab")), "sectors": F.when(F.col("id") % 3 == 0, F.col("sectors")).when(F.col("id") % 3 == 1, F.array().cast("array<string>")), "tags": F.array(F.concat(F.lit("t"), (F.col("id") % 6).cast("string")), F.concat(F.lit("u"), (F.col("id") % 5).cast("string")))})
    out = reads.similar(rows, F.lit(NOW).cast("timestamp_ntz"), days=20)
    return out.select("id", "other_id", F.col("weight").cast("long").alias("weight"), F.col("rank").cast("long").alias("rank"))


def similar_to_one(spark: SparkSession, d: str) -> DataFrame:
    tags = ["andanandre", "anandanti", "ananeaing", "anandthat"]
    out = reads.similar_to(_with_sectors(_published(spark, d)), F.lit(NOW).cast("timestamp_ntz"), "tab2", ["sector1", "sector20"], tags, 40, days=20)
    return _list(out, "weight").withColumn("weight", F.col("weight").cast("long"))


def tag_counts_min3(spark: SparkSession, d: str) -> DataFrame:
    return metrics.tag_counts(_published(spark, d))


def sitemap_union(spark: SparkSession, d: str) -> DataFrame:
    one = lambda rows, prefix, name, block: rows.select(F.concat(F.lit(prefix), name).alias("url"), F.lit(block).alias("block"))
    low = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("-"))
    shown = settle(_published(spark, d).select("id", "tags"))
    blocks = [
        spark.createDataFrame([("/", 0), ("/about", 0)], "url string, block int"),
        one(shown, "/item/", F.col("id").cast("string"), 1),
        one(table(spark, d, "region"), "/region/", low("r_name"), 2),
        one(table(spark, d, "nation"), "/sector/", low("n_name"), 3),
        one(table(spark, d, "supplier"), "/author/", F.col("s_suppkey").cast("string"), 4),
        one(metrics.tag_counts(shown), "/tag/", F.col("tag"), 5),
        one(table(spark, d, "conversations").select("conv_id").distinct(), "/blog/", F.col("conv_id").cast("string"), 6),
    ]
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out


def suggest_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = [
        ("region", table(spark, d, "region"), "r_name", [F.col("r_name")], 2),
        ("nation", table(spark, d, "nation"), "n_name", [F.col("n_name")], 3),
        ("part", table(spark, d, "part").select("p_name").distinct(), "p_name", [F.col("p_name")], 4),
    ]
    return search.suggest(blocks, "an")


SYNONYMS = [["the", "that"], ["with", "from", "this one"], ["nation", "tion"]]


def search_boolean(spark: SparkSession, d: str) -> DataFrame:
    groups = search.expand("with ER nation", search.synonym_table(SYNONYMS))
    return _published(spark, d).filter(search.matches(search.tokens("title", "body"), groups)).select("id")


def search_ranked(spark: SparkSession, d: str) -> DataFrame:
    groups = search.expand("with er", search.synonym_table(SYNONYMS))
    rows = _published(spark, d).filter(search.matches(search.tokens("title", "body"), groups))
    score = search.rank(groups, [("title", 1.0), ("body", 0.5)])
    return rows.withColumn("rank", score).orderBy(F.desc("rank"), *reads.newest_first()).limit(12).select("id", "rank")


def search_fuzzy_title(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").withColumn("similarity", F.round(search.word_similarity("smal", "p_name"), 6))
    return rows.filter("similarity > 0.3").select("p_partkey", "similarity")


def tag_search(spark: SparkSession, d: str) -> DataFrame:
    return search.search_tags(_published(spark, d), "ation", 10)


_GROUPS = search.expand("with ER nation", search.synonym_table(SYNONYMS))
_GROUPS2 = search.expand("with er", search.synonym_table(SYNONYMS))
_TOK = "list_distinct(list_filter(string_split_regex(lower(translate({}, 'İI', 'iı')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''))"


def _any(groups: list[list[str]], tokens: str) -> str:
    return " AND ".join(f"list_has_any({tokens}, {g!r})" for g in groups)


def _rank_sql(groups: list[list[str]], fields: list[tuple[str, float]]) -> str:
    terms = sorted({t for g in groups for t in g})
    return " + ".join(f"{w} * len(list_intersect({_TOK.format(f)}, {terms!r}))" for f, w in fields)


_TRI = "list_distinct(list_transform(range(1, (length({0}) + 2)::BIGINT), lambda i: substr('  ' || lower({0}) || ' ', i, 3)))"
_PART_TITLE = "list_filter(string_split_regex(lower(p_name), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"



def extent_sql(raw: str, title: str) -> str:
    """The best likeness of a query's trigrams to any run of a title's, by trying all runs."""
    own = search.query_trigrams(raw)
    words = f"list_filter(string_split_regex(lower(translate({title}, 'İI', 'iı')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    tris = f"flatten(list_transform({words}, lambda w: list_transform(range(1, (length(w) + 2)::BIGINT), lambda i: substr('  ' || w || ' ', i, 3))))"
    likeness = f"len(list_intersect(list_distinct(t[i:j]), {own!r}))::DOUBLE / ({len(own)} + len(list_distinct(t[i:j])) - len(list_intersect(list_distinct(t[i:j]), {own!r})))"
    runs = f"list_max(list_transform(range(1, len(t) + 1), lambda i: list_max(list_transform(range(i, len(t) + 1), lambda j: {likeness}))))"
    return f"coalesce(list_transform([{tris}], lambda t: {runs})[1], 0.0)"


QUERIES = {f.__name__: f for f in (published_listing_page, listing_by_tab_page2, listing_by_tag, listing_catch_all_bucket, listing_exclude_ids, top_recent_with_fallback, top_viewed_window, next_item, latest_per_group, similar_items, similar_bare, similar_to_one, tag_counts_min3, sitemap_union, suggest_blocks, search_boolean, search_ranked, search_fuzzy_title, tag_search)}

_WITH = f"WITH {ARTICLES_SQL}, p AS (SELECT * FROM articles WHERE {PUBLISHED_SQL})"
_NEWEST = "published_at DESC NULLS LAST, id DESC"
_TOP = """({p} SELECT *, false AS fallback FROM (SELECT * FROM {w} ORDER BY {o} LIMIT 5) WHERE (SELECT count(*) FROM {w}) >= 5
           UNION ALL SELECT *, true FROM (SELECT * FROM {e} ORDER BY {fo} LIMIT 5) WHERE (SELECT count(*) FROM {w}) < 5)"""

_SECTORS = f"{_WITH}, s AS (SELECT *, ['sector' || ({sql_md5_mod("'a' || id::VARCHAR", 9)}), 'sector' || ({sql_md5_mod("'b' || id::VARCHAR", 23)})] AS sectors FROM p)"

ORACLE = {
    "published_listing_page": f"{_WITH} SELECT {LIST_SQL}, (SELECT count(*) FROM p) AS total FROM p ORDER BY {_NEWEST.replace('published_at', 'p.published_at')} LIMIT 12",
    "listing_by_tab_page2": f"{_WITH} SELECT {LIST_SQL} FROM p WHERE tab = 'tab3' ORDER BY {_NEWEST.replace('published_at', 'p.published_at')} LIMIT 12 OFFSET 12",
    "listing_by_tag": f"{_WITH} SELECT {LIST_SQL} FROM (SELECT * FROM (SELECT * FROM p WHERE list_contains(tags, 'thanedble') ORDER BY {_NEWEST} LIMIT 12) UNION ALL SELECT * FROM (SELECT * FROM p WHERE list_contains(tags, 'aeronreth') ORDER BY {_NEWEST} LIMIT 12))",
    "listing_catch_all_bucket": f"{_WITH} SELECT {LIST_SQL} FROM (SELECT * FROM p WHERE list_contains(tags, 'ofonrereer') OR (tab = 'tab5' AND len(tags) = 0) ORDER BY {_NEWEST} LIMIT 12)",
    "listing_exclude_ids": f"{_WITH} SELECT {LIST_SQL} FROM (SELECT * FROM p WHERE NOT (id < 400 AND id % 3 = 0) ORDER BY {_NEWEST} LIMIT 12)",
    "top_recent_with_fallback": f"""{_WITH}, r AS (SELECT * FROM p WHERE published_at >= TIMESTAMP '{NOW}' - INTERVAL 48 HOUR), n AS (SELECT * FROM r WHERE tab = 'tab0'),
        x AS {_TOP.format(p='', w='n', e='p', o='score DESC NULLS LAST, ' + _NEWEST, fo=_NEWEST)}, y AS {_TOP.format(p='', w='r', e='p', o='score DESC NULLS LAST, ' + _NEWEST, fo=_NEWEST)}
        SELECT {LIST_SQL}, fallback, 'narrow' AS block FROM x UNION ALL SELECT {LIST_SQL}, fallback, 'wide' FROM y""",
    "top_viewed_window": f"""{_WITH}, v AS (SELECT (event_id * 31) % 1000 AS id, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY 1),
        e AS (SELECT p.*, coalesce(views, 0) AS views FROM p LEFT JOIN v USING (id)), r AS (SELECT * FROM e WHERE published_at >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY),
        x AS {_TOP.format(p='', w='r', e='e', o='views DESC NULLS LAST, ' + _NEWEST, fo='views DESC NULLS LAST, ' + _NEWEST)}
        SELECT {LIST_SQL}, views, fallback FROM x""",
    "next_item": f"{_WITH} SELECT id, lead(id) OVER (ORDER BY {_NEWEST}) AS next_id FROM p WHERE id % 17 <> 0",
    "latest_per_group": "WITH n AS (SELECT * FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 400) SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS rank FROM n QUALIFY rank <= 3",
    "similar_items": f"""{_SECTORS}, c AS (SELECT a.id, b.id AS other_id, b.published_at, a.tags AS own_tags, a.sectors AS own_sectors, a.tab AS own_tab, b.tags, b.sectors, b.tab
            FROM s a JOIN s b ON a.id <> b.id AND (a.tab = b.tab OR list_has_any(a.sectors, b.sectors)) AND b.published_at >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY
            QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.published_at DESC, b.id DESC) <= 50),
        w AS (SELECT *, (2 * len(list_filter(tags, lambda t: list_contains(own_tags, t))) + 3 * len(list_filter(sectors, lambda t: list_contains(own_sectors, t))) + (tab = own_tab)::INTEGER)::BIGINT AS weight FROM c)
        SELECT id, other_id, weight, row_number() OVER (PARTITION BY id ORDER BY weight DESC, published_at DESC, other_id DESC) AS rank FROM w WHERE weight > 0 QUALIFY rank <= 5""",
    "similar_bare": f"""{_SECTORS}, m AS (SELECT id, published_at, CASE WHEN id % 2 = 0 THEN tab END AS tab, CASE WHEN id % 3 = 0 THEN sectors ELSE [] END AS sectors, ['t' || id % 6, 'u' || id % 5] AS tags FROM s), c AS (SELECT a.id, b.id AS other_id, b.published_at, a.tags AS own_tags, a.sectors AS own_sectors, a.tab AS own_tab, b.tags, b.sectors, b.tab
            FROM m a JOIN m b ON a.id <> b.id AND (a.tab = b.tab OR list_has_any(a.sectors, b.sectors) OR (a.tab IS NULL AND len(a.sectors) = 0)) AND b.published_at >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY
            QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.published_at DESC, b.id DESC) <= 50),
        w AS (SELECT *, (2 * len(list_filter(tags, lambda t: list_contains(own_tags, t))) + 3 * len(list_filter(sectors, lambda t: list_contains(own_sectors, t))) + coalesce((tab = own_tab)::INTEGER, 0))::BIGINT AS weight FROM c)
        SELECT id, other_id, weight, row_number() OVER (PARTITION BY id ORDER BY weight DESC, published_at DESC, other_id DESC) AS rank FROM w WHERE weight > 0 QUALIFY rank <= 5""",
    "similar_to_one": f"""{_SECTORS}, g AS (SELECT ['andanandre', 'anandanti', 'ananeaing', 'anandthat'] AS wanted, ['sector1', 'sector20'] AS own),
        c AS (SELECT s.*, wanted, own FROM s, g WHERE id <> 40 AND published_at >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY AND (tab = 'tab2' OR list_has_any(sectors, own)) ORDER BY {_NEWEST} LIMIT 50),
        w AS (SELECT *, (2 * len(list_filter(tags, lambda t: list_contains(wanted, t))) + 3 * len(list_filter(sectors, lambda t: list_contains(own, t))) + (tab = 'tab2')::INTEGER)::BIGINT AS weight FROM c)
        SELECT {LIST_SQL}, weight FROM (SELECT * FROM w WHERE weight > 0 ORDER BY weight DESC, {_NEWEST} LIMIT 5)""",
    "tag_counts_min3": f"{_WITH} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM p) GROUP BY tag HAVING count(*) >= 3",
    "sitemap_union": f"""{_WITH}, t AS (SELECT unnest(tags) AS tag FROM p)
        SELECT '/' AS url, 0 AS block UNION ALL SELECT '/about', 0 UNION ALL SELECT '/item/' || id, 1 FROM p UNION ALL SELECT '/region/' || replace(lower(r_name), ' ', '-'), 2 FROM region UNION ALL SELECT '/sector/' || replace(lower(n_name), ' ', '-'), 3 FROM nation
        UNION ALL SELECT '/author/' || s_suppkey, 4 FROM supplier UNION ALL SELECT '/tag/' || tag, 5 FROM t GROUP BY tag HAVING count(*) >= 3 UNION ALL SELECT DISTINCT '/blog/' || conv_id, 6 FROM conversations""",
    "suggest_blocks": """SELECT 'region' AS type, r_name AS label, 0 AS block FROM (SELECT r_name FROM region WHERE lower(r_name) LIKE '%an%' ORDER BY r_name LIMIT 2)
        UNION ALL SELECT 'nation', n_name, 1 FROM (SELECT n_name FROM nation WHERE lower(n_name) LIKE '%an%' ORDER BY n_name LIMIT 3)
        UNION ALL SELECT 'part', p_name, 2 FROM (SELECT DISTINCT p_name FROM part WHERE lower(p_name) LIKE '%an%' ORDER BY p_name LIMIT 4)""",
    "search_boolean": f"{_WITH} SELECT id FROM p WHERE {_any(_GROUPS, _TOK.format(chr(39).join(['title || ', ' ', ' || body'])))}",
    "search_ranked": f"{_WITH} SELECT id, ({_rank_sql(_GROUPS2, [('title', 1.0), ('body', 0.5)])})::DOUBLE AS rank FROM p WHERE {_any(_GROUPS2, _TOK.format(chr(39).join(['title || ', ' ', ' || body'])))} ORDER BY rank DESC, published_at DESC, id DESC LIMIT 12",
    "search_fuzzy_title": f"""WITH q AS (SELECT {_TRI.format("'smal'")} AS w), s AS (SELECT p_partkey,
        round(coalesce(list_max(list_transform({_PART_TITLE}, lambda t: len(list_intersect(w, {_TRI.format('t')}))::DOUBLE / len(w))), 0.0), 6) AS similarity FROM part, q)
        SELECT p_partkey, similarity FROM s WHERE similarity > 0.3""",
    "tag_search": f"{_WITH} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM p) WHERE lower(tag) LIKE '%ation%' GROUP BY tag ORDER BY n DESC, tag LIMIT 10",
}
