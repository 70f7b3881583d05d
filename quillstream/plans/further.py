"""Catalogue: lookups, URLs, markup, selectors and upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import pages as P
from ..functions import text as T
from ..functions import urls as U
from ..functions import values as V
from ..operators import changes, gates, reads, search, upkeep
from ..sources import files
from ..storage import table_path
from ..tables import ARTICLES_SQL, NOW, PUBLISHED_SQL, articles, spread, sql_md5_mod, sql_stamp, stamp, table
from .reads import _TOK, LIST_SQL, _any, _list, _with_sectors, extent_sql


def _now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def _published(spark, d):
    return reads.published(articles(spark, d))


def admin_list(spark: SparkSession, d: str) -> DataFrame:
    return _list(upkeep.admin_list(articles(spark, d), "an_ %t", 1, 500))


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.lookup(table(spark, d, "nation"), "n_name", "NATION_7").select("n_nationkey", "n_name").unionByName(upkeep.lookup(table(spark, d, "nation"), "n_name", "none").select("n_nationkey", "n_name"))


def featured_slot(spark: SparkSession, d: str) -> DataFrame:
    rows = _published(spark, d)
    own = upkeep.featured(rows.withColumn("is_featured", V.md5_mod(F.concat(F.lit("f"), F.col("id").cast("string")), 40) == 0))
    none = upkeep.featured(rows.withColumn("is_featured", F.lit(None).cast("boolean")))
    return _list(own.withColumn("slot", F.lit("featured")).unionByName(none.withColumn("slot", F.lit("fallback"))), "slot")


RETIRED = ["sector3", "sector17"]


def stale_categories(spark: SparkSession, d: str) -> DataFrame:
    return _with_sectors(articles(spark, d)).filter(F.arrays_overlap("sectors", F.array(*map(F.lit, RETIRED)))).select("id")


def phrase_filters(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.substring("text", 1, 5), F.when(F.col("doc_id") % 4 == 0, " National CONSULTANT in Nigeria").when(F.col("doc_id") % 4 == 1, " road works, South Africa").when(F.col("doc_id") % 4 == 2, " programme officers").otherwise(""))
    rows = table(spark, d, "documents").withColumn("title", made)
    return rows.select("doc_id", upkeep.holds_any(F.col("title"), upkeep.JOBS).alias("job"), upkeep.holds_any(F.col("title"), upkeep.COUNTRIES).alias("country"), upkeep.holds_any(F.col("text"), ["idiot", "the and", "worthless"]).alias("words"))


def enabled_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    registry = docs.select("source").distinct().withColumn("enabled", F.when(F.md5("source") < "c", F.md5("source") < "8"))
    return docs.join(upkeep.enabled(registry).select("source"), "source").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def label_decoration(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "nation").filter("n_nationkey % 4 <> 1")
    return upkeep.decorate(table(spark, d, "supplier"), "s_nationkey", names, "n_nationkey", "n_name", "label").select("s_suppkey", "label")


def author_fetch(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("author"))
    return table(spark, d, "orders").join(people, "o_custkey", "left").select("o_orderkey", "author")


VOCABULARY = [("rude-land", "disgusting"), ("worth-land", "worthless"), ("than-land", "thanedble")]


def vocabulary_listing(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = spark.createDataFrame(VOCABULARY, "slug string, tag string")
    asked = spark.createDataFrame([("rude-land",), ("than-land",), ("nowhere",)], "asked string")
    return upkeep.by_vocabulary(_published(spark, d), asked, vocabulary).select("asked", "id")


def thin_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = _published(spark, d).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return tags.select("tag", (F.col("n") < 3).alias("thin"))


def recent_runs(spark: SparkSession, d: str) -> DataFrame:
    stats = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run_date"), F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("scraped"))
    return upkeep.recent_runs(stats, [F.desc("run_date"), F.col("source").asc()])


def page_counts(spark: SparkSession, d: str) -> DataFrame:
    return _published(spark, d).groupBy("tab").agg(F.count(F.lit(1)).alias("n")).select("tab", U.page_count(F.col("n")).alias("pages"))


def page_numbers(spark: SparkSession, d: str) -> DataFrame:
    k, key = F.col("p_partkey") % 5, F.col("p_partkey").cast("string")
    rows = table(spark, d, "part").select("p_partkey", F.when(k == 0, key).when(k == 1, F.concat(key, F.lit("x"))).when(k == 2, "1").when(k == 3, F.concat(F.lit("-"), key)).alias("raw"))
    return rows.select("p_partkey", U.page_param("raw").alias("param"), U.page_segment("raw").alias("segment"))


def members_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", (_now() - F.make_interval(hours=F.pmod(F.col("c_custkey") * 37, F.lit(9000)).cast("int"))).alias("created_at")).orderBy(F.desc("created_at"), F.desc("c_custkey")).select("c_custkey", stamp("created_at").alias("created_at"))


def search_count(spark: SparkSession, d: str) -> DataFrame:
    rows = _published(spark, d)
    since = _now() - F.expr("interval 20 days")
    asked = [("With er", {}), ("thanedbl", {}), ("er", {}), ("thanedble", {"tab": "tab3"}), ("the that", {"tab": "tab3", "since": since}), ("x", {})]
    return search.counts(rows, asked, {})


def search_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = _published(spark, d)
    out = None
    for kind, compiled in (("good", "er & (with | from)"), ("broken", "er & (with")):
        own = rows.filter(search.matches(search.tokens("title", "body"), search.groups_of(compiled, "With er!"))).select("id", F.lit(kind).alias("mode"))
        out = own if out is None else out.unionByName(own)
    return out


def search_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = _published(spark, d).withColumns({"excerpt": F.substring("body", 1, 200), "tag_text": F.array_join("tags", " ")})
    groups = [["er", "with"], ["thanedble", "that", "the"]]
    score = search.rank_by_frequency(groups, [("title", 1.0), ("excerpt", 0.4), ("tag_text", 0.4), ("body", 0.2)])
    return rows.filter(search.matches(search.tokens("title", "excerpt", "tag_text", "body"), groups)).select("id", F.round(score, 6).alias("rank"))


def topic_tags(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).select("id", F.exists("tags", lambda t: ~t.rlike("^(?:a|c)") & ~t.rlike("ing$")).alias("topic"))


def sector_label(spark: SparkSession, d: str) -> DataFrame:
    label = reads.sector_label(F.col("tab"), F.col("sectors"), F.col("tags"), ["tab0", "tab4"], "tab4", "^(?:a|c)", ["sector1", "sector2", "sector3"])
    return _with_sectors(articles(spark, d)).select("id", label.alias("label"))


def _visits(spark, d):
    k = F.col("page_id") % 6
    address = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.when(k == 0, "?utm_source=ChatGPT.com&page=3").when(k == 1, "?a=b&utm_source=app.claude.ai").otherwise(""))
    referrer = F.when(k == 2, "https://www.perplexity.ai/search?q=x").when(k == 3, "https://notyou.com/").when(k == 4, "https://you.com:443/")
    return table(spark, d, "pages").select("page_id", address.alias("address"), referrer.alias("referrer"), (F.col("page_id") % 40).alias("session"))


def assistant_referrals(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.once_per_session(_visits(spark, d).withColumn("source", U.assistant(F.col("address"), F.col("referrer"))), "session", "source")


def _addresses(spark, d):
    k, n = F.col("p_partkey") % 8, F.col("p_partkey").cast("string")
    url = (
        F.when(k == 0, F.concat(F.lit("https://x.example/news?page="), n)).when(k == 1, "https://x.example/news/?kind=energy&page=3&zone=east").when(k == 2, "/news?zone=west&kind=other").when(k == 3, F.concat(F.lit("/tag/a/page/"), n, F.lit("?page=2")))
        .when(k == 4, "/?page=1&q=z").when(k == 5, "/gone/").when(k == 6, F.concat(F.lit("/item/"), n, F.lit("?q=a%20b&page=x#top"))).otherwise(F.concat(F.lit("/item/"), n))
    )
    return table(spark, d, "part").select("p_partkey", url.alias("url"))


def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    return _addresses(spark, d).select("p_partkey", U.canonical(F.col("url"), ["q", "kind"]).alias("canonical"))


def redirects(spark: SparkSession, d: str) -> DataFrame:
    to = U.redirect(F.col("url"), "/news", [("kind", ["energy", "mining"], "/kind"), ("zone", ["east", "west"], "/zone")], ["/gone"])
    return _addresses(spark, d).select("p_partkey", to["status"].alias("status"), to["target"].alias("target"))


#: Addresses by p_partkey % 12, with where they lead: filters with and without the page, prefixes, a parameter left over.
_MOVED = [
    ("/news?kind=energy&page=7", 308, "/kind/energy"), ("/lands?land=kenya&page={n}", 308, "/lands/kenya/page/{n}"), ("/lands?page=1&land=mali", 308, "/lands/mali"), ("/lands?land=No_Slug", None, None),
    ("/tag/x?page={n}", 308, "/tag/x/page/{n}"), ("/tag?page={n}", None, None), ("/item/5?page={n}", None, None), ("/news/page/4?q=a&page={n}&kind=b", 308, "/news/page/4?q=a&kind=b"),
    ("/news/page/4?page={n}", 308, "/news/page/4"), ("/news?zone=nowhere&page={n}", 308, "/news/page/{n}"), ("/?page={n}&q=x", 308, "/page/{n}"), ("/gone?page={n}", 410, None),
]


def redirect_rules(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("p_partkey") + 2).cast("string")
    url = F.replace(F.element_at(F.array(*(F.lit("https://x.example" + u) for u, *_ in _MOVED)), (F.col("p_partkey") % 12 + 1).cast("int")), F.lit("{n}"), n)
    to = U.redirect(url, "/news", [("kind", ["energy"], "/kind"), ("zone", ["east"], "/zone"), ("land", None, "/lands", True, "/lands")], ["/gone"], prefixes=["/news", "/lands", "/tag/"])
    return table(spark, d, "part").select("p_partkey", to["status"].alias("status"), to["target"].alias("target"))


def reserved_keys(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "part").select(T.slug("p_name").alias("key"))
    retired = table(spark, d, "part").filter("p_partkey % 9 = 0").select(F.concat(T.slug("p_name"), F.lit("-old")).alias("key"))
    return changes.reserved(live, retired, "key")


def json_ld_node(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey") % 5, F.col("p_partkey").cast("string")
    one = F.concat(F.lit('{"@type": "WebPage", "headline": "page '), n, F.lit('"}'))
    dated = F.concat(F.lit('{"@type": "NewsArticle", "headline": "item '), n, F.lit('", "datePublished": "2024-01-02"}'))
    text = F.when(k == 0, one).when(k == 1, F.concat(F.lit("["), one, F.lit(", "), dated, F.lit("]"))).when(k == 2, F.concat(F.lit('{"@graph": ['), dated, F.lit(", "), one, F.lit("]}"))).when(k == 3, "{broken")
    html = F.concat(F.lit("<html><head>"), F.coalesce(F.concat(F.lit('<script type="application/ld+json">'), text, F.lit("</script>")), F.lit("")), F.lit("</head></html>"))
    node = M.json_ld(html)
    return table(spark, d, "part").select("p_partkey", node["@type"].alias("kind"), node["headline"].alias("headline"), node["datePublished"].alias("published"))


def alt_backfill(spark: SparkSession, d: str) -> DataFrame:
    rows = articles(spark, d).withColumn("image_alt", F.when(F.col("id") % 3 == 0, F.concat(F.lit("picture of "), "source")))
    return rows.select("id", F.coalesce("image_alt", "title").alias("image_alt"))


def backfill_selection(spark: SparkSession, d: str) -> DataFrame:
    rows = _with_sectors(articles(spark, d))
    shown = ~F.col("is_suppressed") & (F.col("score") >= 6) & F.col("title").isNotNull()
    rules = {
        "score": F.col("score").isNull(), "tags": F.size("tags") == 0, "meta": shown & (T.meta_band("body") == "out"), "headings": shown & (F.regexp_count("body", F.lit("(?i)<h2[ >]")) < 2),
        "trim": T.count_blank_separated("body") > 900, "translate": (F.col("score") >= 5) & (F.col("lang") != "en"), "topic": (F.col("tab") == "tab7") & ~F.exists("tags", lambda t: t.rlike("ing$")), "all": F.col("lang") == "de",
    }
    return rows.select("id", F.array_join(upkeep.needs(rules), ",").alias("needs"))


def _orphans(spark, d):
    return table(spark, d, "pages").filter("page_id % 3 <> 0").select(F.concat(F.lit("img/"), F.col("page_id").cast("string")).alias("path"), F.length("html").cast("long").alias("bytes"))


def orphan_summary(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.orphan_summary(_orphans(spark, d), 100)


def orphan_deletable(spark: SparkSession, d: str) -> DataFrame:
    backup = table(spark, d, "pages").filter("page_id % 2 = 0").select(F.concat(F.lit("img/"), F.col("page_id").cast("string")).alias("path"), (F.length("html") + F.when(F.col("page_id") % 8 == 0, 1).otherwise(0)).cast("long").alias("bytes"))
    path = table_path(spark, "manifest")
    files.write_manifest(backup, path)
    return upkeep.deletable(_orphans(spark, d), files.read_manifest(spark, path))


def inline_images(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey").cast("string")
    image = lambda url, h: F.struct(url.alias("url"), h.alias("hash"))
    far, near = F.rpad(F.md5(n), 64, "0"), F.concat(F.lit("f"), F.substring(F.rpad(F.md5(n), 64, "0"), 2, 63))
    made = F.array(image(F.concat(F.lit("https://a/"), n, F.lit(".jpg")), far), image(F.concat(F.lit("https://b/"), n, F.lit("-300x200.jpg")), F.lit(None).cast("string")), image(F.lit("https://c/other.png"), near), image(F.concat(F.lit("https://d/z"), n, F.lit(".png")), F.lit("f" * 64)))
    return spread(table(spark, d, "part").select("p_partkey")).select("p_partkey", F.array_join(F.transform(upkeep.dedupe_images(made), lambda x: x["url"]), " ").alias("images"))


def reprocess(spark: SparkSession, d: str) -> DataFrame:
    stages = [
        ("retranslate", lambda r: r.withColumn("name", F.concat(F.lit("x "), "p_name"))),
        ("rehash", lambda r: r.withColumn("hash", F.md5("name"))),
        ("post", lambda r: r.filter(F.col("hash") > "4")),
    ]
    return upkeep.reprocess(table(spark, d, "part").select("p_partkey", "p_name"), stages).select("p_partkey", "hash", "stage")


def translation_fallback(spark: SparkSession, d: str) -> DataFrame:
    new = F.when(F.col("p_partkey") % 3 == 0, " ").when(F.col("p_partkey") % 3 == 1, F.upper("p_name"))
    return table(spark, d, "part").select("p_partkey", upkeep.or_original(new, F.col("p_name")).alias("name"))


PHOTOS = ["p0", "p1", "p2", "p3", "p4"]


def photo_rotation(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    used = F.transform(F.sequence(F.lit(0), F.pmod("p_partkey", F.lit(6)).cast("int")), lambda i: F.concat(F.lit("p"), i.cast("string")))
    pick = upkeep.first_free(V.rotate(F.array(*map(F.lit, PHOTOS)), V.md5_mod(key, 5)), used)
    return table(spark, d, "part").select("p_partkey", pick.alias("photo"), (V.md5_mod(key, 3) + 1).alias("page"))


def simple_budget(spark: SparkSession, d: str) -> DataFrame:
    k, price = F.col("o_orderkey") % 4, F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    words = F.when(k == 0, F.concat(F.lit("about "), price, F.lit(" Million"))).when(k == 1, F.concat(F.lit("USD "), price)).when(k == 2, "1,234,567 for all").otherwise("open")
    return table(spark, d, "orders").select("o_orderkey", F.round(V.budget_simple(words), 2).alias("amount"))


def text_forms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.substring("text", 1, 30).alias("head"), F.concat("source", F.lit("/img/"), F.col("doc_id").cast("string"), F.lit("_small.jpg")).alias("url"), F.when(F.col("source").isNotNull() & (F.col("doc_id") % 2 == 0), "_small").alias("pattern"))
    made = F.concat(F.lit("a -- b --- c – d "), "doc_id")
    return rows.select("doc_id", T.dashes_to_commas_strict(made).alias("strict"), T.strip_caption_credit(F.concat(F.lit("A bridge at dawn"), F.when(F.col("doc_id") % 3 == 0, " (Photo: Ann/AFP)").when(F.col("doc_id") % 3 == 1, " | Reuters").otherwise(""))).alias("caption"), T.rewrite_image("url", F.col("pattern"), F.lit("_large")).alias("url"))


def slug_variants(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 4 == 0, "!!!").otherwise(F.concat("p_name", F.lit(" - ß ﬁeld & Ærø Ñandú ½ "), "p_type"))
    return spread(table(spark, d, "part").select("p_partkey", "p_name", "p_type")).select("p_partkey", T.slug(name, 100).alias("long"), T.slug(name, 20, "tender").alias("short"))


def ad_images(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 12
    names = ["-300x250.jpg", "-970x250.png", "-800x600.jpg", ".jpg", "-320x100.webp", "-399x900.gif", "-300x250.jpg.bak", "-800x600-FollowUs.jpeg", "-1200x400.JPG", "-headshot.png", "-50x5000.jpg?w=1", "-728x90.tiff"]
    url = F.concat(F.lit("https://img.example/a/x"), F.col("p_partkey").cast("string"), F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int")))
    width, height = F.when(F.col("p_partkey") % 5 == 0, "320").when(F.col("p_partkey") % 5 == 1, "x"), F.when(F.col("p_partkey") % 3 == 0, " 50 ").otherwise("100")
    return table(spark, d, "part").select("p_partkey", P.noise_image(url, width, height).alias("noise"))


_ALTS = ["File Photo", "", "img", "LÉGENDE", "2024", "2024 report here", "12 cats", "photo of a cat", "stock market", "Handout", "  getty  ", "a photo", "photo d'archive", "images", "Sans légende"]


def generic_alts(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_join(F.slice(F.split("text", " "), F.pmod("doc_id", F.lit(20)).cast("int") + 1, 2), " ")
    alt = F.when(F.col("doc_id") % 2 == 0, words).otherwise(F.element_at(F.array(*map(F.lit, _ALTS)), (F.col("doc_id") % 15 + 1).cast("int")))
    return table(spark, d, "documents").select("doc_id", T.generic_alt(alt).alias("generic"))


def new_urls(spark: SparkSession, d: str) -> DataFrame:
    rows = articles(spark, d).select(F.concat(F.lit("/item/"), F.col("id").cast("string")).alias("url"), "id")
    return upkeep.new_urls(rows.filter("id % 3 <> 0"), rows.filter("id % 2 = 0"), "url")


def rss_channel(spark: SparkSession, d: str) -> DataFrame:
    return files.feed_channel(_published(spark, d).withColumn("description", F.col("title")), "News & more", "https://x.example", 50)


def range_chips(spark: SparkSession, d: str) -> DataFrame:
    rows, out = articles(spark, d).withColumn("published_at", F.when(F.col("id") % 10 > 0, F.col("published_at"))), None
    for chip in ("24h", "week", "month", "ever"):
        start = upkeep.range_start(_now(), chip)
        own = (rows if start is None else rows.filter(F.col("published_at") >= start)).agg(F.count(F.lit(1)).alias("n")).withColumn("chip", F.lit(chip))
        out = own if out is None else out.unionByName(own)
    return out


def listing_until_few_new(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.floor(F.col("event_id") / 50).cast("long").alias("page"), (F.col("event_id") % 50).alias("position"), F.pmod(F.col("user_id") * 7 + F.floor(F.col("event_id") / 400).cast("long"), F.lit(700)).alias("id"))
    return upkeep.until_few_new(rows, 10, 400)


def listing_rows(spark: SparkSession, d: str) -> DataFrame:
    row = lambda k: F.concat(F.lit('<tr class="t"><td><a href="/n/'), (F.col("p_partkey") * 10 + k).cast("string"), F.lit('">'), "p_name", F.lit("</a></td><td> "), "p_brand", F.lit("</td><td></td></tr>"))
    html = F.concat(F.lit("<table>"), row(1), F.lit("<tr><th>head</th></tr>"), row(2), F.lit("</table>"))
    found = M.listing_rows(html, r'(?s)<tr class="t">(.*?)</tr>', {"href": r'href="([^"]+)"', "title": r"(?s)<td>(.*?)</td>", "brand": r"(?s)<td>.*?</td>\s*<td>(.*?)</td>", "closing": r"(?s)(?:<td>.*?</td>\s*){2}<td>(.*?)</td>"})
    return table(spark, d, "part").select("p_partkey", F.explode(found).alias("r")).select("p_partkey", "r.*")


def log_report(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.when(F.col("event_type") == "view", "published").otherwise("dropped"), F.lit(" item score="), F.pmod("event_id", F.lit(10)).cast("string"))
    logs = table(spark, d, "events").filter("event_type <> 'click'").groupBy(F.concat(F.lit("log"), F.pmod("event_id", F.lit(13)).cast("string")).alias("file")).agg(F.array_join(F.collect_list(line), "\n").alias("value"))
    return upkeep.log_report(logs)


QUERIES = {f.__name__: f for f in (
    admin_list, point_lookup, featured_slot, stale_categories, phrase_filters, enabled_sources, label_decoration, author_fetch, vocabulary_listing, thin_tags, recent_runs, page_counts, page_numbers, members_order, search_count, search_fallback, search_fields, topic_tags, sector_label,
    assistant_referrals, canonical_urls, redirects, redirect_rules, reserved_keys, json_ld_node, alt_backfill, backfill_selection, orphan_summary, orphan_deletable, inline_images, reprocess, translation_fallback, photo_rotation, simple_budget, text_forms, slug_variants, ad_images, generic_alts, new_urls, rss_channel,
    range_chips, listing_until_few_new, listing_rows, log_report,
)}

_WITH = f"WITH {ARTICLES_SQL}, p AS (SELECT * FROM articles WHERE {PUBLISHED_SQL})"
_NEWEST = "published_at DESC NULLS LAST, id DESC"
_SECTORS = f"['sector' || ({sql_md5_mod("'a' || id::VARCHAR", 9)}), 'sector' || ({sql_md5_mod("'b' || id::VARCHAR", 23)})]"
_BLANK = "len(regexp_extract_all({}, '\\S+'))"
_BODY = chr(39).join(["title || ", " ", " || body"])
_CUT = "(right(rtrim(regexp_replace(rtrim(text), '\\n+(?:Source|Kaynak)[^\\n]*$', '')), 1) NOT IN (" + ", ".join("'" + c + "'" for c in gates.ENDINGS) + "))"
_PHRASES = lambda words, t: "(" + " OR ".join(f"contains(lower({t}), '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"
_TF = "len(list_filter(string_split_regex(lower(translate({}, 'İI', 'iı')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t IN ('er', 'with', 'thanedble', 'that', 'the')))"
_TITLE = "substr(text, 1, 5) || CASE doc_id % 4 WHEN 0 THEN ' National CONSULTANT in Nigeria' WHEN 1 THEN ' road works, South Africa' WHEN 2 THEN ' programme officers' ELSE '' END"
_XML = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_PLAIN_SLUG = "replace(p_name, ' ', '-')"

ORACLE = {
    "admin_list": f"WITH {ARTICLES_SQL} SELECT {LIST_SQL} FROM (SELECT * FROM articles WHERE title ILIKE '%an_ %t%' ORDER BY {_NEWEST} LIMIT 100)",
    "point_lookup": "SELECT n_nationkey, n_name FROM nation WHERE n_name = 'NATION_7'",
    "featured_slot": f"""{_WITH}, f AS (SELECT *, ({sql_md5_mod("'f' || id::VARCHAR", 40)}) = 0 AS is_featured FROM p)
        SELECT {LIST_SQL}, 'featured' AS slot FROM (SELECT * FROM f ORDER BY is_featured DESC, {_NEWEST} LIMIT 1) UNION ALL SELECT {LIST_SQL}, 'fallback' FROM (SELECT * FROM f ORDER BY {_NEWEST} LIMIT 1)""",
    "stale_categories": f"WITH {ARTICLES_SQL} SELECT id FROM articles WHERE list_has_any({_SECTORS}, {RETIRED!r})",
    "phrase_filters": f"WITH t AS (SELECT doc_id, text, {_TITLE} AS title FROM documents) SELECT doc_id, {_PHRASES(upkeep.JOBS, 'title')} AS job, {_PHRASES(upkeep.COUNTRIES, 'title')} AS country, {_PHRASES(['idiot', 'the and', 'worthless'], 'text')} AS words FROM t",
    "enabled_sources": "SELECT source, count(*) AS n FROM documents WHERE md5(source) < '8' GROUP BY source",
    "label_decoration": "SELECT s_suppkey, coalesce(n_name, s_nationkey::VARCHAR) AS label FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 1) ON s_nationkey = n_nationkey",
    "author_fetch": "SELECT o_orderkey, c_name AS author FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) ON o_custkey = c_custkey",
    "vocabulary_listing": f"{_WITH}, v AS (SELECT * FROM (VALUES ('rude-land', 'disgusting'), ('than-land', 'thanedble')) AS v(asked, tag)) SELECT asked, id FROM p JOIN v ON list_contains(tags, tag)",
    "thin_tags": f"{_WITH} SELECT tag, count(*) < 3 AS thin FROM (SELECT unnest(tags) AS tag FROM p) GROUP BY tag",
    "recent_runs": "SELECT strftime(ts, '%Y-%m-%d') AS run_date, event_type AS source, count(*) AS scraped FROM events GROUP BY 1, 2 ORDER BY run_date DESC, source LIMIT 10",
    "page_counts": f"{_WITH} SELECT tab, ceil(count(*) / 12.0)::BIGINT AS pages FROM p GROUP BY tab",
    "page_numbers": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN greatest(1, p_partkey) ELSE 1 END::BIGINT AS param, CASE WHEN p_partkey % 5 = 0 AND p_partkey >= 2 THEN p_partkey END::BIGINT AS segment FROM part",
    "members_order": f"SELECT c_custkey, {sql_stamp(f'''(TIMESTAMP '{NOW}' - to_hours(((c_custkey * 37) % 9000)::INTEGER))''')} AS created_at FROM customer",
    "search_count": f"{_WITH} " + " UNION ALL ".join(f"SELECT {k} AS asked, count(*) AS n FROM p WHERE {own}" for k, own in enumerate((
        f"({_any([['with'], ['er']], _TOK.format(_BODY))} OR {extent_sql('with er', 'title')} > 0.3)", f"({_any([['thanedbl']], _TOK.format(_BODY))} OR {extent_sql('thanedbl', 'title')} > 0.3)", _any([['er']], _TOK.format(_BODY)),
        f"tab = 'tab3' AND ({_any([['thanedble']], _TOK.format(_BODY))} OR {extent_sql('thanedble', 'title')} > 0.3)",
        f"tab = 'tab3' AND published_at >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY AND ({_any([['the'], ['that']], _TOK.format(_BODY))} OR {extent_sql('the that', 'title')} > 0.3)", "false"))),
    "search_fallback": f"{_WITH} SELECT id, 'good' AS mode FROM p WHERE {_any([['er'], ['with', 'from']], _TOK.format(_BODY))} UNION ALL SELECT id, 'broken' FROM p WHERE {_any([['with'], ['er']], _TOK.format(_BODY))}",
    "search_fields": f"""{_WITH}, f AS (SELECT *, substr(body, 1, 200) AS excerpt, array_to_string(tags, ' ') AS tag_text FROM p),
        n AS (SELECT id, title, body, excerpt, tag_text, {', '.join(f'{_TF.format(c)} AS n_{c}' for c in ('title', 'excerpt', 'tag_text', 'body'))} FROM f)
        SELECT id, round({' + '.join(f'{w} * n_{c} / (n_{c} + 1)' for c, w in (('title', 1.0), ('excerpt', 0.4), ('tag_text', 0.4), ('body', 0.2)))}, 6)::DOUBLE AS rank FROM n
        WHERE {_any([['er', 'with'], ['thanedble', 'that', 'the']], _TOK.format("title || ' ' || excerpt || ' ' || tag_text || ' ' || body"))}""",
    "topic_tags": f"WITH {ARTICLES_SQL} SELECT id, len(list_filter(tags, lambda t: t[1] NOT IN ('a', 'c') AND NOT suffix(t, 'ing'))) > 0 AS topic FROM articles",
    "sector_label": f"""WITH {ARTICLES_SQL}, s AS (SELECT *, list_filter({_SECTORS}, lambda x: x NOT IN ('sector1', 'sector2', 'sector3'))[1] AS sector, list_filter(tags, lambda t: t[1] NOT IN ('a', 'c'))[1] AS topic FROM articles)
        SELECT id, CASE WHEN tab IN ('tab0', 'tab4') THEN coalesce(sector, CASE WHEN tab = 'tab4' THEN tab END, topic, tab) ELSE tab END AS label FROM s""",
    "assistant_referrals": "WITH v AS (SELECT page_id % 40 AS session, CASE page_id % 6 WHEN 0 THEN 'chatgpt.com' WHEN 1 THEN 'claude.ai' WHEN 2 THEN 'perplexity.ai' WHEN 4 THEN 'you.com' END AS source FROM pages) SELECT DISTINCT session, source FROM v WHERE source IS NOT NULL",
    "canonical_urls": """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN CASE WHEN p_partkey > 1 THEN '/news/page/' || p_partkey ELSE '/news' END WHEN 1 THEN '/news/page/3?kind=energy' WHEN 2 THEN '/news?kind=other' WHEN 3 THEN '/tag/a/page/' || p_partkey || '/page/2'
        WHEN 4 THEN '/?q=z' WHEN 5 THEN '/gone' WHEN 6 THEN '/item/' || p_partkey || '?q=a%20b' ELSE '/item/' || p_partkey END AS canonical FROM part""",
    "redirects": """SELECT p_partkey, CASE p_partkey % 8 WHEN 5 THEN 410 WHEN 7 THEN NULL ELSE 308 END AS status, CASE p_partkey % 8 WHEN 0 THEN CASE WHEN p_partkey > 1 THEN '/news/page/' || p_partkey ELSE '/news' END WHEN 1 THEN '/kind/energy' WHEN 2 THEN '/zone/west'
        WHEN 3 THEN '/tag/a/page/' || p_partkey WHEN 4 THEN '/' WHEN 6 THEN '/item/' || p_partkey END AS target FROM part""",
    "redirect_rules": "SELECT p_partkey, CASE p_partkey % 12 " + " ".join(f"WHEN {k} THEN {s or 'NULL'}" for k, (_, s, _t) in enumerate(_MOVED)) + " END::INTEGER AS status, CASE p_partkey % 12 " + " ".join(f"WHEN {k} THEN replace('{t}', '{{n}}', (p_partkey + 2)::VARCHAR)" for k, (_, _s, t) in enumerate(_MOVED) if t) + " END AS target FROM part",
    "reserved_keys": f"SELECT {_PLAIN_SLUG} AS key FROM part UNION SELECT {_PLAIN_SLUG} || '-old' FROM part WHERE p_partkey % 9 = 0",
    "json_ld_node": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'WebPage' WHEN 1 THEN 'NewsArticle' WHEN 2 THEN 'NewsArticle' END AS kind, CASE p_partkey % 5 WHEN 0 THEN 'page ' || p_partkey WHEN 1 THEN 'item ' || p_partkey WHEN 2 THEN 'item ' || p_partkey END AS headline, CASE WHEN p_partkey % 5 IN (1, 2) THEN '2024-01-02' END AS published FROM part",
    "alt_backfill": f"WITH {ARTICLES_SQL} SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN 'picture of ' || source END, title) AS image_alt FROM articles",
    "backfill_selection": f"""WITH {ARTICLES_SQL}, s AS (SELECT *, coalesce({PUBLISHED_SQL}, false) AS shown FROM articles) SELECT id, array_to_string(list_filter([CASE WHEN lang = 'de' THEN 'all' END, CASE WHEN shown AND len(regexp_extract_all(body, '(?i)<h2[ >]')) < 2 THEN 'headings' END, CASE WHEN shown AND length(body) NOT BETWEEN 105 AND 170 THEN 'meta' END,
        CASE WHEN score IS NULL THEN 'score' END, CASE WHEN len(tags) = 0 THEN 'tags' END, CASE WHEN tab = 'tab7' AND len(list_filter(tags, lambda t: suffix(t, 'ing'))) = 0 THEN 'topic' END, CASE WHEN score >= 5 AND lang <> 'en' THEN 'translate' END, CASE WHEN {_BLANK.format('body')} > 900 THEN 'trim' END], lambda x: x IS NOT NULL), ',') AS needs FROM s""",
    "orphan_summary": "WITH s AS (SELECT count(*) AS n, sum(length(html)) AS b FROM pages WHERE page_id % 3 <> 0) SELECT n, round(b / 1048576.0, 1)::DOUBLE AS megabytes, abs(n - 100) > 20 AS suspicious FROM s",
    "orphan_deletable": "SELECT 'img/' || page_id AS path, length(html)::BIGINT AS bytes FROM pages WHERE page_id % 3 <> 0 AND page_id % 2 = 0 AND page_id % 8 <> 0",
    "inline_images": "SELECT p_partkey, 'https://a/' || p_partkey || '.jpg https://d/z' || p_partkey || '.png' AS images FROM part",
    "reprocess": "SELECT p_partkey, md5('x ' || p_name) AS hash, 'post' AS stage FROM part WHERE md5('x ' || p_name) > '4'",
    "translation_fallback": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN upper(p_name) ELSE p_name END AS name FROM part",
    "photo_rotation": f"""WITH r AS (SELECT p_partkey, {sql_md5_mod('p_partkey::VARCHAR', 5)} AS turn, {sql_md5_mod('p_partkey::VARCHAR', 3)} + 1 AS page FROM part),
        f AS (SELECT *, list_filter(list_transform(range(5), lambda i: (i + turn) % 5), lambda x: x > p_partkey % 6)[1] AS first FROM r) SELECT p_partkey, 'p' || first AS photo, page FROM f""",
    "simple_budget": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN round(o_totalprice::DECIMAL(12,2)::DOUBLE * 1000000, 2) WHEN 1 THEN o_totalprice::DECIMAL(12,2)::DOUBLE WHEN 2 THEN 1234567.0 END AS amount FROM orders",
    "text_forms": "SELECT doc_id, 'a, b --- c, d ' || doc_id AS strict, 'A bridge at dawn' AS caption, source || '/img/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '_large.jpg' ELSE '_small.jpg' END AS url FROM documents",
    "slug_variants": "WITH s AS (SELECT p_partkey, regexp_replace(replace(p_name, ' ', '-') || '---field-r-nandu-12-' || replace(lower(p_type), ' ', '-'), '^-+|-+$', '', 'g') AS s FROM part) SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE regexp_replace(substr(s, 1, 100), '-+$', '') END AS long, CASE WHEN p_partkey % 4 = 0 THEN 'tender' ELSE regexp_replace(substr(s, 1, 20), '-+$', '') END AS short FROM s",
    "ad_images": rf"""WITH u AS (SELECT p_partkey, 'https://img.example/a/x' || p_partkey || ['-300x250.jpg', '-970x250.png', '-800x600.jpg', '.jpg', '-320x100.webp', '-399x900.gif', '-300x250.jpg.bak', '-800x600-FollowUs.jpeg', '-1200x400.JPG', '-headshot.png', '-50x5000.jpg?w=1', '-728x90.tiff'][p_partkey % 12 + 1] AS url,
        CASE p_partkey % 5 WHEN 0 THEN '320' WHEN 1 THEN 'x' END || 'x' || CASE WHEN p_partkey % 3 = 0 THEN '50' ELSE '100' END AS given FROM part),
        n AS (SELECT *, regexp_extract(lower(url), '-([0-9]{{2,4}}x[0-9]{{2,4}})[.](?:jpe?g|png|webp|gif)$', 1) AS told FROM u)
        SELECT p_partkey, regexp_matches(lower(url), '{P.NOISE_ADDRESS}') OR told IN {P.AD_SIZES} OR coalesce(given IN {P.AD_SIZES}, false)
               OR (told <> '' AND least(try_cast(split_part(told, 'x', 1) AS INT), try_cast(split_part(told, 'x', 2) AS INT)) < {P.LEAST_SIDE}) AS noise FROM n""",
    "generic_alts": rf"""WITH a AS (SELECT doc_id, trim(CASE WHEN doc_id % 2 = 0 THEN array_to_string(string_split(text, ' ')[doc_id % 20 + 1 : doc_id % 20 + 2], ' ') ELSE {[a for a in _ALTS]!r}[doc_id % 15 + 1] END, E' \n\t\r') AS alt FROM documents)
        SELECT doc_id, length(alt) < 5 OR ({_BLANK.format('alt')} <= 2 AND regexp_full_match(lower(alt), '{T.FILLERS.replace(chr(39), chr(39) * 2)}')) AS generic FROM a""".replace(chr(34) + "photo d'archive" + chr(34), "'photo d''archive'"),
    "new_urls": f"WITH {ARTICLES_SQL} SELECT '/item/' || id AS url FROM articles WHERE id % 2 = 0 AND id % 3 = 0",
    "rss_channel": f"""{_WITH}, t AS (SELECT *, row_number() OVER (ORDER BY {_NEWEST}) AS n FROM p QUALIFY n <= 50)
        SELECT '<rss version="2.0"><channel><title>News &amp; more</title><link>https://x.example</link>' || string_agg('<item><title>' || {_XML.format('title')} || '</title><link>https://x.example/item/' || id || '</link><description>' || {_XML.format('title')} || '</description><pubDate>' || strftime(published_at, '%a, %d %b %Y %H:%M:%S') || ' GMT</pubDate></item>', '' ORDER BY n) || '</channel></rss>' AS xml FROM t""",
    "range_chips": f"WITH {ARTICLES_SQL}, a AS (SELECT CASE WHEN id % 10 > 0 THEN published_at END AS shown FROM articles) SELECT chip, count(*) FILTER (days IS NULL OR shown >= TIMESTAMP '{NOW}' - to_days(days)) AS n FROM a, (VALUES ('24h', 1), ('week', 7), ('month', 30), ('ever', NULL)) AS c(chip, days) GROUP BY chip",
    "listing_until_few_new": """WITH r AS (SELECT event_id // 50 AS page, event_id % 50 AS position, (user_id * 7 + event_id // 400) % 700 AS id FROM events), f AS (SELECT id, min((page, position)) AS spot FROM r GROUP BY id),
        h AS (SELECT id, spot[1] AS page, spot[2] AS position FROM f), g AS (SELECT p.page, count(h.id) AS n FROM (SELECT DISTINCT page FROM r) p LEFT JOIN h USING (page) GROUP BY p.page)
        SELECT page, position, id FROM h WHERE page <= coalesce((SELECT min(page) FROM g WHERE n < 10), 1e18) ORDER BY page, position LIMIT 400""",
    "listing_rows": "SELECT p_partkey, '/n/' || (p_partkey * 10 + k) AS href, p_name AS title, p_brand AS brand, NULL::VARCHAR AS closing FROM part, (VALUES (1), (2)) AS v(k)",
    "log_report": "SELECT 'log' || (event_id % 13) AS file, count(*) FILTER (event_type = 'view') AS published, count(*) FILTER (event_type <> 'view') AS dropped, round(avg(event_id % 10), 2) AS mean_score, round(100.0 * published / count(*), 1)::DOUBLE AS percent FROM events WHERE event_type <> 'click' GROUP BY 1",
}
