"""Catalogue: the remaining reads, gates, formats and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import changes, gates, metrics, models, reads, search
from ..tables import ARTICLES_SQL, NOW, PUBLISHED_SQL, articles, sql_md5_mod, sql_stamp, stamp, table
from .reads import _TOK, _any
from .texts import AUTHORS


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def news_sitemap(spark: SparkSession, d: str) -> DataFrame:
    rows = reads.published(articles(spark, d)).filter(F.col("published_at") >= _now() - F.expr("interval 48 hours"))
    return reads.page(rows, 1, 1000).select("id", T.escape_xml(F.substring("title", 1, 110)).alias("title"), stamp("published_at").alias("published_at"))


def display_dates(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", V.display_date(ts).alias("shown"), V.rfc822(ts).alias("rfc"))


def progress_bands(spark: SparkSession, d: str) -> DataFrame:
    at = F.lit("1998-06-01 00:00:00").cast("timestamp")
    p = V.progress(at, F.col("o_orderdate").cast("timestamp"), (F.col("o_orderdate") + F.expr("interval 1000 days")).cast("timestamp"))
    return table(spark, d, "orders").select("o_orderkey", F.round(p["percent"], 6).alias("percent"), p["band"].alias("band"))


def author_distribution(spark: SparkSession, d: str) -> DataFrame:
    rows = articles(spark, d).select(metrics.author_for(F.col("id").cast("string"), AUTHORS).alias("author"), "score")
    return rows.groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"))


def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.status_histogram(table(spark, d, "orders").withColumn("status", F.concat(F.lower("o_orderpriority"), F.lit(": "), "o_orderstatus")), "status")


def report_cards(spark: SparkSession, d: str) -> DataFrame:
    return gates.report_card(articles(spark, d))


def damage_and_gain(spark: SparkSession, d: str) -> DataFrame:
    words = T.count_blank_separated("text")
    return table(spark, d, "documents").select("doc_id", gates.damaged("text").alias("damaged"), gates.gains(words, F.col("doc_id") % 400).alias("gains"), gates.truncated_list("text").alias("list_cut"))


def dimension_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.orderBy(F.col("n_regionkey").asc_nulls_last(), F.col("n_name").asc()).limit(7).select("n_nationkey", "n_name", "r_name")


def search_articles(spark: SparkSession, d: str) -> DataFrame:
    since = _now() - F.expr("interval 20 days")
    rows = search.search(reads.published(articles(spark, d)), "er", {}, tab="tab3", since=since, fuzzy_from=4)
    return rows.select("id", "tab")


def untranslated(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").withColumn("other", F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).when(F.col("p_partkey") % 4 == 1, "").when(F.col("p_partkey") % 4 == 2, "x"))
    return rows.filter(T.untranslated("other", "p_name")).select("p_partkey")


def patched_orders(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.lit("before").alias("updated_at"))
    patches = rows.filter("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "Z").alias("o_orderstatus"), F.lit("never").alias("o_orderpriority"))
    return changes.patch(rows, patches, "o_orderkey", ["o_orderstatus"], ["o_orderstatus"], F.lit("after"))


def changed_only(spark: SparkSession, d: str) -> DataFrame:
    return changes.write_if_changed(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), {"p_name": F.regexp_replace("p_name", "^small ", "tiny "), "p_brand": F.col("p_brand")})


def contradictions(spark: SparkSession, d: str) -> DataFrame:
    pairs = (("small", "large"), ("old", "new"), ("red", "blue"))
    rows = table(spark, d, "part").select("p_partkey", "p_name")
    other = rows.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("before"))
    return rows.join(other, "p_partkey").filter(T.contradicts("p_name", "before", pairs)).select("p_partkey")


def model_scores(spark: SparkSession, d: str) -> DataFrame:
    rules = [("idiot", "score: 1"), ("the", '{"score": 8}'), ("de", "about 7 points")]
    rows = models.ask(table(spark, d, "documents").select("doc_id", F.col("text").alias("prompt")), "prompt", "reply", models.KeywordModel(rules, "none"))
    return rows.select("doc_id", V.clamp(V.json_number("reply", "score", 5)).alias("score"))


def view_counters(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "events").filter("event_type = 'view'").groupBy(F.pmod("event_id", F.lit(1000)).alias("id")).agg(F.count(F.lit(1)).alias("new_views"))
    rows = articles(spark, d).select("id", F.coalesce("score", F.lit(0)).alias("view_count")).join(seen, "id", "left")
    return rows.select("id", (F.col("view_count") + F.coalesce("new_views", F.lit(0))).cast("long").alias("view_count"))


QUERIES = {f.__name__: f for f in (news_sitemap, display_dates, progress_bands, author_distribution, status_histogram, report_cards, damage_and_gain, dimension_order, search_articles, untranslated, patched_orders, changed_only, contradictions, model_scores, view_counters)}

_WITH = f"WITH {ARTICLES_SQL}, p AS (SELECT * FROM articles WHERE {PUBLISHED_SQL})"
_XML = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_BLANK = "len(regexp_extract_all({}, '\\S+'))"
_CUT = "(right(rtrim(regexp_replace(rtrim(text), '\\n+(?:Source|Kaynak)[^\\n]*$', '')), 1) NOT IN (" + ", ".join("'" + c + "'" for c in gates.ENDINGS) + "))"

ORACLE = {
    "news_sitemap": f"{_WITH} SELECT id, {_XML.format('substr(title, 1, 110)')} AS title, {sql_stamp('published_at')} AS published_at FROM (SELECT * FROM p WHERE published_at >= TIMESTAMP '{NOW}' - INTERVAL 48 HOUR ORDER BY published_at DESC, id DESC LIMIT 1000)",
    "display_dates": f"SELECT o_orderkey, day(o_orderdate) || ' ' || {V.MONTHS!r}[month(o_orderdate)] || ' ' || year(o_orderdate) AS shown, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S') || ' GMT' AS rfc FROM orders",
    "progress_bands": "WITH s AS (SELECT o_orderkey, greatest(0.0, least(100.0, 100.0 * (epoch(TIMESTAMP '1998-06-01') - epoch(o_orderdate)) / 86400000.0))::DOUBLE AS p FROM orders) SELECT o_orderkey, round(p, 6) AS percent, CASE WHEN p >= 85 THEN 'late' WHEN p >= 60 THEN 'middle' ELSE 'early' END AS band FROM s",
    "author_distribution": f"{_WITH} SELECT {AUTHORS!r}[{sql_md5_mod('id::VARCHAR', 7)} + 1] AS author, count(*) AS n, count(score) AS scored FROM articles GROUP BY 1",
    "status_histogram": "SELECT lower(o_orderpriority) AS status, count(*) AS n FROM orders GROUP BY 1",
    "report_cards": f"{_WITH} SELECT source, count(*) AS n, count(*) FILTER ({_BLANK.format('body')} >= 250 AND title <> '') AS good, good >= least(4, n) AS passed FROM articles GROUP BY source",
    "damage_and_gain": f"SELECT doc_id, (text = '' OR contains(text, '[…]') OR {_BLANK.format('text')} <= 120 OR {_CUT}) AS damaged, {_BLANK.format('text')} >= greatest(1.3 * (doc_id % 400), doc_id % 400 + 40) AS gains, regexp_matches(rtrim(text), '(?i)(?:following|as follows|include|such as)\\s*:$') AS list_cut FROM documents",
    "dimension_order": "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY n_regionkey, n_name LIMIT 7",
    "search_articles": f"{_WITH} SELECT id, tab FROM p WHERE tab = 'tab3' AND published_at >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY AND {_any([['er']], _TOK.format(chr(39).join(['title || ', ' ', ' || body'])))}",
    "untranslated": "SELECT p_partkey FROM part WHERE p_partkey % 4 <> 2",
    "patched_orders": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority, CASE WHEN o_orderkey % 6 = 0 THEN 'after' ELSE 'before' END AS updated_at FROM orders",
    "changed_only": "SELECT p_partkey, 'tiny ' || substr(p_name, 7) AS p_name, p_brand FROM part WHERE prefix(p_name, 'small ')",
    "contradictions": "SELECT a.p_partkey FROM part a JOIN part b ON a.p_partkey = b.p_partkey + 1 WHERE " + " OR ".join(f"(contains(a.p_name, '{x}') AND contains(b.p_name, '{y}'))" for p, q in (("small", "large"), ("old", "new"), ("red", "blue")) for x, y in ((p, q), (q, p))),
    "model_scores": "SELECT doc_id, CASE WHEN contains(lower(text), 'idiot') THEN 1 WHEN contains(lower(text), 'the') THEN 8 WHEN contains(lower(text), 'de') THEN 7 ELSE 5 END AS score FROM documents",
    "view_counters": f"{_WITH}, v AS (SELECT event_id % 1000 AS id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) SELECT id, (coalesce(score, 0) + coalesce(n, 0))::BIGINT AS view_count FROM articles LEFT JOIN v USING (id)",
}
