"""Catalogue: joins, change capture, events, pages, feeds, conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import changes, metrics, reads
from ..sources import files, html
from ..tables import ARTICLES_SQL, NOW, PUBLISHED_SQL, articles, sql_stamp, stamp, table


def _now(at: str = NOW):
    return F.lit(at).cast("timestamp_ntz")


def legacy_key_resolution(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    base = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.lower("p_type"))
    current = parts.select(F.col("p_partkey").alias("item"), F.concat(base, F.lit("-"), F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 6)).alias("key"), (_now() - F.make_interval(hours=F.col("p_partkey").cast("int"))).alias("at"))
    history = parts.filter("p_partkey % 10 = 0").select(F.concat(F.lit("old-"), F.col("p_partkey").cast("string")).alias("old_key"), F.col("p_partkey").alias("item"))
    asked = history.select(F.col("old_key").alias("asked")).unionByName(parts.filter("p_partkey % 100 = 7").select(base.alias("asked")).distinct()).unionByName(spark.createDataFrame([("nothing-here",), ("old%2D20",)], "asked string"))
    accented = parts.filter("p_partkey % 100 = 9").select(F.concat(F.initcap(F.replace(base, F.lit("e"), F.lit("%C3%A9"))), F.lit("-0a1b2c")).alias("asked")).distinct()
    return reads.resolve_keys(asked.unionByName(accented), current, history)


def slug_history_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    name = lambda c: F.concat_ws("-", F.lower(c), F.col("o_orderkey").cast("string"))
    old = rows.select("o_orderkey", name("o_orderstatus").alias("key"))
    new = rows.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, name("o_orderpriority")).when(F.col("o_orderkey") % 50 == 1, F.concat(F.lit("was-"), (F.col("o_orderkey") + 1).cast("string"))).otherwise(name("o_orderstatus")).alias("key"))
    history = rows.filter("o_orderkey % 5 = 2").select(F.concat(F.lit("was-"), F.col("o_orderkey").cast("string")).alias("old_key"), "o_orderkey")
    return changes.key_history(old, new, history, "o_orderkey", "key")


def upsert_restricted(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderpriority").alias("slug"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"))
    current = rows.filter("o_orderkey % 5 <> 0")
    batch = rows.filter("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_totalprice", F.lit("new").alias("slug"))
    return changes.upsert(current, batch, "o_orderkey", ["slug"], F.lit("2024-01-31"))


def stats_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.to_date("ts").alias("run_date"), "event_type", V.run_slot(F.col("ts").cast("timestamp")).alias("run_slot"), "event_id", "value")
    last = changes.last_per_key(rows, ["run_date", "event_type", "run_slot"], [F.desc("event_id")])
    return last.select(F.date_format("run_date", "yyyy-MM-dd").alias("run_date"), "event_type", "run_slot", "event_id", "value")


def run_slot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", V.run_slot(F.col("ts").cast("timestamp")).alias("slot"))


def modified_date(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    shown = V.modified_date(F.col("o_orderdate"), F.col("o_orderdate"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_shipdate")))
    return rows.select("l_orderkey", "l_linenumber", F.date_format(shown, "yyyy-MM-dd").alias("shown"))


def tender_status(spark: SparkSession, d: str) -> DataFrame:
    at, deadline = _now("1998-06-01 12:30:15"), F.col("o_orderdate") + F.expr("interval 30 days")
    left = V.countdown(at.cast("timestamp"), deadline.cast("timestamp"))
    open_ = changes.purge(table(spark, d, "orders").withColumn("deadline", F.when(F.col("o_orderkey") % 7 > 0, deadline)), "deadline", at)
    return open_.select("o_orderkey", V.tender_status(at, F.col("o_orderdate"), F.col("deadline")).alias("status"), V.in_window(at, F.col("deadline"), F.col("o_orderdate")).alias("listed"), left["days"].alias("days"), left["hours"].alias("hours"), left["seconds"].alias("seconds"))


def fk_validate_default(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").withColumn("nation", F.concat(F.lit("NATION_"), (F.col("s_nationkey") * 2).cast("string")))
    return metrics.validate_keys(rows, "nation", table(spark, d, "nation"), "n_name", F.lit("other")).select("s_suppkey", "nation")


def bookmark_join(spark: SparkSession, d: str) -> DataFrame:
    saved = table(spark, d, "events").filter("event_type = 'click'").select("user_id", F.pmod(F.col("event_id") * 31, F.lit(1000)).alias("id"), "ts").groupBy("user_id", "id").agg(F.max("ts").alias("saved_at"))
    return saved.join(reads.published(articles(spark, d)), "id").select("user_id", "id", "title", stamp("saved_at").alias("saved_at"))


def anti_join_known(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "orders").filter("o_orderdate >= timestamp_ntz'1998-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(seen, "c_custkey", "left_anti").select("c_custkey", "c_name")


def orphan_detection(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    objects = pages.select(F.concat(F.lit("img/"), F.col("page_id").cast("string"), F.lit(".jpg")).alias("path"), F.length("html").cast("long").alias("bytes"))
    texts = pages.filter("page_id % 3 = 0").select(F.concat(F.lit("see store/img/"), F.col("page_id").cast("string"), F.lit(".jpg x")).alias("body")).unionByName(pages.filter("page_id % 50 = 1").select(F.concat(F.lit("raw img/"), F.col("page_id").cast("string"), F.lit(".jpg")).alias("body")))
    left = changes.unreferenced(objects, "path", texts, "body", "store")
    return left.select("path", "bytes")


def registry_drift(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nation").filter("n_nationkey % 6 <> 0")
    b = table(spark, d, "nation").filter("n_nationkey % 7 <> 0").select("n_nationkey", F.when(F.col("n_nationkey") % 5 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("n_name"), F.when(F.col("n_nationkey") % 4 == 0, F.lit(None)).otherwise(F.col("n_regionkey")).cast("int").alias("n_regionkey"))
    return changes.registry_drift(a, b, "n_nationkey", ["n_name", "n_regionkey"])


def tombstone_conflicts(spark: SparkSession, d: str) -> DataFrame:
    name, k = F.replace("p_name", F.lit(" "), F.lit("-")), F.col("p_partkey")
    parts = table(spark, d, "part")
    gone = parts.filter(k % 40 == 0).select(F.concat(name, F.when(k % 80 == 0, "-0a1b2c").when(k % 3 == 0, "-x").when(k % 7 == 0, "-old").otherwise("")).alias("key")).distinct()
    retired = parts.filter(k % 7 == 0).select(F.concat(name, F.lit("-old")).alias("key"))
    return changes.key_conflicts(gone, parts.select(name.alias("key")), retired).withColumnRenamed("key", "gone")


def event_overview(spark: SparkSession, d: str) -> DataFrame:
    return metrics.overview(table(spark, d, "events"))


def event_daily_active(spark: SparkSession, d: str) -> DataFrame:
    return metrics.daily_active(table(spark, d, "events")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "users", "bar")


def event_top_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    views = metrics.top_k(rows, "k", F.count(F.lit(1))).withColumn("measure", F.lit("views"))
    users = metrics.top_k(rows, "k", F.countDistinct("user_id")).withColumn("measure", F.lit("users"))
    return views.unionByName(users).select("measure", F.col("rank").cast("long").alias("rank"), "k", "value")


def referrer_class(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", r"^\w+://([^/?#]+)", 1)
    return table(spark, d, "pages").select("page_id", host.alias("host"), metrics.referrer_class(host, {"example.com": "com", "example.net": "net"}).alias("class"))


def html_strip_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.trim(html.strip_blocks("html")).alias("text"), html.field("html", "title").alias("title"), T.count_runs(T.strip_tags("html")).cast("long").alias("words"))


def html_sanitise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", html.clean_column("html").alias("html"))


def html_links(spark: SparkSession, d: str) -> DataFrame:
    return html.links(table(spark, d, "pages"), exclude="^/th").select("url", "href", html.absolute(F.col("url"), F.col("href")).alias("target"))


def main_content(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", html.content_column("html").alias("c")).select("page_id", "c.text", "c.cut")


def page_headings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", html.headings_column(F.concat("html", F.lit("<h3> </h3><h4>last</h4>"))).alias("html"))


def page_images(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    made = F.concat("html", F.lit('<img data-src="https://img.example/'), n, F.lit('.jpg" src="data:image/gif;base64,AAAA"><img src="a.gif"><IMG alt="x" srcset="https://img.example/s'), n, F.lit('.jpg 400w, https://img.example/l.jpg 800w" src="https://img.example/src.jpg">'))
    return table(spark, d, "pages").select("page_id", F.array_join(html.images_column(made), " ").alias("images"))


def page_tables(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat("html", F.lit('<table><tr class="a"><th>Name</th><td> x <i>y</i></td></tr><tr><td>'), F.col("page_id").cast("string"), F.lit("</td></tr></table>"))
    return table(spark, d, "pages").select("page_id", F.array_join(F.transform(html.tables_column(made), lambda r: F.array_join(r, "|")), "\n").alias("cells"))


def feed_items(spark: SparkSession, d: str) -> DataFrame:
    rows = reads.page(reads.published(articles(spark, d)), 1, 50).withColumn("description", F.when(F.col("id") % 3 > 0, T.excerpt("body", 60)))
    return files.feed_items(rows, "https://site.example")


def structured_data(spark: SparkSession, d: str) -> DataFrame:
    rows = articles(spark, d).withColumn("author", F.when(F.col("id") % 2 == 0, F.concat(F.lit("a"), F.col("id").cast("string")))).withColumn("tab", F.when(F.col("id") % 5 > 0, F.col("tab")))
    parsed = F.from_json("json", "type string, date string, keywords string, author string, trail array<struct<position: int, name: string>>")
    return files.structured_data(rows).select("id", parsed.alias("j")).select("id", "j.type", "j.date", "j.keywords", "j.author", F.size("j.trail").alias("steps"), F.element_at("j.trail", -1)["position"].alias("last"))


def conversation_turns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    longest = F.max_by("text", F.struct(F.length("text"), -F.col("turn")))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.md5(longest).alias("longest"), F.sum(F.length("text")).cast("long").alias("signs"))


def headcounts(spark: SparkSession, d: str) -> DataFrame:
    rows = articles(spark, d)
    return rows.agg(F.count_if(~F.col("is_suppressed")).alias("visible"), F.count_if(F.col("published_at") >= _now() - F.expr("interval 24 hours")).alias("last_day"), F.count_if(F.col("score").isNull()).alias("unscored"))


def bookmark_toggle(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.pmod("event_id", F.lit(50)).alias("id"), "event_type", "event_id")
    saved = rows.filter("event_type = 'signup'").select("user_id", "id").distinct()
    return changes.toggle(saved, rows.filter("event_type = 'click'").select("user_id", "id"), ["user_id", "id"])


QUERIES = {f.__name__: f for f in (legacy_key_resolution, slug_history_merge, upsert_restricted, stats_upsert, run_slot, modified_date, tender_status, fk_validate_default, bookmark_join, anti_join_known, orphan_detection, registry_drift, tombstone_conflicts, event_overview, event_daily_active, event_top_keys, referrer_class, html_strip_text, html_sanitise, html_links, main_content, page_headings, page_images, page_tables, feed_items, structured_data, conversation_turns, headcounts, bookmark_toggle)}

_WITH = f"WITH {ARTICLES_SQL}, p AS (SELECT * FROM articles WHERE {PUBLISHED_SQL})"
_SLOT = "CASE WHEN hour(ts + INTERVAL 3 HOUR) < 12 THEN 'sabah' ELSE 'oglen' END"
_XML = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"

_HEADED = "html || '<h3> </h3><h4>last</h4>'"
_STRIP = "trim(regexp_replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
_SOURCE = "coalesce(" + ", ".join(f"list_filter([split_part(trim(split_part(regexp_extract(t, '(?i)[\\s\"]{n}\\s*=\\s*\"([^\"]*)\"', 1), ',', 1)), ' ', 1)], lambda v: length(v) > 10 AND NOT prefix(v, 'data:'))[1]" for n in html.LAZY) + ")"

ORACLE = {
    "page_headings": f"""WITH h AS (SELECT page_id, {_HEADED} AS html FROM pages), e AS (SELECT page_id, {"regexp_replace(" * 6}html{"".join(f", '(?is)<h{k}\\b[^>]*>(?:\\s|<(?:[^/h>][^>]*|/[^h>][^>]*|/?h[^1-6>][^>]*)>)*</h{k}\\s*>', '', 'g')" for k in range(1, 7))} AS html, list_min(list_transform(regexp_extract_all(html, '(?i)<h([1-6])\\b', 1), lambda x: x::INTEGER)) AS top FROM h)
        SELECT page_id, replace({"regexp_replace(" * 6}html{"".join(f", '(?is)<h{k}\\b[^>]*>(.*?)</h{k}\\s*>', CASE WHEN top = {k} THEN '^h2>\\1^/h2>' ELSE '^h3>\\1^/h3>' END, 'g')" for k in range(1, 7))}, '^', '<') AS html FROM e""",
    "page_images": f"""WITH m AS (SELECT page_id, html || '<img data-src="https://img.example/' || page_id || '.jpg" src="data:image/gif;base64,AAAA"><img src="a.gif"><IMG alt="x" srcset="https://img.example/s' || page_id || '.jpg 400w, https://img.example/l.jpg 800w" src="https://img.example/src.jpg">' AS html FROM pages),
        t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<img\\b[^>]*>')) AS t, unnest(range(len(regexp_extract_all(html, '(?is)<img\\b[^>]*>')))) AS spot FROM m), s AS (SELECT page_id, {_SOURCE} AS url, spot FROM t), f AS (SELECT page_id, url, min(spot) AS spot FROM s WHERE url IS NOT NULL GROUP BY 1, 2)
        SELECT page_id, CASE WHEN count(*) > 6 THEN '' ELSE string_agg(url, ' ' ORDER BY spot) END AS images FROM f GROUP BY page_id""",
    "page_tables": f"""WITH m AS (SELECT page_id, html || '<table><tr class="a"><th>Name</th><td> x <i>y</i></td></tr><tr><td>' || page_id || '</td></tr></table>' AS html FROM pages)
        SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '(?is)<tr\\b[^>]*>(.*?)</tr>', 1), lambda r: array_to_string(list_transform(regexp_extract_all(r, '(?is)<t[dh]\\b[^>]*>(.*?)</t[dh]>', 1), lambda c: {_STRIP.format('c')}), '|')), chr(10)) AS cells FROM m""",
    "legacy_key_resolution": f"""WITH c AS (SELECT p_partkey AS item, replace(p_name, ' ', '-') || '-' || lower(p_type) AS base, base || '-' || substr(md5(p_partkey::VARCHAR), 1, 6) AS key, TIMESTAMP '{NOW}' - to_hours(p_partkey::INTEGER) AS at_time FROM part),
        n AS (SELECT base, arg_max(key, (at_time, key)) AS key FROM c GROUP BY base), x AS (SELECT DISTINCT base FROM c WHERE item % 100 = 9),
        a AS (SELECT 'old-' || item AS asked, key, 'history' AS how FROM c WHERE item % 10 = 0 UNION ALL SELECT 'old%2D20', key, 'history' FROM c WHERE item = 20
              UNION ALL SELECT base, key, 'base' FROM n WHERE base IN (SELECT base FROM c WHERE item % 100 = 7) UNION ALL SELECT 'nothing-here', NULL, 'none')
        SELECT asked, key, how FROM a UNION ALL SELECT upper(substr(replace(base, 'e', '%C3%A9'), 1, 1)) || lower(substr(replace(base, 'e', '%C3%A9'), 2)) || '-0a1b2c', key, 'folded' FROM x JOIN n USING (base)""",
    "slug_history_merge": """WITH r AS (SELECT o_orderkey, lower(o_orderstatus) || '-' || o_orderkey AS old, CASE WHEN o_orderkey % 4 = 0 THEN lower(o_orderpriority) || '-' || o_orderkey WHEN o_orderkey % 50 = 1 THEN 'was-' || (o_orderkey + 1) ELSE lower(o_orderstatus) || '-' || o_orderkey END AS new FROM orders),
        e AS (SELECT 'was-' || o_orderkey AS old_key, o_orderkey, 0 AS turn FROM r WHERE o_orderkey % 5 = 2 UNION ALL SELECT old, o_orderkey, 1 FROM r WHERE old <> new)
        SELECT old_key, o_orderkey FROM e WHERE old_key NOT IN (SELECT new FROM r) QUALIFY row_number() OVER (PARTITION BY old_key ORDER BY turn DESC, o_orderkey DESC) = 1""",
    "upsert_restricted": """WITH r AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority AS slug, strftime(o_orderdate, '%Y-%m-%d') AS updated_at FROM orders)
        SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE slug END AS slug,
        CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 6 = 0 THEN '2024-01-31' ELSE updated_at END AS updated_at FROM r WHERE o_orderkey % 5 <> 0 OR o_orderkey % 3 = 0""",
    "stats_upsert": f"SELECT strftime(ts, '%Y-%m-%d') AS run_date, event_type, {_SLOT} AS run_slot, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY 1, event_type, strftime(ts, '%Y-%m-%d'), {_SLOT} ORDER BY event_id DESC) = 1",
    "run_slot": f"SELECT event_id, {_SLOT} AS slot FROM events",
    "modified_date": "SELECT l_orderkey, l_linenumber, strftime(CASE WHEN l_linenumber % 2 = 0 AND l_shipdate > o_orderdate + INTERVAL 10 MINUTE THEN l_shipdate ELSE o_orderdate END, '%Y-%m-%d') AS shown FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "tender_status": """WITH n AS (SELECT o_orderkey, o_orderdate, TIMESTAMP '1998-06-01 12:30:15' AS t, o_orderdate + INTERVAL 30 DAY AS real, CASE WHEN o_orderkey % 7 > 0 THEN real END AS deadline FROM orders),
        s AS (SELECT *, greatest(0, epoch(real) - epoch(t))::BIGINT AS left_s FROM n WHERE deadline IS NULL OR deadline >= t)
        SELECT o_orderkey, CASE WHEN deadline < t THEN 'expired' WHEN o_orderdate > t THEN 'planned' ELSE 'active' END AS status, (coalesce(deadline > t, false) OR coalesce(o_orderdate >= t - INTERVAL 7 DAY, false)) AS listed, left_s // 86400 AS days, (left_s % 86400) // 3600 AS hours, left_s % 60 AS seconds FROM s""",
    "fk_validate_default": "SELECT s_suppkey, coalesce(n_name, 'other') AS nation FROM supplier LEFT JOIN nation ON n_name = 'NATION_' || (s_nationkey * 2)",
    "bookmark_join": f"{_WITH}, s AS (SELECT user_id, (event_id * 31) % 1000 AS id, max(ts) AS saved_at FROM events WHERE event_type = 'click' GROUP BY 1, 2) SELECT user_id, id, title, {sql_stamp('saved_at')} AS saved_at FROM s JOIN p USING (id)",
    "anti_join_known": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')",
    "orphan_detection": "WITH t AS (SELECT 'see store/img/' || page_id || '.jpg x' AS body FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT 'raw img/' || page_id || '.jpg' FROM pages WHERE page_id % 50 = 1), o AS (SELECT 'img/' || page_id || '.jpg' AS path, length(html) AS bytes FROM pages) SELECT path, bytes FROM o WHERE NOT EXISTS (SELECT 1 FROM t WHERE contains(body, path))",
    "registry_drift": """WITH a AS (SELECT * FROM nation WHERE n_nationkey % 6 <> 0), b AS (SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN lower(n_name) ELSE n_name END AS n_name, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey % 7 <> 0)
        SELECT n_nationkey, 'only first' AS problem FROM a WHERE n_nationkey NOT IN (SELECT n_nationkey FROM b) UNION ALL SELECT n_nationkey, 'only second' FROM b WHERE n_nationkey NOT IN (SELECT n_nationkey FROM a)
        UNION ALL SELECT a.n_nationkey, 'differs in n_name' FROM a JOIN b USING (n_nationkey) WHERE a.n_name IS DISTINCT FROM b.n_name UNION ALL SELECT a.n_nationkey, 'differs in n_regionkey' FROM a JOIN b USING (n_nationkey) WHERE a.n_regionkey IS DISTINCT FROM b.n_regionkey""",
    "tombstone_conflicts": """WITH l AS (SELECT DISTINCT replace(p_name, ' ', '-') AS key FROM part), g AS (SELECT DISTINCT replace(p_name, ' ', '-') || CASE WHEN p_partkey % 80 = 0 THEN '-0a1b2c' WHEN p_partkey % 3 = 0 THEN '-x' WHEN p_partkey % 7 = 0 THEN '-old' ELSE '' END AS gone FROM part WHERE p_partkey % 40 = 0)
        SELECT gone, CASE WHEN gone IN (SELECT key FROM l) THEN 'live' WHEN gone IN (SELECT replace(p_name, ' ', '-') || '-old' FROM part WHERE p_partkey % 7 = 0) THEN 'retired' WHEN regexp_replace(gone, '-[0-9a-f]{6}$', '') IN (SELECT key FROM l) THEN 'stem' ELSE 'none' END AS conflict FROM g""",
    "event_overview": """WITH s AS (SELECT user_id, ts::DATE AS day, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM events GROUP BY 1, 2), o AS (SELECT count(DISTINCT user_id) AS users, count(*) AS sessions, sum(n)::BIGINT AS views, floor(avg(span) / 1000000)::BIGINT AS s FROM s)
        SELECT users, sessions, views, (s // 60) || 'm ' || (s % 60) || 's' AS mean_session FROM o""",
    "event_daily_active": "WITH u AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS users FROM events GROUP BY 1) SELECT day, users, greatest(4, round(users / greatest(1, max(users) OVER ()) * 100)::INTEGER)::INTEGER AS bar FROM u",
    "event_top_keys": """WITH e AS (SELECT (props->>'$.k')::INTEGER AS k, user_id FROM events), v AS (SELECT k, count(*) AS value FROM e GROUP BY k ORDER BY value DESC, k LIMIT 5), u AS (SELECT k, count(DISTINCT user_id) AS value FROM e GROUP BY k ORDER BY value DESC, k LIMIT 5)
        SELECT 'views' AS measure, row_number() OVER (ORDER BY value DESC, k) AS rank, k, value FROM v UNION ALL SELECT 'users', row_number() OVER (ORDER BY value DESC, k), k, value FROM u""",
    "referrer_class": "WITH h AS (SELECT page_id, regexp_extract(url, '^\\w+://([^/?#]+)', 1) AS host FROM pages) SELECT page_id, host, CASE WHEN host = 'example.com' OR suffix(host, '.example.com') THEN 'com' WHEN host = 'example.net' OR suffix(host, '.example.net') THEN 'net' ELSE 'other' END AS class FROM h",
    "html_strip_text": """WITH s AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script\\b.*?</script>', ' ', 'g'), '(?s)<style\\b.*?</style>', ' ', 'g'), '(?s)<noscript\\b.*?</noscript>', ' ', 'g') AS h FROM pages)
        SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text, nullif(trim(regexp_replace(regexp_extract(html, '(?s)<title\\b[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g')), '') AS title, len(regexp_extract_all(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\\p{L}\\p{N}_]+')) AS words FROM s""",
    "html_links": """WITH l AS (SELECT url, unnest(list_distinct(regexp_extract_all(html, '<a\\s[^>]*href="([^"]+)"', 1))) AS href FROM pages)
        SELECT url, href, CASE WHEN regexp_matches(href, '^\\w+://') THEN href WHEN prefix(href, '//') THEN 'https:' || href WHEN prefix(href, '/') THEN regexp_extract(url, '^(\\w+://[^/?#]+)', 1) || href ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '/') || href END AS target FROM l WHERE NOT prefix(href, '/th')""",
    "feed_items": f"""{_WITH}, t AS (SELECT * FROM p ORDER BY published_at DESC, id DESC LIMIT 50), x AS (SELECT *, CASE WHEN id % 3 > 0 THEN trim(substr(regexp_replace(body, '<[^>]+>', '', 'g'), 1, 60)) END AS description FROM t)
        SELECT id, '<item><title>' || {_XML.format('title')} || '</title><link>https://site.example/item/' || id || '</link><description>' || coalesce({_XML.format('description')}, '') || '</description><pubDate>' || strftime(published_at, '%a, %d %b %Y %H:%M:%S') || ' GMT</pubDate></item>' AS item FROM x""",
    "structured_data": f"""{_WITH} SELECT id, 'NewsArticle' AS type, strftime(published_at, '%Y-%m-%d') AS date, nullif(array_to_string(tags, ', '), '') AS keywords, CASE WHEN id % 2 = 0 THEN 'a' || id ELSE source END AS author, CASE WHEN id % 5 > 0 THEN 2 ELSE 1 END AS steps, CASE WHEN id % 5 > 0 THEN 2 ELSE 1 END AS last FROM articles""",
    "conversation_turns": "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, md5(arg_max(text, (length(text), -turn))) AS longest, sum(length(text))::BIGINT AS signs FROM conversations GROUP BY conv_id",
    "headcounts": f"{_WITH} SELECT count(*) FILTER (NOT is_suppressed) AS visible, count(*) FILTER (published_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR) AS last_day, count(*) FILTER (score IS NULL) AS unscored FROM articles",
    "bookmark_toggle": """WITH e AS (SELECT user_id, event_id % 50 AS id, event_type FROM events), s AS (SELECT DISTINCT user_id, id FROM e WHERE event_type = 'signup'), o AS (SELECT user_id, id FROM e WHERE event_type = 'click' GROUP BY 1, 2 HAVING count(*) % 2 = 1)
        (SELECT * FROM s EXCEPT SELECT * FROM o) UNION ALL (SELECT * FROM o EXCEPT SELECT * FROM s)""",
}
