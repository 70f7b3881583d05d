"""Catalogue: trimming and fields of texts, names of stored files, odd dates, model phases, files written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import gates, models, reads, upkeep
from ..sources import files, registry, rules
from ..storage import table_path
from ..tables import ARTICLES_SQL, NOW, PUBLISHED_SQL, articles, sql_stamp, stamp, table

RULES = [(r"\bthe\b", "THE"), (r"(\w)ing\b", "$1in"), (r"THE THE", "THE")]


def text_trimming(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("flat", F.replace("text", F.lit("\n"), F.lit(" ")))
    bylined = F.concat(F.lit("By Ann Other\n12 March 2024\n\n\n"), F.col("text"), F.lit("\n\n\n\nYazan: X\n3-May-2024\nend"))
    promoted = F.concat(F.lit("Subscribe now\n\nKept one\n \nfollow us here\n\n"), F.col("text"))
    cut = lambda c: F.md5(F.coalesce(c, F.lit("")))
    return docs.select("doc_id", cut(T.strip_byline(bylined)).alias("byline"), cut(T.cap_title("flat")).alias("title"), cut(T.cut_at_sentence("flat", 40)).alias("sentence"), cut(T.wrap_paragraphs("text")).alias("paragraphs"), cut(T.regroup_sentences("flat")).alias("groups"), cut(T.fix_words("flat", RULES)).alias("words"), cut(T.drop_promotions(promoted)).alias("promotions"))


def contact_fields(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    made = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Ref. AB-"), n, F.lit("/24 more"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("see No: X9"), n, F.lit("99"))).otherwise(F.concat(F.lit("no. "), F.col("source")))
    parts = F.array(F.lit("Budget"), n, F.lit("The DEADLINE is"), F.concat(F.lit(" day "), n), F.when(F.col("doc_id") % 2 == 0, "Closing date").otherwise("x"))
    return table(spark, d, "documents").select("doc_id", T.first_email(F.concat(F.lit("mailto:"), "text")).alias("email"), T.reference_number(made).alias("reference"), T.value_after_label(parts, "deadline").alias("deadline"), T.value_after_label(parts, "closing").alias("closing"))


def storage_names(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.col("title"), F.lit(' <figure class="injected">a\nb</figure> see store/'), F.col("id").cast("string"), F.lit('/a.jpg, <figure class="injected"></figure> and store/x-1.png; store/'), F.when(F.col("id") % 2 == 0, "\n\nSource: here").otherwise(""))
    left, n = T.remove_figures(body)
    return articles(spark, d).select("id", T.storage_path("source", "published_at", "id", F.concat(F.lit("Été & "), F.col("tab"), F.lit(" .JPG"))).alias("path"), F.array_join(T.object_paths(body, "store"), " ").alias("objects"), left.alias("left"), n.alias("figures"), T.append_citation(body, F.concat(F.lit("https://x/"), F.col("id").cast("string"))).alias("cited"))


def odd_dates(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate")
    inside = F.when(F.col("o_orderkey") % 5 == 0, "no 1-2-2024 date").otherwise(F.concat(F.lit("on "), F.date_format(day, "dd-MM-yyyy"), F.lit(" at noon")))
    zoned = F.concat(F.date_format(day, "d-MMM-yyyy"), F.lit(" 23:30 (GMT "), F.when(F.col("o_orderkey") % 2 == 0, "-4.00").otherwise("5.50"), F.lit(")"))
    rows = table(spark, d, "orders").select("o_orderkey", V.embedded_date(inside).alias("inside"), zoned.alias("zoned")).withColumn("zoned", V.zoned_date("zoned"))
    return rows.select("o_orderkey", F.date_format("inside", "yyyy-MM-dd").alias("inside"), stamp("zoned").alias("zoned"))


def _documents(rows: DataFrame, entry: str, before: str, after: str, path: str) -> None:
    """Files of whole XML documents, each with the entries of an eighth of the rows."""
    made = rows.groupBy(F.pmod(F.xxhash64(entry), F.lit(8))).agg(F.concat(F.lit(before), F.array_join(F.collect_list(entry), ""), F.lit(after)).alias("value"))
    made.select("value").write.option("maxRecordsPerFile", 1).text(path)


def finalise_reasons(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 6
    html = F.when(k == 0, "<p> </p>").when(k == 1, F.concat(F.lit("<h2>Q</h2><p>"), "text", F.lit("</p>"))).when(k == 2, F.concat(F.lit("<p>"), "text", F.lit(".</p>"))).when(k == 3, F.concat(F.lit("<H2 id='a'>Q</H2><p>"), "text", F.lit('."</p> '))).when(k == 4, F.concat(F.lit("<h2>Q</h2>"), "text", F.lit("!")))
    rows = table(spark, d, "documents").select("doc_id", html.alias("html"), (F.col("doc_id") % 12 == 4).alias("foreign"))
    return rows.select("doc_id", gates.finalise("html", F.col("foreign")).alias("reason"), gates.few_headings("html", 2).alias("few"))


WORDS = [("idiot", "BLOCK rude"), ("eau", "sports"), ("the", "news")]


def model_phases(spark: SparkSession, d: str) -> DataFrame:
    """Two phases with a model by keywords: long texts are asked, others get a fixed answer; what answers let pass, their validated class, and rewrites."""
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 13 != 0, F.col("text")).alias("prompt"))
    told = models.ask_survivors(rows, F.length("prompt") > 300, "prompt", "answer", models.KeywordModel(WORDS), "short")
    rewritten = F.when(F.col("doc_id") % 3 == 0, F.substring("prompt", 1, 100)).when(F.col("doc_id") % 3 == 1, F.reverse("prompt"))
    return told.select("doc_id", models.verdict(F.col("answer")).alias("passes"), models.validated(F.col("answer"), ["news", "short"], "other").alias("kind"), F.length(models.accept_rewrite(F.col("prompt"), rewritten)).alias("length"))


def whole_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers that must end with a closing sign; rows answered under the same hash keep theirs."""
    rows = table(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 4 == 0, F.md5("text")).when(F.col("doc_id") % 4 == 1, "old").alias("hash"), F.lit("kept").alias("answer"))
    model = models.KeywordModel([("idiot", "cut off"), ("eau", "Whole."), ("the", 'Told "so".')], "no end")
    return models.ask_whole(rows, "text", "answer", model, "hash").select("doc_id", "answer")


def best_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Of several attempts at a key the one with most values."""
    tries = table(spark, d, "events").groupBy((F.col("user_id") % 97).alias("k"), F.pmod("event_id", F.lit(4)).cast("int").alias("attempt")).agg(F.array_sort(F.collect_set(F.date_format("ts", "dd"))).alias("days"))
    return models.best_attempt(tries, "k", "days", "attempt").select("k", F.array_join("days", ",").alias("days"))


def feed_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The published articles as feeds, written and read back."""
    path = table_path(spark, "feed")
    rows = reads.published(articles(spark, d)).withColumn("description", F.when(F.col("id") % 2 == 0, F.col("source")))
    _documents(files.feed_items(rows, "https://x.example"), "item", "<rss version='2.0'><channel><title>t</title>", "</channel></rss>", path)
    return files.read_feed(spark, path, "item").select("link", F.regexp_replace("title", r"\s+", " ").alias("title"), "description", stamp("published_at").alias("published_at"))


def sitemap_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = table_path(spark, "map")
    rows = articles(spark, d).select(F.concat(F.lit("<url><loc> https://x.example/"), F.col("id").cast("string"), F.lit(" </loc>"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("<lastmod>"), F.date_format("published_at", "yyyy-MM-dd"), F.lit("</lastmod>"))).otherwise(""), F.lit("</url>")).alias("value"))
    _documents(rows, "value", "<urlset>", "</urlset>", path)
    return files.read_sitemap(spark, path).select("loc", F.date_format("published_at", "yyyy-MM-dd").alias("day"))


def delimited_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = table_path(spark, "rows")
    part = table(spark, d, "part")
    rows = part.select(F.col("p_partkey").cast("string").alias("id"), F.lit("1").alias("version"), F.concat(F.lit(":TR: "), "p_name").alias("name")).unionByName(part.filter("p_partkey % 5 = 0").select(F.col("p_partkey").cast("string").alias("id"), F.lit("1").alias("version"), F.concat(F.lit(":TR: "), "p_name").alias("name")))
    rows.write.csv(path, sep="\t", header=True)
    return files.read_delimited(spark, path).select("id", "name")


def log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Events as log files, and how often what stands in all of them."""
    path = table_path(spark, "logs")
    line = F.concat(F.date_format("ts", "HH:mm:ss"), F.lit(" "), F.when(F.col("event_type") == "view", "published item").otherwise(F.concat(F.lit("dropped: "), "event_type")))
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    found = files.read_logs(spark, path, {"published": r"\bpublished\b", "dropped": r"dropped: \w+", "night": r"(?m)^0[0-4]:"})
    sizes = files.list_objects(spark, path).filter("path like '%part-%'").agg(F.sum("bytes").alias("bytes"))
    return found.agg(F.sum("published").alias("published"), F.sum("dropped").alias("dropped"), F.sum("night").alias("night")).join(sizes)


def vocabulary_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Names as a word list with headings, remarks and list marks."""
    path = table_path(spark, "words")
    made = F.concat(F.when(F.col("p_partkey") % 7 == 0, "# heading, none\n\n").otherwise(""), F.when(F.col("p_partkey") % 2 == 0, "- ").otherwise(""), F.lit("**"), F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit("** (remark), x"))
    table(spark, d, "part").select(made.alias("value")).write.text(path)
    return files.read_vocabulary(spark, path).select("term")


def news_sitemap_xml(spark: SparkSession, d: str) -> DataFrame:
    since = F.lit(NOW).cast("timestamp_ntz") - F.expr("interval 48 hours")
    return files.news_sitemap(reads.published(articles(spark, d)), "https://x.example", "X News", "en", since, most=20, title_size=30)


def report_cards_images(spark: SparkSession, d: str) -> DataFrame:
    rows = articles(spark, d).withColumn("body", F.concat(F.lit("<p class='a b'>"), "body", F.lit("</p>")))
    status = F.when(F.col("id") % 7 == 0, "404").when(F.col("id") % 7 == 1, "ERR").when(F.col("id") % 7 > 2, "200")
    return gates.report_card(rows, image_status=status)


def image_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of pictures rewritten by their source's rule: what a first and a second run change."""
    k = F.col("p_partkey") % 5
    source = F.element_at(F.array(F.lit("ecofin"), F.lit("business_in_cameroon"), F.lit("undp")), (F.col("p_partkey") % 3 + 1).cast("int"))
    url = F.concat(F.lit("https://i/"), F.col("p_partkey").cast("string"), F.when(k == 0, "_S.jpg").when(k == 1, "_Generic.jpg").when(k == 2, "_XL.jpg").when(k == 3, "_S.png"))
    rows = table(spark, d, "part").select("p_partkey", source.alias("source"), url.alias("image"), url.alias("old"))
    once = rules.rewritten(rows, registry.shipped(spark), "image").withColumn("first", upkeep.rewrite_status(F.col("old"), F.col("image"))).withColumn("old", F.col("image"))
    twice = rules.rewritten(once, registry.shipped(spark), "image")
    return twice.groupBy("source", "first", upkeep.rewrite_status(F.col("old"), F.col("image")).alias("second")).agg(F.count(F.lit(1)).alias("n"))


def photo_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Four steps: pictures for the title, for its region, articles' pictures for the title, for its region; some searches fail, some pictures are in use."""
    k, key = F.col("id"), F.col("id").cast("string")
    found = lambda salt, n, fails: F.when(k % fails != 0, F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit(f"{salt}/"), (k * 7 % 50 + i).cast("string"))))
    steps = [found("photo", 2, 2), F.when(F.col("tab") != "tab1", found("region", 2, 3)), found("article", 1, 5), F.when(F.col("tab") != "tab1", F.array(F.concat(F.lit("last/"), key)))]
    used = F.array(*(F.lit(f"{s}/{i}") for s in ("photo", "region", "article") for i in range(0, 60, 2)))
    got = upkeep.fallback_photo(steps, used)
    return articles(spark, d).select("id", got["url"].alias("url"), got["step"].alias("step"))


QUERIES = {f.__name__: f for f in (text_trimming, contact_fields, storage_names, odd_dates, finalise_reasons, model_phases, whole_answers, best_attempts, feed_round_trip, sitemap_round_trip, delimited_round_trip, log_round_trip, vocabulary_round_trip, news_sitemap_xml, report_cards_images, image_backfill, photo_fallback)}

_WITH = f"WITH {ARTICLES_SQL}"
_ENDS = ", ".join("'" + c + "'" for c in gates.ENDINGS)
_BODY = "title || ' <figure class=\"injected\">a' || chr(10) || 'b</figure> see store/' || id || '/a.jpg, <figure class=\"injected\"></figure> and store/x-1.png; store/' || CASE WHEN id % 2 = 0 THEN chr(10) || chr(10) || 'Source: here' ELSE '' END"
_KEY = "CASE WHEN contains(lower(p), 'idiot') THEN {} WHEN contains(lower(p), 'eau') THEN {} WHEN contains(lower(p), 'the') THEN {} ELSE {} END"
ORACLE = {
    "text_trimming": rf"""WITH t AS (SELECT doc_id, text, replace(text, chr(10), ' ') AS flat, 'By Ann Other' || chr(10) || '12 March 2024' || repeat(chr(10), 3) || text || repeat(chr(10), 4) || 'Yazan: X' || chr(10) || '3-May-2024' || chr(10) || 'end' AS bylined FROM documents),
        h AS (SELECT *, string_split_regex(trim(flat), '\s+') AS parts, array_to_string(string_split_regex(trim(flat), '\s+')[1:40], ' ') AS head, list_filter(string_split(regexp_replace(flat, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS said FROM t)
        SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(bylined, '(?m)^(?:By|Par|Por|Yazan)[ :][^\n]{{1,60}}$', '', 'g'), '(?m)^\d{{1,2}}[ ./-]\w{{2,12}}[ ./-]\d{{4}}$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'))) AS byline,
        md5(CASE WHEN length(flat) > 120 THEN regexp_replace(regexp_replace(substr(flat, 1, 120), '\s+\S*$', ''), '[ ,;:.-]+$', '') ELSE flat END) AS title,
        md5(CASE WHEN len(parts) > 40 AND regexp_matches(head, '[.!?]') THEN regexp_extract(head, '(?s)^(.*[.!?])', 1) ELSE flat END) AS sentence,
        md5(array_to_string(list_transform(list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda b: trim(b)), lambda b: b <> ''), lambda b: '<p>' || b || '</p>'), chr(10))) AS paragraphs,
        md5(CASE WHEN len(regexp_extract_all(flat, '\S+')) >= 180 THEN array_to_string(list_transform(range(1, len(said) + 1, greatest(1, ceil(len(said) / 5.0))::BIGINT), lambda i: array_to_string(said[i : i + greatest(1, ceil(len(said) / 5.0))::BIGINT - 1], ' ')), chr(10) || chr(10)) ELSE flat END) AS groups,
        md5(regexp_replace(regexp_replace(regexp_replace(flat, '\bthe\b', 'THE', 'g'), '(\w)ing\b', '\1in', 'g'), 'THE THE', 'THE', 'g')) AS words,
        md5(array_to_string(list_filter(string_split_regex('Subscribe now' || chr(10) || chr(10) || 'Kept one' || chr(10) || ' ' || chr(10) || 'follow us here' || chr(10) || chr(10) || text, '\n\s*\n'), lambda b: NOT (length(b) < 500 AND regexp_matches(b, '(?i)(?:subscribe|newsletter|read more|follow us|sign up|abonnez|inscreva)'))), chr(10) || chr(10))) AS promotions FROM h""",
    "contact_fields": r"""SELECT doc_id, regexp_extract(regexp_replace('mailto:' || text, '(?i)mailto:', '', 'g'), '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', 1) AS email,
        CASE doc_id % 3 WHEN 0 THEN 'AB-' || doc_id || '/24' WHEN 1 THEN 'X9' || doc_id || '99' ELSE regexp_extract(source, '^[A-Za-z0-9][A-Za-z0-9/_-]{3,}') END AS reference, 'day ' || doc_id AS deadline, NULL::VARCHAR AS closing FROM documents""",
    "storage_names": f"""{_WITH}, b AS (SELECT *, {_BODY} AS made FROM articles) SELECT id, source || '/' || strftime(published_at, '%Y') || '/' || strftime(published_at, '%m') || '/' || id || '/' || regexp_replace(lower('Été & ' || tab || ' .JPG'), '[^a-z0-9._-]+', '-', 'g') AS path,
        id || '/a.jpg x-1.png' AS objects, replace(replace(made, '<figure class="injected">a' || chr(10) || 'b</figure>', ''), '<figure class="injected"></figure>', '') AS left, 2 AS figures, CASE WHEN contains(made, 'Source:') THEN made ELSE made || chr(10) || chr(10) || 'Source: https://x/' || id END AS cited FROM b""",
    "odd_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS inside, strftime(date_trunc('day', o_orderdate) + INTERVAL 1410 MINUTE + CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 240 MINUTE ELSE INTERVAL (-330) MINUTE END, '%Y-%m-%d %H:%M:%S') AS zoned FROM orders",
    "finalise_reasons": f"""WITH h AS (SELECT doc_id, doc_id % 12 = 4 AS foreign_, CASE doc_id % 6 WHEN 0 THEN '<p> </p>' WHEN 1 THEN '<h2>Q</h2><p>' || text || '</p>' WHEN 2 THEN '<p>' || text || '.</p>' WHEN 3 THEN '<H2 id=''a''>Q</H2><p>' || text || '."</p> ' WHEN 4 THEN '<h2>Q</h2>' || text || '!' END AS html FROM documents),
        p AS (SELECT *, regexp_replace(html, '<[^>]+>', ' ', 'g') AS plain FROM h) SELECT doc_id, CASE WHEN trim(coalesce(plain, '')) = '' THEN 'empty' WHEN foreign_ THEN 'language' WHEN right(rtrim(plain), 1) NOT IN ({_ENDS}) THEN 'truncated' WHEN len(regexp_extract_all(html, '(?i)<h2[ >]')) < 1 THEN 'headings' END AS reason, len(regexp_extract_all(html, '(?i)<h2[ >]')) < 2 AS few FROM p""",
    "model_phases": f"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN text END AS p FROM documents), a AS (SELECT *, CASE WHEN length(p) > 300 THEN {_KEY.format("'BLOCK rude'", "'sports'", "'news'", "NULL")} ELSE 'short' END AS answer, CASE doc_id % 3 WHEN 0 THEN substr(p, 1, 100) WHEN 1 THEN reverse(p) END AS new FROM r)
        SELECT doc_id, coalesce(NOT prefix(upper(answer), 'BLOCK'), true) AS passes, CASE WHEN answer IN ('news', 'short') THEN answer ELSE 'other' END AS kind, CASE WHEN coalesce(length(new) >= 0.3 * length(p), false) THEN length(new) ELSE length(p) END::INTEGER AS length FROM a""",
    "whole_answers": f"""WITH r AS (SELECT doc_id, text AS p FROM documents) SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'kept' ELSE {_KEY.format("NULL", "'Whole.'", "'Told " + chr(34) + "so" + chr(34) + ".'", "NULL")} END AS answer FROM r""",
    "best_attempts": "WITH a AS (SELECT user_id % 97 AS k, event_id % 4 AS attempt, list_sort(list_distinct(list(strftime(ts, '%d')))) AS days FROM events GROUP BY 1, 2) SELECT k, array_to_string(days, ',') AS days FROM a QUALIFY row_number() OVER (PARTITION BY k ORDER BY len(days) DESC, attempt) = 1",
    "feed_round_trip": f"{_WITH} SELECT 'https://x.example/item/' || id AS link, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, CASE WHEN id % 2 = 0 THEN source ELSE '' END AS description, {sql_stamp('published_at')} AS published_at FROM articles WHERE {PUBLISHED_SQL}",
    "sitemap_round_trip": f"{_WITH} SELECT 'https://x.example/' || id AS loc, CASE WHEN id % 3 = 0 THEN strftime(published_at, '%Y-%m-%d') END AS day FROM articles",
    "delimited_round_trip": "SELECT p_partkey::VARCHAR AS id, trim(p_name) AS name FROM part",
    "log_round_trip": "SELECT count(*) FILTER (event_type = 'view') AS published, count(*) FILTER (event_type <> 'view') AS dropped, count(*) FILTER (hour(ts) < 5) AS night, sum(10 + length(CASE WHEN event_type = 'view' THEN 'published item' ELSE 'dropped: ' || event_type END))::BIGINT AS bytes FROM events",
    "vocabulary_round_trip": "SELECT DISTINCT w AS term FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE length(w) > 1",
    "news_sitemap_xml": f"""{_WITH}, n AS (SELECT * FROM articles WHERE {PUBLISHED_SQL} AND published_at >= TIMESTAMP '{NOW}' - INTERVAL 48 HOUR ORDER BY published_at DESC, id DESC LIMIT 20)
        SELECT '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:news="http://www.google.com/schemas/sitemap-news/0.9">' || coalesce(string_agg('<url><loc>https://x.example/item/' || id || '</loc><news:news><news:publication><news:name>X News</news:name><news:language>en</news:language></news:publication><news:publication_date>'
               || strftime(published_at, '%Y-%m-%dT%H:%M:%S+00:00') || '</news:publication_date><news:title>' || replace(replace(replace(replace(replace(substr(title, 1, 30), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '\'\'', '&apos;') || '</news:title></news:news></url>', '' ORDER BY published_at DESC, id DESC), '') || '</urlset>' AS xml FROM n""",
    "report_cards_images": f"{_WITH} SELECT source, count(*) AS n, count(*) FILTER (len(regexp_extract_all(regexp_replace(body, '<[^>]+>', ' ', 'g'), '\\S+')) >= 250 AND trim(title) <> '' AND id % 7 > 2) AS good, good >= least(4, n) AS passed FROM articles GROUP BY source",
    "image_backfill": "SELECT ['ecofin', 'business_in_cameroon', 'undp'][p_partkey % 3 + 1] AS source, CASE WHEN p_partkey % 5 = 4 THEN 'none' WHEN (p_partkey % 3 = 0 AND p_partkey % 5 IN (0, 2)) OR (p_partkey % 3 = 1 AND p_partkey % 5 IN (0, 1)) THEN 'changed' ELSE 'skipped' END AS first, CASE WHEN p_partkey % 5 = 4 THEN 'none' ELSE 'skipped' END AS second, count(*) AS n FROM part GROUP BY ALL",
    "photo_fallback": f"""{_WITH}, s AS (SELECT id, tab, id * 7 % 50 AS b FROM articles),
        c AS (SELECT id, unnest([1, 1, 2, 2, 3, 4]) AS step, unnest([0, 1, 2, 3, 4, 5]) AS turn, unnest([CASE WHEN id % 2 <> 0 THEN 'photo/' || (b + 1) END, CASE WHEN id % 2 <> 0 THEN 'photo/' || (b + 2) END, CASE WHEN tab <> 'tab1' AND id % 3 <> 0 THEN 'region/' || (b + 1) END, CASE WHEN tab <> 'tab1' AND id % 3 <> 0 THEN 'region/' || (b + 2) END,
              CASE WHEN id % 5 <> 0 THEN 'article/' || (b + 1) END, CASE WHEN tab <> 'tab1' THEN 'last/' || id END]) AS url FROM s),
        f AS (SELECT *, split_part(url, '/', 2)::BIGINT % 2 = 0 AND step < 4 AS used FROM c)
        SELECT s.id, arg_min(url, turn) FILTER (url IS NOT NULL AND NOT used) AS url, min(step) FILTER (url IS NOT NULL AND NOT used)::INTEGER AS step FROM s LEFT JOIN f USING (id) GROUP BY s.id""",
}
