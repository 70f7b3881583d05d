"""Catalogue: text, gates, duplicates, dates, money, hashes, arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import text as T
from ..functions import values as V
from ..operators import changes, gates, metrics, reads, similarity
from ..tables import ARTICLES_SQL, NOW, PUBLISHED_SQL, articles, sql_md5_mod, sql_stamp, stamp, table

REASONS = ["duplicate", "min_content", "low_score", "truncated", "language"]


def slug_base(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.slug("text").alias("slug"))


def slug_unique_allocation(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", T.slug("p_name").alias("base"))
    turn = F.col("p_partkey") % 15
    taken = parts.filter("p_partkey % 5 = 0").select(F.when(turn == 0, F.col("base")).when(turn == 5, F.concat("base", F.lit("-3"))).otherwise(F.concat("base", F.lit("-4"))).alias("key")).distinct()
    return changes.allocate_keys(parts, "base", [F.col("p_partkey")], taken).select("p_partkey", "key")


def word_count_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.count_runs("text").cast("long").alias("words"), T.count_blank_separated("text").cast("long").alias("blank_words"), gates.min_content("text").alias("dropped"))


def language_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents")
    return rows.select("doc_id", F.round(gates.stopword_ratio("text", gates.ENGLISH), 6).alias("ratio"), gates.not_english("text").alias("not_english"), gates.not_language("text", "éèêçà", ["le", "la", "de", "et", "des"]).alias("not_french"))


def truncation_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", gates.truncated("text").alias("truncated"))


def _judged(spark, d):
    """Flags of each article; bodies are read for them where they lie, and only (id, hash, flags) meet to find copies."""
    rows = articles(spark, d)
    flags = {"min_content": gates.min_content("body"), "low_score": gates.low_score("score"), "truncated": gates.truncated("body"), "language": gates.not_english("body") & (F.col("lang") == "en")}
    slim = rows.select("id", "source", "lang", "score", F.md5("body").alias("h"), *(c.alias(f"__{n}") for n, c in flags.items()))
    # Copies are told by their ids alone: a hash that many rows share is one row here.
    firsts = slim.groupBy("h").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("__first"))
    marked = slim.join(firsts, "id", "left")
    return gates.run_gates(marked, [("duplicate", F.col("__first").isNull()), *((n, F.col(f"__{n}")) for n in flags)])


def gate_funnel(spark: SparkSession, d: str) -> DataFrame:
    return gates.funnel(_judged(spark, d), REASONS)


def funnel_totals(spark: SparkSession, d: str) -> DataFrame:
    return gates.with_total(gates.funnel(_judged(spark, d), REASONS))


def yield_alerts(spark: SparkSession, d: str) -> DataFrame:
    judged = _judged(spark, d).withColumn("source", F.concat_ws("/", "source", "lang"))
    return gates.yield_alert(gates.funnel(judged, REASONS), 3).select("source", "scraped")


def exact_dedup_status(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("url"), "text")
    stored = rows.filter("url % 3 <> 0").select("url", F.when(F.col("url") % 3 == 1, F.md5("text")).otherwise("old").alias("content_hash"))
    return gates.status_by_hash(rows, stored, "url", "text").select(F.col("url").alias("doc_id"), "status")


def near_dup_window(spark: SparkSession, d: str) -> DataFrame:
    return similarity.near_before(articles(spark, d), 48).select("id", "earlier_id", F.round("similarity", 6).alias("similarity"))


def near_dup_newest(spark: SparkSession, d: str) -> DataFrame:
    rows = articles(spark, d)
    stored = rows.filter("id % 2 = 0 AND NOT is_suppressed")
    now = F.lit(NOW).cast("timestamp_ntz")
    out = similarity.near_newest(rows.filter("id % 2 = 1 OR id % 10 = 0"), stored, now - F.expr("interval 96 hours"), 400)
    return out.select("id", "duplicate_of", F.round("similarity", 6).alias("similarity"))


def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return similarity.near_pairs(articles(spark, d)).select("a", "b", F.round("similarity", 6).alias("similarity"))


def benchmark_overlap(spark: SparkSession, d: str) -> DataFrame:
    return similarity.overlap(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text").withColumnRenamed("id", "doc_id")


def hash_bucket_assign(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("content_hash"), V.md5_mod(key, 7).alias("bucket"), V.md5_mod(key, 1000003).alias("wide"))


AUTHORS = ["ada", "bela", "cem", "dora", "ege", "fuat", "gul"]


def rule_assignment(spark: SparkSession, d: str) -> DataFrame:
    rules = [(F.col("tab") == "tab1", F.lit("desk")), ((F.col("tab") == "tab2") & (F.size("tags") >= 8), F.lit("tagged")), (F.col("source").isin("src0", "src1"), F.concat(F.lit("house-"), "source"))]
    author = metrics.assign_by_rules(rules, metrics.author_for(F.col("id").cast("string"), AUTHORS))
    return articles(spark, d).select("id", author.alias("author"))


REMAP = {"disgusting": "rude", "worthless": "rude", "thanedble": None}


def array_remap(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).select("id", F.array_join(V.remap("tags", REMAP), "|").alias("tags"), F.array_join(V.allow("tags", ["disgusting", "worthless", "thanedble", "aeronreth"], 3), "|").alias("allowed"))


def category_label(spark: SparkSession, d: str) -> DataFrame:
    label = reads.category_label(F.col("tab"), F.col("tags"), ["tab0", "tab4"], "^(?:a|c)")
    return articles(spark, d).select("id", label.alias("label"))


KEYWORDS = [("paint", "red|green|blue"), ("small", "small|tiny"), ("goods", "widget|ring|gear|bolt")]


def keyword_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", metrics.keyword_category(F.concat_ws(" ", "p_name", "p_type"), KEYWORDS, "other").alias("category"))


def budget_extract(spark: SparkSession, d: str) -> DataFrame:
    price, key = F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.col("o_orderkey") % 7
    words = F.when(key == 0, F.concat(F.lit("Budget: USD "), price, F.lit(" in all"))).when(key == 1, F.concat(F.lit("about EUR "), price, F.lit(" million"))).when(key == 2, F.concat(F.lit("GBP "), price, F.lit(" or USD ."))).when(key == 3, F.concat(F.lit("CHF "), price, F.lit(" billion")))
    words = words.when(key == 4, F.concat(F.lit("worth us$ "), price, F.lit("m"))).when(key == 5, "2,500.00 Million usd, or EUR 3").otherwise("none")
    return table(spark, d, "orders").withColumn("words", words).select("o_orderkey", F.round(V.budget_usd("words"), 2).alias("usd"))


def date_parse_multi(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey") % 6
    made = F.when(key == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(key == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).when(key == 2, F.date_format("o_orderdate", "dd MMM yyyy")).when(key == 3, F.date_format("o_orderdate", "EEE, dd MMM yyyy")).when(key == 4, F.concat(F.lit("Expire le "), F.date_format("o_orderdate", "dd-MM-yyyy"))).otherwise("soon")
    rows = table(spark, d, "orders").withColumn("made", made)
    return rows.select("o_orderkey", F.date_format(F.coalesce(V.parse_date("made"), V.embedded_date("made")), "yyyy-MM-dd").alias("day"))


def reading_time(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", V.reading_minutes("text").alias("minutes"), T.meta_band("text").alias("band"), T.cap_words("text", 5).alias("head"))


def text_cleaning(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit("LONDON (Agency) — "), F.col("text"), F.lit(" -- done – now"), F.lit(" & <b>\"x\"</b> summary: y"))
    rows = table(spark, d, "documents").withColumn("made", made)
    return rows.select("doc_id", T.dashes_to_commas(T.strip_dateline("made")).alias("dashes"), T.escape_xml("made").alias("escaped"), T.excerpt("made", 40).alias("excerpt"), T.strip_label("made").alias("unlabelled"))


def image_variants(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 40).alias("width"), F.concat(F.lit("https://img.example/a/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-300x200.JPG?x=1")).alias("url"))
    widths = T.variant_widths("width")
    return rows.select("p_partkey", F.array_join(F.transform(widths, lambda w: w.cast("string")), ",").alias("widths"), T.image_stem("url").alias("stem"), P.noise_image(F.col("url")).alias("noise"))


def image_distance(spark: SparkSession, d: str) -> DataFrame:
    bits = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "f").otherwise("0")), "")
    rows = table(spark, d, "embeddings").select("vec_id", bits.alias("h"))
    a, b = rows, rows.select(F.col("vec_id").alias("other"), F.col("h").alias("h2"))
    near = a.join(b, F.col("other") == F.col("vec_id") + 1)
    return near.select("vec_id", "other", V.hamming_hex("h", "h2").cast("long").alias("bits"))


def image_matches(spark: SparkSession, d: str) -> DataFrame:
    stem = F.md5((F.col("p_partkey") % 700).cast("string"))
    h = F.concat(stem, F.substring(stem, 1, 30), F.lpad(F.conv((F.col("p_partkey") * 37 % 256).cast("string"), 10, 16), 2, "0"))
    return similarity.hash_matches(table(spark, d, "part").select("p_partkey", h.alias("h")), "p_partkey", "h", 4)


QUERIES = {f.__name__: f for f in (image_matches, slug_base, slug_unique_allocation, word_count_gate, language_gate, truncation_gate, gate_funnel, funnel_totals, yield_alerts, exact_dedup_status, near_dup_window, near_dup_newest, near_duplicates, benchmark_overlap, hash_bucket_assign, rule_assignment, array_remap, category_label, keyword_category, budget_extract, date_parse_multi, reading_time, text_cleaning, image_variants, image_distance)}

_WITH = f"WITH {ARTICLES_SQL}"
_SLUG = "regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(translate({t}, 'çşığöüÇŞİĞÖÜ', 'csigoucsigou')), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9_\\s\\x1c-\\x1f-]', '', 'g'), '[\\s\\x1c-\\x1f_]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), '-+$', '')"
_RUNS = "len(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+'))"
_PLAIN = "regexp_replace({t}, '<[^>]+>', ' ', 'g')"


def _ratio(t: str, words: list[str]) -> str:
    return f"(len(list_filter(string_split_regex(lower({t}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ({', '.join(map(repr, words))})))::DOUBLE / greatest(1, {_RUNS.format(t=t)}))"


def _not_english(t: str) -> str:
    return f"({_RUNS.format(t=t)} >= 50 AND {_ratio(t, gates.ENGLISH)} <= 0.08)"


def _truncated(t: str) -> str:
    return f"(right(rtrim(regexp_replace(rtrim({t}), '\\n+(?:Source|Kaynak)[^\\n]*$', '')), 1) NOT IN ({', '.join(chr(39) + c + chr(39) for c in gates.ENDINGS)}))"


_JUDGED = f"""{_WITH}, j AS (SELECT *, CASE WHEN id <> min(id) OVER (PARTITION BY md5(body)) THEN 'duplicate' WHEN {_RUNS.format(t=_PLAIN.format(t='body'))} < 100 THEN 'min_content'
    WHEN least(10, greatest(1, coalesce(score, 5))) < 6 THEN 'low_score' WHEN {_truncated('body')} THEN 'truncated' WHEN lang = 'en' AND {_not_english('body')} THEN 'language' END AS reason FROM articles)"""
_COUNTS = "count(*) AS scraped, " + ", ".join(f"count(*) FILTER (reason = '{r}') AS dropped_{r}" for r in REASONS) + ", count(*) FILTER (reason IS NULL) AS published, round(avg(score) FILTER (reason IS NULL), 1) AS avg_score"
_SH = """{n} AS (SELECT {id} AS id, {extra} list_filter(string_split_regex(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM {src}),
    {n}s AS MATERIALIZED (SELECT id, {extra} list_distinct(list_transform(range(1, (len(w) - 3)::BIGINT), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM {n} WHERE len(w) >= 5)"""
_SIMILAR = f"""{_WITH}, {_SH.format(n='x', id='id', t='body', src='articles', extra='published_at,')},
    c AS MATERIALIZED (SELECT *, min(id) OVER (PARTITION BY list_sort(s)) AS rep FROM xs),
    p AS (SELECT id, unnest(s) AS g FROM c WHERE id = rep), f AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM p a JOIN p b USING (g) WHERE a.id < b.id GROUP BY 1, 2),
    l AS (SELECT a, b, n::DOUBLE / (len(u.s) + len(v.s) - n) AS similarity FROM f JOIN c u ON u.id = a JOIN c v ON v.id = b WHERE n::DOUBLE / (len(u.s) + len(v.s) - n) >= 0.8)"""

ORACLE = {
    "image_matches": """WITH p AS (SELECT p_partkey % 700 AS stem, (p_partkey * 37) % 256 AS tail, min(p_partkey) AS id FROM part GROUP BY 1, 2)
        SELECT a.id AS a, b.id AS b, bit_count(xor(a.tail, b.tail)::BIGINT)::BIGINT AS bits FROM p a JOIN p b ON a.stem = b.stem AND a.id < b.id WHERE bit_count(xor(a.tail, b.tail)::BIGINT) <= 4""",
    "slug_base": f"SELECT doc_id, {_SLUG.format(t='text')} AS slug FROM documents",
    "slug_unique_allocation": f"""WITH b AS (SELECT p_partkey, {_SLUG.format(t="p_name")} AS base FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS k FROM b),
        t AS (SELECT DISTINCT CASE p_partkey % 15 WHEN 0 THEN base WHEN 5 THEN base || '-3' ELSE base || '-4' END AS key FROM b WHERE p_partkey % 5 = 0),
        c AS (SELECT base, i, CASE WHEN i = 1 THEN base ELSE base || '-' || i END AS key FROM (SELECT base, unnest(range(1, (count(*) + 10)::BIGINT)) AS i FROM b GROUP BY base)),
        f AS (SELECT base, key, row_number() OVER (PARTITION BY base ORDER BY i) AS k FROM c WHERE key NOT IN (SELECT key FROM t)) SELECT p_partkey, key FROM n JOIN f USING (base, k)""",
    "word_count_gate": f"SELECT doc_id, {_RUNS.format(t='text')} AS words, len(regexp_extract_all(text, '\\S+')) AS blank_words, {_RUNS.format(t=_PLAIN.format(t='text'))} < 100 AS dropped FROM documents",
    "language_gate": f"SELECT doc_id, round({_ratio('text', gates.ENGLISH)}, 6) AS ratio, {_not_english('text')} AS not_english, ({_RUNS.format(t='text')} >= 50 AND len(regexp_extract_all(text, '[éèêçà]'))::DOUBLE / greatest(1, length(text)) <= 0.05 AND {_ratio('text', ['le', 'la', 'de', 'et', 'des'])} <= 0.04) AS not_french FROM documents",
    "truncation_gate": f"SELECT doc_id, {_truncated('text')} AS truncated FROM documents",
    "gate_funnel": f"{_JUDGED} SELECT source, {_COUNTS} FROM j GROUP BY source",
    "funnel_totals": f"{_JUDGED}, s AS (SELECT source, {_COUNTS} FROM j GROUP BY source) SELECT * FROM s UNION ALL SELECT 'total', {', '.join(f'sum({c})::BIGINT' for c in ['scraped', *(f'dropped_{r}' for r in REASONS), 'published'])}, NULL FROM s",
    "yield_alerts": f"{_JUDGED} SELECT source || '/' || lang AS source, count(*) AS scraped FROM j GROUP BY 1 HAVING count(*) > 3 AND count(*) FILTER (reason IS NULL) = 0",
    "exact_dedup_status": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'duplicate' ELSE 'update' END AS status FROM documents",
    "near_dup_window": f"""{_SIMILAR}, e AS (SELECT a, b, similarity FROM l UNION ALL SELECT b, a, similarity FROM l UNION ALL SELECT DISTINCT rep, rep, 1.0 FROM c)
        SELECT u.id, arg_max(v.id, (v.published_at, v.id)) AS earlier_id, round(arg_max(similarity, (v.published_at, v.id)), 6) AS similarity FROM e JOIN c u ON u.rep = a JOIN c v ON v.rep = b
        WHERE (v.published_at, v.id) < (u.published_at, u.id) AND v.published_at >= u.published_at - INTERVAL 48 HOUR GROUP BY u.id""",
    "near_dup_newest": f"""{_WITH}, {_SH.format(n='x', id='id', t='body', src='articles', extra='published_at, is_suppressed,')},
        c AS (SELECT * FROM articles WHERE id % 2 = 0 AND NOT is_suppressed AND published_at >= TIMESTAMP '{NOW}' - INTERVAL 496 HOUR ORDER BY published_at DESC, id DESC LIMIT 200),
        b AS (SELECT xs.id, unnest(s) AS g FROM xs WHERE (id % 2 = 1 OR id % 10 = 0) AND NOT (id % 2 = 0 AND NOT is_suppressed)), h AS (SELECT xs.id AS other, unnest(s) AS g FROM xs WHERE id IN (SELECT id FROM c)),
        f AS (SELECT id, other, count(*) AS n FROM b JOIN h USING (g) GROUP BY 1, 2), m AS (SELECT f.id, other, n::DOUBLE / (len(u.s) + len(v.s) - n) AS similarity, v.published_at FROM f JOIN xs u ON u.id = f.id JOIN xs v ON v.id = other)
        SELECT id, other AS duplicate_of, round(similarity, 6) AS similarity FROM m WHERE similarity >= 0.8 QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, published_at DESC, other DESC) = 1""",
    "near_duplicates": f"{_SIMILAR} SELECT a, b, round(similarity, 6) AS similarity FROM l UNION ALL SELECT rep, id, 1.0 FROM c WHERE id <> rep",
    "benchmark_overlap": f"WITH {_SH.format(n='x', id='doc_id', t='text', src='documents', extra='')}, {_SH.format(n='y', id='item_id', t='text', src='benchmark', extra='')}, a AS (SELECT id, unnest(s) AS g FROM xs), b AS (SELECT id AS target, unnest(s) AS g FROM ys) SELECT id AS doc_id, target, count(*) AS shared FROM a JOIN b USING (g) GROUP BY 1, 2",
    "hash_bucket_assign": f"SELECT doc_id, md5(text) AS content_hash, {sql_md5_mod('doc_id::VARCHAR', 7)} AS bucket, {sql_md5_mod('doc_id::VARCHAR', 1000003)} AS wide FROM documents",
    "rule_assignment": f"{_WITH} SELECT id, CASE WHEN tab = 'tab1' THEN 'desk' WHEN tab = 'tab2' AND len(tags) >= 8 THEN 'tagged' WHEN source IN ('src0', 'src1') THEN 'house-' || source ELSE {AUTHORS!r}[{sql_md5_mod('id::VARCHAR', 7)} + 1] END AS author FROM articles",
    "array_remap": f"""{_WITH} SELECT id, array_to_string(list_sort(list_distinct(list_transform(list_filter(tags, lambda t: t <> 'thanedble'), lambda t: CASE WHEN t IN ('disgusting', 'worthless') THEN 'rude' ELSE t END))), '|') AS tags,
        array_to_string(list_filter(tags, lambda t: t IN ('disgusting', 'worthless', 'thanedble', 'aeronreth'))[1:3], '|') AS allowed FROM articles""",
    "category_label": f"{_WITH} SELECT id, CASE WHEN tab IN ('tab0', 'tab4') THEN coalesce(list_filter(tags, lambda t: t[1] NOT IN ('a', 'c'))[1], tab) ELSE tab END AS label FROM articles",
    "keyword_category": "SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(lower(p_name || ' ' || p_type), '\\b(?:{w})\\b') THEN '{n}'" for n, w in KEYWORDS) + " ELSE 'other' END AS category FROM part",
    "budget_extract": "WITH p AS (SELECT o_orderkey, o_totalprice::DECIMAL(12,2)::DOUBLE AS v FROM orders) SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN v WHEN 1 THEN round(v * 1080000.0, 2) WHEN 2 THEN round_even(v * 1.27, 2) WHEN 3 THEN CASE WHEN v * 1e9 <= 1e12 THEN round(v * 1.12e9, 2) END WHEN 4 THEN v * 1e6 WHEN 5 THEN 2500000000.0 END AS usd FROM p",
    "date_parse_multi": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders",
    "reading_time": "SELECT doc_id, greatest(1, length(text) // 1500)::INTEGER AS minutes, CASE WHEN length(text) BETWEEN 135 AND 160 THEN 'ideal' WHEN length(text) BETWEEN 105 AND 170 THEN 'safe' ELSE 'out' END AS band, CASE WHEN len(string_split_regex(trim(text), '\\s+')) > 5 THEN array_to_string(string_split_regex(trim(text), '\\s+')[1:5], ' ') ELSE text END AS head FROM documents",
    "text_cleaning": """WITH m AS (SELECT doc_id, 'LONDON (Agency) — ' || text || ' -- done – now & <b>"x"</b> summary: y' AS made FROM documents)
        SELECT doc_id, regexp_replace(substr(made, 19), '\\s*(?:—|–|--)\\s*', ', ', 'g') AS dashes,
        replace(replace(replace(replace(replace(made, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped,
        trim(substr(regexp_replace(made, '<[^>]+>', '', 'g'), 1, 40)) AS excerpt, regexp_replace(made, '(?i)\\b(?:summary|özet|résumé|resumo)\\s*:\\s*', '', 'g') AS unlabelled FROM m""",
    "image_variants": """WITH w AS (SELECT p_partkey, p_size * 40 AS width, p_name FROM part)
        SELECT p_partkey, array_to_string(list_sort(list_distinct(list_append(list_filter([400, 800, 1200], lambda x: x < width), least(width, 1200)))), ',') AS widths, lower(replace(p_name, ' ', '_')) AS stem, false AS noise FROM w""",
    "image_distance": "SELECT a.vec_id, b.vec_id AS other, (4 * len(list_filter(list_zip(a.embedding, b.embedding), lambda p: (p[1] > 0) <> (p[2] > 0))))::BIGINT AS bits FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
}
