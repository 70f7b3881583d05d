"""Catalogue: search over the written index, against SQL that takes every text apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import synonyms
from ..operators import reads, search, search_index
from ..storage import table_path
from ..tables import ARTICLES_SQL, NOW, PUBLISHED_SQL, articles
from .reads import SYNONYMS, extent_sql

_made: dict[tuple[str, str], search_index.SearchIndex] = {}


def index(spark: SparkSession, d: str) -> search_index.SearchIndex:
    """The index of the published articles, written once a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _made:
        rows = reads.published(articles(spark, d)).withColumns({"excerpt": F.substring("body", 1, 200), "tag_text": F.array_join("tags", " ")})
        _made[key] = search_index.build(rows, table_path(spark, "search"), buckets=16)
    return _made[key]


#: (query, page, filters, SQL of the filters): words, synonyms, misspelt words, several words, a tab, a time, too short.
ASKED = [
    ("With er", 1, {}, "true"),
    ("with er", 2, {}, "true"),
    ("thanedbl the", 1, {}, "true"),
    ("Is and retition oun", 1, {}, "true"),
    ("thnd", 1, {"tab": "tab3"}, "tab = 'tab3'"),
    ("eau de", 1, {"days": 20}, f"published_at >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY"),
    ("er", 1, {"tab": "tab5"}, "tab = 'tab5'"),
    (" x ", 1, {}, "false"),
]


def _filters(tab: str | None = None, days: int | None = None) -> dict:
    return {"tab": tab, "since": None if days is None else F.expr(f"TIMESTAMP_NTZ '{NOW}' - interval {days} days")}


def index_search(spark: SparkSession, d: str) -> DataFrame:
    """A page of hits for each query, with places and ranks."""
    own, words, out = index(spark, d), search.synonym_table(SYNONYMS), None
    for k, (raw, number, filters, _) in enumerate(ASKED):
        page = own.search(raw, words, number, **_filters(**filters)).withColumn("asked", F.lit(k)).select("asked", "id", F.round("rank", 6).alias("rank"), F.round("similarity", 6).alias("similarity"))
        out = page if out is None else out.unionAll(page)
    return out


def index_count(spark: SparkSession, d: str) -> DataFrame:
    own, words, out = index(spark, d), search.synonym_table(SYNONYMS), None
    for k, (raw, _, filters, _) in enumerate(ASKED):
        n = own.count(raw, words, **_filters(**filters)).select(F.lit(k).alias("asked"), "n")
        out = n if out is None else out.unionAll(n)
    return out


COMPILED = ["er & (with | from)", "er & (with", "(thanedble | ther) & the"]


def index_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Compiled queries; the broken one falls back to the plain words."""
    own, out = index(spark, d), None
    for k, compiled in enumerate(COMPILED):
        rows = own.hits("With er!", {}, compiled=compiled).select(F.lit(k).alias("asked"), "id")
        out = rows if out is None else out.unionAll(rows)
    return out


TITLES = ["smal", "smal rde", "larg gizmo blue", "ol shiny widgt smalll", "zz"]


def index_titles(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts like queries of one to four words."""
    rows = table_of_parts(spark, d)
    built = search_index.build(rows, table_path(spark, "names"), buckets=8)
    out = None
    for k, raw in enumerate(TITLES):
        near = rows.join(built.alike(raw), "id").withColumn("similarity", search.extent_similarity(raw, search.trigrams_of(F.col("title")))).filter("similarity > 0.3")
        own = near.select(F.lit(k).alias("asked"), "id", F.round("similarity", 6).alias("similarity"))
        out = own if out is None else out.unionAll(own)
    return out


def table_of_parts(spark: SparkSession, d: str) -> DataFrame:
    from ..tables import table

    none = F.lit(None).cast("string")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), none.alias("tab"), F.lit(None).cast("timestamp_ntz").alias("published_at"), F.col("p_name").alias("title"), none.alias("excerpt"), none.alias("tag_text"), none.alias("body"))


#: Words of the dictionary stand in for words of the documents: what a query expands to by the whole dictionary.
SAID = ["Güney Afrika madencilik", "guney afrika ALTIN", "seçim oy", "para fonu borc", "DR Kongo dis ticaret", "nothing known"]


def dictionary_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents that end with a pair of dictionary terms (by their ids), found by queries through the dictionary, which is read from a table."""
    from ..tables import table

    terms = [t for g in synonyms.GROUPS for t in g]
    pick = lambda c: F.element_at(F.array(*map(F.lit, terms)), (F.pmod(c, F.lit(len(terms))) + 1).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", F.concat_ws(" ", F.substring("text", 1, 40), pick(F.col("doc_id")), pick(F.col("doc_id") * 7 + 3)).alias("body"))
    stored = spark.createDataFrame([(k, t) for k, g in enumerate(synonyms.GROUPS) for t in g], "group int, term string")
    words, out = search.synonym_table(synonyms.groups_from(stored)), None
    for k, raw in enumerate(SAID):
        own = rows.filter(search.matches(search.tokens("body"), search.expand(raw, words))).select(F.lit(k).alias("asked"), "doc_id")
        out = own if out is None else out.unionAll(own)
    return out


QUERIES = {f.__name__: f for f in (index_search, index_count, index_fallback, index_titles, dictionary_search)}

_TERMS = "list_filter(string_split_regex(lower(translate(coalesce({}, ''), 'İI', 'iı')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_P = f"WITH {ARTICLES_SQL}, p AS MATERIALIZED (SELECT id, tab, published_at, title, {_TERMS.format('title')} AS t0, {_TERMS.format('substr(body, 1, 200)')} AS t1, {_TERMS.format(chr(34) + 'tag_text' + chr(34))} AS t2, {_TERMS.format('body')} AS t3 FROM (SELECT *, array_to_string(tags, ' ') AS tag_text FROM articles WHERE {PUBLISHED_SQL}))"


def _hits(raw: str, groups: list[list[str]], where: str, rank: bool = True) -> str:
    """Rows of ``p`` that match, with rank, by taking texts apart."""
    raw = raw.strip()
    terms = sorted({t for g in groups for t in g})
    every = "list_concat(t0, t1, t2, t3)"
    met = " AND ".join(f"list_has_any({every}, {g!r})" for g in groups) or "false"
    tf = [f"len(list_filter(t{k}, lambda x: list_contains({terms!r}, x)))" for k in range(4)]
    score = " + ".join(f"{w} * {n} / ({n} + 1)" for n, w in zip(tf, search_index.WEIGHTS.values(), strict=True))
    like = extent_sql(search.lower_tr(raw), "title")
    fuzzy = "similarity > 0.3" if len(raw) >= search_index.FUZZY_FROM else "false"
    scored = f", 2.0 * CASE WHEN met THEN {score} ELSE 0 END + 0.5 * similarity AS rank" if rank else ""
    return f"SELECT id, published_at, similarity{scored} FROM (SELECT *, {met} AS met, {like} AS similarity FROM p WHERE {where}) WHERE met OR {fuzzy}"


_SYN = search.synonym_table(SYNONYMS)
_DICT = search.synonym_table(synonyms.GROUPS)
_ALL_TERMS = [t for g in synonyms.GROUPS for t in g]
_PARTS = "WITH q AS (SELECT p_partkey AS id, p_name AS title FROM part) "
ORACLE = {
    "index_search": f"{_P} " + " UNION ALL ".join(f"SELECT {k} AS asked, id, round(rank, 6) AS rank, round(similarity, 6) AS similarity FROM (SELECT * FROM ({_hits(raw, search.expand(raw, _SYN), where)}) ORDER BY rank DESC, published_at DESC, id DESC LIMIT 12 OFFSET {12 * (n - 1)})" for k, (raw, n, _, where) in enumerate(ASKED)),
    "index_count": f"{_P} " + " UNION ALL ".join(f"SELECT {k} AS asked, count(*) AS n FROM ({_hits(raw, search.expand(raw, _SYN), where, False)})" for k, (raw, _, _, where) in enumerate(ASKED)),
    "index_fallback": f"{_P} " + " UNION ALL ".join(f"SELECT {k} AS asked, id FROM ({_hits('With er!', groups, 'true', False)})" for k, groups in enumerate(([["er"], ["with", "from"]], [["with"], ["er"]], [["thanedble", "ther"], ["the"]]))),
    "index_titles": _PARTS + " UNION ALL ".join(f"SELECT {k} AS asked, id, round(s, 6) AS similarity FROM (SELECT id, {extent_sql(raw, 'title')} AS s FROM q) WHERE s > 0.3" for k, raw in enumerate(TITLES)),
    "dictionary_search": f"WITH t AS (SELECT {_ALL_TERMS!r} AS w), r AS (SELECT doc_id, ".replace('"', "'") + _TERMS.format(f"substr(text, 1, 40) || ' ' || w[doc_id % {len(_ALL_TERMS)} + 1] || ' ' || w[(doc_id * 7 + 3) % {len(_ALL_TERMS)} + 1]") + " AS words FROM documents, t) " + " UNION ALL ".join(f"SELECT {k} AS asked, doc_id FROM r WHERE " + " AND ".join(f"list_has_any(words, {g!r})" for g in search.expand(raw, _DICT)) for k, raw in enumerate(SAID)),
}
