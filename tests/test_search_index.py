"""The search index: what a query reads, one predicate for page and count, likeness against all runs, odd rows."""

import re

import pytest
from pyspark.sql import functions as F

from quillstream.functions import synonyms
from quillstream.operators import search, search_index
from quillstream.storage import table_path

SCHEMA = "id long, tab string, published_at timestamp_ntz, title string, excerpt string, tag_text string, body string"
ROWS = [
    (1, "a", None, "Nijerya maden anlaşması", "kısa", "gold coast", "gold gold gold and oil"),
    (2, "a", None, "Nigerya ekonomisi", None, "", None),
    (3, "b", None, "İstanbul ILICA", "", None, "oil in nigeria"),
    (4, None, None, None, None, None, "maden"),
    (5, "b", None, "", "", "", ""),
    (6, "a", None, "Nijer nehri", "x", "y", "gold " * 50_000),
]


def best(query, title):
    tri = lambda text: [p[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for p in [f"  {w} "] for i in range(len(p) - 2)]
    own, theirs = set(tri(query)), tri(title)
    runs = [set(theirs[i:j]) for i in range(len(theirs)) for j in range(i + 1, len(theirs) + 1)]
    return max((len(r & own) / len(r | own) for r in runs), default=0.0) if own else 0.0


@pytest.fixture(scope="module")
def made(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA).withColumn("published_at", F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(id as int))")).withColumn("term", F.lit("mine")).withColumn("bucket", F.lit(7))
    return search_index.build(rows, table_path(spark, "index"), buckets=8)


def found_by_reading(raw, words):
    """Ids that match, read from the rows: every group has a word in a field, or a title is alike."""
    raw = raw.strip()
    groups = search.expand(raw, words)
    if len(raw) < 2 or not groups:
        return []
    said = lambda r: set(re.findall(r"[^\W_]+", " ".join(search.lower_tr(c or "") for c in r[3:])))
    return [r[0] for r in ROWS if all(said(r) & set(g) for g in groups) or (len(raw) >= 4 and best(search.lower_tr(raw), search.lower_tr(r[3] or "")) > 0.3)]


@pytest.mark.parametrize("raw", ["nigerya", "nigeria oil", "altın", "ılıca", "istanbul", "maden", "zzzz", "g", "", "?!", "Nijerya maden", "gold oil", "nehri nijer", " oil "])
def test_page_and_count_agree(made, raw):
    words = search.synonym_table([["altın", "gold"]])
    got = [r["id"] for r in made.search(raw, words).collect()]
    assert sorted(got) == found_by_reading(raw, words)
    assert made.count(raw, words).first()["n"] == len(got)


def test_filters_and_pages(made):
    words = {}
    every = made.search("gold", words, size=10).collect()
    # A word in tags and body weighs more than the same word very often in the body.
    assert [r["id"] for r in every] == [1, 6] and every[0]["rank"] == pytest.approx(2 * (0.4 / 2 + 0.2 * 3 / 4)) and every[1]["rank"] == pytest.approx(2 * 0.2 * 50_000 / 50_001)
    assert [r["id"] for r in made.search("gold", words, number=2, size=1).collect()] == [6]
    assert [r["id"] for r in made.search("gold", words, since=F.expr("timestamp_ntz'2024-01-05'")).collect()] == [6]
    assert made.count("oil", words, tab="b").first()["n"] == 1


def test_only_the_terms_buckets_are_read(made):
    plan = made.matched([["gold"], ["oil"]])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*In\(term", plan)
    assert "split(" not in plan


TITLES = ["small red widget", "large shiny gizmo", "", "a", "word two words", "ab ab ab abc", "small", None, "the quick brown fox jumps", "smalls mall"]


@pytest.mark.parametrize("query", ["smal", "wordtwo words", "gizmo shiny", "two words", "ab abc", "quik brwn fox jmps", "x", "..."])
def test_likeness_like_all_runs(spark, query):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TITLES)], "i int, t string")
    got = {r["i"]: r["s"] for r in rows.select("i", search.extent_similarity(query, search.trigrams_of(F.col("t"))).alias("s")).collect()}
    assert got == pytest.approx({i: best(query, t or "") for i, t in enumerate(TITLES)})


def test_dictionary_from_a_table(spark, monkeypatch):
    rows = spark.createDataFrame([(2, "b"), (1, "y"), (1, "x"), (1, "x")], "group int, term string")
    assert synonyms.groups_from(rows) == [["x", "y"], ["b"]]
    monkeypatch.setattr(synonyms, "MOST_GROUPS", 1)
    with pytest.raises(ValueError):
        synonyms.groups_from(rows)
    assert search.expand("Güney Afrika", search.synonym_table(synonyms.GROUPS)) == [["güney", "guney", "afrika", "south", "africa"]]


def test_empty_table(spark):
    none = search_index.build(spark.createDataFrame([], SCHEMA), table_path(spark, "index"), buckets=2)
    assert none.count("gold", {}).first()["n"] == 0


def test_terms_are_counted_where_they_lie(spark):
    rows = spark.createDataFrame([(["b", "a", "b"],), ([],), (None,), (["c"],)], "t array<string>")
    got = [r[0] for r in rows.select(search_index.counted(F.col("t"))).collect()]
    assert got == [[("a", 1), ("b", 2)], [], None, [("c", 1)]]


def test_large_bucket_is_split(spark, tmp_path):
    """A term of all rows fills one bucket: its size, not the number of buckets, says how many tasks write it."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4kb")
    try:
        text = F.concat(F.lit("same "), F.md5(F.col("id").cast("string")))
        rows = spark.range(0, 4000, 1, 8).select("id", F.lit("t").alias("tab"), F.lit("2024-01-01").cast("timestamp_ntz").alias("published_at"), F.lit("x").alias("title"), F.lit("").alias("excerpt"), F.lit("").alias("tag_text"), text.alias("body"))
        own = search_index.build(rows, str(tmp_path / "index"), buckets=1, spread=1)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "index/postings/bucket=0").glob("*.parquet"))) > 2
    assert own.matched([["same"]]).count() == 4000
