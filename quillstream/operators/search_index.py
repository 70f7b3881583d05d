"""Search over an inverted index: postings, titles' trigrams and what a hit shows are written once; queries read only theirs.

* ``postings`` (bucket, term, id, a term's frequency in each field, a row for each field that holds it), in
  directories by bucket of the term, sorted by term: a query's plan names its terms' buckets, so other directories are not listed, and row
  groups of other terms are skipped by their bounds. No text is taken apart when a query comes.
* ``trigrams`` (bucket, trigram, id) of titles, laid out likewise.
* ``items`` (id, tab, published_at, title).

One predicate (``hits``) serves the page, the count and the rank: an item matches if every group of the query
has a term in one of its fields, or, for queries of ``FUZZY_FROM`` signs or more, if its title is more
similar to the query than ``THRESHOLD``. Candidates for the latter are titles that hold so many of the
query's trigrams that they can be; only these are compared.

Rank: twice the sum over fields of weight times tf / (tf + 1), plus half the similarity; then newest first, id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, turkish_lower
from .search import TOKENS, expand, extent_similarity, groups_of, lower_tr, query_trigrams, trigrams_of

#: Weights of the fields: title, excerpt, tags, body. Signs from which a query is matched by likeness, and how alike a title must be.
WEIGHTS = {"title": 1.0, "excerpt": 0.4, "tag_text": 0.4, "body": 0.2}
FUZZY_FROM, THRESHOLD = 4, 0.3
PAGE = 12


def terms_of(field: Column | str) -> Column:
    return F.filter(F.split(turkish_lower(field), TOKENS), lambda t: t != "")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, by: str, path: str, buckets: int, spread: int) -> None:
    """Rows by bucket of a term, each bucket in ``spread`` parts or more: what is large is split and what is small united by its size, so that no frequent term makes one task's work."""
    made = rows.withColumn("bucket", _bucket(F.col(by), buckets)).withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(spread)))
    made.hint("rebalance", "bucket", "__salt").drop("__salt").sortWithinPartitions("bucket", by, "id").write.partitionBy("bucket").parquet(path)


def counted(terms: Column) -> Column:
    """The distinct terms with how often each stands in the array: structs (term, n)."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i >= 0) & (i < F.size(s)) & ((i == 0) | (F.get(s, i) != F.get(s, i - 1))))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("n"))))

    return let(F.sort_array(terms), runs)


def build(rows: DataFrame, path: str, buckets: int = 64, spread: int = 2) -> SearchIndex:
    """Write the index of ``rows`` (id, tab, published_at and the fields title, excerpt, tag_text, body; others are ignored) under ``path``.

    A text's terms are counted where it lies, so that they are shuffled once, to their buckets.
    """
    parts = F.array(*(F.struct(F.lit(k).alias("field"), counted(terms_of(f)).alias("terms")) for k, f in enumerate(WEIGHTS)))
    said = rows.select("id", F.explode(parts).alias("p")).select("id", "p.field", F.explode("p.terms").alias("x"))
    told = said.select(F.col("x.term").alias("term"), "id", *(F.when(F.col("field") == k, F.col("x.n")).otherwise(0).alias(f"{f}_tf") for k, f in enumerate(WEIGHTS)))
    _write(told, "term", f"{path}/postings", buckets, spread)
    _write(rows.select("id", F.explode(F.array_distinct(trigrams_of(F.col("title")))).alias("trigram")), "trigram", f"{path}/trigrams", buckets, spread)
    rows.select("id", "tab", "published_at", "title").write.parquet(f"{path}/items")
    return SearchIndex(rows.sparkSession, path, buckets, rows.schema["id"].dataType.simpleString())


class SearchIndex:
    """An index written by ``build`` with the same number of buckets, of rows whose ids are of the given type."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, id_type: str = "bigint"):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.schemas = {
            "postings": f"term string, id {id_type}, " + ", ".join(f"{f}_tf int" for f in WEIGHTS) + ", bucket int",
            "trigrams": f"id {id_type}, trigram string, bucket int",
            "items": f"id {id_type}, tab string, published_at timestamp_ntz, title string",
        }

    def _read(self, kind: str, by: str, terms: list[str]) -> DataFrame:
        """Rows of the given terms: only their buckets are read."""
        told = self.spark.range(1).select(*(_bucket(F.lit(t), self.buckets).alias(f"c{i}") for i, t in enumerate(terms))).first() if terms else ()
        return self.spark.read.schema(self.schemas[kind]).parquet(f"{self.path}/{kind}").filter(F.col("bucket").isin(sorted(set(told))) & F.col(by).isin(terms))

    def matched(self, groups: list[list[str]]) -> DataFrame:
        """(id, score) of the items where every group has a term; the score weighs frequencies by field."""
        terms = sorted({t for g in groups for t in g})
        masks = {t: sum(1 << k for k, g in enumerate(groups) if t in g) for t in terms}
        rows = self._read("postings", "term", terms)
        mask = F.element_at(F.create_map(*(F.lit(x) for t, m in masks.items() for x in (t, m))), F.col("term")) if terms else F.lit(0)
        met = rows.groupBy("id").agg(F.bit_or(mask.cast("long")).alias("met"), *(F.sum(f"{f}_tf").alias(f"{f}_tf") for f in WEIGHTS))
        score = reduce(lambda a, b: a + b, (w * F.col(f"{f}_tf") / (F.col(f"{f}_tf") + 1) for f, w in WEIGHTS.items()))
        return met.filter(F.col("met") == (1 << len(groups)) - 1).select("id", score.alias("score"))

    def alike(self, raw: str, threshold: float = THRESHOLD) -> DataFrame:
        """(id) of the items whose titles hold enough of the query's trigrams to be as alike as ``threshold``."""
        own = query_trigrams(raw)
        return self._read("trigrams", "trigram", own).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > threshold * len(own)).select("id")

    def hits(self, raw: str, synonyms: dict[str, list[str]], tab: str | None = None, since: Column | None = None, compiled: str | None = None) -> DataFrame:
        """(id, tab, published_at, title, similarity, rank) of all items that match.

        ``compiled``: a query 'a & (b | c)' instead of the expanded one; one that does not parse falls back to the
        plain words of ``raw``. Under 2 signs, or without a word of 2 signs, nothing matches. At most 60 groups.
        """
        raw = raw.strip()
        groups = groups_of(compiled, raw) if compiled is not None else expand(raw, synonyms)
        if len(raw) < 2 or not groups or len(groups) > 60:
            if len(groups) > 60:
                raise ValueError("a query of more than 60 groups")
            return self.spark.createDataFrame([], "id long, tab string, published_at timestamp_ntz, title string, similarity double, rank double")
        fuzzy = len(raw) >= FUZZY_FROM
        found = self.matched(groups)
        if fuzzy:
            found = found.join(self.alike(raw), "id", "full")
        items = self.spark.read.schema(self.schemas["items"]).parquet(f"{self.path}/items")
        if tab is not None:
            items = items.filter(F.col("tab") == tab)
        if since is not None:
            items = items.filter(F.col("published_at") >= since)
        told = items.join(found, "id").withColumn("similarity", extent_similarity(lower_tr(raw), trigrams_of(turkish_lower("title"))))
        match = F.col("score").isNotNull() | (F.lit(fuzzy) & (F.col("similarity") > THRESHOLD))
        return told.filter(match).select("id", "tab", "published_at", "title", "similarity", (2.0 * F.coalesce("score", F.lit(0.0)) + 0.5 * F.col("similarity")).alias("rank"))

    def count(self, raw: str, synonyms: dict[str, list[str]], **filters) -> DataFrame:
        """One row: how many items match."""
        return self.hits(raw, synonyms, **filters).agg(F.count(F.lit(1)).alias("n"))

    def search(self, raw: str, synonyms: dict[str, list[str]], number: int = 1, size: int = PAGE, **filters) -> DataFrame:
        """One page of the matching items, best first (then newest, then largest id)."""
        order = [F.desc("rank"), F.col("published_at").desc_nulls_last(), F.desc("id")]
        return self.hits(raw, synonyms, **filters).orderBy(*order).offset((number - 1) * size).limit(size)
