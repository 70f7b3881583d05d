"""Search: query expansion on the driver (a query is a scalar), matching and ranking as Columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ACCENTED, PLAIN, fold, let, turkish_lower

TOKENS = r"[^\p{L}\p{N}]+"
_FOLD = str.maketrans(ACCENTED, PLAIN)


def lower_tr(text: str) -> str:
    return text.translate(str.maketrans("İI", "iı")).lower()


def synonym_table(groups: list[list[str]]) -> dict[str, list[str]]:
    """Term to group; a later group replaces an earlier one for a term that stands in both."""
    return {lower_tr(term): [lower_tr(t) for t in group] for group in groups for term in group}


def expand(raw: str, synonyms: dict[str, list[str]]) -> list[list[str]]:
    """OR-groups, all of which must match: phrases of 3, 2, then 1 words are looked up, greedily from the left.

    A word that is not known stands for itself and its folded form. Synonyms of several words count as
    separate words; words under 2 letters go.
    """
    words = re.sub(r"[^\w\s-]", " ", lower_tr(raw)).split()
    folded = {k.translate(_FOLD): k for k in synonyms}
    out, i = [], 0
    while i < len(words):
        for n in (3, 2, 1):
            phrase = " ".join(words[i : i + n])
            if i + n <= len(words) and (known := phrase if phrase in synonyms else folded.get(phrase.translate(_FOLD))):
                own, i = [phrase, *synonyms[known]], i + n
                break
        else:
            own, i = [words[i]], i + 1
        terms = [w for term in own for w in term.split()]
        group = list(dict.fromkeys(t for w in terms for t in (w, w.translate(_FOLD)) if len(t) >= 2))
        if group:
            out.append(group)
    return out


def tokens(*fields: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(turkish_lower(F.concat_ws(" ", *fields)), TOKENS), lambda t: t != ""))


def matches(tokens: Column, groups: list[list[str]]) -> Column:
    """At least one token of every group."""
    hits = [F.arrays_overlap(tokens, F.array(*map(F.lit, g))) for g in groups]
    return reduce(lambda a, b: a & b, hits, F.lit(bool(groups)))


def rank(groups: list[list[str]], fields: list[tuple[str, float]]) -> Column:
    """Weighted number of distinct query terms in each field."""
    terms = F.array(*map(F.lit, sorted({t for g in groups for t in g})))
    return reduce(lambda a, b: a + b, (weight * F.size(F.array_intersect(tokens(field), terms)) for field, weight in fields))


def trigrams(c: Column) -> Column:
    padded = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def word_similarity(query: str, text: str) -> Column:
    """Largest share of the query's trigrams that a word of the text holds."""
    wanted = trigrams(F.lit(query))
    words = F.filter(F.split(F.lower(text), TOKENS), lambda w: w != "")
    share = F.transform(words, lambda w: F.size(F.array_intersect(wanted, trigrams(w))) / F.size(wanted))
    return F.coalesce(F.array_max(share), F.lit(0.0))


def trigrams_of(text: Column) -> Column:
    """Trigrams of the words of a text in their order, repeats kept: a word has two blanks before it and one behind it."""
    words = F.filter(F.split(F.lower(text), TOKENS), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: let(F.concat(F.lit("  "), w, F.lit(" ")), lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))))


def query_trigrams(text: str) -> list[str]:
    """The distinct trigrams of a query."""
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return sorted({p[i : i + 3] for p in (f"  {w} " for w in words) for i in range(len(p) - 2)})


def extent_similarity(query: str, trigrams: Column) -> Column:
    """The largest likeness of the query's trigrams to those of a run of ``trigrams`` (a text's, in order): common ones by all distinct ones of both.

    The best run begins and ends with a trigram of the query, so only such runs are compared.
    """
    own = query_trigrams(query)
    if not own:
        return F.lit(0.0)
    wanted = F.array(*map(F.lit, own))

    def best(tris: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.greatest(F.size(tris), F.lit(1))), lambda i: F.array_contains(wanted, F.try_element_at(tris, i)))

        def likeness(i: Column, j: Column) -> Column:
            return let(F.array_distinct(F.slice(tris, i, j - i + 1)), lambda run: let(F.size(F.array_intersect(run, wanted)), lambda common: common / (len(own) + F.size(run) - common)))

        return let(ends, lambda at: F.array_max(F.transform(at, lambda i: F.array_max(F.transform(F.filter(at, lambda j: j >= i), lambda j: likeness(i, j))))))

    return F.coalesce(let(trigrams, best), F.lit(0.0))


def plain(raw: str) -> list[list[str]]:
    """Every word must match as it is: no synonyms."""
    return [[w] for w in re.sub(r"[^\w\s-]", " ", lower_tr(raw)).split()]


def groups_of(compiled: str, raw: str) -> list[list[str]]:
    """OR-groups of a compiled query 'a & (b | c)'; one that is not of that form falls back to the plain words of the raw query."""
    word = r"[\w-]+"
    if not re.fullmatch(rf"\s*(?:{word}|\(\s*{word}(?:\s*\|\s*{word})*\s*\))(?:\s*&\s*(?:{word}|\(\s*{word}(?:\s*\|\s*{word})*\s*\)))*\s*", compiled):
        return plain(raw)
    return [[lower_tr(w) for w in re.findall(word, part)] for part in compiled.split("&")]


def rank_by_frequency(groups: list[list[str]], fields: list[tuple[str | Column, float]]) -> Column:
    """Over the fields, weight times tf / (tf + 1), where tf is how often the query's terms stand in the field."""
    terms = F.array(*map(F.lit, sorted({t for g in groups for t in g})))

    def part(field: str | Column, weight: float) -> Column:
        tf = F.size(F.filter(F.split(turkish_lower(field), TOKENS), lambda t: F.array_contains(terms, t)))
        return weight * tf / (tf + 1)

    return reduce(lambda a, b: a + b, (part(*f) for f in fields))


def search(rows: DataFrame, raw: str, synonyms: dict[str, list[str]], tab: str | None = None, since: Column | None = None, fuzzy_from: int = 4, threshold: float = 0.3) -> DataFrame:
    """Matching rows with their rank: boolean match over title and body, or a title like the query. Under 2 signs nothing is found.

    Takes every text apart; ``search_index`` does not.
    """
    raw = raw.strip()
    groups = expand(raw, synonyms)
    if len(raw) < 2 or not groups:
        return rows.limit(0).withColumn("rank", F.lit(0.0))
    hit = matches(tokens("title", "body"), groups)
    like = extent_similarity(lower_tr(raw), trigrams_of(turkish_lower("title")))
    if len(raw) >= fuzzy_from:
        hit |= like > threshold
    if tab is not None:
        rows = rows.filter(F.col("tab") == tab)
    if since is not None:
        rows = rows.filter(F.col("published_at") >= since)
    return rows.filter(hit).withColumn("rank", 2.0 * rank(groups, [("title", 1.0), ("body", 0.4)]) + 0.5 * like)


def count(rows: DataFrame, raw: str, synonyms: dict[str, list[str]], **filters) -> DataFrame:
    """One row: how many rows ``search`` finds with the same query and filters."""
    return search(rows, raw, synonyms, **filters).agg(F.count(F.lit(1)).alias("n"))


def counts(rows: DataFrame, asked: list[tuple[str, dict]], synonyms: dict[str, list[str]], fuzzy_from: int = 4, threshold: float = 0.3) -> DataFrame:
    """(asked, n): ``count`` of several queries with their filters, by place; texts are read and taken apart once for all of them."""

    def hit(raw: str, words: Column, titles: Column, tab: str | None = None, since: Column | None = None) -> Column:
        raw = raw.strip()
        groups = expand(raw, synonyms)
        if len(raw) < 2 or not groups:
            return F.lit(False)
        own = matches(words, groups)
        if len(raw) >= fuzzy_from:
            own |= extent_similarity(lower_tr(raw), titles) > threshold
        if tab is not None:
            own = (F.col("tab") == tab) & own
        if since is not None:
            own = (F.col("published_at") >= since) & own
        return own

    every = lambda words, titles: F.array(*(hit(raw, words, titles, **filters) for raw, filters in asked))
    told = rows.select(let(tokens("title", "body"), lambda words: let(trigrams_of(turkish_lower("title")), lambda titles: every(words, titles))).alias("hits"))
    sums = told.agg(*(F.count_if(F.get("hits", F.lit(k))).alias(f"n{k}") for k in range(len(asked))))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("asked"), F.col(f"n{k}").alias("n")) for k in range(len(asked))))).alias("x")).select("x.asked", "x.n")


def suggest(blocks: list[tuple[str, DataFrame, str, list[Column], int]], query: str) -> DataFrame:
    """(type, label, block, position): for each (type, rows with distinct labels, label column, order, k) the first k labels that hold the query."""
    out = None
    for number, (kind, rows, label, order, k) in enumerate(blocks):
        if len(query) < 2:
            rows = rows.limit(0)
        hit = F.lower(fold(label)).contains(query.lower().translate(_FOLD))
        own = rows.filter(hit).orderBy(*order).limit(k).select(F.lit(kind).alias("type"), F.col(label).alias("label"), F.lit(number).alias("block"))
        out = own if out is None else out.unionByName(own)
    return out


def search_tags(rows: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Tags, not all tags of matching rows, that hold the query: most frequent first."""
    tags = rows.select(F.explode("tags").alias("tag")).filter(F.lower(fold("tag")).contains(query.lower().translate(_FOLD)))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(k)
