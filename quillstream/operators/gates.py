"""Ordered gates with drop accounting: an item counts in the first gate that drops it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.values import clamp
from ..storage import settle

# Frequent function words of the English detector; signs a finished text ends with.
ENGLISH = "the of and to in is that for was with on are by from this it be as at an or".split()
ENDINGS = '.!?"”»)]…:'


def status_by_hash(batch: DataFrame, stored: DataFrame, key: str, content: str) -> DataFrame:
    """Each row of the batch is 'new', 'update' or 'duplicate' against stored (key, content_hash); one join."""
    joined = batch.join(stored.select(key, F.col("content_hash").alias("__stored")), key, "left")
    own = F.md5(F.col(content))
    return joined.withColumn("status", F.when(F.col("__stored").isNull(), "new").when(F.col("__stored") == own, "duplicate").otherwise("update")).drop("__stored")


def min_content(body: str, words: int = 100) -> Column:
    return T.count_runs(T.strip_tags(body)) < words


def low_score(score: str, least: int = 6, default: int = 5) -> Column:
    """A missing score counts as the default, which fails."""
    return clamp(F.coalesce(F.col(score), F.lit(default))) < least


def stopword_ratio(body: str, words: list[str]) -> Column:
    runs = F.split(F.lower(body), r"[^\p{L}\p{N}_]+")
    return F.size(F.filter(runs, lambda w: w.isin(words))) / F.greatest(F.lit(1), T.count_runs(body))


def not_english(body: str, least_words: int = 50, ratio: float = 0.08) -> Column:
    """Texts under the least length pass."""
    return (T.count_runs(body) >= least_words) & (stopword_ratio(body, ENGLISH) <= ratio)


def not_language(body: str, signs: str, words: list[str], least_words: int = 50) -> Column:
    """Neither enough letters of the language alone nor enough of its function words."""
    letters = F.regexp_count(F.col(body), F.lit(f"[{signs}]")) / F.greatest(F.lit(1), F.length(body))
    return (T.count_runs(body) >= least_words) & (letters <= 0.05) & (stopword_ratio(body, words) <= 0.04)


def truncated_list(body: str) -> Column:
    return F.rtrim(F.col(body)).rlike(r"(?i)(?:following|as follows|include|such as)\s*:$")


def truncated(body: str) -> Column:
    """A trailing source line aside, the last sign is none that a text ends with."""
    whole = F.rtrim(F.regexp_replace(F.rtrim(F.col(body)), r"\n+(?:Source|Kaynak)[^\n]*$", ""))
    return ~F.right(whole, F.lit(1)).isin(*ENDINGS)


def few_headings(html: str, least: int = 1) -> Column:
    return F.regexp_count(F.col(html), F.lit(r"(?i)<h2[ >]")) < least


def finalise(html: str, language: Column) -> Column:
    """The first reason against a finished body, or null."""
    plain = T.strip_tags(html)
    return F.when(F.trim(F.coalesce(plain, F.lit(""))) == "", "empty").when(language, "language").when(~F.right(F.rtrim(plain), F.lit(1)).isin(*ENDINGS), "truncated").when(few_headings(html), "headings")


def damaged(body: str, words: int = 120) -> Column:
    return (F.coalesce(F.col(body), F.lit("")) == "") | F.col(body).contains("[…]") | (T.count_blank_separated(body) <= words) | truncated(body)


def gains(new_words: Column, old_words: Column) -> Column:
    return new_words >= F.greatest(1.3 * old_words, old_words + 40)


def keeps_tags(before: str, after: str, tags: tuple[str, ...] = ("p", "h2", "h3", "ul", "li", "table", "img", "a")) -> Column:
    """No tag of these became rarer."""
    return keeps_tags_columns(F.col(before), F.col(after), tags)


def keeps_tags_columns(before: Column, after: Column, tags: tuple[str, ...] = ("p", "h2", "h3", "ul", "li", "table", "img", "a")) -> Column:
    out = F.lit(True)
    for t in tags:
        out &= F.regexp_count(after, F.lit(f"(?i)<{t}[ >]")) >= F.regexp_count(before, F.lit(f"(?i)<{t}[ >]"))
    return out


def run_gates(items: DataFrame, gates: list[tuple[str, Column]]) -> DataFrame:
    """Adds drop_reason: the first gate that holds, in the given order, or null. A gate that is null does not hold."""
    return items.withColumn("drop_reason", F.coalesce(*(F.when(F.coalesce(gate, F.lit(False)), F.lit(name)) for name, gate in gates)))


def funnel(judged: DataFrame, reasons: list[str], by: str = "source", score: str = "score") -> DataFrame:
    """Per group: scraped, dropped by reason, published, mean score of the published to one decimal."""
    passed = F.col("drop_reason").isNull()
    return judged.groupBy(by).agg(
        F.count(F.lit(1)).alias("scraped"),
        *(F.count_if(F.col("drop_reason") == r).alias(f"dropped_{r}") for r in reasons),
        F.count_if(passed).alias("published"),
        F.round(F.avg(F.when(passed, F.col(score))), 1).alias("avg_score"),
    )


def with_total(stats: DataFrame, by: str = "source") -> DataFrame:
    """The report's rows with a row of sums behind; its mean stays blank. The report, a row a group, is made once for both."""
    stats = settle(stats)
    sums = [F.sum(c).cast(t).alias(c) for c, t in stats.dtypes if c not in (by, "avg_score")]
    return stats.unionByName(stats.agg(*sums).withColumn(by, F.lit("total")), allowMissingColumns=True)


def yield_alert(stats: DataFrame, least: int = 5) -> DataFrame:
    return stats.filter((F.col("scraped") > least) & (F.col("published") == 0))


def report_card(items: DataFrame, by: str = "source", words: int = 250, image_status: Column | None = None) -> DataFrame:
    """Passes if at least 4 items (all, where there are fewer) are long (tags aside), dated and titled and, where the status of their picture's address is told, it begins with 2."""
    body = F.regexp_replace(F.coalesce("body", F.lit("")), r"<[^>]+>", " ")
    good = (T.count_blank_separated(body) >= words) & F.col("published_at").isNotNull() & (F.trim(F.coalesce("title", F.lit(""))) != "")
    if image_status is not None:
        good &= F.coalesce(image_status.startswith("2"), F.lit(False))
    return items.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("good")).withColumn("passed", F.col("good") >= F.least(F.lit(4), F.col("n")))
