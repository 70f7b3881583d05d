"""Backfills that can be repeated: a ledger says which rows a rule has settled, in which of its versions and for which inputs.

A row is pending for a rule unless the ledger holds its key with the rule's version and the hash of the inputs
as they are now. A run works through the pending rows in slices; each slice is written to the ledger when it
is done, so a run that breaks goes on where it was, a second run finds nothing, and a row whose inputs change,
or a new version of the rule, makes it pending again. Outcomes are text codes, the status behind a colon.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import settle
from . import gates

LEDGER_DDL = "key string, rule string, version int, input string, outcome string"


def input_hash(*inputs: Column | str) -> Column:
    """A hash of the inputs that tells null from empty and one text from two."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("\x00")) for c in inputs))), 256)


class Ledger:
    """The ledger under ``path``, a Parquet table that only grows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], LEDGER_DDL).write.mode("append").parquet(path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER_DDL).parquet(self.path)

    def pending(self, rows: DataFrame, key: str, rule: str, version: int, inputs: list[Column | str]) -> DataFrame:
        """``rows`` that the rule has not settled in this version for these inputs. Keys and hashes are compared, no inputs."""
        return self._open(rows, key, rule, version, inputs).drop("__key", "__input")

    def _open(self, rows: DataFrame, key: str, rule: str, version: int, inputs: list[Column | str]) -> DataFrame:
        done = self.rows().filter((F.col("rule") == rule) & (F.col("version") == version)).select(F.col("key").alias("__key"), F.col("input").alias("__input")).distinct()
        marked = rows.withColumns({"__key": F.col(key).cast("string"), "__input": input_hash(*inputs)})
        return marked.join(done, ["__key", "__input"], "left_anti")

    def run(self, rows: DataFrame, key: str, rule: str, version: int, inputs: list[Column | str], outcome: Callable[[DataFrame], Column], slices: int = 1) -> int:
        """Settle the pending rows, slice by slice; the number of rows settled is returned. A null outcome leaves a row pending."""
        settled = 0
        for n in range(slices):
            part = rows if slices == 1 else rows.filter(F.pmod(F.xxhash64(key), F.lit(slices)) == n)
            open_ = self._open(part, key, rule, version, inputs)
            # Null outcomes go after the rows are settled: a filter before would work out each outcome twice.
            made = settle(open_.select(F.col("__key").alias("key"), F.lit(rule).alias("rule"), F.lit(version).alias("version"), F.col("__input").alias("input"), outcome(open_).alias("outcome"))).filter("outcome is not null")
            settled += made.count()
            made.write.mode("append").parquet(self.path)
        return settled

    def histogram(self, rule: str, version: int) -> DataFrame:
        """(status, n): the outcomes of a rule, without what stands behind their code ('ok:12->40w' is 'ok')."""
        status = F.when(F.col("outcome").startswith("ok:"), "ok").otherwise(F.col("outcome"))
        return self.rows().filter((F.col("rule") == rule) & (F.col("version") == version)).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def rerun_outcome(current: str, source: str, new: str, reason: Column, least_words: int = 60) -> Column:
    """What comes of redoing a text that is cut off: why it is left alone, why the new one is refused, or 'ok:<words>-><words>w'.

    Only a text that is cut off is redone, and only from a source that is whole, without a teaser's mark, and
    of ``least_words``; the new text must pass the gate (``reason``: why it does not, or null) and hold no fewer words.
    """
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " "), r"^\s+|\s+$", "")
    words = lambda c: T.count_blank_separated(plain(F.col(c)))
    cut = lambda c: (plain(F.col(c)) != "") & gates.truncated(c)
    return (
        F.when(~F.coalesce(cut(current), F.lit(False)), "skip:not-truncated")
        .when(F.coalesce(F.col(source), F.lit("")).rlike(r"\[(?:…|\.\.\.)\]") | F.coalesce(cut(source), F.lit(False)), "skip:source-truncated")
        .when(T.count_blank_separated(F.coalesce(F.col(source), F.lit(""))) < least_words, "skip:original-too-thin")
        .when(F.coalesce(F.col(new), F.lit("")) == "", "fail:no-translation")
        .when(reason.isNotNull(), F.concat(F.lit("fail:quality-"), reason))
        .when(words(new) < words(current), "fail:shorter-than-current")
        .otherwise(F.concat(F.lit("ok:"), words(current).cast("string"), F.lit("->"), words(new).cast("string"), F.lit("w")))
    )


def rerun(current: str, outcome: Column, new: str) -> Column:
    """The new text where the outcome is ok, else the current one."""
    return F.when(outcome.startswith("ok:"), F.col(new)).otherwise(F.col(current))
