"""Calls of outside text models as a pluggable stage, with the acceptance rules around them.

No model is shipped and nothing is sent anywhere: a caller passes an object with ``answer``. The rule-based
one below gives the same answers everywhere and stands in for a model in tests.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import settle


#: Calls whose prompts are held at a time.
CALLS = 4


class TextModel(Protocol):
    """Answers a batch of prompts; None for one that failed. Must be safe to call again with the same prompts."""

    def answer(self, prompts: list[str]) -> list[str | None]: ...


class KeywordModel:
    """The answer of the first keyword that a prompt holds."""

    def __init__(self, rules: list[tuple[str, str]], default: str | None = None):
        self.rules, self.default = rules, default

    def answer(self, prompts: list[str]) -> list[str | None]:
        return [next((a for word, a in self.rules if word in p.lower()), self.default) for p in prompts]


def ask(rows: DataFrame, prompt: str, answer: str, model: TextModel, batch: int = 25, tries: int = 3) -> DataFrame:
    """Adds the model's answer to the prompt column, ``batch`` prompts a call.

    A call that fails is tried again; a reply that is too short leaves the rest unanswered, and one that is
    too long is cut. Rows with a null prompt are not sent.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(answer, T.StringType())])

    def call(prompts: list[str]) -> list[str | None]:
        for turn in range(tries):
            try:
                got = list(model.answer(prompts))[: len(prompts)]
                return got + [None] * (len(prompts) - len(got))
            except (OSError, TimeoutError, ValueError):
                if turn == tries - 1:
                    break
        return [None] * len(prompts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # Only the prompts of a few calls are Python objects at a time.
            sent = np.flatnonzero(whole.column(prompt).is_valid().to_numpy(zero_copy_only=False))
            cuts = [0, *sent[CALLS * batch :: CALLS * batch].tolist(), whole.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = whole.slice(a, b - a)
                prompts = part.column(prompt).to_pylist()
                asked, out = [k for k, p in enumerate(prompts) if p is not None], [None] * len(prompts)
                for i in range(0, len(asked), batch):
                    own = asked[i : i + batch]
                    for k, got in zip(own, call([prompts[k] for k in own]), strict=True):
                        out[k] = got
                yield part.append_column(answer, pa.array(out, pa.string()))

    return rows.mapInArrow(run, schema)


def ask_whole(rows: DataFrame, prompt: str, answer: str, model: TextModel, hash_col: str | None = None, tries: int = 3) -> DataFrame:
    """Answers that end with a closing sign: what is cut off is asked again, at most ``tries`` times, and stays null if it never ends.

    With ``hash_col`` rows whose prompt still has the hash they were answered under are not sent and keep their answer.
    """
    from .gates import ENDINGS

    whole = F.right(F.rtrim(F.col(answer)), F.lit(1)).isin(*ENDINGS)
    done = None
    if hash_col is not None:
        same = F.coalesce(F.md5(prompt) == F.col(hash_col), F.lit(False))
        done, rows = rows.filter(same), rows.filter(~same)
    rows = rows.drop(answer)
    for turn in range(tries):
        asked = settle(ask(rows, prompt, answer, model))
        cut = ~F.coalesce(whole, F.lit(False)) & F.col(prompt).isNotNull()
        kept = asked if turn == tries - 1 else asked.filter(~cut)
        if turn == tries - 1:
            kept = kept.withColumn(answer, F.when(~cut, F.col(answer)))
        done = kept if done is None else done.unionByName(kept, allowMissingColumns=True)
        rows = asked.filter(cut).drop(answer)
    return done


def ask_survivors(rows: DataFrame, cheap: Column, prompt: str, answer: str, model: TextModel, otherwise: str) -> DataFrame:
    """Two phases: only rows that pass the cheap filter are sent; the rest get the fixed answer."""
    sent = ask(rows.filter(cheap), prompt, answer, model)
    return sent.unionByName(rows.filter(~F.coalesce(cheap, F.lit(False))).withColumn(answer, F.lit(otherwise)))


def accept_rewrite(original: Column, rewritten: Column, least_share: float = 0.3) -> Column:
    """A rewrite under the least share of the original's length, or none, leaves the original."""
    kept = F.length(rewritten) >= least_share * F.length(original)
    return F.when(F.coalesce(kept, F.lit(False)), rewritten).otherwise(original)


def verdict(answer: Column, block: str = "BLOCK", default: bool = True) -> Column:
    """Whether an answer lets an item pass; a missing answer is the default."""
    return F.when(answer.isNull(), F.lit(default)).otherwise(~F.upper(answer).startswith(block))


def validated(answer: Column, allowed: list[str], default: str) -> Column:
    return F.when(answer.isin(allowed), answer).otherwise(default)


def best_attempt(attempts: DataFrame, key: str, values: str, attempt: str) -> DataFrame:
    """The attempt with most values; the first one wins ties."""
    return attempts.groupBy(key).agg(F.max_by(values, F.struct(F.size(values), -F.col(attempt))).alias(values))
