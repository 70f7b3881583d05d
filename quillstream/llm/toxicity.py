"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration (op 4).

Features of a whole text: densities of a base lexicon and of a lexicon learned from the training labels,
their nearness to words of the second person, the densest window, shares of capitals, punctuation,
symbols and digits, and obfuscation (lexicon words that appear only once masking signs are removed and
digits read as letters). Trees are fitted on one part of a bounded sample of labelled rows and calibrated
by isotonic regression on the other; every document is then scored.

Defined cases: a null text is the empty text and is scored like any other; labelled rows without their
document or with a null label are not learned from, repeated labels of a document count once (toxic if
any is); a null doc_id is not held out; features are rates over the whole text, however long it is, and equal
ones give equal scores; without both labels among the training rows every score is the share of toxic ones (0 without
any); rows that repeat a doc_id are scored one by one; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Labelled rows that are fitted on at most (in expectation, by hash of the id); stems the lexicon may learn; their least share of toxic and least odds ratio.
FIT_ROWS, LEARNED_WORDS, LEAST_SHARE, LEAST_ODDS = 20_000, 300, 0.03, 20.0

# Common insults and second-person words in English, French, German and Spanish.
INSULTS = """
abruti abrutie asshole bastard bitch bloody bobo clown connard connasse crap cretin crétin damn disgusting
dumb dumbass estúpida estúpido fool fuck fucking garbage idiot idiota idiote idiotic idioten imbecile imbécil
imbécile jerk loser losers lunatic moron morons moronic pathetic pig pute salaud salope scum shit sick stupid
stupide dumm dummkopf arschloch scheisse scheiße trottel blöd blödmann hurensohn mierda puta puto pendejo cabrón
gilipollas tonto tonta trash ugly useless vermin worthless wretch
""".split()
SECOND_PERSON = """
you your yours yourself youre u ur tu toi te ton ta tes vous votre vos du dich dir dein deine deiner ihr euch
euer usted ustedes ti tus vosotros vuestro
""".split()

_PUNCTUATION = bytes(i for i in range(33, 127) if not chr(i).isalnum())
_SPACED = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
_READ = bytes.maketrans(b"013457@$!", b"oieastasi")
_CALLS = re.compile(rb"!+(?![a-z0-9])")
_MASKS = b"*.-_#%&~^|+=/\\"
_UPPER, _LETTERS, _DIGITS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)]), b"0123456789"
NAMES = ["log_words", "base", "base_density", "learned", "learned_density", "near", "near_density", "densest", "capitals", "exclamations", "questions", "punctuation", "symbols", "digits", "masked", "masked_density", "second_density"]


def _words(text: bytes) -> list[bytes]:
    return text.translate(_SPACED).split()


def _lower(text: bytes | None) -> bytes:
    return (text or b"").decode("utf-8", "ignore").lower().encode()


class WordMarks(dict):
    """Marks of a word: 1 base lexicon, 2 begins with a learned stem, 4 second person. Words seen are remembered up to a bound."""

    def __init__(self, stems: list[str]):
        super().__init__()
        self.base, self.second = ({w.encode() for w in words} for words in (INSULTS, SECOND_PERSON))
        self.stems = tuple(s.encode() for s in stems)

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        mark = self[word] = (word in self.base) + 2 * word.startswith(self.stems) + 4 * (word in self.second)
        return mark


def features(text: bytes | None, marks: WordMarks, reach: int = 5, window: int = 50) -> list[float]:
    text = text or b""
    low = _lower(text)
    own = np.frombuffer(bytes(map(marks.__getitem__, _words(low))), dtype=np.uint8)
    n, size = max(1, len(own)), max(1, len(text))
    at, spoken = np.flatnonzero(own & 3), np.flatnonzero(own & 4)
    near = densest = 0
    if len(at):
        to = np.searchsorted(spoken, at)
        where = np.concatenate(([-(10**9)], spoken, [10**9]))
        near = int((np.minimum(at - where[to], where[to + 1] - at) <= reach).sum())
        densest = int((np.searchsorted(at, at + window) - np.arange(len(at))).max())
    in_base, in_learned = int((own & 1).sum()), int((own >> 1 & 1).sum())
    # Marks of exclamation behind a word are no letters of it.
    opened = _CALLS.sub(b" ", low).translate(_READ, _MASKS).translate(_SPACED).split()
    masked = max(0, sum(1 for m in map(marks.__getitem__, opened) if m & 3) - len(at))
    count = lambda chars: len(text) - len(text.translate(None, chars))
    letters = max(1, count(_LETTERS))
    return [
        float(np.log1p(len(own))), in_base, 100 * in_base / n, in_learned, 100 * in_learned / n, near, 100 * near / n, densest,
        count(_UPPER) / letters, text.count(b"!") / size, text.count(b"?") / size, count(_PUNCTUATION) / size, count(b"*#$%&|") / size,
        count(_DIGITS) / size, masked, 100 * masked / n, 100 * len(spoken) / n,
    ]


def featurize(docs: DataFrame, learned: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, features) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = WordMarks(learned)
        for batch in batches:
            rows = [features(t, marks) for t in batch.column(1).to_pylist()]
            flat = pa.array(np.array(rows, dtype=np.float64).reshape(-1))
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["id", "features"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, features array<double>")


def _share(c: Column, salt: int) -> Column:
    """A number in [0, 1) by hash."""
    return F.pmod(F.xxhash64(F.lit(salt), c.cast("string")), F.lit(1 << 20)) / F.lit(float(1 << 20))


def stems_of(text: bytes | None) -> set[str]:
    """Beginnings of 3 to 8 letters of the words of a text."""
    words = {w.decode("utf-8", "ignore") for w in set(_words(_lower(text)))}
    return {w[:k] for w in words for k in range(3, min(8, len(w)) + 1)}


def _stem_counts(texts: DataFrame, among: frozenset[str] | None) -> DataFrame:
    """(stem, texts): in how many texts a stem stands; only the stems ``among`` where given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = stems_of(text)
                seen.update(found if among is None else found & among)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["stem", "texts"])

    return texts.select(F.col("text").cast("binary")).mapInArrow(run, "stem string, texts long").groupBy("stem").agg(F.sum("texts").alias("texts"))


def learn_lexicon(labelled: DataFrame) -> list[str]:
    """Word stems of (text, label) rows that stand in many toxic texts and far more of them than of others; at most LEARNED_WORDS.

    A stem that begins with a learned one is not learned again. What is collected is bounded by the stems
    of a text over LEAST_SHARE. Repeated texts count once.
    """
    rows = settle(labelled.dropDuplicates(["text", "label"]))
    texts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, other = texts.get(1, 0), texts.get(0, 0)
    if not toxic or not other:
        return []
    common = {r["stem"]: r["texts"] for r in _stem_counts(rows.filter("label = 1"), None).filter(F.col("texts") >= max(5, LEAST_SHARE * toxic)).collect()}
    elsewhere = {r["stem"]: r["texts"] for r in _stem_counts(rows.filter("label = 0"), frozenset(common)).collect()}
    odds = {s: n / toxic / ((elsewhere.get(s, 0) + 0.5) / other) for s, n in common.items()}
    learned: list[str] = []
    for stem in sorted((s for s in common if odds[s] >= LEAST_ODDS), key=lambda s: (len(s), -common[s], s)):
        if not stem.startswith(tuple(learned)):
            learned.append(stem)
    return sorted(learned, key=lambda s: (-common[s], s))[:LEARNED_WORDS]


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: Column | None = None, fit_rows: int = FIT_ROWS, trees: int = 20, depth: int = 4) -> DataFrame:
    """(id, held_out, score) for every row of ``docs``; rows where ``held_out`` holds are not learned from."""
    out = F.coalesce(F.crc32(F.col("id").cast("string")) % 4 == 2 if held_out is None else held_out, F.lit(False))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("label is not null and id is not null").groupBy("id").agg(F.max("label").alias("label"))
    known = settle(known.filter(~out))
    share = min(1.0, fit_rows / max(1, known.count()))
    sampled = _share(F.col("id"), 4) < share
    labelled = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(sampled).join(known.filter(sampled), "id").select("text", "label")
    learned = learn_lexicon(labelled)
    rows = settle(featurize(docs, learned, id_col, text_col))
    train = settle(rows.filter(sampled).join(known, "id").select("id", array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label")).coalesce(8))
    seen = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if len(seen) < 2 or min(seen.values()) < 10:
        total = sum(seen.values())
        return rows.select("id", out.alias("held_out"), F.lit(seen.get(1.0, 0) / total if total else 0.0).alias("score"))
    aside = _share(F.col("id"), 5) < 0.3
    trees_model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, maxBins=64, seed=7, subsamplingRate=0.8).fit(train.filter(~aside))
    raw = lambda df: trees_model.transform(df).withColumn("raw", vector_to_array("probability")[1])
    steps = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(settle(raw(train.filter(aside)).select("raw", "label")))
    scored = steps.transform(raw(rows.select("id", array_to_vector("features").alias("features"))))
    # A thousandth of the uncalibrated value keeps the trees' order within a step of the calibration.
    final = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.999 * F.col("calibrated") + 0.001 * F.col("raw")))
    return scored.select("id", out.alias("held_out"), final.alias("score"))
