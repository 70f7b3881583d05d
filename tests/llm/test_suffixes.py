"""Removal of repeated passages against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np

from quillstream.llm import suffixes


def brute(texts, length=200):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def make(seed=4):
    r = random.Random(seed)
    words = ["the", "of", "and", "ñandú", "über", "x", "longer", "étude", "stone", "river"] + ["".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(200)]

    def say(n):
        return " ".join(r.choices(words, k=n))

    passages = [say(60) for _ in range(4)]
    texts = [None, "", "short", "a" * 1000, "ab" * 300, "x" * 199, "y" * 200, "y" * 200, say(10) * 40]
    for i in range(40):
        t = say(r.randint(5, 300))
        if i % 3 == 0:
            at = r.randint(0, len(t))
            t = t[:at] + passages[i % 4] + t[at:]
        texts.append(t)
        if i % 7 == 0:
            texts.append(t)
        if i % 5 == 0:
            texts.append(t[:300] + "!" + t[300:])
    texts.append(passages[0][:199])
    texts.append(passages[0][:200])
    return texts


def check(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["id"]: r for r in suffixes.remove_repeats(docs, **options).collect()}
    for i, want in enumerate(brute([(t or "").encode() for t in texts])):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, i
    return got


def test_equals_brute_force(spark):
    got = check(spark, make())
    for r in got.values():
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_every_suffix_has_one_anchor(monkeypatch):
    monkeypatch.setattr(suffixes, "_SLICE", 2048)
    monkeypatch.setattr(suffixes, "_AT", suffixes.np.uint64(4095))
    texts = [(t or "").encode() * 3 for t in make(9)]
    seen = Counter()
    for data, origin, base, first, count, h, lead in suffixes.anchors(texts):
        for (text, offset), b, f, n in zip(origin.tolist(), base.tolist(), first.tolist(), count.tolist(), strict=True):
            assert data[f : f + n + 199].tobytes() == texts[text][offset + f - b : offset + f - b + n + 199]
            seen.update((text, offset + f - b + i) for i in range(n))
    assert set(seen.values()) == {1}
    assert len(seen) == sum(max(0, len(t) - 199) for t in texts)


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    check(spark, [r["text"] for r in rows])
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeats(docs).count() == 0


def test_a_large_bucket_is_sorted_by_classes(monkeypatch):
    r = np.random.default_rng(3)
    data = r.integers(0, 256, 4000).astype(np.uint8)
    data[3000:3500] = data[100:600]
    at = np.arange(len(data) - 199)
    want = suffixes.equal_suffixes(data, at)
    assert np.flatnonzero(want).tolist() == [*range(100, 401), *range(3000, 3301)]
    monkeypatch.setattr(suffixes, "STRETCH", 64)
    assert (suffixes.equal_suffixes(data, at, 100) == want).all()
    assert (suffixes.equal_suffixes(data, at[::-1].copy(), 1000) == want[::-1]).all()


def test_memory_of_a_large_bucket():
    data = np.random.default_rng(5).integers(0, 256, 3_000_000).astype(np.uint8)
    at = np.arange(len(data) - 199)
    tracemalloc.start()
    found = suffixes.equal_suffixes(data, at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not found.any()
    assert peak < 100 << 20


def test_many_places_come_in_several_batches(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "OUT_ROWS", 3)
    monkeypatch.setattr(suffixes, "CUT_ROWS", 2)
    check(spark, make(11))
