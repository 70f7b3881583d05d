"""Exact dedup: groups, true digest collisions, repeated rows."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillstream.llm import exact_dedup

ROWS = [(1, "a", "x"), (5, "a", "y"), (3, "a", None), (2, None, "x"), (4, "", "x"), (7, "b" * 50_000, "x"), (8, "b" * 50_000, "x"), (9, "c", "x"), (10, "c ", "x"), (None, "a", "x"), (None, "d", "x")]
SCHEMA = "doc_id long, text string, digest string"


def weak(text):
    """A digest that collides often."""
    return F.unhex(F.lpad(F.hex(F.length(text) % 2), 2, "0"))


@pytest.mark.parametrize("digest", [exact_dedup.sha256, weak])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_groups(spark, digest, keep):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[t or ""].append(i)
    pick = max if keep == "largest" else min
    want = sorted(((i, pick([x for x in groups[t or ""] if x is not None], default=None), len(groups[t or ""])) for i, t, _ in ROWS), key=str)
    got = exact_dedup.copies(docs, keep=keep, digest=digest).collect()
    assert sorted(((r["id"], r["keep_id"], r["group_size"]) for r in got), key=str) == want
    assert all(r["kept"] == (r["id"] == r["keep_id"]) for r in got)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, weak])
def test_drop_copies_keeps_one_row_of_each_text(spark, digest):
    docs = spark.createDataFrame([*ROWS, (5, "a", "again"), (9, "c", "x")], SCHEMA)
    kept = exact_dedup.drop_copies(docs, digest=digest)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted([5, 4, 8, 9, 10, None], key=str)
    assert len({r["text"] or "" for r in rows}) == 6


def test_compaction_merges_levels(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    runs = [str(tmp_path / f"r{i}") for i in range(2)]
    exact_dedup.flush(docs.filter("doc_id <= 4"), runs[0])
    exact_dedup.flush(docs.filter("doc_id > 4"), runs[1])
    levels = [str(tmp_path / f"l{i}") for i in range(2)]
    for run, level in zip(runs, levels, strict=True):
        exact_dedup.compact(spark, [run], level)
    exact_dedup.compact(spark, levels, str(tmp_path / "top"), levelled=True)
    top = {bytes(r["digest"]): (r["min_id"], r["max_id"], r["rows"]) for r in spark.read.parquet(str(tmp_path / "top")).collect()}
    import hashlib

    assert top[hashlib.sha256(b"a").digest()] == (1, 5, 3) and top[hashlib.sha256(b"").digest()] == (2, 4, 2)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.copies(docs).count() == 0 and exact_dedup.drop_copies(docs).count() == 0


@pytest.mark.parametrize("share", [1, 10_000])
def test_hot_digests_and_repeated_ids(spark, monkeypatch, share):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", share)
    rows = [(i, "copied text" if i % 3 else f"own {i}", "x") for i in range(300)] + [(299, "copied text", "again")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = exact_dedup.copies(docs).collect()
    size = sum(t == "copied text" for _, t, _ in rows)
    assert len(got) == 301 and sum(r["group_size"] == size for r in got) == size and sum(r["kept"] for r in got if r["group_size"] > 1) == 2
    left = exact_dedup.drop_copies(docs).collect()
    assert len(left) == 101 and len({r["text"] for r in left}) == 101
