"""Hard negatives against brute force: ties, repeated rows, crowded vectors, unusable rows, large values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import hard_negatives

SCHEMA = "vec_id long, label int, v array<double>, id string, q string"


def brute(rows, every, k=5):
    """Rows (anchor, positive, rank, negative, scores) by comparing all pairs in whole numbers."""
    rows = [(i, label, [int(x) for x in v]) for i, label, v in rows]
    out = []
    for i, label, v in rows:
        if i % every:
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w, strict=True))
        best = sorted((-score(w), j) for j, m, w in rows if m == label and j != i)[:k]
        others = sorted((-score(w), j) for j, m, w in rows if m != label)
        for p, positive in best:
            fits = [(s, j) for s, j in others if 80 * -p <= 100 * -s <= 100 * -p][:k]
            out += [(i, positive, rank, j, -p, -s) for rank, (s, j) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, every=10):
    table = spark.createDataFrame([(*r, "mine", "mine") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hard_negatives.mine(table, F.col("id") % every == 0).collect())


@pytest.fixture()
def small(monkeypatch):
    """Many rings and blocks on few rows."""
    for name, value in {"SAMPLE_ROWS": 64, "PIVOTS": 5, "RINGS": 4, "RING_ROWS": 10, "BLOCK_ROWS": 32, "FIRST_ROWS": 20, "STEP_ROWS": 8, "TASK_QUERIES": 16}.items():
        monkeypatch.setattr(hard_negatives, name, value)


def test_like_brute_force(spark, small):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(6, 8)) * 40
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in np.floor(middle[i % 6] + rng.normal(size=8) * 15)]) for i in range(300)]
    want = brute(rows, 10)
    assert len(want) > 300 and mined(spark, rows) == want


def test_equal_vectors_and_repeated_rows(spark, small):
    rows = [(i, i % 2, [5.0, -3.0]) for i in range(100, 190)] + [(200 + i, i % 3, [float(i % 4), 2.0]) for i in range(30)] + [(110, 0, [5.0, -3.0]), (111, 1, [5.0, -3.0]), (300, 1, [0.0, 0.0])]
    assert mined(spark, rows) == brute(rows, 10)


@pytest.mark.parametrize("scale", [1.0, 1e4, 2.0**27])
def test_large_values_stay_exact(spark, small, scale):
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, [float(np.floor(x * scale)) for x in rng.normal(size=4)]) for i in range(60)]
    assert mined(spark, rows) == brute(rows, 10)


def test_unusable_rows_take_no_part(spark):
    good = [(i, i % 2, [float(i), 1.0]) for i in range(12)]
    bad = [(None, 1, [9.0, 9.0]), (20, None, [9.0, 9.0]), (30, 1, None), (40, 1, [None, 1.0]), (50, 1, [float("nan"), 1.0]), (60, 0, [float("inf"), 1.0]), (70, 0, [1.0]), (80, 0, []), (90, 0, [1e300, 1.0])]
    assert mined(spark, good + bad) == brute(good, 10)


def test_few_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 0, [1.0])]) == [] and mined(spark, [(0, 0, [1.0])]) == []
    assert mined(spark, [(0, 0, [2.0]), (1, 0, [3.0]), (2, 1, [3.0])]) == [(0, 1, 1, 2, 6, 6)]


def test_annuli_leave_rings_out(spark, monkeypatch):
    """On clustered rows most rings are never sent a query."""
    monkeypatch.setattr(hard_negatives, "RING_ROWS", 20)
    monkeypatch.setattr(hard_negatives, "FIRST_ROWS", 40)
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, [float(x) for x in np.floor(1000 * np.eye(4)[i % 4] + rng.normal(size=4) * 10)]) for i in range(800)]
    index = hard_negatives.Index(hard_negatives.usable_vectors(spark.createDataFrame(rows, "vec_id long, label int, v array<double>"), "vec_id", "label", "v"))
    asked = index.table.filter("id % 10 = 0").select("q", "id", "label", "v", F.array(F.lit(-(1 << 63))).alias("los"), F.array(F.lit((1 << 63) - 1)).alias("his"))
    routed = asked.withColumn("done", F.lit(None).cast("array<int>")).mapInArrow(index._route(True), hard_negatives._ROUTED_DDL)
    assert 80 <= routed.count() <= 80 * len(index.ring) // 2
