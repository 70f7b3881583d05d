"""Nearest neighbours: exact scores, measured recall, defined cases."""

import numpy as np
from pyspark.sql import functions as F

from quillstream.llm import nearest


def brute(ids, vectors, k):
    out = {}
    for i, v in zip(ids, vectors, strict=True):
        if i % 20 == 0:
            s = (vectors * v).sum(axis=1)
            out[i] = [(j, x) for x, j in sorted((-x, j) for x, j in zip(s, ids, strict=True) if j != i)][:k]
    return out


def test_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.collect()
    ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=float)
    want, got = brute(ids.tolist(), vectors, 20), {}
    for r in nearest.nearest(table, F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = sum(len({j for _, j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    for q, rows_ in got.items():
        assert [r for r, *_ in sorted(rows_)] == list(range(1, 21))
        for _, j, s in rows_:
            assert abs(s - float((vectors[ids == q][0] * vectors[ids == j][0]).sum())) < 1e-12


def test_norms_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(8) * rng.uniform(0.1, 10)).tolist()) for i in range(60)]
    rows += [(100 + i, rows[20][1]) for i in range(5)] + [(200, None), (220, [0.0] * 8), (240, [float("nan")] * 8), (260, [1.0, None] * 4), (280, [1.0] * 3), (None, [1.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = [(i, v) for i, v in rows if i is not None and i < 200]
    want = brute([i for i, _ in good], np.array([v for _, v in good]), 10)
    got = {}
    for r in nearest.nearest(table, F.col("id") % 20 == 0, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == {0, 20, 40, 100}
    # The copies of vector 20 come in order of their ids.
    assert [j for j in got[20] if j >= 100] == [100, 101, 102, 103, 104]
    hits = sum(len(set(got[q]) & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert nearest.nearest(table.limit(0), F.col("id") % 20 == 0).count() == 0
    few = nearest.nearest(table.filter("vec_id < 5"), F.col("id") % 20 == 0)
    assert few.count() == 4
