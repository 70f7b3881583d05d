"""Columns of the input that have the names of helper columns, in every operator that carries columns."""

import pytest
from pyspark.sql import functions as F

from quillstream.llm import exact_dedup, mixing, quality, simhash, surrogates

HELPERS = ["id", "taken", "size", "keep", "digest", "body", "hit", "word", "mask", "gone", "band", "entropy", "threshold", "kept", "ref", "new", "lang2", "a", "b", "s", "i", "words", "rows", "text2"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"plain words number {i} and more of them here", "en", "s1") for i in range(30)] + [(40, "mail ann@mail.example.com", "en", "s2"), (41, "mail ann@mail.example.com", "en", "s2"), (42, None, None, None), (None, "", "en", "s1"), (43, "x" * 100_000, "en", "s1")]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return made.select("*", *(F.col("doc_id").alias(p + c) for p in ("__", "___") for c in HELPERS), F.lit("mine").alias("pii_count"))


def test_columns_come_through(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    made = {
        "exact": exact_dedup.drop_copies(docs),
        "quality": quality.drop_low_quality(docs, labels),
        "near": simhash.drop_near_copies(docs),
        "mix": mixing.mix(docs),
    }
    for name, out in made.items():
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[p + c] == r["doc_id"] for p in ("__", "___") for c in HELPERS) and r["pii_count"] == "mine", name
    out = surrogates.replace(docs, "k")
    assert out.columns == [*(c for c in docs.columns if c != "pii_count"), "pii_count", "pii_kinds"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[40]["text"] == rows[41]["text"] != "mail ann@mail.example.com" and rows[40]["pii_count"] == 1 and rows[40]["__new"] == 40
    assert rows[42]["text"] is None and rows[None]["text"] == "" and len(rows[43]["text"]) == 100_000
