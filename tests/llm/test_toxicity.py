"""Toxicity: features, the learned lexicon, held-out accuracy, defined cases."""

from quillstream.llm import toxicity


def test_features():
    marks = toxicity.WordMarks(["zarg"])
    f = dict(zip(toxicity.NAMES, toxicity.features("You idiot! zargling Zargs are fine 1d1ot m*o*r*o*n".encode(), marks), strict=True))
    assert (f["base"], f["learned"], f["near"], f["masked"]) == (1, 2, 3, 2)
    assert f["exclamations"] > 0 and f["second_density"] > 0 and f["densest"] == 3
    assert len(toxicity.features(None, marks)) == len(toxicity.features(b"", marks)) == len(toxicity.NAMES)


def test_learned_stems(spark):
    rows = [(f"plain words here number {i} zargu{'abcdefgh'[i % 8]}", 1) for i in range(40)] + [(f"plain words here number {i}", 0) for i in range(200)]
    assert toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int")) == ["zar"]


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, labels).filter("held_out").join(labels.withColumnRenamed("doc_id", "id"), "id").select("score", "toxic").collect()
    found = [r["toxic"] for r in rows if r["score"] >= 0.3]
    assert sum(found) / len(found) > 0.9
    assert sum(found) / sum(r["toxic"] for r in rows) > 0.7
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "you idiot", "x"), (None, "text", "x")], "doc_id long, text string, features string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert toxicity.score(docs, labels.limit(0)).count() == 4
