"""The pipeline's stages on a small table: columns, decisions, and what the last stage packs."""

import zlib
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from quillstream.llm import packing, quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "mixing sources", "best-fit packing"]
    now = docs
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, SF).write.parquet(str(tmp_path / str(i)))
        before, now = now, spark.read.parquet(str(tmp_path / str(i)))
        seen[name] = (before, now)
        if i < 4:
            assert now.columns == docs.columns
    ids = lambda df: Counter(r[0] for r in df.select("doc_id").collect())
    before, after = seen["quality classifier"]
    assert ids(after) == ids(quality.judge(before, labels).filter("__kept"))
    before, after = seen["exact dedup"]
    largest = {}
    for r in before.collect():
        largest[r["text"] or ""] = max(r["doc_id"], largest.get(r["text"] or "", -1))
    assert ids(after) == Counter(largest.values())
    before, after = seen["simhash near-dedup"]
    groups = {r["component_id"] for r in simhash.near_copies(before).collect()}
    assert ids(after) == Counter(groups)
    before, after = seen["best-fit packing"]
    texts = [r["text"] or "" for r in before.collect()]
    encode = packing.Encoder(__import__("public_tokenizers").path("byte_bpe_50k.json")).encode
    want = Counter()
    for ids_ in encode(texts):
        for *_, n, own in packing.cut(ids_, 1024, 2):
            want[n, zlib.crc32(own)] += 1
    assert Counter((r["length"], r["ids_crc32"]) for r in after.collect()) == want


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_mixing_stage_gives_what_the_plan_takes(spark):
    from quillstream.llm import mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)["mixing sources"](spark, docs, SF)
    words = F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(mixing.WORD)))
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(words.alias("n")).collect()}
    assert got == {r["id"]: r["taken"] for r in mixing.plan(docs).filter("taken > 0").collect()}


def test_stages_on_null_empty_repeated_and_no_rows(spark, tmp_path):
    text = "A plain text of several words that is repeated here."
    rows = [(1, None, None, None, 0), (2, "", "en", "s", 0), (3, text, "en", "s", 52), (3, text, "en", "s", 52), (4, text, "en", None, 52), (5, "word " * 30_000, "en", "s", 150_000), (None, "An own text.", "en", "s", 12)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("__kept", F.lit("x"))
    for name, docs in (("few", made), ("none", made.limit(0))):
        now = docs
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}{i}")
            stage(spark, now, SF).write.parquet(path)
            now = spark.read.parquet(path)
            if i < 4:
                assert now.columns == docs.columns
            if i == 0:
                # A handful of texts says nothing about quality: the next stages take them all.
                now = docs
            if i == 1 and name == "few":
                assert sorted((r["doc_id"] or 0) for r in now.collect() if r["text"] == text) == [4]
        assert (now.count() > 0) == (name == "few")
