"""Best-fit packing: exact ids, gapless places, few sequences."""

from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest

from quillstream.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(texts):
    from tokenizers import Tokenizer

    return [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_ids_are_those_of_tokenizers():
    assert packing.Encoder(PATH).fast is not None
    texts = ["", " ", "a", " a b", "a  b", "a b ", "don't we're 12 34x, (y)\n\nz \n q", "x\ty z w é中文 \U0001f600 ok", "<|endoftext|> a <|endoftext|>b", "a\n b", "It's  it 's", "\nfoo bar", "tab \tb c"] * 2
    assert packing.Encoder(PATH).encode(texts) == plain(texts)


def test_whole_texts_of_the_table(spark):
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()]
    assert packing.Encoder(PATH).encode(texts) == plain(texts)


def test_cut_keeps_full_pieces_behind_a_short_first():
    ids = np.arange(10, dtype="<u4").tobytes()
    assert [(k, s, n) for k, s, n, _ in packing.cut(ids, 4, 2)] == [(0, 0, 3), (1, 3, 4), (2, 7, 4)]
    assert b"".join(x for *_, x in packing.cut(ids, 4, 2)) == ids + b"\x02\0\0\0"
    assert [(k, s, n) for k, s, n, _ in packing.cut(b"", 4, 2)] == [(0, 0, 1)]


@pytest.mark.parametrize("carry", [20_000, 3])
def test_pack_round_trip(spark, carry, monkeypatch):
    monkeypatch.setattr(packing, "CARRY", carry)
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["word"] * int(n)), i) for i, n in enumerate(rng.integers(0, 60, 300))] + [(7, None, 0), (None, "x y", 0), (900, "word " * 200, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int").repartition(20)
    got = packing.pack(docs, PATH, capacity=50).collect()
    places, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        assert crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] <= 200
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["ids"]))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 50
    ids = dict(zip([i for i, *_ in rows if i != 7], plain([t or "" for i, t, _ in rows if i != 7]), strict=True))
    for name, want in ids.items():
        assert b"".join(x for _, x in sorted(pieces[name])) == want + b"\x02\0\0\0"
    total = sum(r["length"] for r in got)
    if carry > 3:
        assert len(places) <= 1.1 * total / 50  # small tasks of 15 pieces; large ones come within a thousandth
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_plan_equals_best_fit():
    rng = np.random.default_rng(3)
    for top in (8, 25, 50):
        sizes = rng.integers(1, top + 1, 400)
        counts = np.bincount(sizes, minlength=51)
        runs, fill = packing.plan_bins(counts, 50), defaultdict(int)
        for size in range(1, 51):
            own = runs[runs[:, 0] == size]
            for rank in range(counts[size]):
                _, first, each, at = own[np.searchsorted(own[:, 1], rank, "right") - 1]
                fill[at + (rank - first) // each] += size
        want = [b[0] for b in packing.best_fit([(int(n), []) for n in sizes], 50)]
        assert sorted(fill.values()) == sorted(want)


def test_blocks_in_different_tasks_fill_each_other(spark):
    n = 21_000
    low, high = (spark.range(a, a + n, 1, 1).selectExpr("id as doc_id", f"repeat(' word', {k - 1}) as text") for a, k in ((0, 6), (n, 4)))
    got = packing.pack(low.unionAll(high), PATH, capacity=10, with_ids=False)
    fills = got.groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    assert fills.sum() == 10 * n and len(fills) == n and (fills == 10).all()


def test_as_few_sequences_as_one_best_fit_over_all(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = packing.pack(docs.repartition(7), PATH, with_ids=False).select("sequence_id", "length").toPandas()
    sizes = sorted((int(n) for n in got["length"]), reverse=True)
    one = packing.best_fit([(n, []) for n in sizes], 1024)
    least = -(-sum(sizes) // 1024)
    # Bins that tasks closed nearly full waste at most what counts as nearly full.
    assert least <= got["sequence_id"].nunique() <= len(one) + 1 + packing.NEARLY_FULL * len(one) // 1024


def test_every_token_of_the_vocabulary_has_the_ids_of_tokenizers():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    texts = [whole.decode([i]) for i in range(0, whole.get_vocab_size(), 7)]
    encoder = packing.Encoder(PATH)
    assert encoder.fast is not None and encoder.encode(texts) == plain(texts)
