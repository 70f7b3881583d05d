"""Token alignment against a reading of the contract token by token, with the libraries' own encoders."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillstream.llm import alignment

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "Hello world, this is plain.", "", None, "don't we'll  \n\n two  spaces\t tab", "日本語のテキスト und Straße", "emoji \U0001f600\U0001f468‍\U0001f469 x", "a ▁ b", " leading", "trailing ", "x" * 5000,
    "<|endoftext|> and </s> <s> <unk> are plain", "<0x41> is text", " nbsp 　 wide", "é combining ﬁ", "\x00 nul \x1f", "Hello world, this is plain.", "﻿bom", "123456789 1,234.50", "кириллица и текст",
]


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE)


def tokens(encoders, text):
    """[(id, bytes)] of both sides, or two empty lists."""
    a, b = encoders
    if not text:
        return [], []
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(i): i for i in shown} | {chr(256 + k): i for k, i in enumerate(i for i in range(256) if i not in shown)}
    left = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == raw == b"".join(x for _, x in right) else ([], [])


def spans(side):
    out, at = [], 0
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def read(encoders, rows):
    """What the query returns, from all pairs of tokens of a document."""
    found, counts = [], Counter()
    for name, text in rows:
        a, b = (spans(s) for s in tokens(encoders, text))
        links, j = [], 0
        for i, x, y in a:
            while j and b[j - 1][2] > x:
                j -= 1
            while j < len(b) and b[j][1] < y:
                if b[j][2] > x:
                    links.append((i, b[j][0]))
                j += 1
        counts.update(links)
        groups, ga, gb = [], {}, {}
        shared = sorted({t[2] for t in a} & {t[2] for t in b})
        place = lambda e: next(k for k, s in enumerate(shared) if e <= s)  # noqa: B023, E731
        for side, into in ((a, ga), (b, gb)):
            for i, _, e in side:
                into.setdefault(place(e), []).append(str(i))
        groups = [(ga[k], gb[k]) for k in range(len(shared))]
        found.append((name, len(a), len(b), links, groups))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for name, n_a, n_b, links, groups in found:
        text = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((name, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha, sum(len(x) * len(y) for x, y in groups)))
    return sorted(out, key=str)


def test_like_reading_token_by_token(spark, encoders, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 100)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "again the same id"), (None, "no id at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("mine")).withColumn("n", F.lit(1)).repartition(3)
    got = sorted((tuple(r) for r in alignment.statistics(docs, BYTE, PIECE).collect()), key=str)
    assert got == read(encoders, rows)
    assert [r[1:] for r in got if r[0] in (1, 2, 6)] == [(0, 0, 0, 0, 0, 0, "", 0)] * 3


def test_documents_table(spark, encoders):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 20000")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()][:40]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in alignment.statistics(some, BYTE, PIECE).collect()), key=str) == read(encoders, rows)


def test_align_and_products(spark, encoders):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    aligned = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), BYTE, PIECE)
    n = 0
    for r in aligned.collect():
        a, b = (spans(s) for s in tokens(encoders, TEXTS[r["doc_id"]]))
        assert list(r["a_ids"]) == [t[0] for t in a] and list(r["b_ids"]) == [t[0] for t in b]
        assert [(x["a"], x["b"]) for x in r["links"]] == [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]]
        assert [i for g in r["groups"] for i in g["a"]] == list(r["a_ids"]) and [i for g in r["groups"] for i in g["b"]] == list(r["b_ids"])
        assert [g["end"] for g in r["groups"]] == sorted({t[2] for t in a} & {t[2] for t in b})
        n += sum(len(g["a"]) * len(g["b"]) for g in r["groups"])
    assert alignment.products(aligned).count() == n


def test_empty_table(spark):
    assert alignment.statistics(spark.createDataFrame([], "doc_id long, text string"), BYTE, PIECE).count() == 0
