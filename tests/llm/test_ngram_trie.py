"""N-gram trie scores: sequences, lookups and sums against direct computation."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillstream.llm import ngram_trie as nt


@pytest.mark.parametrize("top", [10, 1000, 10**12])
def test_elias_fano(top):
    rng = np.random.default_rng(top % 97)
    values = np.sort(rng.integers(0, top, 700))
    ef = nt.EliasFano.of([a.copy() for a in nt.EliasFano(values).arrays()])
    assert (ef.access(np.arange(700)) == values).all()
    asked = np.concatenate([values, values + 1, rng.integers(0, top + 10, 500), [0, top * 2]])
    assert (ef.find(asked) == np.searchsorted(values, asked)).all()


def test_children():
    rng = np.random.default_rng(2)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 50, (400, 2))})
    have = nt.Children(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), 60)
    for a in range(-1, 60):
        asked = np.arange(50)
        at, rank, there = have.find(np.full(50, a), asked)
        for b in range(50):
            assert there[b] == ((a, b) in set(pairs))
            if there[b]:
                assert pairs[at[b]] == (a, b) and rank[b] == sum(1 for x in pairs if x[0] == a and x[1] < b)


def test_tokens():
    texts = ["A b\tB", "", "  x ", "é\x0bÉ z"]
    h, text = nt.tokens([t.encode() for t in texts])
    words = [w for t in texts for w in [*t.encode().lower().split(), b"<end>"]]
    assert len(h) == len(words) and text.tolist() == [0] * 4 + [1] + [2] * 2 + [3] * 3
    assert len(set(zip(h.tolist(), words, strict=True))) == len(set(words)) == len(set(h.tolist()))


def brute(rows):
    toks = {i: [*(t or "").encode().lower().split(), None] for i, t in rows}
    train = [i for i, _ in rows if not nt.held_out_by_id(i)]
    c = Counter(w for i in train for w in toks[i])
    n, v = sum(c.values()), len(c)
    base = {i: sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in toks[i]) for i in toks}
    known = {i: sum(c[w] > 0 for w in toks[i]) for i in toks}
    return toks, c, n, v, base, known


def make():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[int(x)] for x in (rng.zipf(1.3, rng.integers(0, 80)) % 60))) for i in range(120)]
    return [*rows, (500, None), (501, "unseen Words only"), (502, "w1 W1\n w2")]


@pytest.mark.parametrize("shards", [1, 5])
def test_scores(spark, shards):
    rows = make()
    toks, c, n, v, base, known = brute(rows)
    got = {r["id"]: r for r in nt.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), shards=shards).collect()}
    assert set(got) == set(toks)
    for i, r in got.items():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(toks[i]), known[i], n, nt.held_out_by_id(i))
        assert abs(r["base_score"] - base[i]) < 1e-6 * max(1, abs(base[i]))
        assert r["score"] < 0
    if shards == 1:
        # One shard has one discount per order: the model by definition, without quantisation.
        two, three = Counter(), Counter()
        for i in toks:
            if not nt.held_out_by_id(i):
                t = [b"<s>", b"<s>", *toks[i]]
                two.update(zip(t[1:], t[2:]))
                three.update(zip(t, t[1:], t[2:]))
        d2, d3 = (nt._discount(np.array(list(x.values()))) for x in (two, three))
        s2, s3 = defaultdict(list), defaultdict(list)
        for (b, _), k in two.items():
            s2[b].append(k)
        for (a, b, _), k in three.items():
            s3[a, b].append(k)

        def p(a, b, w):
            low = (c[w] + 1) / (n + v + 1)
            if b in s2:
                low = max(two[b, w] - d2, 0) / sum(s2[b]) + d2 * len(s2[b]) / sum(s2[b]) * low
            if (a, b) in s3:
                low = max(three[a, b, w] - d3, 0) / sum(s3[a, b]) + d3 * len(s3[a, b]) / sum(s3[a, b]) * low
            return low

        for i, r in got.items():
            t = [b"<s>", b"<s>", *toks[i]]
            want = sum(math.log10(p(*x)) for x in zip(t, t[1:], t[2:]))
            assert abs(r["score"] - want) < 0.02 * abs(want) + 0.05, i


@pytest.mark.parametrize("shards", [1, 5])
def test_base_is_the_add_one_unigram(spark, shards):
    rows = make()
    toks, c, n, v, *_ = brute(rows)
    for r in nt.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), shards=shards).collect():
        assert abs(r["base_score"] - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks[r["id"]])) < 1e-6 * max(1, abs(r["base_score"]))


def by_definition(rows):
    """Scores by dictionaries: one model, discounts over all n-grams."""
    toks, c, n, v, *_ = brute(rows)
    two, three, s2, s3 = Counter(), Counter(), defaultdict(list), defaultdict(list)
    for i in toks:
        if not nt.held_out_by_id(i):
            t = [b"<s>", b"<s>", *toks[i]]
            two.update(zip(t[1:], t[2:]))
            three.update(zip(t, t[1:], t[2:]))
    d2, d3 = (nt._discount(np.array(list(x.values()))) for x in (two, three))
    for (b, _), k in two.items():
        s2[b].append(k)
    for (a, b, _), k in three.items():
        s3[a, b].append(k)

    def p(a, b, w):
        low = (c[w] + 1) / (n + v + 1)
        for counts, d, own, key in ((two, d2, s2.get(b), (b, w)), (three, d3, s3.get((a, b)), (a, b, w))):
            if own:
                low = max(counts[key] - d, 0) / sum(own) + d * len(own) / sum(own) * low
        return low

    out = {}
    for i in toks:
        t = [b"<s>", b"<s>", *toks[i]]
        out[i] = sum(math.log10(p(*x)) for x in zip(t, t[1:], t[2:]))
    return out


@pytest.mark.parametrize(("shards", "parts"), [(1, 0), (5, 0), (5, 4), (40, 30)])
def test_placement_does_not_alter_the_model(spark, shards, parts, monkeypatch):
    words = np.sort(np.concatenate([nt.tokens([b"w0 w1 w2 w3 w4"])[0]]))
    common = np.sort(nt.tokens([b"w1 w7 w9"])[0])
    hot = (words, np.full(len(words), parts, np.uint64)) if parts else (np.empty(0, np.uint64), np.empty(0, np.uint64))
    monkeypatch.setattr(nt, "frequent_words", lambda *_: (hot, common))
    rows = make()
    want = by_definition(rows)
    got = {r["id"]: r["score"] for r in nt.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), shards=shards).collect()}
    assert set(got) == set(want)
    for i, x in got.items():  # what is left is quantisation
        assert abs(x - want[i]) < 0.02 * abs(want[i]) + 0.05, i


def test_scores_do_not_depend_on_the_number_of_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, *others = ({r["id"]: r["score"] for r in nt.score(docs, shards=n).collect()} for n in (1, 5, 16))
    assert len(one) == 200
    for other in others:
        assert max(abs(x - other[i]) / max(1, abs(x)) for i, x in one.items()) < 1e-9


def test_defined_cases(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")
    got = nt.score(docs).collect()
    assert len(got) == 3 and all(r["n_known"] == 3 for r in got)
    assert nt.score(docs.limit(0)).count() == 0


def test_counted_columns_against_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001/documents.parquet"
    got = nt.score(spark.read.parquet(path)).select("id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").toPandas()
    con = duckdb.connect()
    con.create_function("held", lambda i: zlib.crc32(str(i).encode()) % 7 == 2, ["BIGINT"], "BOOLEAN")
    want = con.sql(f"""WITH d AS (SELECT doc_id AS id, held(doc_id) AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), chr(10)) AS w FROM '{path}'),
        t AS (SELECT id, held_out, unnest(w) AS w FROM d), c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
        SELECT id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n)::BIGINT AS train_tokens, sum(log10((coalesce(c, 0) + 1) / (n + 1 * (v + 1)))) AS base_score FROM t LEFT JOIN c USING (w), n GROUP BY id""").df()
    got, want = (f.sort_values("id").reset_index(drop=True) for f in (got, want))
    assert got[["id", "held_out", "n_tokens", "n_known", "train_tokens"]].astype("int64").equals(want[["id", "held_out", "n_tokens", "n_known", "train_tokens"]].astype("int64"))
    assert np.allclose(got["base_score"], want["base_score"], rtol=1e-9)
