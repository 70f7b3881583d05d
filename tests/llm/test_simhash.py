"""SimHash near-dedup against brute force."""

from itertools import combinations, product

import numpy as np
import pytest
import xxhash

from quillstream.llm import simhash


def brute(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 3:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprint_by_definition():
    text = "The cat sat\ton THE mat  The cat"
    words = text.lower().split()
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
    assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(b"") == simhash.fingerprint(None) == 0
    assert simhash.fingerprint(b"one Two") == xxhash.xxh64_intdigest(b"one two", 42)


@pytest.mark.parametrize("block", [4000, 5])
def test_links_equal_brute_force(spark, block):
    rng = np.random.default_rng(3)
    fps = [0, 7, (1 << 64) - 1]
    for centre in rng.integers(0, 1 << 63, 25):
        fps.append(int(centre))
        for _ in range(12):
            x = int(centre)
            for bit in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = sorted(set(fps))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    nodes = spark.createDataFrame(signed, "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, block=block)).collect()}
    want = brute(fps)
    for (i, j) in product(range(len(fps)), repeat=2):
        if i < j:
            a, b = (got.get(signed[k][0], signed[k][0]) for k in (i, j))
            assert (a == b) == (want[i] == want[j])


def test_near_copies_defined_cases(spark):
    rows = [(1, "a b c d", "x"), (2, "A b c d", "x"), (3, None, "x"), (4, "", "x"), (5, "zz yy xx ww", None), (5, "zz yy xx ww", None), (None, "q r s t", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r["id"], r["component_id"]) for r in simhash.near_copies(docs).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)} <= got
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 3, 5, 5]
    assert simhash.near_copies(docs.limit(0)).count() == 0
