"""SimHash near-deduplication by anchor-point covering (op 5).

Fingerprints are 64-bit SimHash values of word shingles. Two fingerprints that differ in at most 3 bits
differ in at most 1 bit in one of their halves, so each half is covered on its own. The anchors of a half
are the words of the perfect Hamming code of length 31 times the free top bit: every half lies within the
covering radius 1 of exactly one anchor, its home. A fingerprint is replicated to every anchor within
radius + threshold = 2 of its half (at most 17). A pair then meets at the home anchor of either member,
where whole fingerprints are compared. Equal fingerprints are one node from the start, and the comparison
at an anchor emits the links of a spanning forest, so large groups of copies give few rows.

An anchor with very many members is dealt out: its homes and members fall into blocks by hash and each
pair of blocks is compared in a task of its own; no comparison is dropped.

Defined cases: null text is the empty text, whose fingerprint is zero and links like any other; rows that
repeat a doc_id are one member; ids must be integers, a null id is carried but never names a component
while another id is there; a text's words are read whole, however many; a bit that exactly half of the
shingles set is 0; an empty table gives an empty result; further columns are ignored, or carried
by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, settle
from .components import components

SEED = 42
#: Members of an anchor that are compared in one go; above it an anchor is dealt out in blocks.
BLOCK = 4_000
#: Groups up to this size are compared for all anchors of a batch at once.
SMALL = 64


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of the ``width``-word shingles: a bit is 1 if set in over half of the XXH64 values."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = [digest(join(words), SEED)]
    else:
        hashes = [digest(join(s), SEED) for s in zip(*(words[i:] for i in range(width)), strict=False)]
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int.from_bytes(np.packbits(ones).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) for every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(x, width) for x in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _syndrome(half: Column) -> Column:
    """XOR of the positions 1..31 of the bits that are set in the low 31 bits."""
    masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
    out = F.lit(0)
    for k, mask in enumerate(masks):
        out = out.bitwiseOR(F.bit_count(half.bitwiseAND(F.lit(mask))).cast("int").bitwiseAND(F.lit(1)) * (1 << k))
    return out


def _anchors(half: Column) -> tuple[Column, Column]:
    """(home anchor, all further anchors within distance 2) of a 32-bit half given as a long."""
    low = half.bitwiseAND(F.lit((1 << 31) - 1))
    s = _syndrome(low)
    flip = lambda p: F.when(p > 0, F.call_function("shiftleft", F.lit(1).cast("long"), p - 1)).otherwise(F.lit(0).cast("long"))
    home = half.bitwiseXOR(flip(s))
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.lit(31)), lambda i: F.struct(i.alias("i"), i.bitwiseXOR(s).alias("j"))), lambda p: p["i"] < p["j"])
    around = F.transform(pairs, lambda p: half.bitwiseXOR(flip(p["i"])).bitwiseXOR(flip(p["j"])))
    across = F.array(home.bitwiseXOR(F.lit(1 << 31)))
    return home, F.when(s > 0, F.concat(around, across)).otherwise(across)


def replicate(nodes: DataFrame) -> DataFrame:
    """(anchor, home, fp): every fingerprint at its anchors; the top bit of ``anchor`` tells the half."""
    rows = None
    for k in range(2):
        half = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)) if k == 0 else F.shiftrightunsigned("fp", 32)
        at = nodes.select("fp", half.alias("half")).select("fp", *(c.alias(n) for c, n in zip(_anchors(F.col("half")), ("own", "others"), strict=True)))
        tag = F.lit(k << 32)
        part = at.select(F.explode(F.concat(F.array(F.struct(F.col("own").alias("anchor"), F.lit(True).alias("home"))), F.transform("others", lambda x: F.struct(x.alias("anchor"), F.lit(False).alias("home"))))).alias("at"), "fp")
        part = part.select(F.col("at.anchor").bitwiseOR(tag).alias("anchor"), F.col("at.home").alias("home"), "fp")
        rows = part if rows is None else rows.unionAll(part)
    return rows


def _forest(fp: np.ndarray, home: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over the pairs with a home member within the threshold."""
    label, out = np.arange(len(fp)), []
    for i in np.flatnonzero(home):
        near = np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= threshold)
        for other in np.unique(label[near]):
            if other != label[i]:
                out.append((int(fp[other]), int(fp[label[i]])))
                label[label == other] = label[i]
    return out


def _links_in(key: np.ndarray, home: np.ndarray, fp: np.ndarray, threshold: int) -> list[np.ndarray]:
    """Links among rows sorted by key; each key's rows are complete."""
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[cut, len(key)])
    homes = np.add.reduceat(home.astype(np.int64), cut)
    use = (size > 1) & (homes > 0)
    keep = np.repeat(use & (size <= SMALL), size)
    out = []
    k, h, f = key[keep], home[keep], fp[keep]
    shift = 1
    while shift < len(k):
        same = k[shift:] == k[:-shift]
        if not same.any():
            break
        hit = same & (h[shift:] | h[:-shift]) & (np.bitwise_count(f[shift:] ^ f[:-shift]) <= threshold)
        out.append(np.stack([f[:-shift][hit], f[shift:][hit]], axis=1))
        shift += 1
    for at, n in zip(cut[use & (size > SMALL)], size[use & (size > SMALL)], strict=True):
        found = _forest(fp[at : at + n], home[at : at + n], threshold)
        if found:
            out.append(np.array(found, dtype=np.uint64))
    return out


def links(nodes: DataFrame, threshold: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints of ``nodes`` within reach at ``threshold`` bits."""
    if not 0 <= threshold <= 3:
        raise ValueError("the covering of halves holds for thresholds from 0 to 3")
    rows = replicate(nodes)
    crowded = settle(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > block).select("anchor", F.ceil(F.col("members") / block).cast("int").alias("blocks")))
    cell = F.lit(0)
    if not crowded.isEmpty():
        rows = rows.join(crowded, "anchor", "left")
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        span = F.sequence(F.lit(0), F.col("blocks") - 1)
        row_of = F.transform(span, lambda j: mine * F.col("blocks") + j)
        column_of = F.transform(span, lambda i: i * F.col("blocks") + mine)
        own = F.transform(F.array_union(F.when(F.col("home"), row_of).otherwise(F.array().cast("array<int>")), column_of), lambda c: F.struct(c.alias("cell"), (F.col("home") & (F.floor(c / F.col("blocks")) == mine)).alias("home")))
        dealt = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("cell"), F.col("home").alias("home")))).otherwise(own)
        rows = rows.select("anchor", "fp", F.explode(dealt).alias("d")).select("anchor", F.col("d.home").alias("home"), "fp", F.col("d.cell").alias("cell"))
        cell = F.col("cell")
    rows = rows.select("anchor", cell.alias("cell"), "home", "fp")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "anchor", "cell").sortWithinPartitions("anchor", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(key, home, fp):
            for pairs in _links_in(key, home, fp, threshold):
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i].astype(np.uint64).view(np.int64)) for i in range(2)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            a, c, h, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            # One key of anchor and cell: anchors take 33 bits.
            got = (a.astype(np.int64) * np.int64(1 << 30) + c, h.astype(bool), f.view(np.uint64))
            key, home, fp = (np.concatenate(x) for x in zip(held, got, strict=True)) if held else got
            other = np.flatnonzero(key != key[-1])
            last = int(other[-1]) + 1 if len(other) else 0
            yield from flush(key[:last], home[:last], fp[:last]) if last else ()
            held = [key[last:], home[last:], fp[last:]]
        if held:
            yield from flush(*held)

    return dealt.mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, threshold: int = 3) -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the smallest id within reach."""
    own = settle(fingerprints(docs, id_col, text_col, width))
    nodes = settle(own.groupBy("fp").agg(F.min("id").alias("least")))
    found = components(links(nodes.select("fp"), threshold))
    joined = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = settle(joined.join(smallest, "root").select("fp", "component_id"))
    return own.join(classes, "fp").select("id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, threshold: int = 3) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id."""
    (gone,) = free_names(docs, "gone")
    drop = near_copies(docs, id_col, text_col, width, threshold).filter("id <> component_id").select(F.col("id").alias(gone)).distinct()
    return docs.join(settle(drop), F.col(f"`{id_col}`") == F.col(gone), "left_anti")
