"""Removal of repeated passages by sorting suffixes (op 3).

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else. Suffixes are told
apart up to that length. Each belongs to an anchor in its first ``LENGTH`` bytes, the token of ``TOKEN``
bytes with the least hash, leftmost first: equal suffixes have equal anchors, and neighbouring suffixes
share theirs, so that they travel together as one short piece of text.

1. Tokens that are the anchor of suffixes in only one place in all texts cannot belong to a repeat. One
   scan counts anchors; those seen again go into a bit filter of bounded size (a full filter lets more
   pieces travel, never fewer).
2. A second scan cuts the pieces of the anchors that pass, merges equal pieces of a task, and
   range-partitions them by the leading bytes of the anchor. The splitters are quantiles of a sample of
   the counted anchors; leading bytes that fill several ranges are dealt among them by the hash.
3. Each bucket sorts its suffixes by multikey quicksort, a part of 50 bytes at a time (compared by its
   fingerprint), going deeper only where suffixes are still equal, and compares the bytes of what is
   equal to the end; a large bucket is sorted a class of its suffixes at a time. No repeat crosses a bucket boundary, since equal suffixes share their anchor; what
   crosses pieces, tasks and copies is compared there.
4. Repeated runs become byte ranges of their texts, are merged per text and cut out.

Texts are known by a digest, so copies and rows that repeat a doc_id get the same result. Defined cases: a
null text is the empty text; texts shorter than ``LENGTH`` lose nothing; a text of any length is worked on in
slices of 256 KB that overlap, so that every suffix begins in one; all places of a repeated string go, the
first one too; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, settle, shards_for

LENGTH, TOKEN, PART = 200, 64, 50
#: Bits of the filter of repeated anchors; sampled anchors for the splitters; input bytes that a bucket stands for.
FILTER_BITS, SAMPLE, BUCKET_BYTES = 1 << 26, 20_000, 2 << 20
#: Suffixes that are sorted at a time, whose keys are made at a time; ranges in a batch; texts that are cut at a time.
MOST_SORTED, STRETCH, OUT_ROWS, CUT_ROWS = 1 << 19, 1 << 13, 1 << 16, 256
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SLICE = 1 << 18
_AT = np.uint64(_SLICE * 2 - 1)


class _Powers:
    """Powers of the fingerprint's base and of its inverse, kept up to the largest size asked for."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (np.uint64(_BASE), np.uint64(_INVERSE)))
        return self.up, self.down


_POWERS = _Powers()


def _prefix(data: np.ndarray) -> np.ndarray:
    """Prefix fingerprints: the fingerprint of data[a:b] is (out[b] - out[a]) * inverse**a."""
    up, _ = _POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by running minima from both ends of blocks."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _segments(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text number, offset, bytes) of about a slice; a long text is cut so that every suffix start is in one part."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(0, len(t) - LENGTH + 1), _SLICE - LENGTH):
            part = t[at : at + _SLICE - 1]
            if len(part) < LENGTH:
                break
            if size + len(part) > _SLICE and group:
                yield group
                group, size = [], 0
            group.append((i, at, part))
            size += len(part)
    if group:
        yield group


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(data, part numbers' (text, offset, start in data), first suffix, suffixes, anchor hash, anchor's leading bytes) by groups.

    First suffix and anchor are places in ``data``; the suffixes of an anchor stand side by side.
    """
    for group in _segments(texts):
        data = np.frombuffer(b"".join(p for *_, p in group), np.uint8)
        sizes = np.array([len(p) for *_, p in group])
        ends = np.cumsum(sizes)
        n = len(data) - TOKEN + 1
        _, down = _POWERS.get(len(data) + 1)
        prefix = _prefix(data)
        tokens = _mixed((prefix[TOKEN:] - prefix[:n]) * down[:n])
        ranked = (tokens & ~_AT) | np.arange(n, dtype=np.uint64)
        least = _sliding_min(ranked, LENGTH - TOKEN + 1)
        at = (least & _AT).astype(np.int64)
        starts = np.arange(len(least))
        part = np.searchsorted(ends, starts, "right")
        good = starts + LENGTH <= ends[part]
        # The step between parts of a long text leaves the last suffix of a part to the next one.
        first = np.flatnonzero(good & np.r_[True, (at[1:] != at[:-1]) | (part[1:] != part[:-1]) | ~good[:-1]])
        if not len(first):
            continue
        total = np.concatenate([[0], np.cumsum(good)])
        count = np.diff(np.concatenate([total[first], [total[-1]]]))
        where = at[first]
        lead = np.zeros(len(where), np.uint64)
        for i in range(8):
            lead = (lead << np.uint64(8)) | data[where + i].astype(np.uint64)
        origin = np.array([(i, o) for i, o, _ in group], dtype=np.int64).reshape(-1, 2)
        yield data, origin[part[first]], (ends - sizes)[part[first]], first, count, tokens[where], lead


def _few(batches: Iterator[pa.RecordBatch], bytes_each: int = 4 << 20) -> Iterator[list[bytes]]:
    """The texts of the first column, a few megabytes at a time, so that what a task derives from them stays small."""
    held, size = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            for t in batch.column(0).slice(i, 256).to_pylist():
                held.append(t or b"")
                size += len(held[-1])
            if size >= bytes_each:
                yield held
                held, size = [], 0
    if held:
        yield held


def _signed(x: np.ndarray) -> np.ndarray:
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def count_anchors(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(hash, lead, places) per anchor and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _few(batches):
            found = [(h, lead) for *_, h, lead in anchors(texts)]
            if not found:
                continue
            h, lead = (np.concatenate(x) for x in zip(*found, strict=True))
            h, first, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(_signed(lead[first])), pa.array(n.astype(np.int64))], names=["hash", "lead", "places"])

    return docs.select(F.col(text_col).cast("binary")).mapInArrow(run, "hash long, lead long, places long")


def _bits(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((h >> np.uint64(s)) % np.uint64(bits)).astype(np.int64) for s in (0, 29)]


def repeated_anchors(docs: DataFrame, buckets: int, text_col: str = "text", bits: int = FILTER_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bit filter of the anchors in more than one place, splitters of their leading bytes)."""
    counted = count_anchors(docs, text_col).groupBy("hash").agg(F.first("lead").alias("lead"), F.sum("places").alias("places"))
    again = settle(counted.filter("places > 1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_bits(batch.column(0).to_numpy().view(np.uint64), bits))
            word, where = np.unique(at >> 6, return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, where, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], names=["word", "value"])

    words = again.select("hash").mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    held = np.zeros(bits >> 6, np.uint64)
    held[words.column("word").to_numpy()] = words.column("value").to_numpy().view(np.uint64)
    sample = again.orderBy("hash").limit(SAMPLE).select("lead", "places").toArrow()
    lead, weight = sample.column("lead").to_numpy(), np.minimum(sample.column("places").to_numpy(), 1 << 20)
    order = np.argsort(lead)
    lead, upto = lead[order], np.cumsum(weight[order])
    if not len(lead):
        return held, np.empty(0, np.int64)
    return held, lead[np.minimum(np.searchsorted(upto, upto[-1] * np.arange(1, buckets) / buckets), len(lead) - 1)]


def cut_pieces(docs: DataFrame, held: np.ndarray, splitters: np.ndarray, text_col: str = "text") -> DataFrame:
    """(bucket, piece, places): the suffixes' text of each repeated anchor, with 24 bytes (digest, offset) per place."""
    context = docs.sparkSession.sparkContext.broadcast((held, splitters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, splitters = context.value
        bits = len(held) << 6
        for texts in _few(batches):
            names: dict[int, bytes] = {}
            merged: dict[bytes, list] = {}
            for data, origin, base, first, count, h, lead in anchors(texts):
                a, b = _bits(h, bits)
                hit = np.flatnonzero((held[a >> 6] >> (a & 63).astype(np.uint64)) & (held[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1))
                key = _signed(lead[hit])
                low, high = (np.searchsorted(splitters, key, side) for side in ("left", "right"))
                bucket = low + (_mixed(h[hit]) % (high - low + 1).astype(np.uint64)).astype(np.int64)
                whole = data.tobytes()
                rows = zip(origin[hit].tolist(), (first[hit] - base[hit]).tolist(), first[hit].tolist(), (first[hit] + count[hit] + LENGTH - 1).tolist(), bucket.tolist(), strict=True)
                for (text, offset), start, f, e, at in rows:
                    if text not in names:
                        names[text] = hashlib.sha256(texts[text]).digest()[:16]
                    place = names[text] + (offset + start).to_bytes(8, "little")
                    own = merged.get(whole[f:e])
                    if own is None:
                        merged[whole[f:e]] = [at, place]
                    else:
                        own.append(place)
            items = list(merged.items())
            for i in range(0, len(items), 20_000):
                part = items[i : i + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v[0] for _, v in part], pa.int32()), pa.array([k for k, _ in part], pa.binary()), pa.array([b"".join(v[1:]) for _, v in part], pa.binary())], names=["bucket", "piece", "places"]
                )

    return docs.select(F.col(text_col).cast("binary")).mapInArrow(run, "bucket int, piece binary, places binary")


def _part_keys(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fingerprints of the parts of the suffixes that start ``at``, a row a part."""
    low = int(at.min())
    prefix = _prefix(data[low : int(at.max()) + LENGTH])
    _, down = _POWERS.get(len(prefix))
    return np.stack([(prefix[a + PART] - prefix[a]) * down[a] for a in (at - low + depth for depth in range(0, LENGTH, PART))])


def _class_keys(data: np.ndarray, at: np.ndarray, classes: int, own: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``at``, part keys) of the suffixes of one class; equal suffixes are of one class. Made a stretch at a time."""
    which, keys = [], []
    for i in range(0, len(at), STRETCH):
        part = _part_keys(data, at[i : i + STRETCH])
        where = np.arange(part.shape[1])
        if classes > 1:
            whole = part[0]
            for k in part[1:]:
                whole = _mixed(whole) + k
            where = np.flatnonzero(_mixed(whole) % np.uint64(classes) == own)
        which.append(where + i)
        keys.append(part[:, where])
    return np.concatenate(which), np.concatenate(keys, axis=1)


def equal_suffixes(data: np.ndarray, at: np.ndarray, most: int = MOST_SORTED) -> np.ndarray:
    """Which of the suffixes that start ``at`` share their first LENGTH bytes with another: multikey quicksort by parts.

    About ``most`` suffixes are sorted at a time: those of one class by all their bytes.
    """
    out = np.zeros(len(at), dtype=bool)
    rows = np.lib.stride_tricks.sliding_window_view(data, LENGTH) if len(at) else None
    classes = -(-len(at) // most)
    for own in range(classes):
        which, keys = _class_keys(data, at, classes, own)
        active, group = np.arange(len(which)), np.zeros(len(which), np.int64)
        for depth, key in enumerate(keys):
            part = key[active]
            order = np.lexsort((part, group)) if depth else np.argsort(part, kind="stable")
            active, group, part = active[order], group[order], part[order]
            new = np.r_[True, (group[1:] != group[:-1]) | (part[1:] != part[:-1])]
            group = np.cumsum(new)
            alone = new & np.r_[new[1:], True]
            active, group = active[~alone], group[~alone]
            if not len(active):
                break
        active = which[active]
        same = np.flatnonzero(group[1:] == group[:-1])
        for i in range(0, len(same), 1 << 15):
            pair = same[i : i + (1 << 15)]
            true = (rows[at[active[pair]]] == rows[at[active[pair + 1]]]).all(axis=1)
            out[active[pair[true]]] = True
            out[active[pair[true] + 1]] = True
    return out


def _flat(held: list[pa.RecordBatch], i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(beginnings, sizes, bytes) of a binary column of several batches."""
    parts, sizes = [], []
    for column in (b.column(i) for b in held):
        ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = column.buffers()[2]
        parts.append(np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.empty(0, np.uint8))
        sizes.append(np.diff(ends))
    size = np.concatenate(sizes)
    return np.cumsum(size) - size, size, np.concatenate(parts)


def repeated_ranges(pieces: DataFrame, parts: int) -> DataFrame:
    """(ref, start, end): byte ranges of texts that are covered by repeats, not yet merged."""
    place = np.dtype([("ref", "V16"), ("at", "<i8")])

    def resolve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (base, sizes, data), (_, widths, all_places) = (_flat(held, i) for i in (1, 2))
        n = sizes - LENGTH + 1
        edge_at = np.cumsum(n) - n
        at = np.arange(n.sum()) + np.repeat(base - edge_at, n)
        repeats = widths // 24
        again = equal_suffixes(data, at) | np.repeat(repeats > 1, n)
        edge = np.zeros(len(at) + 1, dtype=bool)
        edge[edge_at] = edge[-1] = True
        begins = np.flatnonzero(again & (edge[:-1] | ~np.r_[False, again[:-1]]))
        stops = np.flatnonzero(again & (edge[1:] | ~np.r_[again[1:], False]))
        which = np.searchsorted(edge_at, begins, "right") - 1
        first, last = at[begins] - base[which], at[stops] - base[which] + LENGTH
        del at, again, edge
        all_places = all_places.view(place)
        offset, times = np.cumsum(repeats) - repeats, repeats[which]
        told = np.cumsum(times)
        cuts = np.searchsorted(told, np.arange(0, (told[-1] if len(told) else 0) + OUT_ROWS, OUT_ROWS), "right")
        for a, b in zip(cuts, cuts[1:], strict=False):
            some = times[a:b]
            run = np.repeat(np.arange(a, b), some)
            of = all_places[np.repeat(offset[which[a:b]], some) + np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)]
            ref = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(of), [None, pa.py_buffer(of["ref"].tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([ref, pa.array(of["at"] + first[run]), pa.array(of["at"] + last[run])], names=["ref", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            buckets = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(buckets)] if len(buckets) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and buckets[a] != now:
                    yield from resolve(held)
                    held = []
                now = buckets[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from resolve(held)

    return pieces.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "ref binary, start long, end long")


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``with_text``, kept (bytes) and spans."""
    buckets = shards_for(docs, BUCKET_BYTES)
    held, splitters = repeated_anchors(docs, buckets, text_col)
    ranges = repeated_ranges(cut_pieces(docs, held, splitters, text_col), buckets)
    pair = F.struct("start", "end")
    per_text = settle(ranges.distinct().groupBy("ref").agg(F.collect_list(pair).alias("ranges")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), body(text_col).alias("text"))
    rows = rows.withColumn("ref", F.unhex(F.substring(F.sha2("text", 256), 1, 32))).join(per_text, "ref", "left")
    fields = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, spans array<struct<start: long, end: long>>" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, CUT_ROWS) for b in batches for i in range(0, b.num_rows, CUT_ROWS)):
            out: list[list] = [[] for _ in range(6)]
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = merge([(r["start"], r["end"]) for r in found or ()])
                kept = b"".join(text[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(text)], strict=True)) if spans else text
                for to, x in zip(out, (len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": b} for a, b in spans]), strict=True):
                    to.append(x)
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())]
            if with_text:
                columns += [pa.array(out[4], pa.binary()), pa.array(out[5], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "spans"] if with_text else [])])

    return rows.select("id", F.col("text").cast("binary"), "ranges").mapInArrow(run, fields)
