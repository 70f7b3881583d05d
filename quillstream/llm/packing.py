"""Hierarchical best-fit packing of token sequences (op 6).

Each task tokenizes its documents, cuts those over the capacity into full pieces behind one shorter first
piece, and packs the pieces best-fit in decreasing order. Bins that are full or nearly so are final. The
pieces of all others, however many, are packed over all tasks: only the numbers of pieces of each length are
needed to tell best-fit bins (``plan_bins``), then pieces, numbered within their length, meet by bin.

Defined cases: a null or empty text is the end token alone; rows that repeat a doc_id are pieces of
their own; a null doc_id is carried; a text of any length is encoded whole and cut into pieces; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

CAPACITY, END_ID = 1024, 2
#: Free tokens at or under which a task's bin is final; carried pieces that a task of the last level stands for; pieces packed in one go.
NEARLY_FULL, CARRY, PACK_ROWS = 4, 20_000, 50_000

PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
BIN = pa.schema([("size", pa.int32()), ("final", pa.bool_()), ("pieces", pa.list_(PIECE))])
BIN_DDL = "size int, final boolean, pieces array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long, ids: binary>>"


def best_fit(items: list[tuple[int, list]], capacity: int) -> list[tuple[int, list]]:
    """Bins (fill, contents) of items (size, contents): the largest item first, each into the fullest bin that takes it."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, []
    for size, content in sorted(items, key=lambda x: -x[0]):
        fitting = mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            at = room[free].pop()
            if not room[free]:
                mask &= ~(1 << free)
            bins[at] = (bins[at][0] + size, bins[at][1] + content)
        else:
            free, at = capacity, len(bins)
            bins.append((size, list(content)))
        free -= size
        if free:
            room[free].append(at)
            mask |= 1 << free
    return bins


#: Fixed value: the public pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PROBES = ["", " a  b \n\n c\td", "don't we'll it's I'd 'S", "x1234, (y)... été Straße 東京 \U0001f600\u00a0z", "\n lead and trail  "]


class Encoder:
    """Ids of whole texts by a ``tokenizers`` file.

    A plain byte-level BPE (no normalizer, merges in the order of the ids) is run by ``tiktoken`` on the
    vocabulary read from the same file, several times faster with the same ids; whether they are the same
    is checked on probes when it is loaded. Any other file, and any text that it fails on, goes to
    ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = self._plain(json.loads(self.slow.to_str()))
        if self.fast and [self._fast(t) for t in _PROBES] != [self._slow(t) for t in _PROBES]:
            self.fast = None

    @staticmethod
    def _plain(spec: dict):
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [i for i in range(256) if i not in shown]
        byte = {chr(i): i for i in shown} | {chr(256 + k): i for k, i in enumerate(hidden)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [vocab[a + b] for a, b in merges]
        if ids != sorted(ids):
            return None
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}, special_tokens=special)

    def _slow(self, text: str) -> bytes:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _fast(self, text: str) -> bytes:
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> bytes:
        if self.fast:
            try:
                return self._fast(text)
            except (KeyboardInterrupt, SystemExit):
                raise
            except BaseException:  # noqa: BLE001  the library's panics are no Exceptions
                return self._slow(text)
        return self._slow(text)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)


def cut(ids: bytes, capacity: int, end_id: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(piece, start, length, ids) of a document; all pieces but the first are full."""
    ids += end_id.to_bytes(4, "little")
    total = len(ids) // 4
    ends = [*range(total % capacity or capacity, total, capacity), total]
    for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
        yield k, a, b - a, ids[4 * a : 4 * b]


def _batch(bins: list[tuple[int, list]], final: list[bool]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(bins), 10_000):
        part = bins[i : i + 10_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([b[0] for b in part], pa.int32()), pa.array(final[i : i + 10_000], pa.bool_()), pa.array([b[1] for b in part], pa.list_(PIECE))], schema=BIN
        )


def _emit(bins: list[tuple[int, list]], capacity: int) -> Iterator[pa.RecordBatch]:
    """Bins that are nearly full, as final ones; the pieces of the others one by one."""
    full = [b for b in bins if capacity - b[0] <= NEARLY_FULL]
    yield from _batch(full, [True] * len(full))
    rest = [(p["length"], [p]) for size, pieces in bins if capacity - size > NEARLY_FULL for p in pieces]
    yield from _batch(rest, [False] * len(rest))


def plan_bins(counts: list[int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, pieces a bin, first bin): where best fit puts counts[n] pieces of each length n, the longest first.

    Bins of equal free space are kept as ranges, so the work goes by the capacity and not by the pieces.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    rows, bins = [], 0
    for size in range(capacity, 0, -1):
        left, rank = int(counts[size]), 0
        for free in range(size, capacity + 1):
            each = free // size
            while left and (room[free] or free == capacity):
                if free == capacity:
                    at, n = bins, -(-left // each)
                    bins += n
                else:
                    at, n = room[free].pop()
                rows.append((size, rank, each, at))
                whole = min(n, left // each)
                if whole and free > each * size:
                    room[free - each * size].append((at, whole))
                left, rank = left - whole * each, rank + whole * each
                if whole < n and left:
                    if free > left * size:
                        room[free - left * size].append((at + whole, 1))
                    left, whole = 0, whole + 1
                if whole < n:
                    room[free].append((at + whole, n - whole))
            if not left:
                break
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids (little-endian, with ``with_ids``), sequence_id, offset."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        items: list[tuple[int, list]] = []
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 200):
                full = []
                for name, ids in zip(names[at : at + 200], encode([t or "" for t in texts[at : at + 200]]), strict=True):
                    for k, start, n, own in cut(ids, capacity, end_id):
                        row = {"doc_id": name, "piece": k, "start": start, "length": n, "ids_crc32": crc32(own), "ids": own if with_ids else None}
                        (full if n == capacity else items).append((n, [row]))
                yield from _batch(full, [True] * len(full))
                if len(items) >= PACK_ROWS:
                    yield from _emit(best_fit(items, capacity), capacity)
                    items = []
        yield from _emit(best_fit(items, capacity), capacity)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = sum((np.bincount(batch.column(0).to_numpy(), minlength=capacity + 1) for batch in batches), np.zeros(capacity + 1, np.int64))
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n.astype("<i8").tobytes()])], names=["task", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    level = settle(rows.mapInArrow(first, BIN_DDL))
    spark, open_ = docs.sparkSession, level.filter("not final")
    # One row of capacity numbers a task; the checkpoint gives the same rows in the same order again.
    counted = sorted((r["task"], np.frombuffer(r["n"], "<i8")) for r in open_.mapInArrow(lengths, "task int, n binary").collect())
    counts = sum((n for _, n in counted), np.zeros(capacity + 1, np.int64))
    ahead = np.cumsum([n for _, n in counted], axis=0) - [n for _, n in counted] if counted else None
    told = spark.sparkContext.broadcast(({task: ahead[i] for i, (task, _) in enumerate(counted)}, plan_bins(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        starts, runs = told.value
        next_ = starts.get(TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)).copy()
        span = int(counts.max()) + 1
        key = runs[:, 0] * span + runs[:, 1]
        for batch in batches:
            size = batch.column(0).to_numpy().astype(np.int64)
            order = np.argsort(size, kind="stable")
            n = np.bincount(size, minlength=capacity + 1)
            rank = np.empty(len(size), np.int64)
            rank[order] = np.arange(len(size)) - (np.cumsum(n) - n)[size[order]]
            rank += next_[size]
            next_ += n
            run = runs[np.searchsorted(key, size * span + rank, "right") - 1]
            yield pa.RecordBatch.from_arrays([pa.array(run[:, 3] + (rank - run[:, 1]) // run[:, 2]), batch.column(2)], names=["bin", "pieces"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(counts.sum()) // CARRY))
    met = open_.mapInArrow(place, BIN_DDL.replace("size int, final boolean", "bin long")).repartition(parts, "bin").groupBy("bin").agg(F.flatten(F.collect_list("pieces")).alias("pieces"))
    # Numbers of sequences are told by place, so the rows behind them are fixed first.
    done = level.filter("final").select("pieces").unionAll(settle(met.select("pieces")))
    bins = done.select(F.monotonically_increasing_id().alias("sequence_id"), "pieces")
    sizes = F.transform("pieces", lambda p: p["length"])
    placed = bins.select("sequence_id", F.posexplode("pieces").alias("at", "p"), sizes.alias("sizes"))
    ahead = F.aggregate(F.slice("sizes", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda a, x: a + x)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    return placed.select(*(F.col(f"p.{c}").alias(c) for c in columns), "sequence_id", ahead.alias("offset"))
