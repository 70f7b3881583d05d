"""Alignment of two tokenizers over the same bytes (op 11).

The texts of a chunk of documents are laid end to end as bytes; tokens of both tokenizers are known by where
they end. The union of both arrays of ends (``union1d``) cuts the bytes into elementary intervals; ``searchsorted`` names
the one token of each side that owns an interval, so every interval is one overlapping pair of tokens (a
link), and every such pair has one interval. Ends that both sides share close groups; a document's last end
is always shared, so nothing crosses documents. A group stands for the product of its tokens
(``products``).

Corpus-wide counts of pairs (``pair_counts``): a chunk counts its own pairs first, so what is shuffled is a
chunk's distinct pairs, and a pair has at most one row a chunk however frequent it is. ``statistics`` sends
each chunk's distinct pairs to the counts and the answers back to the chunk; texts are encoded once. What is
kept of a document in between is its distinct pairs by number, in a table in the shared folder.

Defined cases: texts that are null or empty, or whose bytes one of the tokenizers does not give back, have
no tokens (a normalizing tokenizer, the sign U+2581 in a text); very long texts are a chunk of their own and
are encoded whole; rows that repeat a doc_id are documents of their own; a null doc_id is carried; ties for
the highest count all count as best; an empty table gives an empty result; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table_path
from .packing import Encoder

#: Bytes of text that a chunk holds before it is closed.
CHUNK_BYTES = 2 << 20
_LOW = (1 << 32) - 1


class ByteTokens:
    """A byte-level BPE: ids of a space and the text, with special tokens as plain text; the bytes of each id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        spec = json.loads(self.slow.to_str())
        self.fast = Encoder(path).fast
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [i for i in range(256) if i not in shown]
        byte = {chr(i): i for i in shown} | {chr(256 + k): i for k, i in enumerate(hidden)}
        names = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = [b""] * (max(names.values()) + 1)
        for token, i in names.items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()

    def ids(self, text: str) -> np.ndarray:
        text = " " + text
        if self.fast:
            try:
                return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int64)
            except (KeyboardInterrupt, SystemExit):
                raise
            except BaseException:  # noqa: BLE001  the library's panics are no Exceptions
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)


class PieceTokens:
    """A sentence-piece model, which adds the space itself; the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int64)


class Pair:
    """Two tokenizers and tables over their ids."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteTokens(byte_path), PieceTokens(piece_path)
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        # An id as text with the sign behind it: within a group, at the end of its side of the group.
        self.shown = [f"{i}{sign}".encode() for n, signs in ((len(self.a.bytes), ",|"), (len(self.b.bytes), ",;")) for sign in signs for i in range(n)]

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none where a side does not give the bytes back."""
        none = np.empty(0, np.int64)
        if not text:
            return none, none
        raw, a, b = (" " + text).encode(), self.a.ids(text), self.b.ids(text)
        if b"".join(map(self.a.bytes.__getitem__, a.tolist())) != raw or b"".join(map(self.b.bytes.__getitem__, b.tolist())) != raw:
            return none, none
        return a, b


@lru_cache(maxsize=2)
def pair_of(byte_path: str, piece_path: str) -> Pair:
    """One per worker process."""
    return Pair(byte_path, piece_path)


def union1d(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``np.union1d`` of two sorted arrays: a stable sort merges the two runs, where NumPy's own hashes all values."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both


class Aligned:
    """Documents laid end to end: ends of tokens, elementary intervals with their owners, groups; ``*_of`` cut them by document."""

    def __init__(self, pair: Pair, encoded: list[tuple[np.ndarray, np.ndarray]]):
        join = lambda k: np.concatenate([e[k] for e in encoded] or [np.empty(0, np.int64)])
        self.a, self.b = join(0), join(1)
        self.ends_a, self.ends_b = np.cumsum(pair.lengths_a[self.a]), np.cumsum(pair.lengths_b[self.b])
        self.edges = union1d(self.ends_a, self.ends_b)
        self.owner_a, self.owner_b = np.searchsorted(self.ends_a, self.edges), np.searchsorted(self.ends_b, self.edges)
        last_a, last_b = self.ends_a[np.minimum(self.owner_a, len(self.ends_a) - 1)], self.ends_b[np.minimum(self.owner_b, len(self.ends_b) - 1)]
        self.shared = self.edges[last_a == last_b]
        self.group_a, self.group_b = np.searchsorted(self.shared, self.ends_a), np.searchsorted(self.shared, self.ends_b)
        # First token, link and group of each document, and one past the last.
        self.n_a, self.n_b = (np.array([len(e[k]) for e in encoded], np.int64) for k in (0, 1))
        self.at_a, self.at_b = np.r_[0, np.cumsum(self.n_a)], np.r_[0, np.cumsum(self.n_b)]
        stop = np.r_[0, self.ends_a][self.at_a]
        self.at_link, self.at_group = np.searchsorted(self.edges, stop, "right"), np.searchsorted(self.shared, stop, "right")
        self.begin = stop[:-1]

    def shown(self, pair: Pair) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each document."""
        last = lambda g: np.r_[g[1:] != g[:-1], True] if len(g) else np.empty(0, bool)
        n_a, n_b = len(pair.a.bytes), len(pair.b.bytes)
        at = np.concatenate([self.a + n_a * last(self.group_a), 2 * n_a + self.b + n_b * last(self.group_b)])
        order = np.argsort(np.concatenate([2 * self.group_a, 2 * self.group_b + 1]), kind="stable")
        words = list(map(pair.shown.__getitem__, at[order].tolist()))
        stops = (self.at_a + self.at_b).tolist()
        return [b"".join(words[x:y])[:-1] for x, y in zip(stops, stops[1:], strict=False)]


def _per_document(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(values)][at])


def _chunks(batches: Iterator[pa.RecordBatch], pair: Pair, size: int) -> Iterator[tuple[list, list[tuple[np.ndarray, np.ndarray]]]]:
    """(ids, encoded documents) of about ``size`` bytes of text."""
    names, encoded, held = [], [], 0
    for batch in batches:
        for name, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py()
            names.append(name.as_py())
            encoded.append(pair.encode(text))
            held += 1 + len(text or "")
            if held >= size:
                yield names, encoded
                names, encoded, held = [], [], 0
    if names:
        yield names, encoded


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


_LINK = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("end", pa.int64())])
_GROUP = pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("end", pa.int64())])
_ALIGNED = pa.schema([("doc_id", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())), ("links", pa.list_(_LINK)), ("groups", pa.list_(_GROUP))])
_ALIGNED_DDL = "doc_id long, a_ids array<int>, b_ids array<int>, links array<struct<a: int, b: int, end: long>>, groups array<struct<a: array<int>, b: array<int>, end: long>>"


def align(docs: DataFrame, byte_tokenizer: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 256 << 10) -> DataFrame:
    """One row per document: ids of both sides; ``links`` (places of the two tokens, byte behind their common interval);
    ``groups`` (ids of both sides, byte behind them). Bytes count from the space before the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(byte_tokenizer, piece_model)
        for names, encoded in _chunks(batches, pair, chunk_bytes):
            x = Aligned(pair, encoded)
            links, groups = [], []
            for d in range(len(names)):
                own = slice(x.at_link[d], x.at_link[d + 1])
                links.append([{"a": a, "b": b, "end": e} for a, b, e in zip((x.owner_a[own] - x.at_a[d]).tolist(), (x.owner_b[own] - x.at_b[d]).tolist(), (x.edges[own] - x.begin[d]).tolist(), strict=True)])
                ends = x.shared[x.at_group[d] : x.at_group[d + 1]]
                cut = lambda ids, stops, at, ends=ends: [p.tolist() for p in np.split(ids[at[d] : at[d + 1]], np.searchsorted(stops[at[d] : at[d + 1]], ends, "right"))[: len(ends)]]  # noqa: B023, E731
                groups.append([{"a": a, "b": b, "end": e} for a, b, e in zip(cut(x.a, x.ends_a, x.at_a), cut(x.b, x.ends_b, x.at_b), (ends - x.begin[d]).tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((names, [e[0] for e in encoded], [e[1] for e in encoded], links, groups), _ALIGNED, strict=True)], schema=_ALIGNED)

    return _rows(docs, id_col, text_col).mapInArrow(run, _ALIGNED_DDL)


def products(aligned: DataFrame) -> DataFrame:
    """(doc_id, group, a_id, b_id): every pair of tokens of the two sides of a group, of rows of ``align``."""
    groups = aligned.select("doc_id", F.posexplode("groups").alias("group", "g"))
    return groups.select("doc_id", "group", F.col("g.b").alias("b"), F.explode("g.a").alias("a_id")).select("doc_id", "group", "a_id", F.explode("b").alias("b_id"))


_CHUNK = pa.schema(
    [
        ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((c, pa.list_(pa.int64())) for c in ("n_a", "n_b", "n_groups", "n_links", "n_products")), ("shown", pa.list_(pa.string())),
        # Distinct pairs of the chunk with their counts; of each document the numbers of its own, and how often it has each.
        ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("held", pa.list_(pa.int32())), ("own", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
    ]
)
_CHUNK_DDL = "chunk long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, n_products array<long>, shown array<string>, pairs array<long>, counts array<long>, held array<int>, own array<int>, times array<int>"


def chunk_table(docs: DataFrame, byte_tokenizer: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of documents with what is known of each and with their pairs, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair, task = pair_of(byte_tokenizer, piece_model), TaskContext.get().partitionId()
        for number, (names, encoded) in enumerate(_chunks(batches, pair, CHUNK_BYTES)):
            x = Aligned(pair, encoded)
            keys, at = np.unique((x.a[x.owner_a] << 32) | x.b[x.owner_b], return_inverse=True)
            document = np.repeat(np.arange(len(names)), np.diff(x.at_link))
            own, times = np.unique(document * max(1, len(keys)) + at, return_counts=True)
            sizes = np.bincount(x.group_a, minlength=len(x.shared)) * np.bincount(x.group_b, minlength=len(x.shared))
            row = (
                task << 33 | number, names, x.n_a, x.n_b, np.diff(x.at_group), np.diff(x.at_link), _per_document(sizes, x.at_group), [hashlib.sha256(s).hexdigest() if s else "" for s in x.shown(pair)],
                keys, np.bincount(at, minlength=len(keys)), np.bincount(own // max(1, len(keys)), minlength=len(names)), own % max(1, len(keys)), times,
            )
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _CHUNK, strict=True)], schema=_CHUNK)

    path = table_path(docs.sparkSession, "chunks")
    _rows(docs, id_col, text_col).mapInArrow(run, _CHUNK_DDL).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, n, best): how many links of the corpus hold the pair, and whether no pair of its second id has more."""
    rows = chunks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("p.pairs", "p.counts")
    counted = rows.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n")).select("pair", F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit(_LOW)).cast("int").alias("b_id"), "n")
    path = table_path(chunks.sparkSession, "pairs")
    counted.write.parquet(path)
    counted = chunks.sparkSession.read.parquet(path)
    # One row for each id of the second vocabulary, which does not grow with the data.
    most = counted.groupBy("b_id").agg(F.max("n").alias("most"))
    return counted.join(F.broadcast(most), "b_id").select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def statistics(docs: DataFrame, byte_tokenizer: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_products: one row per document."""
    chunks = chunk_table(docs, byte_tokenizer, piece_model, id_col, text_col)
    asked = chunks.select("chunk", F.explode("pairs").alias("pair"))
    told = asked.join(pair_counts(chunks), "pair").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("pair", "n", "best"))).alias("t"))
    told = told.select("chunk", F.transform("t", lambda t: t["n"]).alias("n"), F.transform("t", lambda t: t["best"]).alias("best"))
    joined = chunks.drop("pairs", "counts").join(told, "chunk", "left")
    columns = ["doc_ids", "n_a", "n_b", "n_groups", "n_links", "shown", "n_products", "held", "own", "times", "n", "best"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {c: batch.column(k)[i].values for k, c in enumerate(columns)}
                n, best = (cell[c].to_numpy(zero_copy_only=False) if cell[c] is not None else np.empty(0, np.int64) for c in ("n", "best"))
                own, times, held = (cell[c].to_numpy() for c in ("own", "times", "held"))
                at = np.r_[0, np.cumsum(held)]
                count_sum, n_best = _per_document(n[own] * times, at), _per_document(best[own].astype(np.int64) * times, at)
                arrays = [cell["doc_ids"], cell["n_a"], cell["n_b"], cell["n_groups"], cell["n_links"], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), cell["shown"], cell["n_products"]]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_products"])

    return joined.select(*columns).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_products long")
