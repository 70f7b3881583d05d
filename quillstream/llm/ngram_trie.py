"""Language-model scores by sharded Elias-Fano n-gram tries (op 2).

Words are lower-cased (A-Z) and known by 64-bit fingerprints; a text ends with one end token. Two scans:

1. Words: tasks count the words of the training texts and tell which shards will need each word. A shard
   of the words adds up and answers every shard that asked. Token and type totals follow from the answers.
2. N-grams: a token goes, with the two words before it, to the shard of the word just before it, so that
   all successors of a context, shorter and longer, meet in one place. The shard smooths the training
   counts (interpolated absolute discounting over the add-one unigram model), writes them as a trie, maps
   it into memory, and asks it for every distinct n-gram of the texts. Sums per text come back.

Contexts of a frequent word are dealt to several shards by the word before it, so no shard holds more than
its share, however frequent a word is. A longer context stays whole; of the shorter one, the first scan also
counts the successors over all parts, and answers each part the whole counts of the pairs that it holds. The
second scan's shards are read twice: the discounts come from the counts of all shards, then each is scored.
So the model is the same wherever contexts are kept.

The trie: a context word points to its successors and to the words before it; such a longer context points
to its successors, given as ranks among the successors of the shorter one. Pointers and, shifted to be
monotone, successors are Elias-Fano sequences; a lookup is a successor search in its context's range.
Log probabilities and weights are quantised to 8 bits on one grid for all shards, so scores do not depend on
how many shards there are.

Defined cases: a null text is the empty text (one end token); a null id trains; a very long text is a chunk of
its own and is read whole; rows that repeat a doc_id
are texts of their own; without training texts every probability is the add-one one; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_bytes, read_again, settle
from .suffixes import _POWERS, _mixed, _prefix

#: Input bytes that a shard stands for; bytes of text that a task turns into n-grams in one go; bits of a quantised value.
SHARD_BYTES, CHUNK_BYTES, BITS = 6 << 20, 12 << 20, 8
#: Where the grid of the weights of shorter contexts begins (log10); smaller ones take its first step.
WEIGHT_LOWEST = -8.0
#: Most words whose contexts are dealt to several shards; words that travel by number; lookups made in one go.
MOST_HOT, COMMON, LOOKUPS = 100_000, 1 << 16, 1 << 17
END, BEGIN = np.uint64(1), np.uint64(2)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


# --- Elias-Fano -----------------------------------------------------------------------------------


class EliasFano:
    """A monotone sequence in about 2 + log2(universe / length) bits a value."""

    def __init__(self, values: np.ndarray):
        values = values.astype(np.uint64)
        self.n = n = len(values)
        top = int(values[-1]) if n else 0
        self.low_bits = max(0, int(np.log2(max(1, (top + 1) // max(1, n)))))
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        low = values & np.uint64((1 << self.low_bits) - 1)
        self.low = self._pack(low)
        size = (int(high[-1]) if n else 0) + n + 2
        words = np.zeros(-(-size // 64) + 1, np.uint64)
        at = high + np.arange(n)
        np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        self.high = words
        self._index()

    def _pack(self, low: np.ndarray) -> np.ndarray:
        k = self.low_bits
        if not k:
            return np.zeros(1, np.uint64)
        out = np.zeros(len(low) * k // 64 + 2, np.uint64)
        bit = np.arange(len(low), dtype=np.int64) * k
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        np.bitwise_or.at(out, word, low << shift)
        over = np.flatnonzero(shift.astype(np.int64) + k > 64)
        np.bitwise_or.at(out, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
        return out

    def _index(self) -> None:
        ones = np.bitwise_count(self.high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> EliasFano:
        out = cls.__new__(cls)
        out.n, out.low_bits = (int(x) for x in arrays[0])
        out.low, out.high = arrays[1:]
        out._index()
        return out

    def _select(self, k: np.ndarray, counts: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the k-th one (or zero, with ``flip``), from 0."""
        word = np.searchsorted(counts, k, "right") - 1
        bits = self.high[word]
        if flip:
            bits = ~bits
        left = (k - counts[word]).astype(np.int64)
        at = np.zeros(len(k), np.uint64)
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count((bits >> at) & np.uint64((1 << half) - 1)).astype(np.int64)
            go = left >= low
            left -= np.where(go, low, 0)
            at += np.where(go, np.uint64(half), np.uint64(0))
        return word * 64 + at.astype(np.int64)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        k = self.low_bits
        if not k:
            return np.zeros(len(i), np.int64)
        bit = i.astype(np.int64) * k
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        first = self.low[word] >> shift
        rest = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((first | rest) & np.uint64((1 << k) - 1)).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, self.ones, False) - i) << self.low_bits) | self._lows(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is at least x (n if none): to the bucket of its high bits, then along it."""
        high, want = x >> self.low_bits, x & ((1 << self.low_bits) - 1)
        inside = high <= (int(self.zeros[-1]) - 2)
        high = np.where(inside, high, 0)
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), self.zeros, True) - high + 1, 0)
        stop = self._select(high, self.zeros, True) - high
        at, stop = np.minimum(begin, self.n), np.minimum(stop, self.n)
        # Halve the bucket until its first value not under x is left.
        while True:
            open_ = np.flatnonzero(at < stop)
            if not len(open_):
                break
            mid = (at[open_] + stop[open_]) >> 1
            under = self._lows(mid) < want[open_]
            at[open_] = np.where(under, mid + 1, at[open_])
            stop[open_] = np.where(under, stop[open_], mid)
        return np.where(inside, at, self.n)


class Children:
    """Sorted child numbers of every node: Elias-Fano pointers, and the children made monotone by the value before their group."""

    def __init__(self, parents: np.ndarray, children: np.ndarray, nodes: int):
        self.pointers = EliasFano(np.searchsorted(parents, np.arange(nodes + 1)))
        # Every group begins above the last value of the one before it.
        first = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]]) if len(parents) else np.empty(0, np.int64)
        last = np.r_[first[1:], len(parents)] - 1 if len(parents) else first
        ahead = np.concatenate([[0], np.cumsum(children[last] + 1)])[:-1] if len(parents) else first
        self.values = EliasFano(children + np.repeat(ahead, np.diff(np.r_[first, len(parents)]))) if len(parents) else EliasFano(np.empty(0, np.int64))

    def arrays(self) -> list[np.ndarray]:
        return self.pointers.arrays() + self.values.arrays()

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> Children:
        out = cls.__new__(cls)
        out.pointers, out.values = EliasFano.of(arrays[:3]), EliasFano.of(arrays[3:6])
        return out

    def find(self, node: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index among all children, rank in its group, whether it is there); nodes under 0 have no children."""
        known = node >= 0
        node = np.where(known, node, 0)
        a, b = self.pointers.access(node), self.pointers.access(node + 1)
        known &= a < b
        base = np.where(a > 0, self.values.access(np.maximum(a - 1, 0)) + 1, 0) if self.values.n else np.zeros(len(a), np.int64)
        want = base + child
        at = self.values.find(want) if self.values.n else np.zeros(len(a), np.int64)
        there = known & (at >= a) & (at < b)
        there[there] = self.values.access(at[there]) == want[there]
        return at, at - a, there


class Quantised:
    """Logarithms of probabilities as 8-bit numbers on one grid for all shards, read back as the middle of their step.

    The grid goes from ``lowest`` to 0. It is told by the number of training tokens alone, so a value is
    rounded alike wherever it lies, and scores do not depend on the number of shards.
    """

    def __init__(self, values: np.ndarray, lowest: float):
        step = -lowest / (1 << BITS)
        self.codes = np.clip((values - lowest) / step, 0, (1 << BITS) - 1).astype(np.uint8)
        self.table = lowest + step * (np.arange(1 << BITS) + 0.5)

    def arrays(self) -> list[np.ndarray]:
        return [self.codes, self.table]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> Quantised:
        out = cls.__new__(cls)
        out.codes, out.table = arrays
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        return self.table[self.codes[i]]


def _ones_twos(counts: np.ndarray) -> list[int]:
    return [int((counts == 1).sum()), int((counts == 2).sum())]


def _discount(counts: np.ndarray) -> float:
    return _discount_of(*_ones_twos(counts))


def _discount_of(one: int, two: int) -> float:
    return one / (one + 2 * two) if one and two else 0.5


#: Whether each word is parted; sorted pairs v * words + w of parted words v and their counts over all parts; total and kinds of successors of each word.
Whole = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Trie:
    """Smoothed bigrams and trigrams of a shard's contexts."""

    def __init__(self, bi: np.ndarray, n2: np.ndarray, tri: np.ndarray, n3: np.ndarray, unigram: np.ndarray, discounts: tuple[float, float], whole: Whole, lowest: float):
        """Distinct training n-grams with their counts: ``bi`` sorted, v * words + w; ``tri`` (place of its bigram in ``bi``) * words + u; unigram: probability of each word number; discounts of bigrams and trigrams; whole: counts of the parted words; lowest: where the grid of values begins."""
        words = len(unigram)
        # Of parted words the counts over all parts stand for those of this part.
        parted, pair, pair_n, whole_total, whole_kinds = whole
        own = ~parted[bi // words]
        both, n2 = np.concatenate([bi[own], pair]), np.concatenate([n2[own], pair_n])
        order = np.argsort(both)
        both, n2 = both[order], n2[order]
        rank = np.searchsorted(both, bi)[tri // words]
        bv, bw = both // words, both % words
        v = bv[rank]
        relative = rank - np.searchsorted(bv, np.arange(words))[v]
        longer, context = np.unique(v * words + tri % words, return_inverse=True)
        del own, order, both, v, bi
        self.successors = Children(bv, bw, words)
        d = discounts[0]
        total = np.where(parted, whole_total, np.bincount(bv, n2, words))
        kinds = np.where(parted, whole_kinds, np.bincount(bv, minlength=words))
        weight = d * kinds / np.maximum(total, 1)
        p2 = (n2 - d) / total[bv] + weight[bv] * unigram[bw]
        self.p2 = Quantised(np.log10(p2), lowest)
        self.w2 = Quantised(np.log10(np.where(total > 0, weight, 1.0)), WEIGHT_LOWEST)
        del bv, bw, n2
        self.before = Children(longer // words, longer % words, words)
        span = int(relative.max()) + 1 if len(relative) else 1
        tri = context * np.int64(span) + relative
        del context, relative
        order = np.argsort(tri)
        tri, n3, lower = tri[order], n3[order], p2[rank[order]]
        del order, rank, p2
        tc = tri // span
        self.longer = Children(tc, tri % span, len(longer))
        d = discounts[1]
        total, kinds = np.bincount(tc, n3, len(longer)), np.bincount(tc, minlength=len(longer))
        weight = d * kinds / np.maximum(total, 1)
        self.p3 = Quantised(np.log10((n3 - d) / np.maximum(total[tc], 1) + weight[tc] * lower) if len(tri) else np.empty(0), lowest)
        self.w3 = Quantised(np.log10(np.maximum(weight, 1e-300)), WEIGHT_LOWEST)

    _PARTS = (("successors", Children, 6), ("before", Children, 6), ("longer", Children, 6), ("p2", Quantised, 2), ("w2", Quantised, 2), ("p3", Quantised, 2), ("w3", Quantised, 2))

    def mapped(self) -> Trie:
        """The same trie with its levels in a memory-mapped temporary file, which goes with the trie."""
        arrays = [np.ascontiguousarray(a) for name, *_ in self._PARTS for a in getattr(self, name).arrays()]
        file = tempfile.TemporaryFile()  # noqa: SIM115
        spots = []
        for a in arrays:
            file.write(b"\0" * (-file.tell() % 8))
            spots.append((file.tell(), a.dtype, len(a)))
            file.write(a.tobytes())
        file.flush()
        levels = [np.memmap(file, dtype=t, mode="r", offset=at, shape=(n,)) if n else np.empty(0, t) for at, t, n in spots]
        out, at = Trie.__new__(Trie), 0
        for name, kind, n in self._PARTS:
            setattr(out, name, kind.of([np.asarray(x) for x in levels[at : at + n]]))
            at += n
        out.file = file
        return out

    def bigrams(self, v: np.ndarray, w: np.ndarray, log_unigram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 probability, rank of w among the successors of v, whether it is one)."""
        at, rank, there = self.successors.find(v, w)
        out = self.w2.get(v) + log_unigram[w]
        out[there] = self.p2.get(at[there])
        return out, rank, there

    def trigrams(self, u: np.ndarray, v: np.ndarray, lower: np.ndarray, rank: np.ndarray, there: np.ndarray) -> np.ndarray:
        """log10 probability, from that of the bigram, its rank and presence."""
        context, _, known = self.before.find(v, u)
        out = lower.copy()
        if self.longer.values.n:
            at, _, hit = self.longer.find(np.where(known & there, context, -1), np.where(there, rank, 0))
            out[known] += self.w3.get(context[known])
            out[hit] = self.p3.get(at[hit])
        return out


# --- Texts to tokens ------------------------------------------------------------------------------


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of the words of all texts, an end token behind each; text of each token)."""
    flat = np.frombuffer(b"\n".join([b"", *texts, b""]).lower(), np.uint8)
    space = _SPACE[flat]
    narrow = np.int32 if len(flat) < 1 << 31 else np.int64
    edges = np.flatnonzero(space[:-1] != space[1:]).astype(narrow) + narrow(1)
    del space
    # The stretch begins and ends with space, so that edges alternate.
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    # In blocks of words, so that fingerprints of a long stretch are not all in memory.
    for i in range(0, len(starts), 1 << 18):
        s, e = starts[i : i + (1 << 18)].astype(np.int64), ends[i : i + (1 << 18)].astype(np.int64)
        a = int(s[0])
        prefix = _prefix(flat[a : int(e[-1])])
        _, down = _POWERS.get(len(prefix))
        out[i : i + len(s)] = _mixed((prefix[e - a] - prefix[s - a]) * down[s - a] + (e - s).astype(np.uint64))
    out[out < 4] += np.uint64(4)
    sizes = np.array([len(t) for t in texts], np.int64)
    # Words that begin before the end of each text, and so its own ones.
    words = np.diff(np.searchsorted(starts, np.cumsum(sizes + 1), "right"), prepend=0)
    del flat, edges, starts, ends
    ends_at = np.cumsum(words + 1) - 1
    hashes = np.full(len(out) + len(texts), END, np.uint64)
    is_word = np.ones(len(hashes), bool)
    is_word[ends_at] = False
    hashes[is_word] = out
    return hashes, np.repeat(np.arange(len(texts), dtype=np.int32), words + 1)


def _before(hashes: np.ndarray, text: np.ndarray, steps: int) -> np.ndarray:
    """The token ``steps`` before, or the begin mark."""
    out = np.full(len(hashes), BEGIN, np.uint64)
    if steps < len(hashes):
        same = text[steps:] == text[:-steps]
        out[steps:][same] = hashes[:-steps][same]
    return out


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (_mixed(hashes) % np.uint64(shards)).astype(np.int32)


Hot = tuple[np.ndarray, np.ndarray]


def _context_shard(v: np.ndarray, u: np.ndarray, shards: int, hot: Hot) -> np.ndarray:
    """Shard of the contexts of v; a frequent v is parted by the hash of the word u before it."""
    words, parts = hot
    if not len(words):
        return _shard(v, shards)
    at = np.minimum(np.searchsorted(words, v), len(words) - 1)
    parted = words[at] == v
    part = np.where(parted, _mixed(u) % parts[at], np.uint64(0))
    return _shard(v + part * np.uint64(0x9E3779B97F4A7C15), shards)


def frequent_words(texts: DataFrame, shards: int, one_in: int = 32) -> tuple[Hot, np.ndarray]:
    """((fingerprints of words on more than a quarter of a shard's share of the tokens, parts each is dealt to), fingerprints of the COMMON most frequent words).

    Counted on the texts whose id's hash picks them. This only decides where contexts are kept and how words
    are written on the way, at most MOST_HOT and COMMON words come out, and both scans use the same ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _chunks(batches):
            word, n = np.unique(tokens(own)[0], return_counts=True)
            much = (n * 8 * shards > n.sum()) | (n > 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[word[much], np.uint64(0)].view(np.int64)), pa.array(np.r_[n[much], n.sum()].astype(np.int64))], names=["word", "n"])

    picked = texts.filter(F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(one_in)) == 0)
    counts = picked.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(max(COMMON, min(8 * shards, MOST_HOT)) + 1).toArrow()
    word, n = counts.column("word").to_numpy().view(np.uint64), counts.column("n").to_numpy()
    total = int(n[word == 0].sum())
    found = (word != 0) & (n * 4 * shards > total)
    order = np.argsort(word[found])
    hot = word[found][order], np.maximum(1, np.ceil(n[found][order] * 4 * shards / max(1, total))).astype(np.uint64)
    return hot, np.sort(word[word != 0][:COMMON])


def held_out_by_id(name: int | None) -> bool:
    return name is not None and crc32(str(name).encode()) % 7 == 2


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    names, texts, size = [], [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                names.append(name)
                texts.append(text or b"")
                size += len(texts[-1])
                if size >= CHUNK_BYTES:
                    yield names, texts
                    names, texts, size = [], [], 0
    if names:
        yield names, texts


def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, equal bytes of neighbours side by side, compressed."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.itemsize))], np.int64).tobytes()
    planes = [a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in map(np.ascontiguousarray, arrays)]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def _unblob(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8)
    at, out = 8 + 16 * n, []
    for i, kind in enumerate(kinds):
        count, size = int(head[2 * i]), int(head[2 * i + 1])
        raw = np.frombuffer(data, np.uint8, count * size, at).reshape(size, count).T
        out.append(np.ascontiguousarray(raw).view(kind).ravel() if count else np.empty(0, kind))
        at += count * size
    return out


def _distinct(a: np.ndarray) -> np.ndarray:
    """The sorted distinct values; ``np.unique`` would hash them, which takes many times as long as sorting numbers."""
    a = np.sort(a)
    return a[np.r_[True, a[1:] != a[:-1]]] if len(a) else a


def _steps(a: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, from 0."""
    return np.diff(a, prepend=a.dtype.type(0))


def _sums(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=steps.dtype)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, begin, end) of the runs of a sorted array."""
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
    for a, b in zip(cut, [*cut[1:], len(keys)][: len(cut)], strict=True):
        yield int(keys[a]), int(a), int(b)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows (key, ...) that come sorted by key, by key."""
    now, rows = None, []
    for batch in batches:
        found = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))[::-1]
        del batch
        while found:
            row = found.pop()
            if rows and row[0] != now:
                yield now, rows
                rows = []
            now = row[0]
            rows.append(row[1:])
    if rows:
        yield now, rows


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "kind", "blob"])


def _hot_places(v: np.ndarray, hot: Hot) -> np.ndarray:
    """Place of each word among the parted ones, or -1."""
    if not len(hot[0]):
        return np.full(len(v), -1, np.int64)
    at = np.minimum(np.searchsorted(hot[0], v), len(hot[0]) - 1)
    return np.where(hot[0][at] == v, at, -1)


def _pair_blob(place: np.ndarray, w: np.ndarray, word: np.ndarray, common: np.ndarray, *more: np.ndarray) -> bytes:
    """Pairs (place of a parted word, number w of a word) with further arrays; words are told once, common ones by their number."""
    used, w = np.unique(w, return_inverse=True)
    number, told = _numbers(word[used], common)
    return _blob(_steps(word[used][~told]), _steps(number[told]), _steps(place.astype(np.int32)), w.astype(np.int32), *more)


def _pairs_of(blob: bytes, common: np.ndarray, *kinds: str) -> list[np.ndarray]:
    """(place, fingerprint of w, further arrays) of a ``_pair_blob``."""
    steps, told, place, w, *more = _unblob(blob, "<u8", "<u4", "<i4", "<i4", *kinds)
    return [_sums(place), np.sort(np.concatenate([_sums(steps), common[_sums(told)]]))[w], *more]


def word_counts(texts: DataFrame, shards: int, held_out: Callable[[int | None], bool], hot: Hot, common: np.ndarray) -> DataFrame:
    """(shard, kind, blob): for each n-gram shard the training counts of what it needs, of words (kind 0) and of pairs of a parted word and its successor (kind 2).

    Rows of shard -1 hold (tokens, types) of the training texts, those of shard -2 per parted word (place, total and
    kinds of its successors), those of shard -3 the numbers of pairs of parted words seen once and twice.
    """

    def deal(key: np.ndarray, of: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of askers of each key, the askers key by key) for tokens of keys 0, 1, ..."""
        asked = _distinct(of * np.int64(shards) + asks)
        return np.bincount(asked // shards, minlength=key), asked % shards

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, own in _chunks(batches):
            hashes, text = tokens(own)
            train = ~np.array([held_out(n) for n in names])[text]
            before = _before(hashes, text, 1)
            asks = _context_shard(before, _before(hashes, text, 2), shards, hot)
            del text
            place = _hot_places(before, hot)
            del before
            word, number = np.unique(hashes, return_inverse=True)
            del hashes
            count = np.bincount(number, train, len(word)).astype(np.int64)
            n, askers = deal(len(word), number, asks)
            out = [(shard, 0, _blob(_steps(word[mine]), count[mine].astype(np.uint32), n[mine].astype(np.uint32), which.astype(np.uint32))) for shard, mine, which in _homes(_shard(word, shards), n, askers)]
            mine = np.flatnonzero(place >= 0)
            pair, number = np.unique(place[mine] * len(word) + number[mine], return_inverse=True)
            count = np.bincount(number, train[mine], len(pair)).astype(np.int64)
            n, askers = deal(len(pair), number, asks[mine])
            at, w = pair // len(word), pair % len(word)
            home = _shard(word[w] + (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), shards)
            del pair, number, asks, train, place
            for shard, mine, which in _homes(home, n, askers):
                out.append((shard, 2, _pair_blob(at[mine], w[mine], word, common, count[mine].astype(np.uint32), n[mine].astype(np.uint32), which.astype(np.uint32))))
            yield _rows(out)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            out = []
            parts = [_unblob(b, "<u8", "<u4", "<u4", "<u4") for kind, b in rows if kind == 0]
            if parts:
                word, number = np.unique(np.concatenate([_sums(p[0]) for p in parts]), return_inverse=True)
                count = np.bincount(number, np.concatenate([p[1] for p in parts]), len(word)).astype(np.int64)
                pairs = _asked(number, [p[2:] for p in parts], len(word))
                out.append((-1, 0, np.array([count.sum(), (count > 0).sum()], np.int64).tobytes()))
                for shard, a, b in _runs(pairs // len(word)):
                    mine = pairs[a:b] % len(word)
                    out.append((shard, 0, _blob(_steps(word[mine]), count[mine].astype(np.uint64))))
            parts = [_pairs_of(b, common, "<u4", "<u4", "<u4") for kind, b in rows if kind == 2]
            rows.clear()
            if parts:
                word, w = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
                pair, number = np.unique(np.concatenate([p[0] for p in parts]).astype(np.int64) * len(word) + w, return_inverse=True)
                count = np.bincount(number, np.concatenate([p[2] for p in parts]), len(pair)).astype(np.int64)
                asked = _asked(number, [p[3:] for p in parts], len(pair))
                del parts, number
                at, w = pair // len(word), pair % len(word)
                own, n = np.unique(at[count > 0], return_counts=True)
                total = np.bincount(at, count).astype(np.int64)[own]
                out += [(-2, 0, np.stack([own, total, n], axis=1).astype(np.int64).tobytes()), (-3, 0, np.array(_ones_twos(count), np.int64).tobytes())]
                # A pair without a training count is no bigram of the model.
                asked = asked[count[asked % len(pair)] > 0]
                for shard, a, b in _runs(asked // len(pair)):
                    mine = asked[a:b] % len(pair)
                    out.append((shard, 2, _pair_blob(at[mine], w[mine], word, common, count[mine].astype(np.uint64))))
            yield _rows(out)

    sent = texts.mapInArrow(scan, "shard int, kind int, blob binary")
    return sent.repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(add, "shard int, kind int, blob binary")


def _homes(home: np.ndarray, n: np.ndarray, askers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, its keys in their order, their askers), of n askers a key."""
    first = np.cumsum(n) - n
    order = np.argsort(home, kind="stable")
    for shard, a, b in _runs(home[order]):
        mine = order[a:b]
        own = n[mine]
        yield shard, mine, askers[np.repeat(first[mine], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)]


def _asked(number: np.ndarray, parts: list[list[np.ndarray]], keys: int) -> np.ndarray:
    """Sorted distinct asker * keys + key, from the keys' numbers and (askers of each, the askers) of every part."""
    of = np.repeat(number, np.concatenate([p[0] for p in parts]))
    return _distinct(np.concatenate([p[1] for p in parts]).astype(np.int64) * keys + of)


def _numbers(word: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among the common words, whether it is one) of sorted words."""
    at = np.searchsorted(common, word)
    there = at < len(common)
    there[there] = common[at[there]] == word[there]
    return at.astype(np.uint32), there


def ngrams(texts: DataFrame, shards: int, held_out: Callable[[int | None], bool], hot: Hot, common: np.ndarray) -> DataFrame:
    """(shard, chunk, blob): the tokens of a chunk of texts whose word before belongs to the shard; shard -1 holds the chunk's texts.

    Words are told once a blob, common ones by their number.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for k, (names, own) in enumerate(_chunks(batches)):
            chunk = TaskContext.get().partitionId() << 32 | k
            hashes, text = tokens(own)
            out_ = np.array([held_out(n) for n in names])
            word, w = np.unique(np.concatenate([hashes, [BEGIN]]), return_inverse=True)
            begin, w = w[-1], w[:-1].astype(np.int32)
            del hashes
            v, u = np.full(len(w), begin, np.int32), np.full(len(w), begin, np.int32)
            for back, to in ((1, v), (2, u)):
                if back < len(w):
                    same = text[back:] == text[:-back]
                    to[back:][same] = w[:-back][same]
            home = _context_shard(word[v], word[u], shards, hot)
            if len(word) <= 1 << 22 and shards <= 1 << 18:
                order = np.argsort((home.astype(np.int64) << 44) | (v.astype(np.int64) << 22) | w)
            else:
                order = np.lexsort((w, v, home))
            flags = np.packbits(out_)
            number, is_common = _numbers(word, common)
            rows = []
            for shard, a, b in _runs(home[order]):
                mine = order[a:b]
                used, place = np.unique(np.concatenate([u[mine], v[mine], w[mine]]), return_inverse=True)
                own_u, own_v, own_w = place.astype(np.int32).reshape(3, -1)
                told = is_common[used]
                # Sorted by v and then w: steps are small, but for w at the first of a v.
                step_w = np.where(np.r_[True, own_v[1:] != own_v[:-1]], own_w, np.diff(own_w, prepend=np.int32(0)))
                rows.append((shard, chunk, _blob(_steps(word[used[~told]]), _steps(number[used[told]]), own_u, _steps(own_v), step_w.astype(np.int32), text[mine].astype(np.uint32), flags)))
            known = np.array([n is not None for n in names])
            ids = np.array([n or 0 for n in names], np.int64)
            rows.append((-1, chunk, _blob(ids, known.astype(np.uint8), out_.astype(np.uint8), np.bincount(text, minlength=len(names)).astype(np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "chunk", "blob"])

    return texts.mapInArrow(scan, "shard int, chunk long, blob binary")


def _in_blocks(find: Callable, *arrays: np.ndarray) -> list[np.ndarray]:
    """The results of ``find`` over blocks of the arrays, put together; what a lookup needs beside stays small."""
    parts = [find(*(a[i : i + LOOKUPS] for a in arrays)) for i in range(0, max(1, len(arrays[0])), LOOKUPS)]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _decoded(blob: bytes, common: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(fingerprints of a blob's words, [u, v, w as places among them, text, train] of its tokens)."""
    steps, told, u, v, w, text, flags = _unblob(blob, "<u8", "<u4", "<i4", "<i4", "<i4", "<u4", "u1")
    v = _sums(v)
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    upto = np.cumsum(w, dtype=np.int64)
    w = (upto - np.repeat(upto[first] - w[first], np.diff(np.r_[first, len(v)]))).astype(np.int32)
    return np.sort(np.concatenate([_sums(steps), common[_sums(told)]])), [u, v, w, text, ~np.unpackbits(flags).astype(bool)[text]]


def _ngrams_of(rows: list[tuple], common: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, list[np.ndarray]]:
    """((chunk, tokens) of a shard, its sorted words, [u, v, w, text, train] of its tokens)."""
    chunks, dictionaries, columns = [], [], []
    for kind, chunk, blob in rows:
        if kind == 1:
            own, held = _decoded(blob, common)
            chunks.append((chunk, len(held[0])))
            dictionaries.append(own)
            columns.append(held)
    if not chunks:
        return [], np.empty(0, np.uint64), []
    word = _distinct(np.concatenate(dictionaries))
    for own, held in zip(dictionaries, columns, strict=True):
        place = np.searchsorted(word, own).astype(np.int32)
        held[:3] = (place[x] for x in held[:3])
    return chunks, word, [np.concatenate([c[i] for c in columns]) for i in range(5)]


def _repeats(keys: list[np.ndarray]) -> list[int]:
    """How many distinct keys there are once and twice."""
    k = np.sort(np.concatenate(keys)) if keys else np.empty(0, np.uint64)
    cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True]) if len(k) else np.zeros(1, np.int64)
    return _ones_twos(np.diff(cut))


def _count_shard(rows: list[tuple], common: np.ndarray, hot: Hot) -> list[int]:
    """Numbers of bigrams seen once and twice, but for those of parted words, and of trigrams, in a shard.

    N-grams are told apart by 64-bit fingerprints of their words' ones, so that sorting them is all there is to do.
    """
    two, three = [], []
    for kind, _, blob in rows:
        if kind == 1:
            word, (u, v, w, _, train) = _decoded(blob, common)
            first = _mixed(word)
            pair = first[v[train]] * np.uint64(0x9E3779B97F4A7C15) + word[w[train]]
            two.append(pair[_hot_places(word, hot)[v[train]] < 0])
            three.append(_mixed(pair) + first[u[train]])
    rows.clear()
    return _repeats(two) + _repeats(three)


def _score_shard(rows: list[tuple], total: int, types: int, common: np.ndarray, hot: Hot, hot_sums: np.ndarray, discounts: tuple[float, float]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(chunk, texts, score, base score, known tokens) sums of a shard, from its answered counts and n-grams; hot_sums: total and kinds of successors of each parted word."""
    chunks, word, columns = _ngrams_of(rows, common)
    if not chunks:
        return
    u, v, w, text, train = columns
    del columns
    count = np.zeros(len(word), np.int64)
    for kind, _, blob in rows:
        if kind == 0:
            steps, c = _unblob(blob, "<u8", "<u8")
            h = _sums(steps)
            at = np.minimum(np.searchsorted(word, h), len(word) - 1)
            own = word[at] == h
            count[at[own]] = c[own].astype(np.int64)
    n = len(word)
    pairs, pair_n = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for kind, _, blob in rows:
        if kind == 2:
            place, h, c = _pairs_of(blob, common, "<u8")
            pairs.append(np.searchsorted(word, hot[0][place]) * np.int64(n) + np.searchsorted(word, h))
            pair_n.append(c.astype(np.int64))
    rows.clear()
    place = _hot_places(word, hot)
    whole_total, whole_kinds = np.where(place >= 0, hot_sums[:, place] if hot_sums.size else 0, 0)
    whole = (place >= 0, np.concatenate(pairs), np.concatenate(pair_n), whole_total, whole_kinds)
    del pairs, pair_n
    unigram = (count + 1.0) / ((total + 1.0 * types) + 1.0)
    log_unigram = np.log10(unigram)
    # Distinct pairs and triples of all tokens; those with a training count make the trie, all are asked of it.
    pair, in_pair = np.unique(v.astype(np.int64) * n + w, return_inverse=True)
    in_pair = in_pair.astype(np.int32)
    triple, in_triple = np.unique(in_pair.astype(np.int64) * n + u, return_inverse=True)
    in_triple = in_triple.astype(np.int32)
    n2, n3 = (np.bincount(at[train], minlength=len(of)) for at, of in ((in_pair, pair), (in_triple, triple)))
    del in_pair, u, v, train
    learned = n2 > 0
    kept = triple[n3 > 0]
    trie = Trie(pair[learned], n2[learned], (np.cumsum(learned) - 1)[kept // n] * n + kept % n, n3[n3 > 0], unigram, discounts, whole, -4.0 - np.log10(total + types + 1.0)).mapped()
    del whole, learned, kept, n2, n3
    lower, rank, there = _in_blocks(lambda p: trie.bigrams(p // n, p % n, log_unigram), pair)

    def longer(t: np.ndarray) -> tuple[np.ndarray]:
        of = t // n
        return (trie.trigrams(t % n, pair[of] // n, lower[of], rank[of], there[of]),)

    (found,) = _in_blocks(longer, triple)
    del pair, triple
    at = 0
    for chunk, size in chunks:
        own = slice(at, at + size)
        who, number = np.unique(text[own], return_inverse=True)
        sums = [np.bincount(number, x, len(who)) for x in (found[in_triple[own]], log_unigram[w[own]], (count > 0)[w[own]])]
        yield chunk, who, sums[0], sums[1], sums[2].astype(np.uint32)
        at += size


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Callable[[int | None], bool] = held_out_by_id, shards: int | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; texts held out are not learned from."""
    size = input_bytes(docs)
    # An unknown size (no statistics) is told as a very large one.
    shards = shards or (max(8, -(-size // SHARD_BYTES)) if size < 1 << 56 else int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = _texts(docs, id_col, text_col)
    hot, common = frequent_words(texts, shards)
    answers = settle(word_counts(texts, shards, held_out, hot, common))
    first = answers.filter("shard = -1").select("blob").mapInArrow(_totals, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    total, types = first["n"] or 0, first["v"] or 0
    hot_sums = np.zeros((2, max(1, len(hot[0]))), np.int64)
    # At most MOST_HOT rows.
    per_word = answers.filter("shard = -2").select("blob").mapInArrow(_triples, "place long, n long, k long").groupBy("place").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).toArrow()
    hot_sums[:, per_word.column("place").to_numpy()] = per_word.column("n").to_numpy(), per_word.column("k").to_numpy()
    seen = answers.filter("shard = -3").select("blob").mapInArrow(_totals, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _groups(batches):
            if shard >= 0:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in _count_shard(rows, common, hot)], names=["a", "b", "c", "d"])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _groups(batches):
            out = []
            if shard == -1:
                out = [(chunk, 0, blob) for _, chunk, blob in rows]
            else:
                for chunk, who, s, b, k in _score_shard(rows, total, types, common, hot, hot_sums, discounts):
                    out.append((chunk, 1, _blob(_steps(who.astype(np.uint32)), s, b, k)))
            for i in range(0, len(out), 64):
                part = out[i : i + 64]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.binary())], names=["chunk", "kind", "blob"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            ids, known, out, n = _unblob(next(b for kind, b in rows if kind == 0), "<i8", "u1", "u1", "<i8")
            sums = [np.zeros(len(ids)) for _ in range(3)]
            for kind, blob in rows:
                if kind:
                    steps, *values = _unblob(blob, "<u4", "<f8", "<f8", "<u4")
                    who = _sums(steps)
                    for to, x in zip(sums, values, strict=True):
                        to[who] += x
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=known == 0), pa.array(out.astype(bool)), pa.array(n), pa.array(sums[2].astype(np.int64)), pa.array(np.full(len(ids), total, np.int64)), pa.array(sums[1]), pa.array(sums[0])],
                names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    asked = answers.filter("shard >= 0").select("shard", "kind", F.lit(0).cast("long").alias("chunk"), "blob")
    found = ngrams(texts, shards, held_out, hot, common).select("shard", F.lit(1).alias("kind"), "chunk", "blob")
    # Texts of chunks travel beside the n-grams, spread by their chunk.
    spread = F.when(F.col("shard") >= 0, F.col("shard").cast("long")).otherwise(-1 - F.col("chunk"))
    # The shards are shuffled once and read twice, for the discounts and then for the scores.
    met = read_again(asked.unionByName(found).repartition(shards, spread).sortWithinPartitions("shard", "kind", "chunk"))
    ones = met.mapInArrow(count, "a long, b long, c long, d long").agg(*(F.sum(c).alias(c) for c in "abcd")).first()
    ones = [x or 0 for x in ones]
    discounts = _discount_of(ones[0] + (seen["n"] or 0), ones[1] + (seen["v"] or 0)), _discount_of(*ones[2:])
    sums = met.mapInArrow(resolve, "chunk long, kind int, blob binary")
    return sums.repartition(shards, "chunk").sortWithinPartitions("chunk", "kind").select("chunk", "kind", "blob").mapInArrow(gather, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            own = np.frombuffer(blob, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(own[:, i].copy()) for i in range(3)], names=["place", "n", "k"])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = np.array([np.frombuffer(b, np.int64) for b in batch.column(0).to_pylist()], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["n", "v"])
