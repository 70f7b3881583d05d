"""Hard-negative mining over one-dimensional distance keys (op 12).

Vectors get one more coordinate, so that all have the largest norm: a larger inner product with a query is
then a smaller Euclidean distance to it. Pivots are the centres of a bounded sample. A row's key is its
nearest pivot and its distance from it; keys are cut into rings (a pivot, an interval of distances) that are
stored sorted by (pivot, distance), a large ring in several blocks. Whatever lies within a distance r of a
query has a key within r of the query's own distance to that pivot (triangle inequality), so a search scans
an annulus of each pivot:

* first only the rings nearest to the query, until they hold ``FIRST_ROWS`` rows;
* what is found there bounds the distance of the k-th best row; every other ring that this distance reaches
  is scanned then, and no others. Inside a block the scan begins at the query's own key and widens on both
  sides until the bound of the rest certifies the k best.

Results are therefore exact. An anchor's positives are its best rows of the same label; its negatives are,
for each positive, the best rows of other labels whose score lies between a share of the positive's score
and that score: an annulus again, its inner edge the positive.

Defined cases: rows with a null id, label or vector, with null or non-finite components, with another length
than the most usual one, or with a squared norm of 2^62 or more (scores would not fit a long) take no part;
zero vectors do. Ties go to the smaller id; rows that repeat an id are rows of their own, but none is its own
anchor's positive; equal vectors, however many, are dealt to several blocks. A table without anchors or
rows gives an empty result; further columns are ignored, whatever their names. There are no texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table_path
from .nearest import _tasks

#: Rows that the pivots are fitted on; most pivots, and rings of a pivot; rows that a ring is meant to hold.
SAMPLE_ROWS, PIVOTS, RINGS, RING_ROWS = 4_096, 64, 32, 2_048
#: Rows of a block; rows that the first rings of a query hold; rows of the first step of a scan; most queries of a task.
BLOCK_ROWS, FIRST_ROWS, STEP_ROWS, TASK_QUERIES = 65_536, 4_096, 512, 65_536
#: Bounds of distances are widened by this share of the largest norm, against rounding.
SLACK = 1e-6
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1

_ROUTED = pa.schema([("ring", pa.int32()), ("d", pa.float64()), ("q", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.int32())), ("los", pa.list_(pa.int64())), ("his", pa.list_(pa.int64()))])
_ROUTED_DDL = "ring int, d double, q long, id long, label long, v array<int>, los array<long>, his array<long>"
_FOUND = pa.schema([("q", pa.int64()), ("at", pa.int32()), ("other", pa.int64()), ("score", pa.int64())])
_FOUND_DDL = "q long, at int, other long, score long"


def _matrix(column: pa.Array, n: int, kind) -> np.ndarray:
    return column.flatten().to_numpy().astype(kind, copy=False).reshape(n, -1)


def products(rows: np.ndarray, query: np.ndarray, largest: float) -> np.ndarray:
    """Exact integer inner products; double precision holds them below 2^52, else Python's integers do."""
    if largest**2 < 2.0**52:
        return (rows @ query).astype(np.int64)
    return (rows.astype(np.int64).astype(object) @ query.astype(np.int64).astype(object)).astype(np.int64)


def centres(sample: np.ndarray, k: int, rounds: int = 5, seed: int = 5) -> np.ndarray:
    """Centres of a few rounds of k-means."""
    out = sample[np.sort(np.random.default_rng(seed).permutation(len(sample))[:k])]
    for _ in range(rounds):
        near = _distances(sample, out).argmin(axis=1)
        out = np.stack([sample[near == c].mean(axis=0) if (near == c).any() else out[c] for c in range(len(out))])
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T))


class Keys:
    """Pivots and ring edges: small, of bounded size, fitted on the sample."""

    def __init__(self, sample: np.ndarray, largest: float, rows: int):
        self.largest = largest
        placed = self.lifted(sample)
        self.pivots = centres(placed, max(1, min(PIVOTS, rows // (4 * RING_ROWS), len(placed))))
        rings = max(1, min(RINGS, rows // (len(self.pivots) * RING_ROWS)))
        d = _distances(placed, self.pivots)
        near = d.argmin(axis=1)
        shares = np.arange(1, rings) / rings
        self.edges = np.stack([np.quantile(d[near == p, p], shares) if (near == p).any() else np.zeros(rings - 1) for p in range(len(self.pivots))])
        self.rings = rings

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        """Vectors with the coordinate that gives all of them the largest norm."""
        return np.column_stack([rows, np.sqrt(np.maximum(0.0, self.largest**2 - (rows**2).sum(axis=1)))])

    def to_pivots(self, queries: np.ndarray) -> np.ndarray:
        return _distances(np.column_stack([queries, np.zeros(len(queries))]), self.pivots)

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ring, distance to its pivot) of each row."""
        d = _distances(self.lifted(rows), self.pivots)
        pivot = d.argmin(axis=1)
        own = d[np.arange(len(rows)), pivot]
        return (pivot * self.rings + (own[:, None] > self.edges[pivot]).sum(axis=1)).astype(np.int32), own

    def distance(self, query: np.ndarray, score: int) -> float:
        """The distance at which a row has this inner product with the query."""
        return float(np.sqrt(max(0.0, float((query**2).sum()) + self.largest**2 - 2.0 * score)))


class Block:
    """Rows of one block in the order of their distance from its pivot."""

    def __init__(self, d: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, keys: Keys):
        self.d, self.ids, self.labels, self.vectors, self.keys = d, ids, labels, vectors, keys

    def search(self, query: np.ndarray, d: float, own: int, label: int, los: list[int], his: list[int], same: bool, k: int) -> list[list[tuple[int, int]]]:
        """For each range of scores the k best (id, score) of the rows with the query's label (itself excepted), or with another one."""
        n, slack = len(self.ids), SLACK * self.keys.largest
        a = b = int(np.searchsorted(self.d, d))
        floors, step = list(los), STEP_ROWS
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        while a > 0 or b < n:
            gap = min(d - self.d[a - 1] if a > 0 else np.inf, self.d[b] - d if b < n else np.inf)
            if gap - slack > max(self.keys.distance(query, f) for f in floors):
                break
            wide_a, wide_b = max(0, a - step), min(n, b + step)
            for x, y in ((wide_a, a), (b, wide_b)):
                part = products(self.vectors[x:y], query, self.keys.largest)
                fits = (self.labels[x:y] == label) & (self.ids[x:y] != own) if same else self.labels[x:y] != label
                fits &= (part >= min(floors)) & (part <= max(his))
                ids, scores = np.concatenate([ids, self.ids[x:y][fits]]), np.concatenate([scores, part[fits]])
            a, b, step = wide_a, wide_b, step * 2
            for j, (low, high) in enumerate(zip(los, his, strict=True)):
                inside = scores[(scores >= low) & (scores <= high)]
                if len(inside) >= k:
                    floors[j] = int(np.partition(inside, len(inside) - k)[len(inside) - k])
        out = []
        for low, high in zip(floors, his, strict=True):
            at = np.flatnonzero((scores >= low) & (scores <= high))
            at = at[np.lexsort((ids[at], -scores[at]))[:k]]
            out.append(list(zip(ids[at].tolist(), scores[at].tolist(), strict=True)))
        return out


class Index:
    """The stored rows (ring, block, d, id, label, v), sorted by (ring, d), and what a query must know to find its rings."""

    def __init__(self, table: DataFrame):
        """``table``: id, label, v (array<int>), complete rows of one length."""
        spark = self.spark = table.sparkSession
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
        told = table.agg(F.max(norm).alias("m"), F.count(F.lit(1)).alias("n")).first()
        self.rows = int(told["n"])
        if not self.rows:
            return
        sample = table.select("v", F.xxhash64(F.lit(3), "id").alias("h")).orderBy("h").limit(SAMPLE_ROWS).collect()
        self.keys = keys = Keys(np.array([r["v"] for r in sample], np.float64), float(told["m"]), self.rows)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    ring, d = keys.place(_matrix(batch.column(2), batch.num_rows, np.float64))
                    yield pa.RecordBatch.from_arrays([pa.array(ring), pa.array(d), *batch.columns], names=["ring", "d", "id", "label", "v"])

        path = table_path(spark, "keys")
        placed = table.select("id", "label", "v").mapInArrow(place, "ring int, d double, id long, label long, v array<int>")
        # A number for each row, so that rows with one id or one vector can be told apart; fixed by being written.
        placed.withColumn("q", F.monotonically_increasing_id()).repartitionByRange(_tasks(table), "ring", "d", "q").sortWithinPartitions("ring", "d").write.parquet(path)
        self.table = spark.read.parquet(path)
        # At most PIVOTS * RINGS rows.
        rings = sorted(self.table.groupBy("ring").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count(F.lit(1)).alias("n")).collect())
        self.ring = np.array([r["ring"] for r in rings], np.int32)
        self.low, self.high, self.held = (np.array([r[c] for r in rings]) for c in ("low", "high", "n"))
        blocks = -(-self.held // BLOCK_ROWS)
        self.begin = np.cumsum(blocks) - blocks
        self.blocks, self.all_blocks = blocks, int(blocks.sum())

    def _route(self, first: bool):
        keys, ring, low, high, held = self.keys, self.ring, self.low, self.high, self.held
        pivot, slack = ring // keys.rings, SLACK * keys.largest

        def needed(query, d, los, his) -> tuple[np.ndarray, np.ndarray]:
            """(rings that may hold a row in one of the ranges, least distance of each ring's rows)."""
            near, far = np.maximum(0.0, np.maximum(low - d[pivot], d[pivot] - high)) - slack, d[pivot] + high + slack
            need = np.zeros(len(ring), bool)
            for lo, hi in zip(los, his, strict=True):
                need |= (near <= keys.distance(query, lo)) & (far >= keys.distance(query, hi)) & (lo <= hi)
            return np.flatnonzero(need), near

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                q, own, label, los, his, done = (batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6))
                vectors = _matrix(batch.column(3), batch.num_rows, np.float64)
                to = keys.to_pivots(vectors)
                for i in range(batch.num_rows):
                    rings, near = needed(vectors[i], to[i], los[i], his[i])
                    if first:
                        rings = rings[np.argsort(near[rings], kind="stable")]
                        rings = rings[: 1 + int(np.searchsorted(np.cumsum(held[rings]), FIRST_ROWS))]
                    else:
                        rings = rings[~np.isin(ring[rings], done[i])]
                    n = len(rings)
                    if n:
                        same = [pa.array([x] * n, f.type) for x, f in zip((q[i], own[i], label[i], vectors[i].astype(np.int32), los[i], his[i]), list(_ROUTED)[2:], strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(ring[rings], pa.int32()), pa.array(to[i][pivot[rings]]), *same], schema=_ROUTED)

        return run

    def _scan(self, routed: DataFrame, queries: int, same: bool, k: int) -> DataFrame:
        """(q, at, other, score): each block's k best for each range. A block is built once; its queries stream through it."""
        blocks, begin, chunks, keys = self.blocks, self.begin, max(1, -(-queries // TASK_QUERIES)), self.keys
        known = self.spark.createDataFrame([(int(r), int(a), int(n)) for r, a, n in zip(self.ring, begin, blocks, strict=True)], "ring int, begin long, blocks long")
        known = F.broadcast(known)
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        data = self.table.join(known, "ring").select((F.col("begin") + F.pmod(F.xxhash64("q"), "blocks")).alias("block"), F.lit(0).alias("kind"), "d", "q", "id", "label", "v", F.lit(None).cast("array<long>").alias("los"), F.lit(None).cast("array<long>").alias("his"))
        data = data.select("*", every(F.lit(chunks).cast("long")).alias("chunk"))
        asked = routed.join(known, "ring").select("*", every(F.col("blocks")).alias("nth")).select((F.col("begin") + F.col("nth")).alias("block"), F.lit(1).alias("kind"), "d", "q", "id", "label", "v", "los", "his", F.pmod(F.xxhash64("q"), F.lit(chunks)).alias("chunk"))
        cells = data.unionByName(asked).withColumn("cell", (F.col("block") * chunks + F.col("chunk")).cast("int"))
        dealt = cells.select("cell", "kind", "d", "q", "id", "label", "v", "los", "his").repartitionById(self.all_blocks * chunks, F.col("cell")).sortWithinPartitions("cell", "kind", "d")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, parts, block = None, [], None
            for batch in batches:
                if not batch.num_rows:
                    continue
                where, kind, d, q, ids, labels = (batch.column(i).to_numpy() for i in range(6))
                vectors = _matrix(batch.column(6), batch.num_rows, np.float64)
                los, his = batch.column(7).to_pylist(), batch.column(8).to_pylist()
                found: list[tuple[int, int, int, int]] = []
                cuts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (kind[1:] != kind[:-1])])
                for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                    if where[a] != cell:
                        cell, parts, block = where[a], [], None
                    if kind[a] == 0:
                        parts.append((d[a:b], ids[a:b], labels[a:b], vectors[a:b]))
                        continue
                    if block is None and parts:
                        block = Block(*(np.concatenate(x) for x in zip(*parts, strict=True)), keys)
                        parts = []
                    for i in range(a, b if block is not None else a):
                        got = block.search(vectors[i], float(d[i]), int(ids[i]), int(labels[i]), los[i], his[i], same, k)
                        found += [(int(q[i]), j, other, score) for j, best in enumerate(got) for other, score in best]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), _FOUND, strict=True)], schema=_FOUND)

        return dealt.mapInArrow(run, _FOUND_DDL)

    def best(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """(q, at, rank, other, score): the k best rows in each range of scores of each query (q, id, label, v, los, his)."""
        asked, columns = queries.count(), ["q", "id", "label", "v", "los", "his"]
        order = Window.partitionBy("q", "at").orderBy(F.desc("score"), "other")

        def merged(found: DataFrame) -> DataFrame:
            return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

        def kept(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(path := table_path(self.spark, name))
            return self.spark.read.parquet(path)

        # Which rings come first is written down, not worked out a second time.
        near = kept(queries.select(*columns, F.lit(None).cast("array<int>").alias("done")).mapInArrow(self._route(True), _ROUTED_DDL), "routes")
        begun = kept(merged(self._scan(near, asked, same, k)), "found")
        # The k-th best so far is the least score that can still matter.
        floor = begun.filter(F.col("rank") == k).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("at", "score"))).alias("floor"))
        done = near.groupBy("q").agg(F.collect_list("ring").alias("done"))
        raised = F.transform("los", lambda lo, j: F.coalesce(F.try_element_at("floor", j), lo))
        rest = queries.join(floor, "q", "left").join(done, "q", "left").select("q", "id", "label", "v", raised.alias("los"), "his", F.coalesce("done", F.array().cast("array<int>")).alias("done"))
        return merged(begun.drop("rank").unionByName(self._scan(rest.mapInArrow(self._route(False), _ROUTED_DDL), asked, same, k)))


def usable_vectors(table: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, v) of the rows that take part; integer components."""
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    small = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) < 2.0**62
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(good & small, F.lit(False)) & (F.size("v") > 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (length["n"] if length else 0)).withColumn("v", F.col("v").cast("array<int>"))


def mine(table: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "vec_id", label_col: str = "label", vector_col: str = "v") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vector_col`` holds whole numbers; ``is_anchor`` is an expression on ``id``. A negative's score is at
    least ``share`` (a fraction) of the positive's and at most the positive's.
    """
    index = Index(usable_vectors(table, id_col, label_col, vector_col))
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not index.rows:
        return table.sparkSession.createDataFrame([], empty)
    anchors = index.table.filter(is_anchor).select("q", "id", "label", "v")
    path = table_path(table.sparkSession, "positives")
    index.best(anchors.select("*", F.array(F.lit(LOWEST)).alias("los"), F.array(F.lit(HIGHEST)).alias("his")), True, positives).write.parquet(path)
    found = table.sparkSession.read.parquet(path)
    own = found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("other").alias("positive_id"), "score"))).alias("p"))
    part, whole = share
    # Least whole score of at least part / whole of the positive's; quotients of longs, so nothing is rounded.
    scores = F.transform("p", lambda p: p["score"])
    least = F.transform(scores, lambda s: F.ceil(s.cast("decimal(38,0)") * part / F.lit(whole).cast("decimal(38,0)")).cast("long"))
    asked = anchors.join(own, "q").select("q", "id", "label", "v", least.alias("los"), scores.alias("his"))
    hard = index.best(asked, False, negatives)
    pairs = found.select("q", (F.col("rank") - 1).alias("at"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(pairs, ["q", "at"]).join(anchors.select("q", F.col("id").alias("anchor_id")), "q").select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
