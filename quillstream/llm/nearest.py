"""Approximate nearest neighbours by collision-counting hashing (op 10).

Nearness is the inner product. Vectors are scaled by the largest norm and given one more coordinate, so
that Euclidean nearness to a normed query has the same order. The index is cut into blocks by hash; a
block holds, for each of ``PROJECTIONS`` random directions, its vectors' projections as one sorted array.
A query counts collisions: around its own projection a window opens in each array, widened step by step
(virtual rehashing); a vector that lies in enough windows is verified with its exact inner product in
double precision. Widening ends once the k-th best verified vector is nearer than the distance that the
windows stand for. Every query visits every block, and block results are merged, so no row is left out;
only a block's index and one batch of queries are in memory at once. A block is built once and the queries
stream through it; it is dealt to several tasks only to keep all cores busy while blocks are few, and once
more for every ``TASK_QUERIES`` queries, which bounds what a lost task costs.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do such of another
length than the most usual one. Ties go to the smaller id; with fewer candidates than k, all are returned;
rows that repeat an id are candidates of their own (not of that id's query); a null id takes no part;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Random directions; window half-width as a share of the distance; growth of the distance from step to step; how many standard deviations under the expected collisions a vector at that distance is still verified.
PROJECTIONS, WIDTH, GROWTH, SLACK = 64, 0.8, 1.06, 1.3
#: Vectors of a block, queries that are searched at once, and the most queries of a task; block and task bound the work of one.
BLOCK_ROWS, CHUNK_ROWS, TASK_QUERIES = 16_384, 512, 65_536
#: Distances of the steps, up to the largest that two vectors of the scaled space can have.
REACHES = 0.7 * GROWTH ** np.arange(1 + int(np.ceil(np.log(2 / 0.7) / np.log(GROWTH))))


def usable(embedding: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(good & F.exists(embedding, lambda x: x != 0), F.lit(False))


class Block:
    """Sorted projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float, seed: int = 11):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        norms = np.sqrt((self.vectors**2).sum(axis=1))
        extra = np.sqrt(np.maximum(0.0, 1.0 - (norms / largest) ** 2))
        rng = np.random.default_rng(seed)
        self.largest, self.directions = largest, rng.standard_normal((PROJECTIONS, vectors.shape[1] + 1))
        # A norm of 1 for the projections' unit: a difference of projections has the deviation of the distance.
        placed = np.column_stack([self.vectors / largest, extra]) @ self.directions.T
        self.order = np.argsort(placed, axis=0).T.astype(np.int32).copy()
        self.sorted = np.take_along_axis(placed.T, self.order.astype(np.int64), axis=1).copy()
        hit = erf(WIDTH / sqrt(2))
        self.least = int(PROJECTIONS * hit - SLACK * sqrt(PROJECTIONS * hit * (1 - hit)))

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the (ids, inner products) of its k best verified vectors, its own id excepted."""
        lengths = np.sqrt((queries**2).sum(axis=1))
        at = (queries / lengths[:, None]) @ self.directions[:, :-1].T
        spans = (WIDTH * REACHES)[:, None]
        # Ends of every window: projection by step by query.
        low = np.stack([np.searchsorted(row, at[:, p] - spans) for p, row in enumerate(self.sorted)])
        high = np.stack([np.searchsorted(row, at[:, p] + spans, "right") for p, row in enumerate(self.sorted)])
        out, begin = [], 0
        for q in range(len(own)):
            # Steps that did not do for the query before are passed over; windows only open wider for it.
            *found, ended = self._one(int(own[q]), queries[q], lengths[q] * self.largest, low[:, :, q].T.tolist(), high[:, :, q].T.tolist(), k, begin)
            out.append(tuple(found))
            begin = max(0, ended - 1)
        return out

    def _one(self, own: int, query: np.ndarray, scale: float, low: list[list[int]], high: list[list[int]], k: int, begin: int) -> tuple[np.ndarray, np.ndarray, int]:
        n = len(self.ids)
        counts, seen = np.zeros(n, dtype=np.int64), self.ids == own
        found, score, verified, worst = [], [], 0, -np.inf

        def verify(which: np.ndarray) -> None:
            nonlocal verified, worst
            if not len(which):
                return
            seen[which] = True
            found.append(which)
            score.append((self.vectors[which] * query).sum(axis=1))
            verified += len(which)
            if verified >= k:
                best = np.concatenate(score)
                worst = np.partition(best, verified - k)[verified - k]

        inner_low = inner_high = None
        for step in range(begin, len(REACHES)):
            reach = REACHES[step]
            if inner_low is None:
                parts = [row[a:b] for row, a, b in zip(self.order, low[step], high[step], strict=True)]
            else:
                parts = [p for row, a, b, c, d in zip(self.order, low[step], inner_low, inner_high, high[step], strict=True) for p in (row[a:b], row[c:d])]
            inner_low, inner_high = low[step], high[step]
            counts += np.bincount(np.concatenate(parts), minlength=n)
            verify(np.flatnonzero((counts >= self.least) & ~seen))
            # Squared distance of the k-th best to the normed query, in the scaled space.
            if verified >= k and 2 - 2 * worst / scale <= reach**2:
                break
        else:
            # The windows stand for the largest distance there is: what is left is verified without them.
            verify(np.flatnonzero(~seen))
        if not found:
            return self.ids[:0], np.empty(0), step
        which, value = np.concatenate(found), np.concatenate(score)
        top = np.lexsort((self.ids[which], -value))[:k]
        return self.ids[which[top]], value[top], step


def _tasks(table: DataFrame) -> int:
    """Two tasks a core of the session, or its shuffle partitions where these are more."""
    spark = table.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def nearest(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row where ``is_query`` holds on the columns id and v."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    out = "query_id long, vec_id long, score double"
    if length is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    rows = rows.filter(F.size("v") == length["n"])
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    largest = rows.agg(F.max(norm).alias("m"), F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    blocks, longest = -(-largest["n"] // BLOCK_ROWS), float(largest["m"])
    # Tasks that use all cores while blocks are few; no more of them than there are chunks of queries.
    wanted = min(-(-_tasks(table) // blocks), -(-largest["q"] // CHUNK_ROWS))
    chunks = max(1, wanted, -(-largest["q"] // TASK_QUERIES))
    spread = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.select("id", "v", spread(1, blocks).alias("block"), F.lit(0).alias("kind")).select("*", every(chunks).alias("chunk"))
    asked = rows.filter(is_query).select("id", "v", spread(2, chunks).alias("chunk"), F.lit(1).alias("kind")).select("*", every(blocks).alias("block"))
    cells = data.unionByName(asked).withColumn("cell", F.col("block").cast("long") * chunks + F.col("chunk"))
    parts = max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks * chunks)
    # A cell is a partition: hashing would put several into one task and leave others idle.
    dealt = cells.select("cell", "kind", "id", "v").repartitionById(parts, F.col("cell").cast("int")).sortWithinPartitions("cell", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, vectors, block = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            where, kind, own = (batch.column(i).to_numpy() for i in range(3))
            flat = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
            answer: list[tuple[int, np.ndarray, np.ndarray]] = []
            cuts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (kind[1:] != kind[:-1])])
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                if where[a] != cell:
                    cell, ids, vectors, block = where[a], [], [], None
                if kind[a] == 0:
                    ids.append(own[a:b])
                    vectors.append(flat[a:b])
                    continue
                if block is None and ids:
                    block = Block(np.concatenate(ids), np.concatenate(vectors), longest)
                for at in range(a, b if block is not None else a, CHUNK_ROWS):
                    some = slice(at, min(b, at + CHUNK_ROWS))
                    answer += [(int(q), *got) for q, got in zip(own[some], block.search(own[some], flat[some], k), strict=True)]
            if answer:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.full(len(i), q) for q, i, _ in answer]), pa.int64()), pa.array(np.concatenate([i for _, i, _ in answer]), pa.int64()), pa.array(np.concatenate([s for *_, s in answer]), pa.float64())],
                    names=["query_id", "vec_id", "score"],
                )

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = dealt.mapInArrow(run, out).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")
