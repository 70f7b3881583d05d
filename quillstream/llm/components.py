"""Connected components over a table of links, by rounds of random-order contraction.

In each round every node moves to the neighbour (or itself) that comes first in a fresh random order, the
links follow, and loops and repeats go. Only minima are aggregated, so a node with very many neighbours is
never gathered in one place. Each round is checkpointed; expected rounds grow with the logarithm of the
longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link between two different nodes; nulls link nothing."""
    left = settle(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moves: list[DataFrame] = []
    while not left.isEmpty():
        turn = len(moves)

        def place(c: str, turn: int = turn):
            return F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("at"), F.col(c).alias("node"))

        both = left.select(F.col("a").alias("node"), place("b").alias("near")).unionAll(left.select(F.col("b"), place("a")))
        move = settle(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("near", place("node"))["node"].alias("to")))
        moves.append(move)
        to_a, to_b = (move.select(F.col("node").alias(c), F.col("to").alias(f"{c}2")) for c in "ab")
        left = settle(
            left.join(to_a, "a").join(to_b, "b").filter("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        )
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = moves[0].select("node", F.col("to").alias("root"))
    for move in moves[1:]:
        later = move.select(F.col("node").alias("root"), F.col("to").alias("later"))
        out = out.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    return settle(out)
