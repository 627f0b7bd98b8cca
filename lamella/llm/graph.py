"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is joins and partial minimums over edges in written tables, of which the last alone stays; nothing of the graph
reaches the driver but two numbers a round. A node with very many edges is a large partition of a plain join, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm._common import discard, written

MOST_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    return written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both)
    moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    out = written(moved.where("u <> v").distinct(), "edges")
    discard(edges, least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = written(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    discard(edges, least)
    return out


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v: bigint) but the roots; a root is the least node of its component. A written table."""
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = _mark(edges)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        edges = _small_star(_large_star(edges))
        now = _mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out.lm_path = edges.lm_path
    return out
