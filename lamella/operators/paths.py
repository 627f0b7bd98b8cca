"""Longest shortest paths of graphs, by bounds on how far each vertex's farthest one is.

Once the distances from a source are known, and the largest of them, every vertex at distance d has its own farthest vertex no further
than d + that largest. So a few sources, those of the highest bounds and those near the middle in turn, rule out nearly all others:
vertices whose bound is no more than the longest path found need no search. Graphs of up to `whole` branches are a group of a
task each; of larger ones the distances from many sources at once spread over the written edge table in rounds, one join and a
grouped minimum each, so no such graph is a task. Both give the same lengths.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.storage import discard, written

WHOLE = 20_000
#: Searches of a graph at once.
SOURCES = 4
#: Sums in another order differ by this at most, relative to a path; bounds that exceed a path by less are no longer ones.
SLACK = 1e-12


def distances(around: list[list[tuple[int, float]]], start: int) -> np.ndarray:
    """From a vertex to all others of a list of neighbours with lengths."""
    far = np.full(len(around), np.inf)
    far[start] = 0.0
    queue = [(0.0, start)]
    while queue:
        d, i = heapq.heappop(queue)
        if d > far[i]:
            continue
        for j, w in around[i]:
            if d + w < far[j]:
                far[j] = d + w
                heapq.heappush(queue, (d + w, j))
    return far


def longest_of(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, count: int) -> tuple[float, int, int]:
    """(length, start, stop) of a connected graph of vertices 0 to count - 1 and branches from a to b."""
    around: list[list[tuple[int, float]]] = [[] for _ in range(count)]
    for i, j, w in zip(a.tolist(), b.tolist(), lengths.tolist()):
        around[i].append((j, w))
        around[j].append((i, w))
    low, high, best, turn = np.zeros(count), np.full(count, np.inf), (0.0, 0, 0), 0
    open_ = np.arange(count)
    while len(open_):
        start = int(open_[(-high[open_] if turn % 2 == 0 else low[open_]).argmin()])
        d = distances(around, start)
        end = int(d.argmax())
        if d[end] > best[0]:
            best = (float(d[end]), min(start, end), max(start, end))
        low, high = np.maximum(low, np.maximum(d, d[end] - d)), np.minimum(high, d + d[end])
        high[start] = 0.0
        open_, turn = np.flatnonzero(high > best[0] * (1 + SLACK)), turn + 1
    return best


def _spread(sources: DataFrame, ways: DataFrame, keys: list[str]) -> DataFrame:
    """keys, source, vertex, d: the distances from sources (keys, source) over ways (keys, u, v, length)."""
    now = written(sources.select(*keys, "source", F.col("source").alias("vertex"), F.lit(0.0).alias("d"), F.lit(True).alias("fresh")), "reached")
    while not now.where("fresh").isEmpty():
        step = now.where("fresh").withColumnRenamed("vertex", "u").join(ways, [*keys, "u"])
        step = step.select(*keys, "source", F.col("v").alias("vertex"), (F.col("d") + F.col("length")).alias("d"), F.lit(True).alias("fresh"))
        both = now.withColumn("fresh", F.lit(False)).union(step)
        known, new = F.min(F.when(~F.col("fresh"), F.col("d"))), F.min(F.when(F.col("fresh"), F.col("d")))
        after = both.groupBy(*keys, "source", "vertex").agg(F.min("d").alias("d"), F.coalesce(new < known, known.isNull()).alias("fresh"))
        after = written(after, "reached")
        discard(now)
        now = after
    return now


def longest_in_rounds(edges: DataFrame, keys: list[str], sources: int = SOURCES) -> DataFrame:
    """keys, length, start and stop of the graph of each keys, from edges (keys, v1, v2, length), none of them in one task. A round asks
    so many vertices of each graph; the tables of a round go when the next is written."""
    ends = edges.where("v1 <> v2")
    ways = ends.select(*keys, F.col("v1").alias("u"), F.col("v2").alias("v"), "length").union(ends.select(*keys, "v2", "v1", "length"))
    ways = written(ways.groupBy(*keys, "u", "v").agg(F.min("length").alias("length")), "ways")
    bounds = written(ways.select(*keys, F.col("u").alias("vertex"), F.lit(0.0).alias("low"), F.lit(float("inf")).alias("high")).distinct(), "bounds")
    found, turn = None, 0
    while True:
        order = F.struct("high", "low", "vertex") if turn % 2 == 0 else F.struct((-F.col("low")).alias("low"), "high", "vertex")
        asked = bounds.where("high > 0").withColumn("part_", F.pmod(F.xxhash64("vertex"), F.lit(sources)))
        asked = written(asked.groupBy(*keys, "part_").agg(F.max_by("vertex", order).alias("source")).select(*keys, "source"), "asked")
        if asked.isEmpty():
            discard(asked, bounds, ways)
            return found
        reached = _spread(asked, ways, keys)
        farthest = reached.groupBy(*keys, "source").agg(F.max("d").alias("e"), F.max_by("vertex", F.struct("d", "vertex")).alias("end"))
        farthest = written(farthest, "farthest")
        ends = farthest.select(*keys, F.col("e").alias("length"), F.least("source", "end").alias("start"), F.greatest("source", "end").alias("stop"))
        every = ends if found is None else found.union(ends)
        best = every.groupBy(*keys).agg(F.max(F.struct("length", "start", "stop")).alias("b")).select(*keys, "b.length", "b.start", "b.stop")
        best = written(best, "longest")
        d, e = F.col("d"), F.col("e")
        told = reached.join(farthest.select(*keys, "source", "e"), [*keys, "source"]).groupBy(*keys, "vertex")
        told = told.agg(F.max(F.greatest(d, e - d)).alias("l_"), F.min(F.when(F.col("source") == F.col("vertex"), 0.0).otherwise(d + e)).alias("h_"))
        now = bounds.join(told, [*keys, "vertex"], "left").join(best.select(*keys, "length"), keys)
        high = F.least("high", F.coalesce("h_", "high"))
        now = now.select(*keys, "vertex", F.greatest("low", F.coalesce("l_", "low")).alias("low"), F.when(high > F.col("length") * (1 + SLACK), high).otherwise(0.0).alias("high"))
        now = written(now.where("high > 0"), "bounds")
        discard(bounds, asked, reached, farthest, *([found] if found is not None else []))
        bounds, found, turn = now, best, turn + 1


def longest(edges: DataFrame, keys: list[str], whole: int = WHOLE, sources: int = SOURCES) -> DataFrame:
    """keys, length, start and stop (the lesser vertex first; of paths that are equally long, any) of the longest of the shortest paths of
    the graph of each keys, from edges (keys, v1, v2: bigint, length: not negative). A graph of loops alone, or of branches without length,
    has length 0 and its least vertex at both ends."""
    edges = written(edges.select(*keys, "v1", "v2", F.col("length").cast("double").alias("length")), "ways")
    sizes = written(edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"), F.min(F.least("v1", "v2")).alias("first_")), "sizes")
    parts = "".join(f"`{k}` {edges.schema[k].dataType.simpleString()}, " for k in keys)

    def run(key, f):
        names = np.unique(f[["v1", "v2"]].to_numpy())
        length, a, b = longest_of(np.searchsorted(names, f.v1), np.searchsorted(names, f.v2), f.length.to_numpy(), len(names))
        return pd.DataFrame([[*key, length, int(names[a]), int(names[b])]], columns=[*keys, "length", "start", "stop"])

    small = edges.join(sizes.where(F.col("n_") <= whole).select(*keys), keys, "left_semi")
    out = small.groupBy(*keys).applyInPandas(run, parts + "length double, start bigint, stop bigint")
    large = sizes.where(F.col("n_") > whole)
    if large.isEmpty():
        return out
    bare = large.select(*keys, F.lit(0.0).alias("length"), F.col("first_").alias("start"), F.col("first_").alias("stop"))
    found = longest_in_rounds(edges.join(large.select(*keys), keys, "left_semi"), keys, sources)
    if found is not None:
        found = found.where("length > 0")
        out, bare = out.unionByName(found), bare.join(found.select(*keys), keys, "left_anti")
    return out.unionByName(bare)
