"""Connected components of voxels, purifying, and filters of particles.

Voxels are dealt into cubic blocks; a task labels one block's voxels by union-find, so its memory is bounded by a block. Only
voxels on block borders then meet their neighbours across by an equi-join on positions, and the labels that meet are
joined by star rounds over written tables. A component's label is its least linear index, whatever the partitions.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.storage import discard, written

BLOCK = 64
STRIDE = 1 << 20  # positions per axis that a linear index can hold
FORWARD_26 = [o for o in itertools.product((-1, 0, 1), repeat=3) if o > (0, 0, 0)]
FORWARD_6 = [(0, 0, 1), (0, 1, 0), (1, 0, 0)]


def linear(x: Column, y: Column, z: Column) -> Column:
    """A position as one number; z first, then y, then x."""
    return (z.cast("bigint") * STRIDE + y) * STRIDE + x


def _forward(connectivity: int) -> list[tuple[int, int, int]]:
    """(dz, dy, dx) of the neighbours that come after a voxel."""
    if connectivity not in (6, 26):
        raise ValueError("voxels have 6 or 26 neighbours")
    return FORWARD_26 if connectivity == 26 else FORWARD_6


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels (each its own index at first) with all pairs a-b joined to their least."""
    while len(a):
        p, q = labels[a], labels[b]
        differ = p != q
        a, b, p, q = a[differ], b[differ], p[differ], q[differ]
        np.minimum.at(labels, np.maximum(p, q), np.minimum(p, q))
        while (labels[labels] != labels).any():
            labels = labels[labels]
    return labels


def label_block(x: np.ndarray, y: np.ndarray, z: np.ndarray, connectivity: int) -> np.ndarray:
    """The least linear index of each voxel's component among these voxels."""
    at = (z.astype(np.int64) * STRIDE + y) * STRIDE + x
    order = np.argsort(at)
    sorted_at = at[order]
    labels = np.arange(len(at))
    for dz, dy, dx in _forward(connectivity):
        want = sorted_at + (dz * STRIDE + dy) * STRIDE + dx
        place = np.minimum(np.searchsorted(sorted_at, want), len(at) - 1)
        there = np.flatnonzero(sorted_at[place] == want)
        labels = merged(labels, there, place[there])
    out = np.empty(len(at), dtype=np.int64)
    out[order] = sorted_at[labels]
    return out


def stars(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, root of edges (keys, u, v), by alternating large and small stars. Of the rounds' tables the last alone stays."""
    edges = written(edges.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first())

    def turned(e: DataFrame, u: str, v: str) -> DataFrame:
        return e.select(*keys, F.col(u).alias("u"), F.col(v).alias("v"))

    before = mark(edges)
    while before[0]:
        both = edges.union(turned(edges, "v", "u"))
        least = written(both.groupBy(*keys, "u").agg(F.min("v").alias("m")), "least")
        large = both.join(least, [*keys, "u"]).where("v > u").select(*keys, F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = written(large.where("u <> v").distinct(), "edges")
        discard(edges, least)
        least = written(large.groupBy(*keys, "u").agg(F.min("v").alias("m")), "least")
        small = turned(large.join(least, [*keys, "u"]).where("v <> m"), "v", "m").union(turned(least, "u", "m"))
        edges = written(small.distinct(), "edges")
        discard(large, least)
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))


def connected_components(fg: DataFrame, keys: list[str], connectivity: int = 26, block: int = BLOCK) -> DataFrame:
    """keys, x, y, z, label of every voxel: the least linear index of its component."""
    blocks = [F.floor(F.col(k) / block).cast("int").alias(f"b{k}") for k in "xyz"]
    own = fg.select(*keys, *(F.col(k).cast("int").alias(k) for k in "xyz"))
    parts = ", ".join(f"`{k}` {own.schema[k].dataType.simpleString()}" for k in keys)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        return f[[*keys, "x", "y", "z"]].assign(label=label_block(f.x.to_numpy(), f.y.to_numpy(), f.z.to_numpy(), connectivity))

    local = own.select("*", *blocks).groupBy(*keys, "bx", "by", "bz").applyInPandas(run, f"{parts + ', ' if parts else ''}x int, y int, z int, label bigint")
    local = written(local, "blocks")
    offsets = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("dz", "dy", "dx"), o))) for o in _forward(connectivity)))
    moved = local.select(*keys, "x", "y", "z", "label", F.explode(offsets).alias("o")).select(*keys, F.col("label").alias("u"), *(F.floor(F.col(k) / block).alias(f"b{k}") for k in "xyz"), *((F.col(k) + F.col(f"o.d{k}")).alias(k) for k in "xyz"))
    across = moved.where(" or ".join(f"floor({k} / {block}) <> b{k}" for k in "xyz")).select(*keys, "u", "x", "y", "z")
    border = local.where(" or ".join(f"{k} % {block} in (0, {block - 1})" for k in "xyz")).select(*keys, "x", "y", "z", F.col("label").alias("v"))
    roots = stars(across.join(border, [*keys, "x", "y", "z"]).select(*keys, "u", "v"), keys)
    out = local.join(roots.withColumnRenamed("node", "label"), [*keys, "label"], "left")
    return out.select(*keys, "x", "y", "z", F.coalesce("root", "label").alias("label"))


def grid(spark, keys_frame: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Every position of an image of that shape for each row of keys_frame."""
    out = keys_frame
    for k, n in zip("zyx", reversed(shape)):
        out = out.withColumn(k, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out


def complement(fg: DataFrame, keys: list[str], shape: tuple[int, int, int]) -> DataFrame:
    """The background: positions of the image that fg hasn't."""
    every = grid(fg.sparkSession, fg.select(*keys).distinct(), shape)
    return every.join(fg.select(*keys, "x", "y", "z"), [*keys, "x", "y", "z"], "left_anti")


def sizes(labels: DataFrame, keys: list[str], voxel_volume: float = 1.0) -> DataFrame:
    return labels.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("size")).withColumn("volume", F.col("size") * voxel_volume)


def touching(shape: tuple[int, int, int]) -> Column:
    return F.greatest(*(F.when(F.col(k).isin(0, n - 1), 1).otherwise(0) for k, n in zip("xyz", shape))) == 1


def edge_labels(labels: DataFrame, keys: list[str], shape: tuple[int, int, int]) -> DataFrame:
    """keys, label of particles at the image's bounds."""
    return labels.where(touching(shape)).select(*keys, "label").distinct()


def biggest(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label of the largest particle; the least label of equal ones."""
    return found.groupBy(*keys).agg(F.max(F.struct("size", (-F.col("label")).alias("low"))).alias("m")).select(*keys, (-F.col("m.low")).alias("label"))


def filter_particles(labels: DataFrame, keys: list[str], least: float = 0, most: float = float("inf"), shape: tuple[int, int, int] | None = None, voxel_volume: float = 1.0) -> DataFrame:
    """labels of particles of a volume from least to most and, with a shape, not at the bounds; particle: dense numbers from 1."""
    from lamella.operators.filters import numbered

    kept = sizes(labels, keys, voxel_volume).where(F.col("volume").between(least, most))
    if shape:
        kept = kept.join(edge_labels(labels, keys, shape), [*keys, "label"], "left_anti")
    kept = written(numbered(kept, [*(F.col(k) for k in keys), F.col("label")], "n_"), "kept")
    first = kept.groupBy(*keys).agg(F.min("n_").alias("first_"))
    kept = kept.join(first, keys).withColumn("particle", (F.col("n_") - F.col("first_") + 1).cast("int"))
    return labels.join(kept.select(*keys, "label", "particle"), [*keys, "label"])


def painted(labels: DataFrame, properties: DataFrame, keys: list[str], value: str, background: DataFrame | None = None) -> DataFrame:
    """keys, x, y, z and the property of each voxel's particle; voxels of particles that have none get null, those of a background 0."""
    out = labels.join(properties.select(*keys, "label", value), [*keys, "label"], "left").select(*keys, "x", "y", "z", value)
    if background is None:
        return out
    return out.unionByName(background.select(*keys, "x", "y", "z").withColumn(value, F.lit(0).cast(out.schema[value].dataType)))


def purify(fg: DataFrame, keys: list[str], shape: tuple[int, int, int]) -> DataFrame:
    """The largest particle with its cavities filled: background that neither reaches the bounds nor is the largest becomes foreground."""
    labels = connected_components(fg, keys, 26)
    main = labels.join(biggest(sizes(labels, keys), keys), [*keys, "label"], "left_semi").select(*keys, "x", "y", "z")
    main = written(main, "purified")
    back = connected_components(complement(main, keys, shape), keys, 6)
    outside = edge_labels(back, keys, shape).union(biggest(sizes(back, keys), keys)).distinct()
    return main.union(back.join(outside, [*keys, "label"], "left_anti").select(*keys, "x", "y", "z"))
