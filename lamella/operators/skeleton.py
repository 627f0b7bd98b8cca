"""Skeletons: thinning, analysis of branches and junctions, and angles at junctions.

Thinning peels an image by subfields: of the voxels on the surface at the start of a round, those of each of the eight parities of
(x, y, z) in turn go, if they are simple and no ends. No two voxels of a parity are neighbours, so all of one go at once without a change
of topology, and a round needs to see no further than eight voxels: blocks of the image exchange such halos and are peeled side by side,
with the same result for any size of blocks. Everything after is grouped aggregates and joins over skeleton voxels.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators import blocks as dense
from lamella.operators import paths
from lamella.operators.components import connected_components, linear, stars
from lamella.storage import discard, written

_N26 = [o for o in itertools.product((-1, 0, 1), repeat=3) if o != (0, 0, 0)]
_N18 = [i for i, o in enumerate(_N26) if sum(map(abs, o)) <= 2]


def _bits(places) -> int:
    return sum(1 << i for i in places)


#: For each of the 26 neighbours: those next to it (for foreground), and those of the 18 that share a face with it (for background).
_BESIDE = [_bits(j for j, b in enumerate(_N26) if j != i and max(abs(p - q) for p, q in zip(a, b)) <= 1) for i, a in enumerate(_N26)]
_FACING = [_bits(j for j in _N18 if sum(abs(p - q) for p, q in zip(_N26[i], _N26[j])) == 1) for i in range(26)]
_EIGHTEEN, _SIX = _bits(_N18), _bits(i for i, o in enumerate(_N26) if sum(map(abs, o)) == 1)
PARITIES = list(itertools.product((0, 1), repeat=3))
ROUND_HALO = len(PARITIES)


def _grown(start: np.ndarray, within: np.ndarray, beside: list[int]) -> np.ndarray:
    """The neighbours that start reaches over steps within a set; all as bits."""
    while True:
        out = start
        for i, near in enumerate(beside):
            out = out | np.where(out >> i & 1, near, 0) & within
        if (out == start).all():
            return out
        start = out


def is_simple(bits: np.ndarray) -> np.ndarray:
    """Whether voxels with these foreground neighbours can go without a change of topology: one foreground component among 26,
    one background component that touches it by a face among 18."""
    back = ~bits & _EIGHTEEN
    faces = back & _SIX
    whole = _grown(bits & -bits, bits, _BESIDE) == bits
    return (bits != 0) & (faces != 0) & whole & (_grown(faces & -faces, back, _FACING) & _SIX == faces)


def peel(v: np.ndarray, low: tuple[int, int, int]) -> np.ndarray:
    """One round over an array whose first position is low (z, y, x). What it makes of positions within ROUND_HALO of the bounds
    depends on what lies beyond; the outermost layer stays."""
    v = v.copy()
    inner = v[1:-1, 1:-1, 1:-1]
    surface = np.zeros_like(inner)
    for i in range(3):
        for d in (0, 2):
            surface |= ~v[tuple(slice(d, v.shape[k] - 2 + d) if k == i else slice(1, -1) for k in range(3))]
    at = np.argwhere(inner & surface) + 1
    flat, strides = v.reshape(-1), np.array([v.shape[1] * v.shape[2], v.shape[2], 1])
    steps = np.array(_N26) @ strides
    parity = (at + low) & 1
    for p in PARITIES:
        own = at[(parity == p).all(axis=1)] @ strides
        bits = np.zeros(len(own), dtype=np.int64)
        for i, step in enumerate(steps):
            bits |= flat[own + step].astype(np.int64) << i
        thick = np.bitwise_count(bits) > 1
        own, bits = own[thick], bits[thick]
        kinds, which = np.unique(bits, return_inverse=True)
        flat[own[is_simple(kinds)[which]]] = False
    return v


def thin(volume: np.ndarray) -> np.ndarray:
    """The skeleton of a volume (z, y, x): rounds until none takes a voxel."""
    v = np.pad(volume.astype(bool), 1)
    while True:
        out = peel(v, (-1, -1, -1))
        if (out == v).all():
            return v[1:-1, 1:-1, 1:-1]
        v = out


def skeletonise(fg: DataFrame, keys: list[str], block: int = dense.BLOCK, rounds: int = 1) -> DataFrame:
    """keys, x, y, z of the skeleton. Blocks are peeled so many rounds between two exchanges of halos, which are that much wider."""

    def fn(a: np.ndarray, low) -> np.ndarray:
        for _ in range(rounds):
            a = peel(a, low)
        return a

    now = written(dense.blocks_of(fg, keys, None, block), "peeled")
    while True:
        out = written(dense.stencil(now, keys, ROUND_HALO * rounds, fn, bool, block), "peeled")
        discard(now)
        now = out
        if not now.agg(F.sum("changed")).first()[0]:
            return dense.voxels_of(now, keys, None, block)


def classified(skeleton: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y, z, n (neighbours) and kind: end (one at most), slab (two) or junction (more)."""
    offsets = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("dz", "dy", "dx"), o))) for o in _N26))
    own = skeleton.select(*keys, "x", "y", "z")
    near = own.select(*keys, F.explode(offsets).alias("o"), "x", "y", "z").select(*keys, *((F.col(k) + F.col(f"o.d{k}")).alias(k) for k in "xyz"))
    counts = near.groupBy(*keys, "x", "y", "z").agg(F.count(F.lit(1)).alias("n"))
    out = own.join(counts, [*keys, "x", "y", "z"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("kind", F.when(F.col("n") <= 1, "end").when(F.col("n") == 2, "slab").otherwise("junction"))


def elements(skeleton: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(at, slabs): the voxels of vertices (keys, x, y, z, vertex, kind) and of branches (keys, x, y, z, branch)."""
    points = classified(skeleton, keys)
    ends = points.where("kind = 'end'").select(*keys, "x", "y", "z", linear(F.col("x"), F.col("y"), F.col("z")).alias("vertex"), "kind")
    joints = connected_components(points.where("kind = 'junction'"), keys, 26).select(*keys, "x", "y", "z", F.col("label").alias("vertex"), F.lit("junction").alias("kind"))
    slabs = connected_components(points.where("kind = 'slab'"), keys, 26).select(*keys, "x", "y", "z", F.col("label").alias("branch"))
    return ends.union(joints), slabs


def graph(skeleton: DataFrame, keys: list[str], spacing=(1.0, 1.0, 1.0)) -> tuple[DataFrame, DataFrame]:
    """(vertices, branches). A vertex is an end voxel or a component of junction voxels, at their centroid; a branch is a component
    of slab voxels, or a step between two vertices, with its calibrated length between the nearest voxels of its vertices."""
    vertices, branches = graph_of(*elements(skeleton, keys), keys, spacing)
    return vertices, branches.drop("branch")


def graph_of(at: DataFrame, slabs: DataFrame, keys: list[str], spacing=(1.0, 1.0, 1.0)) -> tuple[DataFrame, DataFrame]:
    """The vertices and branches of `elements`; branch is null for a step between two vertices."""
    vertices = at.groupBy(*keys, "vertex", "kind").agg(F.count(F.lit(1)).alias("voxels"), *((F.avg(k) * spacing[i]).alias(k) for i, k in enumerate("xyz")))
    offsets = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("dz", "dy", "dx"), o)), F.lit(float(np.sqrt(sum((a * s) ** 2 for a, s in zip(o, spacing[::-1]))))).alias("step")) for o in _N26))

    def steps(a: DataFrame, name: str) -> DataFrame:
        return a.select(*keys, F.col(name), F.explode(offsets).alias("o"), "x", "y", "z").select(*keys, name, "o.step", *((F.col(k) + F.col(f"o.d{k}")).alias(k) for k in "xyz"))

    sizes = slabs.groupBy(*keys, "branch").agg(F.count(F.lit(1)).alias("slabs"))
    inner = steps(slabs, "branch").join(slabs.withColumnRenamed("branch", "other"), [*keys, "x", "y", "z"]).groupBy(*keys, "branch").agg((F.sum("step") / 2).alias("inner"))
    outer = steps(slabs, "branch").join(at, [*keys, "x", "y", "z"]).groupBy(*keys, "branch", "vertex").agg(F.min("step").alias("step"), F.count(F.lit(1)).alias("meets"))
    outer = outer.groupBy(*keys, "branch").agg(F.sort_array(F.collect_list("vertex")).alias("v"), F.sum("step").alias("outer"))
    through = sizes.join(inner, [*keys, "branch"], "left").join(outer, [*keys, "branch"], "left")
    through = through.select(*keys, F.get("v", F.lit(0)).alias("v1"), F.coalesce(F.get("v", F.lit(1)), F.get("v", F.lit(0))).alias("v2"), (F.coalesce("inner", F.lit(0.0)) + F.coalesce("outer", F.lit(0.0))).alias("length"), "slabs", "branch")
    direct = steps(at, "vertex").join(at.withColumnRenamed("vertex", "other").drop("kind"), [*keys, "x", "y", "z"]).where("vertex < other").groupBy(*keys, F.col("vertex").alias("v1"), F.col("other").alias("v2")).agg(F.min("step").alias("length"))
    return vertices, through.union(direct.withColumn("slabs", F.lit(0).cast("bigint")).withColumn("branch", F.lit(None).cast("bigint")))


def summary(vertices: DataFrame, branches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, skeleton (its least vertex) and, of each skeleton: branches, junctions, end points, junction and slab voxels, mean and longest
    branch, triple and quadruple points."""
    by = [*keys, "skeleton"]
    own = trees(vertices, branches, keys)
    degree = branches.select(*keys, F.explode(F.array("v1", "v2")).alias("vertex")).groupBy(*keys, "vertex").agg(F.count(F.lit(1)).alias("degree"))
    joint = F.col("kind") == "junction"
    v = own.join(degree, [*keys, "vertex"], "left").groupBy(*by).agg(F.count_if(joint).alias("junctions"), F.count_if(F.col("kind") == "end").alias("end_points"), F.coalesce(F.sum(F.when(joint, F.col("voxels"))), F.lit(0)).alias("junction_voxels"), F.count_if(joint & (F.col("degree") == 3)).alias("triple_points"), F.count_if(joint & (F.col("degree") == 4)).alias("quadruple_points"))
    b = branches.join(own.select(*keys, F.col("vertex").alias("v1"), "skeleton"), [*keys, "v1"])
    b = b.groupBy(*by).agg(F.count(F.lit(1)).alias("branches"), F.sum("slabs").alias("slab_voxels"), F.avg("length").alias("mean_length"), F.max("length").alias("max_length"))
    out = v.join(b, by, "left")
    return out.withColumns({k: F.coalesce(k, F.lit(0)) for k in ("branches", "slab_voxels")})


def ranked_branches(vertices: DataFrame, branches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, skeleton, branch (from 1, the longest of a skeleton first), length, the places of its two vertices and their distance."""
    own = trees(vertices, branches, keys)
    out = branches.select(*keys, "v1", "v2", "length")
    for v in ("v1", "v2"):
        at = own.select(*keys, F.col("vertex").alias(v), *(F.col(k).alias(f"{v}_{k}") for k in "xyz"), *(["skeleton"] if v == "v1" else []))
        out = out.join(at, [*keys, v])
    apart = F.sqrt(sum((F.col(f"v1_{k}") - F.col(f"v2_{k}")) * (F.col(f"v1_{k}") - F.col(f"v2_{k}")) for k in "xyz"))
    n = F.row_number().over(Window.partitionBy(*keys, "skeleton").orderBy(F.col("length").desc(), "v1", "v2"))
    return out.select(*keys, "skeleton", n.alias("branch"), "length", *(f"{v}_{k}" for v in ("v1", "v2") for k in "xyz"), apart.alias("distance"))


def per_particle(labels: DataFrame, keys: list[str], spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """keys, label and, of each particle's skeleton: branches and their length in all."""
    by = [*keys, "particle_"]
    thin_ = skeletonise(labels, keys).join(labels.select(*keys, F.col("label").alias("particle_"), "x", "y", "z"), [*keys, "x", "y", "z"])  # particles don't touch
    _, branches = graph(written(thin_, "skeletons"), by, spacing)
    found = branches.groupBy(*by).agg(F.count(F.lit(1)).alias("branches"), F.sum("length").alias("branch_length"))
    every = labels.select(*keys, "label").distinct().withColumnRenamed("label", "particle_").join(found, by, "left")
    return every.select(*keys, F.col("particle_").alias("label"), F.coalesce("branches", F.lit(0)).alias("branches"), F.coalesce("branch_length", F.lit(0.0)).alias("branch_length"))


def seeds(skeleton: DataFrame) -> DataFrame:
    """The voxels of a skeleton as seeds of ellipsoids, (x, y, z)."""
    return skeleton.select(*(F.col(k).cast("double").alias(k) for k in "xyz"))


def largest_graph(vertices: DataFrame, branches: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The vertices and branches of the skeleton of most vertices of each subspace; of equal ones, the one with the least vertex."""
    own = trees(vertices, branches, keys)
    counts = own.groupBy(*keys, "skeleton").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("skeleton")).alias("low"))).alias("m")).select(*keys, (-F.col("m.low")).alias("skeleton"))
    kept = own.join(most, [*keys, "skeleton"], "left_semi")
    return kept.drop("skeleton"), branches.join(kept.select(*keys, F.col("vertex").alias("v1")), [*keys, "v1"], "left_semi")


def junction_angles(vertices: DataFrame, branches: DataFrame, keys: list[str], least_valence: int = 3, most_valence: int = 3, least_length: float = 0.0) -> DataFrame:
    """keys, vertex, valence and the angle (radians) of each pair of branches at a junction, from the vertices at their far ends."""
    kept = branches.where((F.col("length") >= least_length) & (F.col("v1") != F.col("v2"))).dropDuplicates([*keys, "v1", "v2"])
    arms = kept.select(*keys, F.col("v1").alias("vertex"), F.col("v2").alias("far")).union(kept.select(*keys, "v2", "v1"))
    place = vertices.select(*keys, "vertex", "x", "y", "z")
    arms = arms.join(place, [*keys, "vertex"]).join(place.select(*keys, F.col("vertex").alias("far"), *(F.col(k).alias(f"f{k}") for k in "xyz")), [*keys, "far"])
    arms = arms.select(*keys, "vertex", "far", *((F.col(f"f{k}") - F.col(k)).alias(f"d{k}") for k in "xyz"))
    valence = arms.groupBy(*keys, "vertex").agg(F.count(F.lit(1)).alias("valence")).where(F.col("valence").between(least_valence, most_valence))
    a = arms.join(valence, [*keys, "vertex"])
    b = arms.select(*keys, "vertex", F.col("far").alias("far2"), *(F.col(f"d{k}").alias(f"e{k}") for k in "xyz"))
    pairs = a.join(b, [*keys, "vertex"]).where("far < far2")
    norm = [F.sqrt(sum(F.col(f"{p}{k}") * F.col(f"{p}{k}") for k in "xyz")) for p in "de"]
    cosine = sum(F.col(f"d{k}") * F.col(f"e{k}") for k in "xyz") / (norm[0] * norm[1])
    return pairs.select(*keys, "vertex", "valence", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))).alias("angle"))


def trees(vertices: DataFrame, branches: DataFrame, keys: list[str]) -> DataFrame:
    """vertices with skeleton: the least vertex of what branches connect."""
    roots = stars(branches.select(*keys, F.col("v1").alias("u"), F.col("v2").alias("v")), keys)
    return vertices.join(roots.withColumnRenamed("node", "vertex"), [*keys, "vertex"], "left").withColumn("skeleton", F.coalesce("root", "vertex")).drop("root")


def longest_shortest_paths(vertices: DataFrame, branches: DataFrame, keys: list[str], whole: int = paths.WHOLE) -> DataFrame:
    """keys, skeleton, length and the two ends of the longest of the shortest paths of each skeleton; those of more than so many branches
    are worked out in rounds over all tasks."""
    own = trees(vertices, branches, keys).select(*keys, F.col("vertex").alias("v1"), "skeleton")
    return paths.longest(branches.join(own, [*keys, "v1"]), [*keys, "skeleton"], whole)


def prune(vertices: DataFrame, branches: DataFrame, keys: list[str], least_length: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, branches, culled): vertices that short branches connect become one, at their centroid; loops, repeated branches and
    dead ends go. culled has the percentages of branches that went: loop, repeated, short, dead_end."""
    inner = vertices.where("kind = 'junction'").select(*keys, "vertex")
    short = branches.where((F.col("length") < least_length) & (F.col("v1") != F.col("v2")))
    both = short.join(inner.withColumnRenamed("vertex", "v1"), [*keys, "v1"]).join(inner.withColumnRenamed("vertex", "v2"), [*keys, "v2"])
    roots = stars(both.select(*keys, F.col("v1").alias("u"), F.col("v2").alias("v")), keys)
    moved = vertices.join(roots.withColumnRenamed("node", "vertex"), [*keys, "vertex"], "left").withColumn("vertex", F.coalesce("root", "vertex"))
    merged_ = moved.groupBy(*keys, "vertex").agg(F.max("kind").alias("kind"), F.sum("voxels").alias("voxels"), *(F.avg(k).alias(k) for k in "xyz"))
    out = branches
    for v in ("v1", "v2"):
        out = out.join(roots.select(*keys, F.col("node").alias(v), F.col("root").alias("root_")), [*keys, v], "left").withColumn(v, F.coalesce("root_", v)).drop("root_")
    out = out.withColumns({"a_": F.least("v1", "v2"), "b_": F.greatest("v1", "v2")})
    ends = vertices.where("kind = 'end'").select(*keys, F.col("vertex").alias("e_"))
    dead = out.join(ends.withColumnRenamed("e_", "a_"), [*keys, "a_"], "left_semi").unionByName(out.join(ends.withColumnRenamed("e_", "b_"), [*keys, "b_"], "left_semi"))
    dead = dead.select(*keys, "a_", "b_").distinct()
    kind = F.when(F.col("a_") == F.col("b_"), F.when(F.col("length") < least_length, "short").otherwise("loop"))
    marked = out.withColumn("why", kind).join(dead.withColumn("dead_", F.lit(True)), [*keys, "a_", "b_"], "left").withColumn("why", F.coalesce("why", F.when(F.col("dead_"), "dead_end")))
    n = F.row_number().over(Window.partitionBy(*keys, "a_", "b_").orderBy("length"))
    marked = marked.withColumn("why", F.coalesce("why", F.when(n > 1, "repeated")))
    total = F.count(F.lit(1))
    culled = marked.groupBy(*keys).agg(*((F.count_if(F.col("why") == k) * 100.0 / total).alias(k) for k in ("loop", "repeated", "short", "dead_end")))
    return merged_, marked.where("why is null").select(*keys, F.col("a_").alias("v1"), F.col("b_").alias("v2"), "length", "slabs"), culled
