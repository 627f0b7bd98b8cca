"""Pruning of skeletons: cycles, dead ends, and contraction of short branches to a fixed point.

Cycles are broken by spanning forests: in rounds (Borůvka's) each component of a skeleton takes the strongest branch that leads out of
it, what they join becomes one component, and of branches between two components the strongest stays. A branch that no round takes is the
weakest of a cycle, and goes. What makes a branch strong is its length, or the intensity of an image under it: the mean of its
voxels, or the least of them. Rounds are joins, grouped maxima and star rounds over written tables, and halve the components.

Contraction merges the ends of short branches between junctions: of clusters of such branches at once, or of a matching of those that
are the shortest at both their ends. Iterated, it goes on, with lengths measured anew between vertices that have moved, until no
branch between junctions is short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators import skeleton as sk
from lamella.operators.components import stars
from lamella.storage import discard, written

METHODS = ("shortest_branch", "lowest_voxel", "lowest_branch")
#: Values of a tagged image.
TAGS = {"end": 30, "junction": 70, "slab": 127}
PATH_TAG = 96


def _with_ends(edges: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """edges with u and v replaced by the names (keys, node, root) of their nodes."""
    out = edges
    for k in ("u", "v"):
        own = names.select(*keys, F.col("node").alias(k), F.col("root").alias("root_"))
        out = out.join(own, [*keys, k], "left").withColumn(k, F.coalesce("root_", k)).drop("root_")
    return out


def spanning_forest(branches: DataFrame, keys: list[str], strength: list[Column]) -> DataFrame:
    """The branches of the strongest spanning forest of each skeleton, as they are. strength: columns that order branches, the first
    first; equal ones are in order of their vertices, from the greatest, and any two of one order are told apart by number."""
    own = written(branches.withColumn("number_", F.monotonically_increasing_id()), "numbered")
    order = F.struct(*(s.alias(f"s{i}") for i, s in enumerate(strength)), (-F.least("v1", "v2")).alias("a"), (-F.greatest("v1", "v2")).alias("b"), (-F.col("number_")).alias("n"))
    edges = written(own.where("v1 <> v2").select(*keys, F.col("v1").alias("u"), F.col("v2").alias("v"), order.alias("o")), "forest")
    taken: list[DataFrame] = []
    while not edges.isEmpty():
        best = edges.select(*keys, F.col("u").alias("w"), "u", "v", "o").union(edges.select(*keys, F.col("v"), "u", "v", "o"))
        best = written(best.groupBy(*keys, "w").agg(F.max_by(F.struct("u", "v"), "o").alias("e"), F.max("o").alias("o")).select(*keys, "e.u", "e.v", "o").distinct(), "strongest")
        taken.append(best.select(F.col("o.n").alias("n")))
        roots = stars(best.select(*keys, "u", "v"), keys)
        left = _with_ends(edges, roots, keys).where("u <> v").groupBy(*keys, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("o").alias("o"))
        left = written(left, "forest")
        discard(edges)
        edges = left
    if not taken:
        return own.drop("number_").limit(0)
    every = taken[0]
    for t in taken[1:]:
        every = every.union(t)
    return own.join(every.select((-F.col("n")).alias("number_")), "number_", "left_semi").select(*branches.columns)


def cycle_branches(branches: DataFrame, keys: list[str], strength: list[Column]) -> DataFrame:
    """The branches that close cycles: loops, and the weakest of each cycle. branches have a row each that no other equals."""
    kept = spanning_forest(branches, keys, strength).select(*keys, "v1", "v2", *(c for c in branches.columns if c not in (*keys, "v1", "v2")))
    return branches.exceptAll(kept.select(*branches.columns))


def intensities(slabs: DataFrame, image: DataFrame, keys: list[str]) -> DataFrame:
    """keys, branch, mean and least value of the image (keys, x, y, z, value) under each branch; positions that it lacks are 0."""
    met = slabs.join(image.select(*keys, "x", "y", "z", F.col("value").cast("double").alias("value_")), [*keys, "x", "y", "z"], "left")
    value = F.coalesce("value_", F.lit(0.0))
    return met.groupBy(*keys, "branch").agg(F.avg(value).alias("mean"), F.min(value).alias("least"))


def prune_cycles(skeleton: DataFrame, keys: list[str], method: str = "shortest_branch", image: DataFrame | None = None, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """The skeleton's voxels without those of branches that close cycles. Steps between two vertices have no voxels to take, so they
    are the strongest; a ring without a vertex loses its least voxel."""
    if method not in METHODS:
        raise ValueError(f"the method is one of {METHODS}")
    if (method != "shortest_branch") and image is None:
        raise ValueError("an intensity image is needed")
    at, slabs = (written(t, "elements") for t in sk.elements(skeleton, keys))
    _, branches = sk.graph_of(at, slabs, keys, spacing)
    if method != "shortest_branch":
        branches = branches.join(intensities(slabs, image, keys), [*keys, "branch"], "left")
    value = {"shortest_branch": "length", "lowest_voxel": "least", "lowest_branch": "mean"}[method]
    branches = written(branches, "branches")
    ring = branches.where("v1 is null").select(*keys, "branch")
    open_ = branches.where("v1 is not null")
    forest = spanning_forest(open_, keys, [F.col("branch").isNull().cast("int"), F.coalesce(F.col(value), F.lit(0.0)), -F.coalesce("branch", F.lit(0))])
    gone = open_.where("branch is not null").select(*keys, "branch").join(forest.where("branch is not null").select(*keys, "branch"), [*keys, "branch"], "left_anti")
    kept = slabs.join(gone, [*keys, "branch"], "left_anti")
    first = sk.linear(F.col("x"), F.col("y"), F.col("z")) == F.col("branch")  # a branch's number is its least position
    cut = kept.join(ring, [*keys, "branch"], "left_semi").where(first).select(*keys, "x", "y", "z")
    kept = kept.select(*keys, "x", "y", "z").join(cut, [*keys, "x", "y", "z"], "left_anti")
    return at.select(*keys, "x", "y", "z").union(kept)


def prune_ends(skeleton: DataFrame, keys: list[str]) -> DataFrame:
    """The skeleton's voxels without dead ends: end voxels, and the branches from them, that lead to a junction. Skeletons without
    a junction stay."""
    at, slabs = (written(t, "elements") for t in sk.elements(skeleton, keys))
    vertices, branches = sk.graph_of(at, slabs, keys)
    branches = written(branches.where("v1 is not null"), "branches")
    kinds = vertices.select(*keys, "vertex", "kind")
    both = branches
    for v in ("v1", "v2"):
        both = both.join(kinds.select(*keys, F.col("vertex").alias(v), F.col("kind").alias(f"{v}_kind")), [*keys, v])
    dead = written(both.where("v1_kind <> v2_kind"), "dead")
    ends = dead.select(*keys, F.when(F.col("v1_kind") == "end", F.col("v1")).otherwise(F.col("v2")).alias("vertex"))
    kept = at.join(ends, [*keys, "vertex"], "left_anti").select(*keys, "x", "y", "z")
    return kept.union(slabs.join(dead.where("branch is not null").select(*keys, "branch"), [*keys, "branch"], "left_anti").select(*keys, "x", "y", "z"))


def tagged(skeleton: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y, z, tag: 30 for end voxels, 70 for junction voxels, 127 for slab voxels."""
    kind = F.col("kind")
    return sk.classified(skeleton, keys).select(*keys, "x", "y", "z", F.when(kind == "end", TAGS["end"]).when(kind == "junction", TAGS["junction"]).otherwise(TAGS["slab"]).alias("tag"))


# ---- contraction


def _measured(vertices: DataFrame, branches: DataFrame, keys: list[str], moved: DataFrame) -> DataFrame:
    """branches with lengths anew, as straight lines, where one of their vertices has moved (keys, vertex)."""
    out = branches
    for v in ("v1", "v2"):
        out = out.join(vertices.select(*keys, F.col("vertex").alias(v), *(F.col(k).alias(f"{v}_{k}") for k in "xyz")), [*keys, v])
        out = out.join(moved.select(*keys, F.col("vertex").alias(v), F.lit(1).alias(f"{v}_moved")), [*keys, v], "left")
    apart = F.sqrt(sum((F.col(f"v1_{k}") - F.col(f"v2_{k}")) * (F.col(f"v1_{k}") - F.col(f"v2_{k}")) for k in "xyz"))
    length = F.when(F.col("v1_moved").isNotNull() | F.col("v2_moved").isNotNull(), apart).otherwise(F.col("length"))
    return out.withColumn("length", length).select(*branches.columns)


def short_branches(vertices: DataFrame, branches: DataFrame, keys: list[str], least_length: float) -> DataFrame:
    """The branches shorter than least_length between two junctions."""
    inner = vertices.where("kind = 'junction'").select(*keys, "vertex")
    out = branches.where((F.col("length") < least_length) & (F.col("v1") != F.col("v2")))
    for v in ("v1", "v2"):
        out = out.join(inner.withColumnRenamed("vertex", v), [*keys, v], "left_semi")
    return out


def matching(short: DataFrame, keys: list[str]) -> DataFrame:
    """Of short branches those that are the shortest at both their ends; equal lengths are in order of their vertices."""
    order = F.struct("length", F.least("v1", "v2").alias("a"), F.greatest("v1", "v2").alias("b"))
    one = short.groupBy(*keys, F.least("v1", "v2").alias("v1"), F.greatest("v1", "v2").alias("v2")).agg(F.min("length").alias("length"))
    both = one.select(*keys, F.col("v1").alias("w"), order.alias("o")).union(one.select(*keys, "v2", order))
    least = both.groupBy(*keys, "w").agg(F.min("o").alias("o"))
    out = one.withColumn("o", order)
    for v in ("v1", "v2"):
        out = out.join(least.select(*keys, F.col("w").alias(v), F.col("o").alias(f"o{v}")), [*keys, v])
    return out.where("o = ov1 and o = ov2").select(*keys, "v1", "v2", "length")


def contract(vertices: DataFrame, branches: DataFrame, keys: list[str], least_length: float, iterate: bool = False, clusters: bool = False, before: Callable[[int], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, branches): the ends of short branches between junctions merged at the centroid of their voxels; loops go, and of
    repeated branches the shortest stays. before(n) is called before each pass."""
    columns = [*keys, "v1", "v2", "length"]
    now = written(branches.select(*columns), "branches")
    own = written(vertices.select(*keys, "vertex", "kind", "voxels", "x", "y", "z"), "vertices")
    passes = 0
    while True:
        short = short_branches(own, now, keys, least_length)
        if short.isEmpty():
            return own, now
        if before:
            before(passes)
        merge = written(short.select(*keys, "v1", "v2", "length") if clusters else matching(short, keys), "merged")
        roots = stars(merge.select(*keys, F.col("v1").alias("u"), F.col("v2").alias("v")), keys)
        named = own.join(roots.withColumnRenamed("node", "vertex"), [*keys, "vertex"], "left").withColumn("vertex", F.coalesce("root", "vertex"))
        weight = F.sum("voxels")
        merged = named.groupBy(*keys, "vertex").agg(F.max("kind").alias("kind"), weight.alias("voxels"), *((F.sum(F.col(k) * F.col("voxels")) / weight).alias(k) for k in "xyz"))
        merged = written(merged, "vertices")
        edges = _with_ends(now.withColumnsRenamed({"v1": "u", "v2": "v"}), roots, keys).where("u <> v")
        edges = edges.groupBy(*keys, F.least("u", "v").alias("v1"), F.greatest("u", "v").alias("v2")).agg(F.min("length").alias("length"))
        moved = roots.select(*keys, F.col("root").alias("vertex")).distinct()
        after = written(_measured(merged, edges, keys, moved).select(*columns), "branches")
        discard(now, own, merge)
        own, now, passes = merged, after, passes + 1
        if not iterate:
            return own, now


def valences(branches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, vertex, valence."""
    return branches.select(*keys, F.explode(F.array("v1", "v2")).alias("vertex")).groupBy(*keys, "vertex").agg(F.count(F.lit(1)).alias("valence"))


def distinct_branches(branches: DataFrame, keys: list[str]) -> DataFrame:
    """Without loops, and with the shortest of repeated branches alone."""
    one = branches.where("v1 <> v2").withColumns({"a_": F.least("v1", "v2"), "b_": F.greatest("v1", "v2")})
    n = F.row_number().over(Window.partitionBy(*keys, "a_", "b_").orderBy("length"))
    return one.withColumn("n_", n).where("n_ = 1").drop("a_", "b_", "n_")
