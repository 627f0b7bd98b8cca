"""Pruning of graphs and skeletons against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import pruning, skeleton
from lamella.storage import written


def random_graphs(n, seed):
    """(c, v1, v2, length) with repeated branches and loops, lengths with ties."""
    rng = random.Random(seed)
    return [(c, rng.randint(0, 7), rng.randint(0, 7), float(rng.randint(1, 5))) for c in range(n) for _ in range(rng.randint(1, 14))]


def kept_by_kruskal(rows):
    parent, kept = {}, []

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for row in sorted(rows, key=lambda r: (-r[3], min(r[1:3]), max(r[1:3]))):
        a, b = root(row[1]), root(row[2])
        if a != b:
            parent[a] = b
            kept.append((min(row[1:3]), max(row[1:3]), row[3]))
    return sorted(kept)


def test_forests_are_kruskals(spark):
    rows = random_graphs(60, 1)
    found = pruning.spanning_forest(spark.createDataFrame(rows, "c int, v1 bigint, v2 bigint, length double"), ["c"], [F.col("length")]).collect()
    for c in range(60):
        assert sorted((min(r["v1"], r["v2"]), max(r["v1"], r["v2"]), r["length"]) for r in found if r["c"] == c) == kept_by_kruskal([r for r in rows if r[0] == c])


def square():
    """A square with a diagonal and a tail: (z, y, x), a slice."""
    v = np.zeros((1, 24, 24), dtype=bool)
    v[0, 2, 2:21] = v[0, 20, 2:21] = v[0, 2:21, 2] = v[0, 2:21, 20] = True
    v[0, 11, 2:21] = True
    v[0, 11, 20:24] = True
    return skeleton.thin(v)


def frame(spark, v):
    return spark.createDataFrame([(0, int(x), int(y), int(z)) for z, y, x in np.argwhere(v)], "c int, x int, y int, z int")


def cycles(spark, points):
    vertices, branches = skeleton.graph(points, ["c"])
    v, b = vertices.count(), branches.count()
    return b - v + skeleton.trees(written(vertices, "v"), written(branches, "b"), ["c"]).select("skeleton").distinct().count()


@pytest.mark.parametrize("method", pruning.METHODS)
def test_cycles_of_a_skeleton_are_cut_at_the_weakest(spark, method):
    v = square()
    points = frame(spark, v)
    assert cycles(spark, points) == 2
    value = np.where(v, 100, 0)
    value[0, 20, 8:12] = 40  # the lower side is darkest in the mean
    value[0, 11, 10] = 5  # and the middle has the darkest voxel
    value[0, 2, 5:18] = 80
    image = spark.createDataFrame([(0, int(x), int(y), int(z), int(value[z, y, x])) for z, y, x in np.argwhere(v)], "c int, x int, y int, z int, value int")
    left = written(pruning.prune_cycles(points, ["c"], method, image), "left")
    assert cycles(spark, left) == 0
    gone = {(r["x"], r["y"]) for r in points.exceptAll(left).collect()}
    if method == "shortest_branch":
        assert (10, 11) in gone
    elif method == "lowest_voxel":
        assert (10, 11) in gone and (9, 20) in gone
    else:
        assert (9, 20) in gone and (10, 2) in gone and (10, 11) not in gone


def test_a_ring_without_vertices_is_opened(spark):
    ring = [(5, 1), (6, 2), (7, 3), (8, 4), (9, 5), (8, 6), (7, 7), (6, 8), (5, 9), (4, 8), (3, 7), (2, 6), (1, 5), (2, 4), (3, 3), (4, 2)]
    points = spark.createDataFrame([(0, x, y, 0) for x, y in ring], "c int, x int, y int, z int")
    left = pruning.prune_cycles(points, ["c"])
    assert left.count() == len(ring) - 1 and {r["kind"] for r in skeleton.classified(left, ["c"]).collect()} == {"end", "slab"}


def test_dead_ends_go_and_tags(spark):
    points = frame(spark, square())
    left = pruning.prune_ends(points, ["c"])
    assert {(r["x"], r["y"]) for r in points.exceptAll(left).collect()} >= {(22, 11), (23, 11)} and left.count() > 80
    line = spark.createDataFrame([(0, x, 0, 0) for x in range(5)], "c int, x int, y int, z int")
    assert pruning.prune_ends(line, ["c"]).count() == 5
    assert sorted((r["x"], r["tag"]) for r in pruning.tagged(line, ["c"]).collect()) == [(0, 30), (1, 127), (2, 127), (3, 127), (4, 30)]


def brute_contraction(vertices, branches, least, iterate, clusters):
    vertices, edges = dict(vertices), dict(branches)  # v: (kind, voxels, place); (a, b): length
    while True:
        short = {e: w for e, w in edges.items() if w < least and all(vertices[v][0] == "junction" for v in e)}
        if not short:
            return vertices, edges
        if not clusters:
            order = lambda e: (short[e], *e)
            short = {e: w for e, w in short.items() if all(order(e) <= order(f) for f in short if set(e) & set(f))}
        groups = {v: v for v in vertices}
        for _ in vertices:
            for a, b in short:
                groups[a] = groups[b] = min(groups[a], groups[b])
        merged, moved = {}, {groups[v] for e in short for v in e}
        for g in set(groups.values()):
            own = [vertices[v] for v in groups if groups[v] == g]
            n = sum(o[1] for o in own)
            merged[g] = (max(o[0] for o in own), n, tuple(sum(o[1] * o[2][k] for o in own) / n for k in range(3)))
        after = {}
        for (a, b), w in edges.items():
            e = tuple(sorted((groups[a], groups[b])))
            if e[0] != e[1]:
                after[e] = min(after.get(e, w), w)
        vertices = merged
        edges = {e: float(np.linalg.norm(np.subtract(vertices[e[0]][2], vertices[e[1]][2]))) if set(e) & moved else w for e, w in after.items()}
        if not iterate:
            return vertices, edges


@pytest.mark.parametrize(("iterate", "clusters"), [(False, False), (True, False), (True, True), (False, True)])
def test_contraction_against_brute_force(spark, iterate, clusters):
    rng = random.Random(9)
    graphs, rows, nodes = {}, [], []
    for c in range(12):
        places = {v: (rng.choice(["junction", "junction", "end"]), rng.randint(1, 4), tuple(rng.uniform(0, 4) for _ in range(3))) for v in range(9)}
        edges = {tuple(sorted(rng.sample(range(9), 2))): rng.uniform(0.5, 5) for _ in range(13)}
        used = {v for e in edges for v in e}
        graphs[c] = ({v: p for v, p in places.items() if v in used}, edges)
        rows += [(c, a, b, w) for (a, b), w in edges.items()]
        nodes += [(c, v, k, n, *p) for v, (k, n, p) in graphs[c][0].items()]
    vertices = spark.createDataFrame(nodes, "c int, vertex bigint, kind string, voxels bigint, x double, y double, z double")
    branches = spark.createDataFrame(rows, "c int, v1 bigint, v2 bigint, length double")
    found_v, found_b = (t.collect() for t in pruning.contract(vertices, branches, ["c"], 2.0, iterate, clusters))
    for c, (v, b) in graphs.items():
        expected_v, expected_b = brute_contraction(v, b, 2.0, iterate, clusters)
        assert {r["vertex"]: (r["kind"], r["voxels"]) for r in found_v if r["c"] == c} == {k: x[:2] for k, x in expected_v.items()}
        own = {(r["v1"], r["v2"]): r["length"] for r in found_b if r["c"] == c}
        assert own.keys() == expected_b.keys() and all(abs(own[e] - expected_b[e]) < 1e-9 for e in own)
