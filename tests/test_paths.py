"""Longest shortest paths against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from lamella.operators import paths


def drawn(graphs: int, most: int, seed: int) -> pd.DataFrame:
    """Connected graphs: a random tree each, more branches, loops and repeated branches."""
    rng, rows = np.random.default_rng(seed), []
    for g in range(graphs):
        n = int(rng.integers(2, most))
        rows += [(g, i, int(rng.integers(max(0, i - 8), i)), float(rng.integers(0, 40)) / 4) for i in range(1, n)]
        rows += [(g, int(rng.integers(n)), int(rng.integers(n)), float(rng.random() * 30)) for _ in range(int(rng.integers(0, n)))]
    return pd.DataFrame(rows, columns=["g", "v1", "v2", "length"])


def all_distances(f: pd.DataFrame) -> np.ndarray:
    n = int(f[["v1", "v2"]].to_numpy().max()) + 1
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for a, b, w in f[["v1", "v2", "length"]].itertuples(index=False):
        d[a, b] = d[b, a] = min(d[a, b], w)
    for k in range(n):
        d = np.minimum(d, d[:, k, None] + d[None, k])
    return d


@pytest.mark.parametrize("whole", [paths.WHOLE, 0])
def test_longest_equals_brute_force_on_a_thousand_graphs(spark, whole):
    f = drawn(1000, 16, 5)
    found = {r.g: r for r in paths.longest(spark.createDataFrame(f), ["g"], whole).collect()}
    assert sorted(found) == list(range(1000))
    for g, part in f.groupby("g"):
        d, r = all_distances(part), found[g]
        assert r.length == pytest.approx(d.max(), rel=1e-9)
        assert d[r.start, r.stop] == pytest.approx(d.max(), rel=1e-9) and r.start <= r.stop


def test_few_searches_settle_a_large_tree():
    rng, asked, true = np.random.default_rng(3), [], paths.distances
    n = 5000
    b = np.array([rng.integers(0, i) for i in range(1, n)])
    paths.distances = lambda around, start: asked.append(start) or true(around, start)
    try:
        length, start, stop = paths.longest_of(np.arange(1, n), b, rng.random(n - 1), n)
    finally:
        paths.distances = true
    assert length > 0 and start < stop and len(asked) < 12


def test_loops_alone_zero_lengths_and_no_rows(spark):
    rows = [("a", 7, 7, 3.0), ("b", 4, 9, 0.0), ("b", 9, 12, 0.0), (None, -5, 2**62, 1.5)]
    edges = spark.createDataFrame(rows, "g string, v1 long, v2 long, length double")
    for whole in (paths.WHOLE, 0):
        found = {r.g: (r.length, r.start, r.stop) for r in paths.longest(edges.where("g is not null"), ["g"], whole).collect()}
        assert found == {"a": (0.0, 7, 7), "b": (0.0, 4, 4)}
        one = paths.longest(edges.where("g is null").drop("g").selectExpr("1 as g", "*"), ["g"], whole).first()
        assert (one.length, one.start, one.stop) == (1.5, -5, 2**62)
        assert paths.longest(edges.limit(0), ["g"], whole).isEmpty()
