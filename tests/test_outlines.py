"""Traced outlines: order, holes and corners against plain tracing."""

from __future__ import annotations

import numpy as np
import pytest

from lamella.operators import outlines


def frame(spark, *slices):
    return spark.createDataFrame([(z, int(x), int(y)) for z, v in enumerate(slices) for y, x in np.argwhere(v)], "z int, x int, y int")


def components(v, corners):
    left, n = {tuple(p) for p in np.argwhere(v)}, 0
    while left:
        n, stack = n + 1, [left.pop()]
        while stack:
            y, x = stack.pop()
            near = {(y + j, x + i) for j in (-1, 0, 1) for i in (-1, 0, 1) if (corners or i * j == 0)} & left
            left -= near
            stack += near
    return n


@pytest.mark.parametrize("connectivity", [8, 4])
def test_contours_are_components_and_holes(spark, connectivity):
    rng = np.random.default_rng(7)
    ring = np.ones((5, 6), dtype=bool)
    ring[1:4, 1:5] = False
    ring[2, 2] = True
    slices = [ring, np.eye(3, dtype=bool), *(rng.random((9, 11)) < p for p in (0.2, 0.5, 0.8))]
    traced = outlines.contours(frame(spark, *slices), ["z"], connectivity)
    rows = traced.collect()
    found = outlines.measured(traced, ["z"], (0.5, 2.0)).collect()
    for z, v in enumerate(slices):
        own = [r for r in found if r["z"] == z]
        back = np.pad(~v, 1, constant_values=True)
        assert sum(not r["hole"] for r in own) == components(v, connectivity == 8)
        assert sum(r["hole"] for r in own) == components(back, connectivity == 4) - 1
        assert sum(r["area"] for r in own) == pytest.approx(v.sum())
        w = np.pad(v, 1).astype(int)
        assert sum(r["perimeter"] for r in own) == pytest.approx(0.5 * np.abs(np.diff(w, axis=0)).sum() + 2 * np.abs(np.diff(w, axis=1)).sum())
        for c in own:
            line = sorted((r["rank"], r["x"], r["y"], r["ex"], r["ey"]) for r in rows if r["z"] == z and r["contour"] == c["contour"])
            assert [r[0] for r in line] == list(range(c["edges"]))
            assert all(a[3:] == b[1:3] for a, b in zip(line, [*line[1:], line[0]]))  # each edge ends where the next begins


def test_a_long_outline_takes_few_rounds(spark, monkeypatch):
    comb = np.zeros((40, 60), dtype=bool)
    comb[0] = True
    comb[:, ::2] = True
    calls = []
    monkeypatch.setattr(outlines, "written", lambda df, name, own=outlines.written: calls.append(name) or own(df, name))
    traced = outlines.contours(frame(spark, comb), ["z"])
    found = outlines.measured(traced, ["z"]).collect()
    assert len(found) == 1 and found[0]["edges"] > 2000 and calls.count("doubled") <= 14 and calls.count("ranked") <= 14
