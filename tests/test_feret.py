"""Feret diameters against brute force, in one cell and in many."""

from __future__ import annotations

import numpy as np
import pytest

from lamella.operators import particles


@pytest.mark.parametrize("cell_points", [2, 512])
def test_feret_against_brute_force(spark, monkeypatch, cell_points):
    monkeypatch.setattr(particles, "CELL_POINTS", cell_points)
    rng = np.random.default_rng(3)
    n = np.stack(np.mgrid[:15, :15, :15], axis=-1).reshape(-1, 3)
    sets = {0: rng.integers(0, 9, (40, 3)), 1: n[((n - 7) ** 2).sum(axis=1) <= 49], 2: np.array([[1, 2, 3]]), 3: np.array([[1, 2, 3], [1, 2, 3], [4, 2, 3]]), 4: rng.integers(0, 200, (300, 3)), 5: np.array([[i, 0, 0] for i in range(50)])}
    df = spark.createDataFrame([(c, *map(float, p)) for c, v in sets.items() for p in v], "c int, x double, y double, z double")
    found = {r["c"]: r for r in particles.feret(df, ["c"]).collect()}
    assert found.keys() == {0, 1, 3, 4, 5}
    for c, r in found.items():
        v = sets[c].astype(float)
        d = np.linalg.norm(v[:, None] - v[None], axis=2)
        assert r["feret"] == pytest.approx(d.max())
        a, b = np.array([r["xa"], r["ya"], r["za"]]), np.array([r["xb"], r["yb"], r["zb"]])
        assert np.linalg.norm(a - b) == pytest.approx(d.max()) and (v == a).all(axis=1).any() and (v == b).all(axis=1).any()
