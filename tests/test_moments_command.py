"""Moments of images as the command asks for them: thresholds, calibrations and slices."""

from __future__ import annotations

import numpy as np
import pytest

from lamella.model import InvalidImage
from lamella.operators import commands

SHAPE = (5, 4, 6)


def image(spark, channels: int = 2):
    rng = np.random.default_rng(8)
    rows = [(c, x, y, z, int(rng.integers(0, 200))) for c in range(channels) for x in range(5) for y in range(4) for z in range(6)]
    return spark.createDataFrame(rows, "c int, x int, y int, z int, value int"), rows


def expected(rows, first, last, low, high, density, spacing):
    kept = [(np.array([x, y, z]) * spacing, density(v)) for _, x, y, z, v in rows if first - 1 <= z <= last - 1 and low <= v <= high]
    size = float(np.prod(spacing))
    m = np.array([w for _, w in kept]) * size
    p = np.array([at for at, _ in kept])
    centre = (p * m[:, None]).sum(axis=0) / m.sum()
    q, tensor = p - centre, np.zeros((3, 3))
    for i in range(3):
        others = [k for k in range(3) if k != i]
        tensor[i, i] = (m * ((q[:, others] ** 2).sum(axis=1) + sum(spacing[k] ** 2 for k in others) / 12)).sum()
        for j in others:
            tensor[i, j] = -(m * q[:, i] * q[:, j]).sum()
    return len(kept) * size, m.sum(), centre + [0, 0, spacing[2]], tensor


@pytest.mark.parametrize("hounsfield", [None, (2.0, -100.0)])
def test_moments_between_thresholds_are_those_of_brute_force(spark, hounsfield):
    df, rows = image(spark)
    spacing, (low, high) = (0.5, 1.0, 1.5), (40, 150)
    told = (low, high) if hounsfield is None else (low * 2 - 100, high * 2 - 100)
    found = {r["c"]: r for r in commands.image_moments(df, ["c"], SHAPE, spacing, 2, 5, *told, hounsfield, 0.5, -30.0).collect()}
    for c in (0, 1):
        volume, mass, centre, tensor = expected([r for r in rows if r[0] == c], 2, 5, low, high, lambda v: max(0.0, (0.5 * v - 30) / 1000), np.array(spacing))
        r = found[c]
        assert (r.volume, r.mass, r.low, r.high) == pytest.approx((volume, mass, low, high))
        assert [r.cx, r.cy, r.cz] == pytest.approx(centre)
        assert [r.ixx, r.iyy, r.izz, r.ixy, r.ixz, r.iyz] == pytest.approx([tensor[0, 0], tensor[1, 1], tensor[2, 2], tensor[0, 1], tensor[0, 2], tensor[1, 2]], abs=1e-9)
        assert [r.i1, r.i2, r.i3] == pytest.approx(sorted(np.linalg.eigvalsh(tensor), reverse=True))


def test_default_thresholds_nulls_and_wrong_calibrations(spark):
    df, _ = image(spark, 1)
    held = commands.thresholds_of(df, ["c"], None, None).first()
    assert 60 < held.low < 140 and held.high == df.agg({"value": "max"}).first()[0]
    assert tuple(commands.thresholds_of(df, ["c"], None, 900, (2.0, -100.0)).first())[1:] == (50.0, 500.0)
    odd = df.unionByName(spark.createDataFrame([(0, 1, 1, 1, None)], df.schema))
    same = ["volume", "mass", "cx", "ixx"]
    a, b = (commands.image_moments(t, ["c"], SHAPE, low=10).select(*same).first() for t in (df, odd))
    assert tuple(a) == pytest.approx(tuple(b))
    assert commands.image_moments(df.limit(0), ["c"], SHAPE, low=1, high=2).isEmpty()
    for wrong in ({"first": 3, "last": 2}, {"last": 7}, {"low": 1, "high": 2, "hounsfield": (0.0, 1.0)}):
        with pytest.raises(InvalidImage):
            commands.image_moments(df, ["c"], SHAPE, **wrong)
