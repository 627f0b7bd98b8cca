"""Blocks with halos: the ball, ridges and thinning are the same for any blocks, and keep what they must."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from lamella.operators import blocks, distance, skeleton


def frame(spark, *volumes, shift=0):
    """(c, x, y, z) of volumes (z, y, x)."""
    rows = [(c, int(x) + shift, int(y) + shift, int(z) + shift) for c, v in enumerate(volumes) for z, y, x in np.argwhere(v)]
    return spark.createDataFrame(rows, "c int, x int, y int, z int")


def array(df, shape, shift=0):
    out = np.zeros(shape, dtype=bool)
    for r in df.collect():
        out[r["z"] - shift, r["y"] - shift, r["x"] - shift] = True
    return out


def euler(v):
    """Vertices less edges plus faces less cubes."""
    cells = {(2 * z + k, 2 * y + j, 2 * x + i) for z, y, x in np.argwhere(v).tolist() for k, j, i in itertools.product((0, 1, 2), repeat=3)}
    return sum(1 - 2 * (sum(c) % 2) for c in cells)


def shapes():
    n = np.mgrid[:20, :30, :30]
    bar = np.zeros((20, 30, 30), dtype=bool)
    bar[8:13, 10:16, 2:28] = True
    cross = bar.copy()
    cross[8:13, 2:28, 12:17] = True
    torus = (np.sqrt((n[1] - 15) ** 2 + (n[2] - 15) ** 2) - 9) ** 2 + (n[0] - 10) ** 2 <= 10
    rng = np.random.default_rng(0)
    noise = rng.random((20, 30, 30)) < 0.3
    shell = ((n[0] - 10) ** 2 + (n[1] - 15) ** 2 + (n[2] - 15) ** 2 <= 64) & ~((n[0] - 10) ** 2 + (n[1] - 15) ** 2 + (n[2] - 15) ** 2 <= 16)
    return {"bar": bar, "cross": cross, "torus": torus, "noise": noise, "shell": shell}


def parts(places, apart):
    """Sets of places that steps of that many changed axes at most connect."""
    left, out = set(places), []
    while left:
        stack, one = [left.pop()], set()
        while stack:
            p = stack.pop()
            one.add(p)
            near = {q for q in left if max(abs(a - b) for a, b in zip(p, q)) == 1 and sum(a != b for a, b in zip(p, q)) <= apart}
            left -= near
            stack += near
        out.append(one)
    return out


def simple(v, z, y, x):
    """One foreground component around the voxel, and one background component that shares a face with it."""
    around = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o)]
    held = {o for o in around if v[z + o[0], y + o[1], x + o[2]]}
    back = parts([o for o in around if o not in held and sum(map(abs, o)) <= 2], 1)
    return len(parts(held, 3)) == 1 and sum(any(sum(map(abs, o)) == 1 for o in one) for one in back) == 1


@pytest.mark.parametrize("name", list(shapes()))
def test_thinning_keeps_topology_and_is_thin(name):
    v = shapes()[name]
    out = skeleton.thin(v)
    assert euler(out) == euler(v) and not (out & ~v).any()
    if name in ("bar", "cross"):
        assert out.sum() < 80 and out[:, :, :10].sum() > 3
    w = np.pad(out, 1)
    bits = [sum(int(w[z + o[0], y + o[1], x + o[2]]) << i for i, o in enumerate(skeleton._N26)) for z, y, x in np.argwhere(w)]
    free = skeleton.is_simple(np.array(bits)) & (np.bitwise_count(np.array(bits)) > 1)
    assert not free.any()  # no voxel is left that could go


def test_simple_voxels_against_components():
    rng = np.random.default_rng(1)
    for share in (0.1, 0.3, 0.5, 0.8):
        v = np.pad(rng.random((8, 8, 8)) < share, 1)
        at = np.argwhere(v)
        bits = np.array([sum(int(v[z + o[0], y + o[1], x + o[2]]) << i for i, o in enumerate(skeleton._N26)) for z, y, x in at])
        assert skeleton.is_simple(bits).tolist() == [simple(v, *p) for p in at]


@pytest.mark.parametrize(("block", "rounds"), [(8, 1), (16, 2), (64, 1)])
def test_thinning_over_blocks_is_that_of_the_whole(spark, block, rounds):
    volumes = shapes()
    found = skeleton.skeletonise(frame(spark, *volumes.values(), shift=-11), ["c"], block, rounds).cache()
    for c, v in enumerate(volumes.values()):
        odd = np.pad(v, ((1, 0), (1, 0), (1, 0)))  # parities as at the shifted place
        assert (array(found.where(f"c = {c}"), v.shape, -11) == skeleton.thin(odd)[1:, 1:, 1:]).all()


@pytest.mark.parametrize("radius", [1, 2, 2.5, 3])
def test_dilation_and_erosion_by_balls(spark, radius):
    rng = np.random.default_rng(2)
    shape = (13, 9, 11)  # x, y, z
    a = np.where(rng.random(shape[::-1]) < 0.6, rng.random(shape[::-1]), 0)
    rows = [(0, int(x), int(y), int(z), float(a[z, y, x])) for z, y, x in np.argwhere(a > 0)]
    df = spark.createDataFrame(rows, "c int, x int, y int, z int, v double")
    for largest in (True, False):
        expected = np.zeros_like(a)
        for z, y, x in np.ndindex(a.shape):
            near = [a[z + dz, y + dy, x + dx] for dz, dy, dx in blocks.ball(radius) if 0 <= z + dz < 11 and 0 <= y + dy < 9 and 0 <= x + dx < 13]
            expected[z, y, x] = max(near) if largest else min(near)
        for block in (4, 64):
            found = blocks.voxels_of(blocks.dilated(blocks.blocks_of(df, ["c"], "v", block), ["c"], shape, radius, largest, block), ["c"], "v", block)
            out = np.zeros_like(a)
            for r in found.collect():
                out[r["z"], r["y"], r["x"]] = r["v"]
            assert (out == expected).all()


def test_ridges_over_blocks(spark):
    n = np.mgrid[:24, :24, :24]
    v = ((n[0] - 8) ** 2 + (n[1] - 9) ** 2 + (n[2] - 8) ** 2 <= 49) | ((n[0] - 15) ** 2 + (n[1] - 15) ** 2 + (n[2] - 16) ** 2 <= 25)
    rows = [{tuple(r) for r in distance.ridge_points(frame(spark, v), ["c"], (24, 24, 24), block=b).collect()} for b in (4, 8, 64)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) >= 1
