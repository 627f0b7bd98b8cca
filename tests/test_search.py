"""The search for ellipsoids: contacts and torque, known solids, anchors, and the same results for any blocks."""

from __future__ import annotations

import uuid

import numpy as np
import pytest

from lamella.operators import ellipsoids
from lamella.operators.ellipsoids import Parameters, Search


def solid(shape, centre, radii):
    n = np.mgrid[tuple(slice(0, s) for s in shape)] + 0.5
    return sum(((n[k] - centre[k]) / radii[k]) ** 2 for k in range(3)) <= 1


def test_a_sphere_is_found():
    ball = solid((40, 40, 40), (20.5, 20.5, 20.5), (10, 10, 10))
    (_, radii, _), = Search(ball, np.zeros(3, int), ball.shape, np.array([[20.5, 20.5, 20.5]]), [1], Parameters()).run()
    assert np.abs(radii - 9.5).max() <= 1.5


def test_contacts_and_torque_of_a_cuboid():
    """A cuboid that touches the image's lower bound: points beyond the image aren't contacts, and forces along axes don't turn."""
    box = np.zeros((6, 6, 6), dtype=bool)
    box[1:5, 1:5, 0:5] = True
    search = Search(box, np.zeros(3, int), box.shape, np.array([[3.0, 3, 2]]), [1], Parameters())
    search.radii[0] = (1, 2.1, 3.1)
    search.unit = np.concatenate([np.eye(3), -np.eye(3)])[None]
    points, touching = search.contacts(np.array([0]))
    assert {tuple(np.round(p, 9)) for p in points[0][touching[0]]} == {(3, 5.1, 2), (3, 3, 5.1), (3, 0.9, 2)}
    assert np.abs(ellipsoids.torque(search.centre, search.radii, search.axes, points, touching)).max() < 1e-12


def test_torque_turns_an_ellipsoid_into_its_channel():
    turn = ellipsoids._turned(np.array([0.0, 0, 1]), 0.5)
    n = np.stack(np.mgrid[:60, :60, :30], axis=-1) + 0.5 - [30, 30, 15]
    channel = (((n @ turn) / [22, 6, 6]) ** 2).sum(axis=-1) <= 1
    (_, radii, axes), = Search(channel, np.zeros(3, int), channel.shape, np.array([[30.0, 30, 15]]), [3], Parameters(iterations=60)).run()
    assert radii[2] > 14 and abs(axes[:, 2] @ turn[:, 0]) > 0.97


def test_seeds_together_are_as_alone_and_anchors_hold():
    ball = solid((30, 30, 30), (15, 15, 15), (12, 8, 6))
    seeds = np.array([[15.0, 15, 15], [12, 15, 15], [18, 16, 15], [1, 1, 1]])
    for anchor in (False, True):
        p = Parameters(iterations=15, anchor=anchor)
        both = Search(ball, np.zeros(3, int), ball.shape, seeds, [1, 2, 3, 4], p).run()
        assert both[3] is None
        for k in range(3):
            alone, = Search(ball, np.zeros(3, int), ball.shape, seeds[k : k + 1], [k + 1], p).run()
            assert all(np.allclose(a, b) for a, b in zip(alone, both[k]))
            if not anchor:
                assert np.linalg.norm(both[k][0] - seeds[k]) <= p.drift + 1e-9


def test_anchored_changes_keep_the_point_towards_the_seed():
    search = Search(np.ones((20, 20, 20), dtype=bool), np.zeros(3, int), (20, 20, 20), np.array([[9.0, 9, 9], [10, 10, 10]]), [1, 2], Parameters(anchor=True))
    i, rng = np.arange(2), np.random.default_rng(1)
    search.centre[0], search.radii[:] = (11, 10, 9), (1, 2, 4)
    for change in (search.jiggle, search.bump, search.turn):
        pin = search._pin(i, rng.normal(size=(2, 3)))
        along = pin[1] - search.centre
        to_seed = search.seeds - search.centre
        assert np.allclose(np.cross(along, to_seed), 0, atol=1e-9) and ((along * to_seed).sum(axis=1) > 0).all()
        change(i, rng.random((2, 8)))
        search._unpin(i, pin)
        assert np.allclose(search._towards(i, pin[0]), pin[1])


@pytest.mark.parametrize("block", [8, 64])
def test_blocks_dont_matter(spark, block):
    ball = solid((30, 30, 30), (15, 15, 15), (12, 8, 6))
    fg = spark.createDataFrame([tuple(map(int, p)) for p in np.argwhere(ball)], "x int, y int, z int")
    seeds = [(7, 15.0, 15.0, 15.0), (8, 12.0, 15.0, 15.0), (9, 1.0, 1.0, 1.0)]
    p = Parameters(iterations=10)
    rows = ellipsoids.optimise(spark.createDataFrame(seeds, "seed_id bigint, x double, y double, z double"), fg, (30, 30, 30), p, block=block).collect()
    whole = [x for x in Search(ball, np.zeros(3, int), ball.shape, np.array([s[1:] for s in seeds]), [7, 8, 9], p).run() if x]
    assert len(rows) == len(whole) == 2
    assert sorted(np.prod([r[c] for c in ("ra", "rb", "rc")]) for r in rows) == pytest.approx(sorted(np.prod(x[1]) for x in whole))


def test_few_seeds_are_dealt_over_the_cores(spark, monkeypatch, tmp_path):
    """With the same ellipsoids as from one search of all."""
    ball = solid((30, 30, 30), (15, 15, 15), (12, 8, 6))
    fg = spark.createDataFrame([tuple(map(int, p)) for p in np.argwhere(ball)], "x int, y int, z int")
    places = np.argwhere(ball)[::40][:32] + 0.5
    seeds = [(i, *map(float, p)) for i, p in enumerate(places)]
    p = Parameters(iterations=3)

    class Noted(Search):
        def __init__(self, volume, low, image, seeds, *rest):
            (tmp_path / f"{uuid.uuid4().hex}-{len(seeds)}").touch()
            super().__init__(volume, low, image, seeds, *rest)

    monkeypatch.setattr(ellipsoids, "Search", Noted)
    rows = ellipsoids.optimise(spark.createDataFrame(seeds, "seed_id bigint, x double, y double, z double"), fg, (30, 30, 30), p).collect()
    sizes = [int(f.name.split("-")[1]) for f in tmp_path.iterdir()]
    assert len(seeds) == sum(sizes) == 32 and max(sizes) < 32
    whole = [x for x in Search(ball, np.zeros(3, int), ball.shape, places, list(range(32)), p).run() if x]
    assert sorted((r["ra"], r["rb"], r["rc"]) for r in rows) == sorted(tuple(x[1]) for x in whole)
