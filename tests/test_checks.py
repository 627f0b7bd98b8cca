"""Checks of images by their data, and skeletons of particles beside their other measures."""

from __future__ import annotations

import pytest

from lamella.model import InvalidImage
from lamella.operators import commands, particles

SHAPE = (4, 4, 4)
COLUMNS = "c int, x int, y int, z int, value int"


def test_images_that_can_not_be_measured_are_refused(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), COLUMNS)
    good = make((0, 0, 0, 0, 255), (0, 3, 3, 3, 0), (1, 1, 2, 3, 7), (1, 2, 2, 2, None))
    kept = commands.checked_image(good, ["c"], SHAPE)
    assert {tuple(r) for r in kept.collect()} == {(0, 0, 0, 0), (1, 1, 2, 3)} and kept.columns == ["c", "x", "y", "z"]
    assert commands.checked_image(good.limit(0), ["c"], SHAPE, hyperstack=False).isEmpty()
    for rows, asked, why in (
        ([(0, 0, 0, 0, 1), (0, 1, 0, 0, 2), (0, 2, 0, 0, 3)], {}, "binary"),
        ([(0, 4, 0, 0, 1)], {}, "along x"),
        ([(0, 0, 0, -1, 1)], {}, "along z"),
        ([(0, 0, 0, 0, 1), (1, 0, 0, 0, 1)], {"hyperstack": False}, "channels"),
        ([(0, 0, 0, 0, 1)], {"slices": 5}, "slices"),
        ([(0, 0, 0, 0, 1)], {"spacing": (1.0, 0.0, 1.0)}, "scale"),
    ):
        with pytest.raises(InvalidImage, match=why):
            commands.checked_image(make(*rows), ["c"], SHAPE, **asked)
    with pytest.warns(UserWarning, match="scales"):
        commands.checked_image(good, ["c"], SHAPE, (1.0, 1.0, 1.2))


def test_particles_with_skeletons(spark):
    bar, dot = [(0, x, 2, 2) for x in range(2, 12)], [(0, 8, 8, 8)]
    cross = [(0, x, 20, 5) for x in range(2, 13)] + [(0, 7, y, 5) for y in range(15, 26) if y != 20]
    fg = spark.createDataFrame(bar + dot + cross, "c int, x int, y int, z int")
    plain = dict(with_euler=False, with_surface=False, with_feret=False, with_box=False, with_ellipsoid=False)
    found = {r["size"]: (r["n_branches"], r["branch_length"]) for r in particles.analyse(fg, ["c"], (2.0, 2.0, 2.0), with_skeleton=True, **plain).collect()}
    assert found[10] == (1, pytest.approx(18.0)) and found[1] == (0, 0.0)
    assert found[21][0] == 4 and found[21][1] == pytest.approx(40.0, abs=8)
    assert "n_branches" not in particles.analyse(fg, ["c"], **plain).columns
