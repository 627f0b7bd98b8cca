"""Intercepts over blocks."""

from __future__ import annotations

import uuid

import numpy as np
import pytest

from lamella.operators import filters, mil


def sheets(n, axis):
    """(x, y, z): every other slice along an axis."""
    return np.moveaxis(np.broadcast_to(np.arange(n) % 2 == 0, (n, n, n)), 2, axis).copy()


@pytest.mark.parametrize("block", [7, 16, 64])
def test_block_counts_are_those_of_the_whole(block):
    rng = np.random.default_rng(4)
    shape = (30, 17, 40)
    volume = rng.random(shape) < 0.5
    for i in range(12):
        turn, own = mil.direction(3, i)
        if i == 0:
            turn = np.eye(3)
        origins, starts, counts, got = mil.lines_of(shape, turn, own, 40 * 53.0, 6, 1.73)
        changes, parts = 0, []
        for low in np.ndindex(*(-(-n // block) for n in shape)):
            low = np.array(low) * block
            box = np.zeros((block,) * 3, dtype=bool)
            part = volume[tuple(slice(a, a + block) for a in low)]
            box[tuple(slice(0, n) for n in part.shape)] = part
            one, left = mil.block_changes(box, low, shape, (origins, starts, counts), turn[:, 2], 1.73)
            changes += one
            parts.append(left)
        assert changes + mil.border_changes(np.concatenate(parts)) == mil.phase_changes(volume, origins, starts, counts, turn[:, 2], 1.73)


def test_vectors_are_the_same_for_any_blocks(spark):
    rng = np.random.default_rng(5)
    shape = (20, 12, 15)
    volume = rng.random(shape) < 0.4
    fg = spark.createDataFrame([tuple(map(int, p)) for p in np.argwhere(volume)], "x int, y int, z int")
    found = [sorted(map(tuple, mil.mil_points(fg, shape, 30, 50, seed=2, block=b).collect())) for b in (8, 32)]
    length, sections = 50 * float(np.linalg.norm(shape)), 7
    expected = [(i, *mil.mil_vector(volume, *mil.direction(2, i), length, sections, 1.73)) for i in range(30)]
    assert found[0] == found[1] == expected


def test_lines_are_drawn_once_for_a_direction_and_block(spark, monkeypatch, tmp_path):
    """And not again where the parts of lines meet, in few tasks."""
    lines_of = mil.lines_of

    def counted(*given):
        (tmp_path / uuid.uuid4().hex).touch()
        return lines_of(*given)

    monkeypatch.setattr(mil, "lines_of", counted)
    fg = spark.createDataFrame([(1, 2, 3)], "x int, y int, z int")
    for block, blocks in ((32, 1), (8, 2 * 2 * 1)):
        before = len(list(tmp_path.iterdir()))
        assert len(mil.mil_points(fg, (12, 10, 8), 30, 20, block=block).collect()) == 30
        assert len(list(tmp_path.iterdir())) - before == 30 * blocks


def test_channels_are_measured_over_items_read_once(spark, monkeypatch):
    from lamella.plans import measures

    points, plans = mil.mil_points, []

    def few_points(fg, shape, **rest):
        plans.append(fg.inputFiles())
        return points(fg, shape, 60, 100, **rest)

    monkeypatch.setattr(mil, "mil_points", few_points)
    assert measures.anisotropy(spark, "/root/testdata/sf0.001").count() == len(plans) == 3
    assert plans[0] and not any("lineitem" in f for files in plans for f in files)


def test_sheets_and_empty_volumes(spark):
    turn, rng = np.eye(3), np.random.default_rng(1)
    assert np.linalg.norm(mil.mil_vector(sheets(100, 2), turn, rng, 4000.0, 8, 1.0)) == pytest.approx(1.0, rel=0.05)
    assert np.linalg.norm(mil.mil_vector(np.zeros((100, 100, 100), dtype=bool), turn, rng, 4000.0, 8, 1.0)) == pytest.approx(4000.0)
    across = mil.mil_vector(sheets(100, 1), turn, np.random.default_rng(1), 400.0, 2, 1.0)
    assert np.linalg.norm(across) >= 100  # lines along the sheets change at most once each
    none = mil.mil_points(spark.createDataFrame([], "x int, y int, z int"), (10, 10, 10), 9, 4).collect()
    assert len(none) == 9 and all(np.linalg.norm(r[1:]) == pytest.approx(4 * np.sqrt(300)) for r in none)


def test_isodata_from_running_sums():
    def plain(counts):
        low = next((i for i, n in enumerate(counts) if n), 0)
        high = len(counts) - 1 - next((i for i, n in enumerate(reversed(counts)) if n), 0)
        for level in range(low, high):
            under, over = counts[low : level + 1], counts[level + 1 : high + 1]
            a = sum((low + i) * n for i, n in enumerate(under)) / max(1, sum(under))
            b = sum((level + 1 + i) * n for i, n in enumerate(over)) / max(1, sum(over))
            if level + 1 > (a + b) / 2:
                return level
        return max(low, high)

    rng = np.random.default_rng(6)
    for _ in range(200):
        counts = (rng.integers(0, 20, rng.integers(1, 60)) * (rng.random() < 0.9)).tolist()
        if any(counts):
            assert filters.isodata_threshold(counts) == plain(counts)
    assert filters.isodata_threshold([0, 0]) == 0 and filters.isodata_threshold(np.ones(65536)) == 32767
