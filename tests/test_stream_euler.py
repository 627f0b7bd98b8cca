"""The streamed characteristic against the batch one."""

from __future__ import annotations

import numpy as np
import pytest

from lamella.operators import topology
from lamella.streaming import euler


def volume(spark, seed: int = 4):
    v = np.random.default_rng(seed).random((2, 7, 9, 11)) < 0.45
    return spark.createDataFrame([tuple(map(int, p)) for p in np.argwhere(v)], "c int, z int, y int, x int")


def chi(df) -> dict:
    return {r.c: r.chi for r in df.collect()}


@pytest.mark.parametrize("tile", [4, 32])
def test_slices_in_any_order_and_repeated_give_the_batch_characteristic(spark, tmp_path, tile):
    fg = volume(spark)
    want = chi(topology.euler(fg, ["c"]))
    where = {k: str(tmp_path / k) for k in ("in", "out", "check")}
    for z in (5, 0, 6, 2):
        fg.where(f"z = {z}").coalesce(1).write.mode("append").parquet(where["in"])
    part = euler.run_to_table(spark, where["in"], fg.schema, ["c"], where["out"], where["check"], 2, tile)
    assert chi(euler.euler_of_changes(part, ["c"])) == chi(topology.euler(fg.where("z in (5, 0, 6, 2)"), ["c"]))
    for z in (4, 1, 3, 2, 5):  # 2 and 5 come again
        fg.where(f"z = {z}").coalesce(1).write.mode("append").parquet(where["in"])
    every = euler.run_to_table(spark, where["in"], fg.schema, ["c"], where["out"], where["check"], 3, tile)
    assert chi(euler.euler_of_changes(every, ["c"])) == want
    again = euler.run_to_table(spark, where["in"], fg.schema, ["c"], where["out"], where["check"], 3, tile)
    assert again.count() == every.count()


def test_voxels_of_one_cube_below_zero_and_none(spark, tmp_path):
    rows = spark.createDataFrame([(0, x, y, z) for x in (-5, -4) for y in (-1, 0) for z in (-33, -32)] + [(1, 3, 3, 3), (1, 5, 5, 5)], "c int, x int, y int, z int")
    rows.write.parquet(str(tmp_path / "in"))
    found = euler.run_to_table(spark, str(tmp_path / "in"), rows.schema, ["c"], str(tmp_path / "out"), str(tmp_path / "check"), tile=4)
    assert chi(euler.euler_of_changes(found, ["c"])) == {0: 1, 1: 2}
    rows.limit(0).write.parquet(str(tmp_path / "none"))
    empty = euler.run_to_table(spark, str(tmp_path / "none"), rows.schema, ["c"], str(tmp_path / "out0"), str(tmp_path / "check0"))
    assert empty.isEmpty()
