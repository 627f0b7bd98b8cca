"""Raw volumes in one file: round trips of every kind, slices alone, and what is wrong."""

from __future__ import annotations

import json

import numpy as np
import pytest

from lamella.sources import raw, volume


def made(spark, shape, low, high, seed=1):
    rng = np.random.default_rng(seed)
    a = rng.integers(low, high, shape[::-1]) * (rng.random(shape[::-1]) < 0.4)
    return a, spark.createDataFrame([(int(x), int(y), int(z), float(a[z, y, x])) for z, y, x in np.argwhere(a)], "x int, y int, z int, value double")


def array(df, shape):
    out = np.full(shape[::-1], np.nan)
    for r in df.collect():
        out[r["z"], r["y"], r["x"]] = r["value"]
    return out


@pytest.mark.parametrize(("kind", "order", "low", "high"), [("uint8", "Little-endian", 0, 256), ("uint16", "Big-endian", 0, 65536), ("int16", "Little-endian", -32768, 32768), ("float32", "Big-endian", -9, 9), ("bit", "Little-endian", 0, 9)])
def test_round_trips(spark, tmp_path, kind, order, low, high):
    shape, path = (7, 5, 11), f"{tmp_path}/volume.raw"
    a, df = made(spark, shape, low, high)
    volume.save(df, path, shape, kind, order, slab_bytes=200)
    found = volume.load(spark, path, shape, kind, byte_order=order, slab_bytes=200)
    assert found.rdd.getNumPartitions() > 1
    assert (array(found, shape) == (a != 0 if kind == "bit" else a)).all()
    data = open(path, "rb").read()
    assert len(data) == 7 * 5 * 11 * volume.Layout.of({"shape": "7,5,11", "kind": kind}).dtype().itemsize
    if kind == "bit":
        assert (np.frombuffer(data, dtype=np.uint8) == 255 * (a != 0).ravel()).all()
    else:
        assert (raw.decoded(data, shape, kind, byte_order=order) == a).all()
    held = json.load(open(f"{path}.json"))
    assert held["shape"] == list(shape) and held["slabs"][0] == 0 and sorted(p.name for p in tmp_path.iterdir()) == ["volume.raw", "volume.raw.json"]


def test_zero_one(spark, tmp_path):
    shape, path = (4, 3, 2), f"{tmp_path}/bits.raw"
    a, df = made(spark, shape, 1, 9)
    volume.save(df, path, shape, "bit", zero_one=True)
    assert (np.frombuffer(open(path, "rb").read(), dtype=np.uint8) == (a != 0).ravel()).all()
    assert (array(volume.load(spark, path, shape, "uint8", zero_one=True), shape) == 255 * (a != 0)).all()
    volume.save(df, path, shape, "uint8")
    with pytest.raises(Exception, match="0 and 1 alone"):
        volume.load(spark, path, shape, "uint8", zero_one=True).collect()


def test_slices_are_pushed_down_and_headers_skipped(spark, tmp_path):
    shape, path = (3, 2, 20), f"{tmp_path}/headed.raw"
    a = np.random.default_rng(2).integers(0, 256, shape[::-1]).astype(np.uint8)
    open(path, "wb").write(b"header!" + a.tobytes() + b"more")
    every = volume.load(spark, path, shape, offset=7, slab_bytes=12)
    assert (array(every, shape) == a).all()
    for where, wanted in (("z = 5", [5]), ("z > 3 and z <= 6", [4, 5, 6]), ("z in (1, 18)", [1, 18]), ("z >= 19", [19]), ("z < 1", [0]), ("z > 30", []), ("z = 5 and x = 1", [5])):
        some = every.where(where)
        assert sorted({r["z"] for r in some.collect()}) == wanted
    assert every.where("z = 5").rdd.getNumPartitions() == 1
    reader = volume._Reader({"path": path, "shape": "3,2,20", "offset": "7", "slab_bytes": "12"})
    assert list(reader.pushFilters([volume.EqualTo(("z",), 5), volume.EqualTo(("x",), 1)])) == [volume.EqualTo(("x",), 1)]
    assert [(p.first, p.stop) for p in reader.partitions()] == [(5, 6)]


def test_what_is_wrong(spark, tmp_path):
    path = f"{tmp_path}/short.raw"
    open(path, "wb").write(b"abc")
    with pytest.raises(Exception, match="bytes are wanted"):
        volume.load(spark, path, (2, 2, 2)).collect()
    with pytest.raises(ValueError, match="no raw volumes"):
        volume.save(spark.createDataFrame([(0, 0, 0, 1.0)], "x int, y int, z int, value double"), path, (1, 1, 1), "int64")
    with pytest.raises(Exception, match="beyond the shape"):
        volume.save(spark.createDataFrame([(0, 3, 0, 1.0)], "x int, y int, z int, value double"), path, (1, 1, 1))
    volume.save(spark.createDataFrame([], "x int, y int, z int, value double"), path, (2, 2, 2))
    assert open(path, "rb").read() == bytes(8)
