"""Headerless raw volumes, binary STL and header tags.

A raw file is read by Spark's binary reader in any store; a file is a row, so many files are many tasks, and pixels become rows
within the task, slice by slice. Volumes are written slice by slice, each task its own slices, and joined by name; the whole
volume never reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.geometry import stl_name

TYPES = {"uint8": "u1", "uint16": "u2", "int16": "i2", "float32": "f4"}


def dtype_of(kind: str, byte_order: str = "Little-endian") -> np.dtype:
    """Only "Big-endian" is big; all other orders are little."""
    if kind not in TYPES:
        raise ValueError(f"no raw volumes of {kind}")
    return np.dtype((">" if byte_order == "Big-endian" else "<") + TYPES[kind])


def decoded(data: bytes, shape: tuple[int, int, int], kind: str, offset: int = 0, byte_order: str = "Little-endian", zero_one: bool = False) -> np.ndarray:
    """The volume as (z, y, x); x runs fastest. zero_one: bytes 0 and 1 stand for 0 and 255."""
    w, h, d = shape
    if min(shape) < 1 or offset < 0:
        raise ValueError("sizes are from 1 on and a header is from 0 on")
    t = dtype_of(kind, byte_order)
    size = w * h * d * t.itemsize
    if len(data) - offset < size:
        raise EOFError(f"{size} bytes are wanted after the header, and there are {max(0, len(data) - offset)}")
    out = np.frombuffer(data, dtype=t, count=w * h * d, offset=offset).reshape(d, h, w)
    if zero_one:
        if kind != "uint8" or out.max(initial=0) > 1:
            raise ValueError("a binary volume holds 0 and 1 alone")
        out = out * np.uint8(255)
    return out


def read_raw(spark: SparkSession, path: str, shape: tuple[int, int, int], kind: str = "uint8", offset: int = 0, byte_order: str = "Little-endian", zero_one: bool = False) -> DataFrame:
    """(image_id, z, y, x, value) of every raw file at path."""
    w, h, d = shape
    dtype_of(kind, byte_order)

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                volume = decoded(data.as_buffer().to_pybytes(), shape, kind, offset, byte_order, zero_one)
                y, x = np.divmod(np.arange(w * h, dtype=np.int32), w)
                for z in range(d):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * (w * h)), pa.array(np.full(w * h, z, dtype=np.int32)), pa.array(y), pa.array(x), pa.array(volume[z].ravel().astype(np.float64))], names=["image_id", "z", "y", "x", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "image_id string, z int, y int, x int, value double")


def write_raw(voxels: DataFrame, folder: str, name: str, shape: tuple[int, int, int], kind: str = "uint8", little_endian: bool = True, zero_one: bool = False) -> list[str]:
    """Writes a file per slice, name-00000.raw and so on, each under a temporary name first; their paths in order. Joined, they
    are the raw volume; `join_raw` does that in a store."""
    w, h, d = shape
    t = dtype_of(kind, "Little-endian" if little_endian else "Big-endian")
    url = folder if "://" in folder else "file://" + folder

    def run(f: pd.DataFrame) -> pd.DataFrame:
        z = int(f.z.iloc[0])
        plane = np.zeros((h, w))
        plane[f.y, f.x] = f.value
        data = (plane != 0 if zero_one else plane).astype(t).tobytes()
        files, at = fs.FileSystem.from_uri(url)
        files.create_dir(at, recursive=True)
        path = f"{at}/{name}-{z:05d}.raw"
        with files.open_output_stream(path + ".tmp") as out:
            out.write(data)
        files.move(path + ".tmp", path)
        return pd.DataFrame({"z": [z], "path": [path]})

    every = voxels.sparkSession.range(d).select(F.col("id").cast("int").alias("z"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(0.0).alias("value"))
    own = every.union(voxels.select(*(F.col(k).cast("int") for k in ("z", "y", "x")), F.col("value").cast("double")))
    own = own.groupBy("z", "y", "x").agg(F.sum("value").alias("value"))
    return [r["path"] for r in sorted(own.groupBy("z").applyInPandas(run, "z int, path string").collect())]


def join_raw(paths: list[str], target: str) -> None:
    files, at = fs.FileSystem.from_uri(target if "://" in target else "file://" + target)
    with files.open_output_stream(at + ".tmp") as out:
        for p in paths:
            with files.open_input_stream(p) as part:
                while data := part.read(1 << 22):
                    out.write(data)
    files.move(at + ".tmp", at)


def stl_bytes(v0: np.ndarray, v1: np.ndarray, v2: np.ndarray, header: str = "Binary STL created by lamella") -> bytes:
    """Facets (rows of x, y, z) as binary STL: header padded with dots, count, and 50 bytes each."""
    n = np.cross(v1 - v0, v2 - v0)
    length = np.linalg.norm(n, axis=1, keepdims=True)
    n = np.divide(n, length, out=np.zeros_like(n), where=length > 0)
    facets = np.zeros(len(v0), dtype=[("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")])
    facets["n"], facets["v"] = n, np.stack([v0, v1, v2], axis=1)
    return header.encode()[:80].ljust(80, b".") + len(v0).to_bytes(4, "little") + facets.tobytes()


def write_stl(triangles: DataFrame, keys: list[str], folder: str, name: str) -> DataFrame:
    """Writes a file per key; keys, path and the number of facets. A key's mesh is one file, and so one task's."""
    url = folder if "://" in folder else "file://" + folder
    parts = "".join(f"`{k}` {triangles.schema[k].dataType.simpleString()}, " for k in keys)
    flat = triangles.select(*keys, *(F.col(f"v{i}.{k}").alias(f"v{i}{k}") for i in range(3) for k in "xyz"))

    def run(key, f):
        v = [f[[f"v{i}x", f"v{i}y", f"v{i}z"]].to_numpy(dtype=float) for i in range(3)]
        files, at = fs.FileSystem.from_uri(url)
        files.create_dir(at, recursive=True)
        path = f"{at}/" + stl_name(name, ", ".join(f"{k}: {x}" for k, x in zip(keys, key)))
        with files.open_output_stream(path + ".tmp") as out:
            out.write(stl_bytes(*v))
        files.move(path + ".tmp", path)
        return pd.DataFrame([[*key, path, len(f)]], columns=[*keys, "path", "facets"])

    return flat.groupBy(*keys).applyInPandas(run, parts + "path string, facets bigint")


def tag(header: Column, name: str) -> Column:
    """A tag's number in an image's header text, null if it has none."""
    return F.regexp_extract(header, name + r"[^\n]*?:\s*(-?[\d.]+(?:[eE][-+]?\d+)?)", 1).try_cast("double")
