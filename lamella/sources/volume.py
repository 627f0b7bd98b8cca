"""A raw volume in one file as a Spark data source, `rawvolume`: slices are its partitions, and filters on z are pushed down.

Options: shape ("w,h,d"), kind (uint8, uint16, int16, float32 or bit), offset (of the header), byte_order (Little-endian or Big-endian),
zero_one (bits as 0 and 1; else as 0 and 255) and slab_bytes (of a partition). A read seeks to its slices, so no task reads more than
its own, and a slice that no filter asks for is not read.

A write deals voxels into slabs of slices, and each task puts its slabs at their places in one file under a temporary name, in a folder
that all executors share; a second attempt writes equal bytes to the same places. The commit gives the file its size and its name, after
a manifest of what it holds; positions without a voxel are 0. Of voxels at one position the values are added.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from lamella.sources.raw import dtype_of

NAME = "rawvolume"
SLAB_BYTES = 16 << 20


@dataclass(frozen=True)
class Layout:
    """Where a volume's pixels lie in its file."""

    width: int
    height: int
    depth: int
    kind: str
    offset: int
    byte_order: str
    zero_one: bool
    slab_bytes: int

    @classmethod
    def of(cls, options) -> Layout:
        shape = [int(n) for n in options["shape"].split(",")]
        offset = int(options.get("offset", "0"))
        if len(shape) != 3 or min(shape) < 1 or offset < 0:
            raise ValueError("sizes are three from 1 on and a header is from 0 on")
        out = cls(*shape, options.get("kind", "uint8"), offset, options.get("byte_order", "Little-endian"), options.get("zero_one", "false").lower() == "true", int(options.get("slab_bytes", SLAB_BYTES)))
        out.dtype()
        return out

    def dtype(self) -> np.dtype:
        return dtype_of("uint8" if self.kind == "bit" else self.kind, self.byte_order)

    def slice_bytes(self) -> int:
        return self.width * self.height * self.dtype().itemsize

    def slab(self) -> int:
        """Slices of a partition."""
        return max(1, self.slab_bytes // self.slice_bytes())

    def decoded(self, data: bytes) -> np.ndarray:
        out = np.frombuffer(data, dtype=self.dtype())
        if self.kind == "bit" or (self.zero_one and self.kind == "uint8"):
            if self.zero_one and out.max(initial=0) > 1:
                raise ValueError("a binary volume holds 0 and 1 alone")
            return np.where(out != 0, 1 if self.kind == "bit" else 255, 0).astype(np.float64)
        return out.astype(np.float64)

    def encoded(self, values: np.ndarray) -> bytes:
        if self.kind == "bit" or self.zero_one:
            values = (values != 0) * (1 if self.zero_one else 255)
        return values.astype(self.dtype()).tobytes()


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class _Slices(InputPartition):
    def __init__(self, first: int, stop: int):
        super().__init__((first, stop))
        self.first, self.stop = first, stop


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.layout = options["path"], Layout.of(options)
        self.low, self.high, self.only = 0, self.layout.depth, None

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("z",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | In):
                v = f.value
                if isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, v), min(self.high, v + 1)
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, v + isinstance(f, GreaterThan))
                elif isinstance(f, LessThan | LessThanOrEqual):
                    self.high = min(self.high, v + isinstance(f, LessThanOrEqual))
                else:
                    self.only = set(v) if self.only is None else self.only & set(v)
            else:
                yield f

    def partitions(self):
        files, at = _store(self.path)
        wanted = self.layout.offset + self.layout.slice_bytes() * self.layout.depth
        if (size := files.get_file_info(at).size or 0) < wanted:
            raise EOFError(f"{wanted} bytes are wanted with the header, and there are {size}")
        step = self.layout.slab()
        out = [_Slices(z, min(z + step, self.high)) for z in range(self.low, self.high, step)]
        return [p for p in out if self.only is None or any(p.first <= z < p.stop for z in self.only)] or [_Slices(0, 0)]

    def read(self, partition):
        lay = self.layout
        if partition.first >= partition.stop:
            return
        files, at = _store(self.path)
        y, x = (pa.array(k) for k in np.divmod(np.arange(lay.width * lay.height, dtype=np.int32), lay.width))
        with files.open_input_file(at) as source:
            for z in range(partition.first, partition.stop):
                if self.only is None or z in self.only:
                    data = source.read_at(lay.slice_bytes(), lay.offset + z * lay.slice_bytes())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), z, dtype=np.int32)), y, x, pa.array(lay.decoded(data))], names=["z", "y", "x", "value"])


@dataclass
class _Wrote(WriterCommitMessage):
    slabs: list[int]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.layout, self.overwrite = Layout.of(options), overwrite
        files, self.path = _store(options["path"])
        if files.type_name != "local":
            raise ValueError("a volume is written to a folder that all executors share as a file system")
        self.temporary = f"{self.path}.{options['attempt']}.tmp"
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)
        os.makedirs(os.path.dirname(self.path), exist_ok=True)

    def write(self, batches):
        slabs, lay = [], self.layout
        target = os.open(self.temporary, os.O_RDWR | os.O_CREAT, 0o644)
        try:
            for b in batches:
                for z, data in zip(b.column("z").to_pylist(), b.column("data"), strict=True):
                    os.pwrite(target, data.as_buffer(), lay.offset + z * lay.slice_bytes())
                    slabs.append(z)
            os.fsync(target)
        finally:
            os.close(target)
        return _Wrote(slabs)

    def commit(self, messages):
        lay = self.layout
        with open(self.temporary, "ab") as out:
            out.truncate(lay.offset + lay.depth * lay.slice_bytes())
        held = {"shape": [lay.width, lay.height, lay.depth], "kind": lay.kind, "offset": lay.offset, "byte_order": lay.byte_order, "zero_one": lay.zero_one, "slabs": sorted(z for m in messages if m for z in m.slabs)}
        with open(f"{self.temporary}.json", "w") as out:
            json.dump(held, out)
        os.replace(f"{self.temporary}.json", f"{self.path}.json")
        os.replace(self.temporary, self.path)

    def abort(self, messages):
        if os.path.exists(self.temporary):
            os.remove(self.temporary)


class RawVolume(DataSource):
    """`rawvolume`; see the module."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "z int, y int, x int, value double"

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options, overwrite)


def _options(path: str, shape: tuple[int, int, int], kind: str, offset: int, byte_order: str, zero_one: bool, slab_bytes: int) -> dict[str, str]:
    return {"path": path, "shape": ",".join(map(str, shape)), "kind": kind, "offset": str(offset), "byte_order": byte_order, "zero_one": str(zero_one).lower(), "slab_bytes": str(slab_bytes)}


def load(spark: SparkSession, path: str, shape: tuple[int, int, int], kind: str = "uint8", offset: int = 0, byte_order: str = "Little-endian", zero_one: bool = False, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """(z, y, x, value) of every pixel of a raw volume."""
    spark.dataSource.register(RawVolume)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).options(**_options(path, shape, kind, offset, byte_order, zero_one, slab_bytes)).load()


def save(voxels: DataFrame, path: str, shape: tuple[int, int, int], kind: str = "uint8", byte_order: str = "Little-endian", zero_one: bool = False, slab_bytes: int = SLAB_BYTES) -> None:
    """Writes voxels (x, y, z, value) as one file. Voxels beyond the shape raise."""
    spark, options = voxels.sparkSession, _options(path, shape, kind, 0, byte_order, zero_one, slab_bytes)
    spark.dataSource.register(RawVolume)
    lay = Layout.of(options)
    step, (w, h, d) = lay.slab(), shape
    own = voxels.select((F.floor(F.col("z") / step).cast("int") * step).alias("slab"), *(F.col(k).cast("int").alias(k) for k in "zyx"), F.col("value").cast("double").alias("value"))

    def run(t: pa.Table) -> pa.Table:
        first = t.column("slab")[0].as_py()
        z, y, x = (t.column(k).to_numpy() for k in "zyx")
        if first < 0 or z.max() >= d or min(y.min(), x.min()) < 0 or y.max() >= h or x.max() >= w:
            raise ValueError("voxels lie beyond the shape")
        a = np.zeros((min(step, d - first), h, w))
        np.add.at(a, (z - first, y, x), t.column("value").to_numpy())
        return pa.Table.from_arrays([pa.array([first], pa.int32()), pa.array([lay.encoded(a)], pa.binary())], names=["z", "data"])

    slabs = own.groupBy("slab").applyInArrow(run, "z int, data binary")
    slabs.write.format(NAME).options(**options, attempt=os.urandom(8).hex()).mode("overwrite").save()
