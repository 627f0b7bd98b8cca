"""The Euler characteristic of a volume whose voxels arrive as a stream: slices, or parts of them, in any order, late ones and repeated
ones too.

The characteristic is a signed count of distinct cells (see `operators.topology`), so what is kept is the set of cells that have come:
a bit each, in tiles of the cell grid, one state a tile. A voxel is sent to the tiles that own a cell of it (its own, and the next
along an axis at whose end it lies); a tile adds the cells that are new and gives the change. Changes add up to the
characteristic of all that has come, whatever the order and the batches, so no watermark is needed and nothing is late.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Voxels along a side of a tile; its state has (2 TILE)^3 bits, 32 KiB before compression.
TILE = 32
TILE_KEYS = ("bx", "by", "bz")


def tiled(voxels: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """keys, x, y, z and the tile of every voxel, once for each tile that owns a cell of it."""
    out = voxels.select(*keys, *(F.col(k).cast("int").alias(k) for k in "xyz"))
    for k in "xyz":
        out = out.withColumn(f"b{k}", F.explode(F.sequence(F.floor(F.col(k) / tile).cast("int"), F.floor((F.col(k) + 1) / tile).cast("int"))))
    return out


def with_cells(held: np.ndarray, voxels: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The cells of a tile (a cube of bits whose first voxel is at low), with those of the voxels."""
    out = held.copy()
    corner = 2 * (voxels - low)
    for step in itertools.product((0, 1, 2), repeat=3):
        at = corner + step
        at = at[((at >= 0) & (at < out.shape[0])).all(axis=1)]
        out[tuple(at.T)] = True
    return out


def signed_count(cells: np.ndarray) -> int:
    """Cells of even dimension less those of odd; the dimension is the number of odd coordinates, and tiles begin at even ones."""
    return sum((-1) ** sum(p) * int(cells[p[0] :: 2, p[1] :: 2, p[2] :: 2].sum()) for p in itertools.product((0, 1), repeat=3))


def euler_changes(voxels: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """keys, bx, by, bz, change and cells (new ones) of a stream of foreground voxels (keys, x, y, z): the changes of each tile's
    part of the characteristic. Voxels that have come before change nothing; keys have no nulls."""
    by = [*keys, *TILE_KEYS]
    side = 2 * tile

    def run(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bits = np.frombuffer(zlib.decompress(state.get[0]), dtype=np.uint8) if state.exists else np.zeros(side**3 // 8, dtype=np.uint8)
        before = np.unpackbits(bits).astype(bool).reshape((side,) * 3)
        low, now = np.array(key[-3:], dtype=np.int64) * tile, before
        for f in pieces:
            now = with_cells(now, f[["x", "y", "z"]].to_numpy(dtype=np.int64), low)
        state.update((zlib.compress(np.packbits(now).tobytes(), 1),))
        new = int(now.sum()) - int(before.sum())
        if new:
            yield pd.DataFrame([[*key, signed_count(now) - signed_count(before), new]], columns=[*by, "change", "cells"])

    parts = "".join(f"`{k}` {voxels.schema[k].dataType.simpleString()}, " for k in keys) + "bx int, by int, bz int, change bigint, cells bigint"
    return tiled(voxels, keys, tile).groupBy(*by).applyInPandasWithState(run, parts, "bits binary", "append", GroupStateTimeout.NoTimeout)


def euler_of_changes(changes: DataFrame, keys: list[str]) -> DataFrame:
    """keys and chi, of all changes so far."""
    return changes.groupBy(*keys).agg(F.sum("change").alias("chi"))


def run_to_table(spark: SparkSession, source: str, schema, keys: list[str], sink: str, checkpoint: str, files_per_batch: int = 1000, tile: int = TILE) -> DataFrame:
    """Reads the Parquet files of a folder that no run with this checkpoint has read, so many a batch, and appends their changes to the sink.
    Gives all changes so far. A run that is broken off goes on where it was: states and batches are in the checkpoint."""
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    out = euler_changes(live, keys, tile)
    out.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)
