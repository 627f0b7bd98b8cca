"""Distances to the background, ridges and local thickness.

The squared distance is separable: three passes, each over lines along one axis. A pass gathers the voxels of a line, and a
task takes many lines at once. Local thickness deals spheres into the blocks that they reach, so a block's voxels meet only
its spheres.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.operators import blocks
from lamella.operators.components import grid
from lamella.storage import written

FAR = 1e18
SHORT = 64
BLOCK = 32


def _parts(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def lower_envelope(lines: np.ndarray, spacing: float) -> np.ndarray:
    """For each row f: min over j of f[j] + (spacing (i - j))^2. Short rows try all j; of long ones the best j rises with i, so half-way
    points are worked out first, and those between look only between their neighbours' best: n log n steps."""
    n = lines.shape[1]
    if n > SHORT:
        step = max(1, 1_000_000 // n)
        return np.concatenate([_monotone(lines[i : i + step], spacing) for i in range(0, len(lines), step)]) if len(lines) else lines.copy()
    out = np.empty_like(lines)
    cost = (np.arange(n)[:, None] - np.arange(n)[None]) ** 2 * (spacing * spacing)
    step = max(1, 4_000_000 // max(1, n * n))
    for i in range(0, len(lines), step):
        out[i : i + step] = (lines[i : i + step, None, :] + cost[None]).min(axis=2)
    return out


def _monotone(lines: np.ndarray, spacing: float) -> np.ndarray:
    count, n = lines.shape
    size = 1 << n.bit_length()
    best = np.full((count, size + 1), n - 1)  # of place p the best j is in column p + 1
    best[:, 0] = 0
    out, half = np.empty_like(lines), size // 2
    while half:
        at = np.arange(half, n + 1, 2 * half)
        if len(at):
            low, high = best[:, at - half].ravel(), best[:, at + half].ravel()
            sizes = high - low + 1
            starts = np.cumsum(sizes) - sizes
            which = np.repeat(np.arange(len(sizes)), sizes)
            j = np.arange(len(which)) - starts[which] + low[which]
            row, place = which // len(at), at[which % len(at)] - 1
            cost = lines[row, j] + (spacing * (place - j)) ** 2
            least = np.minimum.reduceat(cost, starts)
            first = np.flatnonzero(cost == least[which])
            first = first[np.concatenate(([True], which[first][1:] != which[first][:-1]))]
            best[:, at] = j[first].reshape(count, -1)
            out[:, at - 1] = least.reshape(count, -1)
        half //= 2
    return out


def _pass(df: DataFrame, keys: list[str], axis: str, n: int, spacing: float) -> DataFrame:
    others = [k for k in "xyz" if k != axis]
    lines = df.groupBy(*keys, *others).agg(F.collect_list(F.struct(axis, "d2")).alias("line"))
    names = [*keys, *others]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.full((b.num_rows, n), FAR)
            flat = b.column(len(names))
            owner = np.repeat(np.arange(b.num_rows), np.diff(flat.offsets.to_numpy()))
            values = flat.flatten()
            rows[owner, values.field(0).to_numpy()] = values.field(1).to_numpy()
            made = np.minimum(lower_envelope(rows, spacing), FAR)
            which = pa.array(np.repeat(np.arange(b.num_rows), n))
            columns = [b.column(i).take(which) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(np.arange(n, dtype=np.int32), b.num_rows)), pa.array(made.ravel())], names=[*names, axis, "d2"])

    return lines.mapInArrow(run, _parts(df, keys) + "".join(f"{k} int, " for k in others) + f"{axis} int, d2 double").select(*keys, "x", "y", "z", "d2")


def squared_distance(fg: DataFrame, keys: list[str], shape: tuple[int, int, int], spacing=(1.0, 1.0, 1.0), border: bool = False) -> DataFrame:
    """keys, x, y, z, d2: the squared distance of every foreground voxel to the nearest background voxel; FAR if there is none.
    border: beyond the image is background."""
    w, h, d = (n + 2 * border for n in shape)
    own = fg.select(*keys, *((F.col(k) + int(border)).cast("int").alias(k) for k in "xyz"))
    every = grid(fg.sparkSession, own.select(*keys).distinct(), (w, h, d))
    start = every.join(own.withColumn("own_", F.lit(FAR)), [*keys, "x", "y", "z"], "left").select(*keys, "x", "y", "z", F.coalesce("own_", F.lit(0.0)).alias("d2"))
    for axis, n, s in zip("xyz", (w, h, d), spacing):
        start = _pass(start, keys, axis, n, s)
    return start.where("d2 > 0").select(*keys, *((F.col(k) - int(border)).alias(k) for k in "xyz"), "d2")


def ridge(distance: DataFrame, keys: list[str]) -> DataFrame:
    """The voxels of a distance map whose sphere no neighbour's sphere holds: all that local thickness needs."""
    own = distance.select(*keys, "x", "y", "z", "d2", F.sqrt("d2").alias("r"))
    near = own
    for k in "xyz":
        near = near.withColumn(f"o{k}", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    step = F.sqrt(sum(F.col(f"o{k}") * F.col(f"o{k}") for k in "xyz").cast("double"))
    held = near.where("ox <> 0 or oy <> 0 or oz <> 0").select(*keys, *((F.col(k) + F.col(f"o{k}")).alias(k) for k in "xyz"), (F.col("r") - step).alias("inside"))
    held = held.groupBy(*keys, "x", "y", "z").agg(F.max("inside").alias("inside"))
    return own.join(held, [*keys, "x", "y", "z"], "left").where(F.col("inside").isNull() | (F.col("inside") < F.col("r") - 1e-9)).select(*keys, "x", "y", "z", "r", "d2")


RIDGE_RADIUS = 2


def ridge_points(fg: DataFrame, keys: list[str], shape: tuple[int, int, int], threshold: float = 0.6, block: int = blocks.BLOCK) -> DataFrame:
    """keys, x, y, z of seeds for ellipsoids: voxel centres where closing less opening of the distance map by a small ball is more
    than threshold of its largest value, and the opening is 1 at least. One stencil does all four passes of the ball."""
    found = squared_distance(fg, keys, shape, border=True).withColumn("r", F.sqrt("d2"))

    def fn(a: np.ndarray, low) -> np.ndarray:
        beyond = blocks.outside(a, low, shape)
        over = lambda v, largest: blocks.over_ball(v, RIDGE_RADIUS, largest, beyond)
        opened = over(over(a, False), True)
        return np.where(beyond | (opened < 1), np.nan, over(over(a, True), False) - opened)

    both = blocks.stencil(blocks.blocks_of(found, keys, "r", block), keys, 2 * RIDGE_RADIUS, fn, np.float64, block, 0.0, np.nan)
    both = written(blocks.voxels_of(both, keys, "r", block, np.nan), "ridge")
    most = both.groupBy(*keys).agg(F.max("r").alias("most"))
    return both.join(most, keys).where(F.col("r") > threshold * F.col("most")).select(*keys, *((F.col(k) + 0.5).alias(k) for k in "xyz"), "r")


def local_thickness(fg: DataFrame, keys: list[str], shape: tuple[int, int, int], block: int = BLOCK) -> DataFrame:
    """keys, x, y, z, thickness: for every foreground voxel the diameter of the largest sphere within the foreground that holds it."""
    spheres = written(ridge(squared_distance(fg, keys, shape), keys), "spheres")
    for k in "xyz":
        low, high = F.floor((F.col(k) - F.col("r")) / block), F.floor((F.col(k) + F.col("r")) / block)
        spheres = spheres.withColumn(f"b{k}", F.explode(F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit((shape["xyz".index(k)] - 1) // block)))))
    own = fg.select(*keys, *(F.col(k).cast("int").alias(k) for k in "xyz"), *(F.floor(F.col(k) / block).alias(f"b{k}") for k in "xyz"))
    by = [*keys, "bx", "by", "bz"]

    def run(voxels: pd.DataFrame, spheres: pd.DataFrame) -> pd.DataFrame:
        p, c, r = voxels[["x", "y", "z"]].to_numpy(dtype=float), spheres[["x", "y", "z"]].to_numpy(dtype=float), spheres["r"].to_numpy()
        reach = spheres["d2"].to_numpy()
        best = np.zeros(len(p))
        order = np.argsort(-r)
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            open_ = np.flatnonzero(best < 2 * r[some[0]])
            if not len(open_):
                break
            d2 = ((p[open_, None] - c[None, some]) ** 2).sum(axis=2)
            best[open_] = np.maximum(best[open_], np.where(d2 < reach[some], 2 * r[some], 0).max(axis=1))
        return voxels[[*keys, "x", "y", "z"]].assign(thickness=best)

    return own.groupBy(*by).cogroup(spheres.groupBy(*by)).applyInPandas(run, _parts(fg, keys) + "x int, y int, z int, thickness double")


def thickness_summary(thickness: DataFrame, keys: list[str], name: str = "Tb.Th") -> DataFrame:
    """keys, mean, standard deviation and largest thickness; nulls where there is none."""
    return thickness.groupBy(*keys).agg(F.avg("thickness").alias("mean"), F.stddev("thickness").alias("sd"), F.max("thickness").alias("max")).withColumn("map", F.lit(name))


def slice_thickness(fg: DataFrame, keys: list[str], shape: tuple[int, int, int], whole_stack: bool = False) -> DataFrame:
    """keys, z and the mean, population deviation and largest thickness of each slice: of circles within the slice, or of spheres
    within the whole stack."""
    if whole_stack:
        found = local_thickness(fg, keys, shape)
    else:
        flat = fg.select(*keys, "x", "y", F.col("z").alias("slice"), F.lit(0).alias("z"))
        found = local_thickness(flat, [*keys, "slice"], (shape[0], shape[1], 1)).drop("z").withColumnRenamed("slice", "z")
    return found.where("thickness > 0").groupBy(*keys, "z").agg(F.avg("thickness").alias("mean"), F.stddev_pop("thickness").alias("sd"), F.max("thickness").alias("max"))
