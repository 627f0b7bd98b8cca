"""Projections, filters and predicates over voxel relations; all of them stay within built-in functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MASK = 255


def is_binary(voxels: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys and is_binary: at most two distinct values, and at least one voxel. One pass: a row for each value of a task, and of those
    the count."""
    values = voxels.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return values.groupBy(*keys).agg((F.count(F.lit(1)) <= 2).alias("is_binary"))


def is_mask(voxels: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys and is_mask: every value is 0 or 255."""
    return voxels.groupBy(*keys).agg(F.bool_and(F.col(value).isin(0, MASK)).alias("is_mask"))


def binary_by_colour(voxels: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys and is_binary_colour: the histogram has at most two bins with voxels."""
    return voxels.groupBy(*keys, value).count().groupBy(*keys).agg((F.count(F.lit(1)) <= 2).alias("is_binary_colour"))


def as_bits(voxels: DataFrame, value: str = "value") -> DataFrame:
    """The foreground: values that are not 0."""
    return voxels.where(F.col(value) != 0)


def threshold(voxels: DataFrame, low: float, high: float, value: str = "value") -> DataFrame:
    return voxels.where(F.col(value).between(low, high))


def to_mask(voxels: DataFrame, low: float, high: float, value: str = "value") -> DataFrame:
    return voxels.withColumn(value, F.when(F.col(value).between(low, high), MASK).otherwise(0))


def filled_fraction(value: Column, background: float, foreground: float) -> Column:
    """The part of a voxel that is foreground, from 0 to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - background) / (foreground - background)))


def voxel_density(value: Column, slope: float, constant: float, unit: str) -> Column:
    """The density of a voxel in its calibration, never under 0."""
    factor = {"mm": 1e3, "pixel": 1e3, "um": 1e12, "µm": 1e12}.get(unit, 1.0)
    return F.greatest(F.lit(0.0), (value * slope + constant) / factor)


def density_calibration(slope: float, intercept: float, scaling: float) -> tuple[float, float, str]:
    """Slope, constant and unit of the density function of a scanner's header."""
    m = slope / scaling
    return m, intercept - 32768 * m, "mg HA/ccm"


def calibrated(value: Column, slope: float, intercept: float) -> Column:
    """A raw value as a calibrated one (Hounsfield units, density)."""
    return value * slope + intercept


def raw_value(value: Column, slope: float, intercept: float) -> Column:
    return (value - intercept) / slope


def within(x: Column, y: Column, z: Column, shape: tuple[int, int, int]) -> Column:
    w, h, d = shape
    return x.between(0, w - 1) & y.between(0, h - 1) & z.between(0, d - 1)


def crop(voxels: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """Voxels of a box, ends included; positions from its corner on."""
    box = voxels.where(F.col("x").between(low[0], high[0]) & F.col("y").between(low[1], high[1]) & F.col("z").between(low[2], high[2]))
    return box.withColumns({k: F.col(k) - low[i] for i, k in enumerate("xyz")})


def delete_slices(voxels: DataFrame, first: int, last: int) -> DataFrame:
    """Without the slices first..last (1-based, ends included); later slices move up."""
    if first < 1 or last < first:
        raise ValueError("slices are from 1 on, and the last is not before the first")
    left = voxels.where(~F.col("z").between(first - 1, last - 1))
    return left.withColumn("z", F.when(F.col("z") >= last, F.col("z") - (last - first + 1)).otherwise(F.col("z")))


def _bounds(centre: tuple[float, float, float], reach: float, shape: tuple[int, int, int], spacing: tuple[float, float, float]):
    low = tuple(max(0, int((c - reach) / s)) for c, s in zip(centre, spacing))
    high = tuple(min(n - 1, int((c + reach) / s)) for c, s, n in zip(centre, spacing, shape))
    return low, high


def inner_cube(voxels: DataFrame, centre, radius: float, cropped: float, shape, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """The cube inside a sphere that is shrunk by cropped, within the image."""
    return crop(voxels, *_bounds(centre, radius * cropped / 3**0.5, shape, spacing))


def outer_cube(voxels: DataFrame, centre, radius: float, cropped: float, shape, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    return crop(voxels, *_bounds(centre, radius * cropped, shape, spacing))


def sphere(voxels: DataFrame, centre, radius: float, cropped: float = 1.0, padding: int = 0, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """Voxels whose corner is in the sphere; positions from the corner of its padded box on."""
    reach = radius * cropped
    d2 = sum((F.col(k) * spacing[i] - centre[i]) * (F.col(k) * spacing[i] - centre[i]) for i, k in enumerate("xyz"))
    corner = [int((centre[i] - reach) / spacing[i]) - padding for i in range(3)]
    return voxels.where(d2 <= reach * reach).withColumns({k: F.col(k) - corner[i] for i, k in enumerate("xyz")})


def masked_by_rois(voxels: DataFrame, rois: DataFrame, roi_pixels: DataFrame) -> DataFrame:
    """Voxels in the union of the regions of their slice. rois (roi_id, z, t, c: 1-based, 0 for all), roi_pixels (roi_id, y, x).
    The join is by pixel; the wildcards are tested on what meets."""
    pixels = roi_pixels.join(rois.withColumnsRenamed({k: f"{k}_" for k in "ztc"}), "roi_id").withColumnsRenamed({"x": "x_", "y": "y_"})
    own = {k: F.col(k) if k in voxels.columns else F.lit(0) for k in "ztc"}
    on = (F.col("x") == F.col("x_")) & (F.col("y") == F.col("y_"))
    for k, v in own.items():
        on = on & ((F.col(f"{k}_") == 0) | (F.col(f"{k}_") == v + 1))
    return voxels.join(pixels, on, "left_semi")


def margin(vertices: DataFrame, by: int, shape: tuple[int, int, int]) -> DataFrame:
    """Vertices at least so far from the image's bounds; z counts only where there is more than one slice."""
    keep = F.lit(True)
    for i, k in enumerate("xyz"):
        if k != "z" or shape[2] != 1:
            keep = keep & F.col(k).between(by, shape[i] - 1 - by)
    return vertices.where(keep)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def stack_histogram(voxels: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return voxels.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def local_maxima(voxels: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The voxels that no voxel beside them by a face exceeds; positions without a row exceed none."""
    steps = F.array(*(F.struct(*(F.lit(s if k == i else 0).alias(f"d{n}") for k, n in enumerate("xyz"))) for i in range(3) for s in (-1, 1)))
    sent = voxels.select(*keys, "x", "y", "z", value, F.explode(steps).alias("o")).select(*keys, *((F.col(k) + F.col(f"o.d{k}")).alias(k) for k in "xyz"), value)
    most = sent.groupBy(*keys, "x", "y", "z").agg(F.max(value).alias("most_"))
    return voxels.join(most, [*keys, "x", "y", "z"], "left").where(F.coalesce(F.col(value) >= F.col("most_"), F.lit(True))).drop("most_")


def skip_seeds(seeds: DataFrame, ratio: int, offset: int, order: list[str], partition: list[str] | None = None) -> DataFrame:
    """Every ratio-th seed of a partition, or of all, from an offset on."""
    if partition:
        n = F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1
        return seeds.withColumn("n_", n).where(F.col("n_") % ratio == offset).drop("n_")
    return numbered(seeds, [F.col(k) for k in order], "n_").where(F.col("n_") % ratio == offset).drop("n_")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with numbers from 0 in an order, by ranges: each range is numbered by one task, from the number of rows before it on. The
    rows are written first, so that the ranges are the same when they are counted and when they are numbered."""
    from lamella.storage import written

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = written(rows.repartitionByRange(parts, *order).withColumn("part_", F.spark_partition_id()), "ranges")
    counts = own.groupBy("part_").agg(F.count(F.lit(1)).alias("size_"))
    before = counts.withColumn("before_", F.coalesce(F.sum("size_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = F.row_number().over(Window.partitionBy("part_").orderBy(*order)) - 1
    return own.join(F.broadcast(before.select("part_", "before_")), "part_").withColumn(name, F.col("before_") + n).drop("part_", "before_")


def default_thresholds(histogram: DataFrame, keys: list[str], value: str = "value", hounsfield: bool = False, signed: bool = False) -> DataFrame:
    """keys, low and high: of images in Hounsfield units 0 and 4000; else the IsoData level of a histogram (keys, value, n) and the
    highest value, both shifted for signed 16-bit images whose values are held from 0 on."""
    if hounsfield:
        return histogram.select(*keys).distinct().select(*keys, F.lit(0.0).alias("low"), F.lit(4000.0).alias("high"))
    shift = -32768 if signed else 0
    parts = "".join(f"`{k}` {histogram.schema[k].dataType.simpleString()}, " for k in keys)

    def run(f):
        counts = f.groupby(f[value].astype(int))["n"].sum()
        dense = counts.reindex(range(int(counts.index.max()) + 1), fill_value=0).to_numpy()
        out = f[keys].head(1).reset_index(drop=True)
        return out.assign(low=float(isodata_threshold(dense) + shift), high=float(counts[counts > 0].index.max() + shift))

    return histogram.groupBy(*keys).applyInPandas(run, parts + "low double, high double")


def isodata_threshold(counts: list[int]) -> int:
    """The first level that is half-way between the means under and over it, over a histogram (Ridler and Calvard); from running sums."""
    n = np.asarray(counts, dtype=np.float64)
    held = np.flatnonzero(n)
    if not len(held):
        return 0
    low, high = int(held[0]), int(held[-1])
    levels, total, mass = np.arange(low, high), np.cumsum(n), np.cumsum(n * np.arange(len(n)))
    under = mass[levels] / np.maximum(1, total[levels])
    over = (mass[high] - mass[levels]) / np.maximum(1, total[high] - total[levels])
    found = np.flatnonzero(levels + 1 > (under + over) / 2)
    return low + int(found[0]) if len(found) else high
