"""Whole measurements, as a user asks for them: a check of the image, the operators in turn, and one table.

`shape` and `spacing` tell the image's axes; foregrounds are (keys, x, y, z). Images that a measurement can't take raise
InvalidImage before anything runs.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.model import Axis, InvalidImage, is_isotropic, validate
from lamella.operators import distance, filters, moments, pruning, skeleton
from lamella.storage import written

Shape = tuple[int, int, int]
UNIT = (1.0, 1.0, 1.0)


def _checked(shape: Shape, spacing, slices: int = 1) -> None:
    validate([Axis(k, n, s) for k, n, s in zip("XYZ", shape, spacing)])
    if min(shape) < 1 or min(spacing) <= 0:
        raise InvalidImage("an image has a size and a scale along each axis")
    if shape[2] < slices:
        raise InvalidImage(f"the image needs {slices} slices")


def checked_image(image: DataFrame, keys: list[str], shape: Shape, spacing=UNIT, slices: int = 1, hyperstack: bool = True, tolerance: float = 0.01) -> DataFrame:
    """The foreground (keys, x, y, z) of an image (keys, x, y, z, value) of two values at most in each subspace, those that are not 0.
    Raises InvalidImage where its sizes or scales are wrong, a voxel lies out of bounds, a subspace has more values, or there are
    several subspaces without hyperstack; warns where scales differ by more than the tolerance. Null values are no voxels. An image
    without rows is one without foreground. One pass; a row of bounds and counts comes to the driver."""
    _checked(shape, spacing, slices)
    values = image.where("value is not null").groupBy(*keys, "value").agg(*(f(k).alias(f"{n}_{k}") for k in "xyz" for n, f in (("min", F.min), ("max", F.max))))
    parts = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("values"), *(f(f"{n}_{k}").alias(f"{n}_{k}") for k in "xyz" for n, f in (("min", F.min), ("max", F.max))))
    seen = parts.agg(F.count(F.lit(1)).alias("subspaces"), F.max("values").alias("values"), *(f(f"{n}_{k}").alias(f"{n}_{k}") for k in "xyz" for n, f in (("min", F.min), ("max", F.max)))).first()
    if seen["subspaces"]:
        for k, n in zip("xyz", shape):
            if seen[f"min_{k}"] < 0 or seen[f"max_{k}"] >= n:
                raise InvalidImage(f"voxels lie out of bounds along {k}")
        if seen["subspaces"] > 1 and not hyperstack:
            raise InvalidImage("the image has channels or times")
        if seen["values"] > 2:
            raise InvalidImage("the image is not binary")
    if not is_isotropic([Axis(k, n, s) for k, n, s in zip("XYZ", shape, spacing)], tolerance):
        warnings.warn("the image's scales differ between its axes", stacklevel=2)
    return filters.as_bits(image).select(*keys, "x", "y", "z")


def _joined(tables: list[DataFrame], by: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, by, "left"), tables)


def moments_of(fg: DataFrame, keys: list[str], shape: Shape, spacing=UNIT, weight=None) -> DataFrame:
    """keys, n, mass, the centroid (cx, cy, cz), the inertia tensor (ixx .. iyz), its principal moments i1 >= i2 >= i3 and axes
    (v00 .. v22, columns from the long axis on)."""
    _checked(shape, spacing)
    centre = moments.centroid3d(fg, keys, spacing, weight).drop("n")
    return _joined([moments.principal_axes(moments.inertia_tensor(fg, keys, spacing, weight), keys), centre], keys)


def thresholds_of(image: DataFrame, keys: list[str], low: float | None, high: float | None, hounsfield: tuple[float, float] | None = None) -> DataFrame:
    """keys, low and high as raw values. hounsfield: slope and intercept of an image in Hounsfield units, in which low and high are told
    then. Those that aren't told are the defaults: 0 and 4000 Hounsfield units, or the IsoData level and the highest value of each subspace."""
    if low is None or high is None:
        counts = image.where("value is not null").groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
        found = filters.default_thresholds(counts, keys, hounsfield=hounsfield is not None)
    else:
        found = image.select(*keys).distinct().withColumns({"low": F.lit(None), "high": F.lit(None)})
    given = {k: F.col(k) if v is None else F.lit(float(v)) for k, v in (("low", low), ("high", high))}
    if hounsfield:
        if not hounsfield[0] > 0:
            raise InvalidImage("a calibration in Hounsfield units rises with the values")
        given = {k: filters.raw_value(v, *hounsfield) for k, v in given.items()}
    return found.withColumns(given)


def image_moments(image: DataFrame, keys: list[str], shape: Shape, spacing=UNIT, first: int = 1, last: int | None = None, low: float | None = None, high: float | None = None, hounsfield: tuple[float, float] | None = None, slope: float = 0.0, constant: float = 1.8, unit: str = "mm") -> DataFrame:
    """keys, low and high (raw), volume, mass, the centroid of mass, the inertia tensor and its principal moments and axes, of an image's
    (keys, x, y, z, value) voxels of slices first to last (from 1 on) with values from low to high (see `thresholds_of`). A voxel's mass is
    its density, slope value + constant in the unit's scale and never under 0, by its volume. Voxels without a row or value have no part."""
    _checked(shape, spacing)
    last = shape[2] if last is None else last
    if not 1 <= first <= last <= shape[2]:
        raise InvalidImage(f"slices {first} to {last} are not all in the image")
    held = written(image.where(F.col("z").between(first - 1, last - 1)).select(*keys, "x", "y", "z", "value"), "image")
    limits = written(thresholds_of(image, keys, low, high, hounsfield), "thresholds")
    own = held.join(limits, keys).where(F.col("value").between(F.col("low"), F.col("high")))
    size = spacing[0] * spacing[1] * spacing[2]
    found = moments_of(own, keys, shape, spacing, filters.voxel_density(F.col("value"), slope, constant, unit) * size)
    return found.join(limits, keys).withColumn("volume", F.col("n") * size)


def slice_geometry(fg: DataFrame, keys: list[str], shape: Shape, spacing=UNIT, first: int = 1, last: int | None = None, thickness: bool = True) -> DataFrame:
    """keys, z and, of the slices first to last (from 1 on), centroid, area, angle, moments, perimeter and calipers, and the thickness
    of circles (flat_) and of spheres within the whole stack (deep_)."""
    _checked(shape, spacing)
    last = shape[2] if last is None else last
    if not 1 <= first <= last <= shape[2]:
        raise InvalidImage(f"slices {first} to {last} are not all in the image")
    own = fg.where(F.col("z").between(first - 1, last - 1))
    by = [*keys, "z"]
    parts = [moments.slice_centroids(own, keys, spacing[:2]), moments.slice_moments(own, keys, spacing[:2]), moments.slice_outline(own, keys, spacing[:2])]
    if thickness:
        flat = distance.slice_thickness(own, keys, shape)
        deep = distance.slice_thickness(fg, keys, shape, True)
        parts += [t.select(*by, *(F.col(k).alias(f"{name}_{k}") for k in ("mean", "sd", "max"))) for name, t in (("flat", flat), ("deep", deep))]
    return _joined(parts, by)


def analysed_skeletons(fg: DataFrame, keys: list[str], shape: Shape, spacing=UNIT, thin: bool = True, cycles: str | None = None, image: DataFrame | None = None, dead_ends: bool = False) -> tuple[DataFrame, DataFrame]:
    """(trees, branches): the summary of each tree with its longest shortest path, and its ranked branches. thin: skeletonise first.
    cycles: a method of `pruning` that opens cycles, by the intensities of an image for two of them; dead_ends: prune these too."""
    _checked(shape, spacing)
    points = written(skeleton.skeletonise(fg, keys), "skeleton") if thin else fg
    if cycles:
        points = written(pruning.prune_cycles(points, keys, cycles, image, spacing), "opened")
    if dead_ends:
        points = written(pruning.prune_ends(points, keys), "pruned")
    vertices, branches = skeleton.graph(points, keys, spacing)
    vertices, branches = written(vertices, "vertices"), written(branches, "branches")
    paths = skeleton.longest_shortest_paths(vertices, branches, keys).select(*keys, "skeleton", F.col("length").alias("longest_path"), F.col("start").alias("path_start"))
    trees = _joined([skeleton.summary(vertices, branches, keys), paths], [*keys, "skeleton"])
    return trees, skeleton.ranked_branches(vertices, branches, keys)


def branch_angles(fg: DataFrame, keys: list[str], shape: Shape, spacing=UNIT, least_length: float = 0.0, margin: int = 0, least_valence: int = 3, most_valence: int = 3, thin: bool = True, iterate: bool = False, clusters: bool = True) -> tuple[DataFrame, DataFrame]:
    """(angles, culled): the angles between branches at the junctions of each subspace's largest skeleton, once branches shorter than
    least_length are contracted, at junctions of a valence from least to most that are so far from the bounds; and the
    percentages of branches that pruning took. Short branches are contracted by clusters or by matchings, once or (iterate) until
    none is left; when these are not the defaults, culled tells of what is left then."""
    _checked(shape, spacing)
    points = written(skeleton.skeletonise(fg, keys), "skeleton") if thin else fg
    vertices, branches = skeleton.largest_graph(*(written(t, "graph") for t in skeleton.graph(points, keys, spacing)), keys)
    if iterate or not clusters:
        vertices, branches = pruning.contract(vertices, branches, keys, least_length, iterate, clusters)
        branches, least_length = branches.withColumn("slabs", F.lit(0).cast("bigint")), 0.0
    vertices, branches, culled = skeleton.prune(vertices, branches, keys, least_length)
    vertices, branches = written(vertices, "vertices"), written(branches, "branches")
    angles = skeleton.junction_angles(vertices, branches, keys, least_valence, most_valence)
    if margin:
        own = vertices.select(*keys, "vertex", *((F.col(k) / s).alias(k) for k, s in zip("xyz", spacing)))
        angles = angles.join(filters.margin(own, margin, shape).select(*keys, "vertex"), [*keys, "vertex"], "left_semi")
    return angles, culled
