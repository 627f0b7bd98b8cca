"""Measurements of particles: labelled voxels, any number of labels at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.operators import components, fits, mesh, moments, topology
from lamella.storage import written


def boxes(labels: DataFrame, keys: list[str], spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """keys, label, size, bounding box in voxels, and calibrated centroid (of voxel centres)."""
    made = [F.count(F.lit(1)).alias("size")]
    for i, k in enumerate("xyz"):
        made += [F.min(k).alias(f"min_{k}"), F.max(k).alias(f"max_{k}"), ((F.sum(k) / F.count(F.lit(1)) + 0.5) * spacing[i]).alias(f"c{k}")]
    return labels.groupBy(*keys, "label").agg(*made)


def tensors(labels: DataFrame, keys: list[str], spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """keys, label and the inertia tensor with its eigenvalues and axes."""
    return moments.principal_axes(moments.inertia_tensor(labels, [*keys, "label"], spacing), [*keys, "label"])


def aligned_boxes(labels: DataFrame, keys: list[str], spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """keys, label, centre and the lengths of the box along the particle's axes, longest first."""
    by = [*keys, "label"]
    axes = tensors(labels, keys, spacing).select(*by, *(f"v{i}{j}" for i in range(3) for j in range(3)))
    joined = labels.join(axes, by)
    dots = [sum(F.col(k) * spacing[i] * F.col(f"v{i}{j}") for i, k in enumerate("xyz")) for j in range(3)]
    ends = joined.groupBy(*by).agg(*(f(d).alias(f"{n}{j}") for j, d in enumerate(dots) for n, f in (("low", F.min), ("high", F.max))), *(F.first(f"v{i}{j}").alias(f"v{i}{j}") for i in range(3) for j in range(3)))
    mid = [(F.col(f"low{j}") + F.col(f"high{j}")) / 2 for j in range(3)]
    centre = [sum(F.col(f"v{i}{j}") * mid[j] for j in range(3)).alias(f"c{k}") for i, k in enumerate("xyz")]
    lengths = F.sort_array(F.array(*(F.col(f"high{j}") - F.col(f"low{j}") for j in range(3))), asc=False)
    return ends.select(*by, *centre, lengths.alias("lengths"))


def euler(labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, chi, cavities and holes; the particle's box is padded, so cavities are closed ones."""
    by = [*keys, "label"]
    chi = topology.euler(labels, by)
    box = labels.groupBy(*by).agg(*(f(k).alias(f"{n}{k}") for k in "xyz" for n, f in (("a", F.min), ("b", F.max))))
    for k in "xyz":
        box = box.withColumn(k, F.explode(F.sequence(F.col(f"a{k}") - 1, F.col(f"b{k}") + 1)))
    back = box.select(*by, *((F.col(k) + 1).alias(k) for k in "xyz"))
    own = labels.select(*by, *((F.col(k) + 1).alias(k) for k in "xyz"))
    back = back.join(own, [*by, "x", "y", "z"], "left_anti").withColumnRenamed("label", "particle_")
    found = components.connected_components(back, [*keys, "particle_"], 6)
    cavities = found.groupBy(*keys, F.col("particle_").alias("label")).agg((F.count_distinct("label") - 1).alias("cavities"))
    return chi.join(cavities, by).withColumn("holes", F.col("cavities") - F.col("chi") + 1)


def thickness(labels: DataFrame, thickness_map: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, mean (over the whole particle), sd (population) and max of thicknesses over 0."""
    t = F.when(F.col("thickness") > 0, F.col("thickness"))
    joined = labels.join(thickness_map.select(*keys, "x", "y", "z", "thickness"), [*keys, "x", "y", "z"], "left")
    made = joined.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"), F.sum(t).alias("s"), F.stddev_pop(t).alias("sd"), F.max(t).alias("max"))
    return made.select(*keys, "label", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mean"), F.coalesce("sd", F.lit(0.0)).alias("sd"), F.coalesce("max", F.lit(0.0)).alias("max"))


def surfaces(labels: DataFrame, keys: list[str], spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """keys, label, surface area and enclosed volume."""
    return mesh.surface(labels, [*keys, "label"], spacing)


def hull_directions(n: int = 64) -> np.ndarray:
    i = np.arange(n)
    z = 1 - (2 * i + 1) / n
    r, a = np.sqrt(1 - z * z), i * np.pi * (3 - np.sqrt(5))
    return np.stack([r * np.cos(a), r * np.sin(a), z], axis=1)


#: Points that a cell is to hold about, and cells along an axis at most.
CELL_POINTS, MOST_CELLS = 512, 16


def farthest(p: np.ndarray, q: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The largest distance between a point of p and one of q, and the two; of equal ones the first in order."""
    best = (-1.0, p[0], q[0])
    for at in range(0, len(p), 256):
        d = np.linalg.norm(p[at : at + 256, None] - q[None], axis=2)
        i, j = np.unravel_index(d.argmax(), d.shape)
        if d[i, j] > best[0]:
            best = (float(d[i, j]), p[at + i], q[j])
    return best


def feret(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, the largest distance between two of a key's distinct points, and its ends. Keys with under two points give none.

    Points that are extreme along no axis pair in their row of voxels are left out first. The others are dealt into cells of their key's
    box, more of them for more points. The ends of a key along fixed directions give a distance that is reached; only pairs of cells whose
    boxes allow for more are compared, a pair a group, so the points of a key meet in no single task."""
    points = points.select(*keys, *(F.col(k).cast("double").alias(k) for k in "xyz"))
    first, last = F.min("x").alias("low"), F.max("x").alias("high")
    ends = points.groupBy(*keys, "y", "z").agg(first, last)
    thin = ends.select(*keys, F.explode(F.array_distinct(F.array("low", "high"))).alias("x"), "y", "z")
    ends = thin.groupBy(*keys, "x", "z").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    thin = ends.select(*keys, "x", F.explode(F.array_distinct(F.array("low", "high"))).alias("y"), "z")
    own = written(thin, "points")
    place = F.struct("x", "y", "z")
    along = [sum(float(c) * F.col(k) for c, k in zip(u, "xyz")) for u in hull_directions(16)]
    box = [f(k).alias(f"{name}_{k}") for k in "xyz" for name, f in (("low", F.min), ("high", F.max))]
    whole = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *box, F.array(*(f(place, a) for a in along for f in (F.max_by, F.min_by))).alias("ends")).where("n > 1")
    apart = lambda p, q: F.sqrt(sum((p[k] - q[k]) * (p[k] - q[k]) for k in "xyz"))
    reached = F.array_max(F.transform("ends", lambda p: F.array_max(F.transform("ends", lambda q: apart(p, q)))))
    cells = F.least(F.lit(MOST_CELLS), F.ceil(F.sqrt(F.col("n") / CELL_POINTS))).cast("int")
    whole = written(whole.select(*keys, reached.alias("reached"), cells.alias("g"), *(f"{e}_{k}" for k in "xyz" for e in ("low", "high"))), "boxes")

    def cell(k: str):
        width = F.col(f"high_{k}") - F.col(f"low_{k}")
        return F.when(width > 0, F.least(F.col("g") - 1, F.floor((F.col(k) - F.col(f"low_{k}")) / width * F.col("g")))).otherwise(0)

    number = ((cell("x") * MOST_CELLS + cell("y")) * MOST_CELLS + cell("z")).cast("int")
    held = written(own.join(whole, keys).select(*keys, "x", "y", "z", number.alias("cell"), "reached"), "cells")
    boxes_ = held.groupBy(*keys, "cell", "reached").agg(*box)
    a = boxes_.select(*keys, F.col("cell").alias("a"), "reached", *(F.col(f"{e}_{k}").alias(f"a_{e}_{k}") for k in "xyz" for e in ("low", "high")))
    b = boxes_.select(*keys, F.col("cell").alias("b"), *(F.col(f"{e}_{k}").alias(f"b_{e}_{k}") for k in "xyz" for e in ("low", "high")))
    reach = [F.greatest(F.col(f"a_high_{k}") - F.col(f"b_low_{k}"), F.col(f"b_high_{k}") - F.col(f"a_low_{k}")) for k in "xyz"]
    pairs = a.join(b, keys).where("a <= b").where(F.sqrt(sum(r * r for r in reach)) >= F.col("reached") - 1e-9 * (1 + F.col("reached"))).select(*keys, "a", "b")
    sides = pairs.select(*keys, "a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("cell"))
    met = sides.join(held.drop("reached"), [*keys, "cell"])
    names = ["feret", "xa", "ya", "za", "xb", "yb", "zb"]

    def run(key, f):
        f = f.sort_values(["x", "y", "z"])
        p, q = (f.loc[f.cell == c, ["x", "y", "z"]].to_numpy() for c in key[-2:])
        d, i, j = farthest(p, q)
        i, j = sorted((tuple(i), tuple(j)))
        return pd.DataFrame([[*key[:-2], d, *i, *j]], columns=[*keys, *names])

    parts = "".join(f"`{k}` {points.schema[k].dataType.simpleString()}, " for k in keys)
    found = met.groupBy(*keys, "a", "b").applyInPandas(run, parts + ", ".join(f"{n} double" for n in names))
    best = F.max_by(F.struct(*names), F.struct("feret", *((-F.col(n)).alias(n) for n in names[1:]))).alias("e")
    return found.groupBy(*keys).agg(best).select(*keys, *(f"e.{n}" for n in names))


def ellipsoids(labels: DataFrame, keys: list[str], spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """keys, label, centre, radii and axes of the ellipsoid that fits the particle's surface mesh; nulls where none does."""
    by = [*keys, "label"]
    corners = mesh.mesh(labels, by, spacing)
    points = corners.select(*by, F.explode(F.array("v0", "v1", "v2")).alias("p")).select(*by, *(F.col(f"p.{k}").cast("double").alias(k) for k in "xyz")).distinct()
    return fits.fit_ellipsoids(points, by)


def analyse(fg: DataFrame, keys: list[str], spacing=(1.0, 1.0, 1.0), least: float = 0, most: float = float("inf"), shape=None, with_euler: bool = True, with_surface: bool = True, with_feret: bool = True, with_box: bool = True, with_ellipsoid: bool = True, image: tuple[int, int, int] | None = None, with_skeleton: bool = False) -> DataFrame:
    """One wide row per particle, numbered from 1 by its least position. shape: leave out particles at its bounds; image: the shape in
    which thickness is measured (none without it). Columns: box and centroid, tensor with its axes, bone_volume; surface: area,
    volume; Euler: chi, cavities, holes; feret; box along the axes: box_cx .. box_lengths; ellipsoid: ell_ra .. ; thickness with
    thickness_sd and thickness_max; skeleton: n_branches (0 where a particle thins to one voxel) and branch_length, of all of them."""
    from lamella.operators import distance, skeleton

    found = components.filter_particles(components.connected_components(fg, keys), keys, least, most, shape, float(np.prod(spacing)))
    labels = written(found, "particles")
    by = [*keys, "label"]
    out = labels.select(*by, "particle").distinct().join(boxes(labels, keys, spacing), by).join(tensors(labels, keys, spacing).drop("n", "mass"), by)
    if with_surface:
        out = out.join(surfaces(labels, keys, spacing), by, "left")
    if with_euler:
        out = out.join(euler(labels, keys), by, "left")
    if with_feret:
        points = labels.select(*by, *((F.col(k) * spacing[i]).alias(k) for i, k in enumerate("xyz")))
        out = out.join(feret(points, by).select(*by, "feret"), by, "left")
    if with_box:
        box = aligned_boxes(labels, keys, spacing)
        out = out.join(box.select(*by, *(F.col(k).alias(f"box_{k}") for k in ("cx", "cy", "cz", "lengths"))), by, "left")
    if with_ellipsoid:
        fitted = ellipsoids(labels, keys, spacing)
        out = out.join(fitted.select(*by, *(F.col(k).alias(f"ell_{k}") for k in ("cx", "cy", "cz", "ra", "rb", "rc"))), by, "left")
    if image:
        t = thickness(labels, distance.local_thickness(fg, keys, image), keys)
        out = out.join(t.select(*by, F.col("mean").alias("thickness"), F.col("sd").alias("thickness_sd"), F.col("max").alias("thickness_max")), by, "left")
    if with_skeleton:
        arms = skeleton.per_particle(labels, keys, spacing)
        out = out.join(arms.select(*by, F.col("branches").alias("n_branches"), "branch_length"), by, "left")
    return out.withColumn("bone_volume", F.col("size") * float(np.prod(spacing)))
