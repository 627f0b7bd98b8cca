"""Centroids, inertia and slice geometry: sums of products, so one partial aggregate per table and small algebra after it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_PLACE = -1.0  # where a centroid of no mass is
POWERS = ("x", "y", "z", "xx", "yy", "zz", "xy", "xz", "yz")


def raw_moments(voxels: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """keys, n, m (sum of weights) and sums of weighted products of positions: all that centroids and tensors need, in one
    pass, for any number of particles or subspaces."""
    w = F.lit(1).cast("bigint") if weight is None else weight
    made = [F.count(F.lit(1)).alias("n"), F.sum(w).alias("m")]
    for p in POWERS:
        made.append(F.sum(w * F.col(p[0]).cast("bigint") * (F.col(p[1]).cast("bigint") if len(p) > 1 else 1)).alias(f"s{p}"))
    return voxels.groupBy(*keys).agg(*made)


def centroid3d(voxels: DataFrame, keys: list[str], spacing=(1.0, 1.0, 1.0), weight: Column | None = None) -> DataFrame:
    """keys, n and the mass-weighted centroid; the third position counts slices from 1. Without mass it is NO_PLACE."""
    s = raw_moments(voxels, keys, weight)
    at = [(F.try_divide(f"s{k}", "m") + (1 if k == "z" else 0)) * spacing[i] for i, k in enumerate("xyz")]
    return s.select(*keys, "n", *(F.coalesce(a, F.lit(NO_PLACE)).alias(f"c{k}") for a, k in zip(at, "xyz")))


def inertia_tensor(voxels: DataFrame, keys: list[str], spacing=(1.0, 1.0, 1.0), weight: Column | None = None) -> DataFrame:
    """keys, n, mass and the tensor about the centroid (ixx .. iyz), each voxel with a moment of its own."""
    s = raw_moments(voxels, keys, weight)
    vx, vy, vz = spacing

    def about(a: str, b: str, u: float, v: float) -> Column:
        pair = "".join(sorted(a + b))
        return (F.col(f"s{pair}") - F.coalesce(F.try_divide(F.col(f"s{a}") * F.col(f"s{b}"), F.col("m")), F.lit(0.0))) * (u * v)

    xx, yy, zz = about("x", "x", vx, vx), about("y", "y", vy, vy), about("z", "z", vz, vz)
    own = [F.col("m") * ((p * p + q * q) / 12) for p, q in ((vy, vz), (vx, vz), (vx, vy))]
    made = {"ixx": yy + zz + own[0], "iyy": xx + zz + own[1], "izz": xx + yy + own[2], "ixy": -about("x", "y", vx, vy), "ixz": -about("x", "z", vx, vz), "iyz": -about("y", "z", vy, vz)}
    return s.select(*keys, "n", F.col("m").alias("mass"), *(v.alias(k) for k, v in made.items()))


def signed(vectors: np.ndarray) -> np.ndarray:
    """Columns with the largest part positive, so that equal tensors give equal axes."""
    at = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def principal_axes(tensors: DataFrame, keys: list[str]) -> DataFrame:
    """tensors with i1 >= i2 >= i3 and v00..v22, the axes in the order of rising inertia (the first is the long axis)."""
    extra = ["i1", "i2", "i3"] + [f"v{i}{j}" for i in range(3) for j in range(3)]

    def run(frames):
        for f in frames:
            t = np.empty((len(f), 3, 3))
            for (i, j), k in {(0, 0): "ixx", (1, 1): "iyy", (2, 2): "izz", (0, 1): "ixy", (0, 2): "ixz", (1, 2): "iyz"}.items():
                t[:, i, j] = t[:, j, i] = f[k].to_numpy(dtype=float)
            values, vectors = np.linalg.eigh(t) if len(f) else (np.empty((0, 3)), np.empty((0, 3, 3)))
            axes = np.stack([signed(v) for v in vectors]).reshape(len(f), 9) if len(f) else np.empty((0, 9))
            yield pd.concat([f.reset_index(drop=True), pd.DataFrame(np.hstack([values[:, ::-1], axes]), columns=extra)], axis=1)

    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in tensors.schema.fields), *(f"{k} double" for k in extra)])
    return tensors.mapInPandas(run, schema)


def ordered_axes(rows: DataFrame, extents: list[str] | tuple[str, str, str]) -> DataFrame:
    """rows with their axes (v00..v22, a column of the matrix each) in order of rising extents, as an alignment wants them: the shortest
    becomes x and the longest z; equal ones keep their order. Two axes turn where the z components would add up to less than 0 (the image
    upside down), and the first is reflected where the axes would be left-handed."""
    axes = F.array_sort(F.array(*(F.struct(F.col(e).cast("double").alias("e"), F.lit(j).alias("j"), F.array(*(F.col(f"v{i}{j}") for i in range(3))).alias("v")) for j, e in enumerate(extents))))
    names = [f"v{i}{j}" for i in range(3) for j in range(3)]
    out = rows.withColumn("axes_", axes).withColumns({f"w{i}{j}_": F.col("axes_")[j]["v"][i] for i in range(3) for j in range(3)})
    flipped = sum(F.col(f"w2{j}_") for j in range(3)) < 0
    out = out.withColumn("flipped_", flipped).withColumns({f"w{i}{j}_": F.when(F.col("flipped_"), -F.col(f"w{i}{j}_")).otherwise(F.col(f"w{i}{j}_")) for i in range(3) for j in (1, 2)})
    w = [[F.col(f"w{i}{j}_") for j in range(3)] for i in range(3)]
    det = sum(w[i][0] * (w[(i + 1) % 3][1] * w[(i + 2) % 3][2] - w[(i + 2) % 3][1] * w[(i + 1) % 3][2]) for i in range(3))
    out = out.withColumn("left_", det < 0).withColumns({f"w{i}0_": F.when(F.col("left_"), -F.col(f"w{i}0_")).otherwise(F.col(f"w{i}0_")) for i in range(3)})
    kept = [c for c in rows.columns if c not in names]
    return out.select(*kept, *(F.col(f"w{i}{j}_").alias(f"v{i}{j}") for i in range(3) for j in range(3)), F.col("flipped_").alias("z_flipped"), F.col("left_").alias("reflected"))


def slice_centroids(voxels: DataFrame, keys: list[str], spacing=(1.0, 1.0), weight: Column | None = None) -> DataFrame:
    """keys, z, n, csa, cx, cy and mean density of every slice."""
    s = raw_moments(voxels, [*keys, "z"], weight) if weight is not None else voxels.groupBy(*keys, "z").agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("m"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    return s.select(*keys, "z", "n", (F.col("n") * (spacing[0] * spacing[1])).alias("csa"), (F.col("sx") / F.col("m") * spacing[0]).alias("cx"), (F.col("sy") / F.col("m") * spacing[1]).alias("cy"), (F.col("m") / F.col("n")).alias("mean_density"))


def slice_moments(voxels: DataFrame, keys: list[str], spacing=(1.0, 1.0)) -> DataFrame:
    """keys, z and, about the slice's centroid: theta (its principal angle), imin, imax, ipm, r1, r2 (largest reach from
    the axes), z1, z2, zpol (null where a slice has no reach, as of one pixel). Two passes, the second joined to the angles of the first."""
    vx, vy = spacing
    area = vx * vy
    first = voxels.groupBy(*keys, "z").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(p[0]).cast("bigint") * (F.col(p[1]).cast("bigint") if len(p) > 1 else 1)).alias(f"s{p}") for p in ("x", "y", "xx", "yy", "xy")))
    own = F.col("n") / 12.0
    mxx = (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")) * (vy * vy) + own * (vy * vy)
    myy = (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")) * (vx * vx) + own * (vx * vx)
    mxy = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) * (vx * vy)
    first = first.select(*keys, "z", "n", (F.col("sx") / F.col("n") * vx).alias("cx"), (F.col("sy") / F.col("n") * vy).alias("cy"), mxx.alias("mxx"), myy.alias("myy"), mxy.alias("mxy"))
    root = F.sqrt((F.col("mxx") - F.col("myy")) * (F.col("mxx") - F.col("myy")) + 4 * F.col("mxy") * F.col("mxy"))
    angle = F.when(F.col("mxy") == 0, F.when(F.col("mxx") > F.col("myy"), np.pi / 2).otherwise(0.0)).otherwise(F.atan((F.col("mxx") - F.col("myy") + root) / (2 * F.col("mxy"))))
    first = first.withColumn("theta", angle)
    joined = voxels.select(*keys, "z", "x", "y").join(first, [*keys, "z"])
    dx, dy = F.col("x") * vx - F.col("cx"), F.col("y") * vy - F.col("cy")
    along, across = dx * F.cos("theta") + dy * F.sin("theta"), dy * F.cos("theta") - dx * F.sin("theta")
    second = joined.groupBy(*keys, "z").agg(F.first("n").alias("n"), F.first("theta").alias("theta"), F.sum(across * across).alias("s1"), F.sum(along * along).alias("s2"), F.sum(along * across).alias("sp"), F.max(F.abs(across)).alias("r1"), F.max(F.abs(along)).alias("r2"))
    moment = F.col("n") * (area / 12)  # of the voxels themselves, of unit sides
    i1, i2, ip = F.col("s1") * area + moment, F.col("s2") * area + moment, F.col("sp") + moment
    return second.select(*keys, "z", "theta", F.least(i1, i2).alias("imin"), F.greatest(i1, i2).alias("imax"), ip.alias("ipm"), "r1", "r2", F.try_divide(i1, F.col("r1")).alias("z1"), F.try_divide(i2, F.col("r2")).alias("z2"), F.try_divide(i1 + i2, F.sqrt(F.col("r1") * F.col("r1") + F.col("r2") * F.col("r2"))).alias("zpol"))


def aligned_size(voxels: DataFrame, axes: np.ndarray, centroid: np.ndarray, spacing=(1.0, 1.0, 1.0), keys: Sequence[str] = ()) -> DataFrame:
    """keys, and how many voxels of the least side an image along the principal axes needs."""
    side = min(spacing)
    reach = [F.max(F.abs(sum((F.col(k) * spacing[i] - float(centroid[i])) * float(axes[i, j]) for i, k in enumerate("xyz")))) for j in range(3)]
    return voxels.groupBy(*keys).agg(*((F.floor(2 * r / side) + 5).alias(f"n{k}") for r, k in zip(reach, "xyz")))


def aligned(voxels: DataFrame, axes: np.ndarray, centroid: np.ndarray, size: tuple[int, int, int], spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """The image along its principal axes, by nearest neighbours: every target voxel computes its source, and one equi-join fetches it."""
    side = min(spacing)
    target = voxels.sparkSession.range(size[0] * size[1] * size[2])
    w, h = size[0], size[1]
    target = target.select((F.col("id") % w).cast("int").alias("x"), (F.floor(F.col("id") / w) % h).cast("int").alias("y"), F.floor(F.col("id") / (w * h)).cast("int").alias("z"))
    off = [(F.col(k) - size[i] // 2) * side for i, k in enumerate("xyz")]
    source = [F.floor((sum(off[j] * float(axes[i, j]) for j in range(3)) + float(centroid[i])) / spacing[i] + 0.5).cast("int").alias(f"{k}_") for i, k in enumerate("xyz")]
    found = target.select("x", "y", "z", *source)
    own = voxels.select(*(F.col(k).cast("int").alias(f"{k}_") for k in "xyz"), *(c for c in voxels.columns if c not in "xyz"))
    return found.join(own, ["x_", "y_", "z_"]).drop("x_", "y_", "z_")


def slice_outline(voxels: DataFrame, keys: list[str], spacing=(1.0, 1.0)) -> DataFrame:
    """keys, z, perimeter (of pixel edges between foreground and background), largest and least caliper widths and the angle of
    the largest. Only the first and last pixel of a row reach the task that turns a slice's calipers."""
    vx, vy = spacing
    own = voxels.select(*keys, "z", "x", "y")
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(side)).alias("side")) for dx, dy, side in ((1, 0, vy), (-1, 0, vy), (0, 1, vx), (0, -1, vx))))
    near = own.select(*keys, "z", F.explode(steps).alias("s"), "x", "y").select(*keys, "z", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), "s.side")
    perimeter = near.join(own, [*keys, "z", "x", "y"], "left_anti").groupBy(*keys, "z").agg(F.sum("side").alias("perimeter"))
    ends = own.groupBy(*keys, "z", "y").agg(F.min("x").alias("low"), (F.max("x") + 1).alias("high"))
    corner = F.array(*(F.struct(F.col(a).alias("x"), b.alias("y")) for a in ("low", "high") for b in (F.col("y"), F.col("y") + 1)))
    corners = ends.select(*keys, "z", F.explode(corner).alias("p")).select(*keys, "z", "p.x", "p.y")
    parts = ", ".join(f"`{k}` {voxels.schema[k].dataType.simpleString()}" for k in [*keys, "z"])

    def run(key, f):
        p = np.unique(f[["x", "y"]].to_numpy(dtype=float), axis=0) * [vx, vy]
        hull = _hull(p)
        edges = np.roll(hull, -1, axis=0) - hull
        normals = np.stack([-edges[:, 1], edges[:, 0]], axis=1) / np.linalg.norm(edges, axis=1, keepdims=True)
        least = float(((hull @ normals.T).max(axis=0) - (hull @ normals.T).min(axis=0)).min())
        d = np.linalg.norm(hull[:, None] - hull[None], axis=2)
        i, j = np.unravel_index(d.argmax(), d.shape)
        angle = float(np.arctan2(hull[j, 1] - hull[i, 1], hull[j, 0] - hull[i, 0]) % np.pi)
        return pd.DataFrame([[*key, float(d[i, j]), least, angle]], columns=[*keys, "z", "feret_max", "feret_min", "feret_angle"])

    widths = corners.groupBy(*keys, "z").applyInPandas(run, parts + ", feret_max double, feret_min double, feret_angle double")
    return perimeter.join(widths, [*keys, "z"])


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    return float((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))


def _hull(points: np.ndarray) -> np.ndarray:
    """The convex hull of points in rising order, against the clock."""

    def half(order) -> list:
        out: list = []
        for p in order:
            while len(out) > 1 and _turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]))


def slice_moments_about(voxels: DataFrame, keys: list[str], theta: float, spacing=(1.0, 1.0)) -> DataFrame:
    """keys, z and, about an axis of the user's through each slice's centroid at the angle theta and the axis across it: the second
    moments i1 and i2, the largest reaches r1 and r2 from them, and the section moduli z1 and z2 (null without reach)."""
    vx, vy = spacing
    area = float(vx * vy)
    centre = voxels.groupBy(*keys, "z").agg(F.count(F.lit(1)).alias("n_"), F.avg("x").alias("cx_"), F.avg("y").alias("cy_"))
    x, y = (F.col("x") - F.col("cx_")) * float(vx), (F.col("y") - F.col("cy_")) * float(vy)
    across, along = y * float(np.cos(theta)) - x * float(np.sin(theta)), x * float(np.cos(theta)) + y * float(np.sin(theta))
    c2, s2 = float(np.cos(theta) ** 2), float(np.sin(theta) ** 2)
    own = F.first("n_") / 12.0 * area  # of the pixels themselves
    out = voxels.join(centre, [*keys, "z"]).groupBy(*keys, "z").agg(
        (F.sum(across * across) * area + own * (vy * vy * c2 + vx * vx * s2)).alias("i1"), (F.sum(along * along) * area + own * (vx * vx * c2 + vy * vy * s2)).alias("i2"), F.max(F.abs(across)).alias("r1"), F.max(F.abs(along)).alias("r2")
    )
    return out.withColumns({f"z{k}": F.when(F.col(f"r{k}") > 0, F.col(f"i{k}") / F.col(f"r{k}")) for k in (1, 2)})


def orientation_quadrant(theta: float, labels: tuple[str, str, str, str] = ("right", "up", "left", "down")) -> str:
    """The axis label that a direction (radians) points nearest to."""
    return labels[int(np.floor(((theta % (2 * np.pi)) + np.pi / 4) / (np.pi / 2))) % 4]
