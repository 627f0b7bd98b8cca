"""Scalar geometry: distances, products, ellipsoids, directions, labels of bones. Columns where built-ins do, numpy else."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def distance3d(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum((p - q) * (p - q) for p, q in zip(a, b)))


def cross(a: tuple, b: tuple) -> tuple:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def ellipsoid_volume(a: Column, b: Column, c: Column) -> Column:
    return a * b * c * (4 * np.pi / 3)


def golden_spirals(rows: DataFrame, n: str) -> DataFrame:
    """rows with i and (x, y, z): for each row as many directions as its column n tells, evenly over the sphere; the same for the same n."""
    out = rows.withColumn("i", F.explode(F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("bigint"), F.col(n).cast("bigint") - 1))))
    z = 1 - (2 * F.col("i") + 1) / F.col(n)
    angle = F.col("i") * (np.pi * (3 - np.sqrt(5)))
    r = F.sqrt(1 - z * z)
    return out.select(*rows.columns, "i", (r * F.cos(angle)).alias("x"), (r * F.sin(angle)).alias("y"), z.alias("z"))


def golden_spiral(spark: SparkSession, n: int) -> DataFrame:
    """i and (x, y, z) of n directions."""
    return golden_spirals(spark.range(1).select(F.lit(n).alias("n")), "n").drop("n")


def random_vectors(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """i and unit vectors (x, y, z), evenly spread; one per number and seed, whatever the partitions."""

    def uniform(k: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 52)) / float(1 << 52)

    z, angle = uniform(0) * 2 - 1, uniform(1) * (2 * np.pi)
    r = F.sqrt(1 - z * z)
    return spark.range(n).select(F.col("id").alias("i"), (r * F.cos(angle)).alias("x"), (r * F.sin(angle)).alias("y"), z.alias("z"))


def ellipsoid_tensor(radii: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The matrix of an ellipsoid's quadratic form; axes are columns."""
    return axes @ np.diag(1.0 / np.asarray(radii, dtype=float) ** 2) @ axes.T


def ellipsoid_bounds(radii: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Half the sides of the ellipsoid's axis-aligned box."""
    return np.sqrt(((axes * np.asarray(radii)) ** 2).sum(axis=1))


def ellipsoid_points(radii: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n points evenly spread over an ellipsoid's surface, by rejection."""
    a, b, c = np.asarray(radii, dtype=float)
    out = np.empty((0, 3))
    most = max(b * c, a * c, a * b)
    while len(out) < n:
        v = rng.normal(size=(2 * n, 3))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        mu = np.sqrt((a * c * v[:, 1]) ** 2 + (a * b * v[:, 2]) ** 2 + (b * c * v[:, 0]) ** 2)
        out = np.vstack([out, (v * [a, b, c])[rng.random(len(v)) * most <= mu]])
    return out[:n]


@dataclass(frozen=True)
class Ellipsoid:
    """An ellipsoid of rising radii whose axes are the columns of a rotation; anything else raises ValueError."""

    centre: tuple[float, float, float]
    radii: tuple[float, float, float]
    axes: tuple[tuple[float, float, float], ...] = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))

    def __post_init__(self):
        radii, axes = np.asarray(self.radii, dtype=float), np.asarray(self.axes, dtype=float)
        if not (np.isfinite(radii).all() and np.isfinite(self.centre).all() and np.isfinite(axes).all()):
            raise ValueError("an ellipsoid's numbers are finite")
        if radii[0] <= 0 or (np.diff(radii) < 0).any():
            raise ValueError("radii are more than nothing, and rise")
        if np.abs(axes.T @ axes - np.eye(3)).max() > 1e-12:
            raise ValueError("axes are of unit length and at right angles")

    @property
    def volume(self) -> float:
        return 4 * np.pi / 3 * float(np.prod(self.radii))

    def contains(self, points: np.ndarray) -> np.ndarray:
        d = np.asarray(points, dtype=float) - self.centre
        return ((d @ ellipsoid_tensor(self.radii, np.asarray(self.axes))) * d).sum(axis=-1) <= 1

    def dilated(self, by: float) -> Ellipsoid:
        """With radii longer by so much (shorter, if it is negative)."""
        return Ellipsoid(self.centre, tuple(r + by for r in self.radii), self.axes)

    def turned(self, rotation: np.ndarray) -> Ellipsoid:
        return Ellipsoid(self.centre, self.radii, tuple(map(tuple, rotation @ np.asarray(self.axes))))

    def surface(self, n: int, rng: np.random.Generator, noise: float = 0.0) -> np.ndarray:
        """n points evenly spread over the surface, each moved by normal noise of that deviation along each axis."""
        points = ellipsoid_points(np.asarray(self.radii), n, rng) @ np.asarray(self.axes).T + self.centre
        return points + rng.normal(scale=noise, size=points.shape) if noise else points


def distance_to_ellipsoid(point: np.ndarray, radii: np.ndarray, tolerance: float = 1e-12, most: int = 200) -> float:
    """The distance from a point (in the ellipsoid's own frame) to its surface: the root of the multiplier's equation."""
    r2 = np.asarray(radii, dtype=float) ** 2
    p = np.abs(np.asarray(point, dtype=float))
    if not p.any():
        return float(np.sqrt(r2.min()))
    low = -r2.min() + 1e-300
    high = max(1.0, float(np.linalg.norm(p) * np.sqrt(r2.max())))

    def over(t: float) -> float:
        return float((r2 * p * p / (r2 + t) ** 2).sum() - 1)

    low = -r2.min() * (1 - 1e-15)
    if over(low) < 0:  # on the plane of the least radius, within its focal ellipse
        at = int(r2.argmin())
        rest = np.where(np.arange(3) == at, 0.0, r2 * p / np.where(np.arange(3) == at, 1.0, r2 - r2.min()))
        rest[at] = np.sqrt(max(0.0, r2.min() * (1 - (rest**2 / r2).sum())))
        return float(np.linalg.norm(rest - p))
    while over(high) > 0:
        high *= 2
    for _ in range(most):
        t = (low + high) / 2
        low, high = (t, high) if over(t) > 0 else (low, t)
        if high - low <= tolerance * max(1.0, abs(t)):
            break
    return float(np.linalg.norm(r2 * p / (r2 + (low + high) / 2) - p))


def right_handed(axes: np.ndarray) -> bool:
    return bool(np.linalg.det(axes) > 0)


def voxel_depth(first: float, last: float, slices: int) -> float:
    """The spacing of slices by the positions in their headers."""
    return (abs(last - first) + 1) / slices


#: The names of bones that are looked for in an image's title; of several the last one counts.
BONES = (
    "unknown", "scapula", "humerus", "radius", "ulna", "metacarpal", "pelvis", "femur", "tibia", "fibula",
    "metatarsal", "calcaneus", "tibiotarsus", "tarsometatarsal", "sacrum", "mandible", "clavicle", "rib", "ilium", "os_penis",
    "os_clitoridis", "coracoid", "proximal_phalanx", "distal_phalanx", "middle_phalanx", "intermediate_phalanx", "basihyoid", "ceratohyoid", "epihyoid", "thyrohyoid",
    "stylohyoid", "tympanohyoid", "malleus", "incus", "stapes", "columella", "ischium", "patella", "talus",
)


def bone_id(name: Column, bones=BONES) -> Column:
    """The index of a bone's exact name, 0 if it is none."""
    return F.greatest(F.lit(0), F.coalesce(F.array_position(F.array(*map(F.lit, bones)), name), F.lit(0)) - 1)


def guess_bone(title: Column, bones=BONES) -> Column:
    """The index of the bone that a title names, 0 if none."""
    out = F.lit(0)
    for i, name in enumerate(bones):
        out = F.when(F.lower(title).contains(name), i).otherwise(out)
    return out


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def stl_name(name: str, subspace: str) -> str:
    return re.sub(r"\.[^.]*$", "", name) + "_" + re.sub(r"[,:]", "", subspace).replace(" ", "_") + ".stl"
