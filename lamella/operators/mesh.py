"""Surfaces of binary volumes by cells of 2 x 2 x 2 corners.

A cell's corners that are foreground are its configuration; the triangles of each of the 256 follow from one rule: on each face
of the cell, every run of foreground corners is cut off by a line from where the run ends to where it begins, and these lines
close to loops. A vertex lies on the foreground end of its cut edge, so areas and volumes of a cell are constants of its
configuration, and measuring a surface is one grouping by cell and sums of constants.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Faces as corners in turn, seen from outside; corner i is at (i & 1, i >> 1 & 1, i >> 2).
FACES = ((0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5))


def corner(i: int) -> np.ndarray:
    return np.array([i & 1, i >> 1 & 1, i >> 2], dtype=float)


def loops(config: int) -> list[list[tuple[int, int]]]:
    """Closed loops of cut edges (foreground corner, background corner) of a configuration."""
    inside = [bool(config >> i & 1) for i in range(8)]
    after: dict[tuple[int, int], tuple[int, int]] = {}
    for face in FACES:
        for k in range(4):
            a, b = face[k - 1], face[k]
            if not inside[a] and inside[b]:  # a run begins at b
                m = k
                while inside[face[(m + 1) % 4]]:
                    m += 1
                after[face[m % 4], face[(m + 1) % 4]] = (b, a)
    out = []
    while after:
        start = at = min(after)
        loop = []
        while at in after:
            loop.append(at)
            at = after.pop(at)
        out.append(loop)
    return out


@cache
def triangles(config: int) -> tuple[tuple[int, int, int], ...]:
    """Triangles of a configuration as foreground corners; those without an area are left out."""
    out = []
    for loop in loops(config):
        points = [edge[0] for edge in loop]
        for k in range(1, len(points) - 1):
            a, b, c = points[0], points[k], points[k + 1]
            if len({a, b, c}) == 3:
                out.append((a, b, c))
    return tuple(out)


@cache
def constants(spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]]:
    """For each configuration: area; and the volume's flux through z, as (per unit of the cell's height, rest)."""
    area, flux, rest = [], [], []
    s = np.array(spacing)
    for config in range(256):
        a = f = r = 0.0
        for t in triangles(config):
            p, q, w = (corner(i) * s for i in t)
            n = np.cross(q - p, w - p) / 2
            a += float(np.linalg.norm(n))
            f += float(n[2])
            r += float(n[2] * (p[2] + q[2] + w[2]) / 3)
        area.append(a)
        flux.append(f * spacing[2])
        rest.append(r)
    return tuple(area), tuple(flux), tuple(rest)


def cell_configs(fg: DataFrame, keys: list[str]) -> DataFrame:
    """keys, (x, y, z) of a cell's low corner, and its configuration, for cells with foreground."""
    out = fg.select(*keys, "x", "y", "z", F.explode(F.array(*map(F.lit, range(8)))).alias("corner"))
    low = [(F.col(k) - (F.shiftright("corner", i).bitwiseAND(1))).alias(k) for i, k in enumerate("xyz")]
    return out.select(*keys, *low, F.expr("shiftleft(1, corner)").alias("bit")).groupBy(*keys, "x", "y", "z").agg(F.bit_or("bit").alias("config"))


def _table(values) -> Column:
    return F.expr("array(" + ",".join(f"{v!r}D" for v in values) + ")")


def surface(fg: DataFrame, keys: list[str], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """keys, area and volume of the surface of each subspace or particle. Cells are counted by configuration and height first."""
    area, flux, rest = map(_table, constants(spacing))
    counted = cell_configs(fg, keys).groupBy(*keys, "z", "config").agg(F.count(F.lit(1)).alias("n"))
    at = F.col("config") + 1
    volume = F.sum(F.col("n") * (F.element_at(flux, at) * F.col("z") + F.element_at(rest, at)))
    return counted.groupBy(*keys).agg(F.sum(F.col("n") * F.element_at(area, at)).alias("area"), F.abs(volume).alias("volume"))


def surface_fraction(fg: DataFrame, keys: list[str], shape: tuple[int, int, int], spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """keys, bv, tv and ratio, from the meshes of the foreground and of the full image."""
    total = 1.0
    for n, s in zip(shape, spacing):
        total *= (n - 1) * s
    return surface(fg, keys, spacing).select(*keys, F.col("volume").alias("bv"), F.lit(total).alias("tv"), (F.col("volume") / total).alias("ratio"))


def mesh(fg: DataFrame, keys: list[str], spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """keys and the triangles (v0, v1, v2: x, y, z as float) of the surface; cells without triangles give none."""
    made = [triangles(c) for c in range(256)]
    table = F.expr("array(" + ",".join("array(" + ",".join(f"array({a},{b},{c})" for a, b, c in t) + ")" if t else "CAST(array() AS array<array<int>>)" for t in made) + ")")
    found = cell_configs(fg, keys).select(*keys, "x", "y", "z", F.explode(F.element_at(table, F.col("config") + 1)).alias("t"))

    def vertex(i: int) -> Column:
        at = F.element_at(F.col("t"), i + 1)
        return F.struct(*(((F.col(k) + F.shiftright(at, j).bitwiseAND(1)) * spacing[j]).cast("float").alias(k) for j, k in enumerate("xyz"))).alias(f"v{i}")

    return found.select(*keys, *(vertex(i) for i in range(3)))


def _cross(t: str = "") -> list[Column]:
    d = {f"{k}{i}": F.col(f"v{i}.{k}").cast("double") - F.col(f"v0.{k}").cast("double") for i in (1, 2) for k in "xyz"}
    return [d["y1"] * d["z2"] - d["z1"] * d["y2"], d["z1"] * d["x2"] - d["x1"] * d["z2"], d["x1"] * d["y2"] - d["y1"] * d["x2"]]


def mesh_area(triangles_: DataFrame, keys: list[str]) -> DataFrame:
    x, y, z = _cross()
    return triangles_.groupBy(*keys).agg((F.sum(F.sqrt(x * x + y * y + z * z)) / 2).alias("area"))


def mesh_volume(triangles_: DataFrame, keys: list[str]) -> DataFrame:
    x, y, z = _cross()
    return triangles_.groupBy(*keys).agg(F.abs(F.sum(F.col("v0.x").cast("double") * x + F.col("v0.y").cast("double") * y + F.col("v0.z").cast("double") * z) / 6).alias("volume"))
