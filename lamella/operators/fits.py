"""Sphere, quadric and ellipsoid fits: sums of products over the points, then small dense algebra.

The sums are one partial aggregate for any number of point sets; what is solved per set is 4 x 4 or 9 x 9.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.operators.moments import signed

#: The monomials of a quadric: 1 is what their weighted sum equals.
QUADRIC = ("xx", "yy", "zz", "2xy", "2xz", "2yz", "2x", "2y", "2z")


def centroid(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.count(F.lit(1)).alias("n"))


def _monomial(name: str, centred: dict):
    factor, letters = (2.0, name[1:]) if name[0] == "2" else (1.0, name)
    out = factor * centred[letters[0]]
    return out * centred[letters[1]] if len(letters) > 1 else out


def quadric_sums(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, the centroid, and the sums of a quadric's normal equations about it (about the origin they lose digits)."""
    c = centroid(points, keys).select(*keys, *(F.col(k).alias(f"c{k}") for k in "xyz"))
    p = points.join(c, keys)
    centred = {k: F.col(k) - F.col(f"c{k}") for k in "xyz"}
    m = [_monomial(q, centred) for q in QUADRIC]
    made = [F.count(F.lit(1)).alias("n"), *(F.first(f"c{k}").alias(f"c{k}") for k in "xyz")]
    made += [F.sum(m[i] * m[j]).alias(f"a{i}{j}") for i in range(9) for j in range(i, 9)] + [F.sum(m[i]).alias(f"b{i}") for i in range(9)]
    return p.groupBy(*keys).agg(*made)


def solve_quadric(row: dict) -> np.ndarray:
    """The 4 x 4 matrix of the quadric from its sums; nine points at least."""
    if row["n"] < 9:
        raise ValueError("a quadric needs nine points")
    a = np.array([[row[f"a{min(i, j)}{max(i, j)}"] for j in range(9)] for i in range(9)])
    v = np.linalg.lstsq(a, np.array([row[f"b{i}"] for i in range(9)]), rcond=None)[0]
    return np.array([[v[0], v[3], v[4], v[6]], [v[3], v[1], v[5], v[7]], [v[4], v[5], v[2], v[8]], [v[6], v[7], v[8], -1.0]])


def quadric_to_ellipsoid(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(centre, radii rising, axes as columns) of a quadric, or None if it is no ellipsoid."""
    try:
        centre = np.linalg.solve(-q[:3, :3], q[:3, 3])
    except np.linalg.LinAlgError:
        return None
    t = np.eye(4)
    t[3, :3] = centre
    moved = t @ q @ t.T
    if abs(moved[3, 3]) < 1e-300:
        return None
    values, axes = np.linalg.eigh(moved[:3, :3] / -moved[3, 3])
    if not (values > 0).all():
        return None
    radii = 1 / np.sqrt(values)
    order = np.argsort(radii)
    return centre, radii[order], signed(axes[:, order])


FIT_COLUMNS = ["cx", "cy", "cz", "ra", "rb", "rc", *(f"v{i}{j}" for i in range(3) for j in range(3))]


def fit_ellipsoids(points: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """keys, n, centre, radii and axes of the algebraic fit of each point set; nulls where there is none (strict: an error)."""
    sums = quadric_sums(points, keys)
    parts = ", ".join(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames):
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                found = quadric_to_ellipsoid(solve_quadric(row)) if row["n"] >= 9 else None
                if found is None and strict:
                    raise ValueError("the points fit no ellipsoid")
                values = [None] * 15 if found is None else [*(found[0] + [row["cx"], row["cy"], row["cz"]]), *found[1], *found[2].ravel()]
                out.append([*(row[k] for k in keys), row["n"], *values])
            yield pd.DataFrame(out, columns=[*keys, "n", *FIT_COLUMNS])

    return sums.mapInPandas(run, f"{parts + ', ' if parts else ''}n bigint, " + ", ".join(f"{c} double" for c in FIT_COLUMNS))


def fit_spheres(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, centre and radius: the least-squares sphere, from sums about the centroid; nulls for under five points."""
    c = centroid(points, keys).select(*keys, *(F.col(k).alias(f"m{k}") for k in "xyz"))
    p = points.join(c, keys)
    d = {k: F.col(k) - F.col(f"m{k}") for k in "xyz"}
    r2 = d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"]
    made = [F.count(F.lit(1)).alias("n"), *(F.first(f"m{k}").alias(f"m{k}") for k in "xyz")]
    made += [F.sum(d[i] * d[j]).alias(f"s{i}{j}") for i, j in ("xx", "yy", "zz", "xy", "xz", "yz")] + [F.sum(r2 * d[k]).alias(f"r{k}") for k in "xyz"] + [F.sum(r2).alias("rr")]
    sums = p.groupBy(*keys).agg(*made)
    parts = ", ".join(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames):
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                if row["n"] < 5:
                    out.append([*(row[k] for k in keys), row["n"], *[None] * 4])
                    continue
                a = np.array([[row["s" + "".join(sorted(i + j))] for j in "xyz"] for i in "xyz"])
                at = np.linalg.lstsq(2 * a, np.array([row[f"r{k}"] for k in "xyz"]), rcond=None)[0]
                radius = float(np.sqrt(row["rr"] / row["n"] + at @ at))
                out.append([*(row[k] for k in keys), row["n"], *(at + [row["mx"], row["my"], row["mz"]]), radius])
            yield pd.DataFrame(out, columns=[*keys, "n", "cx", "cy", "cz", "radius"])

    return sums.mapInPandas(run, f"{parts + ', ' if parts else ''}n bigint, cx double, cy double, cz double, radius double")
