"""Euler characteristic and connectivity.

The characteristic of a union of closed voxels is the signed count of its distinct cells: vertices less edges plus
faces less solids. A voxel has 27 cells at doubled coordinates, whose parities tell the dimension; one grouping makes
them distinct, so there is no neighbour join, and any number of subspaces or particles is measured at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _steps(n: int) -> Column:
    return F.array(*(F.lit(i) for i in range(n)))


def cells(fg: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the distinct cells (cx, cy, cz) of foreground voxels."""
    out = fg.select(*keys, "x", "y", "z")
    for k in "xyz":
        out = out.withColumn(f"i{k}", F.explode(_steps(3)))
    return out.select(*keys, *((F.col(k) * 2 + F.col(f"i{k}")).alias(f"c{k}") for k in "xyz")).distinct()


def euler(fg: DataFrame, keys: list[str]) -> DataFrame:
    """keys and chi. Odd coordinates are the cell's dimensions."""
    odd = sum(F.col(f"c{k}") % 2 for k in "xyz")
    return cells(fg, keys).groupBy(*keys).agg(F.sum(F.when(odd % 2 == 0, 1).otherwise(-1)).cast("bigint").alias("chi"))


def edge_counts(fg: DataFrame, keys: list[str], shape: tuple[int, int, int]) -> DataFrame:
    """keys and chi0, chi1, chi2: the Euler characteristics of the foreground's meeting with the corners, the edges (corners
    among them) and the whole surface of the stack, from one pass over the cells there. Along an axis of one voxel both of
    its planes are surface."""
    planes = {k: (0, 2 * n) for k, n in zip("xyz", shape)}
    at = sum(F.when(F.col(f"c{k}").isin(*e), 1).otherwise(0) for k, e in planes.items())
    odd = sum(F.col(f"c{k}") % 2 for k in "xyz")
    found = cells(fg, keys).select(*keys, at.alias("on"), F.when(odd % 2 == 0, 1).otherwise(-1).alias("sign")).where("on > 0")
    return found.groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(F.col("on") >= n, F.col("sign"))), F.lit(0)).cast("bigint").alias(f"chi{3 - n}") for n in (3, 2, 1)))


def connectivity(fg: DataFrame, keys: list[str], shape: tuple[int, int, int], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """keys, chi, delta_chi (chi corrected for the border), connectivity and conn_density."""
    w, h, d = shape
    volume = w * h * d * spacing[0] * spacing[1] * spacing[2]
    out = euler(fg, keys).join(edge_counts(fg, keys, shape), keys, "left").na.fill(0, ["chi0", "chi1", "chi2"])
    delta = F.col("chi") - (F.col("chi2") / 2 + F.col("chi1") / 4 + F.col("chi0") / 8)
    return out.select(*keys, "chi", "chi0", "chi1", "chi2", delta.alias("delta_chi"), (1 - delta).alias("connectivity"), ((1 - delta) / volume).alias("conn_density"))


def outline(fg: DataFrame, keys: list[str], shape: tuple[int, int, int] | None = None) -> DataFrame:
    """Foreground voxels with a background neighbour among 26; with a shape, neighbours beyond it don't count."""
    out = fg.select(*keys, "x", "y", "z")
    for k in "xyz":
        out = out.withColumn(f"o{k}", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    near = out.select(*keys, *((F.col(k) + F.col(f"o{k}")).alias(k) for k in "xyz"))
    full = near.groupBy(*keys, "x", "y", "z").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.lit(27)
    if shape:
        span = [F.lit(3) - F.when(F.col(k) == 0, 1).otherwise(0) - F.when(F.col(k) == n - 1, 1).otherwise(0) for k, n in zip("xyz", shape)]
        wanted = span[0] * span[1] * span[2]
    return fg.select(*keys, "x", "y", "z").join(full.where(F.col("n") < wanted), [*keys, "x", "y", "z"], "left_semi")
