"""Box counts and the fractal dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def box_sizes(start: int, least: int, factor: float) -> list[int]:
    """start, then each divided by factor (whole, and at least one less), down to least."""
    if factor <= 1:
        raise ValueError("a scaling factor is over 1")
    out, size = [], start
    while size >= least and size >= 1:
        out.append(size)
        size = min(size - 1, int(size / factor))
    return out


def auto_parameters(shape) -> tuple[int, int, float]:
    """Start size, least size and factor from the longest side."""
    return max(1, max(shape) // 4), 6, 1.2


def box_counts(fg: DataFrame, keys: list[str], sizes: list[int], translations: int = 0) -> DataFrame:
    """keys, size, n: boxes with foreground, the least over moved grids. Sizes are exploded, so one grouping counts all."""
    moves = list(range(0, translations + 1))
    out = fg.select(*keys, "x", "y", "z", F.explode(F.array(*map(F.lit, sizes))).alias("size"), F.lit(0).alias("move"))
    if translations:
        out = out.select(*keys, "x", "y", "z", "size", F.explode(F.array(*map(F.lit, moves))).alias("move")).where("move < size")
    box = out.select(*keys, "size", "move", *(F.floor((F.col(k) + F.col("move")) / F.col("size")).alias(f"b{k}") for k in "xyz")).distinct()
    return box.groupBy(*keys, "size", "move").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys, "size").agg(F.min("n").alias("n"))


def fractal_dimension(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, dimension (0 where there is no line) and r2, by the line through (-ln size, ln n)."""
    x, y = -F.log("size"), F.log("n")
    found = counts.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"))
    return found.select(*keys, F.coalesce(F.when(F.isnan("slope"), 0.0).otherwise(F.col("slope")), F.lit(0.0)).alias("dimension"), "r2")
