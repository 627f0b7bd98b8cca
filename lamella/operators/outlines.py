"""Traced outlines of slices: the edges between foreground and background pixels, linked into ordered contours.

Each edge runs with the foreground on its left, and its successor is found by an equi-join at the vertex where it ends. Pointer doubling
then gives each edge its contour's least edge, and in a second pass its rank from there: a round is a join and doubles the reach, so a
contour of n edges takes log n rounds and meets in no single task. Outer contours run counter-clockwise and have a positive area, holes a
negative one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.operators.components import STRIDE
from lamella.storage import discard, written

#: Of the directions east, north, west and south: the pixel's neighbour that must be background, and where the edge begins.
_SIDES = ((0, -1, 0, 0), (1, 0, 1, 0), (0, 1, 1, 1), (-1, 0, 0, 1))
_STEPS = ((1, 0), (0, 1), (-1, 0), (0, -1))


def edges(fg: DataFrame, keys: list[str]) -> DataFrame:
    """keys, edge, d (direction), x, y (where it begins), ex, ey (where it ends) of the slices' outlines."""
    own = fg.select(*keys, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    sides = F.explode(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("d", "nx", "ny", "bx", "by", "sx", "sy"), (d, *side, *step)))) for d, (side, step) in enumerate(zip(_SIDES, _STEPS)))))
    out = own.select(*keys, "x", "y", sides.alias("s")).select(*keys, F.col("s.d").alias("d"), (F.col("x") + F.col("s.nx")).alias("ox"), (F.col("y") + F.col("s.ny")).alias("oy"), (F.col("x") + F.col("s.bx")).alias("x"), (F.col("y") + F.col("s.by")).alias("y"), F.col("s.sx").alias("sx"), F.col("s.sy").alias("sy"))
    out = out.join(own.select(*keys, F.col("x").alias("ox"), F.col("y").alias("oy")), [*keys, "ox", "oy"], "left_anti")
    number = (F.col("y").cast("bigint") * STRIDE + F.col("x")) * 4 + F.col("d")
    return out.select(*keys, number.alias("edge"), "d", "x", "y", (F.col("x") + F.col("sx")).alias("ex"), (F.col("y") + F.col("sy")).alias("ey"))


def successors(own: DataFrame, keys: list[str], connectivity: int = 8) -> DataFrame:
    """keys, edge, next. Where two pixels touch at a corner alone, outlines turn right (8: the two are connected) or left (4)."""
    if connectivity not in (4, 8):
        raise ValueError("pixels have 4 or 8 neighbours")
    after = own.select(*keys, F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("edge").alias("next"), F.col("d").alias("nd"))
    turn = F.pmod(F.col("nd") - F.col("d") + 1, F.lit(4))  # 0: right, 1: straight on, 2: left
    pick = F.min_by if connectivity == 8 else F.max_by
    return own.join(after, [*keys, "ex", "ey"]).groupBy(*keys, "edge").agg(pick("next", turn).alias("next"))


def _doubled(links: DataFrame, keys: list[str]) -> DataFrame:
    """keys, edge, contour: the least edge that an edge's successors lead to."""
    now = written(links.select(*keys, "edge", F.col("next").alias("to"), F.col("edge").alias("least")), "doubled")
    while True:
        ahead = now.select(*keys, F.col("edge").alias("to"), F.col("to").alias("to_"), F.col("least").alias("least_"))
        out = written(now.join(ahead, [*keys, "to"]).select(*keys, "edge", F.col("to_").alias("to"), F.least("least", "least_").alias("least"), (F.col("least_") < F.col("least")).alias("less")), "doubled")
        discard(now)
        now = out.drop("less")
        now.lm_path = out.lm_path
        if out.where("less").isEmpty():  # no window of successors holds less than the one before it: all are the contour's
            return now.select(*keys, "edge", F.col("least").alias("contour"))


def contours(fg: DataFrame, keys: list[str], connectivity: int = 8) -> DataFrame:
    """keys, contour (its least edge), rank (from 0), x, y: the ordered vertices of every outline; a written table."""
    own = written(edges(fg, keys), "outline")
    links = written(successors(own, keys, connectivity), "links")
    of = written(_doubled(links, keys), "contours")
    # from each edge to the end of its contour, which is before its least edge
    root = F.col("next") == F.col("contour")
    now = written(links.join(of, [*keys, "edge"]).select(*keys, "edge", "contour", F.when(~root, F.col("next")).alias("to"), F.lit(1).cast("bigint").alias("left")), "ranked")
    while not now.where("to is not null").isEmpty():
        ahead = now.select(*keys, F.col("edge").alias("to"), F.col("to").alias("to_"), F.col("left").alias("left_"))
        out = written(now.join(ahead, [*keys, "to"], "left").select(*keys, "edge", "contour", F.col("to_").alias("to"), (F.col("left") + F.coalesce("left_", F.lit(0))).alias("left")), "ranked")
        discard(now)
        now = out
    size = now.groupBy(*keys, "contour").agg(F.max("left").alias("size"))
    found = now.join(size, [*keys, "contour"]).select(*keys, "edge", "contour", (F.col("size") - F.col("left")).alias("rank"))
    out = written(own.join(found, [*keys, "edge"]).select(*keys, "contour", "rank", "x", "y", "ex", "ey"), "traced")
    discard(own, links, now)
    return out


def measured(traced: DataFrame, keys: list[str], spacing=(1.0, 1.0)) -> DataFrame:
    """keys, contour, edges, perimeter, area (negative for a hole) and hole of each outline."""
    sx, sy = spacing
    length = F.sum(F.abs(F.col("ex") - F.col("x")) * F.lit(float(sx)) + F.abs(F.col("ey") - F.col("y")) * F.lit(float(sy)))
    twice = F.sum(F.col("x").cast("bigint") * F.col("ey") - F.col("ex").cast("bigint") * F.col("y"))
    out = traced.groupBy(*keys, "contour").agg(F.count(F.lit(1)).alias("edges"), length.alias("perimeter"), (twice / 2 * float(sx * sy)).alias("area"))
    return out.withColumn("hole", F.col("area") < 0)


def oriented_diameters(traced: DataFrame, angles: DataFrame, keys: list[str], spacing=(1.0, 1.0)) -> DataFrame:
    """keys, along and across: the extents of each slice's outlines along the direction theta (keys, theta) and across it."""
    p, q = F.col("x") * float(spacing[0]), F.col("y") * float(spacing[1])
    along, across = p * F.cos("theta") + q * F.sin("theta"), q * F.cos("theta") - p * F.sin("theta")
    own = traced.join(angles.select(*keys, "theta").where("theta is not null"), keys)
    return own.groupBy(*keys).agg((F.max(along) - F.min(along)).alias("along"), (F.max(across) - F.min(across)).alias("across"))
