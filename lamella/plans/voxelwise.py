"""Measurements of single voxels, crops, thresholds, lines and fits over the volumes of the driver's tables, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import geometry
from lamella.operators import components, distance, filters, fits, mil, moments
from lamella.plans.measures import H, D, W, _points, query, r6
from lamella.sources.tables import CELL_SQL, FOREGROUND_SQL, GRAINS_SQL, SHAPE, foreground, grains, voxelize

#: Background of each channel, and the squared distances between two phases of the volume.
BACKGROUND_SQL = """bg AS (SELECT c.c, x.x, y.y, z.z FROM (SELECT DISTINCT c FROM fg) c, (SELECT unnest(range(50)) AS x) x, (SELECT unnest(range(11)) AS y) y, (SELECT unnest(range(9)) AS z) z
  WHERE NOT EXISTS (SELECT 1 FROM fg WHERE fg.c = c.c AND fg.x = x.x AND fg.y = y.y AND fg.z = z.z))"""


def thickness_sql(inside: str, outside: str) -> str:
    """t: the local thickness of a phase."""
    return f"""e AS (SELECT i.c, i.x, i.y, i.z, min((i.x - o.x) ** 2 + (i.y - o.y) ** 2 + (i.z - o.z) ** 2) AS d2 FROM {inside} i JOIN {outside} o ON o.c = i.c GROUP BY ALL),
    t AS (SELECT p.c, p.x, p.y, p.z, max(2 * sqrt(s.d2)) AS thickness FROM {inside} p JOIN e s ON s.c = p.c AND (p.x - s.x) ** 2 + (p.y - s.y) ** 2 + (p.z - s.z) ** 2 < s.d2 GROUP BY ALL)"""


@query(f"""WITH {CELL_SQL} SELECT c, x, y, z FROM cell WHERE value % 3 <> 0""")
def as_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.as_bits(voxelize(spark, sf_dir).withColumn("value", F.col("value") % 3)).select("c", "x", "y", "z")


@query(f"""WITH {CELL_SQL} SELECT c, x, y, z, value FROM cell WHERE value BETWEEN 4 AND 7""")
def threshold_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.threshold(voxelize(spark, sf_dir), 4, 7)


@query(f"""WITH {CELL_SQL} SELECT c, x, y, z, round(value * 1.5 - 1000, 6)::DOUBLE AS units, value::DOUBLE AS raw FROM cell""")
def hounsfield_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = filters.calibrated(F.col("value"), 1.5, -1000.0)
    return voxelize(spark, sf_dir).select("c", "x", "y", "z", r6(units).alias("units"), r6(filters.raw_value(units, 1.5, -1000.0)).alias("raw"))


@query(f"""WITH {CELL_SQL} SELECT c, x, y, z, round(greatest(0.0, value * 4000 * 0.5 + (100 - 32768 * 0.5)), 6)::DOUBLE AS density FROM cell""")
def scanner_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    slope, constant, unit = filters.density_calibration(2.0, 100.0, 4.0)
    return voxelize(spark, sf_dir).select("c", "x", "y", "z", r6(filters.voxel_density(F.col("value") * 4000, slope, constant, unit)).alias("density"))


@query(f"""WITH {CELL_SQL} SELECT c, count(*) FILTER (x - 5 BETWEEN 0 AND 39 AND y - 1 BETWEEN 0 AND 8 AND z BETWEEN 0 AND 6) AS inside, count(*) AS n FROM cell GROUP BY c""")
def in_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = filters.within(F.col("x") - 5, F.col("y") - 1, F.col("z"), (40, 9, 7))
    return voxelize(spark, sf_dir).groupBy("c").agg(F.count_if(inside).alias("inside"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CELL_SQL} SELECT c, x - 21 AS x, y - 1 AS y, z AS z, value FROM cell WHERE x BETWEEN 21 AND 28 AND y BETWEEN 1 AND 8 AND z BETWEEN 0 AND 7""")
def crop_outer_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.outer_cube(voxelize(spark, sf_dir), (25.0, 5.0, 4.0), 4.5, 0.8, SHAPE)


@query(f"""WITH {CELL_SQL} SELECT c, x - 19 AS x, y + 1 AS y, z + 2 AS z, value FROM cell WHERE (x - 25) ** 2 + (y - 5) ** 2 + (z - 4) ** 2 <= 12.96""")
def crop_padded_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.sphere(voxelize(spark, sf_dir), (25.0, 5.0, 4.0), 4.5, 0.8, 2)


@query(f"""WITH {CELL_SQL} SELECT c, x, y, z FROM cell WHERE x BETWEEN 2 AND 47 AND y BETWEEN 2 AND 8 AND z BETWEEN 2 AND 6""")
def margin_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.margin(voxelize(spark, sf_dir).select("c", "x", "y", "z"), 2, SHAPE)


@query(f"""WITH {CELL_SQL} SELECT c, count(*) FILTER (value % 5 <> 0 AND value % 7 <> 0) AS n FROM cell GROUP BY c""")
def finite_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    odd = F.when(v % 5 == 0, F.lit(float("nan"))).when(v % 7 == 0, F.lit(float("inf"))).otherwise(v.cast("double"))
    return voxelize(spark, sf_dir).groupBy("c").agg(F.count_if(filters.finite(odd)).alias("n"))


@query(f"""WITH {CELL_SQL}, h AS (SELECT c, value AS v, count(*) AS n FROM cell GROUP BY c, value), ends AS (SELECT c, min(v) AS low, max(v) AS high FROM h GROUP BY c),
level AS (SELECT e.c, e.high, u.l FROM ends e, LATERAL (SELECT unnest(range(e.low, e.high)) AS l) u),
mean AS (SELECT l.c, l.high, l.l, sum(h.v * h.n) FILTER (h.v <= l.l) / sum(h.n) FILTER (h.v <= l.l) AS a, sum(h.v * h.n) FILTER (h.v > l.l) / sum(h.n) FILTER (h.v > l.l) AS b FROM level l JOIN h ON h.c = l.c GROUP BY ALL)
SELECT c, min(l)::DOUBLE AS low, any_value(high)::DOUBLE AS high FROM mean WHERE l + 1 > (a + b) / 2 GROUP BY c""")
def default_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.default_thresholds(filters.stack_histogram(voxelize(spark, sf_dir), ["c"]), ["c"])


@query("""WITH s AS (SELECT l_suppkey AS seed, round(sum(l_quantity)) AS size FROM lineitem GROUP BY l_suppkey)
SELECT seed FROM (SELECT seed, row_number() OVER (ORDER BY seed) - 1 AS n FROM s) WHERE n % 4 = 1""")
def seed_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamella.sources.tables import table

    seeds = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("seed")).distinct()
    return filters.skip_seeds(seeds, 4, 1, ["seed"])


@query(f"""WITH {FOREGROUND_SQL}, side AS (SELECT unnest([[1, 0], [-1, 0], [0, 1], [0, -1]]) AS d)
SELECT a.c, a.z, sum(CASE WHEN d[1] <> 0 THEN 0.25 ELSE 0.5 END)::DOUBLE AS perimeter FROM fg a, side
WHERE NOT EXISTS (SELECT 1 FROM fg b WHERE b.c = a.c AND b.z = a.z AND b.x = a.x + d[1] AND b.y = a.y + d[2]) GROUP BY a.c, a.z""")
def slice_perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments.slice_outline(foreground(spark, sf_dir), ["c"], (0.5, 0.25)).select("c", "z", "perimeter")


@query(f"""WITH {FOREGROUND_SQL}, s AS (SELECT c, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM fg GROUP BY c),
p AS (SELECT c, any_value(n) AS n, sum((x - mx) ** 2) AS xx, sum((y - my) ** 2) AS yy, sum((z - mz) ** 2) AS zz, -sum((x - mx) * (y - my)) AS xy, -sum((x - mx) * (z - mz)) AS xz, -sum((y - my) * (z - mz)) AS yz FROM fg JOIN s USING (c) GROUP BY c),
i AS (SELECT c, (yy + zz + n / 6) / n AS a, (xx + zz + n / 6) / n AS b, (xx + yy + n / 6) / n AS d, xy / n AS xy, xz / n AS xz, yz / n AS yz FROM p)
SELECT c, round(a + b + d, 6) AS trace, round(a * b + a * d + b * d - xy * xy - xz * xz - yz * yz, 4) AS minors,
  round(a * (b * d - yz * yz) - xy * (xy * d - yz * xz) + xz * (xy * yz - b * xz), 3) AS determinant FROM i""")
def principal_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invariants of the tensor, a voxel, from its principal moments."""
    found = moments.principal_axes(moments.inertia_tensor(foreground(spark, sf_dir), ["c"]), ["c"])
    a, b, d = (F.col(k) / F.col("n") for k in ("i1", "i2", "i3"))
    return found.select("c", r6(a + b + d).alias("trace"), F.round(a * b + a * d + b * d, 4).alias("minors"), F.round(a * b * d, 3).alias("determinant"))


@query("""WITH p AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
m AS (SELECT label, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM p GROUP BY label),
q AS (SELECT label, x - mx AS x, y - my AS y, z - mz AS z FROM p JOIN m USING (label)),
v AS (SELECT label, [x * x, y * y, z * z, 2 * x * y, 2 * x * z, 2 * y * z, 2 * x, 2 * y, 2 * z] AS m FROM q),
i AS (SELECT unnest(range(1, 10)) AS i), j AS (SELECT unnest(range(1, 10)) AS j)
SELECT label, (i - 1)::INT AS i, (j - 1)::INT AS j, round(sum(m[i] * m[j]), 6) AS total FROM v, i, j WHERE i <= j GROUP BY label, i, j""")
def quadric_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fits.quadric_sums(_points(spark, sf_dir), ["label"])
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), r6(f"a{i}{j}").alias("total")) for i in range(9) for j in range(i, 9)))
    return found.select("label", F.explode(cells).alias("a")).select("label", "a.i", "a.j", "a.total")


@query(f"""WITH {FOREGROUND_SQL}, axis AS (SELECT unnest([[1, 0, 0], [0, 1, 0], [0, 0, 1]]) AS d, unnest(['x', 'y', 'z']) AS axis),
b AS (SELECT a.c, axis, (SELECT count(*) FROM fg b WHERE b.c = a.c AND b.x = a.x - d[1] AND b.y = a.y - d[2] AND b.z = a.z - d[3]) AS before,
  (SELECT count(*) FROM fg b WHERE b.c = a.c AND b.x = a.x + d[1] AND b.y = a.y + d[2] AND b.z = a.z + d[3]) AS after, CASE axis WHEN 'x' THEN x = {W - 1} WHEN 'y' THEN y = {H - 1} ELSE z = {D - 1} END AS last FROM fg a, axis),
n AS (SELECT c, axis, sum(1 - before) + sum(CASE WHEN last THEN 0 ELSE 1 - after END) AS n FROM b GROUP BY c, axis)
SELECT c, max(n) FILTER (axis = 'x')::BIGINT AS nx, max(n) FILTER (axis = 'y')::BIGINT AS ny, max(n) FILTER (axis = 'z')::BIGINT AS nz, round(4950 / max(n) FILTER (axis = 'x'), 6) AS mx, round(4950 / max(n) FILTER (axis = 'y'), 6) AS my, round(4950 / max(n) FILTER (axis = 'z'), 6) AS mz FROM n GROUP BY c""")
def axis_intercepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mil.axis_intercepts(foreground(spark, sf_dir), ["c"], SHAPE)
    return found.select("c", "nx", "ny", "nz", *(r6(k).alias(k) for k in ("mx", "my", "mz")))


@query(f"""WITH {FOREGROUND_SQL}, {BACKGROUND_SQL}, {thickness_sql("bg", "fg")} SELECT c, round(avg(thickness), 6) AS mean, round(stddev(thickness), 6) AS sd, round(max(thickness), 6) AS max FROM t GROUP BY c""")
def separation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thickness of the background."""
    back = components.complement(foreground(spark, sf_dir), ["c"], SHAPE)
    found = distance.thickness_summary(distance.local_thickness(back, ["c"], SHAPE), ["c"], "Tb.Sp")
    return found.select("c", *(r6(k).alias(k) for k in ("mean", "sd", "max")))


@query(f"""WITH {FOREGROUND_SQL}, {BACKGROUND_SQL}, {thickness_sql("fg", "bg")} SELECT c, z, round(avg(thickness), 6) AS mean, round(stddev_pop(thickness), 6) AS sd, round(max(thickness), 6) AS max FROM t GROUP BY c, z""")
def slice_thickness_of_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = distance.slice_thickness(foreground(spark, sf_dir), ["c"], SHAPE, True)
    return found.select("c", "z", *(r6(k).alias(k) for k in ("mean", "sd", "max")))


TURN = np.array([[0.6, -0.8, 0.0], [0.8, 0.6, 0.0], [0.0, 0.0, 1.0]])


@query(f"""WITH {FOREGROUND_SQL}, t AS (SELECT x.x, y.y, z.z FROM (SELECT unnest(range(40)) AS x) x, (SELECT unnest(range(30)) AS y) y, (SELECT unnest(range(9)) AS z) z),
s AS (SELECT *, floor((x - 20) * 0.6 - (y - 15) * 0.8 + 25 + 0.5)::INT AS u, floor((x - 20) * 0.8 + (y - 15) * 0.6 + 5 + 0.5)::INT AS v, floor(z - 4 + 4 + 0.5)::INT AS w FROM t)
SELECT s.x::INT AS x, s.y::INT AS y, s.z::INT AS z, fg.c, fg.value FROM s JOIN fg ON fg.x = s.u AND fg.y = s.v AND fg.z = s.w""")
def aligned_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image resampled along turned axes."""
    return moments.aligned(foreground(spark, sf_dir), TURN, np.array([25.0, 5.0, 4.0]), (40, 30, 9))


@query(f"""WITH {FOREGROUND_SQL} SELECT c, (2 * max(abs(y - 5)) + 5)::BIGINT AS nx, (2 * max(abs(x - 25)) + 5)::BIGINT AS ny, (2 * max(abs(z - 4)) + 5)::BIGINT AS nz FROM fg GROUP BY c""")
def aligned_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size that each channel needs along axes turned by a right angle."""
    axes = np.array([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])
    return moments.aligned_size(foreground(spark, sf_dir), axes, np.array([25.0, 5.0, 4.0]), keys=["c"])


@query("""SELECT o_orderkey, round(sqrt((a - b) ** 2 + (b - 1) ** 2 + (a - 2) ** 2), 6) AS distance, round(b * 2 - 1 * 1, 6) AS cx, round(1 * a - a * 2, 6) AS cy, round(a * 1 - b * a, 6) AS cz, least(5.0, greatest(-5.0, a)) AS clamped, round(a * a * b * b * 4 * pi() / 3, 3) AS volume
FROM (SELECT o_orderkey, (o_orderkey % 17)::DOUBLE AS a, (o_custkey % 11)::DOUBLE AS b FROM orders)""")
def vector_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamella.sources.tables import table

    a, b, one, two = (F.col("o_orderkey") % 17).cast("double"), (F.col("o_custkey") % 11).cast("double"), F.lit(1.0), F.lit(2.0)
    cross = geometry.cross((a, b, one), (a, one, two))
    made = {"distance": r6(geometry.distance3d((a, b, a), (b, one, two))), "cx": r6(cross[0]), "cy": r6(cross[1]), "cz": r6(cross[2]), "clamped": geometry.clamp(a, -5.0, 5.0), "volume": F.round(geometry.ellipsoid_volume(a, b, a * b), 3)}
    return table(spark, sf_dir, "orders").select("o_orderkey", *(v.alias(k) for k, v in made.items()))


@query("""SELECT o_orderkey, CASE WHEN lower(t) LIKE '%tibia%' THEN 8 WHEN lower(t) LIKE '%femur%' THEN 7 WHEN lower(t) LIKE '%radius%' THEN 3 ELSE 0 END AS bone, regexp_replace(t, '\\.[^.]*$', '') AS stripped
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Mouse Femur ' WHEN 1 THEN 'TIBIA femur.' WHEN 2 THEN 'left radius' ELSE 'scan' END || o_orderpriority || '.tif' AS t FROM orders)""")
def bone_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamella.sources.tables import table

    k = F.col("o_orderkey") % 4
    title = F.concat(F.when(k == 0, "Mouse Femur ").when(k == 1, "TIBIA femur.").when(k == 2, "left radius").otherwise("scan"), F.col("o_orderpriority"), F.lit(".tif"))
    return table(spark, sf_dir, "orders").select("o_orderkey", geometry.guess_bone(title).alias("bone"), geometry.strip_extension(title).alias("stripped"))


@query("""SELECT o_orderkey, round(sqrt((a - 3) ** 2 + (b - 2) ** 2 + 1), 6) AS apart, least(9.0, greatest(2.0, a)) AS clamped, round(a * b * 2 * 4 * pi() / 3, 6) AS volume, round(a / b - b / 2, 6) AS factor,
  CASE o_orderpriority WHEN '1-URGENT' THEN 7 ELSE 0 END AS bone, round(sin_, 6) AS direction FROM (SELECT *, (o_orderkey % 17 + 1)::DOUBLE AS a, (o_custkey % 11 + 1)::DOUBLE AS b FROM orders)
JOIN (SELECT range AS i, 1 - (2 * range + 1) / 64 AS sin_ FROM range(64)) ON i = o_orderkey % 64""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions in plain SQL."""
    from lamella.functions import sql
    from lamella.sources.tables import table

    sql.register(spark)
    table(spark, sf_dir, "orders").createOrReplaceTempView("lm_orders")
    return spark.sql("""SELECT o_orderkey, round(lm_distance(a, b, 1, 3, 2, 0), 6) AS apart, lm_clamp(a, 2, 9) AS clamped, round(lm_ellipsoid_volume(a, b, 2), 6) AS volume, round(lm_ellipsoid_factor(a, b, 2), 6) AS factor,
        lm_bone(CASE o_orderpriority WHEN '1-URGENT' THEN 'femur' ELSE o_orderpriority END) AS bone, round(z, 6) AS direction
        FROM (SELECT *, CAST(o_orderkey % 17 + 1 AS DOUBLE) AS a, CAST(o_custkey % 11 + 1 AS DOUBLE) AS b FROM lm_orders) JOIN lm_directions(64) ON i = o_orderkey % 64""")


@query(f"""WITH {GRAINS_SQL}, near AS (SELECT a.c, a.x, a.y, a.z, count(b.x) - 1 AS n FROM fg a JOIN fg b ON b.c = a.c
  AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.z BETWEEN a.z - 1 AND a.z + 1 GROUP BY ALL)
SELECT c, x, y, z, n, CASE WHEN n <= 1 THEN 'end' WHEN n = 2 THEN 'slab' ELSE 'junction' END AS kind FROM near""")
def classified_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of points of a skeleton, here of all voxels."""
    from lamella.operators import skeleton

    return skeleton.classified(grains(spark, sf_dir), ["c"])
