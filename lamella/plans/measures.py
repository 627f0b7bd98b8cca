"""Measurements over the volumes of the driver's tables, and the SQL that each is held against."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import geometry
from lamella.operators import components, distance, filters, fits, fraction, fractal, mesh, moments, particles, topology
from lamella.sources.tables import CELL_SQL, FOREGROUND_SQL, GRAINS_SQL, SHAPE, SOLID_SHAPE, above_mean, foreground, grains, solids, table, voxelize
from lamella.storage import shared_dir, written

W, H, D = SHAPE
CHANNELS = 3  # A, N and R
REGISTRY: dict = {}
SQL: dict[str, str] = {}
#: Distinct cells of the foreground, for the characteristic.
CELLS_SQL = FOREGROUND_SQL + """, face AS (
  SELECT DISTINCT c, 2 * x + i AS cx, 2 * y + j AS cy, 2 * z + k AS cz
  FROM fg, (SELECT unnest([0, 1, 2]) AS i), (SELECT unnest([0, 1, 2]) AS j), (SELECT unnest([0, 1, 2]) AS k)
), signed AS (
  SELECT *, CASE WHEN (cx + cy + cz) % 2 = 0 THEN 1 ELSE -1 END AS sign,
    (cx IN (0, 100))::INT + (cy IN (0, 22))::INT + (cz IN (0, 18))::INT AS planes FROM face
)"""
#: 26-connected components by the least position that can be reached.
LABEL_SQL = GRAINS_SQL + """, node AS (SELECT c, (z::BIGINT * 1048576 + y) * 1048576 + x AS id, x, y, z FROM fg
), edge AS (
  SELECT a.c, a.id AS u, b.id AS v FROM node a, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), (SELECT unnest([-1, 0, 1]) AS k), node b
  WHERE b.c = a.c AND b.x = a.x + i AND b.y = a.y + j AND b.z = a.z + k
), reach AS (
  SELECT c, id AS u, id AS label FROM node
  UNION
  SELECT e.c, e.v, r.label FROM reach r JOIN edge e ON e.c = r.c AND e.u = r.u AND e.v > r.label
), lab AS (SELECT n.c, n.x, n.y, n.z, l.label FROM (SELECT c, u, min(label) AS label FROM reach GROUP BY c, u) l JOIN node n ON n.c = l.c AND n.id = l.u)"""


def query(sql: str | None = None):
    def put(f):
        REGISTRY[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


@query(f"WITH {CELL_SQL.replace('GROUP BY ALL', 'GROUP BY ALL')} SELECT c, x, y, z, value FROM cell")
def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxelize(spark, sf_dir)


@query(f"""WITH {FOREGROUND_SQL} SELECT c, count(*) * 0.125 AS bv, 4950 * 0.125 AS tv, round(count(*) / 4950, 6) AS ratio FROM fg GROUP BY c""")
def element_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = foreground(spark, sf_dir).withColumn("value", F.lit(255))
    return fraction.element_fraction(mask, ["c"], 0.125, W * H * D).withColumn("ratio", r6("ratio"))


@query("""WITH cell AS (
  SELECT CAST(l_quantity AS INT) - 1 AS x, CAST(round(l_discount * 100) AS INT) AS y, CAST(round(l_tax * 100) AS INT) AS z,
    CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS c, (year(l_shipdate) - 1995)::INT AS t, count(*) AS value FROM lineitem GROUP BY ALL
), fg AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY c, t) AS n, sum(value) OVER (PARTITION BY c, t) AS s FROM cell) WHERE value * n >= s)
SELECT 'lineitem Channel: ' || (c + 1) || ', Time: ' || (t + 1) AS label, c, t, count(*) AS bv, 4950::BIGINT AS tv, round(count(*) / 4950, 6) AS ratio FROM fg GROUP BY c, t""")
def hyperstack_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamella.model import label_column

    mask = above_mean(voxelize(spark, sf_dir, True), ["c", "t"]).withColumn("value", F.lit(255))
    found = fraction.element_fraction(mask, ["c", "t"], 1, W * H * D)
    return found.select(label_column("lineitem", F.col("c"), F.col("t")).alias("label"), "c", "t", F.col("bv").cast("bigint").alias("bv"), F.col("tv").cast("bigint").alias("tv"), r6("ratio").alias("ratio"))


@query(f"""WITH {CELL_SQL} SELECT c, count(DISTINCT value) <= 2 AS is_binary, count(DISTINCT value) <= 2 AS is_binary_colour, bool_and(value IN (0, 255)) AS is_mask FROM cell GROUP BY c""")
def binary_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = voxelize(spark, sf_dir)
    return filters.is_binary(v, ["c"]).join(filters.binary_by_colour(v, ["c"]), "c").join(filters.is_mask(v, ["c"]), "c")


@query(f"""WITH {CELL_SQL} SELECT c, x, y, z, CASE WHEN value BETWEEN 5 AND 9 THEN 255 ELSE 0 END AS value FROM cell""")
def threshold_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.to_mask(voxelize(spark, sf_dir), 5, 9)


@query(f"""WITH {CELL_SQL} SELECT c, value, count(*) AS n FROM cell GROUP BY c, value""")
def stack_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.stack_histogram(voxelize(spark, sf_dir), ["c"])


@query(f"""WITH {CELL_SQL} SELECT c, x, y, z, round(least(1.0, greatest(0.0, (value - 2) / 8.0)), 6) AS filled, round(greatest(0.0, (value * 1.5 - 2) / 1000), 6) AS density FROM cell""")
def partial_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return voxelize(spark, sf_dir).select("c", "x", "y", "z", r6(filters.filled_fraction(v, 2.0, 10.0)).alias("filled"), r6(filters.voxel_density(v, 1.5, -2.0, "mm")).alias("density"))


@query(f"""WITH {FOREGROUND_SQL} SELECT c, count(*) AS bv FROM fg WHERE (y BETWEEN 2 AND 6 AND x BETWEEN 10 AND 30 AND z = 2) OR (x BETWEEN 20 AND 24 AND y BETWEEN 0 AND 3 AND c = 1) GROUP BY c""")
def roi_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rois = spark.createDataFrame([(1, 3, 0, 0), (2, 0, 0, 2)], "roi_id int, z int, t int, c int")
    pixels = spark.sql("SELECT 1 AS roi_id, explode(sequence(10, 30)) AS x, y FROM (SELECT explode(sequence(2, 6)) AS y) UNION ALL SELECT 2, explode(sequence(20, 24)), y FROM (SELECT explode(sequence(0, 3)) AS y)")
    return filters.masked_by_rois(foreground(spark, sf_dir), rois, pixels).groupBy("c").agg(F.count(F.lit(1)).alias("bv"))


@query(f"""WITH {CELL_SQL} SELECT c, x, y, CASE WHEN z >= 5 THEN z - 3 ELSE z END AS z, value FROM cell WHERE z NOT BETWEEN 2 AND 4""")
def delete_slice_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.delete_slices(voxelize(spark, sf_dir), 3, 5)


@query(f"""WITH {CELL_SQL} SELECT c, x - 20 AS x, y - 1 AS y, z AS z, value FROM cell WHERE (x - 25) * (x - 25) + (y - 5) * (y - 5) + (z - 4) * (z - 4) <= 20.25 AND true""")
def crop_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the sphere's box begins at (20.5, 0.5, -0.5), whole parts (20, 0, 0)
    return filters.sphere(voxelize(spark, sf_dir), (25.0, 5.0, 4.0), 4.5).withColumn("y", F.col("y") - 1)


@query(f"""WITH {CELL_SQL} SELECT c, x - 22 AS x, y - 2 AS y, z - 1 AS z, value FROM cell WHERE x BETWEEN 22 AND 27 AND y BETWEEN 2 AND 7 AND z BETWEEN 1 AND 6""")
def crop_inner_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.inner_cube(voxelize(spark, sf_dir), (25.0, 5.0, 4.0), 4.5, 1.0, SHAPE)


@query(f"""WITH {CELLS_SQL} SELECT c, sum(sign)::BIGINT AS chi FROM signed GROUP BY c""")
def euler_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.euler(foreground(spark, sf_dir), ["c"])


@query(f"""WITH {CELLS_SQL}, s AS (SELECT c, sum(sign)::BIGINT AS chi, coalesce(sum(sign) FILTER (planes >= 3), 0)::BIGINT AS chi0,
  coalesce(sum(sign) FILTER (planes >= 2), 0)::BIGINT AS chi1, coalesce(sum(sign) FILTER (planes >= 1), 0)::BIGINT AS chi2 FROM signed GROUP BY c),
d AS (SELECT *, chi - (chi2 / 2 + chi1 / 4 + chi0 / 8) AS delta_chi FROM s)
SELECT *, 1 - delta_chi AS connectivity, round((1 - delta_chi) / 4950, 6) AS conn_density FROM d""")
def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.connectivity(foreground(spark, sf_dir), ["c"], SHAPE).withColumn("conn_density", r6("conn_density"))


@query(f"""WITH {FOREGROUND_SQL}, near AS (SELECT a.c, a.x, a.y, a.z, count(b.x) AS n FROM fg a JOIN fg b ON b.c = a.c
  AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.z BETWEEN a.z - 1 AND a.z + 1 GROUP BY ALL) SELECT c, x, y, z FROM near WHERE n < 27""")
def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.outline(foreground(spark, sf_dir), ["c"])


@query(f"""WITH {FOREGROUND_SQL} SELECT c, count(*) AS n, round(sum(x * value) / sum(value) * 0.5, 6) AS cx, round(sum(y * value) / sum(value) * 0.25, 6) AS cy,
  round((sum(z * value) / sum(value) + 1) * 2, 6) AS cz FROM fg GROUP BY c""")
def centroid3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = moments.centroid3d(foreground(spark, sf_dir), ["c"], (0.5, 0.25, 2.0), F.col("value"))
    return found.select("c", "n", *(r6(k).alias(k) for k in ("cx", "cy", "cz")))


@query(f"""WITH {FOREGROUND_SQL}, s AS (SELECT c, count(*) AS n, sum(value) AS m, sum(x * value) / sum(value) AS mx, sum(y * value) / sum(value) AS my, sum(z * value) / sum(value) AS mz FROM fg GROUP BY c),
p AS (SELECT c, any_value(n) AS n, any_value(m) AS mass, sum(value * (x - mx) ** 2) AS xx, sum(value * (y - my) ** 2) AS yy, sum(value * (z - mz) ** 2) AS zz,
  sum(value * (x - mx) * (y - my)) AS xy, sum(value * (x - mx) * (z - mz)) AS xz, sum(value * (y - my) * (z - mz)) AS yz FROM fg JOIN s USING (c) GROUP BY c)
SELECT c, n::BIGINT AS n, mass::BIGINT AS mass, round(yy + zz + mass / 6, 4) AS ixx, round(xx + zz + mass / 6, 4) AS iyy, round(xx + yy + mass / 6, 4) AS izz,
  round(-xy, 4) AS ixy, round(-xz, 4) AS ixz, round(-yz, 4) AS iyz FROM p""")
def inertia_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = moments.inertia_tensor(foreground(spark, sf_dir), ["c"], weight=F.col("value"))
    return found.select("c", "n", "mass", *(F.round(k, 4).alias(k) for k in ("ixx", "iyy", "izz", "ixy", "ixz", "iyz")))


@query(f"""WITH {FOREGROUND_SQL}, s AS (SELECT c, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM fg GROUP BY c),
p AS (SELECT c, any_value(n) AS n, sum((x - mx) ** 2) AS xx, sum((y - my) ** 2) AS yy, sum((z - mz) ** 2) AS zz, -sum((x - mx) * (y - my)) AS xy, -sum((x - mx) * (z - mz)) AS xz, -sum((y - my) * (z - mz)) AS yz FROM fg JOIN s USING (c) GROUP BY c)
SELECT c, round((yy + zz + n / 6) / n, 5) AS xx, round((xx + zz + n / 6) / n, 5) AS yy, round((xx + yy + n / 6) / n, 5) AS zz, round(xy / n, 5) + 0.0 AS xy, round(xz / n, 5) + 0.0 AS xz, round(yz / n, 5) + 0.0 AS yz, 1.0::DOUBLE AS unit FROM p""")
def principal_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tensor, a voxel, put together again from its principal moments and axes, and the least length of an axis."""
    found = moments.principal_axes(moments.inertia_tensor(foreground(spark, sf_dir), ["c"]), ["c"])
    of = {f"{a}{b}": sum(F.col(f"i{3 - k}") * F.col(f"v{i}{k}") * F.col(f"v{j}{k}") for k in range(3)) / F.col("n") for i, a in enumerate("xyz") for j, b in enumerate("xyz") if j >= i}
    unit = F.least(*(F.sqrt(sum(F.col(f"v{i}{k}") * F.col(f"v{i}{k}") for i in range(3))) for k in range(3)))
    return found.select("c", *((F.round(v, 5) + F.lit(0.0)).alias(k) for k, v in of.items()), r6(unit).alias("unit"))


@query(f"""WITH {FOREGROUND_SQL} SELECT c, z, count(*) AS n, count(*) * 0.125 AS csa, round(sum(x) / count(*) * 0.5, 6) AS cx, round(sum(y) / count(*) * 0.25, 6) AS cy, 1.0::DOUBLE AS mean_density FROM fg GROUP BY c, z""")
def slice_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = moments.slice_centroids(foreground(spark, sf_dir), ["c"], (0.5, 0.25))
    return found.select("c", "z", "n", "csa", r6("cx").alias("cx"), r6("cy").alias("cy"), "mean_density")


@query(f"""WITH {FOREGROUND_SQL}, a AS (SELECT c, z, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM fg GROUP BY c, z),
b AS (SELECT c, z, any_value(n) AS n, any_value(cx) AS cx, any_value(cy) AS cy, sum((y - cy) ** 2) + any_value(n) / 12 AS mxx, sum((x - cx) ** 2) + any_value(n) / 12 AS myy, sum((x - cx) * (y - cy)) AS mxy FROM fg JOIN a USING (c, z) GROUP BY c, z),
t AS (SELECT *, CASE WHEN abs(mxy) < 1e-9 THEN CASE WHEN mxx > myy THEN pi() / 2 ELSE 0 END ELSE atan((mxx - myy + sqrt((mxx - myy) ** 2 + 4 * mxy ** 2)) / (2 * mxy)) END AS theta FROM b),
m AS (SELECT c, z, any_value(theta) AS theta, any_value(n) AS n, sum(((y - cy) * cos(theta) - (x - cx) * sin(theta)) ** 2) + any_value(n) / 12 AS i1, sum(((x - cx) * cos(theta) + (y - cy) * sin(theta)) ** 2) + any_value(n) / 12 AS i2,
  max(abs((y - cy) * cos(theta) - (x - cx) * sin(theta))) AS r1, max(abs((x - cx) * cos(theta) + (y - cy) * sin(theta))) AS r2 FROM fg JOIN t USING (c, z) GROUP BY c, z)
SELECT c, z, round(theta, 4) AS theta, round(least(i1, i2), 4) AS imin, round(greatest(i1, i2), 4) AS imax, round(r1, 4) AS r1, round(r2, 4) AS r2, round((i1 + i2) / sqrt(r1 * r1 + r2 * r2), 4) AS zpol FROM m""")
def slice_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = moments.slice_moments(foreground(spark, sf_dir), ["c"])
    return found.select("c", "z", *(F.round(k, 4).alias(k) for k in ("theta", "imin", "imax", "r1", "r2", "zpol")))


SIZES = fractal.box_sizes(16, 1, 2.0)


@query(f"""WITH {FOREGROUND_SQL} SELECT c, s AS size, count(DISTINCT (x // s, y // s, z // s)) AS n FROM fg, (SELECT unnest({SIZES}) AS s) GROUP BY c, s""")
def box_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fractal.box_counts(foreground(spark, sf_dir), ["c"], SIZES)


@query(f"""WITH {FOREGROUND_SQL}, b AS (SELECT c, s, count(DISTINCT (x // s, y // s, z // s)) AS n FROM fg, (SELECT unnest({SIZES}) AS s) GROUP BY c, s)
SELECT c, round(regr_slope(ln(n), -ln(s)), 6) AS dimension, round(regr_r2(ln(n), -ln(s)), 6) AS r2 FROM b GROUP BY c""")
def fractal_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fractal.fractal_dimension(fractal.box_counts(foreground(spark, sf_dir), ["c"], SIZES), ["c"])
    return found.select("c", r6("dimension").alias("dimension"), r6("r2").alias("r2"))


CONFIG_SQL = FOREGROUND_SQL + """, config AS (SELECT c, x - (i & 1) AS x, y - ((i >> 1) & 1) AS y, z - (i >> 2) AS z, bit_or(1 << i) AS config
  FROM fg, (SELECT unnest(range(8)::INT[]) AS i) GROUP BY ALL)"""


@query(f"""WITH {CONFIG_SQL} SELECT c, config, count(*) AS n FROM config GROUP BY c, config""")
def cell_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.cell_configs(foreground(spark, sf_dir), ["c"]).groupBy("c", "config").agg(F.count(F.lit(1)).alias("n"))


_AREA, _FLUX, _REST = (str(list(v)) for v in mesh.constants())


@query(f"""WITH {CONFIG_SQL} SELECT c, round(sum({_AREA}[config + 1]), 4) AS area, round(abs(sum({_FLUX}[config + 1] * z + {_REST}[config + 1])), 4) AS volume FROM config GROUP BY c""")
def surface_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.surface(foreground(spark, sf_dir), ["c"]).select("c", F.round("area", 4).alias("area"), F.round("volume", 4).alias("volume"))


@query(f"""WITH {CONFIG_SQL}, v AS (SELECT c, abs(sum({_FLUX}[config + 1] * z + {_REST}[config + 1])) AS bv FROM config GROUP BY c)
SELECT c, round(bv, 4) AS bv, {(W - 1) * (H - 1) * (D - 1)}.0::DOUBLE AS tv, round(bv / {(W - 1) * (H - 1) * (D - 1)}, 6) AS ratio FROM v""")
def surface_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mesh.surface_fraction(foreground(spark, sf_dir), ["c"], SHAPE)
    return found.select("c", F.round("bv", 4).alias("bv"), "tv", r6("ratio").alias("ratio"))


@query(f"""WITH {CONFIG_SQL} SELECT c, round(sum({_AREA}[config + 1]), 3) AS area FROM config GROUP BY c""")
def mesh_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.mesh_area(mesh.mesh(foreground(spark, sf_dir), ["c"]), ["c"]).select("c", F.round("area", 3).alias("area"))


@query(f"""WITH RECURSIVE {LABEL_SQL} SELECT * FROM lab""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.connected_components(grains(spark, sf_dir), ["c"], block=16)


@query(f"""WITH RECURSIVE {LABEL_SQL} SELECT c, label, count(*) AS size, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z,
  round(sum(x) / count(*) + 0.5, 6) AS cx, round(sum(y) / count(*) + 0.5, 6) AS cy, round(sum(z) / count(*) + 0.5, 6) AS cz FROM lab GROUP BY c, label""")
def particle_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = particles.boxes(components.connected_components(grains(spark, sf_dir), ["c"]), ["c"])
    return found.select(*(r6(k).alias(k) if k in ("cx", "cy", "cz") else k for k in found.columns))


@query(f"""WITH RECURSIVE {LABEL_SQL}, s AS (SELECT c, label, count(*) AS size, bool_or(x IN (0, 49) OR y IN (0, 10) OR z IN (0, 8)) AS at_edge FROM lab GROUP BY c, label)
SELECT c, label, size, row_number() OVER (PARTITION BY c ORDER BY label) AS particle FROM s WHERE size BETWEEN 1 AND 200 AND NOT at_edge""")
def particle_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = components.connected_components(grains(spark, sf_dir), ["c"])
    return components.filter_particles(labels, ["c"], 1, 200, SHAPE).groupBy("c", "label", "particle").agg(F.count(F.lit(1)).alias("size")).withColumn("particle", F.col("particle").cast("bigint"))


@query(f"""WITH RECURSIVE {LABEL_SQL}, face AS (SELECT DISTINCT c, label, 2 * x + i AS cx, 2 * y + j AS cy, 2 * z + k AS cz FROM lab,
  (SELECT unnest([0, 1, 2]) AS i), (SELECT unnest([0, 1, 2]) AS j), (SELECT unnest([0, 1, 2]) AS k))
SELECT c, label, sum(CASE WHEN (cx + cy + cz) % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS chi FROM face GROUP BY c, label""")
def particle_euler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles.euler(components.connected_components(grains(spark, sf_dir), ["c"]), ["c"]).select("c", "label", "chi")


@query(f"""WITH RECURSIVE {LABEL_SQL}, s AS (SELECT c, label, count(*) AS size FROM lab GROUP BY c, label)
SELECT c, label, size FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY size DESC, label) AS n FROM s) WHERE n = 1""")
def largest_particle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components.sizes(components.connected_components(grains(spark, sf_dir), ["c"]), ["c"])
    return found.join(components.biggest(found, ["c"]), ["c", "label"]).select("c", "label", "size")


@query()
def purify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.purify(foreground(spark, sf_dir), ["c"], SHAPE)


@query()
def particle_analyser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles.analyse(grains(spark, sf_dir), ["c"])


@query(f"""WITH {FOREGROUND_SQL}, bg AS (SELECT c.c, x.x, y.y, z.z FROM (SELECT DISTINCT c FROM fg) c, (SELECT unnest(range(50)) AS x) x, (SELECT unnest(range(11)) AS y) y, (SELECT unnest(range(9)) AS z) z
  WHERE NOT EXISTS (SELECT 1 FROM fg WHERE fg.c = c.c AND fg.x = x.x AND fg.y = y.y AND fg.z = z.z))
SELECT fg.c, fg.x, fg.y, fg.z, min((fg.x - bg.x) ** 2 + (fg.y - bg.y) ** 2 + (fg.z - bg.z) ** 2)::DOUBLE AS d2 FROM fg JOIN bg ON bg.c = fg.c GROUP BY ALL""")
def squared_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distance.squared_distance(foreground(spark, sf_dir), ["c"], SHAPE)


@query(f"""WITH {FOREGROUND_SQL}, bg AS (SELECT c.c, x.x, y.y, z.z FROM (SELECT DISTINCT c FROM fg) c, (SELECT unnest(range(50)) AS x) x, (SELECT unnest(range(11)) AS y) y, (SELECT unnest(range(9)) AS z) z
  WHERE NOT EXISTS (SELECT 1 FROM fg WHERE fg.c = c.c AND fg.x = x.x AND fg.y = y.y AND fg.z = z.z)),
e AS (SELECT fg.c, fg.x, fg.y, fg.z, min((fg.x - bg.x) ** 2 + (fg.y - bg.y) ** 2 + (fg.z - bg.z) ** 2) AS d2 FROM fg JOIN bg ON bg.c = fg.c GROUP BY ALL),
t AS (SELECT p.c, p.x, p.y, p.z, max(2 * sqrt(s.d2)) AS thickness FROM fg p JOIN e s ON s.c = p.c AND (p.x - s.x) ** 2 + (p.y - s.y) ** 2 + (p.z - s.z) ** 2 < s.d2 GROUP BY ALL)
SELECT c, round(avg(thickness), 6) AS mean, round(stddev(thickness), 6) AS sd, round(max(thickness), 6) AS max FROM t GROUP BY c""")
def thickness_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = distance.thickness_summary(distance.local_thickness(foreground(spark, sf_dir), ["c"], SHAPE), ["c"])
    return found.select("c", *(r6(k).alias(k) for k in ("mean", "sd", "max")))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("label", *(e[i].cast("double").alias(k) for i, k in enumerate("xyz")))


@query("""WITH p AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)
SELECT label, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM p GROUP BY label""")
def point_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.centroid(_points(spark, sf_dir), ["label"]).select("label", *(r6(k).alias(k) for k in "xyz"), "n")


@query("""WITH p AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)
SELECT a.label, round(max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)), 6) AS feret FROM p a JOIN p b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label""")
def feret_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles.feret(_points(spark, sf_dir), ["label"]).select("label", r6("feret").alias("feret"))


@query("""WITH p AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
m AS (SELECT label, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM p GROUP BY label),
q AS (SELECT label, mx, my, mz, x - mx AS x, y - my AS y, z - mz AS z, (x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2 AS r FROM p JOIN m USING (label)),
s AS (SELECT label, any_value(mx) AS mx, any_value(my) AS my, any_value(mz) AS mz, count(*) AS n, 2 * sum(x * x) AS a, 2 * sum(x * y) AS b, 2 * sum(x * z) AS c, 2 * sum(y * y) AS d, 2 * sum(y * z) AS e, 2 * sum(z * z) AS f,
  sum(r * x) AS u, sum(r * y) AS v, sum(r * z) AS w, sum(r) AS rr FROM q GROUP BY label),
t AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM s),
o AS (SELECT label, n, mx, my, mz, rr, (u * (d * f - e * e) - b * (v * f - e * w) + c * (v * e - d * w)) / det AS px, (a * (v * f - e * w) - u * (b * f - e * c) + c * (b * w - v * c)) / det AS py,
  (a * (d * w - v * e) - b * (b * w - v * c) + u * (b * e - d * c)) / det AS pz FROM t)
SELECT label, n, round(px + mx, 5) AS cx, round(py + my, 5) AS cy, round(pz + mz, 5) AS cz, round(sqrt(rr / n + px * px + py * py + pz * pz), 5) AS radius FROM o""")
def sphere_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.fit_spheres(_points(spark, sf_dir), ["label"]).select("label", "n", *(F.round(k, 5).alias(k) for k in ("cx", "cy", "cz", "radius")))


@query()
def ellipsoid_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.fit_ellipsoids(_points(spark, sf_dir), ["label"])


@query("""SELECT c, i, round(sqrt(1 - z * z) * cos(i * pi() * (3 - sqrt(5))), 6) AS x, round(sqrt(1 - z * z) * sin(i * pi() * (3 - sqrt(5))), 6) AS y, round(z, 6) AS z
FROM (SELECT c, i, 1 - (2 * i + 1) / n AS z FROM (SELECT c_nationkey AS c, count(*) AS n, unnest(range(count(*))) AS i FROM customer GROUP BY c_nationkey))""")
def golden_spiral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each nation as many directions as it has customers."""
    nations = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return geometry.golden_spirals(nations, "n").select("c", "i", *(r6(k).alias(k) for k in "xyz"))


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, event_type, count(*) FILTER (value >= 50) AS n_fg, count(*) AS n_all, round(count(*) FILTER (value >= 50) / count(*), 6) AS ratio FROM events GROUP BY ALL""")
def stream_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamella.streaming.fraction import windowed_fraction

    return windowed_fraction(table(spark, sf_dir, "events"), "ts", ["event_type"], "value", 50).withColumns({"start": F.date_format("start", "yyyy-MM-dd HH"), "ratio": r6("ratio")})


@query(SQL["euler_sum"])
def stream_euler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characteristic of each channel, from a stream of its slices in three batches."""
    from lamella.streaming import euler as running

    fg, at = foreground(spark, sf_dir).select("c", "x", "y", "z"), f"{shared_dir(spark)}/lamella-stream-{uuid.uuid4().hex}"
    fg.repartition(9, F.pmod(F.col("z") * 4, F.lit(9))).write.parquet(f"{at}/slices")
    return running.euler_of_changes(running.run_to_table(spark, f"{at}/slices", fg.schema, ["c"], f"{at}/changes", f"{at}/checkpoint", 3), ["c"])


def peak_ellipsoids(fg: DataFrame) -> DataFrame:
    """An axis-aligned ellipsoid at every local maximum of each channel, with radii by its value and place; larger ones first."""
    from lamella.operators import ellipsoids

    value = F.col("value")
    made = {f"c{k}": F.col(k) + 0.5 for k in "xyz"} | {"ra": 1.23 + value % 3, "rb": 3.17 + (value + F.col("x")) % 4, "rc": 7.31 + (value + F.col("y")) % 5}
    turn = {f"v{a}{b}": F.lit(float(a == b)) for a in range(3) for b in range(3)}
    seed = components.linear(*(F.col(k) for k in "xyz")) * CHANNELS + F.col("c")
    found = filters.local_maxima(fg, ["c"]).select("c", seed.alias("seed_id"), *(v.cast("double").alias(k) for k, v in (made | turn).items()))
    return ellipsoids.ranked(found)


PEAKS_SQL = FOREGROUND_SQL + """, e AS (SELECT c, ((z::BIGINT * 1048576 + y) * 1048576 + x) * 3 + c AS seed_id, x + 0.5 AS cx, y + 0.5 AS cy, z + 0.5 AS cz, (1.23 + value % 3)::DOUBLE AS ra, (3.17 + (value + x) % 4)::DOUBLE AS rb, (7.31 + (value + y) % 5)::DOUBLE AS rc
  FROM fg p WHERE NOT EXISTS (SELECT 1 FROM fg q WHERE q.c = p.c AND abs(q.x - p.x) + abs(q.y - p.y) + abs(q.z - p.z) = 1 AND q.value > p.value)),
n AS (SELECT *, row_number() OVER (ORDER BY ra * rb * rc DESC, seed_id) - 1 AS ell_id FROM e)"""
ASSIGN_SQL = PEAKS_SQL + """,
held AS (SELECT c, x, y, z, ell_id, ra, rb, rc, row_number() OVER (PARTITION BY c, x, y, z ORDER BY ell_id) - 1 AS rank FROM (SELECT c, x, y, z FROM fg) p JOIN n USING (c)
  WHERE ((x + 0.5 - cx) / ra) ** 2 + ((y + 0.5 - cy) / rb) ** 2 + ((z + 0.5 - cz) / rc) ** 2 <= 1.0)"""


def peaks_assigned(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Every voxel of the foreground with the n largest peak ellipsoids of its channel that hold it."""
    from lamella.operators import ellipsoids

    fg = foreground(spark, sf_dir)
    return ellipsoids.assign(fg, ellipsoids.with_tensors(peak_ellipsoids(fg)), n, keys=["c"])


@query(f"""WITH {ASSIGN_SQL} SELECT c, x, y, z, rank::INT AS rank, ell_id::INT AS ell_id FROM held WHERE rank < 2""")
def ellipsoid_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks_assigned(spark, sf_dir, 2).select("c", "x", "y", "z", "rank", "ell_id")


@query(f"""WITH {ASSIGN_SQL} SELECT c, x, y, z, round(sum((ra / rb - rb / rc) * ra * rb * rc) / sum(ra * rb * rc), 6) AS ef FROM held WHERE rank < 2 GROUP BY c, x, y, z""")
def ef_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamella.operators import ellipsoids

    return ellipsoids.factor_image(peaks_assigned(spark, sf_dir, 2), ["c"]).select("c", "x", "y", "z", r6("ef").alias("ef"))


@query(f"""WITH {ASSIGN_SQL} SELECT fg.c, fg.x, fg.y, fg.z, r.rank::INT AS rank, coalesce(h.ell_id, -1)::INT AS ell_id FROM fg, (SELECT unnest([0, 1]) AS rank) r LEFT JOIN held h ON h.c = fg.c AND h.x = fg.x AND h.y = fg.y AND h.z = fg.z AND h.rank = r.rank""")
def ellipsoid_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamella.operators import ellipsoids

    return ellipsoids.id_image(foreground(spark, sf_dir), peaks_assigned(spark, sf_dir, 2), 2, ["c"])


def _of_channels(fg: DataFrame, measure) -> DataFrame:
    """The rows of a measure of each channel's foreground, with c."""
    parts = [measure(fg.where(F.col("c") == c)).withColumn("c", F.lit(c)) for c in range(CHANNELS)]
    return reduce(DataFrame.unionByName, parts)


@query()
def anisotropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamella.operators import mil

    fg = written(foreground(spark, sf_dir), "foreground")  # the items are read for all channels at once
    return mil.anisotropy(_of_channels(fg, lambda fg: mil.mil_points(fg, SHAPE, seed=1)), ["c"])


@query()
def skeleton_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamella.operators import skeleton

    return skeleton.summary(*skeleton.graph(written(skeleton.skeletonise(grains(spark, sf_dir), ["c"]), "skeleton"), ["c"]), ["c"])


@query()
def junction_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamella.operators import skeleton

    return skeleton.junction_angles(*skeleton.graph(written(skeleton.skeletonise(grains(spark, sf_dir), ["c"]), "skeleton"), ["c"]), ["c"])


@query()
def ellipsoid_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every channel of the enlarged foreground: ellipsoids from every fiftieth ridge seed, and each voxel's factors."""
    from lamella.operators import ellipsoids

    def image(fg: DataFrame) -> DataFrame:
        seeds = distance.ridge_points(fg, ["c"], SOLID_SHAPE).select(components.linear(F.floor("x"), F.floor("y"), F.floor("z")).alias("seed_id"), "x", "y", "z")
        seeds = filters.skip_seeds(seeds, 50, 0, ["seed_id"])
        return ellipsoids.factor_image(ellipsoids.assign(fg, ellipsoids.with_tensors(ellipsoids.optimise(seeds, fg, SOLID_SHAPE))))

    return _of_channels(written(solids(spark, sf_dir), "solids"), image)


@query()
def skeleton_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamella.operators import skeleton

    thin = written(skeleton.skeletonise(grains(spark, sf_dir), ["c"]), "skeleton")
    return skeleton.longest_shortest_paths(*skeleton.graph(thin, ["c"]), ["c"])


@query()
def pruned_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamella.operators import skeleton

    thin = written(skeleton.skeletonise(grains(spark, sf_dir), ["c"]), "skeleton")
    vertices, branches, _ = skeleton.prune(*skeleton.graph(thin, ["c"]), ["c"], 2.0)
    return skeleton.junction_angles(vertices, branches, ["c"], 3, 8)


@query(f"""WITH {FOREGROUND_SQL}, side AS (SELECT unnest([[1, 0], [-1, 0], [0, 1], [0, -1]]) AS d),
edge AS (SELECT a.c, a.z, count(*)::DOUBLE AS perimeter FROM fg a, side WHERE NOT EXISTS (SELECT 1 FROM fg b WHERE b.c = a.c AND b.z = a.z AND b.x = a.x + d[1] AND b.y = a.y + d[2]) GROUP BY a.c, a.z),
row_ AS (SELECT c, z, y + j AS y, min(x) AS low, max(x) + 1 AS high FROM fg, (SELECT unnest([0, 1]) AS j) GROUP BY c, z, y + j),
p AS (SELECT DISTINCT c, z, x, y FROM (SELECT c, z, low AS x, y FROM row_ UNION ALL SELECT c, z, high, y FROM row_)),
pair AS (SELECT a.c, a.z, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM p a JOIN p b ON a.c = b.c AND a.z = b.z AND (a.x, a.y) < (b.x, b.y)),
width AS (SELECT q.c, q.z, ax, ay, bx, by_, any_value(d) AS d, min((bx - ax) * (p.y - ay) - (by_ - ay) * (p.x - ax)) AS low, max((bx - ax) * (p.y - ay) - (by_ - ay) * (p.x - ax)) AS high FROM pair q JOIN p ON p.c = q.c AND p.z = q.z GROUP BY ALL)
SELECT c, z, perimeter, round(max(d), 6) AS feret_max, round(min((high - low) / d) FILTER (low = 0 OR high = 0), 6) AS feret_min FROM width JOIN edge USING (c, z) GROUP BY c, z, perimeter""")
def slice_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments.slice_outline(foreground(spark, sf_dir), ["c"]).select("c", "z", "perimeter", r6("feret_max").alias("feret_max"), r6("feret_min").alias("feret_min"))


@query(f"""WITH {FOREGROUND_SQL}, bg AS (SELECT c.c, x.x, y.y, z.z FROM (SELECT DISTINCT c FROM fg) c, (SELECT unnest(range(50)) AS x) x, (SELECT unnest(range(11)) AS y) y, (SELECT unnest(range(9)) AS z) z
  WHERE NOT EXISTS (SELECT 1 FROM fg WHERE fg.c = c.c AND fg.x = x.x AND fg.y = y.y AND fg.z = z.z)),
e AS (SELECT fg.c, fg.x, fg.y, fg.z, min((fg.x - bg.x) ** 2 + (fg.y - bg.y) ** 2) AS d2 FROM fg JOIN bg ON bg.c = fg.c AND bg.z = fg.z GROUP BY ALL),
t AS (SELECT p.c, p.x, p.y, p.z, max(2 * sqrt(s.d2)) AS thickness FROM fg p JOIN e s ON s.c = p.c AND s.z = p.z AND (p.x - s.x) ** 2 + (p.y - s.y) ** 2 < s.d2 GROUP BY ALL)
SELECT c, z, round(avg(thickness), 6) AS mean, round(stddev_pop(thickness), 6) AS sd, round(max(thickness), 6) AS max FROM t GROUP BY c, z""")
def slice_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = distance.slice_thickness(foreground(spark, sf_dir), ["c"], SHAPE)
    return found.select("c", "z", *(r6(k).alias(k) for k in ("mean", "sd", "max")))
