"""Measurements of particles, graphs and ellipsoids over the volumes of the driver's tables, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators import commands, components, distance, ellipsoids, filters, particles, skeleton
from lamella.plans.measures import ASSIGN_SQL, CHANNELS, LABEL_SQL, PEAKS_SQL, SQL, _AREA, _FLUX, _REST, peak_ellipsoids, peaks_assigned, query, r6
from lamella.plans.voxelwise import BACKGROUND_SQL, thickness_sql
from lamella.sources.tables import CELL_SQL, FOREGROUND_SQL, SHAPE, foreground, grains, table, voxelize


def labelled_sql(name: str, nodes: str, edges: str, keys: str) -> str:
    """A recursive table of the least id that each node (keys, id) reaches over edges (keys, u, v)."""
    same = " AND ".join(f"e.{k.strip()} = l.{k.strip()}" for k in keys.split(","))
    also = " AND ".join(f"r.{k.strip()} = e.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"e.{k.strip()}" for k in keys.split(","))
    return f"""{name}({keys}, id, label) USING KEY ({keys}, id) AS (
  SELECT {keys}, id, id FROM {nodes}
  UNION
  SELECT {own}, e.v, min(l.label) FROM {name} l JOIN {edges} e ON {same} AND e.u = l.id JOIN recurring.{name} r ON {also} AND r.id = e.v WHERE l.label < r.label GROUP BY {own}, e.v)"""


ID = "(z::BIGINT * 1048576 + y) * 1048576 + x"
STEPS = "(SELECT unnest([-1, 0, 1]) AS i) i, (SELECT unnest([-1, 0, 1]) AS j) j, (SELECT unnest([-1, 0, 1]) AS k) k"

SQL["purify"] = f"""WITH RECURSIVE {FOREGROUND_SQL}, node AS MATERIALIZED (SELECT c, {ID} AS id, x, y, z FROM fg),
edge AS MATERIALIZED (SELECT a.c, a.id AS u, b.id AS v FROM node a, {STEPS}, node b WHERE b.c = a.c AND b.x = a.x + i AND b.y = a.y + j AND b.z = a.z + k AND b.id <> a.id),
{labelled_sql("lab", "node", "edge", "c")},
size AS (SELECT c, label, count(*) AS n FROM lab GROUP BY c, label), top AS (SELECT c, label FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, label) AS k FROM size) WHERE k = 1),
main AS MATERIALIZED (SELECT n.c, n.x, n.y, n.z FROM node n JOIN lab l ON l.c = n.c AND l.id = n.id JOIN top t ON t.c = l.c AND t.label = l.label),
back AS MATERIALIZED (SELECT c, x, y, z, {ID} AS id FROM (SELECT c.c, x.x, y.y, z.z FROM (SELECT DISTINCT c FROM fg) c, (SELECT unnest(range(50)) AS x) x, (SELECT unnest(range(11)) AS y) y, (SELECT unnest(range(9)) AS z) z) g
  WHERE NOT EXISTS (SELECT 1 FROM main m WHERE m.c = g.c AND m.x = g.x AND m.y = g.y AND m.z = g.z)),
step AS MATERIALIZED (SELECT a.c, a.id AS u, b.id AS v FROM back a, (SELECT unnest([[1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1]]) AS d) d, back b WHERE b.c = a.c AND b.x = a.x + d[1] AND b.y = a.y + d[2] AND b.z = a.z + d[3]),
{labelled_sql("hole", "back", "step", "c")},
room AS (SELECT b.c, b.x, b.y, b.z, h.label FROM back b JOIN hole h ON h.c = b.c AND h.id = b.id),
part AS (SELECT c, label, count(*) AS n, bool_or(x IN (0, 49) OR y IN (0, 10) OR z IN (0, 8)) AS at_edge FROM room GROUP BY c, label),
outside AS (SELECT c, label FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, label) AS k FROM part) WHERE at_edge OR k = 1)
SELECT c, x, y, z FROM main UNION ALL SELECT c, x::INT, y::INT, z::INT FROM room WHERE NOT EXISTS (SELECT 1 FROM outside o WHERE o.c = room.c AND o.label = room.label)"""


# ---- particles


@query(f"""WITH RECURSIVE {LABEL_SQL}, {BACKGROUND_SQL}, {thickness_sql("fg", "bg")}
SELECT c, label, round(sum(thickness) / count(*), 6) AS mean, round(stddev_pop(thickness), 6) AS sd, round(max(thickness), 6) AS max FROM lab JOIN t USING (c, x, y, z) GROUP BY c, label""")
def particle_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    fg = grains(spark, sf_dir)
    found = particles.thickness(components.connected_components(fg, ["c"]), distance.local_thickness(fg, ["c"], SHAPE), ["c"])
    return found.select("c", "label", *(r6(k).alias(k) for k in ("mean", "sd", "max")))


@query(f"""WITH RECURSIVE {LABEL_SQL}, m AS (SELECT c, label, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM lab GROUP BY c, label),
p AS (SELECT c, label, any_value(n) AS n, sum((x - mx) ** 2) AS xx, sum((y - my) ** 2) AS yy, sum((z - mz) ** 2) AS zz, sum((x - mx) * (y - my)) AS xy, sum((x - mx) * (z - mz)) AS xz, sum((y - my) * (z - mz)) AS yz FROM lab JOIN m USING (c, label) GROUP BY c, label)
SELECT c, label, round(yy + zz + n / 6, 4) AS ixx, round(xx + zz + n / 6, 4) AS iyy, round(xx + yy + n / 6, 4) AS izz, round(-xy, 4) + 0 AS ixy, round(-xz, 4) + 0 AS ixz, round(-yz, 4) + 0 AS iyz, round(2 * (xx + yy + zz) + n / 2, 4) AS trace FROM p""")
def particle_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = particles.tensors(components.connected_components(grains(spark, sf_dir), ["c"]), ["c"])
    trace = F.round(F.col("i1") + F.col("i2") + F.col("i3"), 4).alias("trace")
    return found.select("c", "label", *((F.round(k, 4) + F.lit(0.0)).alias(k) for k in ("ixx", "iyy", "izz", "ixy", "ixz", "iyz")), trace)


@query(f"""WITH RECURSIVE {LABEL_SQL}, face AS (SELECT DISTINCT c, label, 2 * x + i AS cx, 2 * y + j AS cy, 2 * z + k AS cz FROM lab, (SELECT unnest([0, 1, 2]) AS i), (SELECT unnest([0, 1, 2]) AS j), (SELECT unnest([0, 1, 2]) AS k)),
chi AS (SELECT c, label, sum(CASE WHEN (cx + cy + cz) % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS chi FROM face GROUP BY c, label),
box AS (SELECT c, label, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_, min(z) AS az, max(z) AS bz FROM lab GROUP BY c, label),
room AS MATERIALIZED (SELECT c, p, x, y, z, ((z + 1)::BIGINT * 1048576 + y + 1) * 1048576 + x + 1 AS id FROM (SELECT b.c, b.label AS p, x.x, y.y, z.z FROM box b, LATERAL (SELECT unnest(range(ax - 1, bx + 2)) AS x) x, LATERAL (SELECT unnest(range(ay - 1, by_ + 2)) AS y) y, LATERAL (SELECT unnest(range(az - 1, bz + 2)) AS z) z) g
  WHERE NOT EXISTS (SELECT 1 FROM lab l WHERE l.c = g.c AND l.label = g.p AND l.x = g.x AND l.y = g.y AND l.z = g.z)),
step AS MATERIALIZED (SELECT a.c, a.p, a.id AS u, b.id AS v FROM room a, (SELECT unnest([[1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1]]) AS d) d, room b WHERE b.c = a.c AND b.p = a.p AND b.x = a.x + d[1] AND b.y = a.y + d[2] AND b.z = a.z + d[3]),
{labelled_sql("hole", "room", "step", "c, p")},
n AS (SELECT c, p AS label, count(DISTINCT label) - 1 AS cavities FROM hole GROUP BY c, p)
SELECT c, label, chi, cavities, cavities - chi + 1 AS holes FROM chi JOIN n USING (c, label)""")
def particle_cavities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles.euler(components.connected_components(grains(spark, sf_dir), ["c"]), ["c"]).select("c", "label", "chi", "cavities", "holes")


@query(f"""WITH RECURSIVE {LABEL_SQL}, config AS (SELECT c, label, x - (i & 1) AS x, y - ((i >> 1) & 1) AS y, z - (i >> 2) AS z, bit_or(1 << i) AS config FROM lab, (SELECT unnest(range(8)::INT[]) AS i) GROUP BY ALL)
SELECT c, label, round(sum({_AREA}[config + 1]), 4) AS area, round(abs(sum({_FLUX}[config + 1] * z + {_REST}[config + 1])), 4) AS volume FROM config GROUP BY c, label""")
def particle_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = particles.surfaces(components.connected_components(grains(spark, sf_dir), ["c"]), ["c"])
    return found.select("c", "label", F.round("area", 4).alias("area"), F.round("volume", 4).alias("volume"))


@query(f"""WITH RECURSIVE {LABEL_SQL}, s AS (SELECT c, label, count(*) * 0.125 AS volume FROM lab GROUP BY c, label), {BACKGROUND_SQL}
SELECT c, x, y, z, volume::DOUBLE AS volume FROM lab JOIN s USING (c, label) UNION ALL SELECT c, x::INT, y::INT, z::INT, 0 FROM bg""")
def painted_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fg = grains(spark, sf_dir)
    labels = components.connected_components(fg, ["c"])
    return components.painted(labels, components.sizes(labels, ["c"], 0.125), ["c"], "volume", components.complement(fg, ["c"], SHAPE))


@query(f"""WITH RECURSIVE {LABEL_SQL}, {BACKGROUND_SQL}, {thickness_sql("fg", "bg")},
s AS (SELECT c, label, count(*) AS size, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, sum(thickness) / count(*) AS thickness FROM lab JOIN t USING (c, x, y, z) GROUP BY c, label),
f AS (SELECT a.c, a.label, max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS feret FROM lab a JOIN lab b ON b.c = a.c AND b.label = a.label GROUP BY a.c, a.label)
SELECT c, label, row_number() OVER (PARTITION BY c ORDER BY label) AS particle, size, min_x, max_x, min_y, max_y, min_z, max_z, round(thickness, 6) AS thickness, round(CASE WHEN size > 1 THEN feret END, 6) AS feret FROM s JOIN f USING (c, label)""")
def particle_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = particles.analyse(grains(spark, sf_dir), ["c"], image=SHAPE)
    plain = found.select("c", "label", F.col("particle").cast("bigint").alias("particle"), "size", *(f"{e}_{k}" for k in "xyz" for e in ("min", "max")))
    return plain.join(found.select("c", "label", r6("thickness").alias("thickness"), r6("feret").alias("feret")), ["c", "label"])


# ---- graphs

GRAPH_SQL = """branch AS (SELECT l_linenumber AS c, l_suppkey % 50 AS v1, (l_suppkey % 50 * 7 + l_linenumber * (1 + l_partkey % 2)) % 50 AS v2, avg(l_quantity) AS length, count(*) AS slabs FROM lineitem GROUP BY ALL),
vertex AS (SELECT DISTINCT c, v AS vertex, CASE WHEN v % 3 = 0 THEN 'end' ELSE 'junction' END AS kind, v % 4 + 1 AS voxels, (v * 13 % 17)::DOUBLE AS x, (v * 5 % 11)::DOUBLE AS y, (v % 7)::DOUBLE AS z FROM (SELECT c, v1 AS v FROM branch UNION SELECT c, v2 FROM branch)),
node AS (SELECT c, vertex AS id FROM vertex), edge AS (SELECT c, v1 AS u, v2 AS v FROM branch UNION SELECT c, v2, v1 FROM branch),
""" + labelled_sql("lab", "node", "edge", "c")


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and branches of a graph for each line number."""
    v1, c = F.col("l_suppkey") % 50, F.col("l_linenumber")
    branches = table(spark, sf_dir, "lineitem").groupBy(c.alias("c"), v1.alias("v1"), ((v1 * 7 + c * (1 + F.col("l_partkey") % 2)) % 50).alias("v2")).agg(F.avg("l_quantity").alias("length"), F.count(F.lit(1)).alias("slabs"))
    v = F.col("vertex")
    vertices = branches.select("c", F.col("v1").alias("vertex")).union(branches.select("c", "v2")).distinct()
    vertices = vertices.select("c", "vertex", F.when(v % 3 == 0, "end").otherwise("junction").alias("kind"), (v % 4 + 1).alias("voxels"), (v * 13 % 17).cast("double").alias("x"), (v * 5 % 11).cast("double").alias("y"), (v % 7).cast("double").alias("z"))
    return vertices, branches


@query(f"""WITH RECURSIVE {GRAPH_SQL}, own AS (SELECT v.*, l.label AS skeleton FROM vertex v JOIN lab l ON l.c = v.c AND l.id = v.vertex),
degree AS (SELECT c, vertex, count(*) AS degree FROM (SELECT c, v1 AS vertex FROM branch UNION ALL SELECT c, v2 FROM branch) GROUP BY c, vertex),
v AS (SELECT c, skeleton, count(*) FILTER (kind = 'junction') AS junctions, count(*) FILTER (kind = 'end') AS end_points, coalesce(sum(voxels) FILTER (kind = 'junction'), 0)::BIGINT AS junction_voxels,
  count(*) FILTER (kind = 'junction' AND degree = 3) AS triple_points, count(*) FILTER (kind = 'junction' AND degree = 4) AS quadruple_points FROM own LEFT JOIN degree USING (c, vertex) GROUP BY c, skeleton),
b AS (SELECT branch.c, skeleton, count(*) AS branches, sum(slabs)::BIGINT AS slab_voxels, round(avg(length), 6) AS mean_length, round(max(length), 6) AS max_length FROM branch JOIN own ON own.c = branch.c AND own.vertex = branch.v1 GROUP BY branch.c, skeleton)
SELECT * FROM v JOIN b USING (c, skeleton)""")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = skeleton.summary(*_graph(spark, sf_dir), ["c"])
    return found.withColumns({"mean_length": r6("mean_length"), "max_length": r6("max_length")})


@query(f"""WITH RECURSIVE {GRAPH_SQL} SELECT b.c, l.label AS skeleton, row_number() OVER (PARTITION BY b.c, l.label ORDER BY length DESC, v1, v2)::INT AS branch, round(length, 6) AS length,
  round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2), 6) AS distance FROM branch b JOIN lab l ON l.c = b.c AND l.id = b.v1 JOIN vertex p ON p.c = b.c AND p.vertex = b.v1 JOIN vertex q ON q.c = b.c AND q.vertex = b.v2""")
def ranked_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.ranked_branches(*_graph(spark, sf_dir), ["c"]).select("c", "skeleton", "branch", r6("length").alias("length"), r6("distance").alias("distance"))


@query(f"""WITH RECURSIVE {GRAPH_SQL}, n AS (SELECT c, label, count(*) AS n FROM lab GROUP BY c, label), top AS (SELECT c, label FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, label) AS k FROM n) WHERE k = 1)
SELECT l.c, l.id AS vertex FROM lab l JOIN top USING (c, label)""")
def largest_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.largest_graph(*_graph(spark, sf_dir), ["c"])[0].select("c", "vertex")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, kept AS (SELECT DISTINCT c, v1, v2 FROM branch WHERE v1 <> v2),
arm AS (SELECT c, v1 AS vertex, v2 AS far FROM kept UNION ALL SELECT c, v2, v1 FROM kept),
d AS (SELECT a.c, a.vertex, a.far, q.x - p.x AS x, q.y - p.y AS y, q.z - p.z AS z, count(*) OVER (PARTITION BY a.c, a.vertex) AS valence FROM arm a JOIN vertex p ON p.c = a.c AND p.vertex = a.vertex JOIN vertex q ON q.c = a.c AND q.vertex = a.far)
SELECT a.c, a.vertex, a.valence, round(acos(least(1.0, greatest(-1.0, (a.x * b.x + a.y * b.y + a.z * b.z) / (sqrt(a.x ** 2 + a.y ** 2 + a.z ** 2) * sqrt(b.x ** 2 + b.y ** 2 + b.z ** 2))))), 5) AS angle
FROM d a JOIN d b ON b.c = a.c AND b.vertex = a.vertex AND a.far < b.far WHERE a.valence BETWEEN 3 AND 5""")
def graph_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.junction_angles(*_graph(spark, sf_dir), ["c"], 3, 5).withColumn("angle", F.round("angle", 5))


@query(f"""WITH RECURSIVE {GRAPH_SQL}, way AS (SELECT c, v1 AS u, v2 AS v, length FROM branch UNION ALL SELECT c, v2, v1, length FROM branch),
far(c, s, t, d) USING KEY (c, s, t) AS (SELECT c, id, id, 0.0::DOUBLE FROM node
  UNION SELECT f.c, f.s, w.v, min(f.d + w.length) FROM far f JOIN way w ON w.c = f.c AND w.u = f.t LEFT JOIN recurring.far o ON o.c = f.c AND o.s = f.s AND o.t = w.v WHERE o.d IS NULL OR f.d + w.length < o.d - 1e-9 GROUP BY f.c, f.s, w.v)
SELECT f.c, l.label AS skeleton, round(max(d), 5) AS length FROM far f JOIN lab l ON l.c = f.c AND l.id = f.s GROUP BY f.c, l.label""")
def graph_longest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.longest_shortest_paths(*_graph(spark, sf_dir), ["c"]).select("c", "skeleton", F.round("length", 5).alias("length"))


# ---- ellipsoids

IMAGE_SQL = ASSIGN_SQL + """, image AS (SELECT n.n AS run, c, x, y, z, sum((ra / rb - rb / rc) * ra * rb * rc) / sum(ra * rb * rc) AS ef, sum(ra / rb * ra * rb * rc) / sum(ra * rb * rc) AS a_b, sum(rb / rc * ra * rb * rc) / sum(ra * rb * rc) AS b_c
  FROM held, (SELECT unnest([1, 2, 3]) AS n) n WHERE rank < n.n GROUP BY ALL)"""
PLACE_SQL = "c, floor({b_c} * 511 + 0.5 + 1e-9)::INT AS col, (511 - floor({a_b} * 511 + 0.5 + 1e-9))::INT AS row"
C = ["c"]


def _image(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return ellipsoids.factor_image(peaks_assigned(spark, sf_dir, n), C)


@query(f"""WITH {IMAGE_SQL} SELECT {PLACE_SQL.format(b_c="b_c", a_b="a_b")}, count(*) AS n FROM image WHERE run = 1 GROUP BY ALL""")
def flinn_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ellipsoids.flinn(_image(spark, sf_dir, 1), keys=C)


@query(f"""WITH {ASSIGN_SQL} SELECT {PLACE_SQL.format(b_c="rb / rc", a_b="ra / rb")}, count(*) AS n FROM held WHERE rank = 0 GROUP BY ALL""")
def flinn_peak_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ellipsoids.flinn_peaks(peaks_assigned(spark, sf_dir, 3), keys=C)


@query(f"""WITH {PEAKS_SQL} SELECT DISTINCT {PLACE_SQL.format(b_c="rb / rc", a_b="ra / rb")} FROM n""")
def flinn_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ellipsoids.unweighted_flinn(peak_ellipsoids(foreground(spark, sf_dir)), keys=C)


@query(f"""WITH {IMAGE_SQL}, every AS (SELECT c, count(*) AS n FROM fg GROUP BY c) SELECT c, round(median(ef), 6) AS median, round(max(ef), 6) AS max, round(min(ef), 6) AS min, round(count(*) * 100.0 / any_value(n), 6)::DOUBLE AS filling FROM image JOIN every USING (c) WHERE run = 2 GROUP BY c""")
def ef_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ellipsoids.statistics(_image(spark, sf_dir, 2), foreground(spark, sf_dir), C)
    return found.select("c", *(r6(k).alias(k) for k in ("median", "max", "min", "filling")))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs, each with other voxels left empty."""
    parts = [_image(spark, sf_dir, n).where((F.col("x") + F.col("y") + n) % 3 != 0).withColumn("run", F.lit(n)) for n in (1, 2, 3)]
    return reduce(DataFrame.unionByName, parts)


@query(f"""WITH {IMAGE_SQL}, v AS (SELECT c, x, y, z, max(ef) FILTER (run = 1) AS a, max(ef) FILTER (run = 2) AS b, max(ef) FILTER (run = 3) AS d FROM image WHERE (x + y + run) % 3 <> 0 GROUP BY ALL),
two AS (SELECT *, CASE WHEN a IS NULL THEN b * 2 WHEN b IS NULL THEN a * 2 ELSE a + b END AS s FROM v),
three AS (SELECT *, CASE WHEN s IS NULL THEN d * 3 WHEN d IS NULL THEN s * 1.5 ELSE s + d END AS t FROM two)
SELECT c, x, y, z, round(t / 3, 6) AS ef FROM three""")
def run_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ellipsoids.run_average(_runs(spark, sf_dir), 3, keys=C).select("c", "x", "y", "z", r6("ef").alias("ef"))


@query(f"""WITH {IMAGE_SQL}, d AS (SELECT c, abs(a.ef - b.ef) AS d FROM image a JOIN image b USING (c, x, y, z) WHERE a.run = 1 AND b.run = 3)
SELECT c, round(avg(d), 6) AS mean, round(max(d), 6) AS max, round(min(d), 6) AS min, round(percentile_disc(0.5) WITHIN GROUP (ORDER BY d DESC), 6) AS median FROM d GROUP BY c""")
def ef_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ellipsoids.convergence(_image(spark, sf_dir, 1), _image(spark, sf_dir, 3), C)
    return found.select("c", *(r6(k).alias(k) for k in ("mean", "max", "min", "median")))


@query(f"""WITH {FOREGROUND_SQL} SELECT c::INT AS search, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM fg""")
def seed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    fg = foreground(spark, sf_dir)
    return ellipsoids.seeds(*(fg.where(F.col("c") == c) for c in range(CHANNELS)))


@query(f"""WITH {ASSIGN_SQL} SELECT c, x, y, z, count(*) AS n FROM held GROUP BY c, x, y, z""")
def painted_ellipsoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    fg = foreground(spark, sf_dir)
    return ellipsoids.painted(fg, ellipsoids.with_tensors(peak_ellipsoids(fg)), keys=C)


@query()
def particle_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.per_particle(components.connected_components(grains(spark, sf_dir), ["c"]), ["c"])


# ---- whole measurements


@query(f"""SELECT c, z, n, csa, cx, cy, theta, imin, imax, r1, r2, zpol, perimeter, mean AS flat_mean, sd AS flat_sd, max AS flat_max, deep_mean
FROM ({SQL["slice_centroids"].replace("* 0.5, 6) AS cx", ", 6) AS cx").replace("* 0.25, 6) AS cy", ", 6) AS cy").replace("* 0.125 AS csa", "* 1.0 AS csa")}) JOIN ({SQL["slice_moments"]}) USING (c, z)
JOIN ({SQL["slice_perimeter"].replace("THEN 0.25 ELSE 0.5", "THEN 1 ELSE 1")}) USING (c, z) JOIN ({SQL["slice_thickness"]}) USING (c, z) JOIN (SELECT c, z, mean AS deep_mean FROM ({SQL["slice_thickness_of_stack"]})) USING (c, z)""")
def slice_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = commands.slice_geometry(foreground(spark, sf_dir), ["c"], SHAPE)
    four = {k: F.round(k, 4) for k in ("theta", "imin", "imax", "r1", "r2", "zpol")}
    six = {k: r6(k) for k in ("cx", "cy", "flat_mean", "flat_sd", "flat_max", "deep_mean")}
    return found.withColumns(four | six).withColumn("csa", F.col("csa").cast("double")).select("c", "z", "n", "csa", "cx", "cy", *four, "perimeter", "flat_mean", "flat_sd", "flat_max", "deep_mean")


@query(f"""SELECT c, round(trace * n, 2) AS trace, n::BIGINT AS n, cx, cy, cz FROM ({SQL["principal_moments"]}) JOIN (SELECT c, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z) + 1, 6) AS cz FROM (WITH {FOREGROUND_SQL} SELECT * FROM fg) GROUP BY c) USING (c)""")
def whole_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = commands.moments_of(foreground(spark, sf_dir), ["c"], SHAPE)
    trace = F.round(r6((F.col("i1") + F.col("i2") + F.col("i3")) / F.col("n")) * F.col("n"), 2)
    return found.select("c", trace.alias("trace"), "n", *(r6(k).alias(k) for k in ("cx", "cy", "cz")))


@query(f"""WITH {CELL_SQL}, v AS (SELECT c, x * 0.5 AS x, y * 0.5 AS y, z * 2.0 AS z, greatest(0, (value * 0.25 + 1.5) / 1000) * 0.5 AS m FROM cell WHERE value * 3.0 - 10 BETWEEN -6 AND 11 AND z BETWEEN 1 AND 7),
a AS (SELECT c, count(*) AS n, sum(m) AS mass, sum(m * x) / sum(m) AS mx, sum(m * y) / sum(m) AS my, sum(m * z) / sum(m) AS mz FROM v GROUP BY c)
SELECT c, any_value(n) * 0.5::DOUBLE AS volume, round(sum(m), 8) AS mass, round(any_value(mx), 6) AS cx, round(any_value(my), 6) AS cy, round(any_value(mz) + 2, 6) AS cz,
  round(sum(m * ((y - my) ** 2 + (z - mz) ** 2 + 4.25 / 12)), 5) AS ixx, round(sum(m * ((x - mx) ** 2 + (z - mz) ** 2 + 4.25 / 12)), 5) AS iyy, round(sum(m * ((x - mx) ** 2 + (y - my) ** 2 + 0.5 / 12)), 5) AS izz,
  round(-sum(m * (x - mx) * (y - my)), 5) + 0 AS ixy, round(-sum(m * (x - mx) * (z - mz)), 5) + 0 AS ixz, round(-sum(m * (y - my) * (z - mz)), 5) + 0 AS iyz FROM v JOIN a USING (c) GROUP BY c""")
def density_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments by density, of slices 2 to 8 between thresholds in Hounsfield units."""
    found = commands.image_moments(voxelize(spark, sf_dir), ["c"], SHAPE, (0.5, 0.5, 2.0), 2, 8, -6, 11, (3.0, -10.0), 0.25, 1.5, "mm")
    five = ((F.round(k, 5) + F.lit(0.0)).alias(k) for k in ("ixx", "iyy", "izz", "ixy", "ixz", "iyz"))
    return found.select("c", "volume", F.round("mass", 8).alias("mass"), *(r6(k).alias(k) for k in ("cx", "cy", "cz")), *five)


@query(f"""WITH {CELL_SQL} SELECT c, count(*) AS n, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy, sum(z)::BIGINT AS sz FROM cell WHERE value BETWEEN 3 AND 6 GROUP BY c""")
def checked_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The foreground of a thresholded image of all channels, once it is checked."""
    fg = commands.checked_image(filters.to_mask(voxelize(spark, sf_dir), 3, 6), ["c"], SHAPE)
    return fg.groupBy("c").agg(F.count(F.lit(1)).alias("n"), *(F.sum(k).alias(f"s{k}") for k in "xyz"))


@query()
def analysed_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.analysed_skeletons(grains(spark, sf_dir), ["c"], SHAPE)[0]


@query("""WITH node AS (SELECT i.i, j.j, k.k FROM (SELECT unnest([0, 1, 2]) AS i) i, (SELECT unnest([0, 1, 2]) AS j) j, (SELECT unnest([0, 1, 2]) AS k) k),
arm AS (SELECT i, j, k, d, row_number() OVER (PARTITION BY i, j, k ORDER BY d) AS a, count(*) OVER (PARTITION BY i, j, k) AS valence FROM node, (SELECT unnest([[1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1]]) AS d) d
  WHERE i + d[1] BETWEEN 0 AND 2 AND j + d[2] BETWEEN 0 AND 2 AND k + d[3] BETWEEN 0 AND 2)
SELECT p.valence, round(acos((p.d[1] * q.d[1] + p.d[2] * q.d[2] + p.d[3] * q.d[3])::DOUBLE), 5) AS angle, count(*) * (SELECT count(*) FROM region) AS n FROM arm p JOIN arm q ON p.i = q.i AND p.j = q.j AND p.k = q.k AND p.a < q.a GROUP BY ALL""")
def branch_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles by valence in lattices of three lines each way, one for each region, whose outer ends are pruned."""
    at = {k: F.floor(F.col("id") / 25**i) % 25 for i, k in enumerate("xyz")}
    lattice = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(25**3 - 1))).alias("id")).select("c", *(v.cast("int").alias(k) for k, v in at.items()))
    lattice = lattice.where(sum((F.col(k) % 8 == 4).cast("int") for k in "xyz") >= 2)
    angles, _ = commands.branch_angles(lattice, ["c"], (25, 25, 25), most_valence=8, thin=False)
    return angles.groupBy("valence", F.round("angle", 5).alias("angle")).agg(F.count(F.lit(1)).alias("n"))
