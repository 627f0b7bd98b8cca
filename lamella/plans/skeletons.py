"""Skeletons, their pruning and contraction over the driver's tables, with their SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators import components, moments, outlines, pruning, skeleton, topology
from lamella.plans.measures import LABEL_SQL, SQL, query, r6
from lamella.plans.structures import labelled_sql
from lamella.sources.tables import FOREGROUND_SQL, GRAINS_SQL, foreground, grains, table, voxelize
from lamella.storage import written


@query(f"""WITH RECURSIVE {LABEL_SQL}, cell_ AS (SELECT DISTINCT c, 2 * x + i AS cx, 2 * y + j AS cy, 2 * z + k AS cz FROM fg, (SELECT unnest([0, 1, 2]) AS i), (SELECT unnest([0, 1, 2]) AS j), (SELECT unnest([0, 1, 2]) AS k)),
chi AS (SELECT c, sum(CASE WHEN (cx + cy + cz) % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS chi FROM cell_ GROUP BY c)
SELECT c, chi, n AS particles FROM chi JOIN (SELECT c, count(DISTINCT label) AS n FROM lab GROUP BY c) USING (c)""")
def skeleton_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Euler number and particles of the skeletons, which are those of the grains that they are made of."""
    thin = written(skeleton.skeletonise(grains(spark, sf_dir), ["c"]), "skeleton")
    particles = components.connected_components(thin, ["c"]).select("c", "label").distinct().groupBy("c").agg(F.count(F.lit(1)).alias("particles"))
    return topology.euler(thin, ["c"]).select("c", "chi").join(particles, "c")


@query(f"""WITH {GRAINS_SQL}, n AS (SELECT a.c, a.x, a.y, a.z, count(b.x) AS n FROM fg a LEFT JOIN fg b ON b.c = a.c AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1 AND abs(b.z - a.z) <= 1 AND (b.x <> a.x OR b.y <> a.y OR b.z <> a.z) GROUP BY ALL)
SELECT c, x, y, z, CASE WHEN n <= 1 THEN 30 WHEN n = 2 THEN 127 ELSE 70 END AS tag FROM n""")
def tagged_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pruning.tagged(grains(spark, sf_dir), ["c"])


STRONG_SQL = """item AS (SELECT l_linenumber AS c, l_suppkey % 50 AS v1, (l_suppkey % 50 * 7 + l_linenumber * (1 + l_partkey % 2)) % 50 AS v2, l_quantity::BIGINT AS q, round(l_discount * 100)::BIGINT AS d, round(l_tax * 100)::BIGINT AS t FROM lineitem),
one AS (SELECT c, v1, v2, sum(q)::BIGINT * 1000 // count(*) AS length, min(d) AS least, sum(t)::BIGINT * 1000 // count(*) AS mean FROM item GROUP BY ALL)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c, v1, v2, length, least, mean): a branch of a graph for each line number, whose items stand for its voxels."""
    v1, c = F.col("l_suppkey") % 50, F.col("l_linenumber")
    own = table(spark, sf_dir, "lineitem").select(c.alias("c"), v1.alias("v1"), ((v1 * 7 + c * (1 + F.col("l_partkey") % 2)) % 50).alias("v2"), F.col("l_quantity").cast("bigint").alias("q"), F.round(F.col("l_discount") * 100).cast("bigint").alias("d"), F.round(F.col("l_tax") * 100).cast("bigint").alias("t"))
    return own.groupBy("c", "v1", "v2").agg(F.expr("sum(q) * 1000 div count(1)").alias("length"), F.min("d").alias("least"), F.expr("sum(t) * 1000 div count(1)").alias("mean"))


@query(f"""WITH RECURSIVE {STRONG_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY c, method ORDER BY s DESC, least(v1, v2), greatest(v1, v2)) AS k
  FROM (SELECT c, 'shortest_branch' AS method, v1, v2, length AS s FROM one UNION ALL SELECT c, 'lowest_voxel', v1, v2, least FROM one UNION ALL SELECT c, 'lowest_branch', v1, v2, mean FROM one)),
reach(c, method, k, v) AS (SELECT c, method, k, v1 FROM b WHERE v1 <> v2 UNION SELECT r.c, r.method, r.k, CASE WHEN b.v1 = r.v THEN b.v2 ELSE b.v1 END FROM reach r JOIN b ON b.c = r.c AND b.method = r.method AND b.k < r.k AND (b.v1 = r.v OR b.v2 = r.v))
SELECT c, method, least(v1, v2) AS a, greatest(v1, v2) AS b, s FROM b WHERE v1 = v2 OR EXISTS (SELECT 1 FROM reach r WHERE r.c = b.c AND r.method = b.method AND r.k = b.k AND r.v = b.v2)""")
def cycle_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pruning takes of each graph by length, by its lowest voxel and by its lowest branch: those that close a cycle of stronger ones."""
    parts = {"shortest_branch": "length", "lowest_voxel": "least", "lowest_branch": "mean"}
    ways = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(k).alias("s")) for m, k in parts.items())))
    branches = _items(spark, sf_dir).select("c", "v1", "v2", ways.alias("w")).select("c", "w.method", "v1", "v2", "w.s")
    gone = pruning.cycle_branches(written(branches, "branches"), ["c", "method"], [F.col("s")])
    return gone.select("c", "method", F.least("v1", "v2").alias("a"), F.greatest("v1", "v2").alias("b"), "s")


@query(f"""WITH {STRONG_SQL}, short AS (SELECT c, least(v1, v2) AS a, greatest(v1, v2) AS b, min(length) AS length FROM one WHERE v1 <> v2 AND v1 % 3 <> 0 AND v2 % 3 <> 0 AND length < 25500 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY length, a, b) AS k FROM short),
low AS (SELECT c, v, min(k) AS k FROM (SELECT c, a AS v, k FROM r UNION ALL SELECT c, b, k FROM r) GROUP BY c, v),
m AS (SELECT r.c, a, b FROM r JOIN low p ON p.c = r.c AND p.v = r.a AND p.k = r.k JOIN low q ON q.c = r.c AND q.v = r.b AND q.k = r.k),
v AS (SELECT DISTINCT c, v AS vertex, v % 4 + 1 AS voxels, v * 13 % 17 AS x, v * 5 % 11 AS y, v % 7 AS z FROM (SELECT c, v1 AS v FROM one UNION SELECT c, v2 FROM one))
SELECT v.c, coalesce(m.a, v.vertex) AS vertex, sum(voxels)::BIGINT AS voxels, round(sum(x * voxels) / sum(voxels)::DOUBLE, 6) AS x, round(sum(y * voxels) / sum(voxels)::DOUBLE, 6) AS y, round(sum(z * voxels) / sum(voxels)::DOUBLE, 6) AS z FROM v LEFT JOIN m ON m.c = v.c AND m.b = v.vertex GROUP BY ALL""")
def contracted_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertices of each graph once a matching of its short branches, shortest first, is contracted."""
    branches = written(_items(spark, sf_dir).select("c", "v1", "v2", F.col("length").cast("double").alias("length")), "branches")
    v = F.col("vertex")
    vertices = branches.select("c", F.col("v1").alias("vertex")).union(branches.select("c", "v2")).distinct()
    vertices = vertices.select("c", "vertex", F.when(v % 3 == 0, "end").otherwise("junction").alias("kind"), (v % 4 + 1).alias("voxels"), (v * 13 % 17).cast("double").alias("x"), (v * 5 % 11).cast("double").alias("y"), (v % 7).cast("double").alias("z"))
    return pruning.contract(vertices, branches, ["c"], 25500.0)[0].select("c", "vertex", "voxels", r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"))


@query()
def contracted_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles at the junctions of the grains' skeletons, once no branch between junctions is shorter than three voxels."""
    thin = written(skeleton.skeletonise(grains(spark, sf_dir), ["c"]), "skeleton")
    vertices, branches = skeleton.graph(thin, ["c"])
    vertices, branches = pruning.contract(vertices, branches, ["c"], 3.0, iterate=True)
    return skeleton.junction_angles(vertices, branches, ["c"], 3, 8)


@query()
def pruned_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tagged voxels of the grains' skeletons without cycles, cut where the image of counts is lowest, and without dead ends."""
    thin = written(skeleton.skeletonise(grains(spark, sf_dir), ["c"]), "skeleton")
    open_ = written(pruning.prune_cycles(thin, ["c"], "lowest_voxel", voxelize(spark, sf_dir)), "opened")
    return pruning.tagged(written(pruning.prune_ends(open_, ["c"]), "pruned"), ["c"])


# ---- outlines

OUTLINE_SQL = FOREGROUND_SQL + """, side AS (SELECT unnest([[0, 0, -1, 0, 0, 1, 0], [1, 1, 0, 1, 0, 0, 1], [2, 0, 1, 1, 1, -1, 0], [3, -1, 0, 0, 1, 0, -1]]) AS s),
e AS MATERIALIZED (SELECT c, z, s[1] AS d, x + s[4] AS x, y + s[5] AS y, x + s[4] + s[6] AS ex, y + s[5] + s[7] AS ey, ((y + s[5])::BIGINT * 1048576 + x + s[4]) * 4 + s[1] AS id FROM fg f, side
  WHERE NOT EXISTS (SELECT 1 FROM fg o WHERE o.c = f.c AND o.z = f.z AND o.x = f.x + s[2] AND o.y = f.y + s[3])),
link AS MATERIALIZED (SELECT a.c, a.z, a.id AS u, min_by(b.id, (b.d - a.d + 5) % 4) AS v FROM e a JOIN e b ON b.c = a.c AND b.z = a.z AND b.x = a.ex AND b.y = a.ey GROUP BY a.c, a.z, a.id),
ways AS MATERIALIZED (SELECT c, z, u, v FROM link UNION ALL SELECT c, z, v, u FROM link)"""


@query(f"""WITH RECURSIVE {OUTLINE_SQL}, {labelled_sql("lab", "e", "ways", "c, z")}
SELECT e.c, e.z, l.label AS contour, count(*) AS edges, sum(abs(ex - x) * 0.5 + abs(ey - y) * 0.25)::DOUBLE AS perimeter, (sum(x * ey - ex * y) / 2 * 0.125)::DOUBLE AS area, sum(x * ey - ex * y) < 0 AS hole FROM e JOIN lab l ON l.c = e.c AND l.z = e.z AND l.id = e.id GROUP BY ALL""")
def slice_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every traced outline of every slice: its perimeter, area, and whether it is a hole."""
    return outlines.measured(outlines.contours(foreground(spark, sf_dir), ["c", "z"]), ["c", "z"], (0.5, 0.25))


@query(f"""WITH t AS (SELECT c, z, theta FROM ({SQL["slice_moments"]}) WHERE theta IS NOT NULL), v AS (WITH {FOREGROUND_SQL} SELECT c, z, x + i AS x, y + j AS y FROM fg, (SELECT unnest([0, 1]) AS i) i, (SELECT unnest([0, 1]) AS j) j)
SELECT c, z, round(max(x * cos(theta) + y * sin(theta)) - min(x * cos(theta) + y * sin(theta)), 2) AS along, round(max(y * cos(theta) - x * sin(theta)) - min(y * cos(theta) - x * sin(theta)), 2) AS across FROM v JOIN t USING (c, z) GROUP BY c, z""")
def oriented_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extents of each slice's outlines along its principal direction and across it."""
    fg = foreground(spark, sf_dir)
    angles = moments.slice_moments(fg, ["c", "z"][:1]).select("c", "z", F.round("theta", 4).alias("theta"))
    found = outlines.oriented_diameters(outlines.contours(fg, ["c", "z"]), angles, ["c", "z"])
    return found.select("c", "z", F.round("along", 2).alias("along"), F.round("across", 2).alias("across"))


# ---- alignment


@query("""WITH m AS (SELECT vec_id, [{'e': embedding[10]::DOUBLE, 'j': 0, 'v': [embedding[1]::DOUBLE, embedding[4], embedding[7]]}, {'e': embedding[11]::DOUBLE, 'j': 1, 'v': [embedding[2]::DOUBLE, embedding[5], embedding[8]]}, {'e': embedding[12]::DOUBLE, 'j': 2, 'v': [embedding[3]::DOUBLE, embedding[6], embedding[9]]}] AS a FROM embeddings),
o AS (SELECT vec_id, list_sort(a) AS a FROM m),
c AS (SELECT vec_id, a[1].v AS p, a[2].v AS q, a[3].v AS r, a[1].v[3] + a[2].v[3] + a[3].v[3] < 0 AS z_flipped FROM o),
f AS (SELECT vec_id, p, CASE WHEN z_flipped THEN list_transform(q, lambda x: -x) ELSE q END AS q, CASE WHEN z_flipped THEN list_transform(r, lambda x: -x) ELSE r END AS r, z_flipped FROM c),
d AS (SELECT *, p[1] * (q[2] * r[3] - q[3] * r[2]) + p[2] * (q[3] * r[1] - q[1] * r[3]) + p[3] * (q[1] * r[2] - q[2] * r[1]) < 0 AS reflected FROM f),
g AS (SELECT vec_id, CASE WHEN reflected THEN list_transform(p, lambda x: -x) ELSE p END AS p, q, r, z_flipped, reflected FROM d)
SELECT vec_id, round(p[1], 6) AS v00, round(q[1], 6) AS v01, round(r[1], 6) AS v02, round(p[2], 6) AS v10, round(q[2], 6) AS v11, round(r[2], 6) AS v12, round(p[3], 6) AS v20, round(q[3], 6) AS v21, round(r[3], 6) AS v22, z_flipped, reflected FROM g""")
def ordered_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes and extents by the numbers of every vector, put in the order of an alignment."""
    own = table(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[3 * i + j].cast("double").alias(f"v{i}{j}") for i in range(3) for j in range(3)), *(F.col("embedding")[9 + j].alias(f"e{j}") for j in range(3)))
    found = moments.ordered_axes(own, ("e0", "e1", "e2")).drop("e0", "e1", "e2")
    return found.select("vec_id", *((F.round(f"v{i}{j}", 6) + F.lit(0.0)).alias(f"v{i}{j}") for i in range(3) for j in range(3)), "z_flipped", "reflected")


@query(f"""WITH {FOREGROUND_SQL}, a AS (SELECT c, z, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM fg GROUP BY c, z),
d AS (SELECT c, z, n, (y - cy) * 0.25 * cos(0.4) - (x - cx) * 0.5 * sin(0.4) AS p, (x - cx) * 0.5 * cos(0.4) + (y - cy) * 0.25 * sin(0.4) AS q FROM fg JOIN a USING (c, z)),
m AS (SELECT c, z, sum(p * p) * 0.125 + any_value(n) / 12 * 0.125 * (0.0625 * cos(0.4) ** 2 + 0.25 * sin(0.4) ** 2) AS i1, sum(q * q) * 0.125 + any_value(n) / 12 * 0.125 * (0.25 * cos(0.4) ** 2 + 0.0625 * sin(0.4) ** 2) AS i2, max(abs(p)) AS r1, max(abs(q)) AS r2 FROM d GROUP BY c, z)
SELECT c, z, round(i1, 4) AS i1, round(i2, 4) AS i2, round(r1, 4) AS r1, round(r2, 4) AS r2, round(i1 / r1, 4) AS z1, round(i2 / r2, 4) AS z2 FROM m""")
def slice_moments_about(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = moments.slice_moments_about(foreground(spark, sf_dir), ["c"], 0.4, (0.5, 0.25))
    return found.select("c", "z", *(F.round(k, 4).alias(k) for k in ("i1", "i2", "r1", "r2", "z1", "z2")))
