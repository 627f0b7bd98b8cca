"""Round trips through files, tables of results and header tags over the driver's tables, with their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators import mesh
from lamella.plans.measures import CHANNELS, CONFIG_SQL, query, r6
from lamella.results import pivoted
from lamella.sources import raw, volume
from lamella.sources.tables import CELL_SQL, SHAPE, foreground, table, voxelize
from lamella.storage import shared_dir

W, H, D = SHAPE


def _folder(spark: SparkSession, name: str) -> str:
    found = shared_dir(spark)
    return f"{found if '://' in found else 'file://' + found.removeprefix('file:')}/lamella-{name}-{uuid.uuid4().hex}"


@query(f"""WITH {CELL_SQL} SELECT c.c::INT AS c, x.x::INT AS x, y.y::INT AS y, z.z::INT AS z, coalesce(value, 0)::DOUBLE AS value FROM (SELECT unnest([0, 1, 2]) AS c) c, (SELECT unnest(range({W})) AS x) x, (SELECT unnest(range({H})) AS y) y, (SELECT unnest(range({D})) AS z) z
LEFT JOIN cell v ON v.c = c.c AND v.x = x.x AND v.y = y.y AND v.z = z.z""")
def raw_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every channel written as big-endian slices and read back."""
    folder = _folder(spark, "raw")
    for c in range(CHANNELS):
        raw.write_raw(voxelize(spark, sf_dir).where(F.col("c") == c), folder, f"channel{c}", SHAPE, "uint16", False)
    back = raw.read_raw(spark, f"{folder}/channel*.raw", (W, H, 1), "uint16", byte_order="Big-endian")
    c, z = (F.regexp_extract("image_id", r"(\d)-(\d+)\.raw$", i).cast("int") for i in (1, 2))
    return back.select(c.alias("c"), "x", "y", z.alias("z"), "value")


@query(f"""WITH {CELL_SQL} SELECT c.c::INT AS c, k.kind, x.x::INT AS x, y.y::INT AS y, z.z::INT AS z, CASE WHEN k.kind = 'bit' THEN (v.value IS NOT NULL)::INT ELSE coalesce(v.value, 0) END::DOUBLE AS value
FROM (SELECT unnest([0, 1, 2]) AS c) c, (SELECT unnest(['uint16', 'bit']) AS kind) k, (SELECT unnest(range({W})) AS x) x, (SELECT unnest(range({H})) AS y) y, (SELECT unnest(range({D})) AS z) z LEFT JOIN cell v ON v.c = c.c AND v.x = x.x AND v.y = y.y AND v.z = z.z""")
def volume_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every channel as one big-endian file and one of bits, each written and read back by slabs of slices."""
    folder, parts = _folder(spark, "volume"), []
    for c in range(3):
        own = voxelize(spark, sf_dir).where(F.col("c") == c)
        for kind in ("uint16", "bit"):
            volume.save(own, f"{folder}/{c}-{kind}.raw", SHAPE, kind, "Big-endian", slab_bytes=2000)
            back = volume.load(spark, f"{folder}/{c}-{kind}.raw", SHAPE, kind, byte_order="Big-endian", slab_bytes=2000)
            parts.append(back.select(F.lit(c).alias("c"), F.lit(kind).alias("kind"), "x", "y", "z", "value"))
    return reduce(DataFrame.union, parts)


_FACETS = str([len(mesh.triangles(c)) for c in range(256)])


@query(f"""WITH {CONFIG_SQL}, n AS (SELECT c, sum({_FACETS}[config + 1])::BIGINT AS facets FROM config GROUP BY c) SELECT c, facets, 84 + 50 * facets AS bytes, 'surface_c_' || c || '.stl' AS name FROM n""")
def stl_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "stl")
    made = raw.write_stl(mesh.mesh(foreground(spark, sf_dir), ["c"]), ["c"], folder, "surface.tif").select("c", "facets").collect()
    made = spark.createDataFrame(made, "c int, facets bigint")  # a row a file
    files = spark.read.format("binaryFile").load(f"{folder}/*.stl").select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))
    return files.withColumn("c", F.regexp_extract("name", r"_c_(\d+)\.stl$", 1).cast("int")).join(made, "c").select("c", "facets", "bytes", "name")


@query("""WITH v AS (SELECT l_returnflag AS label, l_linenumber AS seq, l_linestatus AS header, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY label, header ORDER BY seq) AS row FROM v)
SELECT label, row::INT AS row, max(value) FILTER (header = 'F') AS F, max(value) FILTER (header = 'O') AS O FROM n GROUP BY label, row""")
def results_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("label"), F.col("l_linenumber").alias("seq"), F.col("l_linestatus").alias("header")).agg(r6(F.avg("l_quantity")).alias("value"))
    return pivoted(values, ["F", "O"])


@query("""SELECT o_orderkey, round(o_totalprice, 2) AS slope, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE -1.5 END::DOUBLE AS intercept FROM orders""")
def header_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string")
    header = F.concat(F.lit("0028,1053  Rescale Slope: "), price, F.when(F.col("o_orderkey") % 3 == 0, "\n").otherwise("\n0028,1052  Rescale Intercept: -1.5\n"))
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.tag(header, "0028,1053").alias("slope"), raw.tag(header, "0028,1052").alias("intercept"))
