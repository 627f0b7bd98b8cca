"""Voxel volumes from the driver's tables: a fixed mapping of line items to a 50 x 11 x 9 volume per channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHAPE = (50, 11, 9)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxelize(spark: SparkSession, sf_dir: str, by_year: bool = False) -> DataFrame:
    """(c, [t,] x, y, z, value): quantity, discount and tax are the position, the return flag the channel, the count the value."""
    items = table(spark, sf_dir, "lineitem")
    where = [(F.col("l_quantity").cast("int") - 1).alias("x"), F.round(F.col("l_discount") * 100).cast("int").alias("y"), F.round(F.col("l_tax") * 100).cast("int").alias("z")]
    channel = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    keys = [channel.alias("c"), *([(F.year("l_shipdate") - 1995).alias("t")] if by_year else []), *where]
    return items.groupBy(*keys).agg(F.count(F.lit(1)).alias("value"))


def above_mean(voxels: DataFrame, keys: list[str], tenths: int = 10) -> DataFrame:
    """The foreground: voxels of at least so many tenths of the mean value of their subspace, by whole numbers alone."""
    total = voxels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"), F.sum("value").alias("s_"))
    return voxels.join(total, keys).where(F.col("value") * F.col("n_") * 10 >= F.col("s_") * tenths).drop("n_", "s_")


def foreground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return above_mean(voxelize(spark, sf_dir), ["c"])


def grains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparser foreground, of many particles."""
    return above_mean(voxelize(spark, sf_dir), ["c"], 17)


TIMES = 4
SOLID_SHAPE = tuple(TIMES * n for n in SHAPE)


def solids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c, x, y, z): the foreground with TIMES^3 voxels for each of its own, in which ellipsoids can grow; a volume of SOLID_SHAPE."""
    own = foreground(spark, sf_dir).select("c", "x", "y", "z")
    for k in "xyz":
        own = own.withColumn(k, F.explode(F.sequence(F.col(k) * TIMES, F.col(k) * TIMES + TIMES - 1)))
    return own


#: The same in DuckDB's SQL, as the first parts of a WITH.
CELL_SQL = """cell AS (
  SELECT CAST(l_quantity AS INT) - 1 AS x, CAST(round(l_discount * 100) AS INT) AS y, CAST(round(l_tax * 100) AS INT) AS z,
    CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS c, count(*) AS value FROM lineitem GROUP BY ALL
)"""
FOREGROUND_SQL = CELL_SQL + """, fg AS (
  SELECT c, x, y, z, value FROM (SELECT *, count(*) OVER (PARTITION BY c) AS n, sum(value) OVER (PARTITION BY c) AS s FROM cell)
  WHERE value * n >= s
)"""
GRAINS_SQL = FOREGROUND_SQL.replace("value * n >= s", "value * n * 10 >= s * 17")
