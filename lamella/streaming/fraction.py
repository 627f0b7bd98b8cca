"""Running forms of additive measures: slices or events arrive as a stream, and windows of them are aggregated with late data cut
off by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_fraction(events: DataFrame, time: str, keys: list[str], value: str, threshold: float, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window, keys, n_fg, n_all and ratio of a stream (or a table) of values."""
    live = events.withWatermark(time, late) if events.isStreaming else events
    found = live.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count_if(F.col(value) >= threshold).alias("n_fg"), F.count(F.lit(1)).alias("n_all"))
    return found.select(F.col("w.start").alias("start"), *keys, "n_fg", "n_all", (F.col("n_fg") / F.col("n_all")).alias("ratio"))


def stream_to_table(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, make) -> None:
    """Runs make over the Parquet files of a folder as a stream until all are read, into Parquet files."""
    live = spark.readStream.schema(schema).parquet(source)
    make(live).writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
