"""New data as it comes in: an optional layer over the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def on_new_rows(spark: SparkSession, path: str, schema: str, work: Callable[[DataFrame, int], None], checkpoint: str, files_at_once: int = 1000) -> StreamingQuery:
    """Run `work` on each batch of files that appear under path (by day or flat), once; ends when all there are have been worked on."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bars(ticks: DataFrame, time: str, security: str, price: str, volume: str, width: str, late: str) -> DataFrame:
    """First, highest, lowest, last price and volume of each security in windows of event time; ticks later than `late` are left out."""
    window = F.window(time, width)
    return (
        ticks.withWatermark(time, late)
        .groupBy(window.alias("window"), security)
        .agg(
            F.min_by(price, time).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, time).alias("close"),
            F.sum(volume).alias("volume"), F.count("*").alias("ticks"),
        )
        .select(security, F.col("window.start").alias("start"), "open", "high", "low", "close", "volume", "ticks")
    )
