"""The half-hour indicators on a feed of clean readings.

The same aggregates as the batch stage on half-hour windows of the reading time; the
watermark bounds the state to the slots still open. Windows are instants, so the
repeated hour in autumn keeps its two sets of slots here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from slotwise.functions.numbers import round_binary

COLUMNS = ["station_id", "last_reported", "bikes", "docks"]
CLOSING_STATION = -1


def half_hour_stream(readings: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Indicators per station and half hour; readings later than ``delay`` are left out."""
    mean = lambda c: round_binary(F.avg(c), 2)
    timed = readings.withColumn("ts", F.timestamp_seconds("last_reported")).withWatermark("ts", delay)
    slots = timed.groupBy("station_id", F.window("ts", "30 minutes").alias("w")).agg(
        F.min("bikes").alias("min_bikes"), F.max("bikes").alias("max_bikes"), mean("bikes").alias("avg_bikes"),
        F.min("docks").alias("min_docks"), F.max("docks").alias("max_docks"), mean("docks").alias("avg_docks"),
        mean(F.col("bikes") + F.col("docks")).alias("avg_capacity"),
    )
    return slots.withColumn("slot", F.col("w.start")).drop("w")


def start(spark: SparkSession, source: str, target: str, checkpoint: str, delay: str = "2 hours"):
    """Process what is new in a folder of clean readings (parquet) and append closed slots to ``target``."""
    schema = spark.read.parquet(source).schema
    feed = spark.readStream.schema(schema).parquet(source)
    writer = half_hour_stream(feed, delay).writeStream.outputMode("append").format("parquet")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)


def replay_half_hours(cleaned: DataFrame, folder: str) -> DataFrame:
    """Run finished readings through the stream and return every slot.

    A closing reading of no station, a month later, moves the watermark past the
    slots still open at the end.
    """
    spark = cleaned.sparkSession
    rows = cleaned.select(*COLUMNS)
    rows.write.parquet(f"{folder}/readings/batch=0")
    start(spark, f"{folder}/readings", f"{folder}/slots", f"{folder}/state").awaitTermination()
    closing = rows.agg(F.max("last_reported").alias("t")).select(
        F.lit(CLOSING_STATION).alias("station_id"), (F.col("t") + 30 * 86_400).alias("last_reported"),
        F.lit(0).alias("bikes"), F.lit(0).alias("docks"),
    )
    closing.write.parquet(f"{folder}/readings/batch=1")
    start(spark, f"{folder}/readings", f"{folder}/slots", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/slots").where(F.col("station_id") != CLOSING_STATION)
