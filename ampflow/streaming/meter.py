"""Live meters: sensor messages as a stream, hourly means out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampflow.schema import READINGS, SENSOR


def sensor_stream(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines that arrive as files: device_id, ts and the sensor's fields."""
    return spark.readStream.schema(f"device_id long, ts timestamp, {SENSOR}").json(path)


def hourly_means(messages: DataFrame, late: str = "1 hour") -> DataFrame:
    """device_id, ts, kwh of each closed hour; messages later than ``late`` are dropped.

    State is one running mean a device and open hour.
    """
    ok = messages.where("device_id is not null and power_W >= 0")
    hours = ok.withWatermark("ts", late).groupBy("device_id", F.window("ts", "1 hour")).agg(F.avg("power_W").alias("w"))
    return hours.select("device_id", F.col("window.start").alias("ts"), (F.col("w") / 1000).alias("kwh"))


def write_hours(hours: DataFrame, out: str, checkpoint: str):
    """Append closed hours to Parquet, exactly once; runs over what is there, then stops."""
    return hours.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hours_stream(spark: SparkSession, path: str) -> DataFrame:
    """The hours that ``write_hours`` appends, as a stream with their event time.

    Each batch of them lies after the one before, so none is late.
    """
    return spark.readStream.schema(READINGS).parquet(path).withWatermark("ts", "0 seconds")
