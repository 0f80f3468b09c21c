"""Point reads and lookups over meter and result tables; filters reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ampflow.sources.readers import start_of_hour


def devices(rows: DataFrame) -> DataFrame:
    """The distinct device_id of any table."""
    return rows.select("device_id").distinct()


def first_last_day(meter: DataFrame) -> DataFrame:
    """device_id, first_day, last_day of meter rows, whose stamps are the hours' ends."""
    ends = meter.groupBy("device_id").agg(F.min("created_at").alias("a"), F.max("created_at").alias("b"))
    return ends.select("device_id", F.to_date(start_of_hour("a")).alias("first_day"), F.to_date(start_of_hour("b")).alias("last_day"))


def days_between(rows: DataFrame, first: Column | str, last: Column | str, day: str = "actual_date") -> DataFrame:
    """Distinct device_id and day of rows from ``first`` to ``last``."""
    return rows.where(F.to_date(day).between(first, last)).select("device_id", F.to_date(day).alias("day")).distinct()


def result(rows: DataFrame, device_id: int, start: Column | None = None, period: str = "week_start") -> DataFrame:
    """A device's row of a result table, of one period if ``start`` is given; none or one."""
    found = rows.where(F.col("device_id") == device_id)
    return (found if start is None else found.where(F.col(period) == start)).limit(1)


def latest(rows: DataFrame, *stamps: str) -> DataFrame:
    """The one latest row of a table, by ``stamps`` in turn."""
    return rows.orderBy(*[F.desc(s) for s in stamps]).limit(1)


def latest_per_device(rows: DataFrame, stamp: str) -> DataFrame:
    """Of each device all rows with its latest stamp, ties too."""
    last = F.rank().over(Window.partitionBy("device_id").orderBy(F.desc(stamp)))
    return rows.withColumn("_r", last).where("_r = 1").drop("_r")
