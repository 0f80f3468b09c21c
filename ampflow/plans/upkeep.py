"""Incremental upkeep of the stored days, daily totals and features: a device's tail from its first changed day.

Three tables by month under a root: ``days`` (cleaned hours of a day as an array),
``daily`` and ``features``.  New readings are cleaned with the rest of their
device, since quantiles and gaps look at all of it; what comes out is held
against the stored days, and only from the first that differs are cuts planned
and features written anew.  The result equals a rebuild of everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ampflow.operators import clean, segment
from ampflow.operators import features as feats
from ampflow.schema import check_daily
from ampflow.sources.sinks import settled

MONTH = "part_month"
DAYS = "device_id long, day date, v array<double>"


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A table by month; None if there is none yet, or all its months have gone."""
    at, fs = _fs(spark, path)
    if not fs.exists(at) or not any(s.getPath().getName().startswith(MONTH) for s in fs.listStatus(at)):
        return None
    return spark.read.parquet(path)


def put_tails(rows: DataFrame, edges: DataFrame, path: str) -> list:
    """``rows`` in place of what the devices of ``edges`` (device_id, first) have from ``first`` on; gives the months rewritten.

    Only months with such rows are read and written, each staged and put in place by Spark's commit.
    """
    spark = rows.sparkSession
    rows = rows.withColumn(MONTH, F.trunc("day", "month"))
    old, touched = stored(spark, path), rows.select(MONTH)
    if old is not None:
        gone = old.join(edges, "device_id").where(F.col("day") >= F.col("first"))
        touched = touched.union(gone.select(MONTH))
    months = sorted(r[0] for r in touched.distinct().collect())  # calendar months, not data
    if not months:
        return []
    if old is not None:
        kept = old.where(F.col(MONTH).isin(months)).join(edges, "device_id", "left").where(F.col("first").isNull() | (F.col("day") < F.col("first"))).drop("first")
        rows = settled(kept.unionByName(rows), "tails")
    left = {r[0] for r in rows.select(MONTH).distinct().collect()}
    if left:
        rows.hint("rebalance", MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
    for month in set(months) - left:
        at, fs = _fs(spark, f"{path}/{MONTH}={month}")
        fs.delete(at, True)
    return months


def first_changes(now: DataFrame, was: DataFrame) -> DataFrame:
    """device_id, first: the first day that either of two tables of days has alone, or has with other hours."""
    both = now.alias("a").join(was.select("device_id", "day", F.col("v").alias("_v")), ["device_id", "day"], "full")
    return both.where(~F.col("v").eqNullSafe(F.col("_v"))).groupBy("device_id").agg(F.min("day").alias("first"))


def upkeep(readings: DataFrame, root: str, changed: DataFrame | None = None, window_days: int = segment.WINDOW_DAYS, history_days: int = feats.HISTORY) -> dict:
    """Brings the tables under ``root`` up to ``readings``; gives how many devices changed, rows were computed, and which months were rewritten.

    ``changed`` has the devices (device_id) with new, other or withdrawn readings; the rest are
    not read.  Without it all are held against what is stored.  ``days`` is written last: a run that
    broke off finds the same changes again.
    """
    spark = readings.sparkSession
    devices = None if changed is None else changed.select("device_id").distinct()
    mine = lambda df: df if devices is None else df.join(devices, "device_id", "left_semi")
    now = settled(segment.day_arrays(clean.preprocess(mine(readings)).select("device_id", "ts", "kwh")), "days-now")
    was = stored(spark, f"{root}/days")
    was = spark.createDataFrame([], DAYS) if was is None else mine(was.drop(MONTH))
    edges = settled(first_changes(now, was), "edges")
    out = {"devices": edges.count(), "daily": 0, "features": 0, "months": {}}
    if not out["devices"]:
        return out

    # The days from a device's first change on, and as many before as a window has.
    rows = now.join(edges, "device_id").withColumn("_new", F.col("day") >= F.col("first"))
    back = F.row_number().over(Window.partitionBy("device_id", "_new").orderBy(F.desc("day")))
    near = rows.withColumn("_r", back).where(F.col("_new") | (F.col("_r") <= window_days)).select("device_id", "day", "v")
    daily = check_daily(settled(segment.adaptive_days(near, window_days), "daily-tail"))

    # Features of the last row before the change look a day ahead.
    old = stored(spark, f"{root}/daily")
    before = daily.limit(0) if old is None else old.drop(MONTH).join(edges, "device_id").where(F.col("day") < F.col("first")).select(daily.columns)
    last = before.groupBy("device_id").agg(F.max("day").alias("_last"))
    ahead = edges.join(last, "device_id", "left").select("device_id", F.coalesce("_last", "first").alias("first"))
    ahead = settled(ahead, "edges-features")
    built = settled(feats.build(before.unionByName(daily), history=history_days), "features-built")  # stored first: a join over its many null checks takes minutes to plan
    features = settled(built.join(ahead, "device_id").where(F.col("day") >= F.col("first")).drop("first"), "features-tail")

    tail = now.join(edges, "device_id").where(F.col("day") >= F.col("first")).drop("first")
    months = {"features": put_tails(features, ahead, f"{root}/features"), "daily": put_tails(daily, edges, f"{root}/daily"), "days": put_tails(tail, edges, f"{root}/days")}
    return out | {"daily": daily.count(), "features": features.count(), "months": months}
