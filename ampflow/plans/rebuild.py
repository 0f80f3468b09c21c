"""Stored data sets: export, daily and feature tables, prepared households, reports.

Every writer checks what it is about to write or has written, and fails rather
than leave an empty or broken table behind.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampflow.operators import clean, ingest, segment
from ampflow.operators import features as feats
from ampflow.schema import SEG, SchemaError, check, check_daily, require
from ampflow.sources.readers import JdbcConfig, history, read_daily, read_half_hours, read_jdbc, some_devices
from ampflow.sources.sinks import newest, read_text, settled, write_text


def _written(df: DataFrame, path: str, what: str, **options) -> DataFrame:
    df.write.mode("overwrite").options(**options).parquet(path)
    out = df.sparkSession.read.parquet(path)
    if out.isEmpty():
        raise SchemaError(f"no rows of {what}")
    return out


def export_readings(meter: DataFrame, path: str, csv: bool = False) -> DataFrame:
    """All readings of a meter table, as Parquet or CSV; an empty table is an error."""
    rows = history(meter)
    if not csv:
        return _written(rows, path, "readings")
    if rows.isEmpty():
        raise SchemaError("no rows of readings")
    rows.write.mode("overwrite").csv(path, header=True)
    return rows.sparkSession.read.schema(rows.schema).csv(path, header=True)


def write_daily(readings: DataFrame, path: str, window_days: int = segment.WINDOW_DAYS) -> DataFrame:
    """The table of daily totals by adaptive cuts, of cleaned readings; checked as read back."""
    rows = segment.adaptive_daily(clean.preprocess(readings).select("device_id", "ts", "kwh"), window_days)
    return check_daily(_written(rows, path, "daily totals"))


def daily_from_jdbc(spark: SparkSession, config: JdbcConfig, table: str, path: str, bounds: tuple[int, int] | None = None, window_days: int = segment.WINDOW_DAYS) -> DataFrame:
    """The table of daily totals straight from a meter table in a database, read in parallel by device if ``bounds`` are given; read once, and stored."""
    readings = settled(history(read_jdbc(spark, config, table, bounds)), "jdbc-readings")
    return write_daily(readings, path, window_days)


def write_features(daily: DataFrame, path: str, history_days: int = feats.HISTORY) -> DataFrame:
    """The feature table of daily totals; no value in it is missing, and a device has one row a day."""
    out = _written(feats.build(daily, history=history_days), path, "features")
    inputs = feats.feature_columns(out.columns)
    missing = sum([F.col(c).isNull().cast("int") for c in [*inputs, *feats.TARGETS]], F.lit(0))
    check(out, missing=missing > 0, negative_target=F.least(*feats.TARGETS) < 0)
    if not out.groupBy("device_id", "day").count().where("count > 1").isEmpty():
        raise SchemaError("a device has two rows of one day")
    return out


def rebuild(meter: DataFrame, root: str, window_days: int = segment.WINDOW_DAYS, history_days: int = feats.HISTORY) -> dict[str, int]:
    """Export, daily and feature tables under ``root``, each from the one before; the first failure stops it.  Gives their row counts."""
    readings = export_readings(meter, f"{root}/readings")
    daily = write_daily(readings, f"{root}/daily", window_days)
    features = write_features(daily, f"{root}/features", history_days)
    return {"readings": readings.count(), "daily": daily.count(), "features": features.count()}


def load_daily(spark: SparkSession, path: str, max_devices: int | None = None, sample: int | None = None, seed: int = 42) -> DataFrame:
    """A daily table that passes all checks, of all devices or of some (``readers.some_devices``)."""
    return some_devices(check_daily(read_daily(spark, path)), max_devices, sample, seed)


def cluster_source(daily: DataFrame) -> DataFrame:
    """What clusters are fitted on: device, day, totals and times if there are any; rows that lack one go, of repeated days the last stays."""
    times = [c for s in SEG for c in (f"{s}_start", f"{s}_hours") if c in daily.columns]
    rows = require(daily, ["device_id", "day", *SEG]).select("device_id", F.to_date("day").alias("day"), *SEG, *times)
    return newest(rows.dropna().withColumn("_at", F.monotonically_increasing_id()), ["device_id", "day"], "_at").drop("_at")


def scanned(spark: SparkSession, paths: list[str], out_dir: str, rescan: bool = False) -> DataFrame:
    """``ingest.scan`` of household files, stored by the list of files and read back when it is asked for again."""
    key = hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]
    path = f"{out_dir}/scan-{key}"
    if rescan or read_text(spark, f"{path}-files") is None:
        ingest.scan(read_half_hours(spark, paths)).write.mode("overwrite").parquet(path)
        write_text(spark, f"{path}-files", "\n".join(sorted(paths)))
    return spark.read.parquet(path)


def write_prepared(hours: DataFrame, homes: DataFrame, counts: dict, out_dir: str) -> None:
    """Prepared households: hourly CSV with three decimals, the selected homes, and a summary."""
    spark = hours.sparkSession
    check(hours, negative=F.col("kwh") < 0, missing=F.col("kwh").isNull())
    if not hours.groupBy("device_id", "ts").count().where("count > 1").isEmpty():
        raise SchemaError("a device has two rows of one hour")
    rows = hours.select("device_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.format_string("%.3f", "kwh").alias("consumption_kwh"))
    rows.sortWithinPartitions("device_id", "timestamp").write.mode("overwrite").csv(f"{out_dir}/hourly", header=True)
    homes.write.mode("overwrite").csv(f"{out_dir}/households", header=True)
    facts = {"quality": counts, "output": ingest.sanity(hours, "device_id").first().asDict()}
    write_text(spark, f"{out_dir}/summary", json.dumps(facts, default=str))


def write_report(spark: SparkSession, path: str, report: dict) -> None:
    """A report of a job as JSON."""
    write_text(spark, path, json.dumps(report, default=str, sort_keys=True))


def write_table(results: DataFrame, path: str) -> None:
    """A table of results, a row a run: as Parquet, and as one CSV file to look at."""
    results.write.mode("overwrite").parquet(f"{path}/parquet")
    results.sparkSession.read.parquet(f"{path}/parquet").coalesce(1).write.mode("overwrite").csv(f"{path}/csv", header=True)
