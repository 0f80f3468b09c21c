"""Sources: meter tables, hourly and daily files, half-hourly household files.

Every reader gives a lazy DataFrame with an explicit schema, so filters and
column selections reach the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ampflow.schema import HALF_HOURS, METER, READINGS, SENSOR, SchemaError, require

#: An hour's row is stamped with the hour's end.
HOUR = "interval 1 hour"
# Headers that hourly files use for the three columns.
ALIASES = {
    "device_id": ["device_id", "deviceid", "device", "id", "lclid", "lc_lid", "household_id", "meter_id"],
    "ts": ["timestamp", "datetime", "date_time", "time", "ts", "hour", "reading_time", "end", "start"],
    "kwh": ["consumption_kwh", "consumption", "kwh", "kwh/hh", "kwh_hh", "kwh/h", "energy_kwh", "value", "usage", "load", "energy"],
}
# Parts of a header that name a column when no header is known.
PARTS = {"device_id": ["lcl", "device"], "ts": ["date", "time"], "kwh": ["kwh"]}
#: Hours that a day of a day matrix needs.
MATRIX_HOURS = 20


@dataclass(frozen=True)
class JdbcConfig:
    """Where a relational meter store is; ``numPartitions`` reads cut the id range."""

    url: str
    user: str = ""
    password: str = field(default="", repr=False)
    driver: str | None = None
    fetch_rows: int = 10_000

    @classmethod
    def from_env(cls, env: dict[str, str]) -> JdbcConfig:
        missing = [k for k in ("DB_HOST", "DB_NAME", "DB_USER") if not env.get(k)]
        if missing:
            raise SchemaError(f"not set: {', '.join(missing)}")
        return cls(f"jdbc:mysql://{env['DB_HOST']}:{env.get('DB_PORT', '3306')}/{env['DB_NAME']}", env["DB_USER"], env.get("DB_PASSWORD", ""))

    def options(self) -> dict[str, str]:
        out = {"url": self.url, "user": self.user, "password": self.password, "fetchsize": str(self.fetch_rows)}
        return out | ({"driver": self.driver} if self.driver else {})


def read_jdbc(spark: SparkSession, config: JdbcConfig, table: str, bounds: tuple[int, int] | None = None, partitions: int = 32) -> DataFrame:
    """A table by JDBC; with ``bounds`` of device_id, read in parallel."""
    reader = spark.read.format("jdbc").options(**config.options()).option("dbtable", table)
    if bounds:
        reader = reader.options(partitionColumn="device_id", lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def read_csv(spark: SparkSession, path: str, schema=READINGS) -> DataFrame:
    """Readings from CSV with a header; a file that is not there fails."""
    return spark.read.schema(schema).csv(path, header=True)


def read_meter(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METER).parquet(path)


def history(meter: DataFrame, device_id: int | None = None) -> DataFrame:
    """Readings of all devices, or of one: the stamp is moved to the hour's start, watts become kWh."""
    rows = meter.where("device_id is not null")
    if device_id is not None:
        rows = rows.where(F.col("device_id") == device_id)
    return rows.select(F.col("device_id").cast("long").alias("device_id"), start_of_hour("created_at").alias("ts"), (F.col("power_W") / 1000.0).alias("kwh"))


def start_of_hour(stamp: str | Column) -> Column:
    """The start of the hour that ends at ``stamp``."""
    return (F.col(stamp) if isinstance(stamp, str) else stamp) - F.expr(HOUR)


def day_rows(meter: DataFrame, device_id: int, day: date) -> DataFrame:
    """A device's rows of one day: a range on the raw stamp, so the scan can skip."""
    lo = F.lit(day).cast("timestamp") + F.expr(HOUR)
    rows = meter.where((F.col("device_id") == device_id) & (F.col("created_at") >= lo) & (F.col("created_at") < lo + F.expr("interval 24 hours")))
    return rows.select("id", F.hour(start_of_hour("created_at")).alias("hour"), (F.col("power_W") / 1000.0).alias("kwh"))


def recent(readings: DataFrame, end_day: Column, window_days: int = 30) -> DataFrame:
    """The readings of the calendar window that ends with ``end_day``."""
    return readings.where((F.col("ts") >= F.date_sub(end_day, window_days - 1)) & (F.col("ts") < F.date_add(end_day, 1)))


def canonical(df: DataFrame) -> DataFrame:
    """A frame with any known headers as device_id, ts, kwh: exact matches first, then parts of a name."""
    plain = {c: re.sub(r"[ -]", "_", c.replace("\ufeff", "").strip().lower()) for c in df.columns}
    chosen: dict[str, str] = {}
    for name, aliases in ALIASES.items():
        exact = [c for a in aliases for c in df.columns if plain[c] == a]
        part = [c for c in df.columns if any(x in plain[c] for x in PARTS[name]) or name == "device_id" and plain[c] in ("id", "hid")]
        if not exact and not part:
            raise SchemaError(f"no column for {name} among {df.columns}")
        chosen[name] = (exact or part)[0]
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in chosen.items()])


def separator(spark: SparkSession, path: str) -> str:
    """The delimiter of a text table, by its first line."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return max(",;\t", key=line.count)


def read_hourly(spark: SparkSession, path: str, max_devices: int | None = None, sample: int | None = None, seed: int = 42) -> DataFrame:
    """device_id, ts, kwh of a text table of hourly or half-hourly readings in any known form.

    Ids that are no whole numbers become dense codes, bad rows go, and of rows
    that repeat a device's stamp the last stays.  ``max_devices`` and ``sample`` as in ``some_devices``.
    """
    raw = canonical(spark.read.csv(path, header=True, sep=separator(spark, path)))
    rows = raw.select(F.trim("device_id").alias("name"), F.try_to_timestamp(F.trim("ts")).alias("ts"), F.expr("try_cast(trim(kwh) as double)").alias("kwh"), F.monotonically_increasing_id().alias("_at")).where("ts is not null and name <> ''")
    if rows.where(~F.col("name").rlike(r"^[+-]?\d{1,18}$")).isEmpty():
        rows = rows.withColumn("device_id", F.col("name").cast("long"))
    else:
        rows = dense_ids(rows, "name", "device_id")
    good = rows.where("kwh >= 0").groupBy("device_id", "ts").agg(F.max_by("kwh", "_at").alias("kwh"))
    return some_devices(good, max_devices, sample, seed)


def some_devices(rows: DataFrame, max_devices: int | None = None, sample: int | None = None, seed: int = 42) -> DataFrame:
    """``rows`` of the first ``max_devices`` devices by id, then of devices in the order of a seeded hash until they hold ``sample`` rows."""
    from ampflow.functions.ranks import numbered

    if max_devices is None and sample is None:
        return rows
    counts = rows.groupBy("device_id").agg(F.count("*").alias("n"))
    if max_devices is not None:
        counts = numbered(counts, "device_id").where(F.col("number") <= max_devices).drop("number")
    if sample is not None:
        ranked = numbered(counts.withColumn("_h", F.xxhash64("device_id", F.lit(seed))), "_h", "device_id")
        before = F.coalesce(F.sum("n").over(Window.partitionBy("_block").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = ranked.withColumn("_block", F.floor(F.col("number") / 100_000))
        blocks = ranked.groupBy("_block").agg(F.sum("n").alias("n")).orderBy("_block").collect()  # a row a hundred thousand devices
        starts, held = [], 0
        for r in blocks:
            starts.append((r["_block"], held))
            held += r.n
        offset = F.broadcast(rows.sparkSession.createDataFrame(starts, "_block long, _held long"))
        counts = ranked.withColumn("_before", before).join(offset, "_block").where(F.col("_before") + F.col("_held") < sample)
    return rows.join(counts.select("device_id"), "device_id", "left_semi")


def day_matrices(readings: DataFrame, least: int = MATRIX_HOURS) -> DataFrame:
    """device_id, day, v: the sum of each hour of days with ``least`` hours or more; hours without readings are 0."""
    hours = readings.groupBy("device_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.sum("kwh").alias("kwh"))
    days = hours.groupBy("device_id", "day").agg(F.count("kwh").alias("_n"), *[F.coalesce(F.max(F.when(F.col("hour") == h, F.col("kwh"))), F.lit(0.0)).alias(f"h{h}") for h in range(24)])
    return days.where(F.col("_n") >= least).select("device_id", "day", F.array(*[f"h{h}" for h in range(24)]).alias("v"))


def dense_ids(df: DataFrame, name: str, as_: str) -> DataFrame:
    """Codes 1, 2, ... of the sorted distinct names, numbered range by range."""
    from ampflow.functions.ranks import numbered

    names = numbered(df.select(name).distinct(), name, name=as_)
    return df.join(names.withColumn(as_, F.col(as_).cast("long")), name)


def household_ids(df: DataFrame, name: str = "household") -> DataFrame:
    """device_id from names such as ``ABC000123``; dense codes if any name is of another form."""
    number = F.regexp_extract(name, r"^[A-Za-z]+0*(\d+)$", 1)
    plain = df.select(name).distinct().agg(F.bool_and(number != ""), F.count("*") == F.count_distinct(number)).first()
    if plain[0] and plain[1]:
        return df.withColumn("device_id", number.cast("long"))
    return dense_ids(df, name, "device_id")


def read_half_hours(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Half-hourly household files as text; a header line, if there is one, is dropped."""
    rows = spark.read.schema(HALF_HOURS).csv(paths)
    return rows.where(~F.lower(F.ltrim(F.regexp_replace("household", "﻿", ""))).isin("lclid", "household"))


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """Daily segment totals from Parquet."""
    return require(spark.read.parquet(path), ["device_id", "day", "seg0", "seg1", "seg2", "seg3"])


def sensor_messages(text: DataFrame, value: str = "value") -> DataFrame:
    """Sensor messages from JSON text; broken ones have null fields."""
    return text.select(F.from_json(value, SENSOR).alias("m")).select("m.*")
