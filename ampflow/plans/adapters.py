"""The registered queries' inputs: meter-like frames made of the given tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampflow.schema import SEG, SEGMENTS

DIGITS = 6
#: Added before rounding, so that sums in another order do not tip what lies halfway.
NUDGE = 1e-8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str, devices: int | None = 4) -> DataFrame:
    """Hourly use of ``devices`` devices (each user one, if None)."""
    device = F.col("user_id") % devices if devices else F.col("user_id")
    events = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    return events.groupBy(device.alias("device_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.sum("value").alias("kwh"))


def meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw meter rows: stamps at the hour's end, watts."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 4).alias("device_id"), (F.col("value") * 1000).alias("power_W"), (F.date_trunc("hour", "ts").cast("timestamp_ntz") + F.expr("interval 1 hour")).alias("created_at"))


def daily(spark: SparkSession, sf_dir: str, device: str = "l_suppkey") -> DataFrame:
    """Segment totals of devices by day, with segment times."""
    rows = table(spark, sf_dir, "lineitem").select(F.col(device).cast("long").alias("device_id"), F.to_date("l_shipdate").alias("day"), "l_orderkey", "l_quantity")
    sums = rows.groupBy("device_id", "day").agg(*[F.sum(F.when(F.col("l_orderkey") % 4 == k, F.col("l_quantity")).otherwise(0.0)).alias(SEG[k]) for k in SEGMENTS])
    x = F.unix_date("day") % 2
    starts, hours = [F.lit(0), 5 + x, 11 + x, F.lit(18)], [5 + x, F.lit(6), 7 - x, F.lit(6)]
    return sums.withColumns({f"{s}_start": starts[k].cast("int") for k, s in enumerate(SEG)} | {f"{s}_hours": hours[k].cast("int") for k, s in enumerate(SEG)})


def half_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Household rows as text: one of two tariffs, padded numbers, some that are none."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id")
    slot = F.date_trunc("hour", "ts").cast("timestamp_ntz") + F.when(F.minute("ts") >= 30, F.expr("interval 30 minutes")).otherwise(F.expr("interval 0 minutes"))
    sums = e.groupBy((user % 6).alias("u"), slot.alias("slot")).agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    text = F.when(F.col("n") == 1, "Null").otherwise(F.concat(F.lit("  "), F.col("v").cast("decimal(12,2)").cast("string")))
    return sums.select(F.concat(F.lit("MAC00000"), F.col("u").cast("string")).alias("household"), F.when(F.col("u") == 5, "ToU").otherwise("Std").alias("tariff"), F.date_format("slot", "yyyy-MM-dd HH:mm:ss").alias("stamp"), text.alias("kwh"))


def raw_half_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Household rows as text, one an event: stamps that repeat, some that are none, numbers that are none or negative, some minutes off the grid."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    slot = F.date_trunc("hour", "ts").cast("timestamp_ntz") + F.when(F.minute("ts") >= 30, F.expr("interval 30 minutes")).otherwise(F.expr("interval 0 minutes"))
    slot = slot + F.when(i % 61 == 0, F.expr("interval 7 minutes")).otherwise(F.expr("interval 0 minutes"))
    stamp = F.when(i % 97 == 0, "no stamp").otherwise(F.concat(F.date_format(slot, "yyyy-MM-dd HH:mm:ss"), F.lit(".0000000")))
    value = F.when(i % 89 == 0, "Null").when(i % 83 == 0, "-1.5").otherwise(F.concat(F.lit("  "), F.col("value").cast("decimal(12,2)").cast("string")))
    return e.select(F.concat(F.lit("MAC00000"), (F.col("user_id") % 6).cast("string")).alias("household"), F.lit("Std").alias("tariff"), stamp.alias("stamp"), value.alias("kwh"), i.alias("order"))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and two forecasts of it, by device."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_suppkey").alias("device_id"), (F.col("l_linenumber") % 4).alias("route"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("p"), (F.col("l_quantity") * 1400).alias("p2"))


def plain(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """A result to compare: doubles rounded, integers as longs, dates and times as text."""
    out = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("double", "float"):
            c = F.round(c.cast("double") + NUDGE, digits) + F.lit(0.0)
        elif kind in ("integer", "short", "byte"):
            c = c.cast("long")
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def sql(body: str, doubles: str = "", ints: str = "", texts: str = "", digits: int = DIGITS) -> str:
    """The same for SQL: ``body``'s columns named in the lists are rounded or cast."""
    fix = [f"ROUND(CAST({c} AS DOUBLE) + {NUDGE}, {digits}) + 0.0 AS {c}" for c in doubles.split()]
    fix += [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()] + [f"CAST({c} AS VARCHAR) AS {c}" for c in texts.split()]
    return f"SELECT * REPLACE ({', '.join(fix)}) FROM ({body})" if fix else body


def r_sql(devices: int | None = 4) -> str:
    device = f"user_id % {devices}" if devices else "user_id"
    return f"SELECT {device} AS device_id, date_trunc('hour', ts) AS ts, sum(value) AS kwh FROM events GROUP BY 1, 2"


def d_sql(device: str = "l_suppkey") -> str:
    sums = ", ".join(f"sum(CASE WHEN l_orderkey % 4 = {k} THEN l_quantity ELSE 0.0 END) AS seg{k}" for k in SEGMENTS)
    x = "(date_diff('day', DATE '1970-01-01', day) % 2)"
    return f"SELECT *, 0 AS seg0_start, 5 + {x} AS seg1_start, 11 + {x} AS seg2_start, 18 AS seg3_start, 5 + {x} AS seg0_hours, 6 AS seg1_hours, 7 - {x} AS seg2_hours, 6 AS seg3_hours FROM (SELECT CAST({device} AS BIGINT) AS device_id, CAST(l_shipdate AS DATE) AS day, {sums} FROM lineitem GROUP BY 1, 2)"


H_SQL = """SELECT 'MAC00000' || u AS household, CASE WHEN u = 5 THEN 'ToU' ELSE 'Std' END AS tariff, strftime(slot, '%Y-%m-%d %H:%M:%S') AS stamp, slot,
  CASE WHEN n = 1 THEN NULL ELSE CAST(CAST(v AS DECIMAL(12,2)) AS DOUBLE) END AS kwh
FROM (SELECT user_id % 6 AS u, date_trunc('hour', ts) + CASE WHEN minute(ts) >= 30 THEN INTERVAL 30 MINUTE ELSE INTERVAL 0 MINUTE END AS slot, sum(value) AS v, count(*) AS n FROM events GROUP BY 1, 2)"""
RH_SQL = """SELECT 'MAC00000' || (user_id % 6) AS household, event_id AS place, try_strptime(left(CASE WHEN event_id % 97 = 0 THEN 'no stamp' ELSE strftime(date_trunc('hour', ts) + CASE WHEN minute(ts) >= 30 THEN INTERVAL 30 MINUTE ELSE INTERVAL 0 MINUTE END + CASE WHEN event_id % 61 = 0 THEN INTERVAL 7 MINUTE ELSE INTERVAL 0 MINUTE END, '%Y-%m-%d %H:%M:%S') END, 19), '%Y-%m-%d %H:%M:%S') AS stamp,
  TRY_CAST(CASE WHEN event_id % 89 = 0 THEN 'Null' WHEN event_id % 83 = 0 THEN '-1.5' ELSE CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) END AS DOUBLE) AS kwh FROM events"""
F_SQL = "SELECT l_suppkey AS device_id, l_linenumber % 4 AS route, l_extendedprice AS y, l_quantity * 1000 AS p, l_quantity * 1400 AS p2 FROM lineitem"
