"""Cleaning of hourly readings: device_id, ts, kwh in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ampflow.functions.calendar import is_weekend
from ampflow.functions.numeric import steps_within
from ampflow.schema import require

MIN_DAY_HOURS = 20
#: Hours that interpolation fills from either side of a gap.
REACH = 6
HOUR_MICROS = 3_600_000_000
#: Readings a device needs for its outliers to be clipped.
CLIP_FROM = 50
#: Days of history below which a device is still learning, and from which it has a model of its own.
LEARNING_DAYS, GLOBAL_DAYS = 61, 30


def typed(readings: DataFrame) -> DataFrame:
    require(readings, ["device_id", "ts", "kwh"])
    return readings.select(F.col("device_id").cast("long").alias("device_id"), "ts", F.col("kwh").cast("double").alias("kwh"))


def deduplicated(readings: DataFrame) -> DataFrame:
    """Mean of the readings of a device and hour."""
    return readings.groupBy("device_id", "ts").agg(F.avg("kwh").alias("kwh"))


def non_negative(readings: DataFrame) -> DataFrame:
    return readings.where("kwh >= 0")


def whole_days(readings: DataFrame, min_hours: int = MIN_DAY_HOURS) -> DataFrame:
    """Readings of days that have ``min_hours`` rows or more.

    The count is a window over the rows themselves: one shuffle, where a
    semi-join with an aggregate would need that of the rows as well.
    """
    day = Window.partitionBy("device_id", F.to_date("ts"))
    return readings.withColumn("_n", F.count("*").over(day)).where(F.col("_n") >= min_hours).drop("_n")


def filled(readings: DataFrame, reach: int = REACH) -> DataFrame:
    """Hours between readings by linear interpolation; days that still lack one go.

    A device's hours step from its first reading to its last; readings off that
    grid go.  An hour is filled if a reading lies ``reach`` hours or less before
    it, or that many after it (and one on the other side).  Every day but a
    device's first and last must come out with all its hours.

    Gaps stay intervals: a reading is multiplied by the hours to fill after it,
    2 ``reach`` at most, so a stray date costs one row however far it lies.
    Frames only grow, from either end: what a device or a day has in all is
    known from its last row on, and a second order begins there.
    """
    kind = readings.schema["ts"].dataType.typeName()
    by, back = (Window.partitionBy("device_id").orderBy(o) for o in ("ts", F.desc("ts")))
    rows = readings.withColumn("_t", _micros(F.col("ts"), kind)).withColumn("_b", F.max("_t").over(back)).withColumn("_a", F.min("_t").over(by))
    rows = rows.where(F.col("kwh").isNotNull() & ((F.col("_t") - F.col("_a")) % HOUR_MICROS == 0))
    rows = rows.withColumn("_g", ((F.lead("_t").over(by) - F.col("_t")) / HOUR_MICROS).cast("int")).withColumn("_next", F.lead("kwh").over(by))
    rows = rows.select("*", F.explode(steps_within(F.col("_g"), reach, reach)).alias("_j"))
    line = F.col("kwh") + (F.col("_next") - F.col("kwh")) * F.col("_j") / F.when(F.col("_g") > 0, F.col("_g"))
    out = rows.withColumn("kwh", F.when(F.col("_j") == 0, F.col("kwh")).otherwise(line)).withColumn("ts", F.col("ts") + F.make_dt_interval(F.lit(0), F.col("_j")))
    day = F.to_date("ts")
    step = lambda at: F.ceil((at - F.col("_a")) / HOUR_MICROS)  # noqa: E731  the first hour of the grid at or after ``at``
    midnight = lambda d: _micros(d.cast(kind), kind)
    wanted = F.least(step(midnight(F.date_add(day, 1))), step(F.col("_b") + 1)) - F.greatest(step(midnight(day)), F.lit(0))
    upto, after = (Window.partitionBy("device_id", day).orderBy(o) for o in ("ts", F.desc("ts")))
    out = out.withColumn("_have", F.count_if((F.col("_j") > 0) | (F.coalesce("_g", F.lit(1)) > 0)).over(upto))  # of a repeated hour one counts
    return out.withColumn("_whole", F.max("_have").over(after) >= wanted).where("_whole").select("device_id", "ts", "kwh")


def _micros(ts: Column, kind: str) -> Column:
    """Microseconds on the clock that ``ts`` is of; those without a zone by their own calendar."""
    if kind == "timestamp":
        return F.unix_micros(ts)
    seconds = F.unix_date(F.to_date(ts)) * F.lit(86400).cast("long") + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def clipped(readings: DataFrame, low: float = 0.01, high: float = 0.99, least: int = CLIP_FROM) -> DataFrame:
    """Readings held between two exact quantiles of their device; devices with fewer than ``least`` as they are."""
    bounds = readings.groupBy("device_id").agg(F.count("kwh").alias("_n"), F.percentile("kwh", F.array(F.lit(low), F.lit(high))).alias("_q"))
    kwh = F.when(F.col("_n") >= least, F.greatest(F.least("kwh", F.col("_q")[1]), F.col("_q")[0])).otherwise(F.col("kwh"))
    return readings.join(bounds, "device_id").select("device_id", "ts", kwh.alias("kwh"))


def with_time(readings: DataFrame) -> DataFrame:
    """day, hour, day_of_week (Monday 0), month, is_weekend."""
    ts = F.col("ts")
    return readings.withColumns({"day": F.to_date(ts), "hour": F.hour(ts), "day_of_week": F.weekday(ts), "month": F.month(ts), "is_weekend": is_weekend(ts)})


def preprocess(readings: DataFrame, min_hours: int = MIN_DAY_HOURS, reach: int = REACH) -> DataFrame:
    """The whole chain: types, duplicates, negatives, bad days, gaps, outliers, time columns."""
    out = readings.transform(typed).transform(deduplicated).transform(non_negative)
    return out.transform(whole_days, min_hours).transform(filled, reach).transform(clipped).transform(with_time)


def last_days(readings: DataFrame, days: int) -> DataFrame:
    """Readings of each device's last ``days`` distinct days; devices with fewer have none."""
    by = Window.partitionBy("device_id").orderBy(F.desc(F.to_date("ts")))
    whole = Window.partitionBy("device_id")
    ranked = readings.withColumn("_r", F.dense_rank().over(by)).withColumn("_d", F.max("_r").over(whole))
    return ranked.where((F.col("_r") <= days) & (F.col("_d") >= days)).drop("_r", "_d")


def status_of(days: Column) -> Column:
    """learning, global or personal, by days of history; the first test leaves nothing for the second."""
    return F.when(days < LEARNING_DAYS, "learning").when(days < GLOBAL_DAYS, "global").otherwise("personal")


def device_status(readings: DataFrame) -> DataFrame:
    """device_id, days, status, can_predict."""
    days = readings.groupBy("device_id").agg(F.count_distinct(F.to_date("ts")).alias("days"))
    return days.withColumn("status", status_of(F.col("days"))).withColumn("can_predict", F.col("days") >= LEARNING_DAYS)


def missing_days(have: DataFrame, first: Column, last: Column) -> DataFrame:
    """Days of [first, last] that ``have`` (device_id, day) lacks, device by device."""
    devices = have.select("device_id").distinct()
    calendar = devices.select("device_id", F.explode(F.sequence(first, last)).alias("day"))
    return calendar.join(have.select("device_id", "day").distinct(), ["device_id", "day"], "left_anti")
