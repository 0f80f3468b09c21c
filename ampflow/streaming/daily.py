"""Daily actuals as a stream: hours close days, days are cut by a device's state, each batch is put in once."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ampflow.operators import clean
from ampflow.plans import jobs
from ampflow.schema import HOURS
from ampflow.sources.sinks import read_text, settled, write_results, write_text

#: Open days with the instants they end at and their hours so far; the days of the window behind.
STATE = "open array<bigint>, ends array<bigint>, hours array<array<double>>, past array<bigint>, values array<array<double>>"
DAYS = "device_id long, day date, v array<double>, _w array<array<double>>"
EPOCH = dt.date(1970, 1, 1)


def _closer(window_days: int) -> Callable:
    def close(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = [list(x) for x in state.get] if state.exists else [[] for _ in range(5)]
        days = {d: (end, list(h)) for d, end, h in zip(*kept[:3])}
        past = dict(zip(*kept[3:]))
        for f in frames:
            for day, hour, kwh, end in zip(f["_day"].tolist(), f["_hour"].tolist(), f["kwh"].tolist(), f["_end"].tolist()):
                v = days.setdefault(day, (end, [None] * len(HOURS)))[1]
                v[hour] = kwh if v[hour] is None else (v[hour] + kwh) / 2  # the hour that a clock change repeats
        out = []
        for day in sorted(d for d, (end, _) in days.items() if end <= state.getCurrentWatermarkMs()):
            past[day] = days.pop(day)[1]
            past = {d: v for d, v in sorted(past.items()) if d > day - window_days}
            out.append((key[0], EPOCH + dt.timedelta(days=day), past[day], list(past.values())))
        state.update((list(days), [e for e, _ in days.values()], [h for _, h in days.values()], list(past), list(past.values())))
        if days:
            state.setTimeoutTimestamp(min(e for e, _ in days.values()))
        yield pd.DataFrame(out, columns=["device_id", "day", "v", "_w"])

    return close


def closed_days(hours: DataFrame, window_days: int = 30) -> DataFrame:
    """device_id, day, v, _w of each day that the watermark has passed: its hours, and the days of the calendar window that ends with it, oldest first.

    ``hours`` is a stream of device_id, ts, kwh with a watermark on ts (``meter.hours_stream``).
    Means of hours are taken before, on the JVM; Python sees 24 rows a device and day.
    State is the open days of a device and ``window_days`` arrays of 24.
    """
    day = F.to_date("ts")
    end = F.unix_millis(F.date_add(day, 1).cast("timestamp"))
    rows = hours.select("device_id", "ts", "kwh", F.unix_date(day).cast("long").alias("_day"), F.hour("ts").alias("_hour"), end.alias("_end"))
    return rows.groupBy("device_id").applyInPandasWithState(_closer(window_days), DAYS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def putter(database: str, done: str, window_days: int = 30, least: int = clean.MIN_DAY_HOURS) -> Callable[[DataFrame, int], None]:
    """What puts a batch of ``closed_days`` into ``daily_actuals``, once.

    ``done`` names the last batch put in.  A batch up to it is passed over, so a
    replay changes nothing; one that broke off between table and mark is put in
    again over the same keys.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark = read_text(spark, done)
        if mark and number <= int(mark):
            return
        days = settled(batch, "closed-days")
        if not days.isEmpty():
            rows = jobs.cut_days(days.where(jobs.enough_hours(least)), window_days)
            write_results(rows.withColumnRenamed("day", "actual_date").withColumn("computed_at", F.current_timestamp()), "daily_actuals", database)
        write_text(spark, done, str(number))

    return put


def write_actuals(hours: DataFrame, checkpoint: str, database: str = "default", window_days: int = 30, least: int = clean.MIN_DAY_HOURS):
    """Closed days of a stream of hours into ``daily_actuals``; runs over what is there, then stops."""
    put = putter(database, f"{checkpoint.rstrip('/')}-done", window_days, least)
    return closed_days(hours, window_days).writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
