"""Daily actuals as a stream: equal to the batch job, once for each batch, over restarts."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ampflow.plans import jobs
from ampflow.sources.sinks import create_tables
from ampflow.streaming import daily, meter

from .test_library import DAY0

TIMES = "device_id actual_date actual_seg0 actual_seg1 actual_seg2 actual_seg3 peak_hour peak_value peak_segment".split()


def messages(path, first, last, skip=()):
    """Two messages an hour of two devices, days ``first`` .. ``last``; device 2 lacks the days in ``skip``."""
    lines = []
    for i in range(24 * first, 24 * (last + 1)):
        for device in (1, 2):
            if device == 2 and i // 24 in skip:
                continue
            for minute in (5, 35):
                watts = 500 + 400 * (i % 24 in (7, 8, 19, 20, 21)) + 13 * (i * device % 11) + minute
                lines.append(json.dumps({"device_id": device, "ts": str(DAY0 + dt.timedelta(hours=i, minutes=minute)), "power_W": float(watts)}))
    path.write_text("\n".join(lines))


def rows(spark, database):
    return {(r.device_id, r.actual_date): r for r in spark.table(f"{database}.daily_actuals").collect()}


def test_streamed_actuals(spark, tmp_path):
    source, at = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    spark.sql("create database if not exists live")
    create_tables(spark, "live")

    def run():
        meter.write_hours(meter.hourly_means(meter.sensor_stream(spark, str(source))), str(tmp_path / "hours"), at + "-hours").awaitTermination()
        daily.write_actuals(meter.hours_stream(spark, str(tmp_path / "hours")), at, "live", window_days=4).awaitTermination()

    messages(source / "a.json", 0, 3, skip=(2,))
    run()
    first = rows(spark, "live")
    assert {d.day for i, d in first if i == 1} == {1, 2, 3} and {d.day for i, d in first if i == 2} == {1, 2}  # the last day is open
    run()  # nothing new
    assert rows(spark, "live") == first
    messages(source / "b.json", 4, 6, skip=(5,))
    run()
    got = rows(spark, "live")
    assert all(got[k] == r for k, r in first.items())  # the later batch leaves them, stamps included
    all_hours = meter.hourly_means(spark.read.schema(meter.sensor_stream(spark, str(source)).schema).json(str(source)))
    want = {(r.device_id, r.day): r for r in jobs.daily_actuals(all_hours, window_days=4).where(F.col("day") < dt.date(2024, 1, 7)).collect()}
    assert set(want) == set(got) and len(want) == 10
    for k, r in want.items():
        for c in TIMES[2:]:
            assert got[k][c] == pytest.approx(r[c], rel=1e-9)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    spark.sql("create database if not exists again")
    create_tables(spark, "again")
    v = [float(1 + (h > 17)) for h in range(24)]
    batch = spark.createDataFrame([(1, dt.date(2024, 1, 2), v, [v, v])], daily.DAYS)
    put = daily.putter("again", str(tmp_path / "done"), window_days=2)
    put(batch, 0)
    before = rows(spark, "again")
    put(batch, 0)
    assert rows(spark, "again") == before and len(before) == 1
    short = spark.createDataFrame([(1, dt.date(2024, 1, 3), v[:10] + [None] * 14, [v])], daily.DAYS)
    put(short, 1)
    put(batch.limit(0), 2)
    assert rows(spark, "again") == before
    daily.putter("again", str(tmp_path / "lost"), window_days=2)(batch, 0)  # its mark was lost
    strip = lambda found: {k: [r[c] for c in TIMES] for k, r in found.items()}
    assert strip(rows(spark, "again")) == strip(before)
