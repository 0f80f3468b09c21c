"""Gaps as intervals: equal to spines where those are short, and a row or two where a spine would be a century long."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ampflow.functions.numeric import steps_within
from ampflow.operators import clean, features, profiles

from .test_library import DAY0, daily, hours


def by_hand(readings, reach):
    """{(device, ts): kwh} of an hourly spine, filled and without incomplete days."""
    out = {}
    for device in {d for d, _, _ in readings}:
        known = {t: v for d, t, v in readings if d == device}
        spine, t = [], min(known)
        while t <= max(known):
            spine.append(t)
            t += dt.timedelta(hours=1)
        at = [i for i, t in enumerate(spine) if known.get(t) is not None]
        values, broken = {}, set()
        for i, t in enumerate(spine):
            before, after = [j for j in at if j <= i], [j for j in at if j >= i]
            if known.get(t) is not None:
                values[t] = known[t]
            elif before and after and (i - before[-1] <= reach or after[0] - i <= reach):
                a, b = before[-1], after[0]
                values[t] = known[spine[a]] + (known[spine[b]] - known[spine[a]]) * (i - a) / (b - a)
            else:
                broken.add(t.date())
        out |= {(device, t): v for t, v in values.items() if t.date() not in broken}
    return out


@pytest.mark.parametrize("reach", [0, 2, 6])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_filled_is_a_filled_spine(spark, reach, kind):
    import numpy as np

    rng = np.random.default_rng(reach)
    rows = []
    for device in range(8):
        start, i = DAY0 + dt.timedelta(hours=int(rng.integers(0, 24)), minutes=int(rng.integers(0, 60))), 0
        for _ in range(60):
            rows.append((device, start + dt.timedelta(hours=i), float(rng.random()) if rng.random() > 0.05 else None))
            i += int(rng.choice([1, 1, 1, 1, 1, 1, 1, 2, 5, 9, 13, 14, 40]))
    frame = spark.createDataFrame(rows, f"device_id long, ts {kind}, kwh double")
    got = {(r.device_id, r.ts): r.kwh for r in clean.filled(frame, reach).collect()}
    assert got == pytest.approx(by_hand(rows, reach))


def test_filled_over_a_clock_change(spark):
    """The day that loses an hour is whole with 23."""
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        rows = spark.range(24 * 4).select(F.lit(1).cast("long").alias("device_id"), F.timestamp_seconds(F.lit(1711666800) + F.col("id") * 3600).alias("ts"), F.lit(1.0).alias("kwh"))
        some = rows.where("hour(ts) not in (5, 6)")
        n = {str(r.day): r.n for r in clean.filled(some).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).collect()}
        assert n["2024-03-30"] == 24 and n["2024-03-31"] == 23 and n["2024-04-01"] == 24
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_stray_reading_costs_a_row(spark):
    plain = hours(spark, [1.0] * 72)
    stray = spark.createDataFrame([(1, dt.datetime(1924, 3, 1, 12), 9.0), (1, dt.datetime(2124, 3, 1, 12), 9.0)], plain.schema)
    out = clean.filled(plain.union(stray))
    days = {r.day: r.n for r in out.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).collect()}
    assert days == {dt.date(2024, 1, 1): 24, dt.date(2024, 1, 2): 24, dt.date(2024, 1, 3): 24}
    assert clean.preprocess(plain.union(stray)).count() == 72
    twice = clean.filled(plain.union(plain.limit(1)))
    assert twice.count() == 73  # a repeated hour is not a missing one
    assert clean.filled(plain.limit(0)).count() == 0 and clean.filled(plain.withColumn("kwh", F.lit(None).cast("double"))).count() == 0


def test_steps_within(spark):
    gaps = spark.createDataFrame([(None,), (0,), (1,), (2,), (5,), (12,)], "g int")
    for after, before in ((None, 0), (0, 0), (2, 1), (3, 3)):
        for r in gaps.select("g", steps_within(F.col("g"), after, before).alias("s")).collect():
            want = [j for j in range(max(r.g or 1, 1)) if j == 0 or after is None or j <= after or r.g - j <= before]
            assert r.s == want


def test_the_near_calendar_is_as_good_as_the_whole(spark, monkeypatch):
    d = daily(spark, 3, 150).where("device_id > 0 or day not between '2024-02-20' and '2024-04-10'").where("device_id > 1 or day <> '2024-05-05'")
    near = features.panel(d)
    frames = {"panel": near, "profile": profiles.behaviour(d)}
    got = {k: f.collect() for k, f in frames.items()}
    far = d.union(d.limit(1).withColumn("day", F.lit("1924-01-01").cast("date")).withColumn("device_id", F.lit(2).cast("long")))
    assert features.panel(far).count() <= near.count() + 1 + 28 + 3
    whole = features.dense
    monkeypatch.setattr(features, "dense", lambda rows, keys=("device_id",), reach=None: whole(rows, keys))
    monkeypatch.setattr(profiles, "dense", lambda rows, keys=("device_id",), reach=None: whole(rows, keys))
    full = {"panel": features.panel(d), "profile": profiles.behaviour(d)}
    for k, f in full.items():
        rows = {(r.device_id, r["day"] if "day" in f.columns else 0): r.asDict() for r in f.collect()}
        mine = {(r.device_id, r["day"] if "day" in f.columns else 0): r.asDict() for r in got[k]}
        assert all(mine[key] == pytest.approx(rows[key], nan_ok=True) for key in mine)
        assert all(v is None or v is False for key in rows.keys() - mine.keys() for c, v in rows[key].items() if c not in ("device_id", "day"))
    assert len(got["panel"]) < full["panel"].count()
