"""Upkeep of stored tables: tails only, and equal to a rebuild."""

import datetime as dt
import glob
import os

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ampflow.operators import features
from ampflow.plans import upkeep

from .test_library import DAY0


def meter(spark, days, device, seed=0):
    """Hours of a device, from a floor to a ceiling it meets every day, so that its quantiles stay."""
    rng = np.random.default_rng(seed + device)
    rows = []
    for i in range(24 * days):
        kwh = (0.1, 0.1, 5.0, 5.0)[i % 24] if i % 24 < 4 else float(np.round(rng.uniform(0.5, 2.0), 3))
        rows.append((device, DAY0 + dt.timedelta(hours=i), kwh))
    return spark.createDataFrame(rows, "device_id long, ts timestamp, kwh double")


def table(spark, path):
    df = upkeep.stored(spark, path)
    return {} if df is None else {(r.device_id, r.day): r for r in df.collect()}


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def plain_totals(days, window_days):
    """Totals that hang on a day and on the ``window_days`` days before, without the planning of cuts."""
    use = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    w = Window.partitionBy("device_id").orderBy("day").rowsBetween(-window_days, -1)
    rows = days.withColumn("u", use).select("device_id", "day", "u", F.count("u").over(w).alias("n"), F.avg("u").over(w).alias("p"))
    return rows.where(F.col("n") == window_days).select("device_id", "day", F.col("u").alias("seg0"), F.col("p").alias("seg1"), F.lit(1.0).alias("seg2"), F.lit(2.0).alias("seg3"))


def plain_features(daily, history):
    groups = features.lag_columns((1, 3)) | features.profile_columns(history) | features.target_columns()
    return features.clean(daily.select("*", *[c.alias(n) for n, c in groups.items()]))


def test_upkeep_rewrites_tails_and_equals_a_rebuild(spark, tmp_path, monkeypatch):
    """Cuts and features are plain ones with the same look-back and look-ahead; planning the real ones takes a minute a run."""
    monkeypatch.setattr(upkeep.segment, "adaptive_days", plain_totals)
    monkeypatch.setattr(upkeep.feats, "build", plain_features)
    kw = {"window_days": 2, "history_days": 5}
    root, fresh = str(tmp_path / "kept"), str(tmp_path / "fresh")
    two, one = meter(spark, 66, 2), meter(spark, 66, 1)
    first = two.union(one.where("ts < '2024-03-05'"))  # 64 days of device 1
    out = upkeep.upkeep(first, root, **kw)
    assert out["devices"] == 2 and out["daily"] == 64 + 62 and out["features"] > 0
    before = {n: files(f"{root}/{n}") for n in ("days", "daily", "features")}
    old = {n: table(spark, f"{root}/{n}") for n in before}

    later = two.union(one.where("ts < '2024-03-06'"))  # a day more
    out = upkeep.upkeep(later, root, spark.range(1, 2).select(F.col("id").alias("device_id")), **kw)
    assert out["devices"] == 1 and out["daily"] == 1 and out["features"] == 1
    assert {m.isoformat() for months in out["months"].values() for m in months} == {"2024-03-01"}
    upkeep.upkeep(later, fresh, **kw)
    for n in before:
        after = files(f"{root}/{n}")
        assert {f: t for f, t in before[n].items() if "2024-03" not in f} == {f: t for f, t in after.items() if "2024-03" not in f}
        got, want = table(spark, f"{root}/{n}"), table(spark, f"{fresh}/{n}")
        assert got == want and all(got[k] == r for k, r in old[n].items())
    assert upkeep.upkeep(later, root, **kw)["devices"] == 0  # nothing changed


def test_tails_that_vanish(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame([(i, dt.date(2024, m, d), x) for i, m, d, x in r], "device_id long, day date, x int")
    edge = lambda *e: spark.createDataFrame([(i, dt.date(2024, m, d)) for i, m, d in e], "device_id long, first date")
    seen = lambda: sorted((r.device_id, r.day.month, r.day.day, r.x) for r in upkeep.stored(spark, path).collect())
    assert upkeep.stored(spark, path) is None and upkeep.put_tails(rows(), edge(), path) == []
    upkeep.put_tails(rows((1, 1, 1, 0), (1, 2, 1, 0), (2, 1, 5, 0)), edge((1, 1, 1), (2, 1, 1)), path)
    upkeep.put_tails(rows((1, 1, 9, 7)), edge((1, 1, 2)), path)
    assert seen() == [(1, 1, 1, 0), (1, 1, 9, 7), (2, 1, 5, 0)] and not glob.glob(f"{path}/*2024-02*")
    upkeep.put_tails(rows(), edge((1, 1, 1), (2, 1, 1)), path)
    assert upkeep.stored(spark, path) is None


def test_first_changes(spark):
    days = lambda *r: spark.createDataFrame([(i, dt.date(2024, 1, d), v) for i, d, v in r], upkeep.DAYS)
    now = days((1, 1, [1.0]), (1, 2, [None]), (1, 3, [2.0]), (2, 1, [1.0]), (3, 4, [1.0]))
    was = days((1, 1, [1.0]), (1, 2, [None]), (1, 3, [1.0]), (2, 1, [1.0]), (4, 5, [1.0]))
    assert {r.device_id: r["first"].day for r in upkeep.first_changes(now, was).collect()} == {1: 3, 3: 4, 4: 5}


def test_upkeep_with_the_real_cuts_and_features(spark, tmp_path):
    """A day or two more of one device: its tail only, equal to a rebuild.  Three runs of half a minute to a minute."""
    root, fresh = str(tmp_path / "kept"), str(tmp_path / "fresh")
    two, one = meter(spark, 75, 2), meter(spark, 75, 1)
    assert upkeep.upkeep(two.union(one.where("ts < '2024-03-14'")), root)["devices"] == 2
    old = {n: table(spark, f"{root}/{n}") for n in ("days", "daily", "features")}
    out = upkeep.upkeep(two.union(one), root, spark.range(1, 2).select(F.col("id").alias("device_id")))
    assert (out["devices"], out["daily"], out["features"]) == (1, 2, 2)
    assert {m.isoformat() for months in out["months"].values() for m in months} == {"2024-03-01"}
    upkeep.upkeep(two.union(one), fresh)
    for n, rows in old.items():
        got = table(spark, f"{root}/{n}")
        assert got and got == table(spark, f"{fresh}/{n}") and all(got[k] == r for k, r in rows.items())
