"""Result tables by partition and swap, jobs that isolate a device's failure, refresh before learning."""

import datetime as dt
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from ampflow.operators import cluster, features, models
from ampflow.plans import cycle, jobs
from ampflow.schema import SEG, SchemaError
from ampflow.sources import sinks
from ampflow.sources.sinks import settled

from .test_library import DAY0, daily, hours


def week(spark, rows):
    return spark.createDataFrame([(i, dt.date(2024, 6, d), dt.date(2024, 6, d + 6), kwh, "v", DAY0) for i, d, kwh in rows], "device_id long, week_start date, week_end date, predicted_consumption_kwh double, model_version string, generated_at timestamp")


def files(spark, table):
    at = spark.sql(f"describe formatted {table}").where("col_name = 'Location'").first().data_type.removeprefix("file:")
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{at}/**/*.parquet", recursive=True)}


def test_an_upsert_rewrites_the_partitions_of_its_dates_only(spark):
    spark.sql("create database if not exists res1")
    sinks.write_results(week(spark, [(1, 1, 1.0), (2, 1, 2.0), (1, 8, 3.0)]), "weekly_predictions", "res1")
    before = files(spark, "res1.weekly_predictions")
    sinks.write_results(week(spark, [(2, 8, 9.0), (1, 8, 4.0)]), "weekly_predictions", "res1")
    after = files(spark, "res1.weekly_predictions")
    assert {f for f in before if "2024-06-01" in f} == {f for f in after if "2024-06-01" in f and after[f] == before.get(f)}
    got = {(r.device_id, r.week_start.day): r.predicted_consumption_kwh for r in spark.table("res1.weekly_predictions").collect()}
    assert got == {(1, 1): 1.0, (2, 1): 2.0, (1, 8): 4.0, (2, 8): 9.0}
    plan = spark.table("res1.weekly_predictions").where(F.col("week_start").isin([dt.date(2024, 6, 8)]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    sinks.write_results(week(spark, []), "weekly_predictions", "res1")
    assert spark.table("res1.weekly_predictions").count() == 4


def test_a_failed_or_short_write_leaves_the_old_rows(spark):
    spark.sql("create database if not exists res2")
    rows = week(spark, [(1, 1, 1.0)])
    night = rows.select("device_id", *[F.lit("x").alias(f"prediction_{d}") for d in ("today", "tomorrow", "day_after_tomorrow")], "model_version", "generated_at")
    sinks.write_results(rows, "weekly_predictions", "res2")
    sinks.write_results(night, "nightly_predictions", "res2", replace=True, expected=1)
    broken = F.raise_error(F.lit("broken")).cast("string")
    for table, new in (("weekly_predictions", rows), ("nightly_predictions", night)):
        for replace in (False, True):
            with pytest.raises(Exception, match="broken"):
                sinks.write_results(new.withColumn("model_version", broken), table, "res2", replace)
            assert spark.table(f"res2.{table}").first().model_version == "v"
    with pytest.raises(SchemaError, match="1 rows of nightly"):
        sinks.write_results(night, "nightly_predictions", "res2", replace=True, expected=2)
    sinks.write_results(night.withColumn("device_id", F.lit(2).cast("long")), "nightly_predictions", "res2")
    assert spark.table("res2.nightly_predictions").count() == 2
    spark.sql("alter table res2.nightly_predictions rename to res2.nightly_predictions_before")  # a swap that broke off
    sinks.create_tables(spark, "res2")
    assert spark.table("res2.nightly_predictions").count() == 2


def test_nightly_gives_every_device_a_row(spark):
    """One device has too few days, one no clean day; the other has its forecast."""
    spark.sql("create database if not exists res3")
    long = hours(spark, [1.0 + (h % 24) / 10 + (h // 24 % 7) / 5 for h in range(24 * 16)])
    raw = long.union(hours(spark, [1.0] * 48, 2)).union(hours(spark, [1.0] * 5, 3)).union(long.limit(3).withColumn("device_id", F.lit(None).cast("long")))
    table = settled(features.build(daily(spark, 2, 60)), "features")
    model = models.SegmentModel("ridge").fit(table.select("device_id", "day", *[c for c in table.columns if "30" not in c and "past" not in c and "14" not in c and "21" not in c and c not in ("device_id", "day")]))
    counts = cycle.write_nightly(raw, model, "res3", window_days=3, history=4, enough=10, now=DAY0)
    assert counts == {"forecast": 1, "too_few_days": 1, "no_clean_days": 1}
    got = {r.device_id: r for r in spark.table("res3.nightly_predictions").collect()}
    assert json.loads(got[1].prediction_today)["date"] == "2024-01-17" and got[2].prediction_today is None and set(got) == {1, 2, 3}


def test_weekly_and_monthly_writers(spark):
    spark.sql("create database if not exists res4")
    d = daily(spark, 3, 150).where("device_id <> 2 or day > '2024-05-27'")
    as_of = F.lit("2024-05-30").cast("date")
    for name, frame, write in (("week", features.weekly(d), cycle.write_weekly), ("month", features.monthly(d), cycle.write_monthly)):
        bundle, _ = jobs.train_period(frame, jobs.HorizonConfig(f"{name}ly", "ridge"), cluster.ClusterFit("disabled"))
        for _ in range(2):
            assert write(d, bundle.fallback, as_of, "res4", version="v3") == {"forecast": 2, f"too_few_{name}s": 1}
        rows = {r.device_id: r for r in spark.table(f"res4.{name}ly_predictions").collect()}
        assert len(rows) == 3 and rows[2].predicted_consumption_kwh is None and rows[0].predicted_consumption_kwh > 0 and rows[0].model_version == "v3"


def test_trainers_by_name(spark):
    d = daily(spark, 3, 150)
    none = cluster.ClusterFit("disabled")
    for name in ("weekly", "monthly"):
        made, scores = cycle.trainer(jobs.HorizonConfig(name, "linear" if name == "monthly" else "ridge"), d, none, solar=False)()
        assert made.fallback.label == "use" and set(scores) == {"mae", "rmse", "mape", "maape", "r2"}
    model, scores = cycle.trainer(jobs.HorizonConfig("3day"), d, none)()
    assert scores["r2"] > 0.5 and set(model.models) == set(features.TARGETS)


def test_a_failed_refresh_stops_the_learning(spark, tmp_path):
    trained = []
    trainers = {"3day": lambda: trained.append(1)}
    stores = {"3day": sinks.ModelStore(spark, str(tmp_path), "3day")}
    out = cycle.learn(trainers, stores, report=str(tmp_path / "r"), refresh=lambda: 1 / 0)
    assert out["3day"]["status"] is jobs.Status.FAILED and out["3day"]["reason"].startswith("refresh") and not trained
    assert json.loads(sinks.read_text(spark, str(tmp_path / "r")))["3day"]["status"] == "failed"
