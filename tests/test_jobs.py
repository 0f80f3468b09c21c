"""Stored data sets, loaders, lookups, saved clusters, learning and running cycles, ranks."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampflow.functions import ranks
from ampflow.operators import cluster, features, ingest, lookups, models, profiles, segment
from ampflow.plans import cycle, jobs, rebuild, registry
from ampflow.schema import SEG, SchemaError
from ampflow.sources import readers, sinks

from .test_library import DAY0, daily, hours


def meter(spark, days=14, devices=2):
    rows = [(i, d, 1000.0 * (1 + (h % 24) / 10 + d), DAY0 + dt.timedelta(hours=h + 1)) for d in range(devices) for i, h in enumerate(range(24 * days))]
    return spark.createDataFrame(rows, "id long, device_id long, power_W double, created_at timestamp")


def test_rebuild_writes_and_checks_all_tables(spark, tmp_path):
    counts = rebuild.rebuild(meter(spark, 38), str(tmp_path), window_days=3, history_days=4)
    assert counts == {"readings": 2 * 38 * 24, "daily": 2 * 35, "features": 2 * 4}
    kept = rebuild.load_daily(spark, f"{tmp_path}/daily", max_devices=1)
    assert {r.device_id for r in kept.select("device_id").distinct().collect()} == {0}
    with pytest.raises(SchemaError):
        rebuild.export_readings(meter(spark).where("id < 0"), f"{tmp_path}/none")
    assert rebuild.export_readings(meter(spark), f"{tmp_path}/csv", csv=True).count() == 2 * 14 * 24
    bad = daily(spark, 1, 40).withColumn("seg0", F.when(F.col("day") == "2024-01-20", -1.0).otherwise(F.col("seg0")))
    bad.write.parquet(f"{tmp_path}/bad")
    with pytest.raises(SchemaError):
        rebuild.load_daily(spark, f"{tmp_path}/bad")


def test_some_devices_fill_a_budget(spark):
    rows = spark.range(1000).selectExpr("id % 50 device_id", "id x")
    few = readers.some_devices(rows, sample=90, seed=3)
    assert few.select("device_id").distinct().count() == 5 and few.count() == 100
    assert sorted(r.device_id for r in readers.some_devices(rows, max_devices=3).select("device_id").distinct().collect()) == [0, 1, 2]
    assert readers.some_devices(rows).count() == 1000


def test_hourly_files_keep_the_last_and_make_matrices(spark, tmp_path):
    lines = ["LCLid;DateTime;KWH/hh (per half hour) "]
    for h in range(48):
        for m in (0, 30):
            lines.append(f"MAC{2 - h % 2:06d};2024-01-0{1 + h // 24} {h % 24:02d}:{m:02d}:00;{0.5 + m / 100}")
    lines += ["MAC000001;2024-01-01 01:00:00;9.0", "MAC000001;bad;1", "MAC000001;2024-01-01 01:30:00;-4"]
    (tmp_path / "h.csv").write_text("\n".join(lines))
    rows = readers.read_hourly(spark, str(tmp_path / "h.csv"))
    assert rows.where("device_id = 1 and kwh = 9.0").count() == 1 and rows.count() == 96
    assert readers.day_matrices(rows).count() == 0 and readers.day_matrices(rows, 12).count() == 4
    v = readers.day_matrices(rows, 12).where("device_id = 1 and day = '2024-01-01'").first().v
    assert v[1] == pytest.approx(9.8) and v[0] == 0.0 and v[3] == pytest.approx(1.3)


@pytest.mark.parametrize("header", ["Device,Reading-Time,load", "hid,When (date),kWh used", "﻿meter_id,start,Energy"])
def test_headers(spark, header):
    assert readers.canonical(spark.createDataFrame([("a", "b", "c")], header.split(","))).columns == ["device_id", "ts", "kwh"]
    with pytest.raises(SchemaError):
        readers.canonical(spark.createDataFrame([("a", "b")], ["x", "kwh"]))


def test_half_hours_of_any_order(spark):
    rows = [("A ", "Std", f"2024-01-01 00:{m}:00.0000000", v, i) for i, (m, v) in enumerate([("00", "1"), ("30", "2"), ("00", "7"), ("10", "3")])]
    rows += [("A", "Std", "2024-01-01 01:00:00", "1", 9), ("A", "Std", "2024-01-01 02:00:00", "2", 10), ("A", "Std", "2024-01-01 02:30:00", "2", 11), ("A", "Std", "2024-01-01 03:00:00", "Null", 12), ("A", "Std", "x", "1", 13), ("A", "Std", "2024-01-01 03:30:00", "-1", 14)]
    df = spark.createDataFrame(rows, "household string, tariff string, stamp string, kwh string, `order` long")
    first, end = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    assert [(r.household, r.ts.hour, r.kwh) for r in ingest.hourly(df, first, end).collect()] == [("A", 2, 4.0)]
    got = ingest.collect_counts(df, first, end).first().asDict()
    assert got == {"rows_selected_homes": 10, "rows_bad_timestamp": 1, "rows_in_window": 9, "rows_null_kwh": 1, "rows_negative_kwh": 1, "rows_off_grid_minute": 1, "rows_duplicate": 1, "hours_seen": 3, "hours_one_half_hour_only": 1, "hours_more_than_two_readings": 1}


def test_prepared_households(spark, tmp_path):
    rows = hours(spark, [0.12345] * 30, 4)
    homes = spark.createDataFrame([("MAC1", 4)], "household string, device_id long")
    rebuild.write_prepared(rows, homes, {"kept": 1}, str(tmp_path))
    line = spark.read.csv(f"{tmp_path}/hourly", header=True).orderBy("timestamp").first()
    assert line.asDict() == {"device_id": "4", "timestamp": "2024-01-01 00:00:00", "consumption_kwh": "0.123"}
    assert json.loads(sinks.read_text(spark, f"{tmp_path}/summary"))["output"]["rows"] == 30
    with pytest.raises(SchemaError):
        rebuild.write_prepared(rows.union(rows), homes, {}, str(tmp_path))


def test_scans_are_stored_by_their_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("LCLid,stdorToU,DateTime,KWH\nM1,Std,2024-01-01 00:00:00,1\n")
    paths = [str(tmp_path / "a.csv")]
    assert rebuild.scanned(spark, paths, str(tmp_path / "out")).count() == 1
    (tmp_path / "a.csv").write_text("LCLid,stdorToU,DateTime,KWH\nM1,Std,2024-01-01 00:00:00,1\nM2,Std,2024-01-01 00:00:00,1\n")
    assert rebuild.scanned(spark, paths, str(tmp_path / "out")).count() == 1
    assert rebuild.scanned(spark, paths, str(tmp_path / "out"), rescan=True).count() == 2


def test_lookups(spark):
    rows = spark.createDataFrame([(1, dt.date(2024, 1, d), d) for d in (1, 2, 5)] + [(2, dt.date(2024, 1, 5), 9), (2, dt.date(2024, 1, 5), 8)], "device_id long, week_start date, x int")
    assert lookups.result(rows, 1, F.lit(dt.date(2024, 1, 2))).first().x == 2 and lookups.result(rows, 7).count() == 0
    assert lookups.latest(rows, "week_start", "x").first().x == 9
    assert sorted(r.x for r in lookups.latest_per_device(rows, "week_start").collect()) == [5, 8, 9]
    assert lookups.days_between(rows, "2024-01-02", "2024-01-05", "week_start").count() == 3
    assert lookups.devices(rows).count() == 2


def test_quantiles_equal_numpy_and_positions_are_gapless(spark):
    rng = random.Random(1)
    values = [(float(rng.choice([0, 0, 0, rng.random()])), rng.random() if rng.random() < 0.9 else None) for _ in range(3000)]
    df = spark.createDataFrame(values, "a double, b double").repartition(6)
    got = ranks.quantiles(df, ["a", "b"], [0.0, 0.01, 0.5, 0.99, 1.0])
    for i, c in enumerate("ab"):
        assert got[c] == pytest.approx(np.quantile([v[i] for v in values if v[i] is not None], [0.0, 0.01, 0.5, 0.99, 1.0]))
    assert ranks.quantiles(df.where("a < -1"), ["a"], [0.5]) == {"a": [None]}
    names = spark.createDataFrame([(f"n{i:04d}",) for i in rng.sample(range(9000), 2000)], "name string")
    placed = sorted((r.name, r.number) for r in ranks.numbered(names, "name").collect())
    assert [n for _, n in placed] == list(range(1, 2001))


def test_robust_scale_of_a_constant_column(spark):
    rows = spark.createDataFrame([(i, 1.0 + (0.001 if i == 3 else 0.0), float(i)) for i in range(20)], "device_id long, a double, b double")
    scores = profiles.robust_scores(rows, ["a", "b"], worst=1)
    assert scores.where("device_id = 3").first().z < 2
    flags = profiles.outliers(scores, limit=1.0, most=0.1)
    assert flags.where("outlier").count() == 2


def test_clusters_and_bundles_are_saved(spark, tmp_path):
    d = daily(spark, 12, 60)
    settings = cluster.ClusterSettings(min_devices=3, k=5, k_max=3, tries=1)
    fit = cluster.fit(d, settings)
    assert fit.status == "ok" and fit.k_status in ("as_requested", f"adjusted_from_{settings.k}") and fit.k <= 5
    frame = features.horizon_frame(features.panel(d), 1)
    inputs = features.panel_inputs(frame)
    assert len(inputs) == 16 + 4 + 2 + 8 + 1 + 7 + 1
    bundle = cluster.train_bundle(frame, fit, lambda: models.estimator("ridge", inputs, "target_ratio", frame), inputs=inputs)
    bundle.save(str(tmp_path / "b"))
    again = cluster.Bundle.load(spark, str(tmp_path / "b"))
    key = lambda df: sorted((r.device_id, str(r.day), round(r.prediction, 9), r.route) for r in df.collect())
    assert key(again.predict(frame)) == key(bundle.predict(frame))
    with pytest.raises(ValueError, match="no rows"):
        cluster.train_bundle(frame.where("device_id < 0"), fit, lambda: None)
    source = rebuild.cluster_source(d.union(d.limit(1)).withColumn("extra", F.lit(1)))
    assert source.count() == 12 * 60 and "extra" not in source.columns


def test_guards(spark):
    frame = spark.createDataFrame([(1, 2.0, 3.0)], "device_id long, a double, b double")
    assert cycle.aligned(frame, ["b", "a", "c"], {"c": 5.0}).columns == ["device_id", "b", "a", "c"]
    with pytest.raises(SchemaError):
        cycle.aligned(frame, ["z"], {})
    with pytest.raises(SchemaError):
        cycle.check_inputs(frame.withColumn("a", F.lit(float("inf"))), ["a"])
    cuts = spark.createDataFrame([((6, 12, 18),), ((3, 10, 17),)], "cut struct<b1: int, b2: int, b3: int>")
    assert segment.check_cuts(cuts.where("cut.b1 = 6")).count() == 1
    with pytest.raises(SchemaError):
        segment.check_cuts(cuts)


def test_learning_cycle_stores_and_promotes(spark, tmp_path):
    d = daily(spark, 2, 30)
    frame = d.select(F.col("seg0").alias("x"), F.col("seg1").alias("y"))
    store = sinks.ModelStore(spark, str(tmp_path), "3day")
    trainers = {"3day": lambda: (models.estimator("linear", ["x"], "y").fit(frame), {"mae": 1.0, "rmse": 2.0, "r2": 0.5}), "weekly": lambda: 1 / 0}
    stores = {"3day": store, "weekly": sinks.ModelStore(spark, str(tmp_path), "weekly")}
    out = cycle.learn(trainers, stores, promote=True, report=str(tmp_path / "report"))
    assert out["3day"]["production"] and store.production()["version"] == out["3day"]["version"]
    assert out["weekly"]["status"] is jobs.Status.FAILED
    assert json.loads(sinks.read_text(spark, str(tmp_path / "report")))["3day"]["status"] == "promoted"
    again = cycle.learn({"3day": lambda: (table_model(), {"mae": 99.0, "rmse": 99.0, "r2": -1.0})}, {"3day": store}, promote=True)
    assert again["3day"]["status"] is jobs.Status.REJECTED and store.production()["version"] == out["3day"]["version"]
    with pytest.raises(ValueError):
        cycle.trainer(jobs.HorizonConfig(horizon="yearly"), d, None)


def table_model():
    class Model:
        def save(self, path):
            pass

    return Model()


def test_single_trainer_and_validation(spark, tmp_path):
    table = daily(spark, 2, 130).select("device_id", "day", *[F.col(x).alias(f"x{i}") for i, x in enumerate(SEG)], *[(F.col(x) * 2).alias(f"target_{x}") for x in SEG]).cache()
    model, scores = cycle.train_single(table, "linear", str(tmp_path / "m"))
    assert set(scores) == {"train", "valid", "test"} and scores["test"]["overall"]["r2"] > 0.5 and model.inputs
    out = cycle.validate(table, "linear", str(tmp_path / "v"))
    assert out["windows"] == len(out["by_window"]) > 0 and json.loads(sinks.read_text(spark, str(tmp_path / "v")))["windows"] == out["windows"]


def test_a_cycle_runs_what_is_due_and_keeps_its_state(spark, tmp_path):
    path, ran = str(tmp_path / "state"), []
    work = {name: (lambda n=name: ran.append(n)) for name in ("actuals", "nightly", "weekly", "cycle")}
    work["monthly"] = lambda: 1 / 0
    out = cycle.run_cycle(spark, path, work, dt.date(2024, 3, 6))
    assert out["monthly"].startswith("failed") and ran == ["cycle", "actuals", "nightly", "weekly"]
    ran.clear()
    cycle.run_cycle(spark, path, work, dt.date(2024, 3, 7))
    assert ran == ["actuals", "nightly"]
    sinks.write_text(spark, path, "no state")
    assert cycle.load_state(spark, path) == jobs.State()


def test_actuals_are_filled_in_once(spark):
    spark.sql("create database if not exists cyc")
    readings = hours(spark, [1.0 + (h % 24) / 10 for h in range(24 * 5)])
    for _ in range(2):
        cycle.write_actuals(readings, F.lit(dt.date(2024, 1, 6)), "cyc", window_days=3)
    rows = spark.table("cyc.daily_actuals").collect()
    assert len(rows) == 5 and all(sum(r[f"actual_{s}"] for s in SEG) == pytest.approx(24 + 27.6) for r in rows)


def test_filling_gaps_is_linear(spark):
    """A frame that grows, in both directions: no operator of the plan shrinks one."""
    from ampflow.operators import clean

    plan = clean.filled(hours(spark, [1.0, None, 3.0]))._jdf.queryExecution().toString()
    assert "unboundedfollowing" not in plan.split("_gaps")[0].lower()


#: Queries without SQL, which test_oracles does not run.
BARE = sorted(set(registry.QUERIES) - set(registry.ORACLES))


@pytest.mark.parametrize("name", BARE)
def test_queries_without_sql_run(spark, name):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0
