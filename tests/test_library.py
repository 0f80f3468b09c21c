"""Cleaning, calendar, features, models, evaluation, sinks, jobs, streaming."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampflow.functions import calendar as cal
from ampflow.operators import clean, cluster, evaluate, features, ingest, models
from ampflow.plans import jobs
from ampflow.schema import SEG, SchemaError, check_daily, no_leakage, require
from ampflow.sources import readers, sinks
from ampflow.streaming import meter

DAY0 = dt.datetime(2024, 1, 1)


def hours(spark, values, device=1):
    """Readings of consecutive hours; None: missing."""
    rows = [(device, DAY0 + dt.timedelta(hours=i), float(v)) for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "device_id long, ts timestamp, kwh double")


def daily(spark, devices=6, days=120, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(devices):
        for i in range(days):
            level = 5 + 4 * (d % 2) + (3 if (i % 7) >= 5 else 0)
            rows.append((d, (DAY0 + dt.timedelta(days=i)).date(), *[float(max(0, level * s + rng.normal(0, 0.3))) for s in (0.5, 1.0, 0.8, 1.5)], 0, 6, 12, 18, 6, 6, 6, 6))
    return spark.createDataFrame(rows, "device_id long, day date, " + ", ".join(f"{s} double" for s in SEG) + ", " + ", ".join(f"{s}_start int" for s in SEG) + ", " + ", ".join(f"{s}_hours int" for s in SEG))


@pytest.mark.parametrize(("gap", "lost"), [(6, False), (7, False), (12, False), (13, True), (24, True)])
def test_gaps(spark, gap, lost):
    values = [float(i % 7) for i in range(72)]
    for i in range(30, 30 + gap):
        values[i] = None
    out = clean.filled(hours(spark, values))
    days = {r.d: r["count"] for r in out.groupBy(F.to_date("ts").alias("d")).count().collect()}
    assert (dt.date(2024, 1, 2) not in days) == lost
    if not lost:
        p, n = values[29], values[30 + gap]
        got = out.where(F.col("ts") == DAY0 + dt.timedelta(hours=31)).first().kwh
        assert got == pytest.approx(p + (n - p) * 2 / (gap + 1))


def test_cleaning_edges(spark):
    raw = hours(spark, [1.0] * 19 + [None] * 5 + [2.0] * 20 + [None] * 4 + [3.0] * 24)
    more = spark.createDataFrame([(1, DAY0 + dt.timedelta(days=2), 5.0), (1, DAY0 + dt.timedelta(days=2, hours=1), -1.0)], raw.schema)
    out = clean.preprocess(raw.union(more))
    kept = {r.day: r for r in out.groupBy("day").agg(F.count("*").alias("n"), F.max("kwh").alias("m")).collect()}
    assert dt.date(2024, 1, 1) not in kept and kept[dt.date(2024, 1, 3)].m == 4.0
    few = hours(spark, [1.0] * 40 + [100.0])
    assert clean.clipped(few).agg(F.max("kwh")).first()[0] == 100.0
    many = hours(spark, [1.0] * 200 + [100.0])
    assert clean.clipped(many).agg(F.max("kwh")).first()[0] < 100.0


def test_jalali(spark):
    days = spark.sql("select explode(sequence(date'1990-01-01', date'2040-12-31')) as day")
    j = cal.jalali(F.col("day"))
    rows = days.select("day", j.alias("j"), cal.from_jalali(j["jy"], j["jm"], j["jd"]).alias("back"), cal.jalali_month_end(F.col("day")).alias("last"), cal.next_jalali_month(F.col("day")).alias("n")).collect()
    assert all(r.day == r.back for r in rows)
    by = {r.day: tuple(r.j) for r in rows}
    known = {"2024-03-20": (1403, 1, 1), "2025-03-21": (1404, 1, 1), "2021-03-20": (1399, 12, 30), "2021-03-21": (1400, 1, 1), "2000-01-01": (1378, 10, 11)}
    assert all(by[dt.date.fromisoformat(k)] == v for k, v in known.items())
    for a, b in zip(rows, rows[1:]):
        assert tuple(b.j)[2] == 1 or tuple(b.j)[2] == tuple(a.j)[2] + 1
    assert all(29 <= r.j.jd <= 31 for r, s in zip(rows, rows[1:]) if s.j.jd == 1)
    assert all(r.day <= r.last and r.n.start >= r.day for r in rows)


def test_weeks(spark):
    r = spark.sql("select date'2024-01-06' as s, date'2024-01-07' as d").select(cal.next_week(F.col("s")).alias("a"), cal.next_week(F.col("d")).alias("b"), cal.whole_weeks(F.col("d"), F.lit("2024-02-01").cast("date")).alias("w")).first()
    assert (r.a.start, r.b.start) == (dt.date(2024, 1, 6), dt.date(2024, 1, 13))
    assert r.w == [dt.date(2024, 1, 13), dt.date(2024, 1, 20)]


def test_feature_table(spark):
    d = daily(spark, 2, 45)
    out = features.build(d)
    inputs = features.feature_columns(out.columns)
    assert len(inputs) == 156 and out.count() == 2 * 14  # from the 31st row, to the last but one
    r = out.where("device_id = 0").orderBy("day").first()
    assert r.day == dt.date(2024, 1, 31)
    x = d.where("device_id = 0").orderBy("day").toPandas()
    assert r.seg0_mean7 == pytest.approx(x.seg0[23:30].mean()) and r.seg1_std14 == pytest.approx(x.seg1[16:30].std())
    assert r.seg2_past_std == pytest.approx(x.seg2[:30].std(ddof=0)) and r.target_seg3 == x.seg3[31] and r.seg0_lag30 == x.seg0[0]
    no_leakage(inputs, [])
    with pytest.raises(SchemaError):
        no_leakage([*inputs, "target_seg0"], [])
    check_daily(d)
    with pytest.raises(SchemaError):
        check_daily(d.union(d))
    with pytest.raises(SchemaError):
        require(d, ["no_such"])


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3)) * [1, 5, 0.2] + [0, 3, 9]
    y = x @ [1.0, -0.5, 4.0] + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    fit = models.estimator("ridge", ["a", "b", "c"], "y", df, alpha=10.0).fit(df)
    got = np.array([r.prediction for r in fit.transform(df).select("prediction").collect()])
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(got, z @ w + y.mean(), atol=1e-8)


def test_recursive_forecast(spark):
    d = daily(spark, 4, 90)
    model = models.SegmentModel("ridge").fit(features.build(d))
    cuts = d.select("device_id").distinct().withColumn("cut", F.struct(F.lit(6).alias("b1"), F.lit(12).alias("b2"), F.lit(18).alias("b3")))
    out = models.recursive_forecast(d, cuts, model)
    rows = out.collect()
    assert len(rows) == 12 and {r.day for r in rows} == {dt.date(2024, 3, 31) + dt.timedelta(days=i) for i in range(3)}
    assert all(0 <= r.seg3 < 30 for r in rows)
    payload = models.with_insufficient(models.payload(out, cuts), d.select("device_id").union(spark.sql("select 99L"))).collect()
    by = {r.device_id: r for r in payload}
    first = json.loads(by[0].prediction_today)
    assert first["date"] == "2024-03-31" and len(first["segments"]) == 4 and first["peak"]["segment"] == 3 and by[99].prediction_today is None
    assert len(model.importance()) == 156
    with pytest.raises(ValueError):
        model.predict(d)


def test_clusters_and_routes(spark):
    d = daily(spark, 16, 60)
    fit = cluster.fit(d, cluster.ClusterSettings(min_devices=3, k_max=3, tries=1))
    labels = {r.device_id: r.cluster for r in fit.labels.collect()}
    assert fit.status == "ok" and fit.k == 2 and len({labels[i] for i in range(0, 16, 2)}) == 1 and labels[0] != labels[1]
    assert cluster.fit(d.where("device_id < 2"), cluster.ClusterSettings()).status == "too_few_devices"
    assert cluster.fit(d, cluster.ClusterSettings(enabled=False)).status == "disabled"
    short = d.where("device_id > 0 or day < '2024-01-10'")
    reasons = {r.device_id: r.reason for r in cluster.route(short, fit, [labels[1]], cluster.ClusterSettings(outlier_z=1e9)).collect()}
    assert reasons[0] == "below_min_days" and reasons[1] == "ok" and reasons[2] == "cluster_has_no_model"


def test_benchmark_beats_naive(spark):
    out = jobs.benchmark(daily(spark, 8, 120), horizons=(1,), settings=cluster.ClusterSettings(min_devices=2, k_max=2, tries=1))
    wape = {r["mode"]: r.wape for r in out.collect()}
    assert wape["global"] < wape["naive"] and set(wape) == {"naive", "global", "cluster"}


def test_features_of_weeks_and_months(spark):
    d = daily(spark, 1, 200)
    x = d.toPandas().assign(use=lambda t: t[list(SEG)].sum(axis=1), day=lambda t: t.day.astype("datetime64[ns]"))
    x["start"] = x.day - np.array([(i - 5) % 7 for i in x.day.dt.dayofweek], "timedelta64[D]")
    whole = x.groupby("start").use.agg(["sum", "count"]).query("count == 7")["sum"]
    rows = features.weekly(d).orderBy("start").collect()
    assert [r.n_hist for r in rows] == list(range(2, len(whole)))
    for r in rows:
        past = whole.to_numpy()[: r.n_hist]
        assert (r.prev1, r.mean2, r.mean4, r.mean8) == pytest.approx((past[-1], past[-2:].mean(), past[-4:].mean(), past[-8:].mean()))
        assert (r.std4, r.trend2, r.trend4) == pytest.approx((past[-4:].std(), past[-1] - past[-2], past[-1] - past[-4] if len(past) >= 4 else 0.0))
        assert r.week == r.start.isocalendar()[1]
    month = x[x.day < "2024-07-01"].groupby(x.day.dt.month).use.sum().to_numpy()
    r = features.monthly(d).orderBy("start").collect()[3]
    assert (r.month, r.prev1, r.mean2, r.mean12, r.trend3) == pytest.approx((6, month[4], month[3:5].mean(), month[:5].mean(), month[4] - month[2]))


def test_weekly_and_monthly_jobs(spark):
    d = daily(spark, 4, 150)
    frame = features.weekly(d)
    config = jobs.HorizonConfig("weekly", "ridge")
    bundle, scores = jobs.train_period(frame, config, cluster.ClusterFit("disabled"))
    assert scores["r2"] > 0
    out = jobs.weekly_forecast(d, bundle.fallback, F.lit("2024-05-30").cast("date")).collect()
    assert len(out) == 4 and {(r.week_start, r.week_end) for r in out} == {(dt.date(2024, 6, 1), dt.date(2024, 6, 7))}
    assert all(r.predicted_consumption_kwh > 0 for r in out)
    months = features.monthly(d)
    fit = models.estimator("linear", ["prev1"], "use").fit(months)
    out = jobs.monthly_forecast(d, fit, F.lit("2024-05-25").cast("date")).collect()
    assert {r.month_start for r in out} == {dt.date(2024, 6, 21)}


def test_learning_cycle_isolates_failures():
    good = {"mae": 1.0, "rmse": 2.0, "r2": 0.9}
    out = jobs.learning_cycle({"a": lambda: ("m", good), "b": lambda: 1 / 0, "c": lambda: ("m", {"mae": 2.0, "rmse": 2.0, "r2": 0.9})}, {"c": good})
    assert [out[k]["status"].value for k in "abc"] == ["promoted", "failed", "rejected"]
    assert evaluate.promote(good, {"mae": 1.04, "rmse": 2.0, "r2": 0.8}) == (False, "r2_worse")


def test_due():
    s = jobs.due(jobs.State(dt.date(2024, 5, 1), dt.date(2024, 5, 18), dt.date(2024, 5, 1)), dt.date(2024, 5, 21))
    assert s == {"actuals": True, "nightly": True, "weekly": False, "monthly": True, "cycle": False}
    assert jobs._solar_month_start(dt.date(2024, 3, 25)) == dt.date(2024, 3, 20)


def test_walk_forward(spark):
    d = daily(spark, 3, 150).withColumn("p", F.col("seg0") * 1.01)
    windows = evaluate.walk_forward(d, lambda train, test: test, {"seg0": ("seg0", "p")})
    assert len(windows) == 3 and evaluate.summary(windows)["valid"]


def test_clock_check(spark):
    rng = np.random.default_rng(0)
    rows = []
    for home in range(6):
        for d in range(0, 365, 2):
            for h in range(24):
                use = 0.2 + np.exp(-((h - 19) ** 2) / 4) + 0.5 * np.exp(-((h - 7.5) ** 2) / 2) + rng.normal(0, 0.05)
                rows.append((home, dt.datetime(2013, 1, 1) + dt.timedelta(days=d, hours=h), float(max(0, use))))
    wall = spark.createDataFrame(rows, "device_id long, ts timestamp, kwh double")
    utc = wall.withColumn("ts", F.when(F.month("ts").between(4, 10), F.col("ts") - F.expr("interval 1 hour")).otherwise(F.col("ts")))
    assert ingest.clock_verdict(wall) == "LOCAL_LIKE" and ingest.clock_verdict(utc) == "UTC_LIKE"


def test_prepare_half_hours(spark):
    rows = []
    for home in ("MAC001", "MAC002", "MAC003"):
        for i in range(48 * 31):
            stamp = (DAY0 + dt.timedelta(minutes=30 * i)).strftime("%Y-%m-%d %H:%M:%S.0000000")
            bad = home == "MAC002" and i < 200
            rows.append((home, "ToU" if home == "MAC003" else "Std", stamp, "Null" if bad else "  0.250"))
    out = ingest.prepare(spark.createDataFrame(rows, "household string, tariff string, stamp string, kwh string"), "2024-01", "2024-01", 5)
    assert {(r.device_id, r.kwh) for r in out.select("device_id", "kwh").distinct().collect()} == {(1, 0.5)} and out.count() == 744


def test_actuals_and_tags(spark):
    readings = hours(spark, [1 + (h % 24 == 19) * 5 for h in range(24 * 10)])
    days = jobs.days_to_fill(readings, spark.createDataFrame([(1, dt.date(2024, 1, 9))], "device_id long, actual_date date"), F.lit("2024-01-11").cast("date"), 5)
    assert {r.day.day for r in days.collect()} == {6, 7, 8, 10}
    actual = jobs.daily_actuals(readings, days, 3).cache()
    rows = actual.collect()
    assert len(rows) == 4 and all(r.peak_hour == 19 and r.peak_value == 6.0 and sum(r[f"actual_{s}"] for s in SEG) == 29.0 for r in rows)
    raw = readings.select(F.monotonically_increasing_id().alias("id"), "device_id", (F.col("kwh") * 1000).alias("power_W"), (F.col("ts") + F.expr("interval 1 hour")).alias("created_at"), F.lit(None).cast("tinyint").alias("segment_id"), F.lit(None).cast("boolean").alias("is_peak_hour"))
    done = sinks.tagged(raw, jobs.tags(raw, actual))
    assert done.where("is_peak_hour").count() == 4 and done.where("segment_id is not null").count() == 96


def test_actuals_of_days_with_missing_hours(spark):
    readings = hours(spark, [None if h in (53, 54) or 72 <= h < 80 else 1.0 + h % 24 for h in range(24 * 5)])
    rows = {r.day.day: r for r in jobs.daily_actuals(readings, None, 3).collect()}
    assert sorted(rows) == [1, 2, 3, 5]  # the fourth day has 16 hours
    assert sum(rows[3][f"actual_{s}"] for s in SEG) == 300.0 - 6 - 7 and rows[3].peak_hour == 23


def test_share_metrics_at_the_edges(spark):
    r = evaluate.measure(spark.createDataFrame([(0.0, 0.0), (-1.0, 1.0), (3.0, 3.0)], "y double, p double"), "y", "p").first()
    assert (r.smape, r.bias, r.wape) == pytest.approx((200 / 3, 100.0, 50.0))
    assert evaluate.measure(spark.createDataFrame([(1.0, 2.0)] * 2, "y double, p double"), "y", "p").first().r2 is None


def test_result_tables(spark):
    spark.sql("create database if not exists amp_test")
    new = spark.sql("select 1L device_id, date'2024-06-01' week_start, date'2024-06-07' week_end, 5.0D predicted_consumption_kwh, 'v1' model_version, timestamp'2024-06-01' generated_at")
    sinks.write_results(new, "weekly_predictions", "amp_test")
    sinks.write_results(new.withColumn("predicted_consumption_kwh", F.lit(7.0)).union(new.withColumn("device_id", F.lit(2))), "weekly_predictions", "amp_test")
    got = {r.device_id: r.predicted_consumption_kwh for r in spark.table("amp_test.weekly_predictions").collect()}
    assert got == {1: 7.0, 2: 5.0} and sinks.missing_columns(spark, "amp_test.weekly_predictions", ["device_id", "x"]) == ["x"]
    sinks.write_results(new, "weekly_predictions", "amp_test", replace=True)
    assert spark.table("amp_test.weekly_predictions").count() == 1


def test_model_store(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.5)], "x double, y double")
    fit = models.estimator("linear", ["x"], "y").fit(df)
    store = sinks.ModelStore(spark, str(tmp_path), "weekly")
    assert store.production() is None and store.next_version() == "v1.0"
    v = store.store_candidate(fit, {"mae": 1.0})
    assert store.promote(v, fit)["version"] == v and store.production()["version"] == v and store.next_version() == "v1.1"
    with pytest.raises(ValueError):
        store.delete(v, candidate=False)
    store.delete(v)
    assert store.versions(True) == [] and store.versions() == [v]


def test_readers(spark, tmp_path):
    (tmp_path / "h.csv").write_text("Meter ID;Date_Time;Energy (kWh)\nB;2024-01-01 00:00:00; 1.5\nA;2024-01-01 00:00:00;2\nA;bad;3\nA;2024-01-01 01:00:00;-1\n")
    rows = {(r.device_id, r.kwh) for r in readers.read_hourly(spark, str(tmp_path / "h.csv")).collect()}
    assert rows == {(2, 1.5), (1, 2.0)}
    with pytest.raises(SchemaError):
        readers.canonical(spark.sql("select 1 as a"))
    with pytest.raises(SchemaError):
        readers.JdbcConfig.from_env({})
    assert readers.JdbcConfig.from_env({"DB_HOST": "h", "DB_NAME": "n", "DB_USER": "u"}).options()["url"].endswith("h:3306/n")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"device_id": 1, "ts": f"2024-01-01T{h:02d}:{m:02d}:00", "power_W": 100.0 * (h + 1)} for h in range(5) for m in (0, 30)]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    hours_ = meter.hourly_means(meter.sensor_stream(spark, str(tmp_path / "in")))
    meter.write_hours(hours_, str(tmp_path / "out"), str(tmp_path / "chk")).awaitTermination()
    (tmp_path / "in" / "b.json").write_text(json.dumps({"device_id": 1, "ts": "2024-01-02T00:00:00", "power_W": 1.0}))
    meter.write_hours(hours_, str(tmp_path / "out"), str(tmp_path / "chk")).awaitTermination()
    got = {r.ts.hour: r.kwh for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {h: pytest.approx(0.1 * (h + 1)) for h in range(5)}
