"""Walk-forward windows from moments by month; bootstrap draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampflow.operators import evaluate, features, models
from ampflow.plans import cycle
from ampflow.schema import SEG
from ampflow.sources.sinks import settled

from .test_library import daily


def test_windows_from_moments_equal_fits_a_window(spark):
    rows = daily(spark, 3, 150).select("device_id", "day", *[F.col(s).alias(f"x{k}") for k, s in enumerate(SEG)], *[(F.col(s) * 2 + F.col("seg0")).alias(f"target_{s}") for s in SEG]).cache()
    inputs, pairs = features.feature_columns(rows.columns), {s: (f"target_{s}", f"pred_{s}") for s in SEG}
    got = evaluate.linear_walk_forward(rows, inputs, pairs, 5.0)
    want = evaluate.walk_forward(rows, lambda train, test: models.SegmentModel("ridge", alpha=5.0).fit(train).predict(test), pairs)
    assert [(w["test_month"], w["train_months"], w["passed"]) for w in got] == [(w["test_month"], w["train_months"], w["passed"]) for w in want] and len(got) == 3
    for g, w in zip(got, want):
        for target in (*SEG, "overall"):
            for m in ("mae", "rmse", "mape", "maape", "r2"):
                assert g["metrics"][target][m] == pytest.approx(w["metrics"][target][m], rel=1e-9)
        assert g["baseline"]["mae"] == pytest.approx(w["baseline"]["mae"], rel=1e-12)
    assert evaluate.linear_walk_forward(rows.where("day < '2024-02-20'"), inputs, pairs, 1.0) == []


def test_training_and_validation_on_all_inputs(spark, tmp_path):
    table = settled(features.build(daily(spark, 3, 150)), "features")
    assert len(features.feature_columns(table.columns)) == 156
    model, scores = cycle.train_single(table, path=str(tmp_path / "m"))
    assert scores["test"]["overall"]["r2"] > 0.5 and models.SegmentModel.load(str(tmp_path / "m")).inputs == model.inputs
    out = cycle.validate(table)
    assert out["windows"] == 3 and out["mean_r2"] > 0.5


def test_draws_sum_to_the_devices_in_every_repetition(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "BLOCK", 20)
    devices = spark.range(130).withColumnRenamed("id", "device_id")
    rows = evaluate.weights(devices, 400, 3).collect()
    w = np.array([r.w for r in rows])
    assert w.shape == (130, 400) and set(w.sum(0)) == {130} and len({r.block for r in rows}) == 6
    assert abs(w.mean() - 1) < 1e-12 and w.var(1).mean() == pytest.approx(1 - 1 / 130, rel=0.05)  # of a multinomial draw
    again = evaluate.weights(devices.repartition(7), 400, 3).collect()
    assert sorted((r.device, r.w) for r in again) == sorted((r.device, r.w) for r in rows)
    assert evaluate.weights(devices.where("device_id < 0")).count() == 0


def test_the_interval_is_that_of_numpy(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "BLOCK", 16)
    rng = np.random.default_rng(6)
    n = 80
    errors = np.column_stack([rng.gamma(2, 2, n), rng.gamma(2, 1.5, n)])
    df = spark.createDataFrame([(i, 0.0, float(x), float(y)) for i, (x, y) in enumerate(errors)], "device_id long, y double, a double, b double")
    r = evaluate.bootstrap_gain(df, "y", "a", "b", 2000).first()
    sums = errors[rng.integers(0, n, (20_000, n))].sum(1)
    low, high = np.quantile((sums[:, 0] - sums[:, 1]) / sums[:, 0] * 100, [0.025, 0.975])
    assert r.gain == pytest.approx((errors[:, 0].sum() - errors[:, 1].sum()) / errors[:, 0].sum() * 100)
    assert (r.low, r.high) == (pytest.approx(low, abs=1.5), pytest.approx(high, abs=1.5))
    one = evaluate.bootstrap_gain(df.where("device_id = 3"), "y", "a", "b", 50).first()
    assert one.low == one.high == pytest.approx(one.gain)
    assert evaluate.bootstrap_gain(df.where("device_id < 0"), "y", "a", "b", 50).first().asDict() == {"gain": None, "low": None, "high": None}
