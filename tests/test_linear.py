"""Linear models from moments, by group and by horizon; the recursive forecast by state."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampflow.operators import cluster, evaluate, features, linear, models, recursion
from ampflow.operators.segment import segment_columns
from ampflow.plans import jobs
from ampflow.schema import SEG, SchemaError
from ampflow.sources.sinks import settled

from .test_library import daily, hours


def closed_form(x, y, alpha):
    mean, std = x.mean(0), x.std(0)
    z = (x - mean) / np.where(std > 0, std, 1)
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) if alpha else np.linalg.pinv(z) @ (y - y.mean())
    return z @ w + y.mean()


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 4)) * [1, 50, 0.01, 1] + [1e6, 0, 3, 7]
    x[:, 3] = 7.0  # no variance
    x = np.column_stack([x, x[:, 1] * 2])  # depends on another
    g = rng.integers(0, 3, 900)
    y = x[:, 0] - 1e6 + 0.2 * x[:, 1] * (g + 1) + rng.normal(size=900)
    rows = [(int(k), *map(float, a), float(b), float(b * 2 + k)) for k, a, b in zip(g, x, y)]
    df = spark.createDataFrame(rows + [(0, None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (1, float("nan"), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], "g int, a double, b double, c double, d double, e double, y double, z double")
    return df.repartition(9), x, g, y


@pytest.mark.parametrize("alpha", [0.0, 1.0, 50.0])
def test_one_pass_gives_the_closed_form_of_every_group_and_target(spark, table, alpha):
    df, x, g, y = table
    inputs = list("abcde")
    found = linear.moments(df, [*inputs, "y", "z"], F.col("g"))
    assert {k: m.n for k, m in found.items()} == {str(k): int((g == k).sum()) for k in range(3)}
    group = {k: {t: linear.solve(m, inputs, t, alpha) for t in ("y", "z")} for k, m in found.items()}
    for k in range(3):
        own = x[g == k]
        for t, truth in (("y", y[g == k]), ("z", y[g == k] * 2 + k)):
            m = group[str(k)][t]
            assert np.allclose(own @ m.weights + m.intercept, closed_form(own, truth, alpha), atol=1e-6)
            assert m.scaled[3] == 0 and m.rows == len(own)
    both = linear.solve(linear.together(found.values()), inputs, "y", alpha)
    assert np.allclose(x @ both.weights + both.intercept, closed_form(x, y, alpha), atol=1e-6)
    made = linear.predicted_by(df.dropna(), group, F.col("g")).select("g", *inputs, "pred_y", "pred_z").collect()
    assert len(made) == 900
    for r in made[:50]:
        m = group[str(r.g)]["y"]
        assert r.pred_y == pytest.approx(float(np.array([r[c] for c in inputs]) @ m.weights + m.intercept), abs=1e-6)


def test_moments_add_up_and_are_merged_in_rounds(spark, table, monkeypatch):
    df = table[0]
    monkeypatch.setattr(linear, "FAN_IN", 2)
    m = linear.moments(df, ["a", "b"])[""]
    x = np.array([[r.a, r.b] for r in df.dropna().collect() if r.a == r.a])
    assert m.n == 900 and np.allclose(m.products / m.n, np.cov(x.T, ddof=0), rtol=1e-9) and np.allclose(m.mean, x.mean(0))
    assert linear.moments(df.where("g > 9"), ["a"]) == {}
    with pytest.raises(ValueError, match="no rows"):
        linear.fit(df.where("g > 9"), ["a"], ["y"])


def test_models_are_saved(spark, table, tmp_path):
    df = table[0]
    m = models.estimator("ridge", ["a", "b"], "y", alpha=3.0).fit(df)
    m.save(str(tmp_path / "m"))
    again = linear.LinearModel.load(spark, str(tmp_path / "m"))
    assert [r.prediction for r in again.transform(df).collect()] == [r.prediction for r in m.transform(df).collect()]
    assert m.transform(df).count() == 900  # rows that lack an input go


def test_a_bundle_takes_one_pass_and_equals_fits_by_cluster(spark):
    d = daily(spark, 12, 60)
    fit = cluster.fit(d, cluster.ClusterSettings(min_devices=3, k_max=2, tries=1))
    frame = features.horizon_frame(features.panel(d), 1)
    inputs = features.panel_inputs(frame)
    build = lambda: models.estimator("ridge", inputs, "target_ratio", frame)
    bundle = cluster.train_bundle(frame, fit, build, inputs=inputs)
    labelled = fit.label(frame)
    for c, m in bundle.models.items():
        alone = build().fit(labelled.where(F.col("cluster") == c))
        assert np.allclose(m.weights, alone.weights, atol=1e-8) and m.rows == alone.rows
    assert np.allclose(bundle.fallback.weights, build().fit(frame).weights, atol=1e-8)
    made = bundle.predict(frame)
    for route, n in made.groupBy("route").count().collect():
        m = bundle.models[int(route[-1])] if route != "fallback" else bundle.fallback
        rows = made.where(F.col("route") == route)
        assert rows.where(F.abs(F.col("prediction") - m.column()) > 1e-12).count() == 0 and n > 0
    uncovered = cluster.train_bundle(frame, fit, build, min_rows=10**6, uncovered_only=True, inputs=inputs)
    assert not uncovered.models and np.allclose(uncovered.fallback.weights, bundle.fallback.weights, atol=1e-8)


def test_horizons_in_one_frame_are_those_of_their_own(spark):
    rows = features.panel(daily(spark, 3, 50)).cache()
    both = features.horizon_frames(rows, (1, 3))
    for h in (1, 3):
        own = features.horizon_frame(rows, h)
        assert both.where(F.col("horizon") == h).select(own.columns).exceptAll(own).isEmpty() and both.where(F.col("horizon") == h).count() == own.count() > 0


def test_benchmark_equals_models_fitted_one_by_one(spark):
    d = daily(spark, 8, 100)
    settings = cluster.ClusterSettings(min_devices=2, k_max=2, tries=1)
    got = {(r.horizon, r["mode"]): r for r in jobs.benchmark(d, (1, 2), settings=settings).collect()}
    assert set(got) == {(h, m) for h in (1, 2) for m in ("naive", "global", "cluster")}
    rows = features.panel(d, (1, 2)).cache()
    cut = features.cutoff(rows.where("usable"))
    for h in (1, 2):
        frame = features.parted(features.horizon_frame(rows, h), cut).cache()
        fit = models.estimator("ridge", features.panel_inputs(frame), "target_ratio").fit(frame.where("part = 'train'"))
        want = evaluate.measure(fit.transform(frame.where("part = 'test'")).withColumn("p", F.greatest(F.col("prediction") * F.col("scale"), F.lit(0.0))), "target", "p").first()
        assert got[h, "global"].wape == pytest.approx(want.wape, rel=1e-9) and got[h, "global"].n == want.n
    with pytest.raises(ValueError, match="too little data"):
        jobs.benchmark(d.where("day < '2024-01-10'"))


def test_trees_in_the_benchmark(spark):
    out = jobs.benchmark(daily(spark, 4, 60), (1,), ("ridge", "random_forest"), settings=cluster.ClusterSettings(enabled=False)).collect()
    assert sorted((r["mode"], r.algorithm) for r in out) == [("global", "random_forest"), ("global", "ridge"), ("naive", "Naive(t-7)")]


# ---- the recursive forecast


def by_all_history(d, cuts, model, steps=3):
    """Each step from all history anew, forecasts so far among it."""
    times = segment_columns(*[F.col(f"cut.b{i}") for i in (1, 2, 3)])
    cuts = cuts.select("device_id", *[c.alias(f"next_{n}") for n, c in times.items()])
    known, out = d.select("device_id", "day", *SEG, *recursion.TIMES), []
    for step in range(1, steps + 1):
        now = recursion.fold(known).join(cuts, "device_id").toArrow().combine_chunks().to_batches()[0]
        state, (start, hours) = recursion.State(now), recursion._following(now)
        found = state.inputs(start, hours)
        x = np.column_stack([found[c] for c in model.inputs])
        new = []
        for k in np.flatnonzero(np.isfinite(x).all(1)):
            made = [max(0.0, float(x[k] @ model.models[t].weights + model.models[t].intercept)) for t in features.TARGETS]
            i, day = state.device[int(k)].as_py(), (state.day[k] + 1).astype(object)
            out.append((step, i, day, *made))
            new.append((i, day, *made, *[int(v) for pair in zip(start[k], hours[k]) for v in pair]))
        known = known.union(d.sparkSession.createDataFrame(new, known.schema))
    return sorted(out)


@pytest.fixture(scope="module")
def moving(spark):
    """Devices of several lengths whose cuts move; one is too short, one has no cut."""
    d = daily(spark, 5, 80)
    move = F.dayofmonth("day") % 2
    d = d.withColumns({"seg1_start": 6 + move, "seg0_hours": 6 + move, "seg1_hours": 6 - move})
    return d.where("device_id <> 3 or day < '2024-01-25'").where("device_id <> 1 or day > '2024-02-15'")


@pytest.fixture(scope="module")
def feature_table(moving):
    return settled(features.build(moving), "features")


def test_features_of_a_state_are_those_of_the_table(spark, moving):
    last = moving.groupBy("device_id").agg(F.max("day").alias("day"))
    after = {c: F.lit(v) for c, v in zip(recursion.TIMES, (0, 5, 5, 7, 12, 6, 18, 6))}
    following = {f"next_{c}": v for c, v in after.items()}
    ahead = last.select("device_id", F.date_add("day", 1).alias("day"), *[F.lit(0.0).alias(s) for s in SEG], *[c.alias(n) for n, c in after.items()])
    table = features.build(moving.unionByName(ahead), targets=False, drop=False).join(last, ["device_id", "day"], "left_semi")
    names = features.feature_columns(table.columns)
    assert len(names) == 156
    want = {r.device_id: r for r in table.collect()}
    state = recursion.fold(moving).withColumns(following).toArrow().combine_chunks().to_batches()[0]
    got = recursion.State(state).inputs(*recursion._following(state))
    assert set(got) == set(names) and set(state.column("device_id").to_pylist()) == set(want) and len(want) == 5
    for k, i in enumerate(state.column("device_id").to_pylist()):
        for c in names:
            assert got[c][k] == pytest.approx(float("nan") if want[i][c] is None else float(want[i][c]), rel=1e-9, abs=1e-9, nan_ok=True), (i, c)


def test_the_forecast_by_state_equals_that_by_all_history(spark, moving, feature_table, monkeypatch):
    model = models.SegmentModel("ridge").fit(feature_table)
    cuts = moving.where("device_id <> 4").select("device_id").distinct().withColumn("cut", F.struct(F.lit(5).alias("b1"), F.lit(12).alias("b2"), F.lit(18).alias("b3")))
    rows = lambda: sorted((r.step, r.device_id, r.day, *[r[s] for s in SEG]) for r in models.recursive_forecast(moving, cuts, model).collect())
    got, want = rows(), by_all_history(moving, cuts, model)
    assert len(got) == 9 and [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want], rtol=1e-9, atol=1e-9)
    monkeypatch.setattr(models, "LinearModel", type(None))  # now a pass a step, as for trees
    stored = rows()
    assert [g[:3] for g in got] == [w[:3] for w in stored]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in stored], rtol=1e-9, atol=1e-9)


def test_advancing_a_state_equals_folding_a_day_more(spark, moving):
    day = dt.date(2024, 3, 10)
    before = recursion.fold(moving.where(F.col("day") < day))
    new = moving.where(F.col("day") == day).select("device_id", *[F.col(s).alias(f"pred_{s}") for s in SEG], *[F.col(c).alias(f"next_{c}") for c in recursion.TIMES])
    rows = before.where("day = '2024-03-09'").join(new, "device_id")
    moved = recursion.advanced(rows, before.columns)
    got = {r.device_id: r.asDict() for r in moved.select(before.columns).collect()}
    want = {r.device_id: r.asDict() for r in recursion.fold(moving.where(F.col("day") <= day)).collect()}
    assert got.keys() <= want.keys() and len(got) == 4
    for i, row in got.items():
        for c, v in row.items():
            assert v == (want[i][c] if isinstance(v, dt.date) else pytest.approx(want[i][c], rel=1e-9, abs=1e-9)), (i, c)


def test_segment_models_check_their_inputs_and_are_saved(spark, feature_table, tmp_path):
    table = feature_table
    with pytest.raises(SchemaError):
        models.SegmentModel().fit(table.drop("target_seg1"))
    with pytest.raises(SchemaError):
        models.SegmentModel().fit(table.select("device_id", "day", *features.TARGETS))
    with pytest.raises(ValueError, match="no rows"):
        models.SegmentModel("random_forest").fit(table.where("device_id < 0"))
    for algorithm, params in (("ridge", {"alpha": 2.0}), ("random_forest", {"trees": 3, "depth": 4})):
        model = models.SegmentModel(algorithm, **params).fit(table)
        model.save(str(tmp_path / algorithm))
        again = models.SegmentModel.load(str(tmp_path / algorithm))
        assert again.algorithm == algorithm and again.params == params
        key = lambda m: sorted((r.device_id, r.day, r.pred_seg2) for r in m.predict(table).collect())
        assert key(again) == key(model) and len(model.importance("target_seg2")) == 156


def test_two_arms_are_held_against_the_same_days(spark):
    values = [1.0 + (h % 24 in (7, 8, 19, 20)) * 2 + (h // 24 % 7) / 4 for h in range(24 * 70)]
    readings = hours(spark, values).union(hours(spark, [2 * v for v in values], 2))
    out = jobs.two_arms(readings, window_days=5, horizons=(1,), settings=cluster.ClusterSettings(enabled=False)).collect()
    got = {(r.arm, r["mode"]): r for r in out}
    assert set(got) == {(arm, mode) for arm in ("jenks", "adaptive") for mode in ("naive", "global")}
    for mode in ("naive", "global"):
        a, b = got["jenks", mode], got["adaptive", mode]
        assert a.n == b.n > 0 and a.mae == pytest.approx(b.mae, abs=1e-6)  # a day's total does not depend on its cuts
