"""Jobs: daily actuals, nightly, weekly and monthly forecasts, the learning cycle, and what is due when."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ampflow.functions.calendar import jalali, next_jalali_month, next_week
from ampflow.operators import clean, cluster, evaluate, models, segment
from ampflow.operators import features as feats
from ampflow.schema import HOURS, SEG, no_leakage
from ampflow.sources.sinks import settled

#: Days that actuals are filled in for, back from yesterday.
BACKFILL = 90
#: Clean days that a device needs for a forecast.
ENOUGH_DAYS = clean.LEARNING_DAYS


class Status(Enum):
    PROMOTED = "promoted"
    REJECTED = "rejected"
    FAILED = "failed"


# Daily actuals --------------------------------------------------------------


def days_to_fill(readings: DataFrame, actuals: DataFrame, as_of: Column, horizon: int = BACKFILL) -> DataFrame:
    """device_id, day: days with readings to come in, of the last ``horizon`` before ``as_of``, that have no actual yet."""
    ends = readings.groupBy("device_id").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    lo, hi = F.greatest("a", F.date_sub(as_of, horizon)), F.least("b", F.date_sub(as_of, 1))
    days = ends.where(lo <= hi).select("device_id", F.explode(F.sequence(lo, hi)).alias("day"))
    return days.join(actuals.select("device_id", F.col("actual_date").alias("day")), ["device_id", "day"], "left_anti")


def daily_actuals(readings: DataFrame, days: DataFrame | None = None, window_days: int = 30, inclusive: bool = True, least: int = clean.MIN_DAY_HOURS) -> DataFrame:
    """device_id, day, cut, actual_seg0 .. 3, peak_hour, peak_value, peak_segment.

    A day is cut by the adaptive profile of the ``window_days`` calendar days
    that end with it (or with the day before).  Days of fewer than ``least``
    hours are left out.  Totals are of the hours there are; for the peak, hours
    without a reading take the mean of the day's others.
    """
    arrays = segment.day_arrays(readings)
    back = (window_days - 1, 0) if inclusive else (window_days, 1)
    at = F.unix_date("day")
    w = Window.partitionBy("device_id").orderBy(at).rangeBetween(-back[0], -back[1])
    rows = arrays.withColumn("_w", F.collect_list("v").over(w)).where((F.size("_w") > 0) & enough_hours(least))
    if days is not None:
        rows = rows.join(days, ["device_id", "day"], "left_semi")
    return cut_days(rows, window_days)


def enough_hours(least: int = clean.MIN_DAY_HOURS) -> Column:
    return F.size(F.filter("v", lambda x: x.isNotNull())) >= least


def cut_days(rows: DataFrame, window_days: int = 30) -> DataFrame:
    """The actuals of ``rows``: device_id, day, v (a day's hours) and _w (the days of its window, oldest first)."""
    cut = segment.segment_totals(segment.adaptive(segment.fit_windows(rows, window_days), "p", "agreement"), digits=9)
    out = cut.withColumn("v", segment.gaps_to_mean(F.col("v"))).withColumn("peak_hour", segment.peak_hour(F.col("v"))).withColumn("peak_value", F.array_max("v"))
    b = [F.col(f"cut.b{i}") for i in (1, 2, 3)]
    return out.select("device_id", "day", "cut", *[F.col(s).alias(f"actual_{s}") for s in SEG], "peak_hour", "peak_value", segment.segment_of(F.col("peak_hour"), *b).alias("peak_segment"))


def tags(meter: DataFrame, actuals: DataFrame) -> DataFrame:
    """id, segment_id, is_peak_hour of the meter rows of the days in ``actuals``."""
    start = F.col("created_at") - F.expr("interval 1 hour")
    rows = meter.select("id", "device_id", F.to_date(start).alias("day"), F.hour(start).alias("hour")).join(actuals, ["device_id", "day"])
    return rows.select("id", segment.segment_of(F.col("hour"), *[F.col(f"cut.b{i}") for i in (1, 2, 3)]).cast("tinyint").alias("segment_id"), (F.col("hour") == F.col("peak_hour")).alias("is_peak_hour"))


# Forecast jobs --------------------------------------------------------------


def nightly(readings: DataFrame, model: models.SegmentModel, window_days: int = 30, version: str = "", now: datetime | None = None, history: int = feats.HISTORY, enough: int = ENOUGH_DAYS) -> DataFrame:
    """Rows for nightly_predictions: three days ahead for every device of ``readings``.

    A device that cannot be forecast has null forecasts and a ``reason``, and does not keep the others from theirs.
    """
    devices = readings.where("device_id is not null").select("device_id").distinct()
    clean_rows = clean.preprocess(readings)
    days = devices.join(clean_rows.groupBy("device_id").agg(F.count_distinct("day").alias("days")), "device_id", "left")
    fit = clean_rows.join(days.where(F.col("days") >= enough), "device_id", "left_semi").select("device_id", "ts", "kwh")
    daily = segment.adaptive_daily(fit, window_days)
    cuts = segment.fit_devices(clean.last_days(fit, window_days)).select("device_id", "cut")
    forecast = models.recursive_forecast(daily, cuts, model, history=history)
    made = days.join(models.payload(forecast, cuts), "device_id", "left")
    reason = F.when(F.col("days").isNull(), "no_clean_days").when(F.col("days") < enough, "too_few_days").when(F.col("prediction_today").isNull(), "incomplete_inputs")
    return made.withColumn("reason", reason).drop("days").withColumn("model_version", F.lit(version)).withColumn("generated_at", F.lit(now) if now else F.current_timestamp())


def weekly_forecast(daily: DataFrame, model, as_of: Column, version: str = "") -> DataFrame:
    """Rows for weekly_predictions: the first whole week after ``as_of``; null for devices without two weeks."""
    rows = feats.latest_period(daily, next_week(as_of)["start"])
    return _period(daily, rows, model, next_week(as_of), "week", version, F.month)


def monthly_forecast(daily: DataFrame, model, as_of: Column, solar: bool = True, version: str = "") -> DataFrame:
    """Rows for monthly_predictions: the first whole month after ``as_of``; null for devices without two months."""
    first = F.trunc(as_of, "month")
    span = next_jalali_month(as_of) if solar else F.struct(F.add_months(first, F.when(as_of == first, 0).otherwise(1)).alias("start"), F.last_day(F.add_months(first, F.when(as_of == first, 0).otherwise(1))).alias("end"))
    rows = feats.latest_period(daily, span["start"], solar)
    return _period(daily, rows, model, span, "month", version, (lambda day: jalali(day)["jm"]) if solar else F.month)


def _period(daily: DataFrame, rows: DataFrame, model, span: Column, name: str, version: str, month: Callable[[Column], Column]) -> DataFrame:
    """A row a device, with the ``reason`` where there is no forecast."""
    made = model.transform(rows.withColumn("_start", span["start"]).withColumn("month", month(F.col("_start"))).withColumn("week", F.weekofyear("_start"))).select("device_id", F.when(~F.isnan("prediction"), F.greatest("prediction", F.lit(0.0))).alias("predicted_consumption_kwh"))
    devices = daily.where("device_id is not null").select("device_id").distinct().join(rows.select("device_id", F.lit(True).alias("known")), "device_id", "left")
    reason = F.when(F.col("known").isNull(), f"too_few_{name}s").when(F.col("predicted_consumption_kwh").isNull(), "incomplete_inputs")
    return devices.join(made, "device_id", "left").select("device_id", span["start"].alias(f"{name}_start"), span["end"].alias(f"{name}_end"), "predicted_consumption_kwh", F.lit(version).alias("model_version"), F.current_timestamp().alias("generated_at"), reason.alias("reason"))


# Learning -------------------------------------------------------------------


@dataclass(frozen=True)
class HorizonConfig:
    horizon: str = "3day"
    algorithm: str = "ridge"
    params: dict = field(default_factory=dict)
    cluster: cluster.ClusterSettings = cluster.ClusterSettings()
    min_rows: int = 20
    uncovered_only: bool = False
    train_share: float = 0.8


def period_inputs(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c not in ("device_id", "start", "use", "days")]


def train_period(frame: DataFrame, config: HorizonConfig, fit_: cluster.ClusterFit) -> tuple[cluster.Bundle, dict]:
    """A bundle trained on the first periods, and its errors on the rest."""
    inputs = period_inputs(frame)
    no_leakage(inputs, [])
    starts = [r.start for r in frame.select("start").distinct().orderBy("start").collect()]  # weeks or months
    if len(starts) < 2:
        raise ValueError("fewer than two periods")
    cut = starts[min(max(int(len(starts) * config.train_share), 1), len(starts) - 1)]
    frame = frame.na.fill(0.0, inputs)
    train, test = frame.where(F.col("start") < F.lit(cut)), frame.where(F.col("start") >= F.lit(cut))
    bundle = cluster.train_bundle(train, fit_, lambda: models.estimator(config.algorithm, inputs, "use", train, **config.params), config.min_rows, config.uncovered_only)
    scores = evaluate.measure(bundle.predict(test).withColumn("p", F.greatest("prediction", F.lit(0.0))), "use", "p", metrics=evaluate.angle_metrics)
    return bundle, scores.first().asDict()


def train_three_day(features: DataFrame, config: HorizonConfig) -> tuple[models.SegmentModel, dict]:
    """A model trained on all but the last month, and its errors on that."""
    last = features.agg(F.max(F.trunc("day", "month"))).first()[0]
    month = F.trunc("day", "month")
    model = models.SegmentModel(config.algorithm, **config.params).fit(features.where(month < F.lit(last)))
    made = model.predict(features.where(month == F.lit(last)))
    scores = evaluate.by_target(made, {s: (f"target_{s}", f"pred_{s}") for s in SEG}).where("target = 'overall'")
    return model, scores.first().asDict()


def learning_cycle(trainers: dict[str, Callable[[], tuple[object, dict]]], current: dict[str, dict | None]) -> dict[str, dict]:
    """Train every horizon, compare with what is in production; one that fails does not stop the rest."""
    out = {}
    for name, train in trainers.items():
        try:
            model, scores = train()
        except Exception as e:  # noqa: BLE001  a horizon's failure is a result of the cycle
            out[name] = {"status": Status.FAILED, "reason": str(e)[:500]}
            continue
        good, why = evaluate.promote(current.get(name), scores)
        out[name] = {"status": Status.PROMOTED if good else Status.REJECTED, "reason": why, "metrics": scores, "model": model}
    return out


# What is due ----------------------------------------------------------------


@dataclass
class State:
    """What ran last, as dates; None: never."""

    cycle: date | None = None
    week: date | None = None
    month: date | None = None


def due(state: State, today: date, cycle_days: int = 30) -> dict[str, bool]:
    """The learning cycle every ``cycle_days``; weeks on Saturdays, months on a Jalali month's first day, once each."""
    saturday = today - timedelta(days=(today.weekday() - 5) % 7)
    return {
        "actuals": True,
        "nightly": True,
        "weekly": state.week is None or state.week < saturday,
        "monthly": state.month is None or state.month < _solar_month_start(today),
        "cycle": state.cycle is None or (today - state.cycle).days >= cycle_days,
    }


def _solar_month_start(day: date) -> date:
    n = (day - date(1970, 1, 1)).days
    start = lambda y: 365 * y + (8 * y + 21) // 33 - 492633  # noqa: E731  as in functions.calendar
    year = (n + 492633) * 33 // (365 * 33 + 8)
    year += (start(year + 1) <= n) - (start(year) > n)
    at = n - start(year)
    return day - timedelta(days=at % 31 if at < 186 else (at - 186) % 30)


# Benchmark ------------------------------------------------------------------


def benchmark(daily: DataFrame, horizons: tuple[int, ...] = (1, 2, 3), algorithms: tuple[str, ...] = ("ridge",), normalize: bool = True, settings: cluster.ClusterSettings = cluster.ClusterSettings(), test_share: float = 0.2, fast: bool = True, arm: str = "default") -> DataFrame:
    """A row a horizon, algorithm and mode (naive, global, cluster) with its errors on the test part.

    The panel is stored once.  Linear models of all horizons and clusters come from one pass over the
    training part, their forecasts and errors from one over the test part; trees are fitted one by one.
    """
    rows = settled(feats.panel(daily, horizons, normalize), "panel")
    cut = feats.cutoff(rows.where("usable"), test_share)
    day = cut.first()
    if day is None:
        raise ValueError("too little data: no day has all features and targets")
    fit_ = cluster.fit(daily.where(F.col("day") <= F.lit(day["cutoff"])), settings)
    frame = fit_.label(feats.parted(feats.horizon_frames(rows, horizons), cut))
    inputs = feats.panel_inputs(frame)
    train, test = frame.where("part = 'train'"), frame.where("part = 'test'")
    unit = lambda made: F.greatest(made * F.col("scale"), F.lit(0.0))
    results = [_errors(test, {("naive", "Naive(t-7)"): F.col("naive")})]
    for algorithm in algorithms:
        kind = models.estimator(algorithm, inputs, "target_ratio", fast=fast)
        if isinstance(kind, models.LinearEstimator):
            results.append(_errors(test, {k: unit(c) for k, c in _linear_runs(train, kind, horizons, fit_, algorithm).items()}))
            continue
        for h in horizons:
            known, asked = settled(train.where(F.col("horizon") == h), "train"), test.where(F.col("horizon") == h)
            build = lambda a=algorithm, k=known: models.estimator(a, inputs, "target_ratio", k, fast=fast)
            results.append(_errors(build().fit(known).transform(asked), {("global", algorithm): unit(F.col("prediction"))}))
            if fit_.labels is not None:
                made = cluster.train_bundle(known.drop("cluster"), fit_, build, inputs=inputs).predict(asked.drop("cluster"))
                results.append(_errors(made, {("cluster", algorithm): unit(F.col("prediction"))}))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.select(F.lit(arm).alias("arm"), "*")


def _linear_runs(train: DataFrame, kind: models.LinearEstimator, horizons: tuple[int, ...], fit_: cluster.ClusterFit, algorithm: str) -> dict[tuple[str, str], Column]:
    """Forecasts by the model of all devices and by that of a row's cluster, as columns; one pass for all of them."""
    found = kind.fit_groups(train, F.concat_ws("|", "horizon", "cluster"))
    whole, own = F.lit(None).cast("double"), F.lit(None).cast("double")
    for h in horizons:
        parts = {key.split("|")[1]: m for key, m in found.items() if key.split("|")[0] == str(h)}
        bundle, at = cluster.linear_bundle(fit_, kind, parts), F.col("horizon") == h
        whole = F.when(at, bundle.fallback.column()).otherwise(whole)
        own = F.when(at, bundle.fallback.column()).otherwise(own)
        for c, m in bundle.models.items():
            own = F.when(at & (F.col("cluster") == c), m.column()).otherwise(own)
    return {("global", algorithm): whole} | ({("cluster", algorithm): own} if fit_.labels is not None else {})


def _errors(test: DataFrame, made: dict[tuple[str, str], Column]) -> DataFrame:
    """horizon, mode, algorithm and errors of each forecast (a column by mode and algorithm); one pass."""
    each = F.array(*[F.struct(F.lit(mode).alias("mode"), F.lit(algorithm).alias("algorithm"), c.alias("p")) for (mode, algorithm), c in made.items()])
    return evaluate.measure(test.select("horizon", "target", F.inline(each)), "target", "p", "horizon", "mode", "algorithm")


def two_arms(readings: DataFrame, train_share: float = 0.8, window_days: int = segment.WINDOW_DAYS, **kw) -> DataFrame:
    """``benchmark`` of daily totals by frozen Jenks cuts and by adaptive ones, over the device-days that both have."""
    frozen = settled(segment.jenks_daily(readings, train_share), "arm-jenks")
    moving = settled(segment.adaptive_daily(readings, window_days), "arm-adaptive")
    frozen = frozen.join(moving.select("device_id", "day"), ["device_id", "day"], "left_semi")
    return benchmark(frozen, arm="jenks", **kw).unionByName(benchmark(moving, arm="adaptive", **kw))
