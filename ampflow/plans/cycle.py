"""What runs when: jobs over the result tables, the learning cycle with its store, a cycle with its state."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampflow.operators import evaluate, models
from ampflow.operators import features as feats
from ampflow.plans import jobs, rebuild
from ampflow.schema import SEG, SchemaError, check
from ampflow.sources.sinks import ModelStore, create_tables, read_text, settled, write_results, write_text

# Jobs over the result tables -------------------------------------------------


def write_actuals(readings: DataFrame, as_of: Column, database: str = "default", horizon: int = jobs.BACKFILL, **kw) -> None:
    """Actuals of the days that have none yet, put into ``daily_actuals``."""
    spark = readings.sparkSession
    create_tables(spark, database)
    days = jobs.days_to_fill(readings, spark.table(f"{database}.daily_actuals"), as_of, horizon)
    rows = jobs.daily_actuals(readings, days, **kw)
    columns = [c for c in spark.table(f"{database}.daily_actuals").columns]
    write_results(rows.withColumnRenamed("day", "actual_date").withColumn("computed_at", F.current_timestamp()).select(columns), "daily_actuals", database)


def write_nightly(readings: DataFrame, model: models.SegmentModel, database: str = "default", **kw) -> dict[str, int]:
    """All devices' three-day forecasts, in place of those of the night before, or nothing: a result that lacks a device is not put in.

    Gives how many devices have a forecast, and how many none for which reason.
    """
    rows = settled(jobs.nightly(readings, model, **kw), "nightly")
    expected = readings.where("device_id is not null").select("device_id").distinct().count()
    write_results(rows, "nightly_predictions", database, replace=True, expected=expected)
    return _reasons(rows)


def write_weekly(daily: DataFrame, model, as_of: Column, database: str = "default", version: str = "") -> dict[str, int]:
    """All devices' forecasts of the first whole week, null where there is none; gives how many, by reason."""
    rows = settled(jobs.weekly_forecast(daily, model, as_of, version), "weekly")
    write_results(rows, "weekly_predictions", database)
    return _reasons(rows)


def write_monthly(daily: DataFrame, model, as_of: Column, database: str = "default", version: str = "", solar: bool = True) -> dict[str, int]:
    """As ``write_weekly``, of the first whole month."""
    rows = settled(jobs.monthly_forecast(daily, model, as_of, solar, version), "monthly")
    write_results(rows, "monthly_predictions", database)
    return _reasons(rows)


def _reasons(rows: DataFrame) -> dict[str, int]:
    return {r.reason: r["count"] for r in rows.groupBy(F.coalesce("reason", F.lit("forecast")).alias("reason")).count().collect()}


# Learning ---------------------------------------------------------------------


def learn(trainers: dict[str, Callable[[], tuple[object, dict]]], stores: dict[str, ModelStore], promote: bool = False, report: str | None = None, refresh: Callable[[], object] | None = None) -> dict[str, dict]:
    """The learning cycle with its stores: every trained model becomes a candidate, and is promoted if it may be and ``promote`` says so.

    What is in production is known by the metrics of its metadata.  The report,
    if a path is given, has all but the models.  ``refresh`` (``rebuild.rebuild``, say) brings the
    data up to date first; if it fails nothing is trained, and all horizons failed for its reason.
    """
    try:
        if refresh:
            refresh()
    except Exception as e:  # noqa: BLE001  old data must not be learned from as if it were new
        out = {name: {"status": jobs.Status.FAILED, "reason": f"refresh: {str(e)[:500]}"} for name in trainers}
        if report:
            rebuild.write_report(next(iter(stores.values())).spark, report, {k: v | {"status": v["status"].value} for k, v in out.items()})
        return out
    current = {}
    for name, store in stores.items():
        now = store.production()
        current[name] = (store.metadata(now["version"]) or {}).get("metrics") if now else None
    out = jobs.learning_cycle(trainers, current)
    for name, got in out.items():
        if "model" not in got:
            continue
        model, store = got.pop("model"), stores[name]
        got["version"] = store.store_candidate(model, {"metrics": got["metrics"], "status": got["status"].value, "reason": got["reason"]})
        got["production"] = got["status"] is jobs.Status.PROMOTED and promote
        if got["production"]:
            store.promote(got["version"], model)
    if report:
        rebuild.write_report(next(iter(stores.values())).spark, report, {k: v | {"status": v["status"].value} for k, v in out.items()})
    return out


def train_single(features: DataFrame, algorithm: str = "ridge", path: str | None = None, **params) -> tuple[models.SegmentModel, dict]:
    """One model of all devices: metrics of a fit on the first 70 % on each part, then a fit on train and valid, saved if ``path`` is given."""
    parts = feats.split(features)
    first = models.SegmentModel(algorithm, **params).fit(parts.where("part = 'train'").drop("part"))
    pairs = {s: (f"target_{s}", f"pred_{s}") for s in SEG}
    scores = {}
    for part in ("train", "valid", "test"):
        made = first.predict(parts.where(F.col("part") == part).drop("part"))
        scores[part] = {r.target: r.asDict() for r in evaluate.by_target(made, pairs).collect()}
    model = models.SegmentModel(algorithm, **params).fit(parts.where("part <> 'test'").drop("part"))
    if path:
        model.save(path)
    return model, scores


def trainer(config: jobs.HorizonConfig, daily: DataFrame, fit_, solar: bool = True) -> Callable[[], tuple[object, dict]]:
    """The trainer of a horizon by its name: 3day, weekly or monthly."""
    if config.horizon == "3day":
        return lambda: jobs.train_three_day(settled(feats.build(daily), "features"), config)
    if config.horizon == "weekly":
        return lambda: jobs.train_period(settled(feats.weekly(daily), "weeks"), config, fit_)
    if config.horizon == "monthly":
        return lambda: jobs.train_period(settled(feats.monthly(daily, solar=solar), "months"), config, fit_)
    raise ValueError(f"no horizon {config.horizon}")


def validate(features: DataFrame, algorithm: str = "ridge", report: str | None = None, **params) -> dict:
    """Walk-forward validation of a feature table, checked first; the summary, with windows, goes to ``report``."""
    inputs = feats.feature_columns(features.columns)
    check_inputs(features, [*inputs, *feats.TARGETS])
    pairs = {s: (f"target_{s}", f"pred_{s}") for s in SEG}
    if algorithm in models.LINEAR:
        windows = evaluate.linear_walk_forward(features, inputs, pairs, models.alpha_of(algorithm, **params))
    else:
        windows = evaluate.walk_forward(features, lambda train, test: models.SegmentModel(algorithm, **params).fit(train).predict(test), pairs)
    out = evaluate.summary(windows) | {"by_window": windows}
    if report:
        rebuild.write_report(features.sparkSession, report, out)
    return out


def check_inputs(frame: DataFrame, columns: list[str]) -> DataFrame:
    """``frame``, if it has the columns and no value of them is missing, NaN or infinite."""
    missing = sorted(set(columns) - set(frame.columns))
    if missing:
        raise SchemaError(f"missing inputs: {missing}")
    bad = F.lit(False)
    for c in columns:
        x = F.col(c).cast("double")
        bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return check(frame, bad_input=bad)


def aligned(frame: DataFrame, columns: list[str], reference: dict[str, float]) -> DataFrame:
    """The model's inputs in its order: columns that ``frame`` lacks come from a reference row; what is then missing or infinite is an error."""
    unknown = sorted(set(columns) - set(frame.columns) - set(reference))
    if unknown:
        raise SchemaError(f"missing inputs: {unknown}")
    rest = [c for c in frame.columns if c not in columns]
    return check_inputs(frame.select(*rest, *[F.col(c) if c in frame.columns else F.lit(float(reference[c])).alias(c) for c in columns]), columns)


# A cycle with its state ---------------------------------------------------------


def load_state(spark: SparkSession, path: str) -> jobs.State:
    """What ran last; a state that is not there or cannot be read is that of a first run."""
    text = read_text(spark, path)
    try:
        return jobs.State(**{k: date.fromisoformat(v) if v else None for k, v in json.loads(text or "{}").items()})
    except (TypeError, ValueError):
        return jobs.State()


def save_state(spark: SparkSession, path: str, state: jobs.State) -> None:
    write_text(spark, path, json.dumps({k: v and v.isoformat() for k, v in asdict(state).items()}))


#: Jobs in the order that they run in, and the state's field that a run of them sets.
ORDER = {"cycle": "cycle", "actuals": None, "nightly": None, "weekly": "week", "monthly": "month"}


def run_cycle(spark: SparkSession, path: str, work: dict[str, Callable[[], object]], today: date, cycle_days: int = 30) -> dict[str, str]:
    """Run what is due today, in order, each for itself; what worked is noted in the state at ``path``.  Gives a word on each job."""
    state = load_state(spark, path)
    due, out = jobs.due(state, today, cycle_days), {}
    for name, mark in ORDER.items():
        if name not in work or not due[name]:
            out[name] = "not_due" if name in work else "no_job"
            continue
        try:
            work[name]()
        except Exception as e:  # noqa: BLE001  one job's failure does not stop the others
            out[name] = f"failed: {str(e)[:200]}"
            continue
        out[name] = "done"
        if mark:
            setattr(state, mark, today)
            save_state(spark, path, state)
    return out
