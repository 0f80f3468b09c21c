"""Schemas of the tables that the library works on, and checks against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOURS = range(24)
SEGMENTS = range(4)
SEG = [f"seg{k}" for k in SEGMENTS]

METER = "id long, device_id long, power_W double, created_at timestamp, segment_id tinyint, is_peak_hour boolean"
READINGS = "device_id long, ts timestamp, kwh double"
DAILY = "device_id long, day date, " + ", ".join(f"{s} double" for s in SEG) + ", " + ", ".join(f"{s}_start int, {s}_hours int" for s in SEG)
HALF_HOURS = "household string, tariff string, stamp string, kwh string"
SENSOR = "current_A double, voltage_V double, power_W double, apparent_power_VA double, power_factor double"
RESULTS = {
    "nightly_predictions": "device_id long, prediction_today string, prediction_tomorrow string, prediction_day_after_tomorrow string, model_version string, generated_at timestamp",
    "daily_actuals": "device_id long, actual_date date, actual_seg0 double, actual_seg1 double, actual_seg2 double, actual_seg3 double, peak_hour int, peak_value double, peak_segment int, computed_at timestamp",
    "weekly_predictions": "device_id long, week_start date, week_end date, predicted_consumption_kwh double, model_version string, generated_at timestamp",
    "monthly_predictions": "device_id long, month_start date, month_end date, predicted_consumption_kwh double, model_version string, generated_at timestamp",
}


class SchemaError(ValueError):
    """A table lacks a column, or holds what its columns must not."""


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, if it has all ``columns``."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    return df


def violations(df: DataFrame, **rules) -> DataFrame:
    """One row with the number of rows that break each rule (a condition that must not hold)."""
    return df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])


def check(df: DataFrame, **rules) -> DataFrame:
    """``df``, if no row breaks a rule; one pass over it."""
    found = {k: v for k, v in violations(df, **rules).first().asDict().items() if v}
    if found:
        raise SchemaError(f"rows that break rules: {found}")
    return df


def check_daily(daily: DataFrame) -> DataFrame:
    """Segment totals neither null nor negative, one row a device and day, hours that make up a day."""
    require(daily, ["device_id", "day", *SEG])
    rules = {"no_day": F.col("day").isNull(), "no_device": F.col("device_id").isNull()}
    rules |= {f"bad_{s}": F.col(s).isNull() | (F.col(s) < 0) | F.isnan(s) | (F.col(s) == float("inf")) for s in SEG}
    if f"{SEG[0]}_start" in daily.columns:
        rules |= {f"bad_{s}_time": ~F.col(f"{s}_start").between(0, 23) | ~F.col(f"{s}_hours").between(1, 24) for s in SEG}
    check(daily, **rules)
    if not daily.groupBy("device_id", "day").count().where("count > 1").isEmpty():
        raise SchemaError("a device has two rows of one day")
    return daily


def no_leakage(columns: list[str], targets: list[str]) -> None:
    """Features must not hold other targets than those named."""
    stray = [c for c in columns if c.startswith("target_seg") and c not in targets]
    if stray:
        raise SchemaError(f"targets among the features: {stray}")
