"""The recursive forecast by a state a device: folded once over its history, then advanced a day at a time.

A state holds what the features of a device's latest day need: the last 31 days'
totals, the last seven days' densities, the latest segment times, and count, mean and
centred squares of all days before the latest.  A day on, these change by one
value each, so a step costs a row a device, however long the history is.

Steps run on batches of states as arrays: as column expressions the inputs of
one step alone take longer to plan than to compute.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ampflow.functions.numeric import ratio, total
from ampflow.operators.features import HISTORY, LAGS, ROLLS
from ampflow.schema import SEG

#: Days whose totals and densities a state holds.
DAYS, RECENT = max(*LAGS, *ROLLS) + 1, 7
ALL = [*SEG, "all"]
TIMES = [f"{s}_{t}" for s in SEG for t in ("start", "hours")]


def fold(daily: DataFrame, order: str = "day") -> DataFrame:
    """A row a device with days: its state as of its last day.  One shuffle by device."""
    rows = daily.withColumn("all", total([F.col(s) for s in SEG])).withColumn("_n", F.row_number().over(Window.partitionBy("device_id").orderBy(F.desc(order))))
    before = lambda c: F.when(F.col("_n") > 1, F.col(c))
    last = F.when(F.col("_n") <= DAYS, F.struct((-F.col("_n")).alias("at"), *SEG, *[ratio(F.col(s), F.col(f"{s}_hours")).alias(f"{s}_density") for s in SEG]))
    aggs = [F.max(order).alias("day"), (F.count("*") - 1).alias("n"), F.sort_array(F.collect_list(last)).alias("_last")]
    aggs += [F.coalesce(F.avg(before(c)), F.lit(0.0)).alias(f"{c}_mean") for c in ALL] + [F.coalesce(F.var_pop(before(c)) * F.count(before(c)), F.lit(0.0)).alias(f"{c}_squares") for c in ALL]
    aggs += [F.max(F.when(F.col("_n") == 1, F.col(c))).alias(c) for c in TIMES]
    out = rows.groupBy("device_id").agg(*aggs)
    held = {f"{s}_days": F.col("_last")[s] for s in SEG}
    held |= {f"{s}_densities": _newest(F.col("_last")[f"{s}_density"], RECENT) for s in SEG}
    return out.withColumns(held).drop("_last")


def _newest(values: Column, k: int) -> Column:
    """The last ``k`` of an array, or all of them."""
    return F.slice(values, F.greatest(F.size(values) - k + 1, F.lit(1)), F.lit(k))


class State:
    """The states of a batch of devices, as arrays of devices by segments (by days, the latest last)."""

    def __init__(self, batch: pa.RecordBatch):
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        number = lambda name: column(name).to_numpy(zero_copy_only=False).astype(float)
        self.device, self.day = column("device_id"), column("day").to_numpy(zero_copy_only=False).astype("datetime64[D]")
        self.n = number("n")
        self.mean, self.squares = (np.column_stack([number(f"{c}_{x}") for c in ALL]) for x in ("mean", "squares"))
        self.start, self.hours = (np.column_stack([number(f"{s}_{t}") for s in SEG]) for t in ("start", "hours"))
        self.days = np.stack([_aligned(column(f"{s}_days"), DAYS) for s in SEG], 1)
        self.densities = np.stack([_aligned(column(f"{s}_densities"), RECENT) for s in SEG], 1)

    def take(self, rows: np.ndarray) -> None:
        self.device = self.device.take(pa.array(np.flatnonzero(rows)))
        for name in ("day", "n", "mean", "squares", "start", "hours", "days", "densities"):
            setattr(self, name, getattr(self, name)[rows])

    def inputs(self, start: np.ndarray, hours: np.ndarray, least: int = HISTORY) -> dict[str, np.ndarray]:
        """The model's inputs of the latest day, by the names of ``features.build``; NaN where that has null.  ``start`` and ``hours`` are the next day's."""
        now, known = self.days[:, :, -1], self.n[:, None] >= least
        lag = lambda k: self.days[:, :, -1 - k]
        mean = np.where(known, self.mean, np.nan)
        std = np.where(known, np.sqrt(np.maximum(self.squares, 0) / np.maximum(self.n, 1)[:, None]), np.nan)
        whole, density, recent = mean[:, :4].sum(1), _ratio(now, self.hours), self.densities.mean(2)
        by_segment = {"": now, "_start": self.start, "_hours": self.hours} | {f"_lag{k}": lag(k) for k in LAGS}
        for k in ROLLS:
            past = self.days[:, :, -1 - k : -1]
            by_segment |= {f"_mean{k}": past.mean(2), f"_std{k}": past.std(2, ddof=1)}
        by_segment |= {f"_trend{k}": now - lag(k) for k in (1, 7)}
        by_segment |= {"_past_mean": mean[:, :4], "_past_std": std[:, :4], "_to_past": _ratio(now, mean[:, :4]), "_past_share": _ratio(mean[:, :4], whole[:, None])}
        by_segment |= {"_next_start": start, "_next_hours": hours, "_start_shift": start - self.start, "_hours_shift": hours - self.hours}
        by_segment |= {"_density": density, f"_density{RECENT}": recent, "_expected": density * hours, f"_expected{RECENT}": recent * hours}
        out = {f"{s}{name}": x[:, k] for name, x in by_segment.items() for k, s in enumerate(SEG)}
        return out | {"past_total": whole, "past_total_std": std[:, 4], "past_cv": _ratio(std[:, 4], whole)} | _calendar(self.day)

    def advance(self, values: np.ndarray, start: np.ndarray, hours: np.ndarray) -> None:
        """A day on: that day's totals by segment, and its segment times."""
        now = self.days[:, :, -1]
        now = np.column_stack([now, now.sum(1)])
        self.n = self.n + 1
        off = now - self.mean
        self.mean = self.mean + off / self.n[:, None]
        self.squares = self.squares + off * (now - self.mean)
        self.days = np.concatenate([self.days[:, :, 1:], values[:, :, None]], 2)
        self.densities = np.concatenate([self.densities[:, :, 1:], _ratio(values, hours)[:, :, None]], 2)
        self.start, self.hours, self.day = start, hours, self.day + 1

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        """The states as rows again."""
        held = {"device_id": self.device, "day": pa.array(self.day), "n": pa.array(self.n.astype(np.int64))}
        held |= {f"{c}_{x}": pa.array(getattr(self, x)[:, k]) for k, c in enumerate(ALL) for x in ("mean", "squares")}
        held |= {f"{s}_{t}": pa.array(getattr(self, t)[:, k].astype(np.int32)) for k, s in enumerate(SEG) for t in ("start", "hours")}
        for name, x in (("days", self.days), ("densities", self.densities)):
            for k, s in enumerate(SEG):  # leading days that are not there go
                held[f"{s}_{name}"] = pa.array([row[np.argmax(~np.isnan(row)) :] if not np.isnan(row).all() else row[:0] for row in x[:, k]], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([held[f.name].cast(f.type) for f in schema], schema=schema)


def _aligned(lists: pa.ListArray, size: int) -> np.ndarray:
    """Rows of ``size`` numbers that end as the lists do; NaN before they begin."""
    n, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.full((len(n), size), np.nan)
    row = np.repeat(np.arange(len(n)), n)
    out[row, size - n[row] + np.arange(len(flat)) - (np.cumsum(n) - n)[row]] = flat
    return out


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(np.broadcast_shapes(a.shape, b.shape), np.nan), where=b != 0)


def _calendar(day: np.ndarray) -> dict[str, np.ndarray]:
    """``functions.calendar.target_day_columns``."""

    def of(d: pd.DatetimeIndex) -> dict[str, np.ndarray]:
        return {"day_of_week": d.dayofweek, "is_weekend": (d.dayofweek >= 5), "month": d.month, "quarter": d.quarter, "week_of_year": d.isocalendar().week}

    here, there = (of(pd.DatetimeIndex(day.astype("datetime64[ns]") + np.timedelta64(k, "D"))) for k in (0, 1))
    out = here | {f"target_{k}": v for k, v in there.items()} | {"day_of_month": pd.DatetimeIndex(day.astype("datetime64[ns]")).day}
    out |= {"weekend_changes": np.asarray(here["is_weekend"]) != np.asarray(there["is_weekend"]), "month_changes": np.asarray(here["month"]) != np.asarray(there["month"])}
    return {k: np.asarray(v, float) for k, v in out.items()}


def _following(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The next day's segment times: columns next_seg0_start, ..."""
    at = lambda t: np.column_stack([batch.column(batch.schema.get_field_index(f"next_{s}_{t}")).to_numpy(zero_copy_only=False).astype(float) for s in SEG])
    return at("start"), at("hours")


def inputs(state: DataFrame, names: list[str], least: int = HISTORY) -> DataFrame:
    """``state`` (with next_seg0_start, ...) and the named inputs of its latest day; devices that lack one go."""
    kept = state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = State(batch).inputs(*_following(batch), least)
            fine = np.isfinite(np.column_stack([x[c] for c in names])).all(1)
            columns = [*batch.filter(pa.array(fine)).columns, *[pa.array(x[c][fine]) for c in names]]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *names])

    clashing = [c for c in names if c in kept]  # today's times are inputs as well as state
    state = state.withColumnsRenamed({c: f"_{c}" for c in clashing})
    kept = [f"_{c}" if c in clashing else c for c in kept]
    back = {f"_{c}": c for c in clashing}

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(b.rename_columns([back.get(c, c) for c in b.schema.names]) for b in batches)

    kind = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema] + [f"`{c}` double" for c in names])
    return state.mapInArrow(named, kind)


def stepped(state: DataFrame, weights: np.ndarray, names: list[str], steps: int, least: int = HISTORY) -> DataFrame:
    """device_id, step, day, seg0 .. seg3 of the next ``steps`` days by linear models: a row of ``weights`` a segment, the intercept first.

    All steps of a device in one go, no plan of its own for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state, (start, hours) = State(batch), _following(batch)
            for step in range(1, steps + 1):
                found = state.inputs(start, hours, least)
                x = np.column_stack([found[c] for c in names])
                fine = np.isfinite(x).all(1)
                state.take(fine)
                start, hours = start[fine], hours[fine]
                made = np.maximum(x[fine] @ weights[:, 1:].T + weights[:, 0], 0.0)
                state.advance(made, start, hours)
                columns = [state.device, pa.array(np.full(len(made), step, np.int32)), pa.array(state.day), *[pa.array(made[:, k]) for k in range(len(SEG))]]
                yield pa.RecordBatch.from_arrays(columns, ["device_id", "step", "day", *SEG])

    return state.mapInArrow(run, f"device_id {state.schema['device_id'].dataType.simpleString()}, step int, day date, " + ", ".join(f"{s} double" for s in SEG))


def advanced(made: DataFrame, columns: list[str]) -> DataFrame:
    """The states (``columns``) of ``made``, a day on: its pred_seg0, ... are that day's totals, next_seg0_start, ... its times."""
    held = [c for c in columns if not c.startswith("next_")]
    schema = made.select(held).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state = State(batch)
            state.advance(np.column_stack([batch.column(batch.schema.get_field_index(f"pred_{s}")).to_numpy() for s in SEG]), *_following(batch))
            own = state.batch(pa.schema([batch.schema.field(c) for c in held]))
            more = [c for c in batch.schema.names if c.startswith("next_")]
            yield pa.RecordBatch.from_arrays([*own.columns, *[batch.column(batch.schema.get_field_index(c)) for c in more]], [*held, *more])

    after = [f for f in made.schema if f.name.startswith("next_")]
    return made.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*schema, *after]))
