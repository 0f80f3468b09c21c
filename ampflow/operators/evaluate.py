"""Forecast errors, bootstrap intervals, walk-forward windows, promotion gates."""

from __future__ import annotations

from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ampflow.operators import linear
from ampflow.sources.sinks import settled

TINY = 1e-8


def _sse(y: Column, p: Column) -> Column:
    return F.sum((p - y) * (p - y))


def _r2(y: Column, p: Column, flat: float | None = 0.0) -> Column:
    sst = F.var_pop(y) * F.count(y)
    return F.when(sst > 1e-12, 1 - _sse(y, p) / F.when(sst > 1e-12, sst)).otherwise(F.lit(flat))


def share_metrics(y: Column, p: Column) -> dict[str, Column]:
    """WAPE, MAE, RMSE, R2, MAPE, sMAPE and bias, in per cent where they are shares."""
    e, size = p - y, F.sum(F.abs(y))
    some = F.when(size > 0, size)
    both = F.abs(y) + F.abs(p)
    return {
        "wape": F.sum(F.abs(e)) / some * 100,
        "mae": F.avg(F.abs(e)),
        "rmse": F.sqrt(F.avg(e * e)),
        "r2": _r2(y, p, None),
        "mape": F.avg(F.abs(e) / F.when(F.abs(y) > TINY, F.abs(y))) * 100,
        "smape": F.avg(F.when(both > 0, 2 * F.abs(e) / F.when(both > 0, both)).when(both == 0, 0.0)) * 100,
        "bias": F.sum(e) / F.when(F.sum(y) != 0, F.sum(y)) * 100,
        "n": F.count(e),
    }


def angle_metrics(y: Column, p: Column) -> dict[str, Column]:
    """MAE, RMSE, MAPE (zeros left out), MAAPE in degrees, R2."""
    e = F.abs(p - y)
    return {
        "mae": F.avg(e),
        "rmse": F.sqrt(F.avg(e * e)),
        "mape": F.avg(e / F.when(F.abs(y) > TINY, F.abs(y))) * 100,
        "maape": F.degrees(F.avg(F.atan(e / (F.abs(y) + TINY)))),
        "r2": _r2(y, p),
    }


def measure(frame: DataFrame, y: str, p: str, *by: str, metrics=share_metrics) -> DataFrame:
    """One aggregate over ``frame``, by the columns ``by``; ``metrics`` gives its columns."""
    columns = [c.alias(n) for n, c in metrics(F.col(y), F.col(p)).items()]
    return frame.groupBy(*by).agg(*columns) if by else frame.agg(*columns)


def by_target(frame: DataFrame, pairs: dict[str, tuple[str, str]], metrics=angle_metrics, by: tuple[str, ...] = ()) -> DataFrame:
    """Metrics of each (truth, forecast) pair by name, and of all together as ``overall``, by the columns ``by`` too; one pass, by unpivot."""
    rows = F.array(*[F.struct(F.lit(n).alias("target"), F.col(y).alias("y"), F.col(p).alias("p")) for n, (y, p) in pairs.items()])
    long = frame.select(*by, F.inline(rows))
    both = long.select(*by, F.explode(F.array("target", F.lit("overall"))).alias("target"), "y", "p")
    return measure(both, "y", "p", *by, "target", metrics=metrics)


#: Devices of a block, about, among which draws are dealt out one by one.
BLOCK = 1000


def draws(sizes: list[tuple[int, int]], reps: int, seed: int) -> dict[int, np.ndarray]:
    """How many of n draws with replacement fall to each block, in each repetition, n being the sum of ``sizes`` (block, devices).

    Multinomial by splitting: each block takes a binomial share of what is left.
    """
    out, n = {}, sum(size for _, size in sizes)
    left, rest, rng = np.full(reps, n), n, np.random.default_rng(seed)
    for block, size in sorted(sizes):
        out[block] = rng.binomial(left, min(1.0, size / rest))
        left, rest = left - out[block], rest - size
    return out


def weights(devices: DataFrame, reps: int = 500, seed: int = 42, device: str = "device_id", values: tuple[str, ...] = ()) -> DataFrame:
    """block, device, ``values`` and w: an array of how often the device is drawn in each repetition.

    In every repetition the weights of all n devices sum to n, exactly.  Draws are split among blocks of
    about ``BLOCK`` devices on the driver (a row a block), then within each block by its task.
    A rerun gives the same: blocks follow from a hash of the device, and are numbered and seeded.
    """
    count = devices.count()
    rows = devices.select(F.pmod(F.xxhash64(F.col(device).cast("string")), F.lit(max(1, count // BLOCK))).alias("block"), F.col(device).cast("string").alias("device"), *values)
    dealt = draws([(r.block, r["count"]) for r in rows.groupBy("block").count().collect()], reps, seed)
    named = devices.sparkSession.createDataFrame([(b, w.tolist()) for b, w in dealt.items()], "block long, _dealt array<long>") if dealt else None
    kind = T.StructType([*rows.schema.fields, T.StructField("w", T.ArrayType(T.LongType()))])
    if named is None:
        return devices.sparkSession.createDataFrame([], kind)

    def deal(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("device", ignore_index=True)
        rng = np.random.default_rng([seed, int(own["block"][0])])
        w = rng.multinomial(np.asarray(own["_dealt"][0]), np.full(len(own), 1 / len(own)))
        return own.drop(columns="_dealt").assign(w=list(w.T))

    return rows.join(named, "block").groupBy("block").applyInPandas(deal, kind)


def bootstrap_gain(frame: DataFrame, y: str, a: str, b: str, reps: int = 500, seed: int = 42, device: str = "device_id") -> DataFrame:
    """gain, low, high: how much less WAPE forecast ``b`` has than ``a``, in per cent, with a 95 % interval.

    Devices are drawn with replacement, as many as there are in every repetition; see ``weights``.
    """
    sums = settled(frame.groupBy(device).agg(F.sum(F.abs(F.col(a) - F.col(y))).alias("ea"), F.sum(F.abs(F.col(b) - F.col(y))).alias("eb")), "bootstrap")
    share = lambda p, q: (F.col(p) - F.col(q)) / F.when(F.col(p) > 0, F.col(p)) * 100
    drawn = weights(sums, reps, seed, device, ("ea", "eb")).select("ea", "eb", F.posexplode("w").alias("rep", "w"))
    gains = drawn.groupBy("rep").agg(F.sum(F.col("w") * F.col("ea")).alias("ea"), F.sum(F.col("w") * F.col("eb")).alias("eb")).withColumn("g", share("ea", "eb"))
    interval = gains.agg(F.percentile("g", 0.025).alias("low"), F.percentile("g", 0.975).alias("high"))  # a row a repetition
    point = sums.agg(F.sum("ea").alias("ea"), F.sum("eb").alias("eb")).select(share("ea", "eb").alias("gain"))
    return point.crossJoin(F.broadcast(interval))  # a row each


def pair_tests(frame: DataFrame, y: str, pairs: list[tuple[str, str]], reps: int = 500, seed: int = 42) -> DataFrame:
    """``bootstrap_gain`` of each pair of forecast columns, and whether its interval leaves out zero."""
    out = None
    for a, b in pairs:
        row = bootstrap_gain(frame, y, a, b, reps, seed).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "*")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def mean_baseline(train: DataFrame, test: DataFrame, columns: list[str], metrics=angle_metrics) -> DataFrame:
    """Metrics of forecasting every test row by the training means."""
    means = train.agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    return by_target(test.crossJoin(F.broadcast(means)), {c: (c, f"_{c}") for c in columns}, metrics)  # one row


def month_windows(frame: DataFrame, day: str = "day", least: int = 2) -> DataFrame:
    """Walk-forward windows: a row a test month that has ``least`` months before it."""
    months = frame.select(F.trunc(day, "month").alias("test_month")).distinct()
    w = Window.orderBy("test_month")  # months only
    rows = months.withColumn("train_months", F.row_number().over(w) - 1).withColumn("train_from", F.first("test_month").over(w))
    return rows.where(F.col("train_months") >= least)


def walk_forward(frame: DataFrame, predict, columns: dict[str, tuple[str, str]], day: str = "day", least: int = 2) -> list[dict]:
    """Metrics of each window; ``predict(train, test)`` gives the test rows with forecasts.

    The windows, a row a month, come to the driver; rows do not.
    """
    out = []
    for w in month_windows(frame, day, least).orderBy("test_month").collect():
        month = F.trunc(day, "month")
        train, test = frame.where(month < w.test_month), frame.where(month == w.test_month)
        scores = {r.target: r.asDict() for r in by_target(predict(train, test), columns).collect()}
        base = {r.target: r.asDict() for r in mean_baseline(train, test, [y for y, _ in columns.values()]).collect()}
        out.append(window(w.test_month, w.train_months, scores, base["overall"]))
    return out


def window(test_month, train_months: int, scores: dict[str, dict], base: dict) -> dict:
    """A window's result: passed if all explain something, and the error is less than that of the training means."""
    r2 = {k: v["r2"] for k, v in scores.items()}
    passed = r2["overall"] > 0 and all(x >= 0 for k, x in r2.items() if k != "overall") and scores["overall"]["mae"] < base["mae"]
    return {"test_month": test_month, "train_months": train_months, "passed": passed, "metrics": scores, "baseline": base}


def linear_walk_forward(frame: DataFrame, inputs: list[str], columns: dict[str, tuple[str, str]], alpha: float, day: str = "day", least: int = 2) -> list[dict]:
    """``walk_forward`` of ridge models in three passes, however many windows: moments by month, which add up to
    those of all months before; forecasts and errors of all windows; errors of the training means.
    """
    month, truths = F.trunc(day, "month"), [y for y, _ in columns.values()]
    found = linear.moments(frame, [*inputs, *truths], month)
    months, before, models, means = sorted(found), None, {}, {}
    for k, name in enumerate(months):
        if k >= least:
            models[name] = {y: linear.solve(before, inputs, y, alpha) for y in truths}
            means[name] = [float(before.mean[before.columns.index(y)]) for y in truths]
        before = found[name] if before is None else before + found[name]
    if not models:
        return []
    made = linear.predicted_by(frame, models, month, "_made_").withColumn("_month", month.cast("string"))
    held = made.withColumns({p: F.greatest(F.col(f"_made_{y}"), F.lit(0.0)) for y, p in columns.values()})
    scores = _by_month(by_target(held, columns, by=("_month",)))
    rows = frame.sparkSession.createDataFrame([(name, *m) for name, m in means.items()], "_month string, " + ", ".join(f"_base_{y} double" for y in truths))
    plain = frame.withColumn("_month", month.cast("string")).join(F.broadcast(rows), "_month")  # a row a month
    base = _by_month(by_target(plain, {name: (y, f"_base_{y}") for name, (y, _) in columns.items()}, by=("_month",)))
    return [window(date.fromisoformat(name), months.index(name), scores[name], base[name]["overall"]) for name in models]


def _by_month(errors: DataFrame) -> dict[str, dict[str, dict]]:
    out: dict = {}
    for r in errors.collect():  # a row a month and target
        row = r.asDict()
        out.setdefault(row.pop("_month"), {})[r.target] = row
    return out


def summary(windows: list[dict]) -> dict:
    """Means and extremes over windows, and whether all passed."""
    maes = [w["metrics"]["overall"]["mae"] for w in windows]
    r2s = [w["metrics"]["overall"]["r2"] for w in windows]
    if not windows:
        return {"windows": 0, "valid": False}
    return {"windows": len(windows), "valid": all(w["passed"] for w in windows), "mean_mae": sum(maes) / len(maes), "worst_mae": max(maes), "mean_r2": sum(r2s) / len(r2s), "worst_r2": min(r2s)}


def promote(current: dict | None, candidate: dict, r2_slack: float = 0.003, mae_ratio: float = 1.05, rmse_ratio: float = 1.05) -> tuple[bool, str]:
    """Whether a candidate may replace the production model, and why."""
    if current is None:
        return True, "no_production_model"
    if candidate["mae"] < current["mae"] and candidate["rmse"] < current["rmse"]:
        return True, "both_errors_improve"
    if candidate["mae"] > mae_ratio * current["mae"]:
        return False, "mae_worse"
    if candidate["rmse"] > rmse_ratio * current["rmse"]:
        return False, "rmse_worse"
    if candidate["r2"] - current["r2"] < -r2_slack:
        return False, "r2_worse"
    return True, "within_limits"


def pivoted(results: DataFrame, row: str, column: str, value: str, columns: list | None = None) -> DataFrame:
    """A report table: mean of ``value``, rows by columns, with the mean of the row."""
    wide = results.groupBy(row).pivot(column, columns).agg(F.avg(value))
    return wide.join(results.groupBy(row).agg(F.avg(value).alias("mean")), row)
