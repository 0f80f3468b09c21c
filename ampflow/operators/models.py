"""Regressors of segment totals, their forecasts, and the recursive three-day forecast."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ampflow.operators import features as feats
from ampflow.operators import linear, recursion
from ampflow.operators.linear import LinearEstimator, LinearModel
from ampflow.operators.segment import segment_columns
from ampflow.schema import SEG, SchemaError, no_leakage
from ampflow.sources.sinks import read_text, save_model, settled, write_text

#: Rows from which a forest's trees see a part of them.
LARGE = 80_000
#: Deeper levels hold hardly a row each, and cost a pass over the rows each.
DEEPEST = 20
#: Rows of a partition that trees learn from, about: each partition sends sums for all nodes of a level, however few its rows.
DEALT = 5_000
LINEAR = ("ridge", "linear")
ALGORITHMS = (*LINEAR, "random_forest", "boosted")


def estimator(algorithm: str, inputs: list[str], label: str, frame: DataFrame | None = None, *, alpha: float = 1.0, trees: int | None = None, depth: int = DEEPEST, seed: int = 42, fast: bool = False) -> Estimator | LinearEstimator:
    """What fits a model from input columns to ``prediction``; ``frame``, the training rows, tells how large a forest is.

    A forest has 200 trees on all rows; from ``LARGE`` rows on 100 trees on a quarter
    of them each, with five rows in a leaf; with ``fast`` 40 trees on all rows.
    """
    if algorithm in ("ridge", "linear"):
        return LinearEstimator(inputs, label, alpha if algorithm == "ridge" else 0.0)
    assemble = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="skip")
    if algorithm == "random_forest":
        large = frame is not None and frame.count() >= LARGE
        count = trees or (40 if fast else 100 if large else 200)
        model = RandomForestRegressor(labelCol=label, numTrees=count, maxDepth=depth, minInstancesPerNode=5 if large else 1, subsamplingRate=0.25 if large and not fast else 1.0, featureSubsetStrategy="sqrt", maxMemoryInMB=1024, cacheNodeIds=True, seed=seed)
    elif algorithm == "boosted":
        model = GBTRegressor(labelCol=label, maxIter=trees or (20 if fast else 100), maxDepth=6, stepSize=0.1, subsamplingRate=0.8, seed=seed)
    else:
        raise ValueError(f"algorithm must be one of {ALGORITHMS}")
    return Pipeline(stages=[assemble, model])


def dealt(rows: DataFrame) -> DataFrame:
    """Training rows, stored, in as many partitions as their number calls for."""
    stored = settled(rows, "training")
    return stored.coalesce(max(1, -(-stored.count() // DEALT)))


class SegmentModel:
    """A regressor for each of the four segments of the next day."""

    def __init__(self, algorithm: str = "ridge", **params):
        self.algorithm, self.params = algorithm, params
        self.inputs: list[str] = []
        self.models: dict[str, PipelineModel] = {}

    def fit(self, frame: DataFrame) -> SegmentModel:
        """Fit on ``frame``; linear models of all four come from one pass, trees from rows assembled and stored once."""
        self.inputs = feats.feature_columns(frame.columns)
        no_leakage(self.inputs, [])
        if not self.inputs or set(feats.TARGETS) - set(frame.columns):
            raise SchemaError("no inputs, or not all four targets")
        if self.algorithm in LINEAR:
            self.models = linear.fit(frame, self.inputs, feats.TARGETS, alpha_of(self.algorithm, **self.params))
            return self
        rows = frame.select(*self.inputs, *feats.TARGETS).dropna()
        if rows.isEmpty():
            raise ValueError("no rows with all inputs to train on")
        rows = dealt(rows)
        self.models = {t: estimator(self.algorithm, self.inputs, t, rows, **self.params).fit(rows) for t in feats.TARGETS}
        return self

    def predict(self, frame: DataFrame) -> DataFrame:
        """``frame`` with pred_seg0 .. pred_seg3, none below zero."""
        missing = sorted(set(self.inputs) - set(frame.columns))
        if missing:
            raise ValueError(f"missing inputs: {missing}")
        if all(isinstance(m, LinearModel) for m in self.models.values()):
            return linear.predicted(frame, {t.replace("target", "pred"): m for t, m in self.models.items()}, 0.0)
        keep = list(frame.columns)
        for t, m in self.models.items():
            name = t.replace("target", "pred")
            frame = m.transform(frame).withColumn(name, F.greatest("prediction", F.lit(0.0)))
            keep.append(name)
            frame = frame.select(keep)
        return frame

    def importance(self, target: str = "target_seg0") -> list[tuple[str, float]]:
        """Inputs by weight, largest first."""
        m = self.models[target]
        values = abs(m.scaled) if isinstance(m, LinearModel) else m.stages[-1].featureImportances
        return sorted(zip(self.inputs, map(float, values)), key=lambda p: -p[1])

    def save(self, path: str) -> None:
        for t, m in self.models.items():
            save_model(m, f"{path}/{t}")
        write_text(SparkSession.active(), f"{path}/facts", json.dumps({"algorithm": self.algorithm, "inputs": self.inputs, "params": self.params}))

    @classmethod
    def load(cls, path: str) -> SegmentModel:
        facts = json.loads(read_text(SparkSession.active(), f"{path}/facts"))
        out = cls(facts["algorithm"], **facts["params"])
        out.inputs, out.models = facts["inputs"], {t: load_model(f"{path}/{t}", facts["algorithm"]) for t in feats.TARGETS}
        return out


def load_model(path: str, algorithm: str) -> LinearModel | PipelineModel:
    """A model of ``estimator`` as ``sinks.save_model`` wrote it."""
    return LinearModel.load(SparkSession.active(), path) if algorithm in LINEAR else PipelineModel.load(path)


def alpha_of(algorithm: str, alpha: float = 1.0, **_) -> float:
    return alpha if algorithm == "ridge" else 0.0


def recursive_forecast(daily: DataFrame, cuts: DataFrame, model: SegmentModel, steps: int = 3, history: int = feats.HISTORY) -> DataFrame:
    """device_id, step, day, seg0 .. seg3 of the next ``steps`` days, each forecast from the ones before it.

    ``cuts`` (device_id, cut) are today's and stay for all steps.  History is folded
    to a state a device; a step takes its inputs from it, forecasts, and advances
    it by what it forecast.  Linear models take all steps in one pass; trees a
    pass each over stored states, a row a device.  Devices whose inputs
    are not complete have no row.
    """
    times = segment_columns(*[F.col(f"cut.b{i}") for i in (1, 2, 3)])
    state = recursion.fold(daily).join(cuts.select("device_id", "cut"), "device_id").withColumns({f"next_{n}": c for n, c in times.items()}).drop("cut")
    ms = [model.models[t] for t in feats.TARGETS]
    if all(isinstance(m, LinearModel) for m in ms):
        return recursion.stepped(state, np.array([[m.intercept, *m.weights] for m in ms]), model.inputs, steps, history)
    known, out = state.columns, None
    for step in range(1, steps + 1):
        rows = recursion.inputs(state, model.inputs, history)
        held = [f"_{c}" if c in model.inputs else c for c in known]
        made = model.predict(rows).select(*[F.col(h).alias(c) for h, c in zip(held, known)], *[f"pred_{s}" for s in SEG])
        made = settled(made, "forecast-step")
        part = made.select("device_id", F.lit(step).alias("step"), F.date_add("day", 1).alias("day"), *[F.col(f"pred_{s}").alias(s) for s in SEG])
        out = part if out is None else out.unionByName(part)
        state = recursion.advanced(made, known)
    return out


def payload(forecast: DataFrame, cuts: DataFrame) -> DataFrame:
    """device_id and the JSON of each day's forecast: date, segments with their hours, and the peak segment."""
    rows = forecast.join(cuts, "device_id")
    edges = [F.lit(0), *[F.col(f"cut.b{i}") for i in (1, 2, 3)], F.lit(24)]
    parts = F.array(*[F.struct(F.lit(k).alias("segment"), edges[k].cast("int").alias("start_hour"), (edges[k + 1] - 1).cast("int").alias("end_hour"), F.col(s).alias("predicted_consumption_kwh")) for k, s in enumerate(SEG)])
    best = F.array_position(F.array(*SEG), F.greatest(*SEG)).cast("int")
    day = F.struct(F.date_format("day", "yyyy-MM-dd").alias("date"), parts.alias("segments"), F.element_at(parts, best).alias("peak"))
    names = ("prediction_today", "prediction_tomorrow", "prediction_day_after_tomorrow")
    return rows.withColumn("_j", F.to_json(day)).groupBy("device_id").agg(*[F.max(F.when(F.col("step") == i + 1, F.col("_j"))).alias(n) for i, n in enumerate(names)])


def with_insufficient(payloads: DataFrame, devices: DataFrame) -> DataFrame:
    """All ``devices``: those without a forecast have null payloads."""
    return devices.select("device_id").distinct().join(payloads, "device_id", "left")


def naive(daily: DataFrame, days: int = 7) -> DataFrame:
    """Each day's totals forecast by those ``days`` before (by calendar)."""
    w = Window.partitionBy("device_id").orderBy("day")
    return feats.dense(daily.select("device_id", "day", *SEG)).select("device_id", "day", *SEG, *[F.lag(s, days).over(w).alias(f"pred_{s}") for s in SEG])
