"""Linear and ridge regression from moments: any number of models, groups and targets in one pass.

Each task sums what it sees of a group to a count, means and centred products, and
these are merged, first of some tasks each, then of all, so a group of any size is
never in one place.  A group's moments are as many numbers as there are columns squared;
they come to the driver, which solves the normal equations.  Moments add up, so
a model of several groups together (a fallback, all months before one) takes no pass of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampflow.sources.sinks import read_text, write_text

#: Partial moments that one task merges in the first round, about.
FAN_IN = 64
_EPS = np.finfo(np.float64).eps


@dataclass
class Moments:
    """Count, means and centred products (not divided) of ``columns``."""

    columns: list[str]
    n: int
    mean: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        off = other.mean - self.mean
        products = self.products + other.products + np.outer(off, off) * (self.n * other.n / n)
        return Moments(self.columns, n, self.mean + off * (other.n / n), products)

    @classmethod
    def of(cls, columns: list[str], x: np.ndarray) -> Moments:
        if not len(x):
            return cls(columns, 0, np.zeros(len(columns)), np.zeros((len(columns),) * 2))
        mean = x.mean(0)
        off = x - mean
        return cls(columns, len(x), mean, off.T @ off)


def together(parts: Iterable[Moments]) -> Moments:
    return reduce(Moments.__add__, parts)


def moments(frame: DataFrame, columns: list[str], by: Column | None = None) -> dict[str, Moments]:
    """Moments of the rows of each value of ``by`` (as text; ``""`` without one), rows that lack a column left out; one pass.

    Values of ``by`` are few: clusters, horizons, months.
    """
    kind, d = "key string, n long, mean array<double>, products array<double>", len(columns)
    floats = pa.list_(pa.float64())

    def batch_of(rows: dict[str, Moments]) -> pa.RecordBatch:
        m = list(rows.values())
        return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array([x.n for x in m], pa.int64()), pa.array([x.mean for x in m], floats), pa.array([x.products.ravel() for x in m], floats)], ["key", "n", "mean", "products"])

    def read(key: str, n: int, mean, products) -> tuple[str, Moments]:
        return key, Moments(columns, n, np.asarray(mean, float), np.asarray(products, float).reshape(d, d))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Moments] = {}
        for batch in batches:
            x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(d)])
            whole = np.isfinite(x).all(1)
            keys = np.array(batch.column(0).to_pylist(), object)[whole]
            x = x[whole]
            for key in dict.fromkeys(keys):
                part = Moments.of(columns, x[keys == key])
                held[key] = held[key] + part if key in held else part
        if held:
            yield batch_of(held)

    def merge(rows: pa.Table) -> pa.Table:
        parts = [read(r["key"], r["n"], r["mean"], r["products"]) for r in rows.to_pylist()]
        return pa.Table.from_batches([batch_of({parts[0][0]: together(m for _, m in parts)})])

    key = F.lit("") if by is None else F.coalesce(by.cast("string"), F.lit(""))
    parts = frame.select(key.alias("key"), *[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(add, kind)
    some = parts.withColumn("some", F.floor(F.spark_partition_id() / FAN_IN)).groupBy("key", "some").applyInArrow(lambda t: merge(t.select(["key", "n", "mean", "products"])), kind)
    return dict(read(*r) for r in some.groupBy("key").applyInArrow(merge, kind).collect())  # a row a group


@dataclass
class LinearModel:
    """``label`` as a weighted sum of ``inputs``; ``scaled`` are the weights of standardised inputs."""

    inputs: list[str]
    label: str
    weights: np.ndarray
    intercept: float
    scaled: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rows: int = 0

    def column(self) -> Column:
        terms = [F.col(f"`{c}`").cast("double") * F.lit(float(w)) for c, w in zip(self.inputs, self.weights)]
        return _balanced([F.lit(float(self.intercept)), *terms])

    def transform(self, frame: DataFrame) -> DataFrame:
        """``frame`` with ``prediction``; rows that lack an input go."""
        return with_inputs(frame, self.inputs).withColumn("prediction", self.column())

    def facts(self) -> dict:
        return {"inputs": self.inputs, "label": self.label, "weights": list(map(float, self.weights)), "intercept": float(self.intercept), "scaled": list(map(float, self.scaled)), "rows": self.rows}

    @classmethod
    def of(cls, facts: dict) -> LinearModel:
        return cls(**facts | {"weights": np.array(facts["weights"]), "scaled": np.array(facts["scaled"])})

    def save(self, path: str) -> None:
        write_text(SparkSession.active(), path, json.dumps(self.facts()))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearModel:
        return cls.of(json.loads(read_text(spark, path)))


def _balanced(terms: list[Column]) -> Column:
    """A sum as a balanced tree, which keeps expressions shallow."""
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) - len(terms) % 2 :]
    return terms[0]


def with_inputs(frame: DataFrame, inputs: list[str]) -> DataFrame:
    """Rows that have all ``inputs``, none of them NaN."""
    return frame.dropna(subset=inputs)


def solve(m: Moments, inputs: list[str], label: str, alpha: float = 0.0) -> LinearModel:
    """Least squares with penalty ``alpha`` on the squares of the standardised inputs' weights (population deviation).

    An input without variance has no weight; of inputs that depend on each other, without a penalty, the least weights are taken.
    """
    if not m.n:
        raise ValueError("no rows with all inputs to train on")
    at, y = [m.columns.index(c) for c in inputs], m.columns.index(label)
    std = np.sqrt(np.maximum(np.diag(m.products)[at], 0) / m.n)
    moves = std > 10 * _EPS * np.abs(m.mean[at])
    unit = np.where(moves, std, 1.0)
    a = m.products[np.ix_(at, at)] / np.outer(unit, unit) * np.outer(moves, moves)
    b = m.products[at, y] / unit * moves
    if alpha > 0:
        scaled = np.linalg.solve(a + alpha * np.eye(len(at)), b)
    else:
        values, vectors = np.linalg.eigh(a)
        used = values > max(values.max(initial=0.0), 0.0) * len(at) * _EPS * 16
        scaled = vectors[:, used] @ ((vectors[:, used].T @ b) / values[used])
    weights = scaled * moves / unit
    return LinearModel(inputs, label, weights, float(m.mean[y] - weights @ m.mean[at]), scaled * moves, m.n)


def fit(frame: DataFrame, inputs: list[str], labels: list[str], alpha: float = 0.0) -> dict[str, LinearModel]:
    """A model for each label, from one pass."""
    m = moments(frame, [*inputs, *labels])
    if not m:
        raise ValueError("no rows with all inputs to train on")
    return {y: solve(m[""], inputs, y, alpha) for y in labels}


@dataclass
class LinearEstimator:
    """``fit(frame)`` gives a ``LinearModel``, as Spark's estimators do."""

    inputs: list[str]
    label: str
    alpha: float = 0.0

    def fit(self, frame: DataFrame) -> LinearModel:
        return fit(frame, self.inputs, [self.label], self.alpha)[self.label]

    def fit_groups(self, frame: DataFrame, by: Column) -> dict[str, Moments]:
        """Moments by group, for ``solve``."""
        return moments(frame, [*self.inputs, self.label], by)

    def solve(self, m: Moments) -> LinearModel:
        return solve(m, self.inputs, self.label, self.alpha)


def predicted(frame: DataFrame, models: dict[str, LinearModel], least: float | None = None) -> DataFrame:
    """``frame`` with a forecast by each of ``models`` (by name, of the same inputs), none below ``least``; rows that lack an input go.

    Inputs are read once for all models, in batches: as expressions, many models of many inputs take long to plan.
    """
    inputs = next(iter(models.values())).inputs
    weights, base = np.array([m.weights for m in models.values()]).T, np.array([m.intercept for m in models.values()])

    @F.pandas_udf(", ".join(f"`{name}` double" for name in models))
    def run(*columns: pd.Series) -> pd.DataFrame:
        made = np.column_stack([c.to_numpy(dtype=float) for c in columns]) @ weights + base
        return pd.DataFrame(made if least is None else np.maximum(made, least), columns=list(models))

    made = with_inputs(frame, inputs).withColumn("_made", run(*[F.col(f"`{c}`").cast("double") for c in inputs]))
    return made.select(*[F.col(f"`{c}`") for c in frame.columns], *[F.col("_made")[name].alias(name) for name in models])


def predicted_by(frame: DataFrame, models: dict[str, dict[str, LinearModel]], by: Column, prefix: str = "pred_") -> DataFrame:
    """``frame`` with a prediction of each label by the models of its group; rows of no known group go.

    Weights of all groups (of few values, see ``moments``) go out by broadcast: one pass, whatever their number.
    """
    first = next(iter(models.values()))
    labels, inputs = list(first), next(iter(first.values())).inputs
    rows = [(key, [[float(m[y].intercept), *map(float, m[y].weights)] for y in labels]) for key, m in models.items()]
    named = frame.sparkSession.createDataFrame(rows, "_key string, _w array<array<double>>")
    x = F.array(F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in inputs])
    joined = frame.withColumn("_key", by.cast("string")).join(F.broadcast(named), "_key").withColumn("_x", x)
    dot = lambda k: F.aggregate(F.zip_with("_x", F.col("_w")[k], lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    return joined.withColumns({f"{prefix}{y}": dot(k) for k, y in enumerate(labels)}).drop("_key", "_w", "_x")
