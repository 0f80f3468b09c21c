"""Clusters of devices by behaviour, and which model a device gets."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampflow.functions.ranks import quantiles
from ampflow.operators.linear import LinearEstimator, LinearModel, Moments, moments, together, with_inputs
from ampflow.operators.profiles import BASE, CLOCK, behaviour, clock, medians_filled, outliers, robust_scale, robust_scores
from ampflow.schema import SEG
from ampflow.sources.sinks import read_text, save_model, settled, write_text

NO_CLUSTER = -1
# Groups of features; the features of a group share its weight.
GROUPS = {
    "level": ["log_mean", "log_median"],
    "variability": ["cv", "robust_cv", "diff_volatility"],
    "weekly": ["weekend_ratio", "dow_amplitude", "autocorr_lag1", "autocorr_lag7"],
    "shape": ["share_0", "share_1", "share_2", "share_3", "share_entropy", "share_peak", "share_trough_ratio", "share_volatility"],
    "predictability": ["naive7_wape"],
    "regime": ["spike_frac", "low_frac", "trend_ratio"],
    "clock": CLOCK,
}


@dataclass(frozen=True)
class ClusterSettings:
    enabled: bool = True
    min_days: int = 30
    k: int | None = None
    k_min: int = 2
    k_max: int = 7
    min_devices: int = 30
    min_share: float = 0.03
    outlier_z: float | None = 12.0
    outlier_share: float = 0.1
    winsor: float = 0.01
    variance: float = 0.9
    tries: int = 3
    seed: int = 42
    parallel: int = 6

    def least(self, n: int) -> int:
        """Devices that a cluster must have, of ``n``."""
        return max(1, min(max(self.min_devices, -int(-self.min_share * n // 1)), n // 2))


@dataclass
class ClusterFit:
    """Labels (device_id, cluster; -1 for none), how the fit went, and what places new devices.

    ``k_status`` says whether a requested number of clusters could be had;
    ``robust`` is the scale that outliers are held against.
    """

    status: str
    labels: DataFrame | None = None
    k: int = 0
    silhouette: float | None = None
    columns: list[str] = field(default_factory=list)
    scaler: dict | None = None
    model: object = None
    k_status: str = ""
    robust: dict | None = None

    def save(self, path: str) -> None:
        """Write everything under ``path``, a folder that Spark can write."""
        if self.model is None:
            raise ValueError(f"no clusters to save: {self.status}")
        self.labels.write.mode("overwrite").parquet(f"{path}/labels")
        self.model.write().overwrite().save(f"{path}/kmeans")
        facts = {"status": self.status, "k": self.k, "silhouette": self.silhouette, "columns": self.columns, "scaler": self.scaler, "k_status": self.k_status, "robust": self.robust}
        write_text(self.labels.sparkSession, f"{path}/facts", json.dumps(facts))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ClusterFit:
        facts = json.loads(read_text(spark, f"{path}/facts"))
        return cls(labels=spark.read.parquet(f"{path}/labels"), model=KMeansModel.load(f"{path}/kmeans"), **facts)

    def label(self, devices: DataFrame) -> DataFrame:
        """``devices`` with their cluster; -1 for those without."""
        if self.labels is None:
            return devices.withColumn("cluster", F.lit(NO_CLUSTER))
        return devices.join(self.labels, "device_id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(NO_CLUSTER)))

    def place(self, profiles: DataFrame) -> DataFrame:
        """device_id, cluster of profiles that were not in the fit."""
        return self.model.transform(apply_scaler(profiles, self.scaler)).select("device_id", F.col("prediction").alias("cluster"))


def profiles_of(daily: DataFrame, min_days: int) -> tuple[DataFrame, list[str]]:
    """Profiles with nulls filled, and their columns; with clock features if the days have segment times."""
    base = behaviour(daily, min_days)
    columns = BASE
    if f"{SEG[0]}_start" in daily.columns:
        base, columns = base.join(clock(daily), "device_id", "left"), BASE + CLOCK
    return medians_filled(base, columns), columns


def fit_scaler(profiles: DataFrame, columns: list[str], settings: ClusterSettings) -> dict:
    """Bounds, mean, population deviation and weight of each column, and the leading principal components of what they give.

    Means, deviations and components all come from one pass, by the moments of the bounded columns.
    """
    q = quantiles(profiles, columns, [settings.winsor, 1 - settings.winsor])
    m = moments(profiles.select(*[F.greatest(F.least(F.col(c), F.lit(q[c][1])), F.lit(q[c][0])).alias(c) for c in columns]), columns).get("")
    if m is None:
        raise ValueError("no device has all profile columns")
    size = {c: sum(x in columns for x in g) for g in GROUPS.values() for c in g}
    std = [float(x) or 1.0 for x in np.sqrt(np.diag(m.products) / m.n)]
    weight = [size[c] ** -0.5 for c in columns]
    unit = np.array(weight) / np.array(std)
    values, vectors = np.linalg.eigh(m.products / m.n * np.outer(unit, unit))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    kept, share, most = 0, 0.0, min(len(columns), max(1, m.n - 1))
    while kept < most and share <= settings.variance:
        share += float(values[kept] / (values.sum() or 1.0))
        kept += 1
    facts = [{"name": c, "low": q[c][0], "high": q[c][1], "mean": float(a), "std": s, "weight": w} for c, a, s, w in zip(columns, m.mean, std, weight)]
    return {"columns": facts, "components": vectors[:, :kept].T.tolist()}


def apply_scaler(profiles: DataFrame, scaler: dict) -> DataFrame:
    """device_id, features: bounded, standardised, weighted and projected profiles."""
    parts = [(F.greatest(F.least(F.col(c["name"]), F.lit(c["high"])), F.lit(c["low"])) - c["mean"]) / c["std"] * c["weight"] for c in scaler["columns"]]
    dot = lambda axis: F.aggregate(F.zip_with("_x", F.array(*[F.lit(float(a)) for a in axis]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    rows = profiles.select("device_id", F.array(*parts).alias("_x"))
    return rows.select("device_id", array_to_vector(F.array(*[dot(axis) for axis in scaler["components"]])).alias("features"))


#: Points of a block, about, in the distances of ``silhouettes``.
BLOCK = 1024


def silhouettes(points: DataFrame, sizes: dict[str, list[int]]) -> dict[str, float]:
    """Mean silhouette, by Euclidean distance over all pairs, of each labelling: columns of ``points`` (with ``features``), whose clusters have ``sizes``.

    Points are dealt to blocks; each pair of blocks is a task that sums a point's distances to the
    clusters, for all labellings at once, so the distances themselves are never rows.
    A point alone in its cluster counts 0.
    """
    names, n = list(sizes), max(1, -(-points.count() // BLOCK))
    rows = points.select(F.monotonically_increasing_id().alias("id"), vector_to_array("features").alias("x"), F.array(*names).alias("own"))
    # an int, as the other block of a pair is: both sides of a cogroup hash their keys by type
    rows = settled(rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), "silhouette")
    others = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left, right = (rows.withColumn("a", a).withColumn("b", b).drop("block") for a, b in ((F.col("block"), others), (others, F.col("block"))))
    offsets = np.cumsum([0, *[len(v) for v in sizes.values()]])

    def measure(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"id": [], "own": [], "sums": []}, dtype=object)  # floats would not become arrays
        x, y = np.stack(p["x"]), np.stack(q["x"])
        far = np.sqrt(sum((x[:, None, k] - y[None, :, k]) ** 2 for k in range(x.shape[1])))
        own = np.stack(q["own"])
        flags = np.zeros((len(q), offsets[-1]))
        for k in range(len(names)):
            flags[np.arange(len(q)), offsets[k] + own[:, k]] = 1
        return pd.DataFrame({"id": p["id"], "own": p["own"], "sums": list(far @ flags)})

    parts = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(measure, "id long, own array<int>, sums array<double>")
    total = parts.groupBy("id").agg(F.first("own").alias("own"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(offsets[-1])])
    scores = {}
    for k, name in enumerate(names):
        mean = [F.col(f"s{offsets[k] + c}") / size for c, size in enumerate(sizes[name])]
        own, score = F.col("own")[k], F.lit(0.0)
        for c, size in enumerate(sizes[name]):
            if size > 1:
                inside, outside = F.col(f"s{offsets[k] + c}") / (size - 1), [m for o, m in enumerate(mean) if o != c and sizes[name][o]]
                near = F.least(*outside) if len(outside) > 1 else outside[0]
                score = F.when(own == c, F.coalesce(F.try_divide(near - inside, F.greatest(near, inside)), F.lit(0.0))).otherwise(score)
        scores[name] = F.avg(score).alias(name)
    return total.agg(*scores.values()).first().asDict()


def fit(daily: DataFrame, settings: ClusterSettings = ClusterSettings()) -> ClusterFit:
    """Cluster devices: outliers aside, k with the best silhouette among those whose clusters are all large enough.

    Never fails for want of data; ``status`` says why there are no clusters.
    """
    if not settings.enabled:
        return ClusterFit("disabled")
    profiles, columns = profiles_of(daily, settings.min_days)
    n = profiles.count()
    if n < 2 * settings.k_min:
        return ClusterFit("too_few_devices", columns=columns)
    used, robust = profiles, robust_scale(profiles, columns)
    if settings.outlier_z is not None:
        far = outliers(robust_scores(profiles, columns, scale=robust), settings.outlier_z, settings.outlier_share).where("outlier").select("device_id")
        used = settled(profiles.join(far, "device_id", "left_anti"), "clustered")
        n = used.count()
    scaler = fit_scaler(used, columns, settings)
    points = settled(apply_scaler(used, scaler), "points").cache()
    valid, least = {}, settings.least(n)
    ks = range(settings.k_min, min(max(settings.k_max, settings.k or 0), n - 1) + 1)
    attempt = inheritable_thread_target(daily.sparkSession)(lambda kt: KMeans(k=kt[0], seed=settings.seed + kt[1], maxIter=100, tol=1e-4).fit(points))
    with ThreadPool(settings.parallel) as pool:  # fits are small jobs, which leave most of a cluster idle
        tries = dict(zip(pairs := [(k, t) for k in ks for t in range(settings.tries)], pool.map(attempt, pairs)))
    for k in ks:
        model = min((tries[k, t] for t in range(settings.tries)), key=lambda m: m.summary.trainingCost)
        if len(model.clusterCenters()) >= 2 and min(model.summary.clusterSizes) >= least:
            valid[k] = model
    labelled = points
    for k, model in valid.items():
        labelled = model.copy().setPredictionCol(f"k{k}").transform(labelled)
    scores = silhouettes(labelled, {f"k{k}": list(m.summary.clusterSizes) for k, m in valid.items()}) if valid else {}
    if not valid:
        points.unpersist()
        return ClusterFit("no_valid_k", columns=columns, scaler=scaler, robust=robust)
    if settings.k:
        k = max((x for x in valid if x <= settings.k), default=min(valid))
        k_status = "as_requested" if k == settings.k else f"adjusted_from_{settings.k}"
    else:
        k, k_status = max(valid, key=lambda x: scores[f"k{x}"]), "auto"
    score, model = scores[f"k{k}"], valid[k]
    labels = settled(model.transform(points).select("device_id", F.col("prediction").alias("cluster")), "clusters")
    points.unpersist()
    return ClusterFit("ok", labels, k, score, columns, scaler, model, k_status, robust)


def one_hot(labels: DataFrame, k: int) -> DataFrame:
    """device_id, cluster and a flag for each of ``k`` clusters."""
    return labels.select("device_id", "cluster", *[(F.col("cluster") == i).cast("int").alias(f"cluster_{i}") for i in range(k)])


def joined(features: DataFrame, profiles: DataFrame) -> DataFrame:
    """Features with their device's profile columns, prefixed; a device that lacks one, or has two, is an error."""
    renamed = profiles.select("device_id", *[F.col(c).alias(f"cluster_{c}") for c in profiles.columns if c != "device_id"])
    if not renamed.groupBy("device_id").count().where("count > 1").isEmpty():
        raise ValueError("a device has two profiles")
    if not features.select("device_id").distinct().join(renamed, "device_id", "left_anti").isEmpty():
        raise ValueError("a device has no profile")
    return features.join(renamed, "device_id")


@dataclass
class Bundle:
    """A model a cluster, and one for all the rest."""

    fit: ClusterFit
    fallback: PipelineModel | LinearModel
    models: dict[int, PipelineModel | LinearModel]

    def predict(self, frame: DataFrame) -> DataFrame:
        """``frame`` with prediction, cluster and route: one pass for linear models, else a pass a model over its own rows."""
        rows, known = self.fit.label(frame), list(self.models)
        if all(isinstance(m, LinearModel) for m in (self.fallback, *self.models.values())):
            made, route = self.fallback.column(), F.lit("fallback")
            for c, m in self.models.items():
                made = F.when(F.col("cluster") == c, m.column()).otherwise(made)
                route = F.when(F.col("cluster") == c, f"cluster_{c}").otherwise(route)
            return with_inputs(rows, self.fallback.inputs).withColumns({"prediction": made, "route": route})
        parts = [self.fallback.transform(rows.where(~F.col("cluster").isin(known)) if known else rows).withColumn("route", F.lit("fallback"))]
        parts += [m.transform(rows.where(F.col("cluster") == c)).withColumn("route", F.lit(f"cluster_{c}")) for c, m in self.models.items()]
        columns = [*rows.columns, "prediction", "route"]
        out = parts[0].select(columns)
        for p in parts[1:]:
            out = out.unionByName(p.select(columns))
        return out

    def save(self, path: str) -> None:
        """Write the models, and the clusters if there are any, under ``path``."""
        save_model(self.fallback, f"{path}/fallback")
        for c, m in self.models.items():
            save_model(m, f"{path}/cluster-{c}")
        if self.fit.model is not None:
            self.fit.save(f"{path}/clusters")
        write_text(SparkSession.active(), f"{path}/bundle", json.dumps({"models": sorted(self.models), "status": self.fit.status, "clusters": self.fit.model is not None, "linear": isinstance(self.fallback, LinearModel)}))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bundle:
        facts = json.loads(read_text(spark, f"{path}/bundle"))
        fit_ = ClusterFit.load(spark, f"{path}/clusters") if facts["clusters"] else ClusterFit(facts["status"])
        load = (lambda at: LinearModel.load(spark, at)) if facts["linear"] else PipelineModel.load
        return cls(fit_, load(f"{path}/fallback"), {c: load(f"{path}/cluster-{c}") for c in facts["models"]})

    def summary(self) -> dict:
        return {"status": self.fit.status, "k": self.fit.k, "silhouette": self.fit.silhouette, "models": sorted(self.models)}


def train_bundle(frame: DataFrame, fit_: ClusterFit, build, min_rows: int = 20, uncovered_only: bool = False, inputs: list[str] | None = None) -> Bundle:
    """Fit ``build()`` (an estimator) on each cluster with ``min_rows`` rows, and on all rows (or the uncovered) as fallback.

    Rows that lack one of ``inputs`` do not count; without any row left there is nothing to fit, which is an error.
    Linear models all come from one pass, by moments of each cluster.
    """
    rows = fit_.label(frame.dropna(subset=inputs) if inputs else frame)
    kind = build()
    if isinstance(kind, LinearEstimator):
        return linear_bundle(fit_, kind, kind.fit_groups(rows, F.col("cluster")), min_rows, uncovered_only)
    sizes = {r.cluster: r["count"] for r in rows.groupBy("cluster").count().collect()}  # a row a cluster
    if not sizes:
        raise ValueError("no rows with all inputs to train on")
    models = {c: build().fit(rows.where(F.col("cluster") == c)) for c, n in sorted(sizes.items()) if c != NO_CLUSTER and n >= min_rows}
    rest = rows.where(~F.col("cluster").isin(list(models))) if uncovered_only and models else rows
    if uncovered_only and rest.isEmpty():
        rest = rows
    return Bundle(fit_, build().fit(rest), models)


def linear_bundle(fit_: ClusterFit, kind: LinearEstimator, found: dict[str, Moments], min_rows: int = 20, uncovered_only: bool = False) -> Bundle:
    """A bundle from the moments of each cluster (as text); the fallback's are those of all, or of the uncovered if there are any, added up."""
    if not found:
        raise ValueError("no rows with all inputs to train on")
    models = {int(c): kind.solve(m) for c, m in sorted(found.items()) if int(c) != NO_CLUSTER and m.n >= min_rows}
    rest = [m for c, m in found.items() if int(c) not in models] if uncovered_only else []
    return Bundle(fit_, kind.solve(together(rest or found.values())), models)


def route(daily: DataFrame, fit_: ClusterFit, models: list[int], settings: ClusterSettings = ClusterSettings()) -> DataFrame:
    """device_id, cluster, reason: where each device goes at inference, and why if it is the fallback."""
    devices = daily.groupBy("device_id").agg(F.count_distinct("day").alias("days"))
    if fit_.model is None:
        return devices.select("device_id", F.lit(NO_CLUSTER).alias("cluster"), F.lit("no_clusterer").alias("reason"))
    profiles, columns = profiles_of(daily, settings.min_days)
    placed = devices.join(fit_.place(profiles), "device_id", "left")
    z = robust_scores(profiles, columns, scale=fit_.robust)
    rows = placed.join(z, "device_id", "left")
    reason = (
        F.when(F.col("days") < settings.min_days, "below_min_days")
        .when(F.col("cluster").isNull(), "no_history")
        .when(F.col("z") > (settings.outlier_z or float("inf")), "outlier_device")
        .when(~F.col("cluster").isin(models or [NO_CLUSTER]), "cluster_has_no_model")
        .otherwise("ok")
    )
    return rows.withColumn("reason", reason).select("device_id", F.when(F.col("reason") == "ok", F.col("cluster")).otherwise(NO_CLUSTER).alias("cluster"), "reason")
