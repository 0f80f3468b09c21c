"""Queries that train models; they are rows-only, tests check their quality."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from ampflow.operators import cluster, evaluate, models
from ampflow.operators import features as feats
from ampflow.plans.adapters import daily, plain, table
from ampflow.sources.sinks import settled

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query) -> None:
    QUERIES[name] = lambda spark, sf: plain(query(spark, sf))


def _frame(s, d):
    rows = feats.panel(daily(s, d, "l_linenumber"))
    frame = feats.parted(feats.horizon_frame(rows, 1), feats.cutoff(rows.where("usable")))
    frame = settled(frame, "panel")
    return frame, feats.panel_inputs(frame)


def _forecast(algorithm: str):
    def run(s, d):
        frame, inputs = _frame(s, d)
        train, test = frame.where("part = 'train'"), frame.where("part = 'test'")
        if train.isEmpty():  # a table too small for a full month of any device: there is nothing to forecast from
            made = test.where(F.lit(False)).withColumn("prediction", F.lit(0.0))
        else:
            if algorithm not in models.LINEAR:
                train = models.dealt(train.select(*inputs, "target_ratio"))
            made = models.estimator(algorithm, inputs, "target_ratio", train, fast=True).fit(train).transform(test)
        return made.select("device_id", "day", "target", "naive", F.greatest(F.col("prediction") * F.col("scale"), F.lit(0.0)).alias("forecast"))

    return run


_add("ridge_forecast", _forecast("ridge"))
_add("rf_forecast", _forecast("random_forest"))


def _cluster(s, d):
    days = daily(s, d)
    return cluster.fit(days).label(days.select("device_id").distinct())


_add("cluster_assign", _cluster)


def _bundle(s, d):
    """Errors by route: devices are the seven line numbers, whose days are dense."""
    days = daily(s, d, "l_linenumber")
    fit = cluster.fit(days)
    frame = feats.horizon_frame(feats.panel(days), 1).cache()
    inputs = feats.panel_inputs(frame)
    if frame.isEmpty():  # a table too small for a full month of any device
        made = frame.withColumn("route", F.lit("")).withColumn("p", F.col("target"))
    else:
        bundle = cluster.train_bundle(frame, fit, lambda: models.estimator("ridge", inputs, "target_ratio", frame), inputs=inputs)
        made = bundle.predict(frame).withColumn("p", F.col("prediction") * F.col("scale"))
    return evaluate.measure(made, "target", "p", "route")


_add("cluster_bundle_routes", _bundle)


def _recursive(s, d):
    days = daily(s, d, "l_linenumber")
    model = models.SegmentModel("ridge").fit(feats.build(days))
    cuts = days.select("device_id").distinct().withColumn("cut", F.struct(F.lit(5).alias("b1"), F.lit(11).alias("b2"), F.lit(18).alias("b3")))
    return models.recursive_forecast(days, cuts, model)


_add("recursive_3day", _recursive)


def _kmeans(s, d):
    points = table(s, d, "embeddings").where("embedding is not null and size(embedding) = 64").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=8, seed=42, maxIter=10).fit(points).transform(points).groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n"))


_add("profile_kmeans", _kmeans)
