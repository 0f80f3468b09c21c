"""Silhouettes and components of device profiles against numpy; joined profiles."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ampflow.operators import cluster
from ampflow.operators.profiles import BASE


def plain_silhouette(x, own):
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i, c in enumerate(own):
        same = own == c
        if same.sum() == 1:
            out.append(0.0)
            continue
        a = far[i, same].sum() / (same.sum() - 1)
        b = min(far[i, own == o].mean() for o in set(own.tolist()) - {c})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


@pytest.mark.parametrize("block", [64, 4096])
def test_silhouettes_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(cluster, "BLOCK", block)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(240, 3)), rng.normal(size=(259, 3)) + 2, [[50.0, 0, 0]]])
    x[10] = x[11]
    labels = np.column_stack([np.r_[np.zeros(240), np.ones(260)], rng.integers(0, 4, 500), np.r_[np.zeros(499), 1]]).astype(int)
    df = spark.createDataFrame([(i, x[i].tolist(), *map(int, labels[i])) for i in range(500)], "device_id long, v array<double>, k2 int, k4 int, kx int").withColumn("features", array_to_vector("v"))
    got = cluster.silhouettes(df, {name: np.bincount(labels[:, k]).tolist() for k, name in enumerate(("k2", "k4", "kx"))})
    for k, name in enumerate(("k2", "k4", "kx")):
        assert got[name] == pytest.approx(plain_silhouette(x, labels[:, k]), abs=1e-9)


def test_scaled_profiles_are_principal_components(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, len(BASE))) @ rng.normal(size=(len(BASE),) * 2)
    x[:, 2] = 4.0
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "device_id long, " + ", ".join(f"{c} double" for c in BASE))
    settings = cluster.ClusterSettings(winsor=0.05, variance=0.8)
    scaler = cluster.fit_scaler(df, BASE, settings)
    low, high = np.quantile(x, [0.05, 0.95], axis=0)
    held = np.clip(x, low, high)
    std = held.std(0)
    size = {c: sum(y in BASE for y in g) for g in cluster.GROUPS.values() for c in g}
    z = (held - held.mean(0)) / np.where(std > 0, std, 1) * [size[c] ** -0.5 for c in BASE]
    share = np.linalg.svd(z, compute_uv=False) ** 2
    kept = int(np.argmax(np.cumsum(share) / share.sum() > 0.8)) + 1
    got = np.array([r.features.toArray() for r in cluster.apply_scaler(df, scaler).orderBy("device_id").collect()])
    assert got.shape == (120, kept)
    assert np.allclose(got.var(0), (share / 120)[:kept]) and np.allclose(np.cov(got.T, ddof=0), np.diag((share / 120)[:kept]), atol=1e-9)


def test_profiles_joined_to_features(spark):
    features = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 4.0)], "device_id long, x double")
    profiles = spark.createDataFrame([(1, 7.0, 8.0), (2, 9.0, 1.0), (3, 0.0, 0.0)], "device_id long, cv double, level double")
    rows = sorted(tuple(r) for r in cluster.joined(features, profiles).collect())
    assert rows == [(1, 2.0, 7.0, 8.0), (1, 3.0, 7.0, 8.0), (2, 4.0, 9.0, 1.0)]
    assert cluster.joined(features, profiles).columns == ["device_id", "x", "cluster_cv", "cluster_level"]
    with pytest.raises(ValueError, match="two profiles"):
        cluster.joined(features, profiles.union(profiles.limit(1)))
    with pytest.raises(ValueError, match="no profile"):
        cluster.joined(features.withColumn("device_id", F.col("device_id") + 5), profiles)


def test_silhouettes_with_every_pair_of_blocks_in_its_own_partition(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 64)
    x = np.random.default_rng(4).normal(size=(300, 2))
    own = (x[:, 0] > 0).astype(int)
    df = spark.createDataFrame([(x[i].tolist(), int(own[i])) for i in range(300)], "v array<double>, k2 int").withColumn("features", array_to_vector("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small partitions are not put together, as on larger tables
    try:
        got = cluster.silhouettes(df, {"k2": np.bincount(own).tolist()})
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got["k2"] == pytest.approx(plain_silhouette(x, own), abs=1e-9)
