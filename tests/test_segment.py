"""Cuts of a day against plain searches."""

import numpy as np
from pyspark.sql import functions as F

from ampflow.operators import segment
from ampflow.operators.segment import CUTS, OPENERS

STEP = [1.0] * 6 + [5.0] * 6 + [2.0] * 6 + [9.0] * 6


def frame(spark, profiles):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(profiles)], "device_id long, v array<double>")


def cuts(df):
    return {r.device_id: tuple(r.cut) for r in df.select("device_id", "cut").collect()}


def slow_jenks(v):
    def sse(cut):
        edges = [0, *cut, 24]
        return round(sum(float(((v[a:b] - v[a:b].mean()) ** 2).sum()) for a, b in zip(edges, edges[1:])), 9)

    return min(CUTS, key=lambda c: (sse(c), -c[2], -c[1], -c[0]))


def test_thirty_one_cuts():
    assert len(CUTS) == 31 and OPENERS == [4, 5, 6, 7, 10, 11, 12, 13, 14, 17, 18, 19, 20]


def test_jenks(spark):
    rng = np.random.default_rng(0)
    profiles = [STEP, [3.0] * 24, *rng.integers(0, 4, (30, 24)).tolist(), *rng.random((30, 24)).round(3).tolist()]
    got = cuts(segment.jenks(frame(spark, profiles)))
    assert got[0] == (6, 12, 18) and got[1] == (7, 14, 20)
    assert [got[i] for i in range(len(profiles))] == [slow_jenks(np.array(p)) for p in profiles]


def slow_adaptive(p, days=None, weights=None):
    v = np.array([np.mean(p[max(0, h - 1) : h + 2]) for h in range(24)])

    def noise(x):
        d = np.abs(x[2:] - 2 * x[1:-1] + x[:-2])
        d = d[~np.isnan(d)]
        return max(np.median(d) if len(d) else 0, 1e-3 * (np.nanmax(x) - np.nanmin(x)), 1e-6)

    def slope(x):
        return (x[-1] - x[0]) / (len(x) - 1) if len(x) > 1 else 0

    e = {}
    for b in range(1, 24):
        left, right = v[max(0, b - 3) : b], v[b : b + 3]
        s = (abs(right.mean() - left.mean()) + abs(slope(right) - slope(left))) / noise(v)
        agree = 0.5
        if days is not None and len(days) >= 2:
            ds = np.array([d[b : b + 3].mean() - d[max(0, b - 3) : b].mean() for d in days])
            ok = ~np.isnan(ds)
            sign = np.sign(round(float((weights[ok] * ds[ok]).sum()), 12))
            m = np.array([w * min(abs(x) / noise(d), 3) for w, x, d in zip(weights, ds, days)])
            total = m[ok].sum()
            agree = 0.5 if sign == 0 or total < 1e-9 else m[ok][np.sign(ds[ok]) == sign].sum() / total
        e[b] = s * (0.5 + 0.5 * agree)
    floor = np.percentile([e[h] for h in OPENERS], 25)
    tss, best = ((v - v.mean()) ** 2).sum(), None
    for i, cut in enumerate(CUTS):
        edges = [0, *cut, 24]
        rss, means = 0.0, []
        for a, b in zip(edges, edges[1:]):
            x, y = np.arange(b - a), v[a:b]
            k, c = np.polyfit(x, y, 1)
            rss += ((y - k * x - c) ** 2).sum()
            means.append(y.mean())
        fit = 1 - rss / tss if tss > 1e-9 else 0
        score = 4 * fit + 1.5 * sum(e[h] for h in cut) - 1.5 * sum(max(0, floor - e[h]) for h in cut) + 0.25 * np.abs(np.diff(means)).sum() / max(v.std(), 1e-6)
        if best is None or round(score, 7) > round(best[0], 7):
            best = (score, cut)
    return best[1]


def test_adaptive(spark):
    rng = np.random.default_rng(1)
    step = [0.2] * 6 + [0.8] * 6 + [0.4] * 6 + [1.2] * 6
    profiles = [step, [1.0] * 24, *rng.random((20, 24)).round(3).tolist()]
    got = cuts(segment.adaptive(frame(spark, profiles)))
    assert got[0] == (7, 11, 17) and got[1] == (4, 10, 17)
    assert [got[i] for i in range(2, 22)] == [slow_adaptive(np.array(p)) for p in profiles[2:]]


def test_days_vote(spark):
    rng = np.random.default_rng(2)
    rows, expected = [], {}
    for dev in range(4):
        days = (np.array(STEP) + rng.normal(0, 2, (6, 24))).round(3)
        if dev == 3:
            days[2, 5] = np.nan
        for i, d in enumerate(days):
            rows += [(dev, f"2024-01-{i + 1:02d} {h:02d}:00:00", float(x)) for h, x in enumerate(d) if not np.isnan(x)]
        w = 0.97 ** np.arange(5, -1, -1.0)
        p = []
        for h in range(24):
            ok = ~np.isnan(days[:, h])
            o = np.argsort(days[ok, h], kind="stable")
            c = np.cumsum(w[ok][o])
            p.append(days[ok, h][o][np.searchsorted(c, c[-1] / 2)])
        expected[dev] = slow_adaptive(np.array(p), days, w)
    readings = spark.createDataFrame(rows, "device_id long, ts string, kwh double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert cuts(segment.fit_devices(readings)) == expected
    daily = segment.adaptive_daily(readings, 5).where("device_id < 3").collect()
    assert len(daily) == 3 and all(sum(r[f"seg{k}_hours"] for k in range(4)) == 24 for r in daily)
