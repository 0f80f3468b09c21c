"""Behaviour profiles of devices, and how far each lies from the rest."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ampflow.functions.numeric import correlation, finite, total
from ampflow.functions.ranks import numbered, quantiles
from ampflow.operators.features import by_day
from ampflow.schema import SEG
from ampflow.sources.sinks import settled

MIN_DAYS, RECENT_DAYS = 21, 28
BASE = [
    "log_mean", "log_median", "cv", "robust_cv", "diff_volatility", "weekend_ratio", "dow_amplitude", "autocorr_lag1", "autocorr_lag7",
    "share_0", "share_1", "share_2", "share_3", "share_entropy", "share_peak", "share_trough_ratio", "share_volatility",
    "naive7_wape", "spike_frac", "low_frac", "trend_ratio",
]
CLOCK = ["boundary_mean_1", "boundary_mean_2", "boundary_mean_3", "boundary_stability", "energy_center_sin", "energy_center_cos", "peak_hour_sin", "peak_hour_cos"]
#: Outliers are scored by the mean of so many worst features.
WORST = 3


def behaviour(daily: DataFrame, min_days: int = MIN_DAYS, recent_days: int = RECENT_DAYS, until: Column | None = None) -> DataFrame:
    """device_id and the features of ``BASE``.

    ``daily`` has whole days only, a row each; lags look back by the calendar, so
    days without a row need none.
    Devices of fewer than ``min_days`` rows, or without use, have no profile.
    """
    rows = daily.select("device_id", "day", *SEG).where(until if until is not None else F.lit(True))
    days = rows.where("day is not null").select("device_id", "day", F.unix_date("day").alias("_d"), *SEG).withColumn("y", total([F.col(s) for s in SEG]))
    w, whole = by_day(order="_d"), Window.partitionBy("device_id")
    before = lambda k: F.first("y").over(w.rangeBetween(-k, -k))
    known = F.count("y").over(whole)
    days = days.withColumns({"y1": before(1), "y7": before(7), "rows": known, "_back": known - F.count("y").over(w) + 1, "_m": F.avg("y").over(whole), "med": F.percentile("y", 0.5).over(whole)}).drop("_d")
    days = days.where(F.col("rows") >= min_days).withColumn("_base", F.when(F.col("med") > 1e-9, F.col("med")).otherwise(F.col("_m")))
    some = F.when(F.col("y") > 0, F.col("y"))
    days = days.withColumns({f"s{k}": F.col(s) / some for k, s in enumerate(SEG)}).withColumn("dow", F.weekday("day"))
    y, we = F.col("y"), F.col("dow") >= 5
    agg = days.groupBy("device_id").agg(
        F.avg(y).alias("m"),
        F.first("med").alias("med"),
        F.stddev_samp(y).alias("sd"),
        F.percentile(F.abs(y - F.col("med")), 0.5).alias("mad"),
        F.avg(F.abs(y - F.col("y1"))).alias("step"),
        F.avg(F.when(we, y)).alias("we"),
        F.avg(F.when(~we, y)).alias("wd"),
        *[F.avg(F.when(F.col("dow") == d, y)).alias(f"d{d}") for d in range(7)],
        correlation(y, F.col("y1")).alias("autocorr_lag1"),
        correlation(y, F.col("y7")).alias("autocorr_lag7"),
        *[F.avg(f"s{k}").alias(f"a{k}") for k in range(4)],
        *[F.stddev_samp(f"s{k}").alias(f"v{k}") for k in range(4)],
        F.avg(F.abs(y - F.col("y7"))).alias("miss7"),
        F.count(y - F.col("y7")).alias("n7"),
        F.avg((y > 2 * F.col("_base")).cast("double")).alias("spike_frac"),
        F.avg((y < 0.3 * F.col("_base")).cast("double")).alias("low_frac"),
        F.avg(F.when(F.col("_back") <= recent_days, y)).alias("recent"),
    ).where("m > 1e-9")
    m = F.col("m")
    dow = F.array(*[F.coalesce(F.col(f"d{d}") / m, F.lit(1.0)) for d in range(7)])
    mean7 = F.aggregate(dow, F.lit(0.0), lambda a, x: a + x) / 7
    whole = total([F.coalesce(f"a{k}", F.lit(0.0)) for k in range(4)])
    agg = agg.withColumn("_dow", dow).withColumn("_dm", mean7).withColumn("_share", F.array(*[F.coalesce(F.col(f"a{k}") / F.when(whole > 0, whole), F.lit(0.25)) for k in range(4)]))
    share, cv = F.col("_share"), F.coalesce(F.col("sd") / m, F.lit(0.0))
    return agg.select(
        "device_id",
        F.log1p(m).alias("log_mean"),
        F.log1p("med").alias("log_median"),
        cv.alias("cv"),
        F.coalesce(F.col("mad") * 1.4826 / F.when(F.col("med") > 1e-9, F.col("med")), cv).alias("robust_cv"),
        F.coalesce(F.col("step") / m, F.lit(0.0)).alias("diff_volatility"),
        F.coalesce(F.col("we") / F.when(F.col("wd") > 1e-9, F.col("wd")), F.lit(1.0)).alias("weekend_ratio"),
        F.sqrt(F.aggregate("_dow", F.lit(0.0), lambda a, x: a + (x - F.col("_dm")) * (x - F.col("_dm"))) / 6).alias("dow_amplitude"),
        "autocorr_lag1",
        "autocorr_lag7",
        *[share[k].alias(f"share_{k}") for k in range(4)],
        (-F.aggregate(share, F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.ln(p)).otherwise(0.0)) / F.ln(F.lit(4.0))).alias("share_entropy"),
        F.array_max(share).alias("share_peak"),
        (F.array_min(share) / F.array_max(share)).alias("share_trough_ratio"),
        (total([F.coalesce(f"v{k}", F.lit(0.0)) for k in range(4)]) / 4).alias("share_volatility"),
        F.when(F.col("n7") >= 5, F.col("miss7") / m).otherwise(1.0).alias("naive7_wape"),
        "spike_frac",
        "low_frac",
        F.ln((F.col("recent") + 1e-6) / (m + 1e-6)).alias("trend_ratio"),
    )


def clock(daily: DataFrame) -> DataFrame:
    """device_id and the features of ``CLOCK``: where a device's cuts and its use lie on the clock.

    Days that lack a segment or its time do not count.
    """
    rows = daily.dropna(subset=[*SEG, *[f"{s}_{n}" for s in SEG for n in ("start", "hours")]])
    turn = [(F.col(f"{s}_start") + F.col(f"{s}_hours") / 2.0) * (2 * math.pi / 24) for s in SEG]
    density = F.array(*[F.col(s) / F.when(F.col(f"{s}_hours") > 0, F.col(f"{s}_hours")).otherwise(1) for s in SEG])
    top = F.array_position(density, F.array_max(density)).cast("int")
    rows = rows.withColumns({
        "_use": total([F.col(s) for s in SEG]),
        "_sin": total([F.col(s) * F.sin(t) for s, t in zip(SEG, turn)]),
        "_cos": total([F.col(s) * F.cos(t) for s, t in zip(SEG, turn)]),
        "_peak": F.element_at(F.array(*turn), top),
    })
    starts = [f"{s}_start" for s in SEG[1:]]
    use = F.when(F.avg("_use") > 0, F.avg("_use"))
    return rows.groupBy("device_id").agg(
        *[F.avg(s).alias(CLOCK[i]) for i, s in enumerate(starts)],
        (total([F.stddev_pop(s) for s in starts]) / 3).alias("boundary_stability"),
        F.coalesce(F.avg("_sin") / use, F.lit(0.0)).alias("energy_center_sin"),
        F.coalesce(F.avg("_cos") / use, F.lit(0.0)).alias("energy_center_cos"),
        F.avg(F.sin("_peak")).alias("peak_hour_sin"),
        F.avg(F.cos("_peak")).alias("peak_hour_cos"),
    )


def medians_filled(profiles: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls (and NaN, infinities) replaced by the column's median over devices; stored."""
    clean = settled(profiles.select("device_id", *[finite(F.col(c)).alias(c) for c in columns]), "profiles")
    mids = quantiles(clean, columns, [0.5])
    return clean.select("device_id", *[F.coalesce(c, F.lit(mids[c][0] or 0.0)).alias(c) for c in columns])


def robust_scale(profiles: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Of each column its median, and the scaled median deviation from it (1 where that is zero)."""
    mids = quantiles(profiles, columns, [0.5])
    away = profiles.select([F.abs(F.col(c) - F.lit(mids[c][0])).alias(c) for c in columns])
    spread = quantiles(away, columns, [0.5])
    out = {}
    for c in columns:
        mad = (spread[c][0] or 0.0) * 1.4826
        out[c] = (mids[c][0] or 0.0, mad if mad > 1e-9 else 1.0)
    return out


def robust_scores(profiles: DataFrame, columns: list[str], worst: int = WORST, scale: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """device_id, z: mean of the ``worst`` largest distances from the median, in units of the scaled median deviation.

    ``scale`` is what ``robust_scale`` gave for the devices that others are held against; by default for these.
    """
    scale = scale or robust_scale(profiles, columns)
    z = F.array(*[F.abs(F.col(c) - F.lit(scale[c][0])) / F.lit(scale[c][1]) for c in columns])
    top = F.slice(F.sort_array(z, asc=False), 1, worst)
    return profiles.select("device_id", (F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)).alias("z"))


def outliers(scores: DataFrame, limit: float = 12.0, most: float = 0.1) -> DataFrame:
    """device_id, z, outlier: scores over ``limit``, but only the highest ``most`` of all devices."""
    n, over = scores.agg(F.count("*"), F.count_if(F.col("z") > limit)).first()
    cap = int(n * most)
    if over <= cap:
        return scores.withColumn("outlier", F.col("z") > limit)
    ranked = numbered(scores.where(F.col("z") > limit).withColumn("_z", -F.col("z")), "_z", "device_id", name="_n")
    cut = ranked.where(F.col("_n") <= cap).select("device_id", F.lit(True).alias("_o"))
    return scores.join(cut, "device_id", "left").withColumn("outlier", F.coalesce("_o", F.lit(False))).drop("_o")
