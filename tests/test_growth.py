"""What keeps steps from growing with shuffle partitions and calendars."""

import statistics

import pytest
from pyspark.sql import functions as F

from ampflow.operators import features, models, profiles


def test_trees_learn_from_few_partitions(spark):
    rows = spark.range(0, 6000, numPartitions=32).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    held = models.dealt(rows)
    assert held.rdd.getNumPartitions() <= 2 and held.count() == 6000
    forest = models.estimator("random_forest", ["x"], "y", held, trees=3, depth=3)
    assert forest.getStages()[-1].getCacheNodeIds()
    assert models.dealt(rows.limit(0)).count() == 0


def test_profiles_make_no_rows_for_days_without_any(spark):
    days = spark.range(0, 60).select(F.lit(1).alias("device_id"), F.expr("date_add(date'2020-01-01', int(id * 3 + if(id > 40, 30000, 0)))").alias("day"), *[(F.col("id") % 5 + k + 1.0).alias(f"seg{k}") for k in range(4)])
    made = profiles.behaviour(days)
    assert "explode" not in made._jdf.queryExecution().optimizedPlan().toString()
    row = made.first()
    assert row.autocorr_lag1 == 0 and row.autocorr_lag7 == 0 and row.naive7_wape == 1  # no day has one, or seven, before it


def test_rolling_features_have_no_sliding_frames(spark):
    x = [1e9 + (i * 7 % 11) if i != 20 else None for i in range(70)]
    days = spark.createDataFrame([(1, i, v, 2.5, 0.0, float(i)) for i, v in enumerate(x)], "device_id long, day int, seg0 double, seg1 double, seg2 double, seg3 double")
    made = features.rolling(days)
    assert "specifiedwindowframe(RowFrame, -30, -1)" not in made._jdf.queryExecution().analyzed().toString()
    for r in made.collect():
        for n in features.ROLLS:
            past = x[max(r.day - n, 0) : r.day]
            if len(past) < n or None in past:
                assert r[f"seg0_mean{n}"] is None and r[f"seg0_std{n}"] is None
            else:
                assert r[f"seg0_std{n}"] == pytest.approx(statistics.stdev(past), rel=1e-9) and r[f"seg0_mean{n}"] == pytest.approx(statistics.mean(past))
                assert r[f"seg1_std{n}"] == 0 and r[f"seg1_mean{n}"] == 2.5
