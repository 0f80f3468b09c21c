"""Readings from CSV and from a database (Derby, in memory)."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ampflow.plans import rebuild
from ampflow.sources import readers

from .test_jobs import meter

CONFIG = readers.JdbcConfig("jdbc:derby:memory:amp;create=true", driver="org.apache.derby.jdbc.EmbeddedDriver")


def test_csv_readings(spark, tmp_path):
    (tmp_path / "r.csv").write_text("device_id,ts,kwh\n1,2024-01-01 00:00:00,1.5\n2,2024-01-01 01:00:00,\nx,2024-01-01 02:00:00,3\n")
    rows = readers.read_csv(spark, str(tmp_path / "r.csv"))
    assert [f.dataType.simpleString() for f in rows.schema] == ["bigint", "timestamp", "double"]
    assert [tuple(r) for r in rows.collect()] == [(1, dt.datetime(2024, 1, 1), 1.5), (2, dt.datetime(2024, 1, 1, 1), None), (None, dt.datetime(2024, 1, 1, 2), 3.0)]
    with pytest.raises(AnalysisException):
        readers.read_csv(spark, str(tmp_path / "none.csv"))


def test_a_meter_table_in_a_database(spark, tmp_path):
    rows = meter(spark, 12, 3).withColumn("id", F.monotonically_increasing_id())
    rows.write.format("jdbc").options(**CONFIG.options()).option("dbtable", "device_data").save()
    whole = readers.read_jdbc(spark, CONFIG, "device_data")
    parted = readers.read_jdbc(spark, CONFIG, "device_data", bounds=(0, 3), partitions=3)
    assert parted.rdd.getNumPartitions() == 3 and whole.rdd.getNumPartitions() == 1
    key = lambda df: sorted((r.id, r.device_id, r.power_W, r.created_at) for r in df.collect())
    assert key(parted) == key(whole) == key(rows)
    daily = rebuild.daily_from_jdbc(spark, CONFIG, "device_data", str(tmp_path / "daily"), bounds=(0, 3), window_days=3)
    want = rebuild.write_daily(readers.history(rows), str(tmp_path / "plain"), 3)
    assert daily.count() == want.count() > 0 and daily.exceptAll(want).isEmpty()
