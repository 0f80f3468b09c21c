"""Sinks: result tables with upserts, segment tags, versioned models."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ampflow.schema import RESULTS, SchemaError

KEYS = {
    "nightly_predictions": ["device_id"],
    "daily_actuals": ["device_id", "actual_date"],
    "weekly_predictions": ["device_id", "week_start"],
    "monthly_predictions": ["device_id", "month_start"],
}
_STAMP = {"daily_actuals": "computed_at"}
#: The date that a result table is partitioned by; the others hold a row a device.
PARTITIONS = {"daily_actuals": "actual_date", "weekly_predictions": "week_start", "monthly_predictions": "month_start"}


def newest(rows: DataFrame, keys: list[str], stamp: str, *more: str) -> DataFrame:
    """One row a key: the latest by ``stamp``, then by ``more``."""
    order = [F.col(c).desc_nulls_last() for c in (stamp, *more)]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """``old`` with ``new`` put over it, key by key; where a key is in both, ``new`` wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return newest(both, keys, "_new", stamp).drop("_new")


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """The four result tables, if they are not there; one that a broken swap left aside is put back."""
    for name, ddl in RESULTS.items():
        full = f"{database}.{name}"
        if not spark.catalog.tableExists(full) and spark.catalog.tableExists(f"{full}_before"):
            spark.sql(f"ALTER TABLE {full}_before RENAME TO {full}")
        by = f" PARTITIONED BY ({PARTITIONS[name]})" if name in PARTITIONS else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {full} ({ddl}) USING parquet{by}")


def missing_columns(spark: SparkSession, table: str, wanted: list[str]) -> list[str]:
    have = {c.name for c in spark.catalog.listColumns(table)} if spark.catalog.tableExists(table) else set()
    return sorted(set(wanted) - have)


def write_results(new: DataFrame, table: str, database: str = "default", replace: bool = False, expected: int | None = None) -> None:
    """Upsert into a result table, or replace all of it; if ``expected`` rows are wanted and others come, the table stays as it is.

    ``new`` is computed and stored first, so a failure in it changes nothing.  Tables by date: only the
    partitions of the dates in ``new`` are read and rewritten, each staged and put in place by Spark's commit;
    a replacement drops those of other dates after that.
    The others are written beside the table, which then changes its name for theirs.
    """
    spark, full = new.sparkSession, f"{database}.{table}"
    create_tables(spark, database)
    new = settled(new.select(spark.table(full).columns), f"{table}-new")
    if expected is not None and (found := new.count()) != expected:
        raise SchemaError(f"{found} rows of {table} where {expected} are wanted")
    by, stamp = PARTITIONS.get(table), _STAMP.get(table, "generated_at")
    if by is None:
        _swapped(new if replace else upserted(spark.table(full), new, KEYS[table], stamp), full)
        return
    dates = {r[0] for r in new.select(by).distinct().collect()}  # days, weeks or months of one run
    if dates:
        old = spark.table(full).where(F.col(by).isin(list(dates)))
        merged = new if replace else settled(upserted(old, new, KEYS[table], stamp), f"{table}-merged")
        with _setting(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
            merged.write.insertInto(full, overwrite=True)
    if replace:
        for (day,) in spark.table(full).select(by).distinct().collect():
            if day not in dates:
                spark.sql(f"ALTER TABLE {full} DROP IF EXISTS PARTITION ({by} = '{day}')")


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the time being."""
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def _swapped(rows: DataFrame, full: str) -> None:
    """``rows`` as the table ``full``: written whole beside it, then renamed."""
    spark = rows.sparkSession
    for name in ("next", "before"):
        spark.sql(f"DROP TABLE IF EXISTS {full}_{name}")
    rows.write.format("parquet").saveAsTable(f"{full}_next")
    spark.sql(f"ALTER TABLE {full} RENAME TO {full}_before")
    spark.sql(f"ALTER TABLE {full}_next RENAME TO {full}")
    spark.sql(f"DROP TABLE {full}_before")


def tagged(meter: DataFrame, tags: DataFrame) -> DataFrame:
    """Meter rows with segment_id and is_peak_hour from ``tags`` (id, segment_id, is_peak_hour); others keep theirs."""
    t = tags.select("id", F.col("segment_id").alias("_s"), F.col("is_peak_hour").alias("_p"))
    return meter.join(t, "id", "left").withColumn("segment_id", F.coalesce("_s", "segment_id")).withColumn("is_peak_hour", F.coalesce("_p", "is_peak_hour")).drop("_s", "_p")


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that executors share (``spark.checkpoint.dir``) and read back: a cut in its lineage."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-shared-")  # one machine: no shared folder is named
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A text as a table of one row, which any Hadoop file system holds."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """What ``write_text`` wrote; None if there is nothing."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def save_model(model, path: str) -> None:
    """A Spark model by its writer, others by their own ``save``."""
    if hasattr(model, "write"):
        model.write().overwrite().save(path)
    else:
        model.save(path)


class ModelStore:
    """Versioned models of one horizon under a folder that Spark can write: candidates, promoted ones, a pointer.

    Manifests are one-row text tables, so any Hadoop file system will do.
    """

    def __init__(self, spark: SparkSession, root: str, horizon: str):
        self.spark, self.root = spark, f"{root.rstrip('/')}/{horizon}"

    def _read(self, path: str) -> dict | None:
        text = read_text(self.spark, path)
        return None if text is None else json.loads(text)

    def _write(self, path: str, what: dict) -> None:
        write_text(self.spark, path, json.dumps(what, default=str))

    def _versions(self, kind: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted((n for n in names if n[:1] == "v"), key=lambda n: [int(x) for x in n[1:].split(".")])

    def versions(self, candidates: bool = False) -> list[str]:
        return self._versions("candidates" if candidates else "versions")

    def next_version(self) -> str:
        """One minor step over the highest version so far."""
        known = self.versions() + self.versions(True)
        top = max(([int(x) for x in v[1:].split(".")] for v in known), default=[0, 0])
        return f"v{top[0] or 1}.{top[1] + 1 if known else 0}"

    def store_candidate(self, model, metadata: dict, version: str | None = None) -> str:
        version = version or self.next_version()
        save_model(model, f"{self.root}/candidates/{version}/model")
        self._write(f"{self.root}/candidates/{version}/metadata", metadata | {"version": version, "stored_at": datetime.now(timezone.utc)})
        return version

    def metadata(self, version: str, candidate: bool = False) -> dict | None:
        return self._read(f"{self.root}/{'candidates' if candidate else 'versions'}/{version}/metadata")

    def promote(self, version: str, model) -> dict:
        """Make a candidate the production model; ``model`` is what to serve (as stored or refitted)."""
        metadata = self.metadata(version, True)
        if metadata is None:
            raise FileNotFoundError(version)
        save_model(model, f"{self.root}/versions/{version}/model")
        self._write(f"{self.root}/versions/{version}/metadata", metadata)
        return self.activate(version)

    def activate(self, version: str) -> dict:
        if self.metadata(version) is None:
            raise FileNotFoundError(version)
        pointer = {"version": version, "path": f"{self.root}/versions/{version}/model", "at": str(datetime.now(timezone.utc))}
        self._write(f"{self.root}/production", pointer)
        return pointer

    def production(self) -> dict | None:
        return self._read(f"{self.root}/production")

    def delete(self, version: str, candidate: bool = True) -> None:
        if not candidate and (self.production() or {}).get("version") == version:
            raise ValueError(f"{version} is in production")
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{'candidates' if candidate else 'versions'}/{version}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
