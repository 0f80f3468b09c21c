"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch at most: texts run to megabytes, so the default of
#: 10,000 rows a batch would not keep a Python worker's memory bounded.
BATCH_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on one machine names none (tests), a temporary folder is
    made and set, once a session.  On a cluster that is an error: executors
    would each write to a disk of their own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, so that two uses do not compute twice and a lost
    executor costs a reread, not a rerun.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ``BATCH_ROWS`` rows, unless they are smaller yet."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def fold(doc_id: Column | str, parts: int) -> Column:
    """``crc32(doc_id as text) mod parts``; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % parts


#: A key of fewer rows than this is never taken apart.
HOT_ROWS = 4096
#: Keys that are joined by broadcast, at most.
HOT_KEYS = 50_000


def with_hot(rows: DataFrame, named: DataFrame, key: str, n: str = "n") -> DataFrame:
    """``rows`` joined with ``named`` (a row a ``key``, stored), which says in ``n`` how many rows a key has.

    Keys with so many rows that there cannot be more than ``HOT_KEYS`` of them are
    joined by broadcast, so that none of them makes a task of its own; the others by shuffle.
    """
    total = named.agg(F.sum(n)).first()[0] or 0
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = named.where(F.col(n) > least).drop(n)
    if hot.isEmpty():
        return rows.join(named.drop(n), key)
    names = F.broadcast(hot.select(key, F.lit(True).alias("_hot")))
    marked = rows.join(names, key, "left")
    return marked.where("_hot").drop("_hot").join(F.broadcast(hot), key).unionByName(marked.where("_hot is null").drop("_hot").join(named.where(F.col(n) <= least).drop(n), key))


def picked(rows: DataFrame, group: str, most: int) -> list:
    """Of ``rows`` (doc_id, ``group``) at most ``most`` ids of each group, those of the smallest hashes: Rows of both columns.

    A threshold from the groups' approximate counts leaves about twice as many
    ids before any is gathered, so no group goes through one task, and an id
    that repeats counts once.
    """
    counts = {r[group]: r.n for r in rows.groupBy(group).agg(F.approx_count_distinct("doc_id").alias("n")).collect()}  # a row a group
    if not counts:
        return []
    limit = F.lit(0.0)
    for name, n in counts.items():
        limit = F.when(F.col(group) == name, min(1.0, 2.2 * most / max(n, 1))).otherwise(limit)
    place = F.xxhash64("doc_id")
    near = rows.where(place / float(1 << 64) + 0.5 <= limit).select("doc_id", group, place.alias("_h")).distinct().collect()
    out: dict = {}
    for r in sorted(near, key=lambda r: (r["_h"], r.doc_id)):
        own = out.setdefault(r[group], [])
        if len(own) < most:
            own.append(r)
    return [r for own in out.values() for r in own]


def texts_of(docs: DataFrame, ids: list, most_chars: int) -> dict:
    """doc_id to whole text for the ids, in their order, as long as they hold ``most_chars`` together; longer ones are passed over.

    Of rows that repeat an id the first text in order counts.
    """
    spark = docs.sparkSession
    if not ids:
        return {}
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = docs.join(F.broadcast(spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], f"doc_id {kind}")), "doc_id")  # as many rows as ids
    sizes = {r.doc_id: r.n for r in wanted.groupBy("doc_id").agg(F.max(F.length("text")).alias("n")).collect()}
    left, kept = most_chars, []
    for i in ids:
        n = sizes.get(i, None) if i in sizes else most_chars + 1
        if (n or 0) <= left:
            left -= n or 0
            kept.append(i)
    if not kept:
        return {}
    chosen = docs.join(F.broadcast(spark.createDataFrame([(i,) for i in dict.fromkeys(kept)], f"doc_id {kind}")), "doc_id")
    return {r.doc_id: r.text for r in chosen.groupBy("doc_id").agg(F.min("text").alias("text")).collect()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
