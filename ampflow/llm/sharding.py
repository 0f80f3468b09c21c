"""Shards of near-equal bytes: a minimax contiguous partition of ordered groups.

Rows of equal text are a group, told by the 64-bit hash of the text, and are never
parted.  Groups are ordered by that hash, so a shard is a range of hashes and
needs no list of its documents.  The smallest capacity that every shard can keep
to is found by binary search, each capacity checked greedily (fill a shard until
the next group does not fit); the cuts are those of that capacity, moved back to
even shares where it leaves room.

Groups larger than an even share of what is left come before all others and are a shard each.

The order is far too long for one machine, so the search sees ranges of hashes
with their sums.  A capacity is surely enough if whole ranges can be
dealt out, and surely too small if not even ranges that could be cut anywhere
would do.  Between the two, only ranges that may hold a cut are summed again in
256 parts, until the two bounds meet: a few passes over a table of one short row a
group, and some thousands of ranges on the driver, whatever the input.

Sizes are UTF-8 bytes plus a fixed amount a row; a null text has no bytes and is in one
group with empty ones.  Rows count, not ids: null and repeated ids are placed like
others.  Ties, that is equal texts, stay together.  With fewer groups than shards some
shards stay empty; an empty table gives an empty result.  Other columns are kept
by ``sharded`` and ``write`` and not read by the rest.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ampflow.llm.common import saved

SHARDS = 24
#: Bytes of a row besides its text.
ROW_BYTES = 8
#: Bits of a hash that the first ranges go by, and that each next pass adds.
FIRST_BITS, MORE_BITS = 16, 8


def text_key(text: Column | str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def text_size(text: Column | str = "text", row_bytes: int = ROW_BYTES) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + row_bytes


@dataclass
class Ranges:
    """Ranges of hashes in order: where each begins, the bits it is told by, its bytes, and whether it is one group."""

    begin: np.ndarray
    bits: np.ndarray
    size: np.ndarray
    single: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        """Bytes up to and with each range, after a zero."""
        return np.append(0, np.cumsum(self.size))


def greedy(r: Ranges, ends: np.ndarray, capacity: int, shards: int, divisible: bool = False) -> np.ndarray:
    """How many bytes the first 1, 2, ... ``shards`` shards hold, each filled as far as ``capacity`` goes.

    A range of several groups is taken whole, or, if ``divisible``, as if it could be cut anywhere.
    """
    out, at = [], 0
    for _ in range(shards):
        k = int(np.searchsorted(ends, at + capacity, "right")) - 1  # ranges that fit whole
        full = k >= len(r.size)
        at = max(at, int(ends[-1]) if full else at + capacity if divisible and not r.single[k] else int(ends[k]))
        out.append(at)
    return np.array(out)


def smallest(r: Ranges, ends: np.ndarray, shards: int, low: int, divisible: bool) -> int:
    """The smallest capacity from ``low`` on by which all is dealt out, by binary search."""
    high = max(low, int(ends[-1]))
    while low < high:
        middle = (low + high) // 2
        if greedy(r, ends, middle, shards, divisible)[-1] >= ends[-1]:
            high = middle
        else:
            low = middle + 1
    return low


def even_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Range numbers at which the shards end: even shares, as far as the capacity allows for the shards before and after."""
    n = len(ends) - 1
    least, at = [], n  # from the back: where a shard must end at least, so that those after it can hold the rest
    for _ in range(shards):
        least.append(at)
        at = int(np.searchsorted(ends, ends[at] - capacity, "left"))
    out, at = [], 0
    for s, low in enumerate(reversed(least)):
        share = ends[at] + (ends[n] - ends[at]) / (shards - s)
        near = int(np.searchsorted(ends, share, "left"))
        if near and share - ends[near - 1] < ends[min(near, n)] - share:
            near -= 1
        most = int(np.searchsorted(ends, ends[at] + capacity, "right")) - 1
        at = max(at, low, min(near, most))
        out.append(at)
    return out


@dataclass
class Plan:
    """``alone``: hashes of groups that are shards 0, 1, ... by themselves; ``cuts``: hashes from which the next shards begin."""

    shards: int
    alone: list[int] = field(default_factory=list)
    cuts: list[int] = field(default_factory=list)
    capacity: int = 0

    def shard(self, key: Column) -> Column:
        out = F.lit(len(self.alone))
        for cut in self.cuts:
            out = out + (key >= F.lit(cut)).cast("int")
        for k, h in enumerate(self.alone):
            out = F.when(key == F.lit(h), k).otherwise(out)
        return out.cast("int")


def _sums(groups: DataFrame, bits: int, of: np.ndarray | None = None, above: int = 0) -> list:
    """(range, bytes, groups) by the first ``bits`` of the hash; of the ranges ``of`` by their first ``above`` bits only."""
    if of is not None:
        names = groups.sparkSession.createDataFrame([(int(x),) for x in of], "outer long")
        groups = groups.withColumn("outer", F.shiftright("key", 64 - above)).join(F.broadcast(names), "outer")  # ranges of the driver, some thousands
    return groups.groupBy(F.shiftright("key", 64 - bits).alias("part")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()


def _ranges(rows: list, bits: int) -> Ranges:
    rows = sorted(rows, key=lambda r: r.part)
    return Ranges(np.array([r.part << (64 - bits) for r in rows], np.int64), np.full(len(rows), bits), np.array([r.size for r in rows], np.int64), np.array([r.n == 1 for r in rows], bool))


def plan(groups: DataFrame, shards: int = SHARDS) -> Plan:
    """Where to cut ``groups`` (key: hash, size: bytes; a row a key, stored, as it is read several times)."""
    total = int(groups.agg(F.sum("size")).first()[0] or 0)
    out, left = Plan(shards), shards
    for r in groups.orderBy(F.desc("size"), "key").limit(shards).collect():
        if left > 1 and r.size * left > total:
            out.alone.append(r.key)
            total, left = total - r.size, left - 1
            out.capacity = max(out.capacity, r.size)
        else:
            break
    rest = groups.where(~F.col("key").isin(out.alone)) if out.alone else groups
    r = _ranges(_sums(rest, FIRST_BITS), FIRST_BITS)
    if not len(r.size):
        return out
    while True:
        ends = r.ends
        low = smallest(r, ends, left, -(-int(ends[-1]) // left), True)
        high = smallest(r, ends, left, low, False)
        if low == high:
            break
        a = np.searchsorted(ends, greedy(r, ends, low, left), "right") - 1
        b = np.searchsorted(ends, greedy(r, ends, high, left, True), "left")
        may = np.zeros(len(ends) + 1, np.int64)
        np.add.at(may, a, 1)
        np.add.at(may, np.minimum(b + 1, len(ends)), -1)
        cut = (np.cumsum(may)[: len(r.size)] > 0) & ~r.single
        finer, kept = [], Ranges(r.begin[~cut], r.bits[~cut], r.size[~cut], r.single[~cut])
        for bits in np.unique(r.bits[cut]).tolist():
            own = r.begin[cut & (r.bits == bits)] >> (64 - bits)
            more = min(64, bits + MORE_BITS)
            finer.append(_ranges(_sums(rest, more, own, bits), more))
        parts = [kept, *finer]
        r = Ranges(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("begin", "bits", "size", "single")))
        by = np.argsort(r.begin)
        r = Ranges(r.begin[by], r.bits[by], r.size[by], r.single[by])
    out.capacity = max(out.capacity, high)
    begins = [int(x) for x in r.begin]
    out.cuts = [begins[k] for k in even_cuts(ends, high, left)[:-1] if k < len(begins)]
    return out


def grouped(rows: DataFrame) -> DataFrame:
    """(key, size) rows summed by key, stored."""
    return saved(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")


def planned(docs: DataFrame, shards: int = SHARDS, text_col: str = "text", row_bytes: int = ROW_BYTES) -> Plan:
    """The plan for the texts of ``docs``."""
    return plan(grouped(docs.select(text_key(text_col).alias("key"), text_size(text_col, row_bytes).alias("size"))), shards)


def sharded(docs: DataFrame, made: Plan, text_col: str = "text", shard_col: str = "shard") -> DataFrame:
    """``docs`` with the number of each row's shard; neither shuffled nor joined."""
    return docs.withColumn(shard_col, made.shard(text_key(text_col)))


def write(docs: DataFrame, made: Plan, path: str, text_col: str = "text", rows_a_file: int = 1_000_000) -> None:
    """``docs`` as Parquet in a folder for each shard, in files of so many rows at most; a shard is written by as many tasks as read it."""
    sharded(docs, made, text_col).write.option("maxRecordsPerFile", rows_a_file).partitionBy("shard").parquet(path)


def slots(rows: DataFrame, shard_col: str = "shard") -> DataFrame:
    """``rows`` numbered from 0 without gaps within each shard, as ``slot``.

    ``rows`` must be stored and hold ``row_id``, as ``monotonically_increasing_id`` gave it when they were written:
    rows are counted by the task that wrote them, so no shard is numbered by one task.
    """
    task = rows.withColumn("_task", F.shiftright("row_id", 33))
    counts = task.groupBy("_task", shard_col).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard_col).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    offsets = counts.select("_task", shard_col, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_task", shard_col).orderBy("row_id"))
    return task.withColumn("_own", own).join(offsets, ["_task", shard_col]).withColumn("slot", F.col("_before") + F.col("_own") - 1).drop("_task", "_own", "_before")


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = saved(docs.select("doc_id", text_size().alias("size"), crc.alias("text_crc32"), text_key().alias("key"), F.monotonically_increasing_id().alias("row_id")), "shard-rows")
    made = plan(grouped(rows))
    placed = slots(rows.withColumn("shard", made.shard(F.col("key"))))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
