"""Positions and quantiles over all rows without a task that sees them all.

Rows are dealt out by range and stored, each range is numbered by itself, and
the ranges' sizes (a row a range) give the offsets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ampflow.sources.sinks import settled


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """``df`` with 1, 2, ... in the order of columns whose values are distinct rows."""
    rows = settled(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes, before, offsets = rows.groupBy("_p").count().orderBy("_p").collect(), 0, []  # a row a range
    for r in sizes:
        offsets.append((r["_p"], before))
        before += r["count"]
    starts = df.sparkSession.createDataFrame(offsets, "_p int, _before long")
    at = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return rows.withColumn("_at", at).join(F.broadcast(starts), "_p").withColumn(name, F.col("_at") + F.col("_before")).drop("_p", "_at", "_before")


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of each column, by linear interpolation; null (and NaN) values do not count.

    Equal values are counted before anything is dealt out, so that a frequent one is no hot range.
    """
    each = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    counts = df.select(F.inline(each)).where("v is not null and not isnan(v)").groupBy("c", "v").agg(F.count("*").alias("n"))
    rows = settled(counts.repartitionByRange("c", "v").withColumn("_p", F.spark_partition_id()), "quantiles")
    sizes = rows.groupBy("c", "_p").agg(F.sum("n").alias("n")).orderBy("c", "_p").collect()  # a row a range and column
    total = {i: 0 for i in range(len(columns))}
    for r in sizes:
        total[r.c] += r.n
    wanted, before = [], dict.fromkeys(total, 0)
    places = {c: sorted({f(q * (n - 1)) for q in shares for f in (math.floor, math.ceil)}) for c, n in total.items() if n}
    for r in sizes:
        wanted += [(r.c, r["_p"], k - before[r.c], k) for k in places[r.c] if before[r.c] <= k < before[r.c] + r.n]
        before[r.c] += r.n
    if not wanted:
        return {c: [None] * len(shares) for c in columns}
    upto = F.sum("n").over(Window.partitionBy("c", "_p").orderBy("v"))
    ask = F.broadcast(df.sparkSession.createDataFrame(wanted, "c int, _p int, k long, at long"))  # two a share and column
    hits = rows.withColumn("_u", upto).join(ask, ["c", "_p"]).where((F.col("k") < F.col("_u")) & (F.col("k") >= F.col("_u") - F.col("n"))).collect()
    value = {(r.c, r.at): r.v for r in hits}

    def pick(i: int, q: float) -> float | None:
        if not total[i]:
            return None
        at = q * (total[i] - 1)
        low, high = value[i, math.floor(at)], value[i, math.ceil(at)]
        return low + (high - low) * (at - math.floor(at))

    return {c: [pick(i, q) for q in shares] for i, c in enumerate(columns)}
