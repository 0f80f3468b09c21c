"""Half-hourly household files to clean hourly readings: scan, choose, collect, filter, check."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ampflow.functions.numeric import correlation
from ampflow.functions.ranks import quantiles

COVERAGE, MAX_GAP, MAX_KWH = 0.97, 6, 25.0
WINDOW_MONTHS = (6, 9, 12)


def kwh(column: str) -> Column:
    """A padded number; null for anything else."""
    return F.expr(f"try_cast(trim({column}) as double)")


def months_of(first: str, last: str) -> list[str]:
    """yyyy-MM of all months from ``first`` to ``last``."""
    y, m = map(int, first.split("-"))
    out = []
    while f"{y:04d}-{m:02d}" <= last:
        out.append(f"{y:04d}-{m:02d}")
        y, m = (y, m + 1) if m < 12 else (y + 1, 1)
    return out


def month_bounds(first: str, last: str) -> tuple[date, date]:
    """The half-open range of days of the months ``first`` to ``last``."""
    y, m = map(int, last.split("-"))
    return date.fromisoformat(f"{first}-01"), date(y + m // 12, m % 12 + 1, 1)


def scan(half_hours: DataFrame) -> DataFrame:
    """household, month, n_rows, n_valid, n_std, n_other: one aggregation over all files."""
    month = F.substring("stamp", 1, 7)
    rows = half_hours.withColumn("month", month).where(F.col("month").rlike(r"^\d{4}-(0[1-9]|1[0-2])$"))
    std = F.lower(F.trim("tariff")) == "std"
    return rows.groupBy("household", "month").agg(F.count("*").alias("n_rows"), F.count_if(kwh("kwh") >= 0).alias("n_valid"), F.count_if(std).alias("n_std"), F.count_if(~std).alias("n_other"))


def households(scanned: DataFrame, months: list[str], expected: int) -> DataFrame:
    """household, std_only, coverage of the months (1 at most)."""
    inside = F.col("month").isin(months)
    sums = scanned.groupBy("household").agg(F.sum("n_std").alias("std"), F.sum("n_other").alias("other"), F.sum(F.when(inside, F.col("n_valid")).otherwise(0)).alias("valid"))
    return sums.select("household", ((F.col("other") == 0) & (F.col("std") > 0)).alias("std_only"), F.least(F.col("valid") / F.lit(float(expected)), F.lit(1.0)).alias("coverage"))


def windows(scanned: DataFrame, least: float = COVERAGE, sizes: tuple[int, ...] = WINDOW_MONTHS, top: int = 3) -> DataFrame:
    """size, start, homes: the ``top`` runs of months with the most households of enough coverage.

    A household's month is read once per window that holds it, by explode; the
    windows are no more than the months.
    """
    ends = scanned.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    first = F.to_date(F.concat("month", F.lit("-01")))
    rows = scanned.select("household", first.alias("m"), "n_valid").crossJoin(F.broadcast(ends))  # one row
    a, b = F.to_date(F.concat("a", F.lit("-01"))), F.to_date(F.concat("b", F.lit("-01")))
    each = rows.withColumn("size", F.explode(F.lit(list(sizes)))).withColumn("back", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    start = F.add_months("m", -F.col("back"))
    inside = each.withColumn("start", start).where((start >= a) & (F.add_months(start, F.col("size") - 1) <= b))
    per_home = inside.groupBy("size", "start", "household").agg(F.sum("n_valid").alias("valid")).withColumn("slots", 48 * F.datediff(F.add_months("start", F.col("size")), F.col("start")))
    homes = per_home.where(F.col("valid") >= F.lit(least) * F.col("slots")).groupBy("size", "start").agg(F.count("*").alias("homes"))
    rank = F.row_number().over(Window.partitionBy("size").orderBy(F.desc("homes"), "start"))
    return homes.withColumn("rank", rank).where(F.col("rank") <= top).select("size", F.date_format("start", "yyyy-MM").alias("start"), "homes", "rank")


def choose(table: DataFrame, least: float, wanted: int, oversample: float = 1.3, seed: int = 42) -> DataFrame:
    """Households on one tariff with enough coverage: ceil(wanted * oversample) of them, by a seeded hash."""
    n = -int(-wanted * oversample // 1)
    fit = table.where(F.col("std_only") & (F.col("coverage") >= least))
    return fit.orderBy(F.xxhash64("household", F.lit(seed)), "household").limit(n)


def _readings(half_hours: DataFrame, first: date, end: date) -> DataFrame:
    """household (trimmed), at (its row's place, by ``order`` if there is one), stamp, value; flags of what is wrong with a row."""
    place = F.col("order") if "order" in half_hours.columns else F.monotonically_increasing_id()
    rows = half_hours.select(F.trim("household").alias("household"), place.alias("at"), F.try_to_timestamp(F.substring("stamp", 1, 19)).alias("stamp"), kwh("kwh").alias("value"))
    inside = F.coalesce((F.col("stamp") >= F.lit(first)) & (F.col("stamp") < F.lit(end)), F.lit(False))
    return rows.withColumn("inside", inside).withColumn("good", inside & F.coalesce(F.col("value") >= 0, F.lit(False)))


def _slots(rows: DataFrame) -> DataFrame:
    """Of good rows the first of each household and stamp; ``rows`` counts them."""
    return rows.where("good").groupBy("household", "stamp").agg(F.min_by("value", "at").alias("kwh"), F.count("*").alias("rows"))


def hourly(half_hours: DataFrame, first: date, end: date) -> DataFrame:
    """household, ts, kwh: hours with exactly two valid half-hours, inside [first, end).

    Of rows that repeat a household's stamp the first counts, in the order of ``order`` or as read.
    """
    sums = _slots(_readings(half_hours, first, end)).groupBy("household", F.date_trunc("hour", "stamp").alias("ts")).agg(F.sum("kwh").alias("kwh"), F.count("*").alias("n"))
    return sums.where("n = 2").drop("n")


def collect_counts(half_hours: DataFrame, first: date, end: date) -> DataFrame:
    """One row: what ``hourly`` met and left out."""
    rows = _readings(half_hours, first, end)
    seen = rows.agg(
        F.count("*").alias("rows_selected_homes"),
        F.count_if(F.col("stamp").isNull()).alias("rows_bad_timestamp"),
        F.count_if("inside").alias("rows_in_window"),
        F.count_if(F.col("inside") & F.col("value").isNull()).alias("rows_null_kwh"),
        F.count_if(F.col("inside") & (F.col("value") < 0)).alias("rows_negative_kwh"),
        F.count_if(F.col("good") & ~F.minute("stamp").isin(0, 30)).alias("rows_off_grid_minute"),
    )
    hours = _slots(rows).groupBy("household", F.date_trunc("hour", "stamp").alias("ts")).agg(F.count("*").alias("n"), F.sum(F.col("rows") - 1).alias("again"))
    later = hours.agg(
        F.coalesce(F.sum("again"), F.lit(0)).alias("rows_duplicate"),
        F.count("*").alias("hours_seen"),
        F.count_if(F.col("n") == 1).alias("hours_one_half_hour_only"),
        F.count_if(F.col("n") > 2).alias("hours_more_than_two_readings"),
    )
    return seen.crossJoin(F.broadcast(later))  # one row each


def longest_gap(rows: DataFrame, index: Column, slots: int, *keys: str) -> DataFrame:
    """``keys``, present, longest_gap: the longest run of missing slots among 0 .. slots - 1, ends included."""
    seen = rows.select(*keys, index.alias("_i")).where(F.col("_i").between(0, slots - 1)).distinct()
    gap = F.col("_i") - F.lag("_i", 1, -1).over(Window.partitionBy(*keys).orderBy("_i")) - 1
    return seen.withColumn("_g", gap).groupBy(*keys).agg(F.count("*").alias("present"), F.greatest(F.max("_g"), slots - 1 - F.max("_i")).cast("long").alias("longest_gap"))


def quality_table(hours: DataFrame, first: date, end: date, least: float = COVERAGE, gap: int = MAX_GAP, most: float = MAX_KWH) -> DataFrame:
    """household, hourly_coverage, max_gap_hours, n_hours, pass_coverage, pass_gap, keep; hours above ``most`` do not count."""
    slots = (end - first).days * 24
    at = F.expr(f"cast((unix_timestamp(cast(ts as timestamp)) - unix_timestamp(timestamp'{first}')) / 3600 as int)")
    runs = longest_gap(hours.where(F.col("kwh") <= most), at, slots, "household")
    out = runs.select("household", (F.col("present") / slots).alias("hourly_coverage"), F.col("longest_gap").alias("max_gap_hours"), F.col("present").alias("n_hours"))
    return out.withColumn("pass_coverage", F.col("hourly_coverage") >= least).withColumn("pass_gap", F.col("max_gap_hours") <= gap).withColumn("keep", F.col("pass_coverage") & F.col("pass_gap"))


def quality_counts(hours: DataFrame, table: DataFrame, most: float = MAX_KWH) -> DataFrame:
    """One row: hours dropped for their size, homes that fail by coverage and by gap, homes kept."""
    homes = table.agg(F.count_if(~F.col("pass_coverage")).alias("homes_failed_hourly_coverage"), F.count_if(~F.col("pass_gap")).alias("homes_failed_max_gap"), F.count_if("keep").alias("households_kept"))
    return hours.agg(F.count_if(F.col("kwh") > most).alias("hours_above_max_kwh_dropped")).crossJoin(F.broadcast(homes))  # one row each


def quality(hours: DataFrame, first: date, end: date, least: float = COVERAGE, gap: int = MAX_GAP, most: float = MAX_KWH) -> DataFrame:
    """Hours of households with enough coverage and no long gap; hours above ``most`` are dropped first."""
    fit = quality_table(hours, first, end, least, gap, most).where("keep").select("household")
    return hours.where(F.col("kwh") <= most).join(fit, "household", "left_semi")


def to_wall_clock(hours: DataFrame, zone: str, key: str = "household") -> DataFrame:
    """UTC to local time; the hour that the clock shows twice is averaged."""
    return hours.groupBy(key, F.from_utc_timestamp("ts", zone).alias("ts")).agg(F.avg("kwh").alias("kwh"))


def dst_signature(hours: DataFrame, key: str = "household") -> DataFrame:
    """day, usual_rows: days on which under half of the homes have 24 rows, and the usual count there."""
    counts = hours.groupBy(key, F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    days = counts.groupBy("day").agg(F.avg((F.col("n") == 24).cast("int")).alias("full"), F.mode("n", True).alias("usual_rows"))
    return days.where("full < 0.5").select("day", "usual_rows")


def sanity(hours: DataFrame, key: str = "household") -> DataFrame:
    """One row: homes, rows, range, median, 99th percentile, share of zeros, quartiles of the homes' means."""
    q = quantiles(hours, ["kwh"], [0.5, 0.99])["kwh"]
    whole = hours.agg(F.count_distinct(key).alias("homes"), F.count("*").alias("rows"), F.min("kwh").alias("min"), F.max("kwh").alias("max"), F.lit(q[0]).cast("double").alias("median"), F.lit(q[1]).cast("double").alias("p99"), F.avg((F.col("kwh") == 0).cast("int")).alias("zero_share"))
    spread = quantiles(hours.groupBy(key).agg(F.avg("kwh").alias("m")), ["m"], [0.25, 0.5, 0.75])["m"]
    return whole.select("*", *[F.lit(x).cast("double").alias(n) for x, n in zip(spread, ("home_q1", "home_median", "home_q3"))])


def season_shift(readings: DataFrame, winter: tuple[int, ...] = (12, 1, 2), summer: tuple[int, ...] = (6, 7, 8), shifts: tuple[int, ...] = (-2, -1, 0, 1, 2)) -> DataFrame:
    """shift, corr: correlation of the winter weekday profile with the summer one moved by so many hours."""
    rows = readings.where(F.weekday("ts") < 5).select(F.month("ts").alias("m"), F.hour("ts").alias("hour"), "kwh")
    profile = rows.groupBy("hour").agg(F.avg(F.when(F.col("m").isin(*winter), F.col("kwh"))).alias("w"), F.avg(F.when(F.col("m").isin(*summer), F.col("kwh"))).alias("s"))
    moved = profile.select(F.col("hour"), "s", F.explode(F.lit(list(shifts))).alias("shift")).select("shift", F.pmod(F.col("hour") + F.col("shift"), F.lit(24)).alias("hour"), "s")
    return moved.join(profile.select("hour", "w"), "hour").groupBy("shift").agg(correlation(F.col("w"), F.col("s")).alias("corr"))


def clock_verdict(readings: DataFrame, margin: float = 0.005, **kw) -> str:
    """UTC_LIKE if summer habits come an hour early, LOCAL_LIKE if they keep their hour, else INCONCLUSIVE."""
    corr = {r.shift: r["corr"] for r in season_shift(readings, **kw).collect()}  # a row a shift
    if not corr:
        return "INCONCLUSIVE"
    best = max(corr, key=corr.get)
    second = max((v for k, v in corr.items() if k != best), default=-1.0)
    if corr[best] - second < margin:
        return "INCONCLUSIVE"
    return {1: "UTC_LIKE", 0: "LOCAL_LIKE"}.get(best, "INCONCLUSIVE")


def prepare(half_hours: DataFrame, first_month: str, last_month: str, wanted: int, least: float = COVERAGE, zone: str | None = None, **limits) -> DataFrame:
    """device_id, ts, kwh: the whole preparation, as one plan over the files (the scan is cached)."""
    from ampflow.sources.readers import household_ids

    first, end = month_bounds(first_month, last_month)
    scanned = scan(half_hours).cache()
    table = households(scanned, months_of(first_month, last_month), 48 * (end - first).days)
    picked = choose(table, least, wanted).select("household")
    clean = quality(hourly(half_hours.join(picked, "household", "left_semi"), first, end), first, end, least, **limits)
    if zone:
        clean = to_wall_clock(clean, zone)
    return household_ids(clean).select("device_id", "ts", F.round("kwh", 3).alias("kwh"))
