"""Model features of daily segment totals.

Frames are positional (a device's rows in day order), and a frame that is not
full gives null.  All columns of one table share one window, so they cost one
shuffle and one sort.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ampflow.functions.calendar import jalali, saturday_of, target_day_columns
from ampflow.functions.numeric import finite, ratio, steps_within, total
from ampflow.schema import SEG

LAGS = (1, 2, 3, 4, 5, 6, 7, 14, 21, 30)
ROLLS = (3, 7, 14, 30)
HISTORY = 30
TARGETS = [f"target_{s}" for s in SEG]


def by_day(*keys: str, order: str = "day") -> WindowSpec:
    return Window.partitionBy(*(keys or ("device_id",))).orderBy(order)


def full(agg: Column, x: Column, w: WindowSpec, n: int) -> Column:
    """A frame's aggregate, null unless it holds ``n`` values."""
    return F.when(F.count(x).over(w) >= n, agg.over(w))


def lag_columns(lags: tuple[int, ...] = LAGS) -> dict[str, Column]:
    return {f"{s}_lag{k}": F.lag(s, k).over(by_day()) for s in SEG for k in lags}


def past_columns(most: int = max(ROLLS)) -> dict[str, Column]:
    """The ``most`` rows before, a column each, which ``rolling_columns`` reads: a sliding frame would go over them anew for each aggregate."""
    return {f"_{s}_{k}": F.lag(s, k).over(by_day()).cast("double") for s in SEG for k in range(1, most + 1)}


def rolling_columns(sizes: tuple[int, ...] = ROLLS) -> dict[str, Column]:
    """Mean and sample deviation of the rows before, from ``past_columns``; null unless there are as many.

    Deviations are summed from the row before, which is one of the frame, so that no digits cancel.
    """
    out = {}
    for s in SEG:
        last = F.col(f"_{s}_1")
        whole, away, squares = last, F.lit(0.0), F.lit(0.0)
        for k in range(2, max(sizes) + 1):
            x = F.col(f"_{s}_{k}")
            whole, away, squares = whole + x, away + (x - last), squares + (x - last) * (x - last)
            if k in sizes:
                var = (squares - away * away / k) / (k - 1)
                out[f"{s}_mean{k}"] = whole / k
                out[f"{s}_std{k}"] = F.sqrt(F.when(var < 0, 0.0).otherwise(var))
    return out


def rolling(daily: DataFrame, sizes: tuple[int, ...] = ROLLS) -> DataFrame:
    """device_id, day and ``rolling_columns``."""
    rows = daily.select("device_id", "day", *[c.alias(n) for n, c in past_columns(max(sizes)).items()])
    return rows.select("device_id", "day", *[c.alias(n) for n, c in rolling_columns(sizes).items()])


def trend_columns() -> dict[str, Column]:
    return {f"{s}_trend{k}": F.col(s) - F.lag(s, k).over(by_day()) for s in SEG for k in (1, 7)}


def profile_columns(least: int = HISTORY) -> dict[str, Column]:
    """A device's past as of the row: mean and population deviation of all rows before, ratios and shares."""
    w = by_day().rowsBetween(Window.unboundedPreceding, -1)
    mean = {s: full(F.avg(s), F.col(s), w, least) for s in SEG}
    out = {f"{s}_past_mean": mean[s] for s in SEG}
    out |= {f"{s}_past_std": full(F.stddev_pop(s), F.col(s), w, least) for s in SEG}
    whole = total(list(mean.values()))
    out["past_total"] = whole
    out["past_total_std"] = full(F.stddev_pop(total([F.col(s) for s in SEG])), F.col(SEG[0]), w, least)
    out["past_cv"] = ratio(out["past_total_std"], whole)
    out |= {f"{s}_to_past": ratio(F.col(s), mean[s]) for s in SEG}
    out |= {f"{s}_past_share": ratio(mean[s], whole) for s in SEG}
    return out


def calendar_columns() -> dict[str, Column]:
    return target_day_columns(F.col("day"))


def segment_time_columns(recent: int = 7) -> dict[str, Column]:
    """Tomorrow's cuts, how they move, and what density would give for them.

    ``density`` is a segment's use an hour; its mean is over ``recent`` rows up to today.
    """
    out = {}
    for s in SEG:
        start, hours = F.lead(f"{s}_start", 1).over(by_day()), F.lead(f"{s}_hours", 1).over(by_day())
        density = ratio(F.col(s), F.col(f"{s}_hours"))
        mean = full(F.avg(density), density, by_day().rowsBetween(-recent + 1, 0), recent)
        out |= {
            f"{s}_next_start": start,
            f"{s}_next_hours": hours,
            f"{s}_start_shift": start - F.col(f"{s}_start"),
            f"{s}_hours_shift": hours - F.col(f"{s}_hours"),
            f"{s}_density": density,
            f"{s}_density{recent}": mean,
            f"{s}_expected": density * hours,
            f"{s}_expected{recent}": mean * hours,
        }
    return out


def target_columns() -> dict[str, Column]:
    return {f"target_{s}": F.lead(s, 1).over(by_day()) for s in SEG}


def feature_columns(daily_columns: list[str]) -> list[str]:
    """The model's inputs among the columns of a feature table, in order."""
    return [c for c in daily_columns if c not in ("device_id", "day") and not c.startswith("target_seg")]


def build(daily: DataFrame, targets: bool = True, drop: bool = True, history: int = HISTORY) -> DataFrame:
    """All features of daily rows (with segment times); rows that lack one are dropped if ``drop``."""
    lags, rolls, past = lag_columns(), rolling_columns(), past_columns()
    rest = trend_columns() | profile_columns(history) | calendar_columns() | segment_time_columns()
    if targets:
        rest |= target_columns()
    out = daily.select("*", *[c.alias(name) for name, c in (lags | past | rest).items()])
    out = out.select(*daily.columns, *lags, *[c.alias(name) for name, c in rolls.items()], *rest)
    return clean(out) if drop else out


def clean(features: DataFrame) -> DataFrame:
    """Rows without nulls, NaN or infinities."""
    doubles = {f.name for f in features.schema if f.dataType.typeName() == "double"}
    return features.select(*[finite(F.col(c)).alias(c) if c in doubles else F.col(c) for c in features.columns]).dropna()


def split(features: DataFrame, train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """A ``part`` column: each device's rows in day order, first train, then valid, then test."""
    n = F.count("*").over(Window.partitionBy("device_id"))
    at = F.row_number().over(by_day())
    part = F.when(at <= F.floor(n * F.lit(train)), "train").when(at <= F.floor(n * F.lit(train + valid)), "valid").otherwise("test")
    return features.withColumn("part", part)


# Panel on a dense calendar --------------------------------------------------

PANEL_LAGS = (*range(1, 15), 21, 28)
PANEL_MEANS = (3, 7, 14, 28)
PANEL_STDS = (7, 14)


def dense(daily: DataFrame, keys: tuple[str, ...] = ("device_id",), reach: tuple[int, int] | None = None) -> DataFrame:
    """Every day from a device's first to its last; days without a row have nulls.

    With ``reach`` (after, before), only those so many days after a row or before
    the next.  Frames that look back ``after`` rows and ahead ``before`` see
    nothing but nulls across a longer gap, as on the whole calendar.  So a stray
    date costs a few rows however far it lies.
    """
    rows = daily.where("day is not null").withColumn("_g", F.datediff(F.lead("day").over(by_day(*keys)), F.col("day")))
    rows = rows.select("*", F.explode(steps_within(F.col("_g"), *(reach or (None, 0)))).alias("_j"))
    rest = [F.when(F.col("_j") == 0, F.col(c)).alias(c) for c in daily.columns if c not in (*keys, "day")]
    return rows.select(*keys, F.date_add("day", F.col("_j")).alias("day"), *rest)


def panel(daily: DataFrame, horizons: tuple[int, ...] = (1, 2, 3), normalize: bool = True) -> DataFrame:
    """A row a device and calendar day with the direct-forecast features of the day's total ``y``.

    Days further from readings than features and targets reach have no row: all of it would be null.
    lag1 is the day itself; a day that lacks a segment has no total.  Shares are
    those of the segments in the total, a quarter each where it is zero.  With
    ``normalize`` levels are in units of the mean of 28 days (``scale``), whose
    log is a feature.  ``ready`` rows have all features, ``usable`` ones all targets too.
    """
    rows = dense(daily.select("device_id", "day", *SEG), reach=(max(PANEL_LAGS), max(horizons, default=0))).withColumn("y", total([F.col(s) for s in SEG]))
    w = by_day()
    y, out = F.col("y"), {}
    for k in PANEL_LAGS:
        out[f"lag{k}"] = F.lag(y, k - 1).over(w)
    for n in PANEL_MEANS:
        out[f"mean{n}"] = full(F.avg(y), y, w.rowsBetween(1 - n, 0), n)
    for n in PANEL_STDS:
        out[f"std{n}"] = full(F.stddev_samp(y), y, w.rowsBetween(1 - n, 0), n)
    for s in SEG:
        share = F.when(y == 0, F.lit(0.25)).otherwise(F.col(s) / F.when(y > 0, y))
        out[f"share_{s}"] = share
        out[f"share7_{s}"] = full(F.avg(share), share, w.rowsBetween(-6, 0), 7)
    inputs = list(out)
    for h in horizons:
        out[f"target{h}"] = F.lead(y, h).over(w)
    rows = rows.select("device_id", "day", "y", *[c.alias(n) for n, c in out.items()]).withColumn("scale", F.col("mean28") if normalize else F.lit(1.0))
    rows = rows.withColumn("ready", F.coalesce(total([F.col(c) for c in inputs]).isNotNull() & (F.col("scale") > 1e-9), F.lit(False)))
    rows = rows.withColumn("usable", F.col("ready") & total([F.col(f"target{h}") for h in horizons]).isNotNull())
    if normalize:
        unit = F.when(F.col("scale") > 1e-9, F.col("scale"))
        rows = rows.withColumn("log_scale", F.log1p("scale")).withColumns({c: F.col(c) / unit for c in inputs if not c.startswith("share")})
    return rows


def horizon_frame(panel_rows: DataFrame, h: int) -> DataFrame:
    """Ready rows with a target ``h`` days on: flags of its weekday, the target, and the naive forecast (its day a week before)."""
    day = F.date_add("day", h)
    rows = panel_rows.where(F.col("ready") & F.col(f"target{h}").isNotNull())
    out = rows.withColumn("target_day", day).withColumns({f"dow{d}": (F.weekday(day) == d).cast("int") for d in range(7)}).withColumn("is_weekend", (F.weekday(day) >= 5).cast("int"))
    return out.withColumn("target", F.col(f"target{h}")).withColumn("target_ratio", F.col("target") / F.col("scale")).withColumn("naive", F.col(f"lag{8 - h}") * F.col("scale"))


def horizon_frames(panel_rows: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """``horizon_frame`` of all ``horizons`` in one, with a column ``horizon``: each row read once, and once more for each horizon it has a target for."""
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.date_add("day", h).alias("target_day"), F.col(f"target{h}").alias("target"), (F.col(f"lag{8 - h}") * F.col("scale")).alias("naive")) for h in horizons])
    rows = panel_rows.where("ready").select("*", F.inline(F.filter(each, lambda x: x["target"].isNotNull())))
    flags = {f"dow{d}": (F.weekday("target_day") == d).cast("int") for d in range(7)}
    return rows.withColumns(flags | {"is_weekend": (F.weekday("target_day") >= 5).cast("int"), "target_ratio": F.col("target") / F.col("scale")})


def panel_inputs(frame: DataFrame) -> list[str]:
    """The model's inputs among the columns of a horizon frame, in order."""
    return [c for c in frame.columns if re.fullmatch(r"(lag|mean|std|dow)\d+|share7?_seg\d|log_scale|is_weekend", c)]


def cutoff(usable: DataFrame, test_share: float = 0.2) -> DataFrame:
    """One row, the day that parts train from test: of n usable days the one at floor(n (1 - share)), inside [1, n - 1]."""
    days = usable.select("day").distinct()
    n = days.count()
    at = min(max(int(n * (1 - test_share) + 1e-9), 1), max(n - 1, 1))
    ranked = days.withColumn("_i", F.row_number().over(Window.orderBy("day")) - 1)  # distinct days only
    return ranked.where(F.col("_i") == at).select(F.col("day").alias("cutoff"))


def parted(frame: DataFrame, cut: DataFrame) -> DataFrame:
    """A ``part`` column: train if the target day is not after the cutoff, test if the day is not before it; others go."""
    part = F.when(F.col("target_day") <= F.col("cutoff"), "train").when(F.col("day") >= F.col("cutoff"), "test")
    return frame.crossJoin(F.broadcast(cut)).withColumn("part", part).where("part is not null").drop("cutoff")  # one row


# Weeks and months ---------------------------------------------------------


def daily_totals(daily: DataFrame) -> DataFrame:
    return daily.groupBy("device_id", "day").agg(F.sum(total([F.col(s) for s in SEG])).alias("use"))


def _periods(totals: DataFrame, start: Column, whole: Column | int) -> DataFrame:
    sums = totals.groupBy("device_id", start.alias("start")).agg(F.sum("use").alias("use"), F.count_distinct("day").alias("days"))
    return sums.where(F.col("days") >= whole)


def _lagged(rows: DataFrame, means: tuple[int, ...], std: int, trends: dict[str, int], inclusive: bool = False) -> DataFrame:
    """Features of periods from those before: the last, means, deviation, trends, and running extremes.

    Means and the deviation take what there is if fewer periods are known.  A
    trend is the last use less that of so many periods back (1: the last), 0 if unknown.
    With ``inclusive`` the frame ends with the row itself: features of the period after it.
    """
    w = by_day("device_id", order="start")
    end = 0 if inclusive else -1
    past = w.rowsBetween(Window.unboundedPreceding, end)
    last = lambda n: w.rowsBetween(end - n + 1, end)
    lag = lambda k: F.lag("use", k - 1 - end).over(w) if k - 1 - end else F.col("use")
    out = {"prev1": lag(1)} | {f"mean{n}": F.avg("use").over(last(n)) for n in means}
    out[f"std{std}"] = F.stddev_pop("use").over(last(std))
    out |= {name: F.coalesce(lag(1) - lag(k), F.lit(0.0)) for name, k in trends.items()}
    out |= {"past_min": F.min("use").over(past), "past_max": F.max("use").over(past), "past_mean": F.avg("use").over(past), "n_hist": F.count("use").over(past)}
    return rows.withColumns(out)


#: Periods that features look back on: means, the deviation, trends.
WEEKS = ((2, 4, 8), 4, {"trend2": 2, "trend4": 4})
MONTHS = ((2, 3, 6, 12), 3, {"trend1": 2, "trend3": 3})


def weekly(daily: DataFrame, days: int = 7, least: int = 2) -> DataFrame:
    """A row a device and whole Saturday week: its use and features of the weeks before."""
    rows = _lagged(_periods(daily_totals(daily), saturday_of(F.col("day")), days), *WEEKS)
    return rows.where(F.col("n_hist") >= least).withColumn("month", F.month("start")).withColumn("week", F.weekofyear("start"))


def monthly(daily: DataFrame, days: int = 20, least: int = 2, solar: bool = False) -> DataFrame:
    """A row a device and month of ``days`` days or more: its use and features of the months before.

    Months are Gregorian, or Jalali with ``solar``.
    """
    rows = _lagged(_periods(daily_totals(daily), month_start(solar), days), *MONTHS)
    month = jalali(F.col("start"))["jm"] if solar else F.month("start")
    return rows.where(F.col("n_hist") >= least).withColumn("month", month)


def month_start(solar: bool = False) -> Column:
    day = F.col("day")
    return F.date_sub(day, jalali(day)["jd"] - 1) if solar else F.trunc(day, "month")


def latest_period(daily: DataFrame, before: Column, solar_month: bool | None = None) -> DataFrame:
    """Inference: features from all periods before ``before``, part ones too; a row a device.

    Weeks by default; months if ``solar_month`` is given.
    """
    start = saturday_of(F.col("day")) if solar_month is None else month_start(solar_month)
    rows = _periods(daily_totals(daily.where(F.col("day") < before)), start, 1)
    rows = _lagged(rows, *(WEEKS if solar_month is None else MONTHS), inclusive=True)
    last = F.row_number().over(Window.partitionBy("device_id").orderBy(F.desc("start")))
    return rows.withColumn("_n", last).where("_n = 1 and n_hist >= 2").drop("_n")


def period_total(daily: DataFrame, start: Column, end: Column) -> DataFrame:
    """device_id, use: the total of [start, end], null if a day of it is missing."""
    rows = daily_totals(daily).where(F.col("day").between(start, end))
    n = F.datediff(end, start) + 1
    return rows.groupBy("device_id").agg(F.when(F.count_distinct("day") == F.first(n), F.sum("use")).alias("use"))
