"""A day in four segments of 4 to 7 hours: where to cut it.

A cut is (b1, b2, b3), the first hours of the second, third and fourth segment.
There are 31; searches score all of them for every profile, as expressions over
an array of 24 hours, so that no row is multiplied.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ampflow.functions.numeric import let
from ampflow.schema import HOURS, SEG, SEGMENTS, check
from ampflow.sources.sinks import settled

SHORTEST, LONGEST, DAY = 4, 7, 24
DECAY = 0.97
#: Agreement of days where there is no vote.
NO_VOTE = 0.5
WINDOW_DAYS = 30

CUTS = [
    (a, a + b, a + b + c)
    for a in range(SHORTEST, LONGEST + 1)
    for b in range(SHORTEST, LONGEST + 1)
    for c in range(SHORTEST, LONGEST + 1)
    if SHORTEST <= DAY - a - b - c <= LONGEST
]
#: Hours that can open a segment.
OPENERS = sorted({h for cut in CUTS for h in cut})


def cut_struct(cut: tuple[int, int, int]) -> Column:
    return F.struct(*[F.lit(h).alias(f"b{i + 1}") for i, h in enumerate(cut)])


def segment_of(hour: Column, b1: Column, b2: Column, b3: Column) -> Column:
    """The segment of an hour, by arithmetic rather than a range join."""
    return (hour >= b1).cast("int") + (hour >= b2).cast("int") + (hour >= b3).cast("int")


def segment_columns(b1: Column, b2: Column, b3: Column) -> dict[str, Column]:
    """seg{k}_start and seg{k}_hours."""
    starts = [F.lit(0), b1, b2, b3, F.lit(DAY)]
    out = {f"{s}_start": starts[k].cast("int") for k, s in enumerate(SEG)}
    return out | {f"{s}_hours": (starts[k + 1] - starts[k]).cast("int") for k, s in enumerate(SEG)}


def check_cuts(rows: DataFrame, cut: str = "cut") -> DataFrame:
    """``rows``, if every cut gives four segments of ``SHORTEST`` to ``LONGEST`` hours."""
    edges = [F.lit(0), *[F.col(f"{cut}.b{i}") for i in (1, 2, 3)], F.lit(DAY)]
    fits = [(b - a).between(SHORTEST, LONGEST) for a, b in zip(edges, edges[1:])]
    return check(rows, bad_cut=~F.coalesce(fits[0] & fits[1] & fits[2] & fits[3], F.lit(False)))


def held(array: Column) -> Column:
    """An array as one value: later uses of its items do not copy the expressions behind them."""
    return F.transform(array, lambda x: x)


# Profiles ---------------------------------------------------------------


def hour_arrays(readings: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and v, an array of 24: the mean reading of each hour, null where there is none."""
    hourly = readings.groupBy(*keys, F.hour("ts").alias("hour")).agg(F.avg("kwh").alias("kwh"))
    each = hourly.groupBy(*keys).agg(*[F.max(F.when(F.col("hour") == h, F.col("kwh"))).alias(f"h{h}") for h in HOURS])
    return each.select(*keys, F.array(*[f"h{h}" for h in HOURS]).alias("v"))


def day_arrays(readings: DataFrame) -> DataFrame:
    """device_id, day, v."""
    return hour_arrays(readings.withColumn("day", F.to_date("ts")), ["device_id", "day"])


def mean_profile(readings: DataFrame) -> DataFrame:
    """device_id, v: the mean of each hour; hours without readings get the mean of the rest."""
    return hour_arrays(readings, ["device_id"]).withColumn("v", gaps_to_mean(F.col("v")))


def gaps_to_mean(v: Column) -> Column:
    """An array with the mean of its values in place of nulls."""
    known = lambda x: F.filter(x, lambda y: y.isNotNull())
    mean = lambda k: F.aggregate(k, F.lit(0.0), lambda a, y: a + y) / F.when(F.size(k) > 0, F.size(k))
    return let(v, lambda x: let(let(known(x), mean), lambda m: F.transform(x, lambda y: F.coalesce(y, m))))


def weighted_profile(readings: DataFrame, decay: float = DECAY) -> DataFrame:
    """device_id, hour, kwh: of each hour, the lower weighted median over days; later days weigh more.

    A device of one day gets that day.  Hours without readings get the mean of the others.
    """
    hourly = readings.groupBy("device_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.avg("kwh").alias("kwh"))
    rank = F.dense_rank().over(Window.partitionBy("device_id").orderBy(F.desc("day")))
    weighed = hourly.withColumn("w", F.pow(F.lit(decay), rank - 1))
    one = Window.partitionBy("device_id", "hour")
    running = F.sum("w").over(one.orderBy("kwh", "day"))
    half = F.sum("w").over(one) * 0.5
    rows = weighed.where("kwh is not null").withColumn("_run", running).withColumn("_half", half)
    medians = rows.where(F.col("_run") >= F.col("_half")).groupBy("device_id", "hour").agg(F.min("kwh").alias("kwh"))
    hours = medians.select("device_id").distinct().withColumn("hour", F.explode(F.lit([*HOURS])))
    full = hours.join(medians, ["device_id", "hour"], "left")
    return full.withColumn("kwh", F.coalesce("kwh", F.avg("kwh").over(Window.partitionBy("device_id"))))


def smoothed(v: Column) -> Column:
    """Centred mean of three hours; of two at either end."""
    at = lambda i: v[i]
    parts = []
    for h in HOURS:
        near = [at(i) for i in (h - 1, h, h + 1) if 0 <= i < DAY]
        parts.append(sum(near[1:], near[0]) / len(near))
    return F.array(*parts)


def peak_hour(v: Column) -> Column:
    """The first hour of the largest value."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


# Jenks ---------------------------------------------------------------------


def prefix(v: Column) -> Column:
    """Sums of the first 0 .. 24 values."""
    start = F.array(F.lit(0.0))
    return F.aggregate(v, start, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def _bounds(cut: tuple[int, int, int]) -> list[tuple[int, int]]:
    edges = [0, *cut, DAY]
    return list(zip(edges, edges[1:]))


def jenks(profiles: DataFrame, v: str = "v") -> DataFrame:
    """``profiles`` with cut and sse: the cut of the least squared error within segments.

    Of equal errors (to 9 digits) the one with the largest b3 wins, then b2, then b1.
    """
    rows = profiles.withColumn("_s", prefix(F.col(v))).withColumn("_q", prefix(F.transform(v, lambda x: x * x)))

    def sse(a: int, b: int) -> Column:
        s, q = F.col("_s")[b] - F.col("_s")[a], F.col("_q")[b] - F.col("_q")[a]
        return q - s * s / (b - a)

    parts = sorted({p for cut in CUTS for p in _bounds(cut)})
    rows = rows.withColumn("_p", held(F.array(*[sse(a, b) for a, b in parts])))
    scored = []
    for cut in CUTS:
        cost = [F.col("_p")[parts.index(p)] for p in _bounds(cut)]
        scored.append(F.struct(F.round(sum(cost[1:], cost[0]), 9).alias("sse"), *[F.lit(-h).alias(f"n{3 - i}") for i, h in enumerate(reversed(cut))], cut_struct(cut).alias("cut")))
    best = F.array_min(F.array(*scored))
    return rows.withColumn("_b", best).withColumn("cut", F.col("_b.cut")).withColumn("sse", F.col("_b.sse")).drop("_s", "_q", "_p", "_b")


def segment_totals(days: DataFrame, v: str = "v", cut: str = "cut", digits: int = 3) -> DataFrame:
    """seg0 .. seg3 of day arrays (null hours count nothing), with start and hours of each."""
    b = [F.col(f"{cut}.b{i}") for i in (1, 2, 3)]
    edges = [F.lit(0), *b, F.lit(DAY)]
    sums = {s: F.round(F.aggregate(F.slice(v, edges[k] + 1, edges[k + 1] - edges[k]), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), digits) for k, s in enumerate(SEG)}
    return days.withColumns(sums | segment_columns(*b))


def jenks_daily(readings: DataFrame, train_share: float = 0.8) -> DataFrame:
    """Daily totals by one frozen cut a device: Jenks on the mean profile of its first ``train_share`` of days."""
    days = day_arrays(readings)
    by = Window.partitionBy("device_id")
    placed = days.withColumn("_i", F.row_number().over(by.orderBy("day"))).withColumn("_n", F.count("*").over(by))
    first = placed.where(F.col("_i") <= F.greatest(F.floor(F.col("_n") * train_share), F.lit(1)))
    means = first.groupBy("device_id").agg(F.array(*[F.avg(F.coalesce(F.col("v")[h], F.lit(0.0))) for h in HOURS]).alias("p"))
    cuts = jenks(means, "p").select("device_id", "cut")
    return segment_totals(days.join(cuts, "device_id")).drop("v", "cut")


def rolling_jenks_daily(readings: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Daily totals by a cut a day: Jenks on the mean profile of the ``window_days`` days before it (as many rows)."""
    days = day_arrays(readings)
    before = Window.partitionBy("device_id").orderBy("day").rowsBetween(-window_days, -1)
    means = F.array(*[F.avg(F.coalesce(F.col("v")[h], F.lit(0.0))).over(before) for h in HOURS])
    rows = days.withColumn("p", means).withColumn("_n", F.count("*").over(before)).where(F.col("_n") == window_days)
    return segment_totals(jenks(rows, "p")).drop("v", "p", "cut", "sse", "_n")


# Adaptive cuts ---------------------------------------------------------------


def noise_scale(v: Column) -> Column:
    """Median size of the second difference, with floors from the range; nulls are left out."""

    def scale(x: Column) -> Column:
        second = F.transform(F.sequence(F.lit(1), F.lit(DAY - 2)), lambda i: F.abs(F.get(x, i + 1) - 2 * F.get(x, i) + F.get(x, i - 1)))
        spread = F.array_max(x) - F.array_min(x)
        return let(F.array_sort(F.filter(second, lambda d: d.isNotNull())), lambda o: F.greatest(F.coalesce(middle(o), F.lit(0.0)), spread * 1e-3, F.lit(1e-6)))

    def middle(o: Column) -> Column:
        n = F.size(o)
        return (F.get(o, F.floor((n - 1) / 2).cast("int")) + F.get(o, F.floor(n / 2).cast("int"))) / 2

    return let(v, scale)


def _side(v: Column, a: int, b: int) -> Column:
    """Mean of the hours [a, b); null if one is missing."""
    return sum([v[i] for i in range(a + 1, b)], v[a]) / (b - a)


def _slope(v: Column, a: int, b: int) -> Column:
    return (v[b - 1] - v[a]) / (b - a - 1) if b - a > 1 else F.lit(0.0)


def change_strength(v: Column, noise: Column) -> Column:
    """For hours 1 .. 23: change of level and slope between the three hours before and after, in noise units."""
    parts = []
    for b in range(1, DAY):
        lo, hi = max(0, b - 3), min(DAY, b + 3)
        parts.append((F.abs(_side(v, b, hi) - _side(v, lo, b)) + F.abs(_slope(v, b, hi) - _slope(v, lo, b))) / noise)
    return F.array(*parts)


def persistence(days: DataFrame, keys: list[str], weight: str = "w", v: str = "v") -> DataFrame:
    """``keys`` and agreement, an array for hours 1 .. 23: how far days agree on the direction of a change.

    ``days`` has day arrays and their weights.  Without a vote (keys of one day,
    no direction, no strength) agreement is a half.  A day that lacks an hour on either side of a change has no vote on it.
    """
    col = F.col(v)
    rows = days.withColumn("_noise", noise_scale(col))
    diffs = F.array(*[_side(col, b, min(DAY, b + 3)) - _side(col, max(0, b - 3), b) for b in range(1, DAY)])
    each = rows.select(*keys, F.col(weight).alias("_w"), "_noise", F.posexplode(diffs).alias("_at", "_d"))
    both = Window.partitionBy(*keys, "_at")
    mean = F.sum(F.col("_w") * F.col("_d")).over(both)
    each = each.withColumn("_sign", F.signum(F.round(mean, 12))).withColumn("_m", F.when(F.col("_d").isNotNull(), F.col("_w") * F.least(F.abs("_d") / F.col("_noise"), F.lit(3.0))))
    voted = each.groupBy(*keys, "_at").agg(
        F.sum(F.when(F.signum("_d") == F.col("_sign"), F.col("_m")).when(F.col("_d").isNotNull(), 0.0)).alias("_for"),
        F.sum("_m").alias("_all"),
        F.max("_sign").alias("_sign"),
        F.count("*").alias("_days"),
    )
    agree = F.when((F.col("_days") < 2) | (F.coalesce("_sign", F.lit(0.0)) == 0) | (F.coalesce("_all", F.lit(0.0)) < 1e-9), NO_VOTE).otherwise(F.col("_for") / F.col("_all"))
    pairs = voted.select(*keys, F.struct("_at", agree.alias("a")).alias("_p"))
    return pairs.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["a"]).alias("agreement"))


def line_rss(v: Column, a: int, b: int) -> Column:
    """Residual squares of the least-squares line through the hours [a, b)."""
    n = b - a
    mid = (n - 1) / 2
    sxx = sum((i - mid) ** 2 for i in range(n))
    mean = _side(v, a, b)
    syy = sum([(v[a + i] - mean) * (v[a + i] - mean) for i in range(1, n)], (v[a] - mean) * (v[a] - mean))
    sxy = sum([v[a + i] * (i - mid) for i in range(1, n)], v[a] * (0 - mid))
    return F.greatest(syy - sxy * sxy / sxx, F.lit(0.0))


def adaptive(profiles: DataFrame, v: str = "v", agreement: str | None = None) -> DataFrame:
    """``profiles`` with cut and score: the cut that best fits lines and falls on changes.

    A cut scores 4 (1 - RSS / TSS), plus 1.5 times the evidence of its three
    changes, less 1.5 times what they lack to the lower quartile of evidence,
    plus a quarter of how far neighbouring segments lie apart.  Of equal scores
    (to 9 digits) the first cut in order wins.  Evidence counts by a half plus half
    the days' agreement on it; without ``agreement`` that is ``NO_VOTE``.
    """
    rows = profiles.withColumn("_v", held(smoothed(F.col(v)))).withColumn("_noise", noise_scale(F.col("_v")))
    rows = rows.withColumn("_e", held(change_strength(F.col("_v"), F.col("_noise"))))
    vote = F.col(agreement) if agreement else F.array_repeat(F.lit(NO_VOTE), DAY - 1)
    rows = rows.withColumn("_e", F.zip_with("_e", vote, lambda e, a: e * (0.5 + 0.5 * a)))
    ordered = F.array_sort(F.array(*[F.col("_e")[h - 1] for h in OPENERS]))
    at = 0.25 * (len(OPENERS) - 1)
    low = int(at)
    rows = rows.withColumn("_o", ordered).withColumn("_floor", F.col("_o")[low] + (F.col("_o")[low + 1] - F.col("_o")[low]) * (at - low))
    w = F.col("_v")
    rows = rows.withColumn("_s", prefix(w)).withColumn("_q", prefix(F.transform(w, lambda x: x * x))).withColumn("_t", prefix(F.transform(w, lambda x, i: x * i)))
    over = lambda name, a, b: F.col(name)[b] - F.col(name)[a]  # noqa: E731  a sum of the hours [a, b)
    rows = rows.withColumn("_tss", F.greatest(over("_q", 0, DAY) - over("_s", 0, DAY) * over("_s", 0, DAY) / DAY, F.lit(0.0)))
    parts = sorted({p for cut in CUTS for p in _bounds(cut)})

    def rss(a: int, b: int) -> Column:
        """As ``line_rss``, from the prefix sums."""
        n = b - a
        sxx = n * (n * n - 1) / 12
        sxy = over("_t", a, b) - over("_s", a, b) * (a + (n - 1) / 2)
        return F.greatest(over("_q", a, b) - over("_s", a, b) * over("_s", a, b) / n - sxy * sxy / sxx, F.lit(0.0))

    rows = rows.withColumn("_rss", held(F.array(*[rss(a, b) for a, b in parts]))).withColumn("_avg", held(F.array(*[over("_s", a, b) / (b - a) for a, b in parts])))
    sd = F.greatest(F.sqrt(F.col("_tss") / DAY), F.lit(1e-6))
    scored = []
    for i, cut in enumerate(CUTS):
        at = [parts.index(p) for p in _bounds(cut)]
        left = sum([F.col("_rss")[j] for j in at[1:]], F.col("_rss")[at[0]])
        fit = F.when(F.col("_tss") > 1e-9, 1 - left / F.when(F.col("_tss") > 0, F.col("_tss"))).otherwise(F.lit(0.0))
        found = [F.col("_e")[h - 1] for h in cut]
        lack = [F.greatest(F.col("_floor") - e, F.lit(0.0)) for e in found]
        apart = [F.abs(F.col("_avg")[b] - F.col("_avg")[a]) for a, b in zip(at, at[1:])]
        score = 4 * fit + 1.5 * sum(found[1:], found[0]) - 1.5 * sum(lack[1:], lack[0]) + 0.25 * sum(apart[1:], apart[0]) / sd
        scored.append(F.struct(F.round(score, 9).alias("score"), F.lit(-i).alias("n"), cut_struct(cut).alias("cut")))
    rows = rows.withColumn("_b", F.array_max(F.array(*scored)))
    out = rows.withColumn("cut", F.col("_b.cut")).withColumn("score", F.col("_b.score"))
    return out.drop("_v", "_noise", "_e", "_o", "_floor", "_s", "_q", "_t", "_tss", "_rss", "_avg", "_b")


def fit_devices(readings: DataFrame, decay: float = DECAY) -> DataFrame:
    """device_id, v (weighted profile), cut, score, peak_hour: the adaptive cut of each device's readings."""
    profile = weighted_profile(readings, decay)
    v = profile.groupBy("device_id").agg(*[F.max(F.when(F.col("hour") == h, F.col("kwh"))).alias(f"h{h}") for h in HOURS])
    v = v.select("device_id", F.array(*[f"h{h}" for h in HOURS]).alias("v"))
    days = day_arrays(readings).withColumn("w", F.pow(F.lit(decay), F.row_number().over(Window.partitionBy("device_id").orderBy(F.desc("day"))) - 1))
    voted = v.join(persistence(days, ["device_id"]), "device_id")
    return adaptive(voted, "v", "agreement").drop("agreement").withColumn("peak_hour", peak_hour(F.col("v")))


def segment_features(profiles: DataFrame, v: str = "v", cut: str = "cut", keys: tuple[str, ...] = ("device_id",)) -> DataFrame:
    """Of each segment of a profile: mean, max, min, sample deviation, total."""
    hours = profiles.select(*keys, cut, F.posexplode(v).alias("hour", "kwh"))
    segment = segment_of(F.col("hour"), *[F.col(f"{cut}.b{i}") for i in (1, 2, 3)])
    return hours.groupBy(*keys, segment.alias("segment")).agg(F.avg("kwh").alias("mean"), F.max("kwh").alias("max"), F.min("kwh").alias("min"), F.stddev_samp("kwh").alias("std"), F.sum("kwh").alias("total"))


def fit_windows(rows: DataFrame, window_days: int = WINDOW_DAYS, decay: float = DECAY) -> DataFrame:
    """``rows`` (device_id, day, _w) with p, the weighted profile of a window of days, and agreement, their votes.

    _w has the day arrays of the window, oldest first, ``window_days`` at most;
    medians are taken within it.
    """
    every = F.lit([decay**i for i in range(window_days - 1, -1, -1)])
    rows = rows.withColumn("_u", F.slice(every, window_days - F.size("_w") + 1, F.size("_w")))

    def median(h: int) -> Column:
        pairs = F.filter(F.zip_with(F.transform("_w", lambda d: d[h]), "_u", lambda x, w: F.struct(x.alias("x"), w.alias("w"))), lambda p: p["x"].isNotNull())
        ordered = F.array_sort(pairs)
        total = F.aggregate(ordered, F.lit(0.0), lambda a, p: a + p["w"])
        step = lambda acc, p: F.struct((acc["s"] + p["w"]).alias("s"), F.coalesce(acc["m"], F.when(acc["s"] + p["w"] >= total / 2, p["x"])).alias("m"))
        return F.aggregate(ordered, F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("m")), step)["m"]

    rows = rows.withColumn("p", gaps_to_mean(held(F.array(*[median(h) for h in HOURS]))))
    voting = rows.select("device_id", "day", "_u", F.posexplode("_w").alias("_i", "v")).withColumn("w", F.element_at("_u", F.col("_i") + 1))
    return rows.drop("_w", "_u").join(persistence(voting, ["device_id", "day"]), ["device_id", "day"])


def adaptive_daily(readings: DataFrame, window_days: int = WINDOW_DAYS, decay: float = DECAY) -> DataFrame:
    """Daily totals by an adaptive cut a day, fitted on the ``window_days`` days before it (as many rows).

    The days of a window are gathered as an array beside the row, so a day's readings are read once.
    """
    return adaptive_days(day_arrays(readings), window_days, decay)


def adaptive_days(days: DataFrame, window_days: int = WINDOW_DAYS, decay: float = DECAY) -> DataFrame:
    """``adaptive_daily`` of day arrays (device_id, day, v)."""
    before = Window.partitionBy("device_id").orderBy("day").rowsBetween(-window_days, -1)
    rows = days.withColumn("_w", F.collect_list("v").over(before)).where(F.size("_w") == window_days)
    voted = fit_windows(rows, window_days, decay)
    return segment_totals(adaptive(voted, "p", "agreement")).drop("v", "p", "cut", "score", "agreement")


# Forecast-aware frozen cuts ------------------------------------------------

# Shrinkage grid, days that a forecast looks back on, that cuts are selected on, that shrinkage is tuned on, that must be left.
SHRINKS = (0.0, 0.002, 0.005, 0.01, 0.02, 0.05, float("inf"))
PROXY_DAYS, SELECT_DAYS, TUNE_DAYS, SPARE_DAYS = 7, 56, 28, 14


def proxy_errors(days: DataFrame, start: Column, end: Column, back: int = PROXY_DAYS) -> DataFrame:
    """device_id, candidate, b1, b2, b3, error: hourly error of a simple forecast under each cut.

    ``days`` are day arrays (null hours count as 0), numbered from 0 by device;
    those of [start, end) are scored, columns that may use ``_n``, the number of
    a device's days.  A day's segment totals are forecast by their mean over the
    ``back`` days before, spread over hours by the mean shape of all days before ``start``.
    """
    by = Window.partitionBy("device_id").orderBy("day")
    rows = days.withColumn("v", F.transform("v", lambda x: F.coalesce(x, F.lit(0.0))))
    rows = rows.withColumn("_i", F.row_number().over(by) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("device_id"))).withColumn("_a", start).withColumn("_b", end)
    shape = rows.where("_i < _a").groupBy("device_id").agg(F.array(*[F.avg(F.col("v")[h]) for h in HOURS]).alias("shape"))
    before = by.rowsBetween(-back, -1)
    means = rows.withColumn("_m", F.array(*[F.avg(F.col("v")[h]).over(before) for h in HOURS])).where(f"_i >= _a and _i < _b and _i >= {back}")
    rows = means.join(shape, "device_id")
    rows = rows.withColumn("_pm", prefix(F.col("_m"))).withColumn("_ps", prefix(F.col("shape")))
    parts = sorted({p for cut in CUTS for p in _bounds(cut)})

    def error(a: int, b: int) -> Column:
        total = F.col("_pm")[b] - F.col("_pm")[a]
        base = F.col("_ps")[b] - F.col("_ps")[a]
        share = lambda h: F.when(base > 1e-12, F.col("shape")[h] / F.when(base > 1e-12, base)).otherwise(F.lit(1.0 / (b - a)))
        each = [F.abs(F.col("v")[h] - total * share(h)) for h in range(a, b)]
        return sum(each[1:], each[0])

    sums = rows.groupBy("device_id").agg(F.count("*").alias("_n"), *[F.sum(error(a, b)).alias(f"e{a}_{b}") for a, b in parts])
    each = F.array(*[F.struct(F.lit(i).alias("candidate"), *[F.lit(h).alias(f"b{j + 1}") for j, h in enumerate(cut)], (sum([F.col(f"e{a}_{b}") for a, b in _bounds(cut)[1:]], F.col(f"e0_{cut[0]}")) / (F.col("_n") * DAY)).alias("error")) for i, cut in enumerate(CUTS)])
    return sums.select("device_id", F.explode(each).alias("c")).select("device_id", "c.*")


def _grouped(errors: DataFrame, groups: DataFrame | None) -> DataFrame:
    return errors.join(groups, "device_id") if groups is not None else errors.withColumn("group", F.lit(0))


def reference_cut(errors: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(group, r1, r2, r3): the cut of the least mean error, each device's errors in units of their mean."""
    mean = F.avg("error").over(Window.partitionBy("device_id"))
    scaled = _grouped(errors, groups).withColumn("_e", F.col("error") / F.greatest(mean, F.lit(1e-12)))
    means = scaled.groupBy("group", "candidate", "b1", "b2", "b3").agg(F.avg("_e").alias("_e"))
    return means.groupBy("group").agg(F.min_by(F.struct("b1", "b2", "b3"), F.struct(F.round("_e", 12), "candidate")).alias("r")).select("group", F.col("r.b1").alias("r1"), F.col("r.b2").alias("r2"), F.col("r.b3").alias("r3"))


def forecast_aware(errors: DataFrame, shrink: float, groups: DataFrame | None = None) -> DataFrame:
    """device_id, cut: the least error, plus ``shrink`` an hour of distance from the group's reference cut."""
    rows = _grouped(errors, groups).join(F.broadcast(reference_cut(errors, groups)), "group")  # one row a group
    best = F.min("error").over(Window.partitionBy("device_id"))
    away = F.abs(F.col("b1") - F.col("r1")) + F.abs(F.col("b2") - F.col("r2")) + F.abs(F.col("b3") - F.col("r3"))
    if shrink == float("inf"):
        cost = away.cast("double")
    else:
        cost = F.col("error") / F.greatest(best, F.lit(1e-12)) - 1 + shrink * away
    return rows.withColumn("_c", F.round(cost, 12)).groupBy("device_id").agg(F.min_by(F.struct("b1", "b2", "b3"), F.struct("_c", "candidate")).alias("cut"))


def tuned_shrink(chosen_on: DataFrame, scored_on: DataFrame, groups: DataFrame | None = None, slack: float = 5e-4) -> float:
    """The largest shrinkage whose mean error, in units of a device's mean, is within ``slack`` of the best.

    Cuts are chosen on the first table of ``proxy_errors`` and scored on the second.
    """
    mean = F.avg("error").over(Window.partitionBy("device_id"))
    later = scored_on.select("device_id", "b1", "b2", "b3", (F.col("error") / F.greatest(mean, F.lit(1e-12))).alias("later"))
    rows = None
    for i, shrink in enumerate(SHRINKS):
        picked = forecast_aware(chosen_on, shrink, groups).select("device_id", "cut.*", F.lit(i).alias("i"))
        rows = picked if rows is None else rows.unionByName(picked)
    means = {r.i: r.e for r in rows.join(later, ["device_id", "b1", "b2", "b3"]).groupBy("i").agg(F.avg("later").alias("e")).collect()}  # a row a shrinkage
    if not means:
        return 0.0
    best = min(means.values())
    return SHRINKS[max(i for i, e in means.items() if e <= best * (1 + slack))]


def frozen_cuts(days: DataFrame, fallback: tuple[int, int, int], groups: DataFrame | None = None, tune_days: int = TUNE_DAYS, select_days: int = SELECT_DAYS, back: int = PROXY_DAYS) -> DataFrame:
    """device_id, cut, fitted: one cut a device from its training days (day arrays), with the shrinkage that serves best.

    Shrinkage is tuned on the last ``tune_days``, with cuts selected on the
    ``select_days`` before; then cuts are selected on the last ``select_days``.
    Devices of fewer days than all this takes get ``fallback``.
    """
    whole = days.groupBy("device_id").agg(F.count("*").alias("n"))
    fit = days.join(whole.where(F.col("n") >= back + tune_days + SPARE_DAYS), "device_id", "left_semi")
    n = F.col("_n")
    cut_at = n - tune_days
    first = settled(proxy_errors(fit, F.greatest(F.lit(back), cut_at - select_days), cut_at, back), "errors-selected")
    tuning = settled(proxy_errors(fit, cut_at, n, back), "errors-tuned")
    final = settled(proxy_errors(fit, F.greatest(F.lit(back), n - select_days), n, back), "errors-final")
    chosen = forecast_aware(final, tuned_shrink(first, tuning, groups), groups)
    return whole.select("device_id").join(chosen, "device_id", "left").select("device_id", F.coalesce("cut", cut_struct(fallback)).alias("cut"), F.col("cut").isNotNull().alias("fitted"))


def shape_groups(days: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(device_id, group): k-means on the share of each hour in a device's mean day."""
    sums = days.groupBy("device_id").agg(*[F.sum(F.coalesce(F.col("v")[h], F.lit(0.0))).alias(f"h{h}") for h in HOURS])
    whole = F.greatest(sum([F.col(f"h{h}") for h in HOURS], F.lit(0.0)), F.lit(1e-12))
    points = settled(sums.select("device_id", F.array(*[F.col(f"h{h}") / whole for h in HOURS]).alias("share")), "shapes")
    n = points.count()
    if min(k, n) < 2:
        return points.select("device_id", F.lit(0).alias("group"))
    vectors = points.select("device_id", array_to_vector("share").alias("features"))
    return KMeans(k=min(k, n), seed=seed, maxIter=100).fit(vectors).transform(vectors).select("device_id", F.col("prediction").alias("group"))
