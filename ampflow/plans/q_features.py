"""Queries: features of daily rows, panels, weeks and months, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampflow.operators import features as feats
from ampflow.operators import profiles
from ampflow.plans.adapters import d_sql, daily, plain, sql
from ampflow.schema import SEG

D = f"WITH d AS ({d_sql()})"
DL = f"WITH d AS ({d_sql('l_linenumber')})"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEYS = ["device_id", "day"]


def _add(name: str, query, body: str | None = None, **kinds) -> None:
    QUERIES[name] = lambda spark, sf: plain(query(spark, sf))
    if body:
        ORACLES[name] = sql(body, **kinds)


def _some(columns):
    """The columns are made when the query runs: they need a session."""
    return lambda s, d: daily(s, d).select(*KEYS, *[c.alias(n) for n, c in columns().items()])




W = "WINDOW w AS (PARTITION BY device_id ORDER BY day)"
LAGS = " ".join(f"{s}_lag{k}" for s in SEG for k in feats.LAGS)
ROLLS = " ".join(f"{s}_mean{n} {s}_std{n}" for s in SEG for n in feats.ROLLS)
TRENDS = " ".join(f"{s}_trend{k}" for s in SEG for k in (1, 7))
PAST = " ".join(f"{s}_past_mean {s}_past_std {s}_to_past {s}_past_share" for s in SEG) + " past_total past_total_std past_cv"
CALENDAR = "day_of_month " + " ".join(f"{p}{n}" for p in ("", "target_") for n in ("day_of_week", "is_weekend", "month", "quarter", "week_of_year")) + " weekend_changes month_changes"
_add("lag_features", _some(feats.lag_columns), D + " SELECT device_id, day, " + ", ".join(f"lag({s}, {k}) OVER w AS {s}_lag{k}" for s in SEG for k in feats.LAGS) + f" FROM d {W}", doubles=LAGS, texts="day")


def _full(agg: str, x: str, frame: str, n: int) -> str:
    over = f"OVER (PARTITION BY device_id ORDER BY day ROWS BETWEEN {frame})"
    return f"CASE WHEN count({x}) {over} >= {n} THEN {agg}({x}) {over} END"


_add("rolling_features", lambda s, d: feats.rolling(daily(s, d)), D + " SELECT device_id, day, " + ", ".join(f"{_full('avg', s, f'{n} PRECEDING AND 1 PRECEDING', n)} AS {s}_mean{n}, {_full('stddev_samp', s, f'{n} PRECEDING AND 1 PRECEDING', n)} AS {s}_std{n}" for s in SEG for n in feats.ROLLS) + " FROM d", doubles=ROLLS, texts="day")
_add("trend_features", _some(feats.trend_columns), D + " SELECT device_id, day, " + ", ".join(f"{s} - lag({s}, {k}) OVER w AS {s}_trend{k}" for s in SEG for k in (1, 7)) + f" FROM d {W}", doubles=TRENDS, texts="day")
UP = "UNBOUNDED PRECEDING AND 1 PRECEDING"
_add("expanding_profile", _some(feats.profile_columns), D + ", x AS (SELECT *, " + ", ".join(f"{_full('avg', s, UP, 30)} AS {s}_past_mean, {_full('stddev_pop', s, UP, 30)} AS {s}_past_std" for s in SEG) + f", {_full('stddev_pop', '(seg0 + seg1 + seg2 + seg3)', UP, 30)} AS past_total_std FROM d), y AS (SELECT *, seg0_past_mean + seg1_past_mean + seg2_past_mean + seg3_past_mean AS past_total FROM x) SELECT device_id, day, " + ", ".join(f"{s}_past_mean, {s}_past_std, {s} / nullif({s}_past_mean, 0) AS {s}_to_past, {s}_past_mean / nullif(past_total, 0) AS {s}_past_share" for s in SEG) + ", past_total, past_total_std, past_total_std / nullif(past_total, 0) AS past_cv FROM y", doubles=PAST, texts="day")
CAL = "dayofmonth(day) AS day_of_month, " + ", ".join(
    f"isodow({x}) - 1 AS {p}day_of_week, CAST(isodow({x}) >= 6 AS INT) AS {p}is_weekend, month({x}) AS {p}month, quarter({x}) AS {p}quarter, week({x}) AS {p}week_of_year" for x, p in (("day", ""), ("(day + 1)", "target_"))
) + ", CAST((isodow(day) >= 6) <> (isodow(day + 1) >= 6) AS INT) AS weekend_changes, CAST(month(day) <> month(day + 1) AS INT) AS month_changes"
_add("calendar_features", _some(feats.calendar_columns), D + f" SELECT device_id, day, {CAL} FROM d", ints=CALENDAR, texts="day")
_add("segment_time_features", _some(feats.segment_time_columns), D + ", x AS (SELECT *, " + ", ".join(f"lead({s}_start) OVER w AS {s}_next_start, lead({s}_hours) OVER w AS {s}_next_hours, {s} / nullif({s}_hours, 0) AS {s}_density" for s in SEG) + f" FROM d {W}), y AS (SELECT *, " + ", ".join(f"{_full('avg', f'{s}_density', '6 PRECEDING AND CURRENT ROW', 7)} AS {s}_density7" for s in SEG) + " FROM x) SELECT device_id, day, " + ", ".join(f"{s}_next_start, {s}_next_hours, {s}_next_start - {s}_start AS {s}_start_shift, {s}_next_hours - {s}_hours AS {s}_hours_shift, {s}_density, {s}_density7, {s}_density * {s}_next_hours AS {s}_expected, {s}_density7 * {s}_next_hours AS {s}_expected7" for s in SEG) + " FROM y", doubles=" ".join(f"{s}_{n}" for s in SEG for n in ("density", "density7", "expected", "expected7")), ints=" ".join(f"{s}_{n}" for s in SEG for n in ("next_start", "next_hours", "start_shift", "hours_shift")), texts="day")
_add("targets_lead", _some(feats.target_columns), D + " SELECT device_id, day, " + ", ".join(f"lead({s}) OVER w AS target_{s}" for s in SEG) + f" FROM d {W}", doubles=" ".join(feats.TARGETS), texts="day")
_add("feature_table_rows", lambda s, d: feats.build(daily(s, d)).groupBy("device_id").agg(F.count("*").alias("rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("seg0_lag30").alias("lag30"), F.sum("target_seg3").alias("target")), D + ", x AS (SELECT *, row_number() OVER w AS i, lead(seg3) OVER w AS t, lag(seg0, 30) OVER w AS l, least(" + ", ".join(f"sum({s}) OVER (PARTITION BY device_id ORDER BY day ROWS BETWEEN {UP})" for s in SEG) + f") AS low FROM d {W}) SELECT device_id, count(*) AS rows, min(day) AS first_day, max(day) AS last_day, sum(l) AS lag30, sum(t) AS target FROM x WHERE i > 30 AND t IS NOT NULL AND low > 0 GROUP BY 1", doubles="lag30 target", ints="rows", texts="first_day last_day")
_add("split_70_15_15", lambda s, d: feats.split(daily(s, d).select(*KEYS)), D + " SELECT device_id, day, CASE WHEN i <= floor(n * 0.7) THEN 'train' WHEN i <= floor(n * 0.85) THEN 'valid' ELSE 'test' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY day) AS i, count(*) OVER (PARTITION BY device_id) AS n FROM d)", texts="day")

WIDE = """, e AS (SELECT device_id, min(day) AS a, max(day) AS b FROM d GROUP BY 1), sp AS (SELECT device_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM e),
wide AS (SELECT device_id, day, seg0, seg1, seg2, seg3, seg0 + seg1 + seg2 + seg3 AS y FROM sp LEFT JOIN d USING (device_id, day))"""
LEVELS = [f"lag{k}" for k in feats.PANEL_LAGS] + [f"mean{n}" for n in feats.PANEL_MEANS] + [f"std{n}" for n in feats.PANEL_STDS]
SHARES = [f"{n}_{s}" for s in SEG for n in ("share", "share7")]
PANEL_TARGETS = ["target1", "target2", "target3"]


def _pfull(agg: str, x: str, n: int) -> str:
    over = f"OVER (PARTITION BY device_id ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} >= {n} THEN {agg}({x}) {over} END"


PANEL_SQL = DL + WIDE + ", sh AS (SELECT *, " + ", ".join(f"CASE WHEN y = 0 THEN 0.25 ELSE {s} / CASE WHEN y > 0 THEN y END END AS share_{s}" for s in SEG) + " FROM wide), pn AS (SELECT device_id, day, y, " + ", ".join(f"lag(y, {k - 1}) OVER w AS lag{k}" for k in feats.PANEL_LAGS) + ", " + ", ".join(f"{_pfull('avg', 'y', n)} AS mean{n}" for n in feats.PANEL_MEANS) + ", " + ", ".join(f"{_pfull('stddev_samp', 'y', n)} AS std{n}" for n in feats.PANEL_STDS) + ", " + ", ".join(f"share_{s}, {_pfull('avg', f'share_{s}', 7)} AS share7_{s}" for s in SEG) + ", " + ", ".join(f"lead(y, {h}) OVER w AS target{h}" for h in (1, 2, 3)) + " FROM sh WINDOW w AS (PARTITION BY device_id ORDER BY day))"
READY = "coalesce((" + " + ".join(LEVELS + SHARES) + ") IS NOT NULL AND {0} > 1e-9, false)"
_add("panel_calendar", lambda s, d: feats.panel(daily(s, d, "l_linenumber"), normalize=False), PANEL_SQL + f" SELECT *, 1.0 AS scale, {READY.format('1')} AS ready, {READY.format('1')} AND (target1 + target2 + target3) IS NOT NULL AS usable FROM pn", doubles=" ".join(["y", "scale", *LEVELS, *SHARES, *PANEL_TARGETS]), texts="day")
_add("panel_naive", lambda s, d: feats.horizon_frame(feats.panel(daily(s, d, "l_linenumber")), 2).select("device_id", "day", "target_day", "target", "target_ratio", "naive", "log_scale", "lag2", "mean7", "std14", "share7_seg1", "is_weekend", *[f"dow{i}" for i in range(7)]), PANEL_SQL + " SELECT device_id, day, day + 2 AS target_day, target2 AS target, target2 / mean28 AS target_ratio, lag6 AS naive, ln(1 + mean28) AS log_scale, lag2 / mean28 AS lag2, mean7 / mean28 AS mean7, std14 / mean28 AS std14, share7_seg1, CAST(isodow(day + 2) >= 6 AS INT) AS is_weekend, " + ", ".join(f"CAST(isodow(day + 2) = {i + 1} AS INT) AS dow{i}" for i in range(7)) + f" FROM pn WHERE {READY.format('mean28')} AND target2 IS NOT NULL", doubles="target target_ratio naive log_scale lag2 mean7 std14 share7_seg1", ints="is_weekend " + " ".join(f"dow{i}" for i in range(7)), texts="day target_day")


def _cutoff(s, d):
    rows = feats.panel(daily(s, d, "l_linenumber"))
    frame = feats.parted(feats.horizon_frame(rows, 1), feats.cutoff(rows.where("usable")))
    return frame.groupBy("part").agg(F.count("*").alias("rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


_add("cutoff_split", _cutoff, PANEL_SQL + f", u AS (SELECT *, day + 1 AS target_day FROM pn WHERE {READY.format('mean28')} AND target1 IS NOT NULL), dd AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM u WHERE (target2 + target3) IS NOT NULL)), cu AS (SELECT day AS c FROM dd WHERE i = least(greatest(floor(n * 0.8 + 1e-9), 1), n - 1)) SELECT CASE WHEN target_day <= c THEN 'train' ELSE 'test' END AS part, count(*) AS rows, min(day) AS first_day, max(day) AS last_day FROM u CROSS JOIN cu WHERE target_day <= c OR day >= c GROUP BY 1", ints="rows", texts="first_day last_day")

SAT = "(day - CAST((isodow(day) + 1) % 7 AS INT))"


def _period_sql(start: str, least: int, shape, extra: str = "month(start) AS month", before: str = "", ahead: int = 1) -> str:
    """Frames end ``ahead`` rows before the row: 1, or 0 for features of the period after it."""
    means, std, trends = shape
    w = "PARTITION BY device_id ORDER BY start"
    frame = lambda n: f"OVER ({w} ROWS BETWEEN {n} PRECEDING AND {ahead} PRECEDING)"
    cols = [f"lag(use, {ahead}) OVER ({w}) AS prev1"] + [f"avg(use) {frame(n - 1 + ahead)} AS mean{n}" for n in means] + [f"stddev_pop(use) {frame(std - 1 + ahead)} AS std{std}"]
    cols += [f"coalesce(lag(use, {ahead}) OVER ({w}) - lag(use, {k - 1 + ahead}) OVER ({w}), 0.0) AS {name}" for name, k in trends.items()]
    cols += [f"{f}(use) {frame('UNBOUNDED')} AS {n}" for f, n in (("min", "past_min"), ("max", "past_max"), ("avg", "past_mean"), ("count", "n_hist"))]
    return DL + f", t AS (SELECT device_id, day, sum(seg0 + seg1 + seg2 + seg3) AS use FROM d {before} GROUP BY 1, 2), p AS (SELECT device_id, {start} AS start, sum(use) AS use, count(DISTINCT day) AS days FROM t GROUP BY 1, 2 HAVING count(DISTINCT day) >= {least}), q AS (SELECT *, {', '.join(cols)} FROM p) SELECT *{', ' + extra if extra else ''} FROM q WHERE n_hist >= 2"


WEEK_D = "use prev1 mean2 mean4 mean8 std4 trend2 trend4 past_min past_max past_mean"
MONTH_D = "use prev1 mean2 mean3 mean6 mean12 std3 trend1 trend3 past_min past_max past_mean"
_add("weekly_frame", lambda s, d: feats.weekly(daily(s, d, "l_linenumber")), _period_sql(SAT, 7, feats.WEEKS, "month(start) AS month, weekofyear(start) AS week"), doubles=WEEK_D, ints="days n_hist month week", texts="start")
_add("monthly_frame", lambda s, d: feats.monthly(daily(s, d, "l_linenumber")), _period_sql("CAST(date_trunc('month', day) AS DATE)", 20, feats.MONTHS), doubles=MONTH_D, ints="days n_hist month", texts="start")
J_AT = "(SELECT n - a FROM (SELECT date_diff('day', DATE '1970-01-01', day) AS n), (SELECT 365 * y + floor((8 * y + 21) / 33.0)::BIGINT - 492633 AS a, 365 * (y + 1) + floor((8 * (y + 1) + 21) / 33.0)::BIGINT - 492633 AS b FROM generate_series(1360, 1390) t(y)) WHERE n >= a AND n < b)"
J_START = f"(day - CAST(CASE WHEN {J_AT} < 186 THEN {J_AT} % 31 ELSE ({J_AT} - 186) % 30 END AS INT))"
J_MONTH = J_AT.replace("day)", "start)")
_add("jalali_monthly_frame", lambda s, d: feats.monthly(daily(s, d, "l_linenumber"), solar=True), _period_sql(J_START, 20, feats.MONTHS, f"(CASE WHEN {J_MONTH} < 186 THEN {J_MONTH} // 31 + 1 ELSE ({J_MONTH} - 186) // 30 + 7 END) AS month"), doubles=MONTH_D, ints="days n_hist month", texts="start")
_add("week_total_or_null", lambda s, d: feats.period_total(daily(s, d, "l_linenumber"), F.lit("1996-06-01").cast("date"), F.lit("1996-06-07").cast("date")), DL + " SELECT device_id, CASE WHEN count(DISTINCT day) = 7 THEN sum(seg0 + seg1 + seg2 + seg3) END AS use FROM d WHERE day BETWEEN DATE '1996-06-01' AND DATE '1996-06-07' GROUP BY 1", doubles="use")
LATEST = "WHERE day < DATE '1997-03-05'"
LAST = " QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY start DESC) = 1"
_add("latest_week_features", lambda s, d: feats.latest_period(daily(s, d, "l_linenumber"), F.lit("1997-03-05").cast("date")), _period_sql(SAT, 1, feats.WEEKS, "", LATEST, 0) + LAST, doubles=WEEK_D, ints="days n_hist", texts="start")
_add("latest_month_features", lambda s, d: feats.latest_period(daily(s, d, "l_linenumber"), F.lit("1997-03-05").cast("date"), True), _period_sql(J_START, 1, feats.MONTHS, "", LATEST, 0) + LAST, doubles=MONTH_D, ints="days n_hist", texts="start")

# Of the reference's lines: the calendar's days without a row are null, recent ones are the last 28 known.
PROF = WIDE + """, yy AS (SELECT *, lag(y) OVER w AS y1, lag(y, 7) OVER w AS y7, isodow(day) - 1 AS dow, seg0 / CASE WHEN y > 0 THEN y END AS s0, seg1 / CASE WHEN y > 0 THEN y END AS s1, seg2 / CASE WHEN y > 0 THEN y END AS s2, seg3 / CASE WHEN y > 0 THEN y END AS s3 FROM wide WINDOW w AS (PARTITION BY device_id ORDER BY day)),
rc AS (SELECT device_id, day, row_number() OVER (PARTITION BY device_id ORDER BY day DESC) AS back FROM wide WHERE y IS NOT NULL),
md AS (SELECT device_id, quantile_cont(y, 0.5) AS med, avg(y) AS mu, count(y) AS n FROM yy GROUP BY 1),
ag AS (SELECT device_id, avg(y) AS m, any_value(med) AS med, stddev_samp(y) AS sd, quantile_cont(abs(y - med), 0.5) * 1.4826 AS mad, avg(abs(y - y1)) AS step, avg(y) FILTER (dow >= 5) AS we, avg(y) FILTER (dow < 5) AS wd, """ + ", ".join(f"avg(y) FILTER (dow = {i}) AS d{i}" for i in range(7)) + ", " + ", ".join(f"avg(s{k}) AS a{k}, stddev_samp(s{k}) AS v{k}" for k in range(4)) + """, corr(y, y1) AS c1, corr(y, y7) AS c7, avg(abs(y - y7)) AS miss7, count(y - y7) AS n7, avg((y > 2 * CASE WHEN med > 1e-9 THEN med ELSE mu END)::INT) AS spike_frac, avg((y < 0.3 * CASE WHEN med > 1e-9 THEN med ELSE mu END)::INT) AS low_frac, avg(y) FILTER (back <= 28) AS recent FROM yy JOIN md USING (device_id) LEFT JOIN rc USING (device_id, day) WHERE n >= 21 GROUP BY 1 HAVING avg(y) > 1e-9),
dw AS (SELECT *, """ + ", ".join(f"coalesce(d{i} / m, 1.0) AS w{i}" for i in range(7)) + ", a0 + a1 + a2 + a3 AS sa FROM ag), sh AS (SELECT *, " + ", ".join(f"a{k} / sa AS share_{k}" for k in range(4)) + ", (" + " + ".join(f"w{i}" for i in range(7)) + """) / 7 AS wm FROM dw)
SELECT device_id, ln(1 + m) AS log_mean, ln(1 + med) AS log_median, coalesce(sd / m, 0.0) AS cv, CASE WHEN med > 1e-9 THEN mad / med ELSE coalesce(sd / m, 0.0) END AS robust_cv, coalesce(step / m, 0.0) AS diff_volatility, CASE WHEN wd > 1e-9 AND we IS NOT NULL THEN we / wd ELSE 1.0 END AS weekend_ratio, sqrt((""" + " + ".join(f"(w{i} - wm) * (w{i} - wm)" for i in range(7)) + ") / 6) AS dow_amplitude, coalesce(c1, 0.0) AS autocorr_lag1, coalesce(c7, 0.0) AS autocorr_lag7, share_0, share_1, share_2, share_3, -(" + " + ".join(f"CASE WHEN share_{k} > 0 THEN share_{k} * ln(share_{k}) ELSE 0 END" for k in range(4)) + ") / ln(4.0) AS share_entropy, greatest(share_0, share_1, share_2, share_3) AS share_peak, least(share_0, share_1, share_2, share_3) / greatest(share_0, share_1, share_2, share_3) AS share_trough_ratio, (v0 + v1 + v2 + v3) / 4 AS share_volatility, CASE WHEN n7 >= 5 THEN miss7 / m ELSE 1.0 END AS naive7_wape, spike_frac, low_frac, ln((recent + 1e-6) / (m + 1e-6)) AS trend_ratio FROM sh"
_add("device_behaviour_profile", lambda s, d: profiles.behaviour(daily(s, d)), D + PROF, doubles=" ".join(profiles.BASE))
_add("clock_features", lambda s, d: profiles.clock(daily(s, d)), D + ", x AS (SELECT *, [seg0 / seg0_hours, seg1 / seg1_hours, seg2 / seg2_hours, seg3 / seg3_hours] AS den, [2 * pi() * (seg0_start + seg0_hours / 2.0) / 24, 2 * pi() * (seg1_start + seg1_hours / 2.0) / 24, 2 * pi() * (seg2_start + seg2_hours / 2.0) / 24, 2 * pi() * (seg3_start + seg3_hours / 2.0) / 24] AS ang FROM d), y AS (SELECT *, ang[list_position(den, list_max(den))] AS pk FROM x) SELECT device_id, avg(seg1_start) AS boundary_mean_1, avg(seg2_start) AS boundary_mean_2, avg(seg3_start) AS boundary_mean_3, (stddev_pop(seg1_start) + stddev_pop(seg2_start) + stddev_pop(seg3_start)) / 3 AS boundary_stability, CASE WHEN avg(seg0 + seg1 + seg2 + seg3) > 0 THEN avg(seg0 * sin(ang[1]) + seg1 * sin(ang[2]) + seg2 * sin(ang[3]) + seg3 * sin(ang[4])) / avg(seg0 + seg1 + seg2 + seg3) ELSE 0 END AS energy_center_sin, CASE WHEN avg(seg0 + seg1 + seg2 + seg3) > 0 THEN avg(seg0 * cos(ang[1]) + seg1 * cos(ang[2]) + seg2 * cos(ang[3]) + seg3 * cos(ang[4])) / avg(seg0 + seg1 + seg2 + seg3) ELSE 0 END AS energy_center_cos, avg(sin(pk)) AS peak_hour_sin, avg(cos(pk)) AS peak_hour_cos FROM y GROUP BY 1", doubles=" ".join(profiles.CLOCK))


def _outliers(s, d):
    p = profiles.medians_filled(profiles.behaviour(daily(s, d)), profiles.BASE)
    return profiles.outliers(profiles.robust_scores(p, profiles.BASE), 3.0)


B = profiles.BASE
_add("robust_outliers", _outliers, D + ", bp AS (" + PROF.strip().lstrip(",").join(["WITH ", ""]) + ") , md2 AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in B) + " FROM bp), aw AS (SELECT device_id, " + ", ".join(f"abs(bp.{c} - md2.{c}) AS {c}" for c in B) + " FROM bp CROSS JOIN md2), sc AS (SELECT " + ", ".join(f"CASE WHEN quantile_cont({c}, 0.5) * 1.4826 > 1e-9 THEN quantile_cont({c}, 0.5) * 1.4826 ELSE 1.0 END AS {c}" for c in B) + " FROM aw), z AS (SELECT device_id, list_aggregate(list_reverse_sort([" + ", ".join(f"aw.{c} / sc.{c}" for c in B) + "])[1:3], 'avg') AS z FROM aw CROSS JOIN sc) SELECT device_id, z, coalesce(z > 3.0 AND row_number() OVER (ORDER BY z DESC, device_id) <= floor((SELECT count(*) FROM z) * 0.1), false) AS outlier FROM z", doubles="z")
