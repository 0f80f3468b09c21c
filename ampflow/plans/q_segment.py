"""Queries: hour profiles, cuts of a day, segment totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampflow.operators import clean, segment
from ampflow.operators.segment import CUTS, OPENERS
from ampflow.plans.adapters import plain, r_sql, readings, sql
from ampflow.plans.jobs import daily_actuals

R = f"WITH r AS ({r_sql()})"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, body: str | None = None, **kinds) -> None:
    QUERIES[name] = lambda spark, sf: plain(query(spark, sf))
    if body:
        ORACLES[name] = sql(body, **kinds)


def _cut(df):
    return df.select("device_id", *[F.col(f"cut.b{i}").alias(f"b{i}") for i in (1, 2, 3)])


def _hours(df, column="v"):
    return df.select("device_id", F.posexplode(column).alias("hour", "kwh"))


CAND = ", cand(c, b1, b2, b3) AS (VALUES " + ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(CUTS)) + ")"
MEAN = ", hr AS (SELECT device_id, hour(ts) AS h, avg(kwh) AS kwh FROM r GROUP BY 1, 2), prof AS (SELECT device_id, h, coalesce(kwh, avg(kwh) OVER (PARTITION BY device_id)) AS v FROM (SELECT DISTINCT device_id FROM hr) CROSS JOIN (SELECT unnest(generate_series(0, 23)) AS h) LEFT JOIN hr USING (device_id, h))"
_add("hour_profile_mean", lambda s, d: _hours(segment.mean_profile(readings(s, d))), R + MEAN + " SELECT device_id, h AS hour, v AS kwh FROM prof", doubles="kwh", ints="hour")
_add("hour_profile_weighted_median", lambda s, d: segment.weighted_profile(readings(s, d)), R + """, x AS (SELECT device_id, CAST(ts AS DATE) AS day, hour(ts) AS h, avg(kwh) AS kwh FROM r GROUP BY 1, 2, 3),
w AS (SELECT *, pow(0.97, dense_rank() OVER (PARTITION BY device_id ORDER BY day DESC) - 1) AS w FROM x),
c AS (SELECT *, sum(w) OVER (PARTITION BY device_id, h ORDER BY kwh, day) AS run, sum(w) OVER (PARTITION BY device_id, h) / 2 AS half FROM w),
med AS (SELECT device_id, h, min(kwh) AS kwh FROM c WHERE run >= half GROUP BY 1, 2)
SELECT device_id, h AS hour, coalesce(kwh, avg(kwh) OVER (PARTITION BY device_id)) AS kwh FROM (SELECT DISTINCT device_id FROM med) CROSS JOIN (SELECT unnest(generate_series(0, 23)) AS h) LEFT JOIN med USING (device_id, h)""", doubles="kwh", ints="hour")
SMOOTH = ", sm AS (SELECT device_id, h, avg(v) OVER (PARTITION BY device_id ORDER BY h ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM prof)"
_add("smooth_profile", lambda s, d: _hours(segment.mean_profile(readings(s, d)).withColumn("v", segment.smoothed(F.col("v")))), R + MEAN + SMOOTH + " SELECT device_id, h AS hour, v AS kwh FROM sm", doubles="kwh", ints="hour")
_add("peak_hour", lambda s, d: segment.mean_profile(readings(s, d)).select("device_id", segment.peak_hour(F.col("v")).alias("peak_hour"), F.array_max("v").alias("peak_value")), R + MEAN + " SELECT device_id, min(h) FILTER (v = m) AS peak_hour, max(v) AS peak_value FROM (SELECT *, max(v) OVER (PARTITION BY device_id) AS m FROM prof) GROUP BY 1", doubles="peak_value", ints="peak_hour")
JENKS = """, sse AS (SELECT device_id, c, b1, b2, b3, round(sum(s), 9) AS sse FROM (SELECT device_id, c, b1, b2, b3, (h >= b1)::INT + (h >= b2)::INT + (h >= b3)::INT AS seg, sum(v * v) - sum(v) * sum(v) / count(*) AS s FROM {0} CROSS JOIN cand GROUP BY 1, 2, 3, 4, 5, 6) GROUP BY 1, 2, 3, 4, 5),
best AS (SELECT * FROM sse QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY sse, b3 DESC, b2 DESC, b1 DESC) = 1)"""
_add("jenks_boundaries", lambda s, d: _cut(segment.jenks(segment.mean_profile(readings(s, d)))), R + CAND + MEAN + JENKS.format("prof") + " SELECT device_id, b1, b2, b3 FROM best", ints="b1 b2 b3")
DAYS = ", dh AS (SELECT device_id, CAST(ts AS DATE) AS day, hour(ts) AS h, avg(kwh) AS kwh FROM r GROUP BY 1, 2, 3), full_dh AS (SELECT device_id, day, h, coalesce(kwh, 0.0) AS v FROM (SELECT DISTINCT device_id, day FROM dh) CROSS JOIN (SELECT unnest(generate_series(0, 23)) AS h) LEFT JOIN dh USING (device_id, day, h))"
TOTALS = ", ".join(f"round(sum(CASE WHEN (h >= b1)::INT + (h >= b2)::INT + (h >= b3)::INT = {k} THEN v ELSE 0.0 END), 3) AS seg{k}" for k in range(4)) + ", 0 AS seg0_start, b1 AS seg1_start, b2 AS seg2_start, b3 AS seg3_start, b1 AS seg0_hours, b2 - b1 AS seg1_hours, b3 - b2 AS seg2_hours, 24 - b3 AS seg3_hours"
KINDS = {"doubles": "seg0 seg1 seg2 seg3", "ints": " ".join(f"seg{k}_start seg{k}_hours" for k in range(4)), "texts": "day"}
TRAIN = ", tr AS (SELECT * FROM (SELECT device_id, day, row_number() OVER (PARTITION BY device_id ORDER BY day) AS i, count(*) OVER (PARTITION BY device_id) AS n FROM (SELECT DISTINCT device_id, day FROM dh)) WHERE i <= greatest(floor(n * 0.8), 1)), tp AS (SELECT device_id, h, avg(v) AS v FROM full_dh SEMI JOIN tr USING (device_id, day) GROUP BY 1, 2)"
_add("jenks_daily_totals", lambda s, d: segment.jenks_daily(readings(s, d)), R + CAND + DAYS + TRAIN + JENKS.format("tp") + f" SELECT device_id, day, {TOTALS} FROM full_dh JOIN best USING (device_id) GROUP BY device_id, day, b1, b2, b3", **KINDS)
ROLL = """, rp AS (SELECT device_id, day, h, v, avg(v) OVER w AS p, count(*) OVER w AS n FROM full_dh WINDOW w AS (PARTITION BY device_id, h ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
rs AS (SELECT device_id, day, c, b1, b2, b3, round(sum(s), 9) AS sse FROM (SELECT device_id, day, c, b1, b2, b3, (h >= b1)::INT + (h >= b2)::INT + (h >= b3)::INT AS seg, sum(p * p) - sum(p) * sum(p) / count(*) AS s FROM rp CROSS JOIN cand WHERE n = 7 GROUP BY 1, 2, 3, 4, 5, 6, 7) GROUP BY 1, 2, 3, 4, 5, 6),
rb AS (SELECT * FROM rs QUALIFY row_number() OVER (PARTITION BY device_id, day ORDER BY sse, b3 DESC, b2 DESC, b1 DESC) = 1)"""
_add("rolling_jenks_daily", lambda s, d: segment.rolling_jenks_daily(readings(s, d), 7), R + CAND + DAYS + ROLL + f" SELECT device_id, day, {TOTALS} FROM rp JOIN rb USING (device_id, day) GROUP BY device_id, day, b1, b2, b3", **KINDS)
RSS = """, seg AS (SELECT device_id, c, b1, b2, b3, seg, avg(v) AS mean, regr_syy(v, h) - regr_sxy(v, h) * regr_sxy(v, h) / regr_sxx(v, h) AS rss FROM (SELECT *, (h >= b1)::INT + (h >= b2)::INT + (h >= b3)::INT AS seg FROM {0} CROSS JOIN cand) GROUP BY 1, 2, 3, 4, 5, 6)"""


def _line_fit(s, d):
    parts = sorted({p for cut in CUTS for p in segment._bounds(cut)})
    p = segment.mean_profile(readings(s, d)).withColumn("r", segment.held(F.array(*[segment.line_rss(F.col("v"), a, b) for a, b in parts])))
    each = [F.struct(F.lit(i).alias("c"), F.lit(k).alias("segment"), F.col("r")[parts.index(x)].alias("rss")) for i, cut in enumerate(CUTS) for k, x in enumerate(segment._bounds(cut))]
    return p.select("device_id", F.inline(F.array(*each)))


_add("linear_fit_rss", _line_fit, R + CAND + MEAN + RSS.format("prof") + " SELECT device_id, c, seg AS segment, greatest(rss, 0) AS rss FROM seg", doubles="rss", ints="c segment")
EVID = """, d2 AS (SELECT device_id, median(d) AS med FROM (SELECT device_id, h, abs(lead(v) OVER w - 2 * v + lag(v) OVER w) AS d FROM sm WINDOW w AS (PARTITION BY device_id ORDER BY h)) WHERE h BETWEEN 1 AND 22 GROUP BY 1),
ns AS (SELECT device_id, greatest(any_value(med), 1e-3 * (max(v) - min(v)), 1e-6) AS noise FROM sm JOIN d2 USING (device_id) GROUP BY 1),
ev AS (SELECT device_id, h, (abs(rm - lm) + abs(coalesce((rl - v) / nullif(rc - 1, 0), 0) - coalesce((ll - lf) / nullif(lc - 1, 0), 0))) / noise AS e FROM (SELECT device_id, h, v, avg(v) OVER l AS lm, avg(v) OVER r AS rm, first_value(v) OVER l AS lf, last_value(v) OVER l AS ll, count(*) OVER l AS lc, last_value(v) OVER r AS rl, count(*) OVER r AS rc FROM sm
  WINDOW l AS (PARTITION BY device_id ORDER BY h ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY device_id ORDER BY h ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) JOIN ns USING (device_id) WHERE h >= 1)"""


def _evidence(s, d):
    p = segment.mean_profile(readings(s, d)).withColumn("v", segment.smoothed(F.col("v")))
    return p.select("device_id", F.posexplode(segment.change_strength(F.col("v"), segment.noise_scale(F.col("v")))).alias("hour", "evidence")).withColumn("hour", F.col("hour") + 1)


_add("change_evidence", _evidence, R + MEAN + SMOOTH + EVID + " SELECT device_id, h AS hour, e AS evidence FROM ev", doubles="evidence", ints="hour")
OPEN = ", ".join(map(str, OPENERS))
ADAPT = RSS.format("sm") + f""", fl AS (SELECT device_id, quantile_cont(e, 0.25) AS floor FROM ev WHERE h IN ({OPEN}) GROUP BY 1),
tot AS (SELECT device_id, var_pop(v) * 24 AS tss, greatest(stddev_pop(v), 1e-6) AS sd FROM sm GROUP BY 1),
fit AS (SELECT device_id, c, b1, b2, b3, sum(greatest(rss, 0)) AS rss, sum(coalesce(abs(mean - prev), 0)) AS apart FROM (SELECT *, lag(mean) OVER (PARTITION BY device_id, c ORDER BY seg) AS prev FROM seg) GROUP BY 1, 2, 3, 4, 5),
chg AS (SELECT device_id, c, sum(e) AS found, sum(greatest(floor - e, 0)) AS lack FROM cand JOIN ev ON h IN (b1, b2, b3) JOIN fl USING (device_id) GROUP BY 1, 2),
sc AS (SELECT device_id, c, b1, b2, b3, round(4 * CASE WHEN tss > 1e-9 THEN 1 - rss / tss ELSE 0 END + 1.5 * found - 1.5 * lack + 0.25 * apart / sd, 9) AS score FROM fit JOIN chg USING (device_id, c) JOIN tot USING (device_id)),
ab AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY score DESC, c) = 1)"""
_add("adaptive_boundaries", lambda s, d: segment.adaptive(segment.mean_profile(readings(s, d))).select("device_id", "cut.*", "score"), R + CAND + MEAN + SMOOTH + EVID.replace("ev AS", "plain_ev AS") + ", ev AS (SELECT device_id, h, e * 0.75 AS e FROM plain_ev)" + ADAPT + " SELECT device_id, b1, b2, b3, score FROM ab", doubles="score", ints="b1 b2 b3")
# From here on the SQL's device_id may stand for a device's day, whose window of days is in dd(device_id, day, h, v).
HOURLY = "(SELECT unnest(generate_series(0, 23)) AS h)"
MEDIAN = f""", wt AS (SELECT *, pow(0.97, dense_rank() OVER (PARTITION BY device_id ORDER BY day DESC) - 1) AS w FROM dd),
cum AS (SELECT *, sum(w) OVER (PARTITION BY device_id, h ORDER BY v, day) AS run, sum(w) OVER (PARTITION BY device_id, h) / 2 AS half FROM wt WHERE v IS NOT NULL),
med AS (SELECT device_id, h, min(v) AS v FROM cum WHERE run >= half GROUP BY 1, 2),
prof AS (SELECT device_id, h, coalesce(v, avg(v) OVER (PARTITION BY device_id)) AS v FROM (SELECT DISTINCT device_id FROM med) CROSS JOIN {HOURLY} LEFT JOIN med USING (device_id, h))"""
VOTE = f""", gd AS (SELECT device_id, day, h, v, w FROM (SELECT device_id, day, any_value(w) AS w FROM wt GROUP BY 1, 2) CROSS JOIN {HOURLY} LEFT JOIN dd USING (device_id, day, h)),
gw AS (SELECT device_id, day, h, w, v, abs(lead(v) OVER n - 2 * v + lag(v) OVER n) AS second, avg(v) OVER l AS lm, count(v) OVER l = count(*) OVER l AND count(v) OVER r = count(*) OVER r AS known, avg(v) OVER r AS rm FROM gd
  WINDOW n AS (PARTITION BY device_id, day ORDER BY h), l AS (PARTITION BY device_id, day ORDER BY h ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY device_id, day ORDER BY h ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
gn AS (SELECT device_id, day, greatest(coalesce(median(second) FILTER (h BETWEEN 1 AND 22), 0.0), 1e-3 * (max(v) - min(v)), 1e-6) AS noise FROM gw GROUP BY 1, 2),
gx AS (SELECT device_id, day, h, w, noise, CASE WHEN known THEN rm - lm END AS d FROM gw JOIN gn USING (device_id, day) WHERE h >= 1),
gs AS (SELECT *, sign(round(sum(w * d) OVER (PARTITION BY device_id, h), 12)) AS sg, CASE WHEN d IS NOT NULL THEN w * least(abs(d) / noise, 3.0) END AS m FROM gx),
vt AS (SELECT device_id, h, CASE WHEN count(*) < 2 OR coalesce(max(sg), 0) = 0 OR coalesce(sum(m), 0) < 1e-9 THEN 0.5 ELSE sum(CASE WHEN sign(d) = sg THEN m ELSE 0.0 END) / sum(m) END AS agree FROM gs GROUP BY 1, 2)"""
FITTED = MEDIAN + VOTE + SMOOTH + EVID.replace("ev AS", "plain_ev AS") + ", ev AS (SELECT device_id, h, e * (0.5 + 0.5 * agree) AS e FROM plain_ev JOIN vt USING (device_id, h))" + ADAPT
_add("adaptive_fit_devices", lambda s, d: segment.fit_devices(readings(s, d)).select("device_id", "cut.*", "score", "peak_hour"), R + CAND + DAYS + ", dd AS (SELECT device_id, day, h, kwh AS v FROM dh)" + FITTED + " SELECT device_id, b1, b2, b3, score, peak_hour FROM ab JOIN (SELECT device_id, min(h) FILTER (v = m) AS peak_hour FROM (SELECT *, max(v) OVER (PARTITION BY device_id) AS m FROM prof) GROUP BY 1) USING (device_id)", doubles="score", ints="b1 b2 b3 peak_hour")
DAY_OF = ", ix AS (SELECT device_id, day, row_number() OVER (PARTITION BY device_id ORDER BY day) AS i FROM (SELECT DISTINCT device_id, day FROM dh))"
PRIOR = DAY_OF + ", dd AS (SELECT a.device_id || ' ' || a.day AS device_id, dh.day, dh.h, dh.kwh AS v FROM ix a JOIN ix b ON a.device_id = b.device_id AND b.i BETWEEN a.i - 7 AND a.i - 1 JOIN dh ON dh.device_id = b.device_id AND dh.day = b.day WHERE a.i > 7)"
OF_DAY = "(SELECT device_id AS k, b1, b2, b3 FROM ab) ON k = device_id || ' ' || day"
_add("adaptive_daily_totals", lambda s, d: segment.adaptive_daily(readings(s, d), 7), R + CAND + DAYS + PRIOR + FITTED + f" SELECT device_id, day, {TOTALS} FROM full_dh JOIN {OF_DAY} GROUP BY device_id, day, b1, b2, b3", **KINDS)
_add("segment_features", lambda s, d: segment.segment_features(segment.jenks(segment.mean_profile(readings(s, d)))), R + CAND + MEAN + JENKS.format("prof") + " SELECT device_id, (h >= b1)::INT + (h >= b2)::INT + (h >= b3)::INT AS segment, avg(v) AS mean, max(v) AS max, min(v) AS min, stddev_samp(v) AS std, sum(v) AS total FROM prof JOIN best USING (device_id) GROUP BY 1, 2", doubles="mean max min std total", ints="segment")
# Of the reference's lines: days [start, end) scored, shape of all days before start, forecast by the 7 days before.
M = """, ix AS (SELECT *, dense_rank() OVER (PARTITION BY device_id ORDER BY day) - 1 AS i FROM full_dh), m AS (SELECT device_id, i, h, v, avg(v) OVER (PARTITION BY device_id, h ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS p, max(i) OVER (PARTITION BY device_id) + 1 AS n FROM ix)"""


def _phase(name: str, start: str, end: str, least: int = 0) -> str:
    return f""", {name}_s AS (SELECT device_id, h, avg(v) AS s FROM m WHERE i < {start} GROUP BY 1, 2),
{name}_g AS (SELECT device_id, i, h, v, c, b1, b2, b3, s, sum(p) OVER w AS total, sum(s) OVER w AS base, count(*) OVER w AS len FROM m JOIN {name}_s USING (device_id, h) CROSS JOIN cand WHERE i >= {start} AND i < {end} AND n >= {least}
  WINDOW w AS (PARTITION BY device_id, i, c, (h >= b1)::INT + (h >= b2)::INT + (h >= b3)::INT)),
{name} AS (SELECT device_id, c AS candidate, b1, b2, b3, avg(abs(v - total * CASE WHEN base > 1e-12 THEN s / base ELSE 1.0 / len END)) AS error FROM {name}_g GROUP BY 1, 2, 3, 4, 5),
{name}_r AS (SELECT b1 AS r1, b2 AS r2, b3 AS r3 FROM (SELECT candidate, b1, b2, b3, round(avg(error / greatest(mean, 1e-12)), 12) AS e FROM (SELECT *, avg(error) OVER (PARTITION BY device_id) AS mean FROM {name}) GROUP BY 1, 2, 3, 4) ORDER BY e, candidate LIMIT 1),
{name}_p AS (SELECT device_id, l, candidate, b1, b2, b3 FROM (SELECT *, error / greatest(min(error) OVER (PARTITION BY device_id), 1e-12) - 1 AS rel, abs(b1 - r1) + abs(b2 - r2) + abs(b3 - r3) AS dist FROM {name} CROSS JOIN {name}_r) CROSS JOIN lam QUALIFY row_number() OVER (PARTITION BY device_id, l ORDER BY CASE WHEN isinf(l) THEN dist ELSE round(rel + l * dist, 12) END, candidate) = 1)"""


LAM = ", lam(l) AS (VALUES (0.0::DOUBLE), (0.002), (0.005), (0.01), (0.02), (0.05), ('Infinity'::DOUBLE))"
#: Days to select and to tune on: the table has a month only.
SELECT, TUNE = 14, 7
_add("fsas_proxy_error", lambda s, d: segment.proxy_errors(segment.day_arrays(readings(s, d)), F.greatest(F.lit(7), F.col("_n") - SELECT), F.col("_n")), R + CAND + LAM + DAYS + M + _phase("er", f"greatest(7, n - {SELECT})", "n") + " SELECT device_id, candidate, b1, b2, b3, error FROM er", doubles="error", ints="candidate b1 b2 b3")
_add("fsas_choice", lambda s, d: _cut(segment.forecast_aware(segment.proxy_errors(segment.day_arrays(readings(s, d)), F.greatest(F.lit(7), F.col("_n") - SELECT), F.col("_n")), 0.005)), R + CAND + LAM + DAYS + M + _phase("er", f"greatest(7, n - {SELECT})", "n") + " SELECT device_id, b1, b2, b3 FROM er_p WHERE l = 0.005", ints="b1 b2 b3")
LEAST = 7 + TUNE + segment.SPARE_DAYS
FIT = R + CAND + LAM + DAYS + M + _phase("ea", f"greatest(7, n - {TUNE} - {SELECT})", f"n - {TUNE}", LEAST) + _phase("et", f"n - {TUNE}", "n", LEAST) + _phase("ef", f"greatest(7, n - {SELECT})", "n", LEAST) + """, curve AS (SELECT l, avg(error / greatest(mean, 1e-12)) AS e FROM ea_p JOIN (SELECT *, avg(error) OVER (PARTITION BY device_id) AS mean FROM et) USING (device_id, candidate) GROUP BY 1),
best AS (SELECT max(l) AS l FROM curve WHERE e <= (SELECT min(e) FROM curve) * 1.0005)
SELECT device_id, coalesce(b1, 6) AS b1, coalesce(b2, 12) AS b2, coalesce(b3, 18) AS b3, b1 IS NOT NULL AS fitted FROM (SELECT DISTINCT device_id FROM dh) LEFT JOIN (SELECT * FROM ef_p SEMI JOIN best USING (l)) USING (device_id)"""
_add("fsas_fit", lambda s, d: segment.frozen_cuts(segment.day_arrays(readings(s, d)), (6, 12, 18), tune_days=TUNE, select_days=SELECT).select("device_id", "cut.*", "fitted"), FIT, ints="b1 b2 b3")
_add("fsas_groups", lambda s, d: segment.frozen_cuts(segment.day_arrays(readings(s, d)), (6, 12, 18), segment.shape_groups(segment.day_arrays(readings(s, d)), 2), TUNE, SELECT).select("device_id", "cut.*", "fitted"))


def _actuals(s, d):
    return daily_actuals(readings(s, d), window_days=7).drop("cut")


ENDING = DAY_OF + ", dd AS (SELECT a.device_id || ' ' || a.day AS device_id, dh.day, dh.h, dh.kwh AS v FROM ix a JOIN dh ON a.device_id = dh.device_id AND dh.day BETWEEN a.day - 6 AND a.day)"
OWN = f", own AS (SELECT device_id, day, h, kwh, coalesce(kwh, avg(kwh) OVER (PARTITION BY device_id, day)) AS v FROM ix CROSS JOIN {HOURLY} LEFT JOIN dh USING (device_id, day, h)), pk AS (SELECT *, max(v) OVER (PARTITION BY device_id, day) AS m FROM own)"
ACTUAL = ", ".join(f"sum(CASE WHEN (h >= b1)::INT + (h >= b2)::INT + (h >= b3)::INT = {k} THEN coalesce(kwh, 0.0) ELSE 0.0 END) AS actual_seg{k}" for k in range(4))
_add("daily_actuals", _actuals, R + CAND + DAYS + ENDING + FITTED + OWN + f" SELECT * EXCLUDE (b1, b2, b3), (peak_hour >= b1)::INT + (peak_hour >= b2)::INT + (peak_hour >= b3)::INT AS peak_segment FROM (SELECT device_id, day, b1, b2, b3, {ACTUAL}, min(h) FILTER (v = m) AS peak_hour, max(v) AS peak_value FROM pk JOIN {OF_DAY} GROUP BY device_id, day, b1, b2, b3 HAVING count(kwh) >= 20)", doubles="actual_seg0 actual_seg1 actual_seg2 actual_seg3 peak_value", ints="peak_hour peak_segment", texts="day")


def entry(spark, sf_dir: str):
    """The flagship query over tables too sparse for whole days: one device's days of an hour or more."""
    rows = clean.whole_days(readings(spark, sf_dir), 1)
    return plain(segment.jenks_daily(rows))
