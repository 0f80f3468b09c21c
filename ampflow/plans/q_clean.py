"""Queries: scans, lookups, joins, sets, cleaning, calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampflow.functions import calendar as cal
from ampflow.operators import clean, lookups
from ampflow.plans.adapters import d_sql, daily, meter, plain, r_sql, readings, sql, table
from ampflow.sources import readers, sinks

R, RU, D = f"WITH r AS ({r_sql()}) ", f"WITH r AS ({r_sql(None)}) ", f"WITH d AS ({d_sql()}) "
M = "WITH m AS (SELECT event_id AS id, user_id % 4 AS device_id, value * 1000 AS power_W, date_trunc('hour', ts) + INTERVAL 1 HOUR AS created_at FROM events) "
O = "WITH o AS (SELECT o_custkey AS device_id, o_orderdate AS generated_at, o_totalprice AS value, o_orderkey AS id FROM orders) "  # noqa: E741
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, body: str | None = None, **kinds) -> None:
    QUERIES[name] = lambda spark, sf: plain(query(spark, sf))
    if body:
        ORACLES[name] = sql(body, **kinds)


def _orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("device_id"), F.col("o_orderdate").alias("generated_at"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("id"))


_add("scan_readings", lambda s, d: readers.history(meter(s, d)), M + "SELECT device_id, created_at - INTERVAL 1 HOUR AS ts, power_W / 1000.0 AS kwh FROM m", doubles="kwh", texts="ts")
_add("device_history", lambda s, d: readers.history(meter(s, d), 2), M + "SELECT device_id, created_at - INTERVAL 1 HOUR AS ts, power_W / 1000.0 AS kwh FROM m WHERE device_id = 2", doubles="kwh", texts="ts")


def _day_rows(s, d):
    import datetime

    return readers.day_rows(meter(s, d), 1, datetime.date(2024, 1, 10))


_add("device_day_rows", _day_rows, M + "SELECT id, hour(created_at - INTERVAL 1 HOUR) AS hour, power_W / 1000.0 AS kwh FROM m WHERE device_id = 1 AND created_at >= TIMESTAMP '2024-01-10 01:00:00' AND created_at < TIMESTAMP '2024-01-11 01:00:00'", doubles="kwh", ints="hour")
_add("recent_window", lambda s, d: readers.recent(readings(s, d), F.lit("2024-01-20").cast("date"), 7), R + "SELECT device_id, ts, kwh FROM r WHERE ts >= DATE '2024-01-14' AND ts < DATE '2024-01-21'", doubles="kwh", texts="ts")
_add("devices_distinct", lambda s, d: lookups.devices(readings(s, d, None)), "SELECT DISTINCT user_id AS device_id FROM events")
_add("device_first_last_day", lambda s, d: lookups.first_last_day(meter(s, d)), M + "SELECT device_id, CAST(min(created_at) - INTERVAL 1 HOUR AS DATE) AS first_day, CAST(max(created_at) - INTERVAL 1 HOUR AS DATE) AS last_day FROM m GROUP BY 1", texts="first_day last_day")
_add("actual_dates_between", lambda s, d: lookups.days_between(_orders(s, d), "1996-01-01", "1996-06-30", "generated_at"), O + "SELECT DISTINCT device_id, CAST(generated_at AS DATE) AS day FROM o WHERE CAST(generated_at AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-06-30'", texts="day")


_add("latest_per_device_ties", lambda s, d: lookups.latest_per_device(_orders(s, d), "generated_at"), O + "SELECT device_id, generated_at, value, id FROM o WHERE (device_id, generated_at) IN (SELECT device_id, max(generated_at) FROM o GROUP BY 1)", doubles="value", texts="generated_at")
_add("top1_latest", lambda s, d: lookups.latest(_orders(s, d), "generated_at", "id"), O + "SELECT device_id, generated_at, value, id FROM o ORDER BY generated_at DESC, id DESC LIMIT 1", doubles="value", texts="generated_at")
_add("point_lookup", lambda s, d: lookups.result(sinks.newest(_orders(s, d), ["device_id"], "generated_at", "id"), 7), O + "SELECT device_id, generated_at, value, id FROM o WHERE device_id = 7 ORDER BY generated_at DESC, id DESC LIMIT 1", doubles="value", texts="generated_at")
#: A device and a day that every size of the table has.
_add("period_lookup", lambda s, d: lookups.result(daily(s, d, "l_linenumber").select("device_id", "day", "seg0"), 1, F.lit("1996-06-03").cast("date"), "day"), f"WITH d AS ({d_sql('l_linenumber')}) SELECT device_id, day, seg0 FROM d WHERE device_id = 1 AND day = DATE '1996-06-03'", doubles="seg0", texts="day")
_add("keep_last", lambda s, d: sinks.newest(_orders(s, d), ["device_id"], "generated_at", "id"), O + "SELECT device_id, generated_at, value, id FROM o QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY generated_at DESC, id DESC) = 1", doubles="value", texts="generated_at")


def _upsert(s, d):
    o = _orders(s, d).select("device_id", F.to_date("generated_at").alias("day"), "value", "generated_at", "id")
    one = sinks.newest(o, ["device_id", "day"], "generated_at", "id").drop("id")
    new = one.where("device_id % 3 = 0").withColumn("value", F.col("value") + 1)
    return sinks.upserted(one, new, ["device_id", "day"], "generated_at").select("device_id", "day", "value")


_add("upsert_newest", _upsert, O + "SELECT device_id, CAST(generated_at AS DATE) AS day, CASE WHEN device_id % 3 = 0 THEN value + 1 ELSE value END AS value FROM o QUALIFY row_number() OVER (PARTITION BY device_id, CAST(generated_at AS DATE) ORDER BY generated_at DESC, id DESC) = 1", doubles="value", texts="day")
_add("tag_rows", lambda s, d: sinks.tagged(meter(s, d).withColumn("segment_id", F.lit(9)).withColumn("is_peak_hour", F.lit(False)), meter(s, d).where("device_id = 1").select("id", F.lit(2).alias("segment_id"), (F.col("id") % 2 == 0).alias("is_peak_hour"))).select("id", "segment_id", "is_peak_hour"), M + "SELECT id, CASE WHEN device_id = 1 THEN 2 ELSE 9 END AS segment_id, device_id = 1 AND id % 2 = 0 AS is_peak_hour FROM m", ints="segment_id")
_add("dedupe_mean", lambda s, d: clean.deduplicated(table(s, d, "events").select((F.col("user_id") % 4).alias("device_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("kwh"))), "SELECT user_id % 4 AS device_id, date_trunc('hour', ts) AS ts, avg(value) AS kwh FROM events GROUP BY 1, 2", doubles="kwh", texts="ts")
_add("non_negative", lambda s, d: clean.non_negative(readings(s, d).withColumn("kwh", F.col("kwh") - 200)), R + "SELECT device_id, ts, kwh - 200 AS kwh FROM r WHERE kwh - 200 >= 0", doubles="kwh", texts="ts")
_add("time_features", lambda s, d: clean.with_time(readings(s, d)), R + "SELECT device_id, ts, kwh, CAST(ts AS DATE) AS day, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, month(ts) AS month, CAST(isodow(ts) >= 6 AS INT) AS is_weekend FROM r", doubles="kwh", ints="hour day_of_week month is_weekend", texts="ts day")
_add("bad_days_semi", lambda s, d: clean.whole_days(readings(s, d, 5)), f"WITH r AS ({r_sql(5)}) SELECT device_id, ts, kwh FROM r WHERE (device_id, CAST(ts AS DATE)) IN (SELECT device_id, CAST(ts AS DATE) FROM r GROUP BY 1, 2 HAVING count(*) >= 20)", doubles="kwh", texts="ts")
_add("missing_days_anti", lambda s, d: clean.missing_days(daily(s, d), F.lit("1996-01-01").cast("date"), F.lit("1996-03-31").cast("date")), D + "SELECT v.device_id, v.day FROM (SELECT DISTINCT device_id, CAST(g.day AS DATE) AS day FROM d, generate_series(DATE '1996-01-01', DATE '1996-03-31', INTERVAL 1 DAY) g(day)) v ANTI JOIN d ON v.device_id = d.device_id AND v.day = d.day", texts="day")
_add("day_set_except", lambda s, d: daily(s, d).where("device_id = 1").select("day").exceptAll(daily(s, d).where("device_id = 2").select("day")), D + "SELECT day FROM d WHERE device_id = 1 EXCEPT SELECT day FROM d WHERE device_id = 2", texts="day")
_add("devices_intersect", lambda s, d: table(s, d, "orders").select(F.col("o_custkey").alias("device_id")).intersect(table(s, d, "events").select("user_id")), "SELECT o_custkey AS device_id FROM orders INTERSECT SELECT user_id FROM events")
_add("union_arms", lambda s, d: daily(s, d).select(F.lit("a").alias("arm"), "device_id", "day", "seg0").unionByName(daily(s, d).select(F.lit("b").alias("arm"), "device_id", "day", F.col("seg1").alias("seg0"))), D + "SELECT 'a' AS arm, device_id, day, seg0 FROM d UNION ALL SELECT 'b', device_id, day, seg1 FROM d", doubles="seg0", texts="day")

SPINE = """, e AS (SELECT device_id, min(ts) AS a, max(ts) AS b FROM r GROUP BY 1), s AS (SELECT device_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM e),
j AS (SELECT s.device_id, s.ts, r.kwh, row_number() OVER w AS i FROM s LEFT JOIN r ON s.device_id = r.device_id AND s.ts = r.ts WINDOW w AS (PARTITION BY s.device_id ORDER BY s.ts)),
k AS (SELECT *, last_value(CASE WHEN kwh IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, last_value(kwh IGNORE NULLS) OVER b AS pv, first_value(CASE WHEN kwh IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ni, first_value(kwh IGNORE NULLS) OVER f AS nv FROM j
  WINDOW b AS (PARTITION BY device_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY device_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT device_id, ts, coalesce(kwh, CASE WHEN i - pi <= 6 OR ni - i <= 6 THEN pv + (nv - pv) * (i - pi) / (ni - pi) END) AS kwh FROM k),
filled AS (SELECT device_id, ts, kwh FROM l QUALIFY count(*) FILTER (kwh IS NULL) OVER (PARTITION BY device_id, CAST(ts AS DATE)) = 0) """
_add("hour_spine_fill", lambda s, d: clean.filled(readings(s, d, None)), RU + SPINE + "SELECT device_id, ts, kwh FROM filled", doubles="kwh", texts="ts")
CLIP = "SELECT r.device_id, r.ts, CASE WHEN q.n >= 50 THEN greatest(least(r.kwh, q.hi), q.lo) ELSE r.kwh END AS kwh FROM {0} r JOIN (SELECT device_id, count(*) AS n, quantile_cont(kwh, 0.01) AS lo, quantile_cont(kwh, 0.99) AS hi FROM {0} GROUP BY 1) q ON r.device_id = q.device_id"
_add("winsor_clip", lambda s, d: clean.clipped(readings(s, d)), R + CLIP.format("r"), doubles="kwh", texts="ts")
PRE = f"WITH r0 AS ({r_sql(5)}), r AS (SELECT * FROM r0 WHERE kwh >= 0 QUALIFY count(*) OVER (PARTITION BY device_id, CAST(ts AS DATE)) >= 20)" + SPINE
_add("preprocess_chain", lambda s, d: clean.preprocess(readings(s, d, 5)), PRE + f"SELECT device_id, ts, kwh, CAST(ts AS DATE) AS day, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, month(ts) AS month, CAST(isodow(ts) >= 6 AS INT) AS is_weekend FROM ({CLIP.format('filled')})", doubles="kwh", ints="hour day_of_week month is_weekend", texts="ts day")
_add("last_n_days", lambda s, d: clean.last_days(readings(s, d, None), 7), RU + "SELECT device_id, ts, kwh FROM (SELECT *, dense_rank() OVER (PARTITION BY device_id ORDER BY CAST(ts AS DATE) DESC) AS n FROM r) QUALIFY n <= 7 AND max(n) OVER (PARTITION BY device_id) >= 7", doubles="kwh", texts="ts")
_add("device_status", lambda s, d: clean.device_status(daily(s, d).select("device_id", F.col("day").alias("ts"))), D + "SELECT device_id, count(DISTINCT day) AS days, CASE WHEN count(DISTINCT day) < 61 THEN 'learning' WHEN count(DISTINCT day) < 30 THEN 'global' ELSE 'personal' END AS status, count(DISTINCT day) >= 61 AS can_predict FROM d GROUP BY 1", ints="days")
_add("dense_device_codes", lambda s, d: readers.dense_ids(table(s, d, "supplier").select("s_name"), "s_name", "device_id"), "SELECT s_name, dense_rank() OVER (ORDER BY s_name) AS device_id FROM supplier", ints="device_id")
_add("calendar_gaps", lambda s, d: _gaps(daily(s, d)), D + "SELECT count(*) AS rows, count(DISTINCT device_id) AS devices, min(day) AS first_day, max(day) AS last_day, count(*) FILTER (g > 1) AS gaps FROM (SELECT *, date_diff('day', lag(day) OVER (PARTITION BY device_id ORDER BY day), day) AS g FROM d)", ints="rows devices gaps", texts="first_day last_day")


def _gaps(df):
    from pyspark.sql.window import Window

    step = F.datediff("day", F.lag("day").over(Window.partitionBy("device_id").orderBy("day")))
    return df.withColumn("g", step).agg(F.count("*").alias("rows"), F.count_distinct("device_id").alias("devices"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_if(F.col("g") > 1).alias("gaps"))


def _days(s, d):
    return table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()


DAYS = "SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem"
_add("saturday_weeks", lambda s, d: _days(s, d).select("day", cal.saturday_of(F.col("day")).alias("week_start"), cal.friday_of(F.col("day")).alias("week_end"), cal.next_week(F.col("day"))["start"].alias("next_start")), f"SELECT day, day - CAST((isodow(day) + 1) % 7 AS INT) AS week_start, day - CAST((isodow(day) + 1) % 7 AS INT) + 6 AS week_end, CASE WHEN isodow(day) = 6 THEN day ELSE day - CAST((isodow(day) + 1) % 7 AS INT) + 7 END AS next_start FROM ({DAYS})", texts="day week_start week_end next_start")


def _jalali(s, d):
    day = F.col("day")
    return _days(s, d).select("day", cal.jalali(day).alias("j"), cal.jalali_month_start(day).alias("month_start"), cal.jalali_month_end(day).alias("month_end")).select("day", "j.*", "month_start", "month_end")


JAL = f"""WITH x AS (SELECT day, date_diff('day', DATE '1970-01-01', day) AS n FROM ({DAYS})),
ys AS (SELECT y, 365 * y + floor((8 * y + 21) / 33.0)::BIGINT - 492633 AS a, 365 * (y + 1) + floor((8 * (y + 1) + 21) / 33.0)::BIGINT - 492633 AS b FROM generate_series(1300, 1450) t(y)),
p AS (SELECT day, n, y AS jy, n - a AS pos, b - a AS len FROM x JOIN ys ON n >= a AND n < b)
SELECT day, jy, CASE WHEN pos < 186 THEN pos // 31 + 1 ELSE (pos - 186) // 30 + 7 END AS jm, CASE WHEN pos < 186 THEN pos % 31 + 1 ELSE (pos - 186) % 30 + 1 END AS jd,
  day - CAST(CASE WHEN pos < 186 THEN pos % 31 ELSE (pos - 186) % 30 END AS INT) AS month_start,
  day - CAST(CASE WHEN pos < 186 THEN pos % 31 ELSE (pos - 186) % 30 END AS INT) + CAST(CASE WHEN pos < 186 THEN 31 WHEN pos < 336 THEN 30 ELSE len - 336 END AS INT) - 1 AS month_end FROM p"""
_add("jalali_dates", _jalali, JAL, ints="jy jm jd", texts="day month_start month_end")
