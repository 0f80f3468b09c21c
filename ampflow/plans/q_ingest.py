"""Queries: half-hourly households, gaps, clocks, sanity."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ampflow.operators import ingest
from ampflow.plans.adapters import H_SQL, RH_SQL, half_hours, plain, r_sql, raw_half_hours, readings, sql, table
from ampflow.sources.readers import day_matrices, household_ids, sensor_messages

H = f"WITH h AS ({H_SQL})"
R, RU = f"WITH r AS ({r_sql()})", f"WITH r AS ({r_sql(None)})"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FIRST, END = date(2024, 1, 1), date(2024, 1, 31)


def _add(name: str, query, body: str | None = None, **kinds) -> None:
    QUERIES[name] = lambda spark, sf: plain(query(spark, sf))
    if body:
        ORACLES[name] = sql(body, **kinds)


SCAN = H + ", sc AS (SELECT household, stamp[1:7] AS month, count(*) AS n_rows, count(*) FILTER (kwh >= 0) AS n_valid, count(*) FILTER (lower(tariff) = 'std') AS n_std, count(*) FILTER (lower(tariff) <> 'std') AS n_other FROM h GROUP BY 1, 2)"
_add("scan_month_quality", lambda s, d: ingest.scan(half_hours(s, d)), SCAN + " SELECT * FROM sc")
_add("household_coverage", lambda s, d: ingest.households(ingest.scan(half_hours(s, d)), ["2024-01"], 1488), SCAN + " SELECT household, sum(n_other) = 0 AND sum(n_std) > 0 AS std_only, least(sum(n_valid) FILTER (month = '2024-01') / 1488.0, 1.0) AS coverage FROM sc GROUP BY 1", doubles="coverage")


def _order_scan(s, d):
    o = table(s, d, "orders")
    return o.groupBy(F.col("o_custkey").cast("string").alias("household"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg((F.count("*") * 600).alias("n_valid"))


_add("window_suggestions", lambda s, d: ingest.windows(_order_scan(s, d), 0.05), """WITH sc AS (SELECT CAST(o_custkey AS VARCHAR) AS household, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) * 600 AS n_valid FROM orders GROUP BY 1, 2), e AS (SELECT min(m) AS a, max(m) AS b FROM sc),
w AS (SELECT size, CAST(start AS DATE) AS start, CAST(start + to_months(size) AS DATE) AS stop FROM (SELECT unnest([6, 9, 12]) AS size), (SELECT unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS start FROM e), e WHERE start + to_months(size - 1) <= b),
hm AS (SELECT size, start, household FROM w JOIN sc ON m >= start AND m < stop GROUP BY size, start, stop, household HAVING sum(n_valid) >= 0.05 * 48 * date_diff('day', start, stop)),
c AS (SELECT size, start, count(*) AS homes FROM hm GROUP BY 1, 2)
SELECT size, strftime(start, '%Y-%m') AS start, homes, row_number() OVER (PARTITION BY size ORDER BY homes DESC, start) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY size ORDER BY homes DESC, start) <= 3""", ints="size homes rank")
# Of rows that repeat a stamp the first counts; an hour needs both halves, and no third reading.
HOURLY = f"""WITH h AS ({RH_SQL}), inw AS (SELECT *, kwh IS NOT NULL AND kwh >= 0 AS ok FROM h WHERE stamp >= DATE '2024-01-01' AND stamp < DATE '2024-01-31'),
sl AS (SELECT * FROM inw WHERE ok QUALIFY row_number() OVER (PARTITION BY household, stamp ORDER BY place) = 1),
hh AS (SELECT household, date_trunc('hour', stamp) AS ts, sum(kwh) AS kwh, count(*) AS n FROM sl GROUP BY 1, 2), ho AS (SELECT household, ts, kwh FROM hh WHERE n = 2)"""


def _hourly(s, d):
    return ingest.hourly(raw_half_hours(s, d), FIRST, END).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_add("half_hour_to_hour", _hourly, HOURLY + " SELECT * FROM ho", doubles="kwh", texts="ts")
_add("ingest_quality_counts", lambda s, d: ingest.collect_counts(raw_half_hours(s, d), FIRST, END), HOURLY + """ SELECT (SELECT count(*) FROM h) AS rows_selected_homes, (SELECT count(*) FROM h WHERE stamp IS NULL) AS rows_bad_timestamp, (SELECT count(*) FROM inw) AS rows_in_window, (SELECT count(*) FROM inw WHERE kwh IS NULL) AS rows_null_kwh, (SELECT count(*) FROM inw WHERE kwh < 0) AS rows_negative_kwh, (SELECT count(*) FROM inw WHERE ok AND minute(stamp) NOT IN (0, 30)) AS rows_off_grid_minute,
  (SELECT count(*) FROM inw WHERE ok) - (SELECT count(*) FROM sl) AS rows_duplicate, (SELECT count(*) FROM hh) AS hours_seen, (SELECT count(*) FROM hh WHERE n = 1) AS hours_one_half_hour_only, (SELECT count(*) FROM hh WHERE n > 2) AS hours_more_than_two_readings""")


def _gaps(s, d):
    index = F.datediff(F.to_date("ts"), F.lit(FIRST)) * 24 + F.hour("ts")
    return ingest.longest_gap(readings(s, d, None), index, 720, "device_id")


_add("longest_gap", _gaps, RU + ", i AS (SELECT DISTINCT device_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS i FROM r), g AS (SELECT *, i - lag(i, 1, -1) OVER (PARTITION BY device_id ORDER BY i) - 1 AS g FROM i WHERE i BETWEEN 0 AND 719) SELECT device_id, count(*) AS present, greatest(max(g), 719 - max(i)) AS longest_gap FROM g GROUP BY 1", ints="present longest_gap")
QUALITY = HOURLY + ", sa AS (SELECT * FROM ho WHERE kwh <= 900), i AS (SELECT household, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS i FROM sa), g AS (SELECT *, i - lag(i, 1, -1) OVER (PARTITION BY household ORDER BY i) - 1 AS g FROM i), q AS (SELECT household, count(*) / 720.0 AS hourly_coverage, greatest(max(g), 719 - max(i)) AS max_gap_hours, count(*) AS n_hours FROM g GROUP BY 1), qt AS (SELECT *, hourly_coverage >= 0.2 AS pass_coverage, max_gap_hours <= 14 AS pass_gap, hourly_coverage >= 0.2 AND max_gap_hours <= 14 AS keep FROM q)"
LIMITS = (FIRST, END, 0.2, 14, 900.0)
_add("household_quality", lambda s, d: ingest.quality(_hourly(s, d), *LIMITS), QUALITY + " SELECT household, ts, kwh FROM sa SEMI JOIN (SELECT household FROM qt WHERE keep) USING (household)", doubles="kwh", texts="ts")
_add("household_quality_table", lambda s, d: ingest.quality_table(_hourly(s, d), *LIMITS), QUALITY + " SELECT * FROM qt", doubles="hourly_coverage", ints="max_gap_hours n_hours")
_add("household_quality_counts", lambda s, d: ingest.quality_counts(_hourly(s, d), ingest.quality_table(_hourly(s, d), *LIMITS), 900.0), QUALITY + " SELECT (SELECT count(*) FROM ho WHERE kwh > 900) AS hours_above_max_kwh_dropped, count(*) FILTER (NOT pass_coverage) AS homes_failed_hourly_coverage, count(*) FILTER (NOT pass_gap) AS homes_failed_max_gap, count(*) FILTER (keep) AS households_kept FROM qt")
_add("household_ids", lambda s, d: household_ids(half_hours(s, d).select("household").distinct()))
#: The table's month moved to where clocks in London go back, on 27 October 2024 at 1:00 UTC.
_add("local_wallclock", lambda s, d: ingest.to_wall_clock(readings(s, d).select("device_id", (F.col("ts") + F.expr("interval 285 days")).cast("timestamp").alias("ts"), "kwh"), "Europe/London", "device_id").withColumn("ts", F.col("ts").cast("timestamp_ntz")), R + ", u AS (SELECT device_id, ts + INTERVAL 285 DAY AS ts, kwh FROM r) SELECT device_id, CASE WHEN ts < TIMESTAMP '2024-10-27 01:00:00' THEN ts + INTERVAL 1 HOUR ELSE ts END AS ts, avg(kwh) AS kwh FROM u GROUP BY 1, 2", doubles="kwh", texts="ts")
_add("dst_signature", lambda s, d: ingest.dst_signature(readings(s, d, 5), "device_id"), f"WITH r AS ({r_sql(5)}), c AS (SELECT device_id, CAST(ts AS DATE) AS day, count(*) AS n FROM r GROUP BY 1, 2), m AS (SELECT day, n, count(*) AS k FROM c GROUP BY 1, 2), f AS (SELECT day, avg((n = 24)::INT) AS fullness FROM c GROUP BY 1) SELECT day, n AS usual_rows FROM m JOIN f USING (day) WHERE fullness < 0.5 QUALIFY row_number() OVER (PARTITION BY day ORDER BY k DESC, n) = 1", ints="usual_rows", texts="day")
_add("sanity_report", lambda s, d: ingest.sanity(readings(s, d, None), "device_id"), RU + ", m AS (SELECT device_id, avg(kwh) AS m FROM r GROUP BY 1) SELECT homes, rows, min, max, median, p99, zero_share, home_q1, home_median, home_q3 FROM (SELECT count(DISTINCT device_id) AS homes, count(*) AS rows, min(kwh) AS min, max(kwh) AS max, quantile_cont(kwh, 0.5) AS median, quantile_cont(kwh, 0.99) AS p99, avg((kwh = 0)::INT) AS zero_share FROM r), (SELECT quantile_cont(m, 0.25) AS home_q1, quantile_cont(m, 0.5) AS home_median, quantile_cont(m, 0.75) AS home_q3 FROM m)", doubles="min max median p99 zero_share home_q1 home_median home_q3", ints="homes rows")


def _season(s, d):
    rows = readings(s, d)
    return ingest.season_shift(rows.withColumn("ts", F.when(F.dayofmonth("ts") > 15, F.col("ts") + F.expr("interval 182 days")).otherwise(F.col("ts"))))


_add("season_shift_corr", _season, R + ", r2 AS (SELECT device_id, CASE WHEN day(ts) > 15 THEN ts + INTERVAL 182 DAY ELSE ts END AS ts, kwh FROM r), p AS (SELECT hour(ts) AS h, avg(kwh) FILTER (month(ts) IN (12, 1, 2)) AS w, avg(kwh) FILTER (month(ts) IN (6, 7, 8)) AS s FROM r2 WHERE isodow(ts) < 6 GROUP BY 1), k AS (SELECT unnest([-2, -1, 0, 1, 2]) AS shift) SELECT shift, corr(a.w, b.s) AS corr FROM k CROSS JOIN p b JOIN p a ON a.h = (b.h + shift + 24) % 24 GROUP BY 1", doubles="corr", ints="shift")
_add("day_matrices", lambda s, d: day_matrices(readings(s, d, 5)).select("device_id", "day", *[F.col("v")[h].alias(f"h{h}") for h in range(24)]), f"WITH r AS ({r_sql(5)}) SELECT device_id, CAST(ts AS DATE) AS day, " + ", ".join(f"coalesce(sum(kwh) FILTER (hour(ts) = {h}), 0.0) AS h{h}" for h in range(24)) + " FROM r GROUP BY 1, 2 HAVING count(DISTINCT hour(ts)) >= 20", doubles=" ".join(f"h{h}" for h in range(24)), texts="day")
_add("sensor_json", lambda s, d: sensor_messages(table(s, d, "events").select("event_id", F.concat(F.lit('{"power_W": '), F.col("value").cast("string"), F.lit(', "voltage_V": 230.0}')).alias("value"))).select("power_W", "voltage_V"), "SELECT value AS \"power_W\", 230.0 AS \"voltage_V\" FROM events", doubles='"power_W" "voltage_V"')
ORACLES["household_ids"] = H + " SELECT DISTINCT household, CAST(regexp_extract(household, '^[A-Za-z]+0*([0-9]+)$', 1) AS BIGINT) AS device_id FROM h"
