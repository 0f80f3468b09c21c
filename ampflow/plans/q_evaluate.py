"""Queries: errors of forecasts, routes, baselines, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampflow.operators import cluster, evaluate, models
from ampflow.operators import features as feats
from ampflow.plans.adapters import F_SQL, d_sql, daily, forecasts, plain, r_sql, readings, sql, table

P = f"WITH f AS ({F_SQL})"
D = f"WITH d AS ({d_sql()})"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, body: str | None = None, **kinds) -> None:
    QUERIES[name] = lambda spark, sf: plain(query(spark, sf))
    if body:
        ORACLES[name] = sql(body, **kinds)


R2 = "1 - sum((p - y) * (p - y)) / (var_pop(y) * count(y)) AS r2"
SHARE = f"sum(abs(p - y)) / sum(abs(y)) * 100 AS wape, avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse, {R2}, avg(abs(p - y) / nullif(abs(y), 0)) * 100 AS mape, avg(coalesce(2 * abs(p - y) / nullif(abs(y) + abs(p), 0), 0)) * 100 AS smape, sum(p - y) / sum(y) * 100 AS bias, count(*) AS n"
ANGLE = f"avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse, avg(abs(p - y) / CASE WHEN abs(y) > 1e-8 THEN abs(y) END) * 100 AS mape, degrees(avg(atan(abs(p - y) / (abs(y) + 1e-8)))) AS maape, {R2}"
_add("metrics_wape", lambda s, d: evaluate.measure(forecasts(s, d), "y", "p"), P + f" SELECT {SHARE} FROM f", doubles="wape mae rmse r2 mape smape bias", ints="n")
_add("metrics_mape_maape", lambda s, d: evaluate.measure(forecasts(s, d), "y", "p", metrics=evaluate.angle_metrics), P + f" SELECT {ANGLE} FROM f", doubles="mae rmse mape maape r2")
_add("metrics_by_target", lambda s, d: evaluate.by_target(forecasts(s, d), {"one": ("y", "p"), "two": ("y", "p2")}), P + f", u AS (SELECT 'one' AS target, y, p FROM f UNION ALL SELECT 'two', y, p2 FROM f), v AS (SELECT * FROM u UNION ALL SELECT 'overall', y, p FROM u) SELECT target, {ANGLE} FROM v GROUP BY 1", doubles="mae rmse mape maape r2")
_add("route_report", lambda s, d: evaluate.measure(forecasts(s, d), "y", "p", "route").withColumn("devices", F.lit(0)).drop("devices"), P + f" SELECT route, {SHARE} FROM f GROUP BY 1", doubles="wape mae rmse r2 mape smape bias", ints="route n")
_add("train_mean_baseline", lambda s, d: evaluate.mean_baseline(daily(s, d).where("day < '1998-01-01'"), daily(s, d).where("day >= '1998-01-01'"), ["seg0", "seg1", "seg2", "seg3"]), D + ", m AS (SELECT avg(seg0) AS m0, avg(seg1) AS m1, avg(seg2) AS m2, avg(seg3) AS m3 FROM d WHERE day < DATE '1998-01-01'), u AS (" + " UNION ALL ".join(f"SELECT 'seg{k}' AS target, seg{k} AS y, m{k} AS p FROM d, m WHERE day >= DATE '1998-01-01'" for k in range(4)) + f"), v AS (SELECT * FROM u UNION ALL SELECT 'overall', y, p FROM u) SELECT target, {ANGLE} FROM v GROUP BY 1", doubles="mae rmse mape maape r2")
_add("bootstrap_ci", lambda s, d: evaluate.bootstrap_gain(forecasts(s, d), "y", "p2", "p"))
_add("pair_tests", lambda s, d: evaluate.pair_tests(forecasts(s, d), "y", [("p2", "p"), ("p", "p2")], 200))
_add("report_pivot", lambda s, d: evaluate.pivoted(forecasts(s, d).withColumn("arm", F.when(F.col("device_id") % 2 == 0, "even").otherwise("odd")).withColumn("e", F.abs(F.col("p") - F.col("y"))), "route", "arm", "e", ["even", "odd"]), P + " SELECT route, avg(abs(p - y)) FILTER (device_id % 2 = 0) AS even, avg(abs(p - y)) FILTER (device_id % 2 = 1) AS odd, avg(abs(p - y)) AS mean FROM f GROUP BY 1", doubles="even odd mean", ints="route")
_add("walk_forward_months", lambda s, d: evaluate.month_windows(daily(s, d)), D + ", m AS (SELECT DISTINCT CAST(date_trunc('month', day) AS DATE) AS test_month FROM d) SELECT * FROM (SELECT test_month, row_number() OVER (ORDER BY test_month) - 1 AS train_months, min(test_month) OVER () AS train_from FROM m) WHERE train_months >= 2", ints="train_months", texts="test_month train_from")


def _arms(s, d):
    a, b = daily(s, d), daily(s, d).withColumn("seg0", F.col("seg0") * 1.01).where("device_id % 2 = 0")
    common = a.select("device_id").intersect(b.select("device_id"))
    total = lambda x, n: feats.daily_totals(x.join(common, "device_id", "left_semi")).withColumnRenamed("use", n)
    both = total(a, "ua").join(total(b, "ub"), ["device_id", "day"])
    off = F.abs(F.col("ua") - F.col("ub")) / F.when(F.col("ua") > 0, F.col("ua"))
    return both.agg(F.count("*").alias("rows"), F.percentile(off, 0.5).alias("median_off"), F.max(off).alias("max_off"))


_add("arm_alignment", _arms, D + ", x AS (SELECT seg0 + seg1 + seg2 + seg3 AS ua, seg0 * 1.01 + seg1 + seg2 + seg3 AS ub FROM d WHERE device_id % 2 = 0), o AS (SELECT abs(ua - ub) / nullif(ua, 0) AS o FROM x) SELECT count(*) AS rows, quantile_cont(o, 0.5) AS median_off, max(o) AS max_off FROM o", doubles="median_off max_off", ints="rows")


def _one_hot(s, d):
    labels = table(s, d, "supplier").select(F.col("s_suppkey").alias("device_id"), (F.col("s_nationkey") % 3).alias("cluster"))
    hot = cluster.one_hot(labels, 3)
    return daily(s, d).select("device_id", "day", "seg0").join(hot, "device_id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


_add("cluster_onehot_join", _one_hot, D + " SELECT device_id, day, seg0, coalesce(s_nationkey % 3, -1) AS cluster, CAST(s_nationkey % 3 = 0 AS INT) AS cluster_0, CAST(s_nationkey % 3 = 1 AS INT) AS cluster_1, CAST(s_nationkey % 3 = 2 AS INT) AS cluster_2 FROM d LEFT JOIN supplier ON s_suppkey = device_id", doubles="seg0", ints="cluster cluster_0 cluster_1 cluster_2", texts="day")


def _payload(s, d):
    f = daily(s, d).where("day between '1996-06-01' and '1996-06-03'").select("device_id", "day", "seg0", "seg1", "seg2", "seg3").withColumn("step", F.dayofmonth("day"))
    cuts = f.select("device_id").distinct().withColumn("cut", F.struct(F.lit(6).alias("b1"), F.lit(12).alias("b2"), F.lit(18).alias("b3")))
    return models.payload(f, cuts)


def _payload_sql() -> str:
    part = lambda k: f"""'{{"segment":{k},"start_hour":{6 * k},"end_hour":{6 * k + 5},"predicted_consumption_kwh":' || CAST(seg{k} AS VARCHAR) || '}}'"""
    day = f"""'{{"date":"' || CAST(day AS VARCHAR) || '","segments":[' || {" || ',' || ".join(part(k) for k in range(4))} || '],"peak":' || CASE list_position([seg0, seg1, seg2, seg3], greatest(seg0, seg1, seg2, seg3)) WHEN 1 THEN {part(0)} WHEN 2 THEN {part(1)} WHEN 3 THEN {part(2)} ELSE {part(3)} END || '}}'"""
    return D + f", j AS (SELECT device_id, dayofmonth(day) AS step, {day} AS j FROM d WHERE day BETWEEN DATE '1996-06-01' AND DATE '1996-06-03') SELECT device_id, max(j) FILTER (step = 1) AS prediction_today, max(j) FILTER (step = 2) AS prediction_tomorrow, max(j) FILTER (step = 3) AS prediction_day_after_tomorrow FROM j GROUP BY 1"


_add("forecast_json", _payload, _payload_sql())
_add("naive_week", lambda s, d: models.naive(daily(s, d, "l_linenumber")).select("device_id", "day", "seg0", "pred_seg0"), f"WITH d AS ({d_sql('l_linenumber')}), e AS (SELECT device_id, min(day) AS a, max(day) AS b FROM d GROUP BY 1), s AS (SELECT device_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM e) SELECT s.device_id, s.day, d.seg0, p.seg0 AS pred_seg0 FROM s LEFT JOIN d ON d.device_id = s.device_id AND d.day = s.day LEFT JOIN d p ON p.device_id = s.device_id AND p.day = s.day - 7", doubles="seg0 pred_seg0", texts="day")
_add("read_daily_use", lambda s, d: readings(s, d).groupBy("device_id", F.to_date("ts").alias("day")).agg(F.sum("kwh").alias("use")), f"WITH r AS ({r_sql()}) SELECT device_id, CAST(ts AS DATE) AS day, sum(kwh) AS use FROM r GROUP BY 1, 2", doubles="use", texts="day")
