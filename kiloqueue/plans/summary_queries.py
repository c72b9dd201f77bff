"""Registered queries: summaries (A-*), evaluation (A-25..A-27, X-36), ECDF (W-07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiloqueue.operators import evaluate as ev
from kiloqueue.operators import recommend as rc
from kiloqueue.operators import summary as sm
from kiloqueue.operators.clean import heuristic_wait
from kiloqueue.operators.features import add_temporal_features
from kiloqueue.operators.quality import duplicate_count, missing_report
from kiloqueue.plans.oracle_base import avg_9, rnd
from kiloqueue.plans.registry import register
from kiloqueue.sources import adapter as ad


def _ses(spark, sf_dir):
    return add_temporal_features(ad.sessions(spark, sf_dir))


_T = """
ts AS (SELECT *, cast(hour(session_start) AS int) AS hour_of_day, cast(isodow(session_start) - 1 AS int) AS day_of_week,
  cast(month(session_start) AS int) AS month, cast(isodow(session_start) >= 6 AS int) AS is_weekend FROM sessions)"""

_SW = """
sw AS (SELECT s.*, coalesce(p.w, 20e0) AS wait_min, p.w AS predicted_wait_min FROM stations s LEFT JOIN (
  SELECT station_id, arg_max(predicted_wait_min, seq) AS w FROM predictions GROUP BY station_id) p USING (station_id))"""


def _stations_wait(spark, sf_dir):
    st = rc.attach_wait(ad.stations(spark, sf_dir), ad.predictions(spark, sf_dir))
    p = rc.latest_predictions(ad.predictions(spark, sf_dir))
    return st.withColumnRenamed("_wait", "wait_min").join(p, "station_id", "left")


@register("a_01_utilisation_summary", sql=f"""
SELECT count(*) AS total_stations, cast(count_if(contains(status, 'Operational')) AS bigint) AS operational_stations,
  cast(sum(num_ports) AS bigint) AS total_ports, cast(sum(available_ports) AS bigint) AS available_ports,
  cast(sum(num_ports) - sum(available_ports) AS bigint) AS occupied_ports,
  {rnd("(sum(num_ports) - sum(available_ports)) / greatest(sum(num_ports), 1) * 100e0", 1)}
    AS network_utilization_pct,
  cast(sum(queue_size) AS bigint) AS total_vehicles_waiting,
  {rnd(avg_9("wait_min"), 1)} AS avg_predicted_wait_min
FROM sw""", ctes=_SW)
def a_01_utilisation_summary(spark, sf_dir):
    return sm.utilisation_summary(_stations_wait(spark, sf_dir), "wait_min")


@register("a_02_live_summary", sql=f"""
SELECT {rnd(avg_9("wait_min"), 1)} AS avg_wait_min, max(wait_min) AS max_wait_min,
  min(wait_min) AS min_wait_min, cast(count_if(available_ports > 0) AS bigint) AS stations_available,
  cast(count_if(available_ports = 0) AS bigint) AS stations_full FROM sw""", ctes=_SW)
def a_02_live_summary(spark, sf_dir):
    return sm.live_summary(_stations_wait(spark, sf_dir), "wait_min")


@register("a_03_kpi_row", sql="""
SELECT count(*) AS stations, cast(sum(num_ports) AS bigint) AS total_ports,
  cast(sum(available_ports) AS bigint) AS available_ports, cast(sum(queue_size) AS bigint) AS vehicles_waiting,
  round(avg(predicted_wait_min), 9) AS avg_predicted_wait_min, cast(count_if(status = 'Operational') AS bigint) AS operational
FROM sw""", ctes=_SW)
def a_03_kpi_row(spark, sf_dir):
    return sm.kpi_row(_stations_wait(spark, sf_dir))


@register("a_04_client_stats", sql=f"""
SELECT count(*) AS stations,
  round(avg((num_ports - available_ports) / greatest(num_ports, 1)) * 100e0, 6) AS avg_utilization_pct,
  {rnd(avg_9("coalesce(nullif(CASE WHEN station_id % 2 = 0 THEN wait_min END, 0e0), nullif(predicted_wait_min, 0e0), 0e0)"), 6)} AS avg_wait_min
FROM sw""", ctes=_SW)
def a_04_client_stats(spark, sf_dir):
    # odd stations have no wait of their own and fall through to the prediction
    st = _stations_wait(spark, sf_dir).withColumn("wait_min", F.when(F.col("station_id") % 2 == 0, F.col("wait_min")))
    return sm.client_stats(st, "wait_min", "predicted_wait_min")


@register("a_06_wait_by_hour", sql=f"""
SELECT hour_of_day, {avg_9('wait_time_minutes')} AS mean_wait, count(wait_time_minutes) AS n,
  round(stddev_samp(wait_time_minutes), 9) AS std_wait FROM ts GROUP BY hour_of_day""", ctes=_T)
def a_06_wait_by_hour(spark, sf_dir):
    return sm.wait_by(_ses(spark, sf_dir), ["hour_of_day"])


@register("a_07_wait_by_dow", sql=f"""
SELECT day_of_week, {avg_9('wait_time_minutes')} AS mean_wait, count(wait_time_minutes) AS n
FROM ts GROUP BY day_of_week""", ctes=_T)
def a_07_wait_by_dow(spark, sf_dir):
    return sm.wait_by(_ses(spark, sf_dir), ["day_of_week"], with_std=False)


@register("a_08_wait_by_month", sql=f"""
SELECT month, {avg_9('wait_time_minutes')} AS mean_wait, count(wait_time_minutes) AS n
FROM ts GROUP BY month""", ctes=_T)
def a_08_wait_by_month(spark, sf_dir):
    return sm.wait_by(_ses(spark, sf_dir), ["month"], with_std=False)


@register("a_09_weekend_hour_pivot", sql=f"""
SELECT hour_of_day, {avg_9('CASE WHEN is_weekend = 0 THEN wait_time_minutes END')} AS is_weekend_0,
  {avg_9('CASE WHEN is_weekend = 1 THEN wait_time_minutes END')} AS is_weekend_1
FROM ts GROUP BY hour_of_day""", ctes=_T)
def a_09_weekend_hour_pivot(spark, sf_dir):
    return sm.pivot_mean(_ses(spark, sf_dir), "hour_of_day", "is_weekend", [0, 1])


@register("a_10_station_profile", sql=f"""
SELECT station_id, {avg_9('wait_time_minutes')} AS avg_wait, count(*) AS session_count,
  {avg_9('session_duration_min')} AS avg_duration FROM sessions GROUP BY station_id""")
def a_10_station_profile(spark, sf_dir):
    return sm.station_profile(ad.sessions(spark, sf_dir))


@register("a_11_median_by_hour", sql="""
SELECT hour_of_day, median(wait_time_minutes) AS median_wait FROM ts GROUP BY hour_of_day""", ctes=_T)
def a_11_median_by_hour(spark, sf_dir):
    return sm.median_by(_ses(spark, sf_dir), "hour_of_day")


@register("a_12_day_hour_pivot", sql="SELECT day_of_week, " + ", ".join(
    f"{avg_9(f'CASE WHEN hour_of_day = {h} THEN wait_time_minutes END')} AS hour_of_day_{h}"
    for h in range(24)) + " FROM ts GROUP BY day_of_week", ctes=_T)
def a_12_day_hour_pivot(spark, sf_dir):
    return sm.pivot_mean(_ses(spark, sf_dir), "day_of_week", "hour_of_day", range(24))


_ALL_COLS = ["session_id", "station_id", "session_start", "session_duration_min", "energy_kwh", "queue_size", "available_ports",
             "traffic_score", "temperature_c", "precipitation_mm", "connector_type", "wait_time_minutes"]
_DESCRIBE_COLS = [c for c in _ALL_COLS if c not in ("session_start", "connector_type")]


@register("a_13_describe", sql=" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", cast(count({c}) AS double) AS count, {avg_9(c)} AS mean,
  round(stddev_samp({c}), 9) AS std, cast(min({c}) AS double) AS min, quantile_cont(cast({c} AS double), 0.25) AS p25,
  quantile_cont(cast({c} AS double), 0.5) AS p50, quantile_cont(cast({c} AS double), 0.75) AS p75, cast(max({c}) AS double) AS max
  FROM sessions""" for c in _DESCRIBE_COLS))
def a_13_describe(spark, sf_dir):
    return sm.describe(ad.sessions(spark, sf_dir), _DESCRIBE_COLS)


@register("a_14_mean_median_p95", sql=f"""
SELECT {avg_9('wait_time_minutes')} AS mean, median(wait_time_minutes) AS median,
  quantile_cont(wait_time_minutes, 0.95) AS p95 FROM sessions""")
def a_14_mean_median_p95(spark, sf_dir):
    return sm.mean_median_p95(ad.sessions(spark, sf_dir), "wait_time_minutes")


@register("a_15_share_below", sql="""
SELECT cast(count_if(wait_time_minutes < 15) AS bigint) / count(*) * 100e0 AS pct_under_15,
  cast(count_if(wait_time_minutes < 30) AS bigint) / count(*) * 100e0 AS pct_under_30 FROM sessions""")
def a_15_share_below(spark, sf_dir):
    return sm.share_below(ad.sessions(spark, sf_dir), "wait_time_minutes")


@register("a_16_traffic_buckets", sql=f"""
SELECT traffic_bin, {avg_9('wait_time_minutes')} AS mean_wait,
  round(stddev_samp(wait_time_minutes), 9) AS std_wait, count(*) AS n FROM (
  SELECT *, CASE WHEN traffic_score > 0 AND traffic_score <= 0.2 THEN '(0.0, 0.2]'
    WHEN traffic_score > 0.2 AND traffic_score <= 0.4 THEN '(0.2, 0.4]'
    WHEN traffic_score > 0.4 AND traffic_score <= 0.6 THEN '(0.4, 0.6]'
    WHEN traffic_score > 0.6 AND traffic_score <= 0.8 THEN '(0.6, 0.8]'
    WHEN traffic_score > 0.8 AND traffic_score <= 1.0 THEN '(0.8, 1.0]' END AS traffic_bin FROM sessions) b
WHERE traffic_bin IS NOT NULL GROUP BY traffic_bin""")
def a_16_traffic_buckets(spark, sf_dir):
    return sm.traffic_buckets(ad.sessions(spark, sf_dir))


@register("a_17_histogram", sql="""
SELECT cast(CASE WHEN hi = lo THEN 0 ELSE least(floor((wait_time_minutes - lo) / ((hi - lo) / 30e0)), 29) END
  AS int) AS bin, count(*) AS count,
  lo + cast(CASE WHEN hi = lo THEN 0 ELSE least(floor((wait_time_minutes - lo) / ((hi - lo) / 30e0)), 29) END
  AS int) * ((hi - lo) / 30e0) AS bin_start
FROM sessions, (SELECT min(wait_time_minutes) AS lo, max(wait_time_minutes) AS hi FROM sessions) m
WHERE wait_time_minutes IS NOT NULL GROUP BY ALL""")
def a_17_histogram(spark, sf_dir):
    return sm.histogram(ad.sessions(spark, sf_dir), "wait_time_minutes", 30)


@register("a_18_a_34_frequency", sql="""
SELECT queue_size, count(*) AS count, count(*) / sum(count(*)) OVER () AS probability
FROM sessions GROUP BY queue_size""")
def a_18_a_34_frequency(spark, sf_dir):
    return sm.frequency(ad.sessions(spark, sf_dir), "queue_size")


_TWICE = "(SELECT * FROM sessions UNION ALL SELECT * FROM sessions WHERE session_id % 11 = 0)"


@register("a_19_duplicate_rows", sql=f"""
SELECT cast(coalesce(sum(n - 1), 0) AS bigint) AS duplicate_rows FROM (
  SELECT count(*) AS n FROM {_TWICE} t GROUP BY {", ".join(_ALL_COLS)}) g""")
def a_19_duplicate_rows(spark, sf_dir):
    s = ad.sessions(spark, sf_dir)
    return duplicate_count(s.unionByName(s.where(F.col("session_id") % 11 == 0)))


@register("a_20_missing_report", sql="SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", cast(count_if({c} IS NULL) AS bigint) AS missing,
  round(count_if({c} IS NULL) / count(*) * 100e0, 2) AS missing_pct FROM raw_stations"""
    for c in ("station_id", "name", "lat", "lng", "num_ports", "available_ports", "queue_size", "power_kw", "connector_type", "status",
              "operator", "traffic_score")) + ") x WHERE missing > 0")
def a_20_missing_report(spark, sf_dir):
    return missing_report(ad.raw_stations(spark, sf_dir))


_CORR = ["wait_time_minutes", *(c for c in _DESCRIBE_COLS if c not in ("wait_time_minutes", "session_id", "station_id"))]


@register("a_21_correlation_matrix", sql=" UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 9) AS r FROM sessions"
    for a in _CORR for b in _CORR))
def a_21_correlation_matrix(spark, sf_dir):
    return sm.correlation_matrix(ad.sessions(spark, sf_dir), _CORR)


@register("a_22_target_correlation", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr({c}, wait_time_minutes), 9) AS r FROM sessions" for c in _CORR[1:]))
def a_22_target_correlation(spark, sf_dir):
    return sm.target_correlation(ad.sessions(spark, sf_dir), _CORR[1:])


@register("a_23_linear_trend", sql="""
SELECT round(regr_slope(wait_time_minutes, queue_size), 9) AS slope,
  round(regr_intercept(wait_time_minutes, queue_size), 9) AS intercept,
  round(corr(queue_size, wait_time_minutes), 9) AS r FROM sessions""")
def a_23_linear_trend(spark, sf_dir):
    return sm.linear_trend(ad.sessions(spark, sf_dir), "queue_size", "wait_time_minutes")


@register("a_24_busiest_station", sql="""
SELECT arg_max(station_id, struct_pack(n := n, k := -station_id)) AS station_id, max(n) AS n
FROM (SELECT station_id, count(*) AS n FROM sessions GROUP BY station_id) g""")
def a_24_busiest_station(spark, sf_dir):
    return sm.busiest(ad.sessions(spark, sf_dir))


@register("a_30_largest_queue", sql="""
SELECT station_id, name, queue_size FROM stations ORDER BY queue_size DESC, station_id DESC LIMIT 1""")
def a_30_largest_queue(spark, sf_dir):
    return sm.largest_queue(ad.stations(spark, sf_dir).select("station_id", "name", "queue_size"))


@register("a_31_alert_count", sql="""
SELECT count(*) AS total FROM sessions WHERE wait_time_minutes >= 30""")
def a_31_alert_count(spark, sf_dir):
    return ad.sessions(spark, sf_dir).where(F.col("wait_time_minutes") >= 30).agg(
        F.count(F.lit(1)).alias("total"))


@register("a_32_running_mean", sql=f"""
SELECT session_id, {avg_9('wait_time_minutes', 'OVER (PARTITION BY station_id ORDER BY session_start, session_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS running_mean
FROM sessions""")
def a_32_running_mean(spark, sf_dir):
    return sm.running_mean(ad.sessions(spark, sf_dir), "station_id", ["session_start", "session_id"],
                           "wait_time_minutes").select("session_id", "running_mean")


@register("o_05_first_k", sql="""
SELECT station_id, name FROM stations ORDER BY queue_size DESC, station_id LIMIT 8""")
def o_05_first_k(spark, sf_dir):
    return sm.first_k(ad.stations(spark, sf_dir), 8, [F.col("queue_size").desc(), "station_id"]).select("station_id", "name")


@register("a_33_normalise", sql="""
SELECT session_id, CASE WHEN hi = lo THEN 0e0 ELSE (energy_kwh - lo) / (hi - lo) END AS energy_kwh_norm
FROM sessions, (SELECT min(energy_kwh) AS lo, max(energy_kwh) AS hi FROM sessions) m""")
def a_33_normalise(spark, sf_dir):
    return sm.normalise_0_1(ad.sessions(spark, sf_dir), "energy_kwh").select("session_id", "energy_kwh_norm")


@register("a_34_availability_share", sql="""
SELECT availability, count(*) AS count, count(*) / sum(count(*)) OVER () AS probability FROM (
  SELECT CASE WHEN u < 0.4 THEN 'Available' WHEN u < 0.7 THEN 'Moderate' WHEN u < 0.9 THEN 'Busy'
    ELSE 'Full' END AS availability FROM (SELECT (num_ports - available_ports) / num_ports AS u FROM stations) s) x
GROUP BY availability""")
def a_34_availability_share(spark, sf_dir):
    from kiloqueue.functions.scalars import availability_label

    st = ad.stations(spark, sf_dir).select(
        availability_label((F.col("num_ports") - F.col("available_ports")) / F.col("num_ports")).alias("availability"))
    return sm.frequency(st, "availability")


@register("a_36_traffic_profile", sql=f"""
SELECT strftime(cast(session_start AS date), '%Y-%m-%d') AS date, cast(hour(session_start) AS int) AS hour,
  {avg_9('traffic_score')} AS traffic_score, cast(isodow(cast(session_start AS date)) - 1 AS int) AS day_of_week
FROM sessions GROUP BY ALL""")
def a_36_traffic_profile(spark, sf_dir):
    return sm.hourly_traffic_profile(ad.sessions(spark, sf_dir)).select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), "hour", "traffic_score", "day_of_week")


@register("a_37_hourly_demand", sql="""
SELECT s.station_id, h.hour, round(h.n / max(h.n) OVER (), 9) AS demand,
  cast(floor(s.num_ports * (1e0 - h.n / max(h.n) OVER ())) AS int) AS free_ports
FROM stations s, (SELECT cast(hour(session_start) AS int) AS hour, count(*) AS n FROM sessions GROUP BY 1) h""")
def a_37_hourly_demand(spark, sf_dir):
    return sm.hourly_demand_curve(ad.sessions(spark, sf_dir), ad.stations(spark, sf_dir))


@register("w_07_empirical_cdf", sql="""
SELECT wait_time_minutes, sum(n) OVER (ORDER BY wait_time_minutes) / sum(n) OVER () AS cdf FROM (
  SELECT wait_time_minutes, count(*) AS n FROM sessions WHERE wait_time_minutes IS NOT NULL GROUP BY 1) g""")
def w_07_empirical_cdf(spark, sf_dir):
    return sm.empirical_cdf(ad.sessions(spark, sf_dir), "wait_time_minutes")


# --- evaluation -------------------------------------------------------------------------

_PRED = f"""
ev AS (SELECT *, cast(hour(session_start) AS int) AS hour_of_day,
  {rnd("least(greatest((cast(queue_size AS double) / (available_ports + 1e0)) * session_duration_min"
       " + traffic_score * 5e0, 0e0), 120e0)", 1)} AS y_pred FROM sessions)"""


def _eval_frame(spark, sf_dir):
    s = _ses(spark, sf_dir)
    return s.withColumn("y_pred", heuristic_wait(s))


def _metrics_sql(model: str, pred: str) -> str:
    p = f"greatest({pred}, 0e0)"
    e = f"(wait_time_minutes - {p})"
    return f"""
SELECT '{model}' AS model, count(*) AS n_samples, {rnd(f"sqrt(sum({e}*{e}) / count(*))", 3)} AS rmse_min,
  {rnd(avg_9(f"abs({e})"), 3)} AS mae_min,
  {rnd(f"1e0 - sum({e}*{e}) / (var_pop(wait_time_minutes) * count(*))", 4)} AS r2,
  {rnd(f"avg(CASE WHEN wait_time_minutes <> 0 THEN abs({e} / wait_time_minutes) END) * 100e0", 2)} AS mape_pct,
  {rnd(f"avg(CASE WHEN (abs(wait_time_minutes) + abs({p})) / 2e0 <> 0 THEN abs({e}) / ((abs(wait_time_minutes) + abs({p})) / 2e0) END) * 100e0", 2)} AS smape_pct,
  {rnd(f"avg(cast(abs({e}) <= 5 AS double)) * 100e0", 1)} AS within_5min_pct,
  {rnd(f"avg(cast(abs({e}) <= 10 AS double)) * 100e0", 1)} AS within_10min_pct
FROM ev"""


@register("a_26_regression_metrics", sql=_metrics_sql("heuristic", "y_pred"), ctes=_PRED)
def a_26_regression_metrics(spark, sf_dir):
    return ev.compute_metrics(_eval_frame(spark, sf_dir), "wait_time_minutes", "y_pred", "heuristic")


@register("a_27_compare_models", sql=f"""
SELECT model AS "Model", rmse_min AS "RMSE (min)", mae_min AS "MAE (min)", r2 AS "R2", mape_pct AS "MAPE (%)",
  within_5min_pct AS "+-5 min (%)", within_10min_pct AS "+-10 min (%)" FROM (
  {_metrics_sql("heuristic", "y_pred")} UNION ALL {_metrics_sql("constant_15", "15e0")}) m""", ctes=_PRED)
def a_27_compare_models(spark, sf_dir):
    f = _eval_frame(spark, sf_dir).withColumn("c15", F.lit(15.0))
    return ev.compare_models([ev.compute_metrics(f, "wait_time_minutes", "y_pred", "heuristic"),
                              ev.compute_metrics(f, "wait_time_minutes", "c15", "constant_15")])


@register("a_25_segment_errors", sql=f"""
SELECT hour_of_day, count(*) AS n,
  {rnd("sqrt(avg((wait_time_minutes - y_pred)*(wait_time_minutes - y_pred)))", 3)} AS rmse,
  {rnd(avg_9("abs(wait_time_minutes - y_pred)"), 3)} AS mae
FROM ev GROUP BY hour_of_day""", ctes=_PRED)
def a_25_segment_errors(spark, sf_dir):
    return ev.segment_analysis(_eval_frame(spark, sf_dir), "wait_time_minutes", "y_pred")


@register("x_36_residuals", sql="""
SELECT session_id, wait_time_minutes AS y_true, y_pred, wait_time_minutes - y_pred AS residual,
  abs(wait_time_minutes - y_pred) AS abs_residual,
  CASE WHEN wait_time_minutes <> 0 THEN (wait_time_minutes - y_pred) / wait_time_minutes * 100e0 END AS pct_error
FROM ev""", ctes=_PRED)
def x_36_residuals(spark, sf_dir):
    return ev.residual_table(_eval_frame(spark, sf_dir), "wait_time_minutes", "y_pred", keys=("session_id",))
