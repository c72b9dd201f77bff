"""Registered queries: streaming jobs run to completion (availableNow), checked
against the batch SQL of the same rule (stream = batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiloqueue.plans.oracle_base import avg_9, queue_wait_sql, rnd
from kiloqueue.plans.registry import register
from kiloqueue.sources import adapter as ad
from kiloqueue.streaming import jobs, stateful


def _pred(ports, avail, queue):
    c, lam = f"greatest(1, {ports})", f"greatest(0.1e0, {queue} + 1e0)"
    w = queue_wait_sql(c, lam, "3e0", queue)
    p = f"(CASE WHEN {w} IS NULL THEN 'inf'::double ELSE greatest(0e0, {rnd(w, 1)}) END)"
    label = (f"CASE WHEN {p} <= 5 AND {avail} > 0 THEN 'GO_NOW' WHEN {p} <= 15 THEN 'GOOD_TIME' "
             f"WHEN {p} <= 30 THEN 'MODERATE_WAIT' WHEN {p} <= 60 THEN 'LONG_WAIT' ELSE 'AVOID' END")
    return p, label


_P, _LBL = _pred("st.num_ports", "s.available_ports", "s.queue_size")


@register("l_01_stream_enrich_predict", sql=f"""
SELECT s.session_id, s.station_id, CASE WHEN isinf({_P}) THEN NULL ELSE {_P} END AS predicted_wait_min,
  {_LBL} AS recommendation
FROM sessions s JOIN stations st USING (station_id)""")
def l_01_stream_enrich_predict(spark, sf_dir):
    out = jobs.enrich_and_predict(spark, sf_dir)
    return out.select("session_id", "station_id",
                      F.when(~F.isnan("predicted_wait_min") & (F.abs("predicted_wait_min") != float("inf")),
                             F.col("predicted_wait_min")).alias("predicted_wait_min"), "recommendation")


@register("l_02_stream_latest_state", sql="""
SELECT station_id, arg_max(session_id, struct_pack(t := session_start, s := session_id)) AS session_id,
  arg_max(wait_time_minutes, struct_pack(t := session_start, s := session_id)) AS wait_time_minutes
FROM sessions GROUP BY station_id""")
def l_02_stream_latest_state(spark, sf_dir):
    return jobs.latest_state(spark, sf_dir).select("station_id", "session_id", "wait_time_minutes")


@register("l_03_l_07_stream_threshold", sql="""
SELECT session_id, station_id, true AS alert FROM sessions WHERE wait_time_minutes >= 30""")
def l_03_l_07_stream_threshold(spark, sf_dir):
    return jobs.threshold_stream(spark, sf_dir, 30.0)


@register("l_07_stream_one_station", sql="""
SELECT session_id, station_id, true AS alert FROM sessions WHERE wait_time_minutes >= 30 AND station_id = 7""")
def l_07_stream_one_station(spark, sf_dir):
    return jobs.threshold_stream(spark, sf_dir, 30.0, station_id=7)


_HOURLY_SQL = f"""
SELECT station_id, strftime(date_trunc('hour', session_start), '%Y-%m-%d %H:%M:%S') AS hour_ts,
  {avg_9('wait_time_minutes')} AS value FROM sessions GROUP BY ALL"""


@register("l_08_stream_hourly_mean", sql=_HOURLY_SQL)
def l_08_stream_hourly_mean(spark, sf_dir):
    return jobs.hourly_means(spark, sf_dir).withColumn("value", F.round("value", 9))


@register("l_09_a_32_stream_running_mean", sql=f"""
SELECT station_id, {avg_9('wait_time_minutes')} AS running_mean, count(*) AS n FROM sessions GROUP BY 1""")
def l_09_a_32_stream_running_mean(spark, sf_dir):
    return jobs.running_means(spark, sf_dir).withColumn("running_mean", F.round("running_mean", 9))


_COOLDOWN_SQL = """
WITH RECURSIVE chain(station_id, alert_type, t) AS (
  SELECT station_id, alert_type, min(epoch_us(event_time)) FROM alerts_t GROUP BY station_id, alert_type
  UNION ALL
  SELECT c.station_id, c.alert_type,
    (SELECT min(epoch_us(a.event_time)) FROM alerts_t a WHERE a.station_id = c.station_id
       AND a.alert_type = c.alert_type AND epoch_us(a.event_time) >= c.t + 600000000)
  FROM chain c WHERE c.t IS NOT NULL)
SELECT station_id, alert_type, strftime(make_timestamp(t), '%Y-%m-%d %H:%M:%S.%f') AS event_time
FROM chain WHERE t IS NOT NULL"""
_COOLDOWN_CTES = """
ae AS (SELECT session_id, station_id, name, status, event_time, predicted_wait_min AS w, utilization_pct AS u
  FROM alert_events),
alerts_t AS (
  SELECT station_id, 'HIGH_WAIT_TIME' AS alert_type, event_time FROM ae WHERE w >= 30
  UNION ALL SELECT station_id, 'HIGH_UTILIZATION', event_time FROM ae WHERE u / 100e0 >= 0.9
  UNION ALL SELECT station_id, 'STATION_OFFLINE', event_time FROM ae WHERE contains(status, 'Offline'))"""


@register("l_05_stream_cooldown", sql=_COOLDOWN_SQL, ctes=_COOLDOWN_CTES)
def l_05_stream_cooldown(spark, sf_dir):
    out = jobs.cooldown_stream(spark, sf_dir, 600.0)
    return out.select("station_id", "alert_type",
                      F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_time"))


_FRESH_SQL = """
SELECT station_id, strftime(max(session_start), '%Y-%m-%d %H:%M:%S.%f') AS reading_time,
  arg_max(traffic_score, struct_pack(t := session_start, s := session_id)) AS traffic_score
FROM sessions WHERE session_start > (SELECT max(session_start) FROM sessions) - INTERVAL 300 SECOND GROUP BY station_id"""


@register("l_10_stream_freshness", sql=_FRESH_SQL)
def l_10_stream_freshness(spark, sf_dir):
    return jobs.freshness_stream(spark, sf_dir, 300.0).select(
        "station_id", F.date_format("reading_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("reading_time"), "traffic_score")


@register("s_16_fresh_readings", sql="""
SELECT station_id, arg_max(traffic_score, session_start) AS traffic_score
FROM sessions WHERE session_start > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 300 SECOND
  AND session_start <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY station_id""")
def s_16_fresh_readings(spark, sf_dir):
    r = ad.sessions(spark, sf_dir).select("station_id", F.col("session_start").alias("event_time"), "traffic_score")
    return jobs.fresh_readings(r, "2024-01-15 12:00:00", 300.0).select("station_id", "traffic_score")


# --- keyed state, timers and watermarks


@register("l_08_stream_window_state", sql=_HOURLY_SQL)
def l_08_stream_window_state(spark, sf_dir):
    means, _ = stateful.windowed_means(spark, sf_dir)
    return means.select("station_id", F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour_ts"), F.round("value", 9).alias("value"))


@register("l_10_stream_expiry", sql=_FRESH_SQL)
def l_10_stream_expiry(spark, sf_dir):
    return stateful.fresh_now(stateful.freshness_changes(spark, sf_dir, 300.0)).select(
        "station_id", F.date_format("reading_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("reading_time"), "traffic_score")


@register("l_05_stream_cooldown_state", sql=_COOLDOWN_SQL, ctes=_COOLDOWN_CTES)
def l_05_stream_cooldown_state(spark, sf_dir):
    through, _ = stateful.judged_cooldown(spark, sf_dir, 600.0)
    return through.select("station_id", "alert_type", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_time"))


def _dismissals(sessions):
    """Every fiftieth session takes away the alerts of its station up to its time."""
    return sessions.where(F.col("session_id") % 50 == 7).select("station_id", F.col("session_start").alias("event_time"))


@register("l_06_w_13_stream_history", sql="""
SELECT a.station_id, a.alert_type, a.session_id, strftime(a.event_time, '%Y-%m-%d %H:%M:%S.%f') AS event_time
FROM alerts_t a
WHERE NOT EXISTS (SELECT 1 FROM sessions s WHERE s.session_id % 50 = 7 AND s.station_id = a.station_id AND s.session_start >= a.event_time)
ORDER BY a.event_time DESC, a.station_id DESC, rule_order DESC, session_id DESC LIMIT 50""", ctes="""
ae AS (SELECT session_id, station_id, name, status, event_time, predicted_wait_min AS w, utilization_pct AS u
  FROM alert_events),
alerts_t AS (
  SELECT station_id, session_id, 'HIGH_WAIT_TIME' AS alert_type, 1 AS rule_order, event_time FROM ae WHERE w >= 30
  UNION ALL SELECT station_id, session_id, 'HIGH_UTILIZATION', 2, event_time FROM ae WHERE u / 100e0 >= 0.9
  UNION ALL SELECT station_id, session_id, 'STATION_OFFLINE', 3, event_time FROM ae WHERE contains(status, 'Offline'))""")
def l_06_w_13_stream_history(spark, sf_dir):
    out = stateful.alert_history(spark, sf_dir, _dismissals(jobs.session_stream(spark, sf_dir)))
    return out.select("station_id", "alert_type", "session_id", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_time"))


def merge_inputs(sessions):
    """Base readings (four of five sessions) and updates (one of three; some fields are null) of a table or stream of sessions."""
    rows = sessions.select("session_id", F.col("session_start").alias("event_time"), "station_id", "wait_time_minutes", "queue_size")
    base = rows.where(F.col("session_id") % 5 != 0)
    new = rows.where(F.col("session_id") % 3 == 0).withColumns({
        "wait_time_minutes": F.when(F.col("session_id") % 2 == 0, F.col("wait_time_minutes") + 1.0),
        "queue_size": F.when(F.col("session_id") % 4 != 0, F.col("queue_size") + 1), "station_id": F.lit(None).cast("long")})
    return base, new


@register("j_13_n_09_stream_merge", sql="""
WITH b AS (SELECT * FROM sessions WHERE session_id % 5 <> 0),
u AS (SELECT session_id, session_start, NULL::BIGINT AS station_id,
  CASE WHEN session_id % 2 = 0 THEN wait_time_minutes + 1e0 END AS wait_time_minutes,
  CASE WHEN session_id % 4 <> 0 THEN queue_size + 1 END AS queue_size FROM sessions WHERE session_id % 3 = 0)
SELECT session_id, coalesce(u.station_id, b.station_id) AS station_id,
  coalesce(u.wait_time_minutes, b.wait_time_minutes) AS wait_time_minutes, coalesce(u.queue_size, b.queue_size) AS queue_size
FROM b FULL OUTER JOIN u USING (session_id, session_start)
WHERE epoch_us(session_start) <= (SELECT least((SELECT max(epoch_us(session_start)) FROM b), (SELECT max(epoch_us(session_start)) FROM u))) // 1000 * 1000 - 3600000000""")
def j_13_n_09_stream_merge(spark, sf_dir):
    merged, closed = stateful.merged_readings(*merge_inputs(jobs.session_stream(spark, sf_dir)))
    return merged.where(F.col("event_time") <= closed).select("session_id", "station_id", "wait_time_minutes", "queue_size")
