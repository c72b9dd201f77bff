"""Registered queries: labels and formats (X-20..X-33)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiloqueue.functions import scalars as sc
from kiloqueue.plans.oracle_base import rnd
from kiloqueue.plans.registry import register
from kiloqueue.sources import adapter as ad


def _level(op: str) -> str:
    w = "wait_time_minutes"
    return (f"CASE WHEN {w} {op} 5 THEN 'GO NOW' WHEN {w} {op} 15 THEN 'GOOD TIME' WHEN {w} {op} 30 THEN 'MODERATE WAIT' "
            "ELSE 'LONG WAIT' END")


@register("x_20_21_26_station_labels", sql=f"""
SELECT station_id, CASE WHEN a < 0.4 * n THEN 'Available' WHEN a < 0.7 * n THEN 'Moderate' WHEN a < n THEN 'Busy' ELSE 'Full' END AS availability,
  greatest(0e0, a / greatest(n, 1) * 20e0 + queue_size * 3e0) AS wait,
  CASE WHEN n IS NULL OR n = 0 THEN 0e0 ELSE {rnd("(n - f) / n * 100e0", 0)} END AS pct
FROM (SELECT station_id, queue_size, available_ports AS f, num_ports - available_ports AS a,
        CASE WHEN station_id % 17 = 0 THEN NULL WHEN station_id % 19 = 0 THEN 0 ELSE num_ports END AS n FROM stations) s""")
def x_20_21_26_station_labels(spark, sf_dir):
    k = F.col("station_id")
    s = ad.stations(spark, sf_dir).withColumn("a", F.col("num_ports") - F.col("available_ports")).withColumn(
        "n", F.when(k % 17 == 0, F.lit(None)).when(k % 19 == 0, 0).otherwise(F.col("num_ports")))
    return s.select("station_id", sc.snapshot_availability("a", "n").alias("availability"),
                    sc.snapshot_wait("a", "n", "queue_size").alias("wait"), sc.utilisation_pct("n", "available_ports").alias("pct"))


@register("x_24_25_27_session_labels", sql=f"""
SELECT session_id, {_level('<=')} AS helper, {_level('<')} AS badge,
  CASE WHEN traffic_score < 0.2 THEN 'Free Flow' WHEN traffic_score < 0.4 THEN 'Light' WHEN traffic_score < 0.6 THEN 'Moderate'
    WHEN traffic_score < 0.8 THEN 'Heavy' ELSE 'Gridlock' END AS traffic,
  lpad(cast(h AS varchar), 2, '0') || ':00' AS hour_24,
  cast(CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END AS varchar) || CASE WHEN h < 12 THEN ' AM' ELSE ' PM' END AS hour_12,
  dayname(session_start) AS day, left(dayname(session_start), 3) AS day_short
FROM (SELECT *, cast(hour(session_start) AS int) AS h FROM sessions) s""")
def x_24_25_27_session_labels(spark, sf_dir):
    s = ad.sessions(spark, sf_dir)
    hour, day = F.hour("session_start"), sc.day_of_week("session_start")
    return s.select("session_id", sc.wait_level("wait_time_minutes").alias("helper"),
                    sc.wait_level("wait_time_minutes", inclusive=False).alias("badge"), sc.traffic_label("traffic_score").alias("traffic"),
                    sc.hour_label(hour).alias("hour_24"), sc.hour_label_12h(hour).alias("hour_12"),
                    sc.day_label(day).alias("day"), sc.day_label(day, short=True).alias("day_short"))


@register("x_28_29_formats", sql="""
SELECT session_id, CASE WHEN m < 1 THEN '< 1 min' WHEN m < 60 THEN cast(cast(round_even(m, 0) AS bigint) AS varchar) || ' min'
    ELSE cast(cast(floor(m / 60) AS bigint) AS varchar) || 'h ' || cast(cast(floor(m % 60) AS bigint) AS varchar) || 'm' END AS wait,
  CASE WHEN km < 1 THEN cast(cast(floor(km * 1000) AS bigint) AS varchar) || ' m' ELSE printf('%.1f km', km) END AS distance
FROM (SELECT session_id, wait_time_minutes * 2.5e0 AS m, energy_kwh / 17e0 AS km FROM sessions) s""")
def x_28_29_formats(spark, sf_dir):
    s = ad.sessions(spark, sf_dir)
    return s.select("session_id", sc.format_wait(F.col("wait_time_minutes") * 2.5).alias("wait"),
                    sc.format_distance(F.col("energy_kwh") / 17.0).alias("distance"))


_TEXTS = ["12", "3.7", "abc", "", " 7 ", "-4", "1e3"]


@register("x_30_31_33_values", sql=f"""
SELECT session_id, coalesce(try_cast(nullif(trim(t), '') AS double), 0e0) AS as_double,
  CASE WHEN regexp_full_match(trim(t), '[+-]?[0-9]+') THEN cast(trim(t) AS int) ELSE -1 END AS as_int,
  left(md5(coalesce(t, 'None') || '_' || cast(station_id AS varchar)), 12) AS cache_key,
  strftime(session_start, '%Y-%m-%dT%H:%M:%SZ') AS iso
FROM (SELECT *, [{", ".join(f"'{t}'" for t in _TEXTS)}, NULL][cast(session_id % 8 AS int) + 1] AS t FROM sessions) s""")
def x_30_31_33_values(spark, sf_dir):
    text = F.element_at(F.array(*[F.lit(t) for t in _TEXTS], F.lit(None)), (F.col("session_id") % 8 + 1).cast("int"))
    s = ad.sessions(spark, sf_dir).withColumn("t", text)
    return s.select("session_id", sc.safe_double("t").alias("as_double"), sc.safe_int("t", -1).alias("as_int"),
                    sc.cache_key("t", "station_id").alias("cache_key"), sc.iso_utc("session_start").alias("iso"))
