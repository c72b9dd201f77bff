"""Registered queries: the preprocessing and feature pipelines (M-19, M-20) and their column rules (P-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiloqueue.operators import clean as cl
from kiloqueue.operators import features as fe
from kiloqueue.plans.oracle_base import haversine_sql
from kiloqueue.plans.prep_queries import MERGED_SQL, TRIM_SQL
from kiloqueue.plans.registry import register
from kiloqueue.sources import adapter as ad


def _raw_sessions(spark, sf_dir):
    """Sessions as the raw file has them: the start as text under another name, no weather."""
    s = ad.sessions(spark, sf_dir)
    text = F.when(F.col("session_id") % 50 == 49, F.lit("soon")).otherwise(F.date_format("session_start", "yyyy-MM-dd HH:mm:ss"))
    return s.withColumn("start_time", text).drop("session_start", "temperature_c", "precipitation_mm")


@register("p_06_rename_start", sql="""
SELECT session_id, CASE WHEN session_id % 50 <> 49 THEN strftime(session_start, '%Y-%m-%d %H:%M:%S') END AS session_start FROM sessions""")
def p_06_rename_start(spark, sf_dir):
    out = cl.standardise_session_columns(_raw_sessions(spark, sf_dir))
    return out.select("session_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"))


@register("p_06_datetime_column", sql="""
SELECT session_id, strftime(session_start, '%Y-%m-%d %H:%M:%S') AS session_start FROM sessions WHERE session_id % 50 <> 49""")
def p_06_datetime_column(spark, sf_dir):
    raw = _raw_sessions(spark, sf_dir).where("session_id % 50 <> 49").withColumnRenamed("start_time", "datetime")
    out = cl.standardise_session_columns(raw)
    return out.select("session_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"))


@register("m_20_p_10_preprocess", sql="""
SELECT session_id, station_id, connector_type, cast(dense_rank() OVER (ORDER BY connector_type) - 1 AS int) AS connector_type_encoded,
  20e0 AS temperature_c, 0e0 AS precipitation_mm, traffic_score, num_ports, is_operational,
  (session_id * 7919) % 100 < 80 AS is_train FROM merged""", ctes=TRIM_SQL + "," + MERGED_SQL)
def m_20_p_10_preprocess(spark, sf_dir):
    train, test, _ = cl.preprocess(ad.raw_stations(spark, sf_dir), _raw_sessions(spark, sf_dir), ad.traffic(spark, sf_dir), ad.weather_row())
    both = train.withColumn("is_train", F.lit(True)).unionByName(test.withColumn("is_train", F.lit(False)))
    return both.select("session_id", "station_id", "connector_type", "connector_type_encoded", "temperature_c", "precipitation_mm",
                       "traffic_score", "num_ports", "is_operational", "is_train")


_W = "OVER (PARTITION BY station_id ORDER BY session_start, session_id ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
_O = "OVER (PARTITION BY station_id ORDER BY session_start, session_id)"
# every feature column of M-19 but the keys, before nulls are filled
_COLUMNS = {
    **{c: c for c in ("session_duration_min", "energy_kwh", "queue_size", "wait_time_minutes", "traffic_score", "temperature_c",
                      "precipitation_mm", "lat", "lng", "power_kw", "is_operational")},
    "hour_of_day": "h", "day_of_week": "dw", "month": "mo", "day_of_month": "day(session_start)", "week_of_year": "weekofyear(session_start)",
    "is_weekend": "cast(dw >= 5 AS int)", "is_rush_hour": "cast(h BETWEEN 7 AND 9 OR h BETWEEN 16 AND 19 AS int)",
    "part_of_day": "CASE WHEN h >= 5 AND h < 12 THEN 1 WHEN h >= 12 AND h < 17 THEN 2 WHEN h >= 17 AND h < 21 THEN 3 ELSE 0 END",
    **{f"{n}_{f}": f"{f}(2e0 * pi() * {x} / {p}e0)" for n, x, p in (("hour", "h", 24), ("day", "dw", 7), ("month", "mo", 12)) for f in ("sin", "cos")},
    "traffic_x_hour": "traffic_score * h / 24e0", "traffic_x_weekend": "traffic_score * cast(dw >= 5 AS int)",
    "traffic_level": "CASE WHEN traffic_score <= 0.33 THEN 0e0 WHEN traffic_score <= 0.66 THEN 1e0 WHEN traffic_score <= 1 THEN 2e0 END",
    "num_ports": "t", "available_ports": "a",
    "port_availability_ratio": "least(greatest(a / t, 0e0), 1e0)", "queue_pressure": "queue_size / (a + 1)",
    "is_cold": "cast(temperature_c < 5 AS int)", "is_hot": "cast(temperature_c > 35 AS int)", "is_raining": "cast(precipitation_mm > 0.1 AS int)",
    "weather_demand_boost": "cast(precipitation_mm > 0.1 AS int) * 0.15e0 + cast(temperature_c < 5 AS int) * 0.10e0",
    "distance_to_city_center_km": haversine_sql("lat", "lng", "37.7749e0", "-122.4194e0"),
    "nearby_stations_count": f"""CASE WHEN lat IS NULL THEN 3 ELSE (SELECT count(*) FROM cs b
      WHERE {haversine_sql('m.lat', 'm.lng', 'b.lat', 'b.lng')} < 2e0) END""",
    **{f"rolling_mean_{k}": f"avg(wait_time_minutes) {_W.format(n)}" for k, n in fe.ROLLING_WINDOWS.items()},
    **{f"rolling_std_{k}": f"coalesce(stddev_samp(wait_time_minutes) {_W.format(n)}, 0e0)" for k, n in fe.ROLLING_WINDOWS.items()},
    **{f"lag_{k}": f"lag(wait_time_minutes, {k}) {_O}" for k in fe.LAGS},
}
_FILLED = {c: f"coalesce(cast({c} AS double), (SELECT coalesce(median({c}), 0e0) FROM fx))" for c in _COLUMNS}


@register("m_19_p_12_p_23_features", sql=f"""
SELECT session_id, station_id, {", ".join(f"round({c}, 6) AS {c}" for c in _COLUMNS if c != "available_ports")},
  least(greatest(available_ports, 0), num_ports) AS available_ports,
  round(least(greatest((num_ports - least(greatest(available_ports, 0), num_ports)) / num_ports, 0e0), 1e0), 6) AS station_utilization,
  round(least(greatest((num_ports - least(greatest(available_ports, 0), num_ports)) / num_ports, 0e0), 1e0) * 100e0, 6) AS utilization_pct
FROM (SELECT session_id, station_id, {", ".join(f"{v} AS {k}" for k, v in _FILLED.items())} FROM fx) y""",
          ctes=TRIM_SQL + "," + MERGED_SQL + f""",
m0 AS (SELECT *, hour(session_start) AS h, isodow(session_start) - 1 AS dw, month(session_start) AS mo,
  CASE WHEN num_ports = 0 THEN 1 ELSE num_ports END AS t,
  least(greatest(available_ports, 0), CASE WHEN num_ports = 0 THEN 1 ELSE num_ports END) AS a FROM merged),
fx AS (SELECT session_id, station_id, {", ".join(f"{v} AS {k}" for k, v in _COLUMNS.items())} FROM m0 m)""")
def m_19_p_12_p_23_features(spark, sf_dir):
    st = cl.clean_stations(ad.raw_stations(spark, sf_dir))
    merged = cl.merge_datasets(st, cl.clean_sessions(ad.sessions(spark, sf_dir)), ad.traffic(spark, sf_dir), ad.weather_row())
    out = fe.engineer_features(merged, st, keep_keys=True)
    return out.select("session_id", "station_id", *[F.round(c, 6).alias(c) for c in out.columns if c not in fe.KEY_COLUMNS])


@register("p_19_p_21_feature_columns", sql="""
SELECT session_id, round(cast(hour(session_start) AS double), 0) AS hour_of_day, traffic_score, queue_size, available_ports, 0e0 AS total_ports,
  0e0 AS rolling_mean_1h FROM sessions""")
def p_19_p_21_feature_columns(spark, sf_dir):
    s = fe.add_temporal_features(ad.sessions(spark, sf_dir)).select(
        "session_id", F.col("hour_of_day").cast("double").alias("hour_of_day"), "traffic_score", "queue_size", "available_ports", "energy_kwh")
    wide = cl.ensure_columns(s, ["total_ports", "rolling_mean_1h", "queue_size"])
    return wide.select("session_id", *cl.feature_columns(wide))


@register("p_21_numeric_fallback", sql="SELECT station_id, lat, lng, cast(queue_size AS int) AS queue_size FROM stations")
def p_21_numeric_fallback(spark, sf_dir):
    df = ad.stations(spark, sf_dir).select("station_id", "name", "lat", "lng", F.col("queue_size").alias("q"))
    return df.select(*cl.feature_columns(df)).withColumnRenamed("q", "queue_size")


@register("p_20_clip", sql="SELECT session_id, least(greatest(wait_time_minutes, 5e0), 40e0) AS wait_time_minutes FROM sessions")
def p_20_clip(spark, sf_dir):
    return cl.clip_column(ad.sessions(spark, sf_dir), "wait_time_minutes", 5.0, 40.0).select("session_id", "wait_time_minutes")
