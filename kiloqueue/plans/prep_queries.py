"""Registered queries: cleaning, merge, encoding, split and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiloqueue.functions.scalars import lenient_timestamp
from kiloqueue.operators import clean as cl
from kiloqueue.operators import features as fe
from kiloqueue.plans.oracle_base import avg_9, haversine_sql, rnd
from kiloqueue.plans.registry import register
from kiloqueue.sources import adapter as ad

# --- oracle fragments ---------------------------------------------------------

CLEAN_STATIONS_SQL = """
  SELECT station_id, name, lat, lng,
    cast(coalesce(num_ports, 2) AS int) AS num_ports, available_ports, queue_size,
    coalesce(power_kw, 50e0) AS power_kw,
    CASE WHEN regexp_matches(coalesce(connector_type, 'Unknown'), 'Type 2|CCS|CHAdeMO|Tesla|J1772|Unknown')
      THEN coalesce(connector_type, 'Unknown') ELSE 'Unknown' END AS connector_type,
    coalesce(status, 'Unknown') AS status,
    cast(coalesce(regexp_matches(status, '(?i)Operational|Available|Online'), false) AS int) AS is_operational,
    operator, traffic_score
  FROM raw_stations
  WHERE lat IS NOT NULL AND lng IS NOT NULL AND lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180"""

TRIM_SQL = """
t1 AS (SELECT * FROM sessions WHERE session_duration_min BETWEEN
  (SELECT quantile_cont(session_duration_min, 0.01) FROM sessions) AND
  (SELECT quantile_cont(session_duration_min, 0.99) FROM sessions)),
t2 AS (SELECT * FROM t1 WHERE energy_kwh BETWEEN
  (SELECT quantile_cont(energy_kwh, 0.01) FROM t1) AND (SELECT quantile_cont(energy_kwh, 0.99) FROM t1)),
t3 AS (SELECT * FROM t2 WHERE wait_time_minutes BETWEEN
  (SELECT quantile_cont(wait_time_minutes, 0.01) FROM t2) AND
  (SELECT quantile_cont(wait_time_minutes, 0.99) FROM t2))"""

MERGED_SQL = f"""
cs AS ({CLEAN_STATIONS_SQL}),
merged AS (
  SELECT s.session_id, s.station_id, s.session_start, s.session_duration_min, s.energy_kwh,
    s.queue_size, s.available_ports, s.wait_time_minutes,
    coalesce(s.traffic_score, tr.traffic_score, 0.3e0) AS traffic_score,
    coalesce(s.temperature_c, 20e0) AS temperature_c,
    coalesce(s.precipitation_mm, 0e0) AS precipitation_mm,
    coalesce(s.connector_type, cs.connector_type, 'Unknown') AS connector_type,
    cs.lat, cs.lng, cs.num_ports, cs.power_kw, cs.is_operational
  FROM t3 s LEFT JOIN cs USING (station_id) LEFT JOIN traffic tr USING (station_id))"""


def _merged(spark, sf_dir):
    st = cl.clean_stations(ad.raw_stations(spark, sf_dir))
    ses = cl.clean_sessions(ad.sessions(spark, sf_dir))
    return cl.merge_datasets(st, ses, ad.traffic(spark, sf_dir), ad.weather_row())


# --- stations -----------------------------------------------------------------

@register("p_01_02_valid_coordinates", sql="""
SELECT station_id, lat, lng FROM raw_stations
WHERE lat IS NOT NULL AND lng IS NOT NULL AND lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180""")
def p_01_02_valid_coordinates(spark, sf_dir):
    raw = ad.raw_stations(spark, sf_dir)
    return (raw.na.drop(subset=["lat", "lng"])
            .where(F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180))
            .select("station_id", "lat", "lng"))


@register("p_03_05_clean_stations", sql=f"SELECT * FROM ({CLEAN_STATIONS_SQL}) x")
def p_03_05_clean_stations(spark, sf_dir):
    return cl.clean_stations(ad.raw_stations(spark, sf_dir))


@register("p_25_required_fields", sql="""
SELECT station_id, (station_id IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL
  AND num_ports IS NOT NULL) AS is_valid FROM raw_stations""")
def p_25_required_fields(spark, sf_dir):
    from kiloqueue.operators.quality import required_fields

    return required_fields(ad.raw_stations(spark, sf_dir), ["station_id", "lat", "lng", "num_ports"]) \
        .select("station_id", "is_valid")


# --- sessions -----------------------------------------------------------------

@register("p_07_percentile_trim", sql="SELECT session_id, session_duration_min, energy_kwh, "
          "wait_time_minutes FROM t3", ctes=TRIM_SQL)
def p_07_percentile_trim(spark, sf_dir):
    return cl.percentile_trim(ad.sessions(spark, sf_dir)).select(
        "session_id", "session_duration_min", "energy_kwh", "wait_time_minutes")


@register("p_08_09_heuristic_wait", sql=f"""
SELECT session_id, {rnd("least(greatest((cast(coalesce(queue_size, 0) AS double)"
  " / (coalesce(available_ports, 2) + 1e0)) * coalesce(session_duration_min, 30e0)"
  " + coalesce(traffic_score, 0.3e0) * 5e0, 0e0), 120e0)", 1)} AS heuristic_wait
FROM sessions""")
def p_08_09_heuristic_wait(spark, sf_dir):
    s = ad.sessions(spark, sf_dir)
    return s.select("session_id", cl.heuristic_wait(s).alias("heuristic_wait")).na.drop(
        subset=["heuristic_wait"])


@register("x_01_lenient_timestamp", sql="""
SELECT session_id, strftime(try_cast(CASE WHEN session_id % 3 = 0 THEN 'not a time'
  ELSE strftime(session_start, '%Y-%m-%d %H:%M:%S') END AS timestamp), '%Y-%m-%d %H:%M:%S') AS parsed
FROM sessions""")
def x_01_lenient_timestamp(spark, sf_dir):
    s = ad.sessions(spark, sf_dir)
    text = F.when(F.col("session_id") % 3 == 0, F.lit("not a time")).otherwise(
        F.date_format("session_start", "yyyy-MM-dd HH:mm:ss"))
    return s.select("session_id", F.date_format(lenient_timestamp(text), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


# --- merge, encode, split -----------------------------------------------------------

@register("j_01_02_merge_sessions", sql="""
SELECT session_id, station_id, lat, lng, num_ports, connector_type, power_kw, is_operational,
  traffic_score, temperature_c, precipitation_mm, wait_time_minutes FROM merged""",
          ctes=TRIM_SQL + "," + MERGED_SQL)
def j_01_02_merge_sessions(spark, sf_dir):
    return _merged(spark, sf_dir).select(
        "session_id", "station_id", "lat", "lng", "num_ports", "connector_type", "power_kw",
        "is_operational", "traffic_score", "temperature_c", "precipitation_mm", "wait_time_minutes")


@register("m_01_label_encode", sql="""
SELECT session_id, connector_type, cast(dense_rank() OVER (ORDER BY connector_type) - 1 AS int)
  AS connector_type_encoded FROM merged""", ctes=TRIM_SQL + "," + MERGED_SQL)
def m_01_label_encode(spark, sf_dir):
    return cl.encode_categoricals(_merged(spark, sf_dir)).select(
        "session_id", "connector_type", "connector_type_encoded")


@register("m_03_split_train", sql="SELECT session_id FROM sessions WHERE (session_id*7919) % 100 < 80")
def m_03_split_train(spark, sf_dir):
    return cl.train_test_split(ad.sessions(spark, sf_dir))[0].select("session_id")


@register("u_03_split_test", sql="SELECT session_id FROM sessions WHERE (session_id*7919) % 100 >= 80")
def u_03_split_test(spark, sf_dir):
    return cl.train_test_split(ad.sessions(spark, sf_dir))[1].select("session_id")


@register("u_01_union_train_test", sql="SELECT session_id, station_id FROM sessions")
def u_01_union_train_test(spark, sf_dir):
    tr, te = cl.train_test_split(ad.sessions(spark, sf_dir))
    return tr.select("session_id", "station_id").unionByName(te.select("session_id", "station_id"))


@register("m_02_standard_scale", sql="""
WITH tr AS (SELECT * FROM sessions WHERE (session_id*7919) % 100 < 80),
st AS (SELECT avg(traffic_score) AS m1, stddev_pop(traffic_score) AS s1,
              avg(energy_kwh) AS m2, stddev_pop(energy_kwh) AS s2 FROM tr)
SELECT session_id, round((traffic_score - m1) / s1, 9) AS traffic_score,
  round((energy_kwh - m2) / s2, 9) AS energy_kwh
FROM sessions, st WHERE (session_id*7919) % 100 >= 80""")
def m_02_standard_scale(spark, sf_dir):
    tr, te = cl.train_test_split(ad.sessions(spark, sf_dir))
    _, te2 = cl.scale_features(tr, te, ["traffic_score", "energy_kwh"])
    return te2.select("session_id", F.round("traffic_score", 9).alias("traffic_score"),
                      F.round("energy_kwh", 9).alias("energy_kwh"))


# --- features ---------------------------------------------------------------------

@register("x_02_06_temporal", sql="""
SELECT session_id, cast(hour(session_start) AS int) AS hour_of_day, cast(isodow(session_start) - 1 AS int) AS day_of_week,
  cast(month(session_start) AS int) AS month, cast(day(session_start) AS int) AS day_of_month,
  cast(weekofyear(session_start) AS int) AS week_of_year,
  cast(isodow(session_start) - 1 >= 5 AS int) AS is_weekend,
  cast(hour(session_start) BETWEEN 7 AND 9 OR cast(hour(session_start) AS int) BETWEEN 16 AND 19 AS int) AS is_rush_hour,
  CASE WHEN cast(hour(session_start) AS int) >= 5 AND cast(hour(session_start) AS int) < 12 THEN 1
    WHEN cast(hour(session_start) AS int) >= 12 AND cast(hour(session_start) AS int) < 17 THEN 2
    WHEN cast(hour(session_start) AS int) >= 17 AND cast(hour(session_start) AS int) < 21 THEN 3 ELSE 0 END AS part_of_day,
  sin(2e0*pi()*cast(hour(session_start) AS int)/24e0) AS hour_sin, cos(2e0*pi()*cast(hour(session_start) AS int)/24e0) AS hour_cos,
  sin(2e0*pi()*(isodow(session_start) - 1)/7e0) AS day_sin,
  cos(2e0*pi()*(isodow(session_start) - 1)/7e0) AS day_cos,
  sin(2e0*pi()*cast(month(session_start) AS int)/12e0) AS month_sin, cos(2e0*pi()*cast(month(session_start) AS int)/12e0) AS month_cos
FROM sessions""")
def x_02_06_temporal(spark, sf_dir):
    out = fe.add_temporal_features(ad.sessions(spark, sf_dir))
    return out.select("session_id", "hour_of_day", "day_of_week", "month", "day_of_month", "week_of_year",
                      "is_weekend", "is_rush_hour", "part_of_day", "hour_sin", "hour_cos", "day_sin",
                      "day_cos", "month_sin", "month_cos")


@register("x_07_08_traffic_features", sql="""
SELECT session_id, traffic_score * cast(hour(session_start) AS int) / 24e0 AS traffic_x_hour,
  traffic_score * cast(isodow(session_start) >= 6 AS int) AS traffic_x_weekend,
  CASE WHEN traffic_score >= 0 AND traffic_score <= 0.33 THEN 0e0
    WHEN traffic_score > 0.33 AND traffic_score <= 0.66 THEN 1e0
    WHEN traffic_score > 0.66 AND traffic_score <= 1 THEN 2e0 END AS traffic_level
FROM sessions""")
def x_07_08_traffic_features(spark, sf_dir):
    out = fe.add_traffic_features(fe.add_temporal_features(ad.sessions(spark, sf_dir)))
    return out.select("session_id", "traffic_x_hour", "traffic_x_weekend", "traffic_level")


@register("x_09_utilization_features", sql="""
SELECT session_id, a AS available_ports, t AS num_ports,
  least(greatest((t - a) / t, 0e0), 1e0) AS station_utilization,
  least(greatest((t - a) / t, 0e0), 1e0) * 100e0 AS utilization_pct,
  least(greatest(a / t, 0e0), 1e0) AS port_availability_ratio,
  queue_size / (a + 1) AS queue_pressure
FROM (SELECT session_id, queue_size, CASE WHEN num_ports = 0 THEN 1 ELSE num_ports END AS t,
        least(greatest(available_ports, 0), CASE WHEN num_ports = 0 THEN 1 ELSE num_ports END) AS a
      FROM merged) x""", ctes=TRIM_SQL + "," + MERGED_SQL)
def x_09_utilization_features(spark, sf_dir):
    out = fe.add_utilization_features(_merged(spark, sf_dir))
    return out.select("session_id", "available_ports", "num_ports", "station_utilization",
                      "utilization_pct", "port_availability_ratio", "queue_pressure")


@register("x_11_weather_features", sql="""
SELECT session_id, cast(temperature_c < 5 AS int) AS is_cold, cast(temperature_c > 35 AS int) AS is_hot,
  cast(precipitation_mm > 0.1 AS int) AS is_raining,
  cast(precipitation_mm > 0.1 AS int) * 0.15e0 + cast(temperature_c < 5 AS int) * 0.10e0
    AS weather_demand_boost
FROM sessions""")
def x_11_weather_features(spark, sf_dir):
    out = fe.add_weather_features(ad.sessions(spark, sf_dir))
    return out.select("session_id", "is_cold", "is_hot", "is_raining", "weather_demand_boost")


@register("x_18_j_05_station_geo", sql=f"""
SELECT a.station_id, round({haversine_sql('a.lat', 'a.lng', '37.7749e0', '-122.4194e0')}, 6)
    AS distance_to_city_center_km,
  cast((SELECT count(*) FROM stations b WHERE {haversine_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} < 2e0)
    AS int) AS nearby_stations_count
FROM stations a""")
def x_18_j_05_station_geo(spark, sf_dir):
    st = ad.stations(spark, sf_dir)
    out = fe.add_geospatial_features(st, st)
    return out.select("station_id", F.round("distance_to_city_center_km", 6).alias("distance_to_city_center_km"),
                      "nearby_stations_count")


@register("j_05_session_nearby_count", sql=f"""
SELECT m.session_id, CASE WHEN m.lat IS NULL THEN 3 ELSE cast((SELECT count(*) FROM cs b
  WHERE {haversine_sql('m.lat', 'm.lng', 'b.lat', 'b.lng')} < 2e0) AS int) END AS nearby_stations_count
FROM merged m""", ctes=TRIM_SQL + "," + MERGED_SQL)
def j_05_session_nearby_count(spark, sf_dir):
    st = cl.clean_stations(ad.raw_stations(spark, sf_dir))
    ses = cl.merge_datasets(st, cl.clean_sessions(ad.sessions(spark, sf_dir)), ad.traffic(spark, sf_dir))
    return fe.add_geospatial_features(ses, st).select("session_id", "nearby_stations_count")


_W = "OVER (PARTITION BY station_id ORDER BY session_start, session_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _roll_sql(n: int, label: str) -> str:
    w = _W.format(n=n)
    return (f"{avg_9('wait_time_minutes', w)} AS rolling_mean_{label},\n"
            f"  round(coalesce(stddev_samp(wait_time_minutes) {w}, 0e0), 9) AS rolling_std_{label}")


@register("w_01_02_rolling", sql=f"""
SELECT session_id, station_id, {_roll_sql(6, '1h')}, {_roll_sql(18, '3h')}, {_roll_sql(36, '6h')}
FROM sessions""")
def w_01_02_rolling(spark, sf_dir):
    out = fe.add_rolling_features(ad.sessions(spark, sf_dir))
    return out.select("session_id", "station_id", *[F.round(c, 9).alias(c) for c in out.columns if c.startswith("rolling_")])


_E = "OVER (PARTITION BY station_id ORDER BY session_start, session_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@register("w_03_expanding", sql=f"""
SELECT session_id, {avg_9('wait_time_minutes', _E)} AS expanding_mean,
  round(coalesce(stddev_samp(wait_time_minutes) {_E}, 0e0), 9) AS expanding_std
FROM sessions""")
def w_03_expanding(spark, sf_dir):
    return fe.add_expanding_features(ad.sessions(spark, sf_dir)).select(
        "session_id", F.round("rolling_mean_1h", 9).alias("expanding_mean"), F.round("rolling_std_1h", 9).alias("expanding_std"))


_L = "OVER (PARTITION BY station_id ORDER BY session_start, session_id)"


@register("w_04_lags", sql="SELECT session_id, " + ", ".join(
    f"lag(wait_time_minutes, {k}) {_L} AS lag_{k}" for k in fe.LAGS) + " FROM sessions")
def w_04_lags(spark, sf_dir):
    out = fe.add_lag_features(ad.sessions(spark, sf_dir))
    return out.select("session_id", *[f"lag_{k}" for k in fe.LAGS])


@register("w_05_global_lags", sql="SELECT session_id, " + ", ".join(
    f"lag(wait_time_minutes, {k}) OVER (ORDER BY session_start, session_id) AS lag_{k}" for k in fe.LAGS) + " FROM sessions")
def w_05_global_lags(spark, sf_dir):
    out = fe.add_lag_features(ad.sessions(spark, sf_dir).drop("station_id"))
    return out.select("session_id", *[f"lag_{k}" for k in fe.LAGS])


_FILL = ["queue_size", "energy_kwh", "traffic_score", *(f"lag_{k}" for k in fe.LAGS)]


@register("p_22_median_fill", sql="WITH f AS (SELECT session_id, queue_size, energy_kwh, traffic_score, " + ", ".join(
    f"lag(wait_time_minutes, {k}) {_L} AS lag_{k}" for k in fe.LAGS) + " FROM sessions) SELECT session_id, " + ", ".join(
    f"cast(coalesce({c}, (SELECT coalesce(median({c}), 0e0) FROM f)) AS double) AS {c}" for c in _FILL) + " FROM f")
def p_22_median_fill(spark, sf_dir):
    out = fe.add_lag_features(ad.sessions(spark, sf_dir)).select("session_id", *_FILL)
    return fe.fill_numeric_medians(out, cl.numeric_columns(out, exclude=("session_id",)))


_WB = ("OVER (PARTITION BY station_id ORDER BY session_start, l_orderkey, l_linenumber, l_partkey "
       "ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)")
_LB = "OVER (PARTITION BY station_id ORDER BY session_start, l_orderkey, l_linenumber, l_partkey)"


@register("w_01_04_rolling_lags_big", sql=f"""
SELECT l_orderkey, l_linenumber, l_partkey, station_id,
  {avg_9('session_duration_min', _WB.format(n=6))} AS rolling_mean_1h,
  round(coalesce(stddev_samp(session_duration_min) {_WB.format(n=6)}, 0e0), 9) AS rolling_std_1h,
  {avg_9('session_duration_min', _WB.format(n=36))} AS rolling_mean_6h,
  lag(session_duration_min, 1) {_LB} AS lag_1, lag(session_duration_min, 24) {_LB} AS lag_24
FROM sessions_big""")
def w_01_04_rolling_lags_big(spark, sf_dir):
    order = ("session_start", "l_orderkey", "l_linenumber", "l_partkey")
    s = ad.sessions_big(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "station_id", "session_start", "session_duration_min")
    out = fe.add_history_features(s, "session_duration_min", "station_id", order, {"1h": 6, "6h": 36}, [1, 24])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "station_id",
                      *[F.round(c, 9).alias(c) for c in ("rolling_mean_1h", "rolling_std_1h", "rolling_mean_6h")], "lag_1", "lag_24")
