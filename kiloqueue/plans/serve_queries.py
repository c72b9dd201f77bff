"""Registered queries: recommendation, prediction tables, alerts, station lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiloqueue.functions import geo
from kiloqueue.functions.scalars import availability_label
from kiloqueue.operators import alerts as al
from kiloqueue.operators import predict as pr
from kiloqueue.operators import quality as qa
from kiloqueue.operators import recommend as rc
from kiloqueue.operators.clean import merge_datasets
from kiloqueue.operators.features import add_temporal_features
from kiloqueue.plans.oracle_base import haversine_sql, queue_wait_sql, rnd
from kiloqueue.plans.registry import register
from kiloqueue.sources import adapter as ad

# --- oracle helpers -----------------------------------------------------------

_WEIGHTS_SQL = """
weights AS (SELECT * FROM (VALUES ('balanced', 0.35e0, 0.25e0, 0.20e0, 0.10e0, 0.10e0),
  ('speed', 0.50e0, 0.20e0, 0.15e0, 0.10e0, 0.05e0), ('distance', 0.20e0, 0.50e0, 0.15e0, 0.10e0, 0.05e0),
  ('availability', 0.20e0, 0.15e0, 0.50e0, 0.10e0, 0.05e0))
  w(priority, w_wait, w_distance, w_availability, w_reliability, w_traffic))"""


def _asin_dist(lat1, lng1, lat2, lng2):
    a = (f"(pow(sin(radians(({lat2})-({lat1}))/2), 2) + cos(radians({lat1}))*cos(radians({lat2}))"
         f"*pow(sin(radians(({lng2})-({lng1}))/2), 2))")
    return f"(2e0*6371e0*asin(sqrt(least({a}, 1e0))))"


def _score_sql(dist: str, pref: str, wait: str = "wt") -> str:
    """Sub-scores and composite (R-B, R-C) over a row with station columns and weights."""
    s_wait = f"greatest(0e0, 1e0 - {wait}/60e0)"
    s_dist = f"greatest(0e0, 1e0 - ({dist})/20e0)"
    s_avail = "(coalesce(available_ports, 1) / greatest(coalesce(num_ports, greatest(coalesce(available_ports, 1), 1)), 1))"
    s_rel = ("CASE WHEN contains(coalesce(status, 'Unknown'), 'Operational') OR "
             "contains(coalesce(status, 'Unknown'), 'Online') THEN 1e0 ELSE 0.3e0 END")
    s_tr = "greatest(0e0, 1e0 - coalesce(traffic_score, 0.3e0))"
    comp = (f"(w_wait*{s_wait} + w_distance*{s_dist} + w_availability*{s_avail} + w_reliability*{s_rel}"
            f" + w_traffic*{s_tr})")
    comp = (f"CASE WHEN {pref} IS NOT NULL AND {pref} <> '' AND contains(lower(coalesce(connector_type, '')),"
            f" lower({pref})) THEN least(1e0, {comp} + 0.05e0) ELSE {comp} END")
    power = "coalesce(nullif(power_kw, 0e0), 50e0)"
    comp = f"CASE WHEN {power} >= 150e0 THEN least(1e0, {comp} + 0.02e0) ELSE {comp} END"
    return f"""{s_wait} AS s_wait, {s_dist} AS s_dist, {s_avail} AS s_avail, {s_rel} AS s_rel,
      {s_tr} AS s_tr, {comp} AS composite, {power} AS pw"""


def _record_sql(key: str, dist_out: str = "distance_km") -> str:
    return f"""{key}, cast(rk AS int) AS rank, station_id, name, lat, lng, {rnd(dist_out, 2)} AS distance_km,
  {rnd('wt', 1)} AS predicted_wait_min, coalesce(available_ports, 1) AS available_ports,
  coalesce(num_ports, greatest(coalesce(available_ports, 1), 1)) AS total_ports,
  {rnd('(1e0 - s_avail)*100e0', 1)} AS utilization_pct, connector_type, pw AS power_kw, operator,
  coalesce(status, 'Unknown') AS status, {rnd('coalesce(traffic_score, 0.3e0)', 3)} AS traffic_score,
  {rnd('composite', 4)} AS composite_score,
  struct_pack(wait_score := {rnd('s_wait', 4)}, distance_score := {rnd('s_dist', 4)},
    availability_score := {rnd('s_avail', 4)}, reliability_score := {rnd('s_rel', 4)},
    traffic_score := {rnd('s_tr', 4)}) AS score_breakdown,
  printf('https://www.google.com/maps/dir/?api=1&destination=%.6f,%.6f&travelmode=driving', lat, lng)
    AS routing_url,
  CASE WHEN coalesce(available_ports, 1) <= 0 THEN 'FULL' WHEN wt < 10 THEN 'RECOMMENDED'
    WHEN wt < 30 THEN 'MODERATE WAIT' ELSE 'HIGH WAIT' END AS action"""


def _recommend_sql(users: str, wait_source: str, top_n: int = 5) -> str:
    """users x stations within detour, scored, top-N per user."""
    d = _asin_dist("u.user_lat", "u.user_lng", "s.lat", "s.lng")
    return f"""
SELECT {_record_sql('user_id')} FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY composite DESC, station_id) AS rk FROM (
    SELECT u.user_id, s.*, {d} AS distance_km, w.*, {wait_source} AS wt, u.connector_pref
    FROM {users} u JOIN weights w ON w.priority = u.priority
    CROSS JOIN stations_w s WHERE {d} <= u.max_detour_km) c0,
  LATERAL (SELECT {_score_sql('c0.distance_km', 'c0.connector_pref', 'c0.wt')}) sc) r
WHERE rk <= {top_n}"""


_STATIONS_W_PRED = """
lastp AS (SELECT station_id, arg_max(predicted_wait_min, seq) AS pw_pred FROM predictions GROUP BY station_id),
stations_w AS (SELECT s.*, lastp.pw_pred FROM stations s LEFT JOIN lastp USING (station_id))"""


# --- recommendation -------------------------------------------------------------------

@register("r_d_recommend_users", sql=_recommend_sql("users", "coalesce(pw_pred, 20e0)"),
          ctes=_WEIGHTS_SQL + "," + _STATIONS_W_PRED)
def r_d_recommend_users(spark, sf_dir):
    return rc.recommend(ad.users(spark, sf_dir), ad.stations(spark, sf_dir), ad.predictions(spark, sf_dir))


@register("r_g_saved_preferences", sql=_recommend_sql("ureq", "coalesce(pw_pred, 20e0)"),
          ctes=_WEIGHTS_SQL + "," + _STATIONS_W_PRED + """,
ureq AS (SELECT u.user_id, u.user_lat, u.user_lng,
  CASE WHEN p.user_id IS NOT NULL THEN p.priority ELSE u.priority END AS priority,
  CASE WHEN p.user_id IS NOT NULL THEN p.connector_pref ELSE u.connector_pref END AS connector_pref,
  CASE WHEN p.user_id IS NOT NULL THEN p.max_detour_km ELSE u.max_detour_km END AS max_detour_km
  FROM users u LEFT JOIN saved_prefs p USING (user_id))""")
def r_g_saved_preferences(spark, sf_dir):
    req = rc.apply_saved_preferences(ad.users(spark, sf_dir), ad.saved_preferences(spark, sf_dir))
    return rc.recommend(req, ad.stations(spark, sf_dir), ad.predictions(spark, sf_dir))


_FUTURE_WAIT = queue_wait_sql("greatest(1, num_ports)", "1e0", "3e0", "0")


@register("r_f_recommend_future", sql=_recommend_sql("users", "coalesce(fw, 'inf'::double)"),
          ctes=_WEIGHTS_SQL + f""",
stations_w AS (SELECT s.*, CASE WHEN {_FUTURE_WAIT} IS NULL THEN NULL
  ELSE greatest(0e0, {rnd(_FUTURE_WAIT, 1)}) END AS fw FROM stations s)""")
def r_f_recommend_future(spark, sf_dir):
    return rc.recommend_future(ad.users(spark, sf_dir), ad.stations(spark, sf_dir), 18)


@register("r_e_en_route", sql=f"""
SELECT {_record_sql('route_id', 'min_d')} FROM (
  SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY composite DESC, station_id) AS rk FROM (
    SELECT n.route_id, n.min_d, s.*, w.*, 20e0 AS wt, NULL::varchar AS connector_pref,
      {_asin_dist('f.wp_lat', 'f.wp_lng', 's.lat', 's.lng')} AS distance_km
    FROM (SELECT r.route_id, s.station_id, min({_asin_dist('r.wp_lat', 'r.wp_lng', 's.lat', 's.lng')}) AS min_d
          FROM routes r CROSS JOIN stations s GROUP BY ALL) n
    JOIN stations s USING (station_id) JOIN routes f ON f.route_id = n.route_id AND f.wp_idx = 0
    JOIN weights w ON w.priority = 'balanced'
    WHERE n.min_d <= 5e0) c0,
  LATERAL (SELECT {_score_sql('c0.distance_km', 'c0.connector_pref', 'c0.wt')}) sc) r
WHERE rk <= 3""", ctes=_WEIGHTS_SQL)
def r_e_en_route(spark, sf_dir):
    return rc.recommend_en_route(ad.routes(spark, sf_dir), ad.stations(spark, sf_dir), 5.0, 3)


_RECS = _recommend_sql("users", "coalesce(pw_pred, 20e0)")


@register("r_h_diversify", sql=f"""
WITH RECURSIVE recs AS (SELECT user_id, rank, station_id, lat, lng FROM ({_RECS}) r),
walk(user_id, k, kept) AS (
  SELECT DISTINCT user_id, 0, cast([] AS STRUCT(rank INT, station_id BIGINT, lat DOUBLE, lng DOUBLE)[]) FROM recs
  UNION ALL
  SELECT w.user_id, w.k + 1, CASE WHEN r.station_id IS NULL OR len(list_filter(w.kept,
      lambda x: sqrt(pow(r.lat - x.lat, 2) + pow(r.lng - x.lng, 2)) * 111e0 < 1e0)) > 0 THEN w.kept
    ELSE list_append(w.kept, {{'rank': cast(r.rank AS int), 'station_id': r.station_id, 'lat': r.lat, 'lng': r.lng}}) END
  FROM walk w LEFT JOIN recs r ON r.user_id = w.user_id AND r.rank = w.k + 1 WHERE w.k < 5)
SELECT user_id, x.rank AS rank, x.station_id AS station_id, x.lat AS lat, x.lng AS lng
FROM (SELECT user_id, unnest(kept) AS x FROM walk WHERE k = 5) u""", ctes=_WEIGHTS_SQL + "," + _STATIONS_W_PRED)
def r_h_diversify(spark, sf_dir):
    recs = rc.recommend(ad.users(spark, sf_dir), ad.stations(spark, sf_dir), ad.predictions(spark, sf_dir))
    return rc.diversify(recs.select("user_id", "rank", "station_id", "lat", "lng"), 1.0, largest=5)


@register("j_03_latest_prediction", sql="""
SELECT station_id, arg_max(predicted_wait_min, seq) AS predicted_wait_min FROM predictions GROUP BY station_id""")
def j_03_latest_prediction(spark, sf_dir):
    return rc.latest_predictions(ad.predictions(spark, sf_dir))


# --- station lists --------------------------------------------------------------------

@register("o_03_station_list", sql=f"""
SELECT station_id, name, status, connector_type, {rnd(_asin_dist('37.78e0', '-122.41e0', 'lat', 'lng'), 2)}
  AS distance_km
FROM stations WHERE contains(lower(status), 'operational') AND contains(lower(connector_type), 'c')
ORDER BY distance_km, station_id LIMIT 20""")
def o_03_station_list(spark, sf_dir):
    st = ad.stations(spark, sf_dir)
    d = F.round(geo.haversine_km(F.lit(37.78), F.lit(-122.41), F.col("lat"), F.col("lng")), 2)
    return (st.where(F.lower("status").contains("operational") & F.lower("connector_type").contains("c"))
            .select("station_id", "name", "status", "connector_type", d.alias("distance_km"))
            .orderBy(F.coalesce("distance_km", F.lit(999.0)), "station_id").limit(20))


@register("p_13_15_status_filter", sql="""
SELECT station_id, name, status FROM stations WHERE contains(lower(status), lower('partial'))""")
def p_13_15_status_filter(spark, sf_dir):
    return ad.stations(spark, sf_dir).where(F.lower("status").contains("partial")).select(
        "station_id", "name", "status")


@register("p_14_point_lookup", sql="SELECT station_id, name, num_ports FROM stations WHERE station_id = 7")
def p_14_point_lookup(spark, sf_dir):
    return ad.stations(spark, sf_dir).where(F.col("station_id") == 7).select("station_id", "name", "num_ports")


@register("p_16_availability_name_filter", sql="""
SELECT station_id, name, CASE WHEN u < 0.4 THEN 'Available' WHEN u < 0.7 THEN 'Moderate'
  WHEN u < 0.9 THEN 'Busy' ELSE 'Full' END AS availability
FROM (SELECT *, (num_ports - available_ports) / num_ports AS u FROM stations) s
WHERE contains(lower(name), '00') AND (CASE WHEN u < 0.4 THEN 'Available' WHEN u < 0.7 THEN 'Moderate'
  WHEN u < 0.9 THEN 'Busy' ELSE 'Full' END) = 'Busy'""")
def p_16_availability_name_filter(spark, sf_dir):
    st = ad.stations(spark, sf_dir)
    lab = availability_label((F.col("num_ports") - F.col("available_ports")) / F.col("num_ports"))
    return (st.select("station_id", "name", lab.alias("availability"))
            .where((F.col("availability") == "Busy") & F.lower("name").contains("00")))


_SORT = """
cs AS (SELECT s.station_id, s.name, nullif(s.available_ports, 3) AS available_ports, p.w AS wait_min,
  CASE WHEN s.station_id % 7 > 0 THEN DIST END AS distance_km FROM stations s LEFT JOIN (
  SELECT station_id, arg_max(predicted_wait_min, seq) AS w FROM predictions GROUP BY station_id) p USING (station_id))""".replace(
    "DIST", _asin_dist("37.78e0", "-122.41e0", "s.lat", "s.lng"))


def _sortable(spark, sf_dir):
    """Stations as a client lists them: some without a distance or a count of free ports."""
    p = rc.latest_predictions(ad.predictions(spark, sf_dir)).withColumnRenamed("predicted_wait_min", "wait_min")
    d = geo.haversine_km(F.lit(37.78), F.lit(-122.41), F.col("lat"), F.col("lng"))
    return ad.stations(spark, sf_dir).join(p, "station_id", "left").select(
        "station_id", "name", F.nullif("available_ports", F.lit(3)).alias("available_ports"), "wait_min",
        F.when(F.col("station_id") % 7 > 0, d).alias("distance_km"))


def _register_sort(by: str, key: str) -> None:
    from kiloqueue.operators.summary import client_places

    @register(f"o_06_client_sort_{by}", sql=f"""
SELECT station_id, cast(row_number() OVER (ORDER BY {key}, station_id) AS int) AS place FROM cs""", ctes=_SORT)
    def query(spark, sf_dir):
        return client_places(_sortable(spark, sf_dir), by).select("station_id", F.col("place").cast("int").alias("place"))


for _by, _key in (("wait", "coalesce(nullif(wait_min, 0), 99e0)"), ("distance", "coalesce(distance_km, 99e0)"),
                  ("availability", "-coalesce(available_ports, 0)"), ("name", "name")):
    _register_sort(_by, _key)


@register("o_08_radius_search", sql=f"""
SELECT station_id, name FROM stations
WHERE {haversine_sql('37.7749e0', '-122.4194e0', 'lat', 'lng')} <= 5e0""")
def o_08_radius_search(spark, sf_dir):
    from kiloqueue.operators.geo import filter_by_radius

    return filter_by_radius(ad.stations(spark, sf_dir), 37.7749, -122.4194, 5.0).select("station_id", "name")


@register("o_09_a_05_nearest_summary", sql=f"""
SELECT arg_min(station_id, {_asin_dist('37.7749e0', '-122.4194e0', 'lat', 'lng')}) AS nearest_station_id,
  cast(count_if(status = 'Operational' AND available_ports > 0) AS bigint) AS n_available,
  round(avg(CASE WHEN coalesce(pw, 0) = 0 THEN 10e0 ELSE pw END)) AS mean_wait_rounded
FROM stations_w""", ctes=_STATIONS_W_PRED.replace("pw_pred", "pw"))
def o_09_a_05_nearest_summary(spark, sf_dir):
    st = rc.attach_wait(ad.stations(spark, sf_dir), ad.predictions(spark, sf_dir))
    from kiloqueue.operators.summary import mobile_summary

    return mobile_summary(st.withColumn("wait_min", F.col("_wait")).drop("_wait"), 37.7749, -122.4194)


# --- predictions --------------------------------------------------------------------------

def _pred_sql(source: str, ports: str, avail: str, queue: str, extra: str = "") -> str:
    c, lam = f"greatest(1, {ports})", f"greatest(0.1e0, {queue} + 1e0)"
    w = queue_wait_sql(c, lam, "3e0", queue)
    p = f"(CASE WHEN {w} IS NULL THEN NULL ELSE greatest(0e0, {rnd(w, 1)}) END)"
    labw = f"coalesce({p}, 'inf'::double)"
    return f"""
SELECT {extra} station_id, {p} AS predicted_wait_min, NULL::double AS rf_prediction,
  {rnd(w, 2)} AS queue_prediction, 'medium' AS confidence_level,
  {lam}/({c}*3e0) < 1 AS queue_stable, {rnd(f"{lam}/({c}*3e0)*100e0", 1)} AS utilization_pct,
  CASE WHEN {labw} <= 5 AND {avail} > 0 THEN 'GO_NOW' WHEN {labw} <= 15 THEN 'GOOD_TIME'
    WHEN {labw} <= 30 THEN 'MODERATE_WAIT' WHEN {labw} <= 60 THEN 'LONG_WAIT' ELSE 'AVOID' END AS recommendation
FROM {source}"""


@register("m_14_prediction_table", sql=_pred_sql("stations", "num_ports", "available_ports", "queue_size"))
def m_14_prediction_table(spark, sf_dir):
    p = pr.predict_table(ad.stations(spark, sf_dir), unstable_wait=None)
    return p.select("station_id", "predicted_wait_min", "rf_prediction", "queue_prediction", "confidence_level",
                    "queue_stable", "utilization_pct", "recommendation")


@register("m_15_predict_batch", sql="""
SELECT session_id, NULL::double AS rf_prediction, 15e0 AS predicted_wait_min,
  CASE WHEN 15e0 <= 5 AND coalesce(available_ports, 2) > 0 THEN 'GO_NOW' ELSE 'GOOD_TIME' END AS recommendation
FROM sessions""")
def m_15_predict_batch(spark, sf_dir):
    return pr.predict_batch(ad.sessions(spark, sf_dir)).select(
        "session_id", "rf_prediction", "predicted_wait_min", "recommendation")


_REQ_SQL = """
req AS (
  SELECT s.session_id, s.station_id, st.num_ports, s.available_ports, s.queue_size,
    hour(s.session_start) AS hour, cast(isodow(s.session_start) - 1 AS int) AS day_of_week,
    s.traffic_score, s.temperature_c, s.precipitation_mm
  FROM sessions s JOIN stations st USING (station_id)),
bad AS (SELECT *, nullif(concat_ws('; ', {rules}), '') AS error FROM ({spoilt}) x)""".format(
    rules=", ".join(f"CASE WHEN NOT coalesce({cond}, false) THEN '{text}' END" for cond, text in (
        ("num_ports BETWEEN 1 AND 100", "num_ports between 1 and 100"),
        ("available_ports BETWEEN 0 AND 100", "available_ports between 0 and 100"),
        ("available_ports <= num_ports", "available_ports must not exceed num_ports"),
        ("queue_size BETWEEN 0 AND 200", "queue_size between 0 and 200"),
        ("hour BETWEEN 0 AND 23", "hour between 0 and 23"), ("day_of_week BETWEEN 0 AND 6", "day_of_week between 0 and 6"),
        ("traffic_score BETWEEN 0 AND 1", "traffic_score between 0 and 1"),
        ("precipitation_mm >= 0", "precipitation_mm must be >= 0"))),
    spoilt="""SELECT session_id, station_id, CASE WHEN session_id % 31 = 0 THEN 101 ELSE num_ports END AS num_ports,
      CASE WHEN session_id % 37 = 0 THEN -1 ELSE available_ports END AS available_ports,
      CASE WHEN session_id % 41 = 0 THEN 201 ELSE queue_size END AS queue_size,
      CASE WHEN session_id % 43 = 0 THEN 24 ELSE hour END AS hour,
      CASE WHEN session_id % 47 = 0 THEN 7 ELSE day_of_week END AS day_of_week,
      CASE WHEN session_id % 53 = 0 THEN 1.5e0 WHEN session_id % 59 = 0 THEN NULL ELSE traffic_score END AS traffic_score,
      temperature_c, CASE WHEN session_id % 61 = 0 THEN -1e0 ELSE precipitation_mm END AS precipitation_mm FROM req""")


def _requests(spark, sf_dir):
    """Session readings as prediction requests, some of them spoilt so that every rule is broken."""
    ses = add_temporal_features(ad.sessions(spark, sf_dir))
    st = ad.stations(spark, sf_dir).select("station_id", "num_ports")
    sid = F.col("session_id")
    spoil = lambda m, bad, c: F.when(sid % m == 0, bad).otherwise(F.col(c)).alias(c)
    return ses.withColumn("hour", F.col("hour_of_day")).join(st, "station_id").select(
        "session_id", "station_id", spoil(31, F.lit(101), "num_ports"), spoil(37, F.lit(-1), "available_ports"),
        spoil(41, F.lit(201), "queue_size"), spoil(43, F.lit(24), "hour"), spoil(47, F.lit(7), "day_of_week"),
        F.when(sid % 53 == 0, 1.5).when(sid % 59 == 0, F.lit(None)).otherwise(F.col("traffic_score")).alias("traffic_score"),
        "temperature_c", spoil(61, F.lit(-1.0), "precipitation_mm"))


@register("m_16_predict_requests", sql=f"""
SELECT * FROM ({_pred_sql("bad WHERE error IS NULL", "num_ports", "available_ports", "queue_size", "session_id, error,")}) ok
UNION ALL
SELECT session_id, error, station_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM bad WHERE error IS NOT NULL""", ctes=_REQ_SQL)
def m_16_predict_requests(spark, sf_dir):
    out = pr.predict_requests(_requests(spark, sf_dir), unstable_wait=None)
    return out.select("session_id", "error", "station_id", "predicted_wait_min", "rf_prediction", "queue_prediction",
                      "confidence_level", "queue_stable", "utilization_pct", "recommendation")


@register("m_16_rejected_requests", sql="SELECT session_id, station_id, error FROM bad WHERE error IS NOT NULL", ctes=_REQ_SQL)
def m_16_rejected_requests(spark, sf_dir):
    _, rejected = qa.validate(_requests(spark, sf_dir))
    return rejected.select("session_id", "station_id", F.concat_ws("; ", "errors").alias("error"))


@register("p_24_recommend_rules", sql="""
SELECT user_id, nullif(concat_ws('; ', CASE WHEN NOT max_detour_km BETWEEN 0.5 AND 100 THEN 'max_detour_km between 0.5 and 100' END,
  CASE WHEN NOT top_n BETWEEN 1 AND 20 THEN 'top_n between 1 and 20' END), '') AS error FROM (
  SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 0.1e0 ELSE max_detour_km END AS max_detour_km, user_id % 23 AS top_n FROM users) x""")
def p_24_recommend_rules(spark, sf_dir):
    u = ad.users(spark, sf_dir)
    ask = u.select("user_id", F.when(F.col("user_id") % 5 == 0, 0.1).otherwise(F.col("max_detour_km")).alias("max_detour_km"),
                   (F.col("user_id") % 23).alias("top_n"))
    errors = qa.violations(ask, qa.RECOMMEND_RULES)
    return ask.select("user_id", F.nullif(F.concat_ws("; ", errors), F.lit("")).alias("error"))


_ENSEMBLE = """
mp AS (SELECT s.*, cast((station_id * 17) % 61 AS double) + 0.25e0 AS rf FROM stations s WHERE station_id % 13 <> 5
  UNION ALL SELECT s.*, NULL FROM stations s WHERE station_id % 13 = 5)"""


def _with_model(spark, sf_dir):
    """Stations with a stored model prediction (some without)."""
    k = F.col("station_id")
    return ad.stations(spark, sf_dir).withColumn("rf", F.when(k % 13 != 5, ((k * 17) % 61).cast("double") + 0.25))


@register("m_14_ensemble", sql=f"""
SELECT station_id, {rnd('rf', 1)} AS rf_prediction, p AS predicted_wait_min, 'high' AS confidence_level,
  CASE WHEN p <= 5 AND available_ports > 0 THEN 'GO_NOW' WHEN p <= 15 THEN 'GOOD_TIME' WHEN p <= 30 THEN 'MODERATE_WAIT'
    WHEN p <= 60 THEN 'LONG_WAIT' ELSE 'AVOID' END AS recommendation
FROM (SELECT *, greatest(0e0, {rnd("0.4e0 * rf + 0.15e0 * w", 1)}) AS p FROM (
  SELECT *, {queue_wait_sql("greatest(1, num_ports)", "greatest(0.1e0, queue_size + 1e0)", "3e0", "queue_size")} AS w
  FROM mp WHERE rf IS NOT NULL) x WHERE w IS NOT NULL) y""", ctes=_ENSEMBLE)
def m_14_ensemble(spark, sf_dir):
    out = pr.predict_table(_with_model(spark, sf_dir).where("rf is not null"), "rf").where("queue_stable")
    return out.select("station_id", "rf_prediction", "predicted_wait_min", "confidence_level", "recommendation")


@register("m_15_predict_batch_model", sql="""
SELECT station_id, rf AS rf_prediction, coalesce(rf, 15e0) AS predicted_wait_min,
  CASE WHEN coalesce(rf, 15e0) <= 5 AND available_ports > 0 THEN 'GO_NOW' WHEN coalesce(rf, 15e0) <= 15 THEN 'GOOD_TIME'
    WHEN coalesce(rf, 15e0) <= 30 THEN 'MODERATE_WAIT' WHEN coalesce(rf, 15e0) <= 60 THEN 'LONG_WAIT' ELSE 'AVOID' END AS recommendation
FROM mp""", ctes=_ENSEMBLE)
def m_15_predict_batch_model(spark, sf_dir):
    return pr.predict_batch(_with_model(spark, sf_dir), "rf").select("station_id", "rf_prediction", "predicted_wait_min", "recommendation")


@register("m_17_demand_curve", sql=f"""
SELECT station_id, cast(h AS int) AS hour, lpad(cast(h AS varchar), 2, '0') || ':00' AS label,
  predicted_wait_min, recommendation
FROM ({_pred_sql("(SELECT station_id, num_ports, greatest(1, num_ports // 2) AS av, 2 AS q FROM stations) x",
                 "num_ports", "av", "q")}) p, range(0, 24) t(h)""")
def m_17_demand_curve(spark, sf_dir):
    return pr.demand_curve(ad.stations(spark, sf_dir), unstable_wait=None)


@register("m_17_forecast_12h", sql=f"""
SELECT station_id, station_name, cast((8 + o) % 24 AS int) AS hour,
  lpad(cast((8 + o) % 24 AS varchar), 2, '0') || ':00' AS label, cast(o AS int) AS offset_hours,
  predicted_wait_min, recommendation
FROM ({_pred_sql("stations", "num_ports", "available_ports", "queue_size", "name AS station_name,")}) p,
  range(0, 12) t(o)""")
def m_17_forecast_12h(spark, sf_dir):
    return pr.forecast(ad.stations(spark, sf_dir), 8, 12, unstable_wait=None)


@register("m_18_realtime_prediction", sql=f"""
SELECT station_id, coalesce(tr.traffic_score, 0.3e0) AS traffic_score, 20e0 AS temperature_c,
  predicted_wait_min, recommendation
FROM ({_pred_sql("stations", "num_ports", "available_ports", "queue_size")}) p
LEFT JOIN traffic tr USING (station_id)""")
def m_18_realtime_prediction(spark, sf_dir):
    out = pr.predict_realtime(ad.stations(spark, sf_dir), ad.traffic(spark, sf_dir), unstable_wait=None)
    return out.select("station_id", "traffic_score", "temperature_c", "predicted_wait_min", "recommendation")


# --- alerts -------------------------------------------------------------------------------

def _alert_sql(src: str, extra: str = "") -> str:
    name = "coalesce(name, 'Station ' || cast(station_id AS varchar))"
    return f"""
SELECT {extra} station_id, {name} AS station_name, 'HIGH_WAIT_TIME' AS alert_type,
  printf('Predicted wait time %.1f min exceeds threshold (30 min)', w) AS message,
  CASE WHEN w >= 60 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, w AS metric, 1 AS rule_order
FROM {src} WHERE w >= 30
UNION ALL
SELECT {extra} station_id, {name}, 'HIGH_UTILIZATION',
  printf('Station utilisation %.1f%% exceeds threshold (90%%)', u / 100e0 * 100e0), 'WARNING',
  u / 100e0 * 100e0, 2
FROM {src} WHERE u / 100e0 >= 0.9
UNION ALL
SELECT {extra} station_id, {name}, 'STATION_OFFLINE', 'Station is offline or unreachable', 'CRITICAL',
  NULL::double, 3
FROM {src} WHERE contains(coalesce(status, 'Unknown'), 'Offline')"""


_SP = """
sp AS (SELECT s.*, coalesce(p.w, 0e0) AS w, coalesce(p.u, 0e0) AS u FROM stations s LEFT JOIN (
  SELECT station_id, arg_max(predicted_wait_min, seq) AS w, arg_max(utilization_pct, seq) AS u
  FROM predictions GROUP BY station_id) p USING (station_id))"""


@register("l_04_alert_rules", sql=_alert_sql("sp"), ctes=_SP)
def l_04_alert_rules(spark, sf_dir):
    return al.evaluate_network(ad.stations(spark, sf_dir), ad.predictions(spark, sf_dir))


_AE = """
ae AS (SELECT session_id, station_id, name, status, event_time, predicted_wait_min AS w, utilization_pct AS u
  FROM alert_events),
alerts_t AS (""" + _alert_sql("ae", "session_id, event_time,") + ")"


@register("l_04_alert_stream_batch", sql="SELECT session_id, station_id, alert_type, severity, message "
          "FROM alerts_t", ctes=_AE)
def l_04_alert_stream_batch(spark, sf_dir):
    return al.evaluate_network(ad.alert_events(spark, sf_dir), None,
                               extra_cols=("session_id", "event_time")).select(
        "session_id", "station_id", "alert_type", "severity", "message")


@register("l_05_cooldown_batch", sql="""
WITH RECURSIVE chain(station_id, alert_type, t) AS (
  SELECT station_id, alert_type, min(epoch_us(event_time)) FROM alerts_t GROUP BY station_id, alert_type
  UNION ALL
  SELECT c.station_id, c.alert_type,
    (SELECT min(epoch_us(a.event_time)) FROM alerts_t a WHERE a.station_id = c.station_id
       AND a.alert_type = c.alert_type AND epoch_us(a.event_time) >= c.t + 21600000000)
  FROM chain c WHERE c.t IS NOT NULL)
SELECT station_id, alert_type, strftime(make_timestamp(t), '%Y-%m-%d %H:%M:%S.%f') AS event_time
FROM chain WHERE t IS NOT NULL""", ctes=_AE)
def l_05_cooldown_batch(spark, sf_dir):
    a = al.evaluate_network(ad.alert_events(spark, sf_dir), None, extra_cols=("session_id", "event_time"))
    out = al.apply_cooldown(a, "event_time", cooldown_s=21600)
    return out.select("station_id", "alert_type",
                      F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_time"))


@register("l_06_w_13_alert_history", sql="""
SELECT session_id, station_id, alert_type FROM alerts_t
ORDER BY event_time DESC, station_id DESC, rule_order DESC LIMIT 50""", ctes=_AE)
def l_06_w_13_alert_history(spark, sf_dir):
    a = al.evaluate_network(ad.alert_events(spark, sf_dir), None, extra_cols=("session_id", "event_time"))
    return al.history(a, 50).select("session_id", "station_id", "alert_type")


@register("l_06_dismiss_station", sql="SELECT station_id, alert_type FROM (" + _alert_sql("sp") +
          ") x WHERE station_id <> 3", ctes=_SP)
def l_06_dismiss_station(spark, sf_dir):
    a = al.evaluate_network(ad.stations(spark, sf_dir), ad.predictions(spark, sf_dir))
    return al.dismiss(a, 3).select("station_id", "alert_type")


@register("p_26_anomalies", sql="""
SELECT station_id, reasons, CASE WHEN len(reasons) = 2 THEN 'critical' ELSE 'warning' END AS severity FROM (
  SELECT station_id, list_filter([CASE WHEN w > 45 THEN printf('High wait: %.1f min', w) END,
    CASE WHEN u > 95 THEN printf('Over-capacity: %.1f%%', u) END], lambda x: x IS NOT NULL) AS reasons
  FROM (SELECT station_id, arg_max(predicted_wait_min, seq) AS w, arg_max(utilization_pct, seq) AS u
        FROM predictions GROUP BY station_id) p) q WHERE len(reasons) > 0""")
def p_26_anomalies(spark, sf_dir):
    p = ad.predictions(spark, sf_dir).groupBy("station_id").agg(
        F.max_by(F.struct("predicted_wait_min", "utilization_pct"), "seq").alias("p")).select("station_id", "p.*")
    return qa.detect_anomalies(p)


@register("p_27_l_03_threshold_alerts", sql="""
SELECT session_id, station_id, true AS alert FROM alert_events WHERE predicted_wait_min >= 30""")
def p_27_l_03_threshold_alerts(spark, sf_dir):
    return al.threshold_alerts(ad.alert_events(spark, sf_dir), "predicted_wait_min", 30.0).select(
        "session_id", "station_id", "alert")


_PAGES = """
pg AS (SELECT *, (row_number() OVER (PARTITION BY severity ORDER BY station_id, rule_order) - 1) // 10 AS page FROM (""" + _alert_sql("sp") + """) a)"""


@register("n_06_webhook_payload", sql="""
SELECT severity, cast(page AS int) AS page, cast(count(*) AS int) AS count,
  string_agg('[' || severity || '] ' || station_name || ': ' || message, chr(10) ORDER BY station_id, rule_order) AS blocks,
  string_agg(coalesce(cast(round(CASE WHEN alert_type = 'HIGH_WAIT_TIME' THEN metric END, 6) AS varchar), '-'), ',' ORDER BY station_id, rule_order) AS waits
FROM pg GROUP BY severity, page""", ctes=_SP + "," + _PAGES)
def n_06_webhook_payload(spark, sf_dir):
    a = al.evaluate_network(ad.stations(spark, sf_dir), ad.predictions(spark, sf_dir))
    out = al.webhook_payload(a, as_of="2024-01-31T00:00:00")
    sent = F.from_json("payload", "alerts array<struct<data: struct<predicted_wait_min: double>>>, count int")
    waits = F.transform(sent["alerts"], lambda x: F.coalesce(F.round(x["data"]["predicted_wait_min"], 6).cast("string"), F.lit("-")))
    return out.select("severity", "page", sent["count"].alias("count"), F.array_join("blocks", "\n").alias("blocks"),
                      F.array_join(waits, ",").alias("waits"))


@register("l_02_latest_state", sql="""
SELECT station_id, arg_max(session_id, struct_pack(t := event_time, s := session_id)) AS session_id,
  arg_max(predicted_wait_min, struct_pack(t := event_time, s := session_id)) AS predicted_wait_min
FROM alert_events GROUP BY station_id""")
def l_02_latest_state(spark, sf_dir):
    ev = ad.alert_events(spark, sf_dir).select("station_id", "event_time", "session_id", "predicted_wait_min")
    return al.latest_per_key(ev, "station_id", "event_time", "session_id").select(
        "station_id", "session_id", "predicted_wait_min")


@register("j_13_n_09_live_merge", sql="""
SELECT coalesce(n.station_id, b.station_id) AS station_id, coalesce(n.predicted_wait_min, b.pw) AS wait_min,
  coalesce(n.name, b.name) AS name
FROM (SELECT station_id, name, 20e0 AS pw FROM stations WHERE station_id % 2 = 0) b
FULL OUTER JOIN (SELECT station_id, NULL::varchar AS name, arg_max(predicted_wait_min, seq) AS predicted_wait_min
                 FROM predictions WHERE station_id % 3 <> 1 GROUP BY station_id) n USING (station_id)""")
def j_13_n_09_live_merge(spark, sf_dir):
    from kiloqueue.operators.joins import live_merge

    base = ad.stations(spark, sf_dir).where(F.col("station_id") % 2 == 0).select(
        "station_id", "name", F.lit(20.0).alias("wait_min"))
    upd = rc.latest_predictions(ad.predictions(spark, sf_dir).where(F.col("station_id") % 3 != 1)).select(
        "station_id", F.lit(None).cast("string").alias("name"), F.col("predicted_wait_min").alias("wait_min"))
    return live_merge(base, upd, "station_id")


@register("j_12_station_prediction_join", sql=f"""
SELECT s.station_id, s.name, s.num_ports, p.predicted_wait_min, p.recommendation
FROM stations s JOIN ({_pred_sql("stations", "num_ports", "available_ports", "queue_size")}) p
  USING (station_id)""")
def j_12_station_prediction_join(spark, sf_dir):
    st = ad.stations(spark, sf_dir)
    p = pr.predict_table(st, unstable_wait=None).select("station_id", "predicted_wait_min", "recommendation")
    return st.select("station_id", "name", "num_ports").join(p, "station_id")


@register("j_01_merge_with_traffic_fanout", sql="""
SELECT s.session_id, coalesce(s.traffic_score, t.traffic_score, 0.3e0) AS traffic_score
FROM sessions s LEFT JOIN (SELECT station_id, traffic_score FROM traffic
  UNION ALL SELECT station_id, traffic_score FROM traffic WHERE station_id % 5 = 0) t USING (station_id)""")
def j_01_merge_with_traffic_fanout(spark, sf_dir):
    tr = ad.traffic(spark, sf_dir)
    dup = tr.unionByName(tr.where(F.col("station_id") % 5 == 0))
    out = merge_datasets(ad.stations(spark, sf_dir), ad.sessions(spark, sf_dir), dup)
    return out.select("session_id", "traffic_score")
