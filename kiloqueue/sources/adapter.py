"""Domain tables derived from the driver's TPC-H-like test tables.

Every derivation is deterministic column arithmetic, so the same rule can be
written as SQL for the DuckDB oracle (see ``kiloqueue.plans.oracle``).  The
derived tables grow with the source tables: ``stations`` with ``supplier``,
``sessions`` with ``events``, ``sessions_big`` with ``lineitem``, ``users``
with ``customer``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kiloqueue.session import ensure_utc

# Fixed values of the fixture mapping (FIXTURES.md, part B): city centre of the
# synthetic network, and the category lists picked by key modulus.
CITY_LAT = 37.7749
CITY_LNG = -122.4194
POWER_LEVELS = [7.2, 50.0, 150.0, 350.0]
CONNECTORS = ["Type 2", "CCS", "CHAdeMO", "Tesla", "J1772"]
EVENT_CONNECTOR = {"click": "CCS", "view": "Type 2", "purchase": "CHAdeMO", "signup": "Tesla"}
PRIORITIES = ["balanced", "speed", "distance", "availability"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_utc(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(key: Column, values: list) -> Column:
    """``case key % len(values) when 0 then values[0] ... end``."""
    n = len(values)
    expr = F.when((key % n) == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], start=1):
        expr = expr.when((key % n) == i, F.lit(v))
    return expr


def _offset(key: Column, mult: int, mod: int) -> Column:
    return ((key * mult) % mod - (mod - 1) // 2).cast("double") / 1e3


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: one charging station per supplier."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("s_suppkey")
    ports = (F.lit(2) + (k * 7) % 12)
    # nation is a fixed 25-row dimension: broadcasting it is size-safe.
    return (
        s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
        .select(
            k.cast("bigint").alias("station_id"),
            F.col("s_name").alias("name"),
            (F.lit(CITY_LAT) + _offset(k, 37, 121)).alias("lat"),
            (F.lit(CITY_LNG) + _offset(k, 53, 201)).alias("lng"),
            ports.cast("int").alias("num_ports"),
            ((k * 11) % (ports + 1)).cast("int").alias("available_ports"),
            ((k * 5) % 7).cast("int").alias("queue_size"),
            _pick(k, POWER_LEVELS).cast("double").alias("power_kw"),
            _pick(k, CONNECTORS).alias("connector_type"),
            F.when(F.col("s_acctbal") < 0, "Offline")
            .when(F.col("s_acctbal") < 1000, "Partial")
            .otherwise("Operational").alias("status"),
            F.col("n_name").alias("operator"),
            (((k * 29) % 100).cast("double") / 1e2).alias("traffic_score"),
        )
    )


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: one charging session per event; stations by user modulus."""
    ev = table(spark, sf_dir, "events")
    n_stations = table(spark, sf_dir, "supplier").select(F.count(F.lit(1))).scalar()
    k = _k()
    eid = F.col("event_id")
    queue = (k % 8).cast("int")
    avail = (F.floor(k / 8.0).cast("int") % 8)
    conn = F.lit(None).cast("string")
    for et, ct in reversed(list(EVENT_CONNECTOR.items())):
        conn = F.when(F.col("event_type") == et, F.lit(ct)).otherwise(conn)
    traffic = ((eid * 37) % 100).cast("double") / 1e2
    wait = F.greatest(
        F.lit(0.0),
        F.least(F.lit(90.0), (k % 8) * 11.5 + ((eid * 37) % 100).cast("double") / 1e1 - avail * 3.0),
    )
    return ev.select(
        eid.alias("session_id"),
        (F.col("user_id") % n_stations).alias("station_id"),
        F.col("ts").cast("timestamp").alias("session_start"),
        F.least(F.lit(120.0), F.lit(5.0) + F.col("value")).alias("session_duration_min"),
        (F.lit(1.0) + F.col("value") * 0.4).alias("energy_kwh"),
        queue.alias("queue_size"),
        avail.alias("available_ports"),
        traffic.alias("traffic_score"),
        ((eid * 13) % 50 - 8).cast("double").alias("temperature_c"),
        F.when(eid % 5 == 0, 0.5).otherwise(0.0).alias("precipitation_mm"),
        conn.alias("connector_type"),
        wait.alias("wait_time_minutes"),
    )


def sessions_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3: one session per lineitem row (bench scale). Not unique on session_id."""
    li = table(spark, sf_dir, "lineitem")
    minutes = ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 131) % 1440).cast("int")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("session_id"),
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_suppkey").alias("station_id"),
        F.timestamp_add("MINUTE", minutes, F.col("l_shipdate").cast("timestamp")).alias("session_start"),
        (F.lit(5.0) + F.col("l_quantity") * 2.0).alias("session_duration_min"),
        F.col("l_quantity").alias("energy_kwh"),
        (F.col("l_partkey") % 8).cast("int").alias("queue_size"),
        ((F.col("l_orderkey") + F.col("l_linenumber")) % 8).cast("int").alias("available_ports"),
        (F.col("l_discount") * 1e1).alias("traffic_score"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4: one user per customer, located around the city centre like stations."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("user_id"),
        (F.lit(CITY_LAT) + _offset(k, 37, 121)).alias("user_lat"),
        (F.lit(CITY_LNG) + _offset(k, 53, 201)).alias("user_lng"),
        _pick(k, PRIORITIES).alias("priority"),
        F.when(k % 3 == 1, "CCS").when(k % 3 == 2, "type 2").otherwise(F.lit(None).cast("string"))
        .alias("connector_pref"),
        F.lit(20.0).alias("max_detour_km"),
    )


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4: per-station mean traffic of sessions; every seventh station has no reading."""
    ses = sessions(spark, sf_dir)
    return (
        ses.where(F.col("station_id") % 7 != 3)
        .groupBy("station_id")
        .agg(F.avg("traffic_score").alias("traffic_score"))
    )


def weather_row() -> dict:
    """B4: the single weather observation appended to sessions (P-10)."""
    return {"temperature_c": 20.0, "precipitation_mm": 0.0}


def raw_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4 'dirty stations': B1 with rule-based defects for the cleaning operators."""
    st = stations(spark, sf_dir)
    sid = F.col("station_id")
    return st.select(
        "station_id", "name",
        F.when(sid % 17 == 0, F.lit(None).cast("double"))
        .when(sid % 17 == 1, F.col("lat") + 200.0).otherwise(F.col("lat")).alias("lat"),
        F.when(sid % 17 == 2, F.lit(-200.0)).otherwise(F.col("lng")).alias("lng"),
        F.when(sid % 19 == 0, F.lit(None).cast("int")).otherwise(F.col("num_ports")).alias("num_ports"),
        "available_ports", "queue_size",
        F.when(sid % 23 == 0, F.lit(None).cast("double")).otherwise(F.col("power_kw")).alias("power_kw"),
        F.when(sid % 11 == 0, F.lit("Mennekes"))
        .when(sid % 11 == 1, F.lit("CCS (Type 1)"))
        .when(sid % 11 == 2, F.lit(None).cast("string"))
        .otherwise(F.col("connector_type")).alias("connector_type"),
        F.when(sid % 13 == 0, F.lit(None).cast("string"))
        .when(sid % 29 == 0, F.lit("Not Operational"))
        .when(sid % 31 == 0, F.lit("available"))
        .otherwise(F.col("status")).alias("status"),
        "operator", "traffic_score",
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4: three waypoints per nation, offsets from the city centre (exploded form)."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("route_id"))
    wp = n.select("route_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("wp_idx"))
    r = F.col("route_id")
    i = F.col("wp_idx").cast("bigint")
    return wp.select(
        "route_id", "wp_idx",
        (F.lit(CITY_LAT) + ((r * 17 + i * 23) % 121 - 60).cast("double") / 1e3).alias("wp_lat"),
        (F.lit(CITY_LNG) + ((r * 31 + i * 41) % 201 - 100).cast("double") / 1e3).alias("wp_lng"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4: queue-model prediction per station (M-14, clipped to [0, 120] as P-20),
    plus a later second prediction (seq 2) for every third station, so that
    'last prediction wins' lookups are exercised."""
    from kiloqueue.functions.scalars import clip
    from kiloqueue.operators.predict import predict_table

    p = predict_table(stations(spark, sf_dir)).select(
        "station_id", clip(F.col("predicted_wait_min"), 0.0, 120.0).alias("predicted_wait_min"),
        "utilization_pct")
    first = p.select("station_id", F.lit(1).alias("seq"), "predicted_wait_min", "utilization_pct")
    later = p.where(F.col("station_id") % 3 == 0).select(
        "station_id", F.lit(2).alias("seq"),
        F.least(F.lit(120.0), F.col("predicted_wait_min") * 1.5 + 10.0).alias("predicted_wait_min"),
        "utilization_pct")
    return first.unionByName(later)


def saved_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4: saved preferences for every fifth user (R-G)."""
    u = users(spark, sf_dir)
    return u.where(F.col("user_id") % 5 == 0).select(
        "user_id", F.lit("availability").alias("priority"), F.lit("CHAdeMO").alias("connector_pref"),
        F.lit(10.0).alias("max_detour_km"))


def alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert input stream: one station reading per session, in event time.

    predicted wait = the session's wait; utilisation from the session's free
    ports against the station's ports; status / name from the station.
    """
    st = stations(spark, sf_dir).select("station_id", "name", "num_ports", "status")
    s = sessions(spark, sf_dir).select("session_id", "station_id", "session_start", "available_ports",
                                      "wait_time_minutes")
    j = s.join(st, "station_id")
    avail = F.least(F.col("available_ports"), F.col("num_ports"))
    return j.select(
        "session_id", "station_id", "name", "status", F.col("session_start").alias("event_time"),
        F.col("wait_time_minutes").alias("predicted_wait_min"),
        F.round((F.col("num_ports") - avail) / F.col("num_ports") * 100.0, 1).alias("utilization_pct"))
