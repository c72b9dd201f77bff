"""DuckDB text of the input adapter, embedded as CTEs in every oracle query.

These are independent re-statements of ``kiloqueue.sources.adapter`` in
DuckDB's dialect (``json_extract_string`` instead of ``get_json_object``,
``to_minutes`` instead of ``timestampadd``).  ``with_ctes(body)`` prepends the
CTEs that the body refers to, in dependency order.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {
    "stations": """
  SELECT cast(s_suppkey AS bigint) AS station_id, s_name AS name,
    37.7749e0 + cast((s_suppkey*37)%121 - 60 AS double)/1e3 AS lat,
    -122.4194e0 + cast((s_suppkey*53)%201 - 100 AS double)/1e3 AS lng,
    cast(2 + (s_suppkey*7)%12 AS int) AS num_ports,
    cast((s_suppkey*11)%(3 + (s_suppkey*7)%12) AS int) AS available_ports,
    cast((s_suppkey*5)%7 AS int) AS queue_size,
    CASE s_suppkey%4 WHEN 0 THEN 7.2e0 WHEN 1 THEN 50e0 WHEN 2 THEN 150e0 ELSE 350e0 END AS power_kw,
    CASE s_suppkey%5 WHEN 0 THEN 'Type 2' WHEN 1 THEN 'CCS' WHEN 2 THEN 'CHAdeMO'
      WHEN 3 THEN 'Tesla' ELSE 'J1772' END AS connector_type,
    CASE WHEN s_acctbal < 0 THEN 'Offline' WHEN s_acctbal < 1000 THEN 'Partial'
      ELSE 'Operational' END AS status,
    n_name AS operator,
    cast((s_suppkey*29)%100 AS double)/1e2 AS traffic_score
  FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "sessions": """
  SELECT event_id AS session_id,
    user_id % (SELECT count(*) FROM supplier) AS station_id,
    cast(ts AS timestamp) AS session_start,
    least(120e0, 5e0 + value) AS session_duration_min,
    1e0 + value*0.4e0 AS energy_kwh,
    cast(k % 8 AS int) AS queue_size,
    cast(floor(k/8e0) AS int) % 8 AS available_ports,
    cast((event_id*37)%100 AS double)/1e2 AS traffic_score,
    cast((event_id*13)%50 - 8 AS double) AS temperature_c,
    CASE WHEN event_id%5 = 0 THEN 0.5e0 ELSE 0e0 END AS precipitation_mm,
    CASE event_type WHEN 'click' THEN 'CCS' WHEN 'view' THEN 'Type 2'
      WHEN 'purchase' THEN 'CHAdeMO' WHEN 'signup' THEN 'Tesla' ELSE NULL END AS connector_type,
    greatest(0e0, least(90e0, (k%8)*11.5e0 + cast((event_id*37)%100 AS double)/1e1
      - (cast(floor(k/8e0) AS int)%8)*3e0)) AS wait_time_minutes
  FROM (SELECT *, cast(json_extract_string(props, '$.k') AS int) AS k FROM events) ev""",
    "sessions_big": """
  SELECT l_orderkey*8 + l_linenumber AS session_id, l_orderkey, l_linenumber, l_partkey,
    l_suppkey AS station_id,
    l_shipdate + to_minutes(cast((l_orderkey*7 + l_linenumber*131)%1440 AS int)) AS session_start,
    5e0 + l_quantity*2e0 AS session_duration_min, l_quantity AS energy_kwh,
    cast(l_partkey%8 AS int) AS queue_size,
    cast((l_orderkey + l_linenumber)%8 AS int) AS available_ports,
    l_discount*1e1 AS traffic_score
  FROM lineitem""",
    "users": """
  SELECT c_custkey AS user_id,
    37.7749e0 + cast((c_custkey*37)%121 - 60 AS double)/1e3 AS user_lat,
    -122.4194e0 + cast((c_custkey*53)%201 - 100 AS double)/1e3 AS user_lng,
    CASE c_custkey%4 WHEN 0 THEN 'balanced' WHEN 1 THEN 'speed' WHEN 2 THEN 'distance'
      ELSE 'availability' END AS priority,
    CASE c_custkey%3 WHEN 1 THEN 'CCS' WHEN 2 THEN 'type 2' ELSE NULL END AS connector_pref,
    20e0 AS max_detour_km
  FROM customer""",
    "traffic": """
  SELECT station_id, avg(traffic_score) AS traffic_score
  FROM sessions WHERE station_id % 7 <> 3 GROUP BY station_id""",
    "raw_stations": """
  SELECT station_id, name,
    CASE WHEN station_id%17 = 0 THEN NULL WHEN station_id%17 = 1 THEN lat + 200e0 ELSE lat END AS lat,
    CASE WHEN station_id%17 = 2 THEN -200e0 ELSE lng END AS lng,
    CASE WHEN station_id%19 = 0 THEN NULL ELSE num_ports END AS num_ports,
    available_ports, queue_size,
    CASE WHEN station_id%23 = 0 THEN NULL ELSE power_kw END AS power_kw,
    CASE WHEN station_id%11 = 0 THEN 'Mennekes' WHEN station_id%11 = 1 THEN 'CCS (Type 1)'
      WHEN station_id%11 = 2 THEN NULL ELSE connector_type END AS connector_type,
    CASE WHEN station_id%13 = 0 THEN NULL WHEN station_id%29 = 0 THEN 'Not Operational'
      WHEN station_id%31 = 0 THEN 'available' ELSE status END AS status,
    operator, traffic_score
  FROM stations""",
    "routes": """
  SELECT cast(n_nationkey AS bigint) AS route_id, cast(i AS int) AS wp_idx,
    37.7749e0 + cast((n_nationkey*17 + i*23)%121 - 60 AS double)/1e3 AS wp_lat,
    -122.4194e0 + cast((n_nationkey*31 + i*41)%201 - 100 AS double)/1e3 AS wp_lng
  FROM nation, range(0, 3) t(i)""",
    # queue wait with lambda = max(.1, queue+1), mu = 3, current queue; clipped to [0, 120]
    "predictions": """
  SELECT station_id, cast(sq AS int) AS seq,
    CASE WHEN sq = 1 THEN w ELSE least(120e0, w*1.5e0 + 10e0) END AS predicted_wait_min, u AS utilization_pct
  FROM (
    SELECT station_id, least(greatest(coalesce(QWAIT, 'inf'::double), 0e0), 120e0) AS w,
      RHOPCT AS u
    FROM stations) p, range(1, 3) t(sq)
  WHERE sq = 1 OR station_id % 3 = 0""",
    "saved_prefs": """
  SELECT user_id, 'availability' AS priority, 'CHAdeMO' AS connector_pref, 10e0 AS max_detour_km
  FROM users WHERE user_id % 5 = 0""",
    "alert_events": """
  SELECT s.session_id, s.station_id, st.name, st.status, s.session_start AS event_time,
    s.wait_time_minutes AS predicted_wait_min,
    round((st.num_ports - least(s.available_ports, st.num_ports)) / st.num_ports * 100e0, 1) AS utilization_pct
  FROM sessions s JOIN stations st USING (station_id)""",
}

# Which CTE reads which other CTE (for ordering).
DEPS = {"traffic": ["sessions"], "raw_stations": ["stations"], "predictions": ["stations"],
        "saved_prefs": ["users"], "alert_events": ["stations", "sessions"]}
ORDER = ["stations", "sessions", "sessions_big", "users", "traffic", "raw_stations", "routes",
         "predictions", "saved_prefs", "alert_events"]


def _refs(text: str) -> set[str]:
    return {n for n in CTES if re.search(rf"\b{n}\b", text)}


def with_ctes(body: str, extra: str = "") -> str:
    """Prefix ``body`` with the adapter CTEs it uses (and their dependencies).

    ``extra`` holds further ``name AS (...)`` definitions appended after them.
    """
    need = _refs(body) | _refs(extra)
    changed = True
    while changed:
        changed = False
        for n in list(need):
            for d in DEPS.get(n, []):
                if d not in need:
                    need.add(d)
                    changed = True
    parts = [f"{n} AS ({CTES[n]}\n)" for n in ORDER if n in need]
    if extra.strip():
        parts.append(extra.strip())
    stripped = body.lstrip()
    if stripped[:15].upper() == "WITH RECURSIVE ":
        parts.append(stripped[15:])
        return "WITH RECURSIVE " + ",\n".join(parts)
    if stripped[:5].upper() == "WITH ":
        # the body has its own CTE list: merge it after ours
        parts.append(stripped[5:])
        return "WITH " + ",\n".join(parts)
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body


# --- shared SQL expression builders (oracle side) ----------------------------

def erlang_c_sql(c: str, lam: str, mu: str) -> str:
    """Erlang C by the factorial sum, written with lgamma (independent of the
    Erlang-B fold used on the Spark side)."""
    a = f"(({lam})/({mu}))"
    rho = f"(({lam})/(({c})*({mu})))"
    top = f"(exp(({c})*ln({a}) - lgamma(({c})+1)) / (1e0 - {rho}))"
    poisson = f"list_sum(list_transform(range(0, ({c})), lambda n: exp(n*ln({a}) - lgamma(n+1))))"
    return f"(CASE WHEN {rho} < 1 THEN {top} / ({poisson} + {top}) ELSE 1e0 END)"


def queue_wait_sql(c: str, lam: str, mu: str, queue: str = "0") -> str:
    """Blended wait (Q-D), NULL when unstable."""
    rho = f"(({lam})/(({c})*({mu})))"
    ec = erlang_c_sql(c, lam, mu)
    inner = (f"greatest(0e0, 0.5e0*({ec}/(({c})*({mu}) - ({lam}))*60e0)"
             f" + 0.5e0*(({queue})*(60e0/({mu}))/({c})))")
    return f"(CASE WHEN {rho} < 1 THEN {rnd(inner, 2)} ELSE NULL END)"


def rnd(x: str, d: int) -> str:
    """HALF_UP rounding of the shortest decimal form of a double, as Spark's
    ``round`` does (DuckDB's own ``round`` works on the binary value)."""
    return f"cast(round(cast(cast(({x}) AS varchar) AS decimal(38,18)), {d}) AS double)"


def avg_9(x: str, over: str = "") -> str:
    """Mean rounded to nine decimals."""
    return f"round(avg({x}) {over}, 9)"


def haversine_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    """atan2 form of the great-circle distance (Spark side uses asin)."""
    a = (f"(pow(sin(radians(({lat2})-({lat1}))/2), 2) + cos(radians({lat1}))*cos(radians({lat2}))"
         f"*pow(sin(radians(({lng2})-({lng1}))/2), 2))")
    return f"(6371e0*2*atan2(sqrt({a}), sqrt(1e0 - least(1e0, {a}))))"


def _fill_predictions() -> None:
    """The predictions CTE embeds the queue wait expression (rounded like Q-D, then M-14's 1 decimal)."""
    w = queue_wait_sql("greatest(1, num_ports)", "greatest(0.1e0, queue_size + 1e0)", "3e0", "queue_size")
    pct = rnd("greatest(0.1e0, queue_size + 1e0)/(greatest(1, num_ports)*3e0)*100e0", 1)
    CTES["predictions"] = CTES["predictions"].replace(
        "QWAIT", f"(CASE WHEN {w} IS NULL THEN NULL ELSE greatest(0e0, {rnd(w, 1)}) END)").replace("RHOPCT", pct)


_fill_predictions()
