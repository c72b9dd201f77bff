"""Registered queries: queueing (A-28, A-29, Q-G..Q-J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiloqueue.operators import queueing as qm
from kiloqueue.plans.oracle_base import erlang_c_sql, queue_wait_sql, rnd
from kiloqueue.plans.registry import register
from kiloqueue.sources import adapter as ad

# --- oracle fragments ---------------------------------------------------------

_RATES_CTE = """
lam AS (
  SELECT station_id, count(*) AS n,
    (epoch_us(max(session_start)) - epoch_us(min(session_start))) / 3.6e9 AS span_h
  FROM sessions GROUP BY station_id),
mu AS (
  SELECT station_id, median(session_duration_min) AS med FROM sessions GROUP BY station_id),
rates AS (
  SELECT s.station_id, s.name, s.num_ports, s.queue_size,
    CASE WHEN lam.n IS NULL OR lam.n < 10 THEN 8e0
      ELSE round(greatest(0.1e0, lam.n / greatest(1e0, lam.span_h)), 3) END AS arrival_rate,
    CASE WHEN mu.med > 0 THEN round(60e0 / mu.med, 4) ELSE 3e0 END AS service_rate
  FROM stations s LEFT JOIN lam USING (station_id) LEFT JOIN mu USING (station_id))
"""


def _queue_select(c: str, lam: str, mu: str, queue: str, name: str, cq: str) -> str:
    rho = f"(({lam})/(({c})*({mu})))"
    wait = queue_wait_sql(c, lam, mu, queue)
    return f"""
  station_id, {name} AS station_name, {c} AS num_ports, {lam} AS arrival_rate,
  {mu} AS service_rate, {rnd(rho, 4)} AS rho, {rnd(erlang_c_sql(c, lam, mu), 4)} AS erlang_c,
  {wait} AS avg_wait_min,
  CASE WHEN {rho} < 1 THEN {rnd(f"({lam}) * {wait} / 60e0", 3)} END AS avg_queue_length,
  {rnd(f"{wait} + 60e0/({mu})", 2)} AS avg_system_time_min,
  {rnd(f"least({lam}, ({c})*({mu}))", 2)} AS throughput_per_hr,
  {rho} < 1 AS system_stable, cast({cq} AS int) AS current_queue,
  {rnd(f"{rho}*100e0", 1)} AS utilization_pct"""


_G = "greatest(1, num_ports)", "greatest(0.01e0, arrival_rate)", "greatest(0.01e0, service_rate)"


@register("q_g_network_queue", sql=f"""
SELECT {_queue_select(*_G, '0', 'name', '0')}
FROM rates""", ctes=_RATES_CTE)
def q_g_network_queue(spark, sf_dir):
    return qm.analyze_network(ad.stations(spark, sf_dir), ad.sessions(spark, sf_dir),
                              unstable_wait=None)


@register("a_28_arrival_rate", sql="""
SELECT station_id, count(*) AS n_sessions,
  CASE WHEN count(*) < 10 THEN 8e0 ELSE round(greatest(0.1e0, count(*) /
    greatest(1e0, (epoch_us(max(session_start)) - epoch_us(min(session_start))) / 3.6e9)), 3) END
    AS arrival_rate
FROM sessions GROUP BY station_id""")
def a_28_arrival_rate(spark, sf_dir):
    return qm.arrival_rates(ad.sessions(spark, sf_dir))


@register("a_28_arrival_rate_by_hour_dow", sql="""
SELECT station_id, cast(hour(session_start) AS int) AS hour_of_day, isodow(session_start) - 1 AS day_of_week,
  count(*) AS n_sessions,
  CASE WHEN count(*) < 10 THEN 8e0 ELSE round(greatest(0.1e0, count(*) /
    greatest(1e0, (epoch_us(max(session_start)) - epoch_us(min(session_start))) / 3.6e9)), 3) END
    AS arrival_rate
FROM sessions GROUP BY ALL""")
def a_28_arrival_rate_by_hour_dow(spark, sf_dir):
    s = ad.sessions(spark, sf_dir).select(
        "*", F.hour("session_start").alias("hour_of_day"), F.weekday("session_start").alias("day_of_week"))
    return qm.arrival_rates(s, keys=("station_id", "hour_of_day", "day_of_week"))


@register("a_29_service_rate", sql="""
SELECT station_id, round(60e0 / median(session_duration_min), 4) AS service_rate
FROM sessions GROUP BY station_id HAVING median(session_duration_min) > 0""")
def a_29_service_rate(spark, sf_dir):
    return qm.service_rates(ad.sessions(spark, sf_dir))


@register("a_29_service_rate_all", sql="""
SELECT CASE WHEN median(session_duration_min) > 0
  THEN round(60e0 / median(session_duration_min), 4) ELSE 3e0 END AS service_rate FROM sessions""")
def a_29_service_rate_all(spark, sf_dir):
    return qm.global_service_rate(ad.sessions(spark, sf_dir))


@register("q_g_network_queue_hour18", sql=f"""
SELECT {_queue_select(*_G, '0', 'name', '0')}
FROM rates""", ctes=_RATES_CTE.replace(
    "FROM sessions GROUP BY station_id),\nmu",
    "FROM sessions WHERE cast(hour(session_start) AS int) = 18 GROUP BY station_id),\nmu"))
def q_g_network_queue_hour18(spark, sf_dir):
    s = ad.sessions(spark, sf_dir).withColumn("hour_of_day", F.hour("session_start"))
    return qm.analyze_network(ad.stations(spark, sf_dir), s, hour_of_day=18, unstable_wait=None)


@register("q_j_queue_snapshot_unstable", sql=f"""
SELECT {_queue_select('greatest(1, num_ports)', 'greatest(0.01e0, 4e0*(queue_size+1))', '3e0',
                      'queue_size', 'name', 'queue_size')}
FROM stations""")
def q_j_queue_snapshot_unstable(spark, sf_dir):
    return qm.queue_snapshot(ad.stations(spark, sf_dir), load_factor=4.0, unstable_wait=None)


@register("q_j_queue_snapshot", sql=f"""
SELECT {_queue_select('greatest(1, num_ports)', 'greatest(0.5e0, queue_size + 1e0)', '3e0',
                      'queue_size', 'name', 'queue_size')}
FROM stations""")
def q_j_queue_snapshot(spark, sf_dir):
    return qm.queue_snapshot(ad.stations(spark, sf_dir), unstable_wait=None)


@register("q_h_capacity_plan", sql=f"""
SELECT r.station_id,
  coalesce(struct_extract(z.best, 'ports'), 20) AS recommended_ports,
  struct_extract(z.best, 'w') AS predicted_wait_min,
  coalesce(struct_extract(z.best, 'u'), 100e0) AS utilization_pct,
  struct_extract(z.best, 'ec') AS erlang_c,
  CASE WHEN z.best IS NULL THEN 'Cannot achieve 15.0 min wait with <=20 ports' END AS note
FROM rates r LEFT JOIN (
  SELECT station_id, arg_min(struct_pack(ports := c, w := w, u := u, ec := ec), c) AS best
  FROM (
    SELECT station_id, c, {queue_wait_sql('c', 'lam', 'mu')} AS w,
      lam/(c*mu)*100e0 AS u, round({erlang_c_sql('c', 'lam', 'mu')}, 4) AS ec
    FROM (SELECT station_id, cast(g.c AS int) AS c, greatest(0.01e0, arrival_rate) AS lam,
            greatest(0.01e0, service_rate) AS mu
          FROM rates, range(1, 21) g(c)) x) y
  WHERE w IS NOT NULL AND w <= 15e0 GROUP BY station_id) z ON r.station_id = z.station_id
""", ctes=_RATES_CTE)
def q_h_capacity_plan(spark, sf_dir):
    rates = qm.station_rates(ad.stations(spark, sf_dir), ad.sessions(spark, sf_dir))
    out = qm.recommend_capacity(rates, target_wait_min=15.0, max_ports=20)
    # infinite wait for infeasible rows is reported as NULL in the parity form (H-12).
    return out.withColumn("predicted_wait_min",
                          F.when(F.col("note").isNull(), F.col("predicted_wait_min")))


@register("q_i_sensitivity", sql=f"""
SELECT station_id, step, round(lam, 3) AS arrival_rate, lam/(c*mu) AS rho,
  {queue_wait_sql('c', 'lam', 'mu')} AS avg_wait_min,
  CASE WHEN lam/(c*mu) < 1 THEN round(lam * {queue_wait_sql('c', 'lam', 'mu')} / 60e0, 3) END
    AS avg_queue_length,
  lam/(c*mu) < 1 AS system_stable
FROM (
  SELECT station_id, c, mu, cast(g.i AS int) AS step,
    greatest(0.01e0, 0.5e0 + (c*mu*0.99e0 - 0.5e0) * g.i / 19e0) AS lam
  FROM (SELECT station_id, greatest(1, num_ports) AS c, greatest(0.01e0, service_rate) AS mu FROM rates) r,
    range(0, 20) g(i)) x
""", ctes=_RATES_CTE)
def q_i_sensitivity(spark, sf_dir):
    rates = qm.station_rates(ad.stations(spark, sf_dir), ad.sessions(spark, sf_dir))
    return qm.sensitivity(rates, steps=20)


# --- bench scale: sessions from lineitem (600k rows at sf0.1) ------------------------

@register("q_g_network_queue_big", sql=f"""
SELECT {_queue_select(*_G, '0', 'name', '0')}
FROM rates""", ctes=_RATES_CTE.replace("FROM sessions", "FROM sessions_big"))
def q_g_network_queue_big(spark, sf_dir):
    return qm.analyze_network(ad.stations(spark, sf_dir), ad.sessions_big(spark, sf_dir),
                              unstable_wait=None, sort=False)
