"""Queueing operators: rate estimation (A-28, A-29) and M/M/c tables (Q-G..Q-J).

The reference loops over stations and re-scans the session table for each one
(a correlated scan).  Here the session table is aggregated once per station
(partial + final hash aggregate, one shuffle on ``station_id``) and joined to
the station table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiloqueue.functions.queueing import (
    DEFAULT_ARRIVAL_RATE, DEFAULT_SERVICE_RATE, queue_metrics,
)
from kiloqueue.functions.ranked import quantiles

QUEUE_COLUMNS = [
    "station_id", "station_name", "num_ports", "arrival_rate", "service_rate", "rho",
    "erlang_c", "avg_wait_min", "avg_queue_length", "avg_system_time_min",
    "throughput_per_hr", "system_stable", "current_queue", "utilization_pct",
]


def arrival_rates(sessions: DataFrame, keys=("station_id",), hour_of_day: int | None = None,
                  day_of_week: int | None = None, min_sessions: int = 10,
                  default_rate: float = DEFAULT_ARRIVAL_RATE) -> DataFrame:
    """A-28: lambda = n / max(1, hours from first to last start), >= .1, round 3.

    Groups with fewer than ``min_sessions`` rows get ``default_rate``; groups
    with no rows at all are absent (callers left-join and default them).
    Without ``session_start`` the divisor is n (so lambda = 1).
    """
    df = sessions
    if hour_of_day is not None and "hour_of_day" in df.columns:
        df = df.where(F.col("hour_of_day") == hour_of_day)
    if day_of_week is not None and "day_of_week" in df.columns:
        df = df.where(F.col("day_of_week") == day_of_week)
    n = F.count(F.lit(1))
    if "session_start" in df.columns:
        span_h = (F.unix_micros(F.max("session_start")) - F.unix_micros(F.min("session_start"))) / 3.6e9
        rate = n / F.greatest(F.lit(1.0), span_h)
    else:
        rate = n / n
    return (
        df.groupBy(*keys)
        .agg(n.alias("n_sessions"), rate.alias("_rate"))
        .select(*keys, "n_sessions",
                F.when(F.col("n_sessions") < min_sessions, F.lit(default_rate))
                .otherwise(F.round(F.greatest(F.lit(0.1), F.col("_rate")), 3))
                .alias("arrival_rate"))
    )


def service_rates(sessions: DataFrame, keys=("station_id",),
                  duration_col: str = "session_duration_min") -> DataFrame:
    """A-29: mu = 60 / median duration, round 4 (groups without a positive median are absent).

    The exact medians come from range-partitioned value counts, whatever a group's size.
    """
    return (
        quantiles(sessions, [duration_col], [0.5], keys).select(*keys, F.col("q")[0].alias("_median"))
        .where(F.col("_median") > 0)
        .select(*keys, F.round(F.lit(60.0) / F.col("_median"), 4).alias("service_rate"))
    )


def global_service_rate(sessions: DataFrame, duration_col: str = "session_duration_min") -> DataFrame:
    """A-29 with station = None: one-row table over all sessions."""
    med = F.max("m")  # of one row, or none without sessions
    return quantiles(sessions, [duration_col], [0.5]).select(F.col("q")[0].alias("m")).agg(
        F.when(med > 0, F.round(F.lit(60.0) / med, 4)).otherwise(F.lit(DEFAULT_SERVICE_RATE))
        .alias("service_rate"))


def station_rates(stations: DataFrame, sessions: DataFrame | None, hour_of_day: int | None = None) -> DataFrame:
    """Per-station (lambda, mu) with the reference defaults for stations without data."""
    st = stations.select("station_id", "name", "num_ports")
    if sessions is None:
        return st.select("*", F.lit(DEFAULT_ARRIVAL_RATE).alias("arrival_rate"),
                         F.lit(DEFAULT_SERVICE_RATE).alias("service_rate"))
    ses = sessions.select(*[c for c in ("station_id", "session_start", "session_duration_min",
                                        "hour_of_day", "day_of_week") if c in sessions.columns])
    lam = arrival_rates(ses, hour_of_day=hour_of_day).select("station_id", "arrival_rate")
    mu = service_rates(ses)
    return (
        st.join(lam, "station_id", "left").join(mu, "station_id", "left")
        .select("station_id", "name", "num_ports",
                F.coalesce("arrival_rate", F.lit(DEFAULT_ARRIVAL_RATE)).alias("arrival_rate"),
                F.coalesce("service_rate", F.lit(DEFAULT_SERVICE_RATE)).alias("service_rate"))
    )


def queue_table(df: DataFrame, ports="num_ports", arrival="arrival_rate", service="service_rate",
                current_queue=None, name="name", unstable_wait=float("inf")) -> DataFrame:
    """Q-A..Q-F over any table with ports and rates: the reference's to_dict record."""
    m = queue_metrics(F.col(ports), F.col(arrival), F.col(service) if service else None,
                      F.col(current_queue) if current_queue else 0, unstable_wait)
    cq = F.col(current_queue).cast("int") if current_queue else F.lit(0)
    nm = F.coalesce(F.col(name).cast("string"), F.concat(F.lit("Station "), F.col("station_id").cast("string"))) \
        if name in df.columns else F.concat(F.lit("Station "), F.col("station_id").cast("string"))
    return df.select(
        "station_id", nm.alias("station_name"),
        m["num_ports"].alias("num_ports"), m["arrival_rate"].alias("arrival_rate"),
        m["service_rate"].alias("service_rate"), m["rho"].alias("rho"),
        m["erlang_c"].alias("erlang_c"), m["avg_wait_min"].alias("avg_wait_min"),
        m["avg_queue_length"].alias("avg_queue_length"),
        m["avg_system_time_min"].alias("avg_system_time_min"),
        m["throughput_per_hr"].alias("throughput_per_hr"),
        m["system_stable"].alias("system_stable"), cq.alias("current_queue"),
        m["utilization_pct"].alias("utilization_pct"),
    )


def analyze_network(stations: DataFrame, sessions: DataFrame | None = None,
                    hour_of_day: int | None = None, unstable_wait=float("inf"),
                    sort: bool = True) -> DataFrame:
    """Q-G: rates per station -> M/M/c metrics -> sorted by average wait (O-04)."""
    rates = station_rates(stations, sessions, hour_of_day)
    out = queue_table(rates, unstable_wait=unstable_wait)
    return out.orderBy(F.col("avg_wait_min").asc_nulls_last(), "station_id") if sort else out


def recommend_capacity(rates: DataFrame, target_wait_min: float = 15.0, max_ports: int = 20,
                       keys=("station_id",)) -> DataFrame:
    """Q-H: smallest c <= max_ports that is stable with wait <= target.

    Each (lambda, mu) row is exploded to ``max_ports`` candidates (a bounded
    generator, J-10); ``min_by`` picks the smallest feasible c per key.  Rows
    without a feasible c report max_ports, infinite wait, 100 % and a note.
    """
    cand = rates.select(*keys, "arrival_rate", "service_rate",
                        F.explode(F.sequence(F.lit(1), F.lit(max_ports))).alias("ports"))
    m = queue_metrics(F.col("ports"), F.col("arrival_rate"), F.col("service_rate"))
    feas = (
        cand.select(*keys, "ports", m["system_stable"].alias("ok"), m["avg_wait_min"].alias("w"),
                    (m["_rho_raw"] * 100.0).alias("u"), m["erlang_c"].alias("ec"))
        .where(F.col("ok") & (F.col("w") <= target_wait_min))
        .groupBy(*keys)
        .agg(F.min_by(F.struct("ports", "w", "u", "ec"), F.col("ports")).alias("best"))
    )
    note = F.lit(f"Cannot achieve {target_wait_min} min wait with <={max_ports} ports")
    return (
        rates.select(*keys).join(feas, list(keys), "left")
        .select(*keys,
                F.coalesce(F.col("best.ports"), F.lit(max_ports)).alias("recommended_ports"),
                F.coalesce(F.col("best.w"), F.lit(float("inf"))).alias("predicted_wait_min"),
                F.coalesce(F.col("best.u"), F.lit(100.0)).alias("utilization_pct"),
                F.col("best.ec").alias("erlang_c"),
                F.when(F.col("best").isNull(), note).alias("note"))
    )


def sensitivity(stations: DataFrame, steps: int = 20, top_fraction: float = 0.99,
                low: float = 0.5, ports="num_ports", service="service_rate") -> DataFrame:
    """Q-I: lambda from ``low`` to ``top_fraction * c * mu`` in ``steps`` evenly spaced values.

    Unstable points keep ``rho`` and report null wait / queue length.
    """
    c = F.greatest(F.lit(1), F.col(ports).cast("int"))
    mu = F.col(service) if service in stations.columns else F.lit(DEFAULT_SERVICE_RATE)
    hi = c * mu * top_fraction
    grid = stations.select(
        "station_id", c.alias("_c"), mu.alias("_mu"),
        F.posexplode(F.transform(
            F.sequence(F.lit(0), F.lit(steps - 1)),
            lambda i: F.lit(low) + (hi - F.lit(low)) * i / F.lit(float(max(steps - 1, 1))),
        )).alias("step", "_lam"))
    m = queue_metrics(F.col("_c"), F.col("_lam"), F.col("_mu"), 0, None)
    return grid.select(
        "station_id", "step",
        F.round(F.col("_lam"), 3).alias("arrival_rate"),
        m["_rho_raw"].alias("rho"),
        m["avg_wait_min"].alias("avg_wait_min"),
        m["avg_queue_length"].alias("avg_queue_length"),
        m["system_stable"].alias("system_stable"),
    )


def queue_snapshot(stations: DataFrame, arrival_rate=None, service_rate: float = DEFAULT_SERVICE_RATE,
                   load_factor: float | None = None, unstable_wait=float("inf")) -> DataFrame:
    """Q-J: queue endpoint for every station with its current queue.

    ``arrival_rate`` is a literal / column; with ``load_factor`` set, lambda is
    ``load_factor * (queue_size + 1)`` (client variant uses max(.5, queue+1)).
    """
    if load_factor is not None:
        lam = F.lit(load_factor) * (F.col("queue_size") + 1)
    elif arrival_rate is None:
        lam = F.greatest(F.lit(0.5), (F.col("queue_size") + 1).cast("double"))
    else:
        lam = arrival_rate if not isinstance(arrival_rate, (int, float)) else F.lit(float(arrival_rate))
    df = stations.select("station_id", "name", "num_ports", "queue_size",
                         lam.alias("arrival_rate"), F.lit(service_rate).alias("service_rate"))
    return queue_table(df, current_queue="queue_size", unstable_wait=unstable_wait)
