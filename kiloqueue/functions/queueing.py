"""M/M/c queue formulas (Q-A..Q-F) as column expressions.

Erlang C is computed through the Erlang-B recursion
``B(0)=1, B(n) = a*B(n-1) / (n + a*B(n-1))`` folded with ``F.aggregate`` over
``sequence(1, c)``, then ``C = B / (1 - rho*(1 - B))``.  This equals the
factorial form and does not overflow for large c.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the queue model: default rates per hour.
DEFAULT_SERVICE_RATE = 3.0
DEFAULT_ARRIVAL_RATE = 8.0
MIN_RATE = 0.01


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def guard_inputs(ports, arrival_rate, service_rate=None) -> tuple[Column, Column, Column]:
    """Q-A: ports >= 1, lambda >= .01, mu = given (or 3.0 when null/0) and >= .01."""
    c = F.greatest(F.lit(1), _c(ports).cast("int"))
    lam = F.greatest(F.lit(MIN_RATE), _c(arrival_rate).cast("double"))
    mu_in = F.lit(None).cast("double") if service_rate is None else _c(service_rate).cast("double")
    mu = F.greatest(F.lit(MIN_RATE), F.coalesce(F.nullif(mu_in, F.lit(0.0)), F.lit(DEFAULT_SERVICE_RATE)))
    return c, lam, mu


def rho(c: Column, lam: Column, mu: Column) -> Column:
    """Q-B: utilisation lambda / (c mu)."""
    return lam / (c * mu)


def erlang_b(c: Column, offered_load: Column) -> Column:
    return F.aggregate(
        F.sequence(F.lit(1), c), F.lit(1.0),
        lambda b, n: offered_load * b / (n + offered_load * b),
    )


def erlang_c(c: Column, lam: Column, mu: Column) -> Column:
    """Q-C: probability of waiting; 1.0 when the queue is unstable."""
    r = rho(c, lam, mu)
    b = erlang_b(c, lam / mu)
    return F.when(r < 1.0, b / (F.lit(1.0) - r * (F.lit(1.0) - b))).otherwise(F.lit(1.0))


def queue_metrics(ports, arrival_rate, service_rate=None, current_queue=0,
                  unstable_wait=float("inf")) -> dict[str, Column]:
    """Q-A..Q-F: every derived queue column, rounded like the reference record.

    ``unstable_wait`` is what wait / queue length report for rho >= 1
    (infinity by default; parity queries pass ``None``).
    """
    c, lam, mu = guard_inputs(ports, arrival_rate, service_rate)
    q = F.coalesce(_c(current_queue).cast("double"), F.lit(0.0))
    r = rho(c, lam, mu)
    stable = r < 1.0
    ec = erlang_c(c, lam, mu)
    erlang_min = F.try_divide(ec, c * mu - lam) * 60.0
    observed_min = q * (F.lit(60.0) / mu) / c
    wait = F.round(F.greatest(F.lit(0.0), 0.5 * erlang_min + 0.5 * observed_min), 2)
    bad = F.lit(unstable_wait).cast("double")
    wait = F.when(stable, wait).otherwise(bad)
    lq = F.when(stable, F.round(lam * wait / 60.0, 3)).otherwise(bad)
    system_time = wait + F.lit(60.0) / mu
    return {
        "num_ports": c,
        "arrival_rate": lam,
        "service_rate": mu,
        "rho": F.round(r, 4),
        "erlang_c": F.round(ec, 4),
        "avg_wait_min": wait,
        "avg_queue_length": lq,
        "avg_system_time_min": F.round(system_time, 2),
        "avg_vehicles_in_system": lam * system_time / 60.0,
        "throughput_per_hr": F.round(F.least(lam, c * mu), 2),
        "system_stable": stable,
        "utilization_pct": F.round(r * 100.0, 1),
        "_rho_raw": r,
    }
