import math

from pyspark.sql import functions as F

from kiloqueue.functions.queueing import queue_metrics
from kiloqueue.operators import queueing as qm


def _row(spark, c, lam, mu, q=0):
    m = queue_metrics(F.lit(c), F.lit(lam), F.lit(mu), q)
    return spark.range(1).select(*[v.alias(k) for k, v in m.items()]).first()


def test_rho_unstable_at_one(spark):
    r = _row(spark, 4, 8.0, 2.0)
    assert r["rho"] == 1.0 and r["system_stable"] is False and math.isinf(r["avg_wait_min"])


def test_stable_load_and_erlang_c(spark):
    r = _row(spark, 4, 8.0, 3.5)
    assert r["system_stable"] and 0 < r["_rho_raw"] < 1
    assert abs(r["erlang_c"] - 0.2517) < 1e-4


def test_erlang_c_matches_factorial_form(spark):
    for c, lam, mu in [(1, 0.5, 1.0), (4, 8.0, 3.5), (20, 50.0, 3.0), (100, 250.0, 3.0)]:
        a, rho = lam / mu, lam / (c * mu)
        top = a ** c / math.factorial(c) / (1 - rho)
        exact = top / (sum(a ** n / math.factorial(n) for n in range(c)) + top)
        r = spark.range(1).select(queue_metrics(F.lit(c), F.lit(lam), F.lit(mu))["erlang_c"].alias("e")).first()
        assert abs(r["e"] - round(exact, 4)) < 1e-9


def test_unstable_case(spark):
    assert _row(spark, 2, 20.0, 3.0)["system_stable"] is False


def test_littles_law_and_more_ports_less_wait(spark):
    waits = [_row(spark, c, 8.0, 3.0)["avg_wait_min"] for c in (3, 4, 6, 10)]
    assert all(a >= b for a, b in zip(waits, waits[1:]))
    r = _row(spark, 4, 8.0, 3.0)
    assert abs(r["avg_queue_length"] - round(8.0 * r["avg_wait_min"] / 60, 3)) < 1e-9


def test_capacity_meets_target(spark):
    rates = spark.createDataFrame([(1, 5.0, 3.0), (2, 500.0, 3.0)], "station_id long, arrival_rate double, service_rate double")
    out = {r.station_id: r for r in qm.recommend_capacity(rates, 20.0, 20).collect()}
    assert out[1].predicted_wait_min <= 20 and out[1].note is None
    assert out[2].recommended_ports == 20 and math.isinf(out[2].predicted_wait_min) and out[2].note


def test_sensitivity_rises(spark):
    st = spark.createDataFrame([(1, 4, 3.0)], "station_id long, num_ports int, service_rate double")
    rows = sorted(qm.sensitivity(st, 20).collect(), key=lambda r: r.step)
    waits = [r.avg_wait_min for r in rows if r.avg_wait_min is not None]
    assert len(rows) == 20 and waits == sorted(waits) and all(r.system_stable for r in rows)


def test_network_rows_equal_stations(spark):
    from tests.conftest import SF
    from kiloqueue.sources import adapter as ad

    st = ad.stations(spark, SF)
    out = qm.analyze_network(st, ad.sessions(spark, SF))
    assert out.count() == st.count()
