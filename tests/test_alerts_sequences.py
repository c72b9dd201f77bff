import datetime as dt

from pyspark.sql import functions as F

from kiloqueue.operators import alerts as al
from kiloqueue.operators import timeseries as ts


def test_alert_rules(spark):
    st = spark.createDataFrame([(1, "A", "Operational", 50.0, 92.0), (2, "B", "Offline", 0.0, 0.0)],
                               "station_id long, name string, status string, predicted_wait_min double, utilization_pct double")
    got = sorted((r.station_id, r.alert_type, r.severity) for r in al.evaluate_network(st).collect())
    assert got == [(1, "HIGH_UTILIZATION", "WARNING"), (1, "HIGH_WAIT_TIME", "WARNING"),
                   (2, "STATION_OFFLINE", "CRITICAL")]


def test_severity_critical(spark):
    st = spark.createDataFrame([(1, "A", "Operational", 55.0, 0.0)],
                               "station_id long, name string, status string, predicted_wait_min double, utilization_pct double")
    r = al.evaluate_network(st, wait_threshold=20).first()
    assert r.severity == "CRITICAL"


def test_cooldown(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, "HIGH_WAIT_TIME", base + dt.timedelta(seconds=s)) for s in (0, 100, 599, 600, 700, 1201)]
    df = spark.createDataFrame(rows, "station_id long, alert_type string, event_time timestamp")
    kept = sorted((r.event_time - base).total_seconds() for r in al.apply_cooldown(df, cooldown_s=600).collect())
    assert kept == [0, 600, 1201]
    arr = spark.range(1).select(al.cooldown_fold(F.array(*[F.lit(float(s)) for s in (0, 100, 599, 600, 700, 1201)]),
                                                 600).alias("k")).first().k
    assert arr == [0.0, 600.0, 1201.0]


def test_sequences(spark):
    n, L = 40, 24
    df = spark.createDataFrame([(1, i, float(i), float(i * 2)) for i in range(n)],
                               "station_id long, session_id long, f double, y double")
    df = df.withColumn("session_start", F.timestamp_seconds("session_id"))
    out = sorted(ts.sequence_windows(df, ["f"], "y", L).collect(), key=lambda r: r.session_id)
    assert len(out) == n - L and out[0].y == 2.0 * L and out[0].X[0] == [0.0] and len(out[0].X) == L
