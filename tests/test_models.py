"""Forests as arrays and in parts, lag orders, cooldown over ranges and in ties."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiloqueue.operators import alerts as al
from kiloqueue.operators import forest, ml
from kiloqueue.operators import timeseries as ts
from kiloqueue.operators.features import add_temporal_features
from kiloqueue.sources import adapter as ad
from tests.conftest import SF

FEATURES = ["hour_of_day", "traffic_score", "queue_size", "available_ports", "temperature_c"]


@pytest.fixture(scope="module")
def parts(spark):
    df = add_temporal_features(ad.sessions(spark, SF)).withColumn("temperature_c", F.lit(None).cast("double"))
    return df, ml.train_forest(df, FEATURES, group=25, numTrees=60)


@pytest.mark.parametrize("limit", [forest.MAX_BYTES, 20_000])
def test_flat_trees_equal_mllib(spark, parts, monkeypatch, limit):
    df, models = parts
    monkeypatch.setattr(forest, "MAX_BYTES", limit)
    assert [m.stages[-1].getNumTrees for m in models] == [25, 25, 10]
    if limit < 1 << 20:
        assert len(forest.flatten(spark, [models[0].stages[-1]])) > 1
    got = ml.predict_with_uncertainty(models, df.select("session_id", *FEATURES), FEATURES).toPandas().set_index("session_id")
    each = []
    for m in models:
        x = m.stages[0].transform(ml.prepare(df.select("session_id", *FEATURES), FEATURES, None))
        for tree in m.stages[-1].trees:
            each.append(tree.copy().setPredictionCol("t").transform(x).select("session_id", "t").toPandas().set_index("session_id")["t"].reindex(got.index).to_numpy())
    each = np.stack(each)
    assert len(each) == 60
    assert np.abs(got["mean"] - each.mean(0)).max() < 1e-9 and np.abs(got["std"] - each.std(0)).max() < 1e-9
    assert (got["lower_95"] >= 0).all() and (got["upper_95"] >= got["mean"]).all()
    alone = ml.predict(models[0], df.select("session_id", *FEATURES), FEATURES).toPandas().set_index("session_id")["rf_prediction"].reindex(got.index)
    own = ml.predict_forest(models[:1], df.select("session_id", *FEATURES), FEATURES).toPandas().set_index("session_id")["rf_prediction"].reindex(got.index)
    assert np.abs(alone - own).max() < 1e-9


def test_importances_of_parts(spark, parts):
    df, models = parts
    imp = {r.feature: r.importance for r in ml.feature_importances(spark, models, FEATURES).collect()}
    assert sum(imp.values()) == pytest.approx(1) and imp["temperature_c"] == 0 and max(imp, key=imp.get) == "queue_size"


def least_squares(x, y):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = float(((y - x @ beta) ** 2).sum())
    return beta, rest


def plain_adf(v):
    """The lag order of least AIC on common rows, then the t statistic of the level on all rows of that order."""
    n, d = len(v), np.diff(v)
    top = ts.most_lags(n)

    def design(order, first):
        rows = range(first, len(d))
        return np.array([[1, v[t], *[d[t - k] for k in range(1, order + 1)]] for t in rows]), d[first:]

    aic = []
    for order in range(top + 1):
        x, y = design(order, top)
        aic.append((len(y) * math.log(least_squares(x, y)[1] / len(y)) + 2 * x.shape[1], order))
    order = min(aic)[1]
    x, y = design(order, order)
    beta, rest = least_squares(x, y)
    return order, beta[1] / math.sqrt(rest / (len(y) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])


def series(spark, seed):
    r = np.random.default_rng(seed)
    out = []
    for key, n in ((1, 60), (2, 300), (3, 25)):
        e = r.normal(0, 1, n + 3)
        v = np.zeros(n + 3)
        for t in range(3, n + 3):
            v[t] = (1.0 if key == 2 else 0.5) * v[t - 1] + 0.6 * (v[t - 2] - v[t - 3]) * (key != 3) + e[t]
        out.append((key, v[3:]))
    rows = [(k, i, float(x)) for k, v in out for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "station_id long, pos int, value double").repartition(5), dict(out)


def test_lag_order_equals_regressions(spark):
    table, values = series(spark, 1)
    got = {r.station_id: r for r in ts.adf(table).collect()}
    for k, v in values.items():
        order, stat = plain_adf(v)
        assert (got[k].lags, got[k].n) == (order, len(v)) and got[k].adf_stat == pytest.approx(stat, rel=1e-6)
    assert got[1].lags > 0 or got[2].lags > 0
    assert ts.adf_p(-2.86) == pytest.approx(0.05, abs=2e-3) and ts.adf_p(-3.43) == pytest.approx(0.01, abs=1e-3) and ts.adf_p(5.0) == 1.0


def test_bandwidth_from_the_data(spark):
    table, values = series(spark, 2)
    for r in ts.kpss_auto(table).collect():
        v = values[r.station_id]
        n, e = len(v), v - v.mean()
        c = [float((e[k:] * e[: n - k]).sum()) for k in range(n)]
        upto = int(n ** (2 / 9))
        s0 = c[0] / n + sum(c[k] / (n / 2) for k in range(1, upto + 1))
        s1 = sum(k * c[k] / (n / 2) for k in range(1, upto + 1))
        lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
        spread = (c[0] + 2 * sum((1 - k / (lags + 1)) * c[k] for k in range(1, lags + 1))) / n
        assert r.lags == lags and r.kpss_stat == pytest.approx((e.cumsum() ** 2).sum() / n**2 / spread, rel=1e-9)
        assert r.p_value == pytest.approx(np.interp(r.kpss_stat, ts.KPSS_VALUES, ts.KPSS_P))


def greedy(times, gap):
    out = []
    for t in sorted(times):
        if not out or t - out[-1] >= gap:
            out.append(t)
    return out


@pytest.mark.parametrize("gap", [0, 7, 600])
def test_cooldown_of_hot_keys_ties_and_nulls(spark, gap):
    r = np.random.default_rng(4)
    rows = [(None if k == 9 else k, "A" if k % 2 else None, int(t)) for k, n in ((1, 6000), (2, 40), (3, 1), (9, 500)) for t in r.integers(0, 9000, n)]
    df = spark.createDataFrame(rows, "station_id long, alert_type string, s long").repartition(7).select(
        "station_id", "alert_type", F.timestamp_seconds("s").alias("event_time"))
    got = al.apply_cooldown(df, cooldown_s=float(gap)).select("station_id", "alert_type", F.unix_timestamp("event_time").alias("s")).collect()
    for key in {x[:2] for x in rows}:
        want = greedy([x[2] for x in rows if x[:2] == key], gap)
        assert sorted(x.s for x in got if (x.station_id, x.alert_type) == key) == want


def test_cooldown_of_nothing(spark):
    none = spark.createDataFrame([(1, "A", None)], "station_id long, alert_type string, event_time timestamp")
    assert al.apply_cooldown(none).count() == 0
    one = none.unionByName(spark.createDataFrame([(1, "A", dt.datetime(2024, 1, 1))], none.schema))
    assert al.apply_cooldown(one).count() == 1


def test_sequences_are_fitted_in_partitions_of_a_stated_number_of_rows(spark, monkeypatch):
    """However few partitions the windows come in; calendars of few keys are dealt over tasks too."""
    from pyspark.sql import functions as F

    from kiloqueue.operators import ml
    from kiloqueue.operators import timeseries as ts

    monkeypatch.setattr(ml, "ROWS_PER_TASK", 100)
    windows = spark.range(2000).coalesce(1).select(F.array(F.array(F.col("id").cast("double"))).alias("X"), F.lit(1.0).alias("y"))
    data = ml._sequence_table(windows)
    per_task = [r["count"] for r in data.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 2000 and len(per_task) == 20 and max(per_task) < 400, per_task
    assert sorted(r.features[0] for r in data.collect()) == list(range(2000))
    sessions = spark.range(400).select((F.col("id") % 40).alias("station_id"), F.timestamp_seconds(F.col("id") * 40_000).alias("session_start"), F.lit(1.0).alias("wait_time_minutes"))
    series = ts.hourly_series(sessions)
    held = [set(x) for x in series.rdd.map(lambda r: r.station_id).mapPartitions(lambda ids: [set(ids)]).collect()]
    assert sum(map(bool, held)) > 1 and sum(map(len, held)) == 40
