"""Order statistics, range windows, cooldown and ranking on keys that hold most rows."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kiloqueue.functions import geo, ranked
from kiloqueue.operators import alerts as al
from kiloqueue.operators import features as fe
from kiloqueue.operators import recommend as rc


@pytest.fixture(scope="module")
def hot():
    """One station with most rows, some with a few, one with a single row."""
    r = random.Random(3)
    rows = [(1 if i % 10 else 2 + i % 5, i, round(r.uniform(0, 90), 2) if i % 17 else None) for i in range(4000)] + [(99, 5000, 1.5)]
    r.shuffle(rows)
    return pd.DataFrame(rows, columns=["station_id", "session_id", "wait_time_minutes"])


@pytest.fixture(scope="module")
def hot_df(spark, hot):
    df = spark.createDataFrame([(int(s), int(i), None if pd.isna(w) else float(w)) for s, i, w in hot.itertuples(index=False)],
                               "station_id long, session_id long, wait_time_minutes double")
    return df.withColumn("session_start", F.timestamp_seconds("session_id"))


def test_no_range_holds_the_hot_key(spark, hot_df):
    parts = ranked.in_ranges(hot_df, "station_id", ["session_start"]).groupBy("station_id", ranked.PART).count().collect()
    assert max(r["count"] for r in parts) < 0.6 * 4000


def test_quantiles_equal_numpy(hot, hot_df):
    probs = [0.01, 0.25, 0.5, 0.95]
    own = hot.wait_time_minutes.dropna()
    got = ranked.quantiles(hot_df, ["wait_time_minutes"], probs).first()
    assert got.total == len(own) and got.q == pytest.approx(np.quantile(own, probs).tolist())
    for r in ranked.quantiles(hot_df, ["wait_time_minutes", "session_id"], probs, ("station_id",)).collect():
        want = hot[hot.station_id == r.station_id][r.column].dropna()
        assert r.q == pytest.approx(np.quantile(want, probs).tolist())


def test_windows_equal_pandas(hot, hot_df):
    p = hot.sort_values("session_id")
    g = p.groupby("station_id").wait_time_minutes
    p = p.assign(roll=g.transform(lambda s: s.shift(1).rolling(36, min_periods=1).mean()), lag=g.shift(24),
                 mean=g.transform(lambda s: s.expanding().mean()), std=g.transform(lambda s: s.expanding().std()),
                 far=p.wait_time_minutes.shift(12)).set_index("session_id")
    h = fe.add_history_features(hot_df).toPandas().set_index("session_id").loc[p.index]
    assert np.allclose(h.rolling_mean_6h.astype(float), p.roll, equal_nan=True) and np.allclose(h.lag_24.astype(float), p["lag"], equal_nan=True)
    e = fe.add_expanding_features(hot_df).toPandas().set_index("session_id").loc[p.index]
    assert np.allclose(e.rolling_mean_1h.astype(float), p["mean"].astype(float), equal_nan=True)
    assert np.allclose(e.rolling_std_1h, p["std"].fillna(0.0), atol=1e-9)
    w = fe.add_global_lags(hot_df).toPandas().set_index("session_id").loc[p.index]
    assert np.allclose(w.lag_12.astype(float), p.far, equal_nan=True)


def test_empty_table(hot_df):
    none = hot_df.limit(0)
    assert ranked.quantiles(none, ["wait_time_minutes"], [0.5]).count() == 0
    assert fe.add_history_features(none).count() == 0 and fe.add_expanding_features(none).count() == 0
    assert fe.fill_numeric_medians(none).count() == 0


def test_cooldown_of_one_large_key(spark):
    base = dt.datetime(2024, 1, 1)
    r = random.Random(1)
    seconds = [r.randrange(3_000_000) for _ in range(12_000)] + [2_000_000] * 300
    rows = [(7, "A", base + dt.timedelta(seconds=s)) for s in seconds] + [(None, "B", base), (8, "A", base)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "station_id long, alert_type string, event_time timestamp")
    for gap in (1, 600, 90_000):
        want, last = [], None
        for s in sorted(seconds):
            if last is None or s - last >= gap:
                want.append(s)
                last = s
        got = al.apply_cooldown(df, cooldown_s=gap).collect()
        assert sorted((x.event_time - base).total_seconds() for x in got if x.station_id == 7) == want
        assert sum(x.station_id is None for x in got) == 1 and sum(x.station_id == 8 for x in got) == 1


def test_ranking_prunes_and_stays_exact(spark):
    r = random.Random(5)
    users = [(i, 37.7 + r.uniform(-.2, .2), -122.4 + r.uniform(-.2, .2), r.choice([*rc.PRIORITY_WEIGHTS, "odd"]), r.choice(["CCS", None, "type 2"]),
              r.choice([3.0, 20.0])) for i in range(150)]
    users += [(1000 + i, 37.7001, -122.4001, "speed", None, 20.0) for i in range(100)]  # a dense cell
    users += [(5000, 37.7, -122.4, "balanced", None, 400.0), (5001, 0.0, 0.0, "balanced", None, 1.0)]  # a long detour, nothing near
    stations = [(i, f"S{i}", 37.7 + r.uniform(-.3, .3), -122.4 + r.uniform(-.3, .3), r.randrange(0, 9), 8, r.choice(["CCS", "Type 2"]),
                 r.choice([50.0, 150.0]), r.choice(["Operational", "Offline"]), "op", r.random(), r.uniform(0, 70)) for i in range(400)]
    stations.append((900, "far", 39.0, -122.4, 8, 8, "CCS", 350.0, "Operational", "op", 0.0, 0.0))
    u = spark.createDataFrame(users, "user_id long, user_lat double, user_lng double, priority string, connector_pref string, max_detour_km double")
    s = spark.createDataFrame(stations, "station_id long, name string, lat double, lng double, available_ports int, num_ports int, connector_type string, "
                              "power_kw double, status string, operator string, traffic_score double, wait_time_minutes double")
    st = rc.station_scores(rc.attach_wait(s, None))
    every = rc.with_weights(u).join(st, F.lit(True)).withColumn("d", geo.haversine_km("user_lat", "user_lng", "lat", "lng")).where("d <= max_detour_km")
    scored = every.select("user_id", "station_id", rc.pair_composite(F.col("d"), F.col("connector_pref")).alias("c")).toPandas()
    want = scored.sort_values(["user_id", "c", "station_id"], ascending=[True, False, True]).groupby("user_id").head(5)
    got = rc.recommend(u, s).select("user_id", "rank", "station_id").toPandas().sort_values(["user_id", "rank"])
    assert got[["user_id", "station_id"]].values.tolist() == want[["user_id", "station_id"]].values.tolist()
    assert rc.candidate_pairs(u, st, 5).count() < 0.5 * len(users) * len(stations)
    assert rc.recommend(u.limit(0), s).count() == 0
