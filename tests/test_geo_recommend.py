import math
import random

from pyspark.sql import functions as F

from kiloqueue.functions import geo
from kiloqueue.operators import features as fe
from kiloqueue.operators import recommend as rc


def _hav(a, b, c, d):
    p1, p2 = math.radians(a), math.radians(c)
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(d - b) / 2) ** 2
    return 6371 * 2 * math.atan2(math.sqrt(x), math.sqrt(1 - x))


def test_sf_to_la(spark):
    d = spark.range(1).select(geo.haversine_km(F.lit(37.7749), F.lit(-122.4194), F.lit(34.0522),
                                               F.lit(-118.2437)).alias("d")).first().d
    assert 540 <= d <= 580


def test_grid_join_equals_brute_force(spark):
    rnd = random.Random(7)
    pts = [(i, rnd.uniform(-0.05, 0.05) + lat, rnd.uniform(-0.05, 0.05) + lng)
           for i, (lat, lng) in enumerate([(37.77, -122.42)] * 60 + [(0.0, 179.99)] * 20 + [(0.0, -179.99)] * 20
                                          + [(89.95, 10.0)] * 20)]
    st = spark.createDataFrame(pts, "station_id long, lat double, lng double")
    got = {(r._qlat, r._qlng): r.nearby_stations_count for r in fe.nearby_counts(st, st, 2.0).collect()}
    for _, a, b in pts:
        want = sum(1 for _, c, d in pts if _hav(a, b, c, d) < 2.0)
        assert got[(a, b)] == want


def test_weights_sum_to_one():
    for w in rc.PRIORITY_WEIGHTS.values():
        assert abs(sum(w) - 1.0) < 1e-12


def test_recommend_ranks_and_order(spark):
    from tests.conftest import SF
    from kiloqueue.sources import adapter as ad

    out = rc.recommend(ad.users(spark, SF), ad.stations(spark, SF), ad.predictions(spark, SF), top_n=5)
    for uid, rows in out.groupBy("user_id").agg(F.collect_list(F.struct("rank", "composite_score")).alias("r")).collect():
        rows = sorted(rows)
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) <= 5
        assert all(a[1] >= b[1] for a, b in zip(rows, rows[1:]))


def test_diversify_keeps_first_and_third(spark):
    recs = spark.createDataFrame([(1, 1, 10, 37.7749, -122.4194), (1, 2, 11, 37.7750, -122.4195),
                                  (1, 3, 12, 37.8044, -122.2712)],
                                 "user_id long, rank int, station_id long, lat double, lng double")
    kept = [r.station_id for r in rc.diversify(recs, 1.0).orderBy("rank").collect()]
    assert kept == [10, 12]


def test_stations_of_one_grid_cell_are_dealt_over_tasks(spark):
    """A cell's stations meet the classes in parts; all pairs are made, also of stations without an id or that come twice."""
    from pyspark.sql import functions as F

    from kiloqueue.operators import recommend as rc

    rows = [(i if i % 7 else None, 37.0 + i % 50 * 1e-4, -122.0) for i in range(6000)]
    cell = F.struct(F.lit(1).alias("band"), F.lit(2).alias("cell")).alias("_cell")
    stations = spark.createDataFrame([*rows, *rows[:20], (None, 1.0, 1.0)], "station_id long, lat double, lng double").select("*", F.lit(5).alias("band"), cell)
    classes = spark.createDataFrame([(k,) for k in range(3)], "k int").select("k", F.lit(5).alias("band"), cell)
    met = rc._meet(classes, stations, ["band", "_cell"]).select("k", "station_id", "lat", "lng")
    plain = classes.join(stations, ["band", "_cell"]).select("k", "station_id", "lat", "lng")
    assert met.count() == plain.count() == 3 * 6021 and met.exceptAll(plain).count() == 0
    per_task = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) > 1 and max(per_task) < 0.7 * sum(per_task)
