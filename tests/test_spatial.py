"""Counts, pairs and spread over dense places, against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiloqueue.functions import geo, spatial
from kiloqueue.operators import recommend
from kiloqueue.session import materialise


def km(lat, lng, lats, lngs):
    a = np.sin(np.radians(lats - lat) / 2) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(lats)) * np.sin(np.radians(lngs - lng) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(a, 1.0)))


def places(kind, n, seed):
    r = np.random.default_rng(seed)
    lat, lng = r.uniform(-89.9, 89.9, n), r.uniform(-180, 180, n)
    if kind == "dense":  # nine in ten within a few hundred metres, a cluster at the antimeridian and one at the pole
        k = int(0.9 * n)
        lat[:k], lng[:k] = 37.77 + r.normal(0, 0.004, k), -122.42 + r.normal(0, 0.004, k)
        m = (n - k) // 3
        lat[k: k + m], lng[k: k + m] = 10 + r.normal(0, 0.01, m), np.where(r.random(m) < 0.5, 180, -180)
        lat[k + m: k + 2 * m] = 89.99
    else:
        lat, lng = 37 + r.uniform(0, 0.6, n), -122 + r.uniform(0, 0.6, n)
    return list(dict.fromkeys(zip(lat.tolist(), lng.tolist())))


@pytest.mark.parametrize(("kind", "radius"), [("dense", 0.3), ("dense", 2.0), ("even", 2.0), ("even", 90.0)])
def test_counts_equal_all_pairs(spark, kind, radius):
    q, s = places(kind, 900, 1), places(kind, 1200, 2)
    weights = np.random.default_rng(3).integers(1, 4, len(s))
    points = spark.createDataFrame([(a, b, int(w)) for (a, b), w in zip(s, weights)], "lat double, lng double, n long")
    got = {(r.lat, r.lng): r.n_near for r in spatial.counts_within(spark.createDataFrame(q, "lat double, lng double"), points, radius).collect()}
    lats, lngs = np.array(s).T
    assert got == {(a, b): int(weights[km(a, b, lats, lngs) < radius].sum()) for a, b in q}


def test_pairs_equal_all_pairs(spark):
    q, s = places("dense", 400, 4), places("dense", 300, 5)
    frames = [spark.createDataFrame(x, "lat double, lng double") for x in (q, s)]
    got = {tuple(r)[:4] for r in spatial.places_within(*frames, 0.5).collect()}
    lats, lngs = np.array(s).T
    assert got == {(a, b, *s[k]) for a, b in q for k in np.flatnonzero(km(a, b, lats, lngs) <= 0.5)}
    assert spatial.places_within(frames[0], frames[1].limit(0), 0.5).count() == 0
    assert spatial.counts_within(frames[0].limit(0), frames[1].withColumn("n", F.lit(1)), 0.5).count() == 0
    assert spatial.counts_within(frames[0], frames[1].withColumn("n", F.lit(1)).limit(0), 0.5).agg(F.sum("n_near")).first()[0] == 0


def test_a_dense_place_makes_no_quadratic_rows(spark):
    """Four times the places, of which nine in ten lie in one cell, make clearly less than sixteen times the pairs of nodes and comparisons."""
    seen = []
    for n in (5_000, 20_000):
        near = spark.range(n).select((F.when(F.col("id") % 10 > 0, F.randn(1) * 0.004 + 37.77).otherwise(F.rand(2) * 160 - 80)).alias("lat"),
                                     (F.when(F.col("id") % 10 > 0, F.randn(3) * 0.004 - 122.42).otherwise(F.rand(4) * 360 - 180)).alias("lng"))
        tree = spatial.Blocks(materialise(near, "near"))
        within, crossing = spatial.near_blocks(tree, tree, 0.3)
        seen.append((sum(p.count() for _, p in within) + crossing.count(), crossing.count()))
        # no block holds more than its share, so no task does
        assert tree.points.groupBy("block").count().agg(F.max("count")).first()[0] <= spatial.BLOCK
    assert seen[1][0] < 12 * seen[0][0] and seen[1][1] < 12 * seen[0][1], seen
    assert seen[1][1] * spatial.BLOCK**2 < 18_000**2 / 2, seen


def walk(rows, d):
    kept, grid = [], {}
    for rank, i, lat, lng in sorted(rows, key=lambda r: r[:2]):
        if lat is None:
            kept.append(i)
            continue
        cell = (math.floor(lat * 111 / d), math.floor(lng * 111 / d))
        around = [p for dx in (-1, 0, 1) for dy in (-1, 0, 1) for p in grid.get((cell[0] + dx, cell[1] + dy), [])]
        if all(math.sqrt((lat - a) ** 2 + (lng - b) ** 2) * 111 >= d for a, b in around):
            kept.append(i)
            grid.setdefault(cell, []).append((lat, lng))
    return kept


@pytest.mark.parametrize("kind", ["dense", "even"])
def test_spread_equals_the_walk(spark, monkeypatch, kind):
    monkeypatch.setattr(recommend, "FOLD_ROWS", 50)
    r = np.random.default_rng(7)
    rows = [(u, int(r.integers(0, 5000)), i, lat, lng) for u, n in ((1, 3000), (2, 20), (3, 600)) for i, (lat, lng) in enumerate(places(kind, n, u))]
    rows += [(1, 0, 100_000, None, 1.0), (3, 9, 100_001, 2.0, None)]
    recs = spark.createDataFrame(rows, "user_id long, rank long, station_id long, lat double, lng double")
    for d in (1.0, 0.05):
        got = recommend.diversify(recs, d).collect()
        for u in (1, 2, 3):
            want = walk([(x[1], x[2], x[3] if x[4] is not None else None, x[4]) for x in rows if x[0] == u], d)
            assert sorted(x.station_id for x in got if x.user_id == u) == sorted(want), (u, d)


def test_spread_of_a_million_rows(spark):
    recs = materialise(spark.range(1_000_000).select(
        F.lit(1).alias("user_id"), F.xxhash64("id").alias("rank"), F.col("id").alias("station_id"), (F.rand(1) * 0.3 + 37).alias("lat"), (F.rand(2) * 0.3 - 122).alias("lng")), "many")
    got = recommend.diversify(recs, 1.0).toPandas()
    want = walk(list(recs.select("rank", "station_id", "lat", "lng").toPandas().itertuples(index=False, name=None)), 1.0)
    assert sorted(got.station_id) == sorted(want)
