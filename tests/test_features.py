from pyspark.sql import functions as F

from kiloqueue.functions import ranked, spatial
from kiloqueue.functions.scalars import congestion_score, wait_recommendation
from kiloqueue.operators import clean as cl
from kiloqueue.operators import features as fe


def test_invalid_coordinates_removed(spark):
    df = spark.createDataFrame([(1, 37.77, -122.4), (2, None, -122.4), (3, 200.0, -122.4)],
                               "station_id long, lat double, lng double")
    assert [r.station_id for r in cl.clean_stations(df).collect()] == [1]


def test_station_defaults_and_flags(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, None, None, "Not Operational"), (2, 1.0, 1.0, "Mennekes", 22.0, None)],
                               "station_id long, lat double, lng double, connector_type string, power_kw double, status string")
    rows = {r.station_id: r for r in cl.clean_stations(df).collect()}
    assert rows[1].connector_type == "Unknown" and rows[1].power_kw == 50.0 and rows[1].num_ports == 2
    assert rows[1].is_operational == 1  # substring rule: "Not Operational" contains "Operational"
    assert rows[2].connector_type == "Unknown" and rows[2].status == "Unknown" and rows[2].is_operational == 0


def test_weather_flags(spark):
    df = spark.createDataFrame([(-5.0, 0.0), (20.0, 0.5), (40.0, 0.0)], "temperature_c double, precipitation_mm double")
    rows = fe.add_weather_features(df).collect()
    assert [r.is_cold for r in rows] == [1, 0, 0] and [r.is_hot for r in rows] == [0, 0, 1]
    assert [r.is_raining for r in rows] == [0, 1, 0]


def test_traffic_score(spark):
    df = spark.createDataFrame([(25.0, 50.0), (60.0, 60.0), (0.0, 60.0), (10.0, 0.0)], "c double, f double")
    assert [r.s for r in df.select(congestion_score("c", "f").alias("s")).collect()] == [0.5, 0.0, 1.0, 0.0]


def test_recommendation_labels(spark):
    df = spark.createDataFrame([(2.0, 5), (10.0, 2), (25.0, 1), (50.0, 0), (90.0, 3)], "w double, a int")
    labels = [r.l for r in df.select(wait_recommendation("w", "a").alias("l")).collect()]
    assert labels == ["GO_NOW", "GOOD_TIME", "MODERATE_WAIT", "LONG_WAIT", "AVOID"]


def test_utilisation_in_range(spark):
    df = spark.createDataFrame([(0, 4), (3, 4), (8, 4)], "available_ports int, num_ports int")
    rows = fe.add_utilization_features(df).collect()
    assert all(0.0 <= r.station_utilization <= 1.0 for r in rows)


def test_temporal_ranges(spark):
    from tests.conftest import SF
    from kiloqueue.sources import adapter as ad

    t = fe.add_temporal_features(ad.sessions(spark, SF))
    agg = t.agg(F.min("hour_of_day"), F.max("hour_of_day"), F.min("hour_sin"), F.max("hour_cos"),
                F.max("day_of_week")).first()
    assert agg[0] >= 0 and agg[1] <= 23 and agg[2] >= -1 and agg[3] <= 1 and agg[4] <= 6


def test_rolling_excludes_current_row(spark):
    df = spark.createDataFrame([(1, i, float(i * 10)) for i in range(5)], "station_id long, session_id long, wait_time_minutes double")
    df = df.withColumn("session_start", F.timestamp_seconds("session_id"))
    rows = sorted(fe.add_rolling_features(df).collect(), key=lambda r: r.session_id)
    assert rows[0].rolling_mean_1h is None and rows[0].rolling_std_1h == 0.0
    assert rows[1].rolling_mean_1h == 0.0 and rows[3].rolling_mean_1h == 10.0


def test_pipeline_has_no_nulls(spark):
    from tests.conftest import SF
    from kiloqueue.sources import adapter as ad

    st = cl.clean_stations(ad.raw_stations(spark, SF))
    merged = cl.merge_datasets(st, cl.clean_sessions(ad.sessions(spark, SF)), ad.traffic(spark, SF))
    out = fe.engineer_features(cl.encode_categoricals(merged), st)
    num = cl.numeric_columns(out)
    nulls = out.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in num]).first().asDict()
    assert all(v == 0 for v in nulls.values()), nulls


def test_split_is_disjoint_and_whole(spark):
    from tests.conftest import SF
    from kiloqueue.sources import adapter as ad

    s = ad.sessions(spark, SF)
    tr, te = cl.train_test_split(s)
    n, a, b = s.count(), tr.count(), te.count()
    assert a + b == n and 0.75 <= a / n <= 0.85
    assert tr.join(te, "session_id").count() == 0


def test_only_columns_with_gaps_are_ranked(spark, monkeypatch):
    asked, found = [], ranked.quantiles
    monkeypatch.setattr(ranked, "quantiles", lambda df, cols, *more: asked.append(list(cols)) or found(df, cols, *more))
    df = spark.createDataFrame([(1, 1.0, None, None, float("inf")), (2, 4.0, 7.0, None, 2.0), (3, 2.0, 8.0, None, 4.0)],
                               "whole int, full double, gap double, none double, endless double")
    out = fe.fill_numeric_medians(df).collect()
    assert asked == [["gap", "none", "endless"]]
    assert [tuple(r) for r in out] == [(1.0, 1.0, 7.5, 0.0, 3.0), (2.0, 4.0, 7.0, 0.0, 2.0), (3.0, 2.0, 8.0, 0.0, 4.0)]
    assert fe.fill_numeric_medians(df.select("whole", "full")).dtypes == [("whole", "double"), ("full", "double")] and len(asked) == 1


def test_places_of_a_dense_spot_are_dealt_over_tasks(spark):
    """However few bytes they have: each place is compared with all near ones."""
    places = spark.range(1500).select((37.7 + F.col("id") % 40 * 1e-3).alias("lat"), (-122.4 + F.floor(F.col("id") / 40) * 1e-3).alias("lng"), F.lit(1).alias("n"))
    counts = spatial.counts_within(places.drop("n"), places, 2.0)
    joins = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [block" in joins
    assert counts.count() == 1500
