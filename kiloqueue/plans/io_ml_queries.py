"""Registered queries: sources / sinks (S-*) and MLlib models (M-04..M-12)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kiloqueue.operators import ml
from kiloqueue.operators import timeseries as ts
from kiloqueue.operators.features import add_temporal_features
from kiloqueue.plans.registry import register
from kiloqueue.sources import adapter as ad
from kiloqueue.sources import io
from kiloqueue.streaming.jobs import work_dir

#: The forest (300 trees, depth 15), its bands and boosting (200 rounds) run at the reference's settings.  Folds, the grid,
#: the sequence forecast and saving use fewer trees or rounds, so that a query takes a minute; the operators' defaults
#: are the reference's.
FOLD_TREES, SEQUENCE_ROUNDS, SAVED_TREES = 50, 20, 20

# --- sources ------------------------------------------------------------------


def _station_payloads(spark, sf_dir):
    """Station documents as an upstream API would send them (built from stations)."""
    st = ad.stations(spark, sf_dir)
    sid = F.col("station_id")
    conn = F.struct(F.struct(F.col("connector_type").alias("Title")).alias("ConnectionType"),
                    F.col("power_kw").alias("PowerKW"))
    conns = (F.when(sid % 10 == 0, F.array().cast("array<struct<ConnectionType:struct<Title:string>,PowerKW:double>>"))
             .when(sid % 10 == 1, F.lit(None)).otherwise(F.array_repeat(conn, F.col("num_ports"))))
    doc = F.struct(sid.alias("ID"),
                   F.struct(F.col("name").alias("Title"), F.col("lat").alias("Latitude"),
                            F.col("lng").alias("Longitude"), F.col("operator").alias("Town")).alias("AddressInfo"),
                   conns.alias("Connections"),
                   F.when(sid % 9 == 0, F.lit(None)).otherwise(F.struct(F.col("status").alias("Title")))
                   .alias("StatusType"),
                   F.struct(F.col("operator").alias("Title")).alias("OperatorInfo"))
    return st.select(F.to_json(doc).alias("payload"))


@register("s_01_n_01_station_json", sql="""
SELECT station_id, name, lat, lng, '' AS address, operator AS city, '' AS country,
  cast(CASE WHEN station_id % 10 = 0 THEN 0 WHEN station_id % 10 = 1 THEN 1 ELSE num_ports END AS int) AS num_ports,
  CASE WHEN station_id % 10 IN (0, 1) THEN 'Unknown' ELSE connector_type END AS connector_type,
  CASE WHEN station_id % 10 IN (0, 1) THEN NULL ELSE power_kw END AS power_kw,
  CASE WHEN station_id % 9 = 0 THEN 'Unknown' ELSE status END AS status, 'Public' AS usage_type,
  operator
FROM stations""")
def s_01_n_01_station_json(spark, sf_dir):
    flat = _station_payloads(spark, sf_dir).select(*io.flatten_stations(F.col("payload")))
    return flat.drop("date_created")


@register("s_06_x_10_traffic_json", sql="""
SELECT station_id, CASE WHEN station_id % 6 = 0 THEN 0e0 ELSE cs END AS current_speed_kmh, 50e0 AS free_flow_speed_kmh,
  0e0 AS confidence,
  CASE WHEN station_id % 6 = 0 THEN 0e0
    ELSE round(greatest(0e0, least(1e0, 1e0 - cs / 50e0)), 4) END AS traffic_score
FROM (SELECT station_id, 50e0 * (1e0 - traffic_score) AS cs FROM stations) s""")
def s_06_x_10_traffic_json(spark, sf_dir):
    st = ad.stations(spark, sf_dir)
    sid = F.col("station_id")
    flow = F.struct((F.lit(50.0) * (F.lit(1.0) - F.col("traffic_score"))).alias("currentSpeed"),
                    F.lit(50.0).alias("freeFlowSpeed"))
    payload = F.to_json(F.struct(flow.alias("flowSegmentData")))
    # every sixth reading arrives with no speeds at all: default current 0, free 50, score 0
    payload = F.when(sid % 6 == 0, F.lit("{}")).otherwise(payload)
    return st.select("station_id", *io.flatten_traffic(payload))


@register("s_09_n_02_forecast_explode", sql="""
SELECT n_nationkey AS city, strptime(strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(cast(i * 3 AS int)),
  '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS datetime,
  cast(n_nationkey AS double) + cast(i AS double) / 2e0 AS temperature_c,
  CASE WHEN (n_nationkey + i) % 4 = 0 THEN 0.5e0 ELSE 0e0 END AS precipitation_mm,
  CASE WHEN (n_nationkey + i) % 4 = 0 THEN 'Rain' ELSE 'Clear' END AS weather_main
FROM nation, range(0, 8) t(i)""")
def s_09_n_02_forecast_explode(spark, sf_dir):
    n = ad.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("city"))
    i = F.col("i")
    item = F.struct(
        F.struct((F.col("city").cast("double") + i.cast("double") / 2.0).alias("temp")).alias("main"),
        F.when((F.col("city") + i) % 4 == 0, F.struct(F.lit(0.5).alias("3h"))).alias("rain"),
        F.array(F.struct(F.when((F.col("city") + i) % 4 == 0, "Rain").otherwise("Clear").alias("main")))
        .alias("weather"),
        F.date_format(F.timestamp_add("HOUR", i * 3, F.lit("2024-01-01 00:00:00").cast("timestamp")),
                      "yyyy-MM-dd HH:mm:ss").alias("dt_txt"))
    # one forecast document per city: {"list": [item, ...]} (8 items, collected per city)
    items = (n.select("city", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
             .groupBy("city").agg(F.array_sort(F.collect_list(F.struct("i", item.alias("it")))).alias("a")))
    docs = items.select("city", F.to_json(F.struct(F.transform("a", lambda e: e["it"]).alias("list"))).alias("doc"))
    return io.explode_forecast(docs, "doc", keys=("city",))


@register("s_03_s_11_csv_roundtrip", sql="""
SELECT session_id, station_id, strftime(session_start, '%Y-%m-%d %H:%M:%S.%f') AS session_start, session_duration_min, energy_kwh, queue_size,
  available_ports, traffic_score, temperature_c, precipitation_mm, connector_type, wait_time_minutes FROM sessions""")
def s_03_s_11_csv_roundtrip(spark, sf_dir):
    path = work_dir(spark, "csv")
    src = ad.sessions(spark, sf_dir).withColumn("session_start", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    io.write_table(src, path, fmt="csv")
    return io.read_csv(spark, path, ", ".join(f"{c} {t}" for c, t in src.dtypes))


@register("s_12_s_13_partitioned_sink", sql="""
SELECT station_id, session_id, wait_time_minutes, cast(station_id % 10 AS int) AS shard FROM sessions""")
def s_12_s_13_partitioned_sink(spark, sf_dir):
    path = work_dir(spark, "sink")
    src = ad.sessions(spark, sf_dir).select("station_id", "session_id", "wait_time_minutes",
                                           (F.col("station_id") % 10).cast("int").alias("shard"))
    io.write_table(src, path, partition_by=("shard",))

    def never():
        raise AssertionError("the table is there and must be read")

    return io.load_or_compute(spark, path, never).select("station_id", "session_id", "wait_time_minutes", "shard")


@register("s_01_landed_station_files", sql="""
SELECT station_id, name, lat, lng, CASE WHEN station_id % 9 = 0 THEN 'Unknown' ELSE status END AS status, operator FROM stations""")
def s_01_landed_station_files(spark, sf_dir):
    path = work_dir(spark, "stations")
    _station_payloads(spark, sf_dir).write.text(path)
    return io.read_station_json(spark, path).select("station_id", "name", "lat", "lng", "status", "operator")


@register("s_02_station_csv", sql="SELECT station_id, name, lat, lng, num_ports FROM stations")
def s_02_station_csv(spark, sf_dir):
    path = work_dir(spark, "kaggle")
    st = ad.stations(spark, sf_dir).select(F.col("station_id").alias("ID"), F.col("name").alias("Name"), F.col("lat").alias("Latitude"),
                                           F.col("lng").alias("Longitude"), "num_ports")
    io.write_table(st, path, fmt="csv")
    return io.read_csv(spark, path, "ID long, Name string, Latitude double, Longitude double, num_ports int", io.STATION_CSV_RENAMES)


_ENERGY = "SELECT date_trunc('hour', session_start) AS t, round(sum(energy_kwh), 6) AS kwh FROM sessions GROUP BY 1"


def _hourly_energy(spark, sf_dir):
    s = ad.sessions(spark, sf_dir)
    return s.groupBy(F.date_trunc("hour", "session_start").alias("t")).agg(F.round(F.sum("energy_kwh"), 6).alias("kwh"))


@register("s_04_hourly_energy", sql=f"SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS hour, kwh FROM ({_ENERGY}) e")
def s_04_hourly_energy(spark, sf_dir):
    path = work_dir(spark, "energy")
    io.write_table(_hourly_energy(spark, sf_dir).select(F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("Datetime"), "kwh"), path, fmt="csv")
    out = io.read_hourly_energy(spark, path, "Datetime string, kwh double")
    return out.select(F.date_format("Datetime", "yyyy-MM-dd HH:mm:ss").alias("hour"), "kwh")


@register("s_05_demand_csv", sql="SELECT station_id, count(*) AS demand FROM sessions GROUP BY station_id")
def s_05_demand_csv(spark, sf_dir):
    path = work_dir(spark, "demand")
    io.write_table(ad.sessions(spark, sf_dir).groupBy("station_id").agg(F.count("*").alias("demand")), path, fmt="csv")
    return io.read_csv(spark, path, "station_id long, demand long")


@register("s_07_station_traffic_files", sql="""
SELECT station_id, 50e0 * (1e0 - traffic_score) AS current_speed_kmh, 50e0 AS free_flow_speed_kmh, 0.9e0 AS confidence,
  round(greatest(0e0, least(1e0, 1e0 - 50e0 * (1e0 - traffic_score) / 50e0)), 4) AS traffic_score FROM stations""")
def s_07_station_traffic_files(spark, sf_dir):
    path = work_dir(spark, "traffic")
    flow = F.struct((F.lit(50.0) * (F.lit(1.0) - F.col("traffic_score"))).alias("currentSpeed"), F.lit(50.0).alias("freeFlowSpeed"),
                    F.lit(0.9).alias("confidence"))
    ad.stations(spark, sf_dir).select("station_id", F.to_json(F.struct(flow.alias("flowSegmentData"))).alias("payload")).write.json(path)
    return io.read_station_traffic(spark, path)


@register("s_08_current_weather", sql="""
SELECT city, CASE WHEN city % 3 = 0 THEN 20e0 ELSE cast(city AS double) END AS temperature_c, 20e0 AS feels_like_c, 50e0 AS humidity_pct,
  CASE WHEN city % 2 = 0 THEN 1.5e0 ELSE 0e0 END AS precipitation_mm, cast(city AS double) / 4e0 AS wind_speed_ms,
  CASE WHEN city % 2 = 0 THEN 'Rain' ELSE 'Clear' END AS weather_main
FROM (SELECT cast(c_custkey AS bigint) AS city FROM customer) c""")
def s_08_current_weather(spark, sf_dir):
    path = work_dir(spark, "weather")
    c = F.col("city")
    wet = F.when(c % 2 == 0, F.struct(F.lit(1.5).alias("1h")))
    doc = F.struct(F.when(c % 3 != 0, F.struct(c.cast("double").alias("temp"))).alias("main"), wet.alias("rain"),
                   F.struct((c / 4.0).alias("speed")).alias("wind"),
                   F.when(c % 2 == 0, F.array(F.struct(F.lit("Rain").alias("main")))).alias("weather"))
    ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("city")).select(
        "city", F.to_json(doc).alias("payload")).write.json(path)
    return io.read_weather_json(spark, path)


@register("s_10_load_raw", sql="""
SELECT 'demand' AS name, count(*) AS n FROM (SELECT station_id FROM sessions GROUP BY 1) d
UNION ALL SELECT 'stations', count(*) FROM stations""")
def s_10_load_raw(spark, sf_dir):
    root = work_dir(spark, "raw")
    io.write_table(ad.stations(spark, sf_dir).select("station_id", "name"), f"{root}/stations", fmt="csv")
    io.write_table(ad.sessions(spark, sf_dir).groupBy("station_id").agg(F.count("*").alias("demand")), f"{root}/demand", fmt="csv")
    schemas = {"stations": "station_id long, name string", "demand": "station_id long, demand long", "weather": "city long"}
    tables = io.load_raw(spark, {k: f"{root}/{k}" for k in schemas}, schemas)
    counts = [df.agg(F.lit(k).alias("name"), F.count("*").alias("n")) for k, df in sorted(tables.items())]
    return counts[0].unionByName(counts[1]) if len(counts) == 2 else None


@register("s_14_metrics_json", sql="""
SELECT hour_of_day, count(*) AS n, round(avg(wait_time_minutes), 9) AS mean_wait FROM (
  SELECT cast(hour(session_start) AS int) AS hour_of_day, wait_time_minutes FROM sessions) s GROUP BY hour_of_day""")
def s_14_metrics_json(spark, sf_dir):
    path = work_dir(spark, "metrics")
    s = add_temporal_features(ad.sessions(spark, sf_dir))
    io.write_metrics(s.groupBy("hour_of_day").agg(F.count("*").alias("n"), F.round(F.avg("wait_time_minutes"), 9).alias("mean_wait")), path)
    return io.read_metrics(spark, path, "hour_of_day int, n long, mean_wait double")


@register("s_15_sessions_csv", sql="""
SELECT session_id, CASE WHEN session_id % 9 <> 0 THEN strftime(session_start, '%Y-%m-%d %H:%M:%S') END AS start_time, wait_time_minutes FROM sessions""")
def s_15_sessions_csv(spark, sf_dir):
    path = work_dir(spark, "eda")
    text = F.when(F.col("session_id") % 9 == 0, F.lit("?")).otherwise(F.date_format("session_start", "yyyy-MM-dd HH:mm:ss"))
    io.write_table(ad.sessions(spark, sf_dir).select("session_id", text.alias("start_time"), "wait_time_minutes"), path, fmt="csv")
    out = io.read_sessions_csv(spark, path, "session_id long, start_time string, wait_time_minutes double")
    return out.withColumn("start_time", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss"))


# --- models: facts that SQL can state about models at the reference's settings ------------

_FEATS = ["hour_of_day", "day_of_week", "is_weekend", "traffic_score", "queue_size", "available_ports",
          "temperature_c", "precipitation_mm", "hour_sin", "hour_cos"]


def _model_frame(spark, sf_dir):
    return add_temporal_features(ad.sessions(spark, sf_dir))


@register("m_04_m_07_o_07_importances", sql="""
SELECT cast(10 AS bigint) AS features, 1e0 AS total, true AS queue_first, true AS descending""")
def m_04_m_07_o_07_importances(spark, sf_dir):
    models = ml.train_forest(_model_frame(spark, sf_dir), _FEATS)
    imp = ml.feature_importances(spark, models, _FEATS)
    inorder = F.collect_list("importance")
    return imp.agg(F.count("*").alias("features"), F.round(F.sum("importance"), 9).alias("total"),
                   (F.max_by("feature", "importance") == "queue_size").alias("queue_first"),
                   (F.sort_array(inorder, asc=False) == inorder).alias("descending"))


@register("m_08_m_09_rf_uncertainty", sql="SELECT session_id, true AS sound FROM sessions")
def m_08_m_09_rf_uncertainty(spark, sf_dir):
    df = _model_frame(spark, sf_dir)
    models = ml.train_forest(df, _FEATS)
    out = ml.predict_with_uncertainty(models, df.select("session_id", *_FEATS), _FEATS)
    forest = ml.mean_of_parts(models, df.select("session_id", *_FEATS), _FEATS).select("session_id", "rf_prediction")
    sound = ((F.col("lower_95") >= 0) & (F.col("lower_95") <= F.col("mean")) & (F.col("mean") <= F.col("upper_95")) & (F.col("std") >= 0)
             & (F.abs(F.col("mean") - F.col("rf_prediction")) < 1e-9))
    return out.join(forest, "session_id").select("session_id", sound.alias("sound"))


@register("m_06_cross_validate", sql="SELECT cast(k AS int) AS fold, true AS good FROM range(0, 5) t(k)")
def m_06_cross_validate(spark, sf_dir):
    folds = ml.cross_validate(spark, _model_frame(spark, sf_dir), _FEATS, numTrees=FOLD_TREES)
    return folds.select("fold", ((F.col("r2") > 0.3) & (F.col("mae") <= F.col("rmse"))).alias("good"))


@register("m_05_tune", sql="""
SELECT trees, depth, min_instances, true AS beats_mean FROM (VALUES (25), (50)) a(trees), (VALUES (5), (8), (10)) b(depth), (VALUES (2), (5)) c(min_instances)""")
def m_05_tune(spark, sf_dir):
    df = _model_frame(spark, sf_dir)
    spread = df.agg(F.stddev_pop("wait_time_minutes").alias("s")).scalar()
    return ml.tune_rf(df, _FEATS, trees=(25, 50), depths=(5, 8, 10), folds=2).select("trees", "depth", "min_instances", (F.col("rmse") < spread).alias("beats_mean"))


@register("m_10_m_21_gbt_holdout", sql="""
SELECT count(*) AS n_samples, true AS good FROM sessions WHERE (session_id * 7919) % 100 >= 80""")
def m_10_m_21_gbt_holdout(spark, sf_dir):
    from kiloqueue.operators.clean import train_test_split
    from kiloqueue.operators.evaluate import compute_metrics

    tr, te = train_test_split(_model_frame(spark, sf_dir))
    model = ml.train_gbt(tr, _FEATS)
    pred = model.transform(ml.prepare(te, _FEATS, None)).withColumn("p", F.greatest("rf_raw", F.lit(0.0)))
    m = compute_metrics(pred, "wait_time_minutes", "p", "gbt")
    return m.select("n_samples", ((F.col("r2") > 0.5) & (F.col("mae_min") <= F.col("rmse_min"))).alias("good"))


@register("m_11_m_12_sequence_forecast", sql="""
SELECT station_id, cast(k AS int) AS step, true AS sound FROM (
  SELECT station_id FROM (SELECT station_id, date_diff('hour', date_trunc('hour', min(session_start)), date_trunc('hour', max(session_start))) + 1 AS n
    FROM sessions GROUP BY station_id) s WHERE n >= 24) t, range(0, 12) r(k)""")
def m_11_m_12_sequence_forecast(spark, sf_dir):
    series = ts.hourly_series(ad.sessions(spark, sf_dir)).withColumn("session_id", F.col("pos"))
    seqs = ts.sequence_windows(series, ["value"], "value", 24, order_cols=("pos",))
    model = ml.train_sequence_model(seqs, maxIter=SEQUENCE_ROUNDS)
    last = (series.withColumn("_rn", F.row_number().over(Window.partitionBy("station_id").orderBy(F.col("pos").desc())))
            .where(F.col("_rn") <= 24)
            .groupBy("station_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("a"))
            .select("station_id", F.transform("a", lambda e: F.array(e["value"])).alias("X")).where(F.size("X") == 24))
    out = ml.forecast_multistep(model, last, steps=12, checkpoint_every=4)
    return out.select("station_id", "step", F.col("predicted_wait_min").between(0, 90).alias("sound"))


@register("s_17_model_save_load", sql="SELECT session_id, true AS same FROM sessions")
def s_17_model_save_load(spark, sf_dir):
    df = _model_frame(spark, sf_dir)
    model = ml.train_rf(df, _FEATS, numTrees=SAVED_TREES)
    path = f"{work_dir(spark, 'model')}/rf"
    ml.save_model(model, path)
    again = ml.load_model(path)
    a = ml.predict(model, df.select("session_id", *_FEATS), _FEATS).select("session_id", F.col("rf_prediction").alias("a"))
    b = ml.predict(again, df.select("session_id", *_FEATS), _FEATS).select("session_id", F.col("rf_prediction").alias("b"))
    return a.join(b, "session_id").select("session_id", (F.col("a") == F.col("b")).alias("same"))
