"""Readers and writers (S-01..S-15, S-17 via ``operators.ml``).

Landed files replace the reference's HTTP collectors: JSON payloads are read
with an explicit schema (no inference), flattened with native struct / array
functions, and written back as parquet or CSV.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, LongType, StringType, StructField, StructType)

from kiloqueue.functions.scalars import congestion_score

_TITLE = StructType([StructField("Title", StringType())])

STATION_JSON_SCHEMA = StructType([
    StructField("ID", LongType()),
    StructField("AddressInfo", StructType([
        StructField("Title", StringType()), StructField("Latitude", DoubleType()),
        StructField("Longitude", DoubleType()), StructField("AddressLine1", StringType()),
        StructField("Town", StringType()),
        StructField("Country", StructType([StructField("ISOCode", StringType())]))])),
    StructField("Connections", ArrayType(StructType([
        StructField("ConnectionType", _TITLE), StructField("PowerKW", DoubleType())]))),
    StructField("StatusType", _TITLE),
    StructField("UsageType", _TITLE),
    StructField("OperatorInfo", _TITLE),
    StructField("DateCreated", StringType()),
])

TRAFFIC_JSON_SCHEMA = StructType([StructField("flowSegmentData", StructType([
    StructField("currentSpeed", DoubleType()), StructField("freeFlowSpeed", DoubleType()),
    StructField("confidence", DoubleType())]))])

WEATHER_JSON_SCHEMA = StructType([
    StructField("main", StructType([StructField("temp", DoubleType()), StructField("feels_like", DoubleType()),
                                    StructField("humidity", DoubleType())])),
    StructField("rain", StructType([StructField("1h", DoubleType()), StructField("3h", DoubleType())])),
    StructField("wind", StructType([StructField("speed", DoubleType())])),
    StructField("weather", ArrayType(StructType([StructField("main", StringType())]))),
    StructField("dt_txt", StringType()),
])

FORECAST_JSON_SCHEMA = StructType([StructField("list", ArrayType(WEATHER_JSON_SCHEMA))])


def _title(c: Column, default: str) -> Column:
    return F.coalesce(c.getField("Title"), F.lit(default))


def flatten_stations(payload: Column, parsed: bool = False) -> list[Column]:
    """S-01 / N-01: station payload (JSON text, or a struct if ``parsed``) -> flat columns.  A missing connection list
    counts as one empty connection; an empty list as zero ports."""
    p = payload if parsed else F.from_json(payload, STATION_JSON_SCHEMA)
    addr = p.getField("AddressInfo")
    conns = p.getField("Connections")
    first = F.get(conns, 0)
    return [
        p.getField("ID").alias("station_id"),
        F.coalesce(addr.getField("Title"), F.lit("Unknown")).alias("name"),
        addr.getField("Latitude").alias("lat"), addr.getField("Longitude").alias("lng"),
        F.coalesce(addr.getField("AddressLine1"), F.lit("")).alias("address"),
        F.coalesce(addr.getField("Town"), F.lit("")).alias("city"),
        F.coalesce(addr.getField("Country").getField("ISOCode"), F.lit("")).alias("country"),
        F.when(conns.isNull(), F.lit(1)).otherwise(F.size(conns)).cast("int").alias("num_ports"),
        F.coalesce(first.getField("ConnectionType").getField("Title"), F.lit("Unknown")).alias("connector_type"),
        first.getField("PowerKW").alias("power_kw"),
        _title(p.getField("StatusType"), "Unknown").alias("status"),
        _title(p.getField("UsageType"), "Public").alias("usage_type"),
        F.try_to_timestamp(p.getField("DateCreated")).alias("date_created"),
        _title(p.getField("OperatorInfo"), "").alias("operator"),
    ]


def read_station_json(spark: SparkSession, path: str) -> DataFrame:
    """S-01 from landed files (one JSON document per line), explicit schema."""
    raw = spark.read.schema(STATION_JSON_SCHEMA).json(path)
    return raw.select(*flatten_stations(F.struct(*[F.col(c) for c in raw.columns]), parsed=True))


def flatten_traffic(payload: Column) -> list[Column]:
    """S-06: speeds with defaults (0 current, 50 free flow, 0 confidence) and
    the congestion score X-10 (missing speeds count as 50 there)."""
    f = F.from_json(payload, TRAFFIC_JSON_SCHEMA).getField("flowSegmentData")
    cur, free = f.getField("currentSpeed"), f.getField("freeFlowSpeed")
    return [F.coalesce(cur, F.lit(0.0)).alias("current_speed_kmh"),
            F.coalesce(free, F.lit(50.0)).alias("free_flow_speed_kmh"),
            F.coalesce(f.getField("confidence"), F.lit(0.0)).alias("confidence"),
            congestion_score(cur, free).alias("traffic_score")]


def flatten_weather(payload: Column) -> list[Column]:
    """S-08: nested defaults 20 C / 50 % / 0 mm / 0 m/s / 'Clear'."""
    w = F.from_json(payload, WEATHER_JSON_SCHEMA)
    main = w.getField("main")
    return [F.coalesce(main.getField("temp"), F.lit(20.0)).alias("temperature_c"),
            F.coalesce(main.getField("feels_like"), F.lit(20.0)).alias("feels_like_c"),
            F.coalesce(main.getField("humidity"), F.lit(50.0)).alias("humidity_pct"),
            F.coalesce(w.getField("rain").getField("1h"), F.lit(0.0)).alias("precipitation_mm"),
            F.coalesce(w.getField("wind").getField("speed"), F.lit(0.0)).alias("wind_speed_ms"),
            F.coalesce(F.get(w.getField("weather"), 0).getField("main"), F.lit("Clear")).alias("weather_main")]


def explode_forecast(df: DataFrame, payload: str, keys=()) -> DataFrame:
    """S-09 / N-02: 3-hour forecast list -> one row per item."""
    items = F.from_json(F.col(payload), FORECAST_JSON_SCHEMA).getField("list")
    e = df.select(*keys, F.explode(items).alias("it"))
    return e.select(*keys, F.try_to_timestamp(F.col("it.dt_txt")).alias("datetime"),
                    F.col("it.main.temp").alias("temperature_c"),
                    F.coalesce(F.col("it.rain.3h"), F.lit(0.0)).alias("precipitation_mm"),
                    F.get(F.col("it.weather"), 0).getField("main").alias("weather_main"))


STATION_CSV_RENAMES = {"Latitude": "lat", "Longitude": "lng", "Name": "name", "ID": "station_id"}


def read_csv(spark: SparkSession, path: str, schema: str | StructType, renames: dict | None = None) -> DataFrame:
    """S-02..S-05, S-15: CSV with header and a declared schema (no inference)."""
    df = spark.read.option("header", True).schema(schema).csv(path)
    return df.withColumnsRenamed(renames) if renames else df


def read_hourly_energy(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S-04: hourly energy with its ``Datetime`` parsed into a key column."""
    df = read_csv(spark, path, schema)
    return df.withColumn("Datetime", F.try_to_timestamp(F.col("Datetime").cast("string")))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def load_raw(spark: SparkSession, paths: dict[str, str], schemas: dict[str, str]) -> dict[str, DataFrame]:
    """S-10: read the raw tables that exist, skip the absent ones (any other fault is raised)."""
    return {name: read_csv(spark, p, schemas[name]) for name, p in paths.items() if path_exists(spark, p)}


def read_station_traffic(spark: SparkSession, path: str) -> DataFrame:
    """S-07: landed traffic answers of many stations, one line {station_id, payload} each -> one row per station."""
    raw = spark.read.schema("station_id long, payload string").json(path)
    return raw.select("station_id", *flatten_traffic(F.col("payload")))


def read_weather_json(spark: SparkSession, path: str) -> DataFrame:
    """S-08: landed current-weather answers, one line {city, payload} each."""
    raw = spark.read.schema("city long, payload string").json(path)
    return raw.select("city", *flatten_weather(F.col("payload")))


def read_sessions_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S-15: sessions CSV with ``start_time`` parsed leniently."""
    df = read_csv(spark, path, schema)
    return df.withColumn("start_time", F.try_to_timestamp(F.col("start_time").cast("string")))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=(), mode: str = "overwrite") -> None:
    """S-11 / S-12: sink, optionally partitioned (partition pruning on read)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def load_or_compute(spark: SparkSession, path: str, compute) -> DataFrame:
    """S-13: read the stored table if present, else compute, store and read it back.

    A table that is there but can't be read is an error, never a reason to write over it.
    """
    if not path_exists(spark, path):
        write_table(compute(), path, mode="errorifexists")
    return spark.read.parquet(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """S-14: metrics rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S-14: metrics rows read back with their schema."""
    return spark.read.schema(schema).json(path)
