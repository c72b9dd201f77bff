"""Cleaning, merging and splitting (P-01..P-12, P-19..P-21, J-01, J-02, M-01..M-03, M-20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from kiloqueue.functions.ranked import quantiles
from kiloqueue.functions.scalars import clip, lenient_timestamp

# Connector whitelist, status pattern, defaults and the feature list.
KNOWN_CONNECTORS = ["Type 2", "CCS", "CHAdeMO", "Tesla", "J1772", "Unknown"]
OPERATIONAL_PATTERN = "(?i)Operational|Available|Online"
STATION_DEFAULTS = {"num_ports": 2, "connector_type": "Unknown", "power_kw": 50.0, "status": "Unknown"}
MERGE_DEFAULTS = {"traffic_score": 0.3, "temperature_c": 20.0, "precipitation_mm": 0.0,
                  "connector_type": "Unknown"}
TRIM_COLUMNS = ["session_duration_min", "energy_kwh", "wait_time_minutes"]
TARGET = "wait_time_minutes"
FEATURE_COLUMNS = [
    "hour_of_day", "day_of_week", "is_weekend", "month",
    "traffic_score", "station_utilization", "queue_size",
    "available_ports", "total_ports", "avg_session_duration_min",
    "temperature_c", "precipitation_mm", "connector_type_encoded",
    "distance_to_city_center_km", "nearby_stations_count",
    "rolling_mean_1h", "rolling_mean_3h", "rolling_std_1h",
    "hour_sin", "hour_cos", "day_sin", "day_cos",
]
STATION_JOIN_COLUMNS = ["station_id", "lat", "lng", "num_ports", "connector_type", "power_kw",
                        "is_operational"]


# --- small helpers --------------------------------------------------------------

def ensure_columns(df: DataFrame, cols, default=0.0) -> DataFrame:
    """P-19: add absent columns with a default (decided from the schema, not per row)."""
    missing = {c: F.lit(default) for c in cols if c not in df.columns}
    return df.withColumns(missing) if missing else df


def clip_column(df: DataFrame, col: str, lo: float = 0.0, hi: float = 120.0) -> DataFrame:
    """P-20."""
    return df.withColumn(col, clip(F.col(col), lo, hi)) if col in df.columns else df


def drop_columns(df: DataFrame, cols) -> DataFrame:
    """P-12: drop, tolerating absent names."""
    return df.drop(*[c for c in cols if c in df.columns])


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def feature_columns(df: DataFrame, target: str = TARGET) -> list[str]:
    """P-21: FEATURE_COLUMNS present in ``df``, else every numeric column but the target."""
    present = [c for c in FEATURE_COLUMNS if c in df.columns]
    return present or numeric_columns(df, exclude=(target,))


# --- stations -----------------------------------------------------------------

def _default(df: DataFrame, col: str, value, cast: str | None = None) -> Column:
    base = F.col(col) if col in df.columns else F.lit(None)
    out = F.coalesce(base, F.lit(value))
    return out.cast(cast) if cast else out


def connector_whitelist(col) -> Column:
    """P-04: keep the text if it contains any known connector name, else 'Unknown'."""
    c = col if isinstance(col, Column) else F.col(col)
    hit = F.lit(False)
    for k in KNOWN_CONNECTORS:
        hit = hit | F.coalesce(c.contains(k), F.lit(False))
    return F.when(hit, c).otherwise(F.lit("Unknown"))


def is_operational(col) -> Column:
    """P-05: case-insensitive match, null -> 0."""
    c = col if isinstance(col, Column) else F.col(col)
    return F.coalesce(c.rlike(OPERATIONAL_PATTERN), F.lit(False)).cast("int")


def clean_stations(df: DataFrame) -> DataFrame:
    """P-01..P-05."""
    out = (
        df.na.drop(subset=["lat", "lng"])
        .where(F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180))
    )
    out = out.withColumns({
        "num_ports": _default(out, "num_ports", 2).cast("int"),
        "connector_type": _default(out, "connector_type", "Unknown", "string"),
        "power_kw": _default(out, "power_kw", 50.0, "double"),
        "status": _default(out, "status", "Unknown", "string"),
    })
    return out.withColumns({
        "connector_type": connector_whitelist("connector_type"),
        "is_operational": is_operational("status"),
    })


# --- sessions -----------------------------------------------------------------

def standardise_session_columns(df: DataFrame) -> DataFrame:
    """X-01 + P-06: lenient parse of time columns, start_time -> session_start."""
    out = df
    for c in ("start_time", "end_time", "datetime", "Datetime"):
        if c in out.columns:
            out = out.withColumn(c, lenient_timestamp(F.col(c)))
    if "start_time" in out.columns:
        out = out.withColumnRenamed("start_time", "session_start")
    if "session_start" not in out.columns and "datetime" in out.columns:
        out = out.withColumn("session_start", F.col("datetime"))
    return out


def percentile_trim(df: DataFrame, cols=TRIM_COLUMNS, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """P-07: keep rows whose value lies within the [lo, hi] quantiles, column by column.

    Each later column's quantiles are computed after the earlier filters.  The
    exact bounds (two numbers a column) become literals, so the result is one
    scan with plain range filters.
    """
    out = df
    for c in cols:
        if c not in out.columns:
            continue
        bounds = quantiles(out, [c], [lo, hi]).first()
        # a column without any value has no bounds, and its nulls pass no range
        out = out.where(F.col(c).between(*bounds["q"]) if bounds else F.lit(False))
    return out


def heuristic_wait(df: DataFrame) -> Column:
    """P-09: queue/(avail+1)*duration + traffic*5, defaults 0/2/30/0.3, clip [0,120], round 1."""
    q = _default(df, "queue_size", 0.0, "double")
    a = _default(df, "available_ports", 2.0, "double")
    d = _default(df, "session_duration_min", 30.0, "double")
    t = _default(df, "traffic_score", 0.3, "double")
    wait = F.try_divide(q, a + 1.0) * d + t * 5.0
    return F.round(clip(wait, 0.0, 120.0), 1)


def clean_sessions(df: DataFrame) -> DataFrame:
    """P-06, P-07, P-09, P-08 in the reference order."""
    out = percentile_trim(standardise_session_columns(df))
    if TARGET not in out.columns:
        out = out.withColumn(TARGET, heuristic_wait(out))
    return out.na.drop(subset=[TARGET])


def clean_traffic(df: DataFrame) -> DataFrame:
    """Traffic readings: score defaults to .3 and is clipped to [0, 1]."""
    return df.withColumn("traffic_score", clip(_default(df, "traffic_score", 0.3, "double"), 0.0, 1.0))


# --- merge (J-01, J-02, P-10, P-11) ---------------------------------------------

def merge_datasets(stations: DataFrame, sessions: DataFrame, traffic: DataFrame | None = None,
                   weather: dict | None = None) -> DataFrame:
    """Sessions enriched with station metadata, traffic and constant weather.

    J-01 is a left equi join on station_id with the station columns pruned
    first; the join strategy is left to the planner/AQE (broadcast when the
    station side is under the broadcast threshold, shuffle join otherwise).
    Connector type is ``coalesce(session, station)`` (quirk K-03).  J-02 keeps
    the session's traffic score and falls back to the station reading;
    duplicate traffic rows fan out as in the reference.
    """
    df = sessions
    if "station_id" in df.columns:
        keep = [c for c in STATION_JOIN_COLUMNS if c in stations.columns]
        st = stations.select(*[F.col(c).alias(c if c == "station_id" or c not in df.columns else f"_st_{c}")
                               for c in keep])
        df = df.join(st, "station_id", "left")
        for c in keep:
            if c != "station_id" and f"_st_{c}" in df.columns:
                df = df.withColumn(c, F.coalesce(F.col(c), F.col(f"_st_{c}"))).drop(f"_st_{c}")
    if traffic is not None and "station_id" in traffic.columns:
        tr = traffic.select("station_id", F.col("traffic_score").alias("_traffic"))
        df = df.join(tr, "station_id", "left")
        base = F.col("traffic_score") if "traffic_score" in df.columns else F.lit(None)
        df = df.withColumn("traffic_score", F.coalesce(base, F.col("_traffic"))).drop("_traffic")
    for k, v in (weather or {}).items():
        if k not in df.columns:
            df = df.withColumn(k, F.lit(v))
    return df.withColumns({c: _default(df, c, v) for c, v in MERGE_DEFAULTS.items()})


# --- encode and split (M-01..M-03) -------------------------------------------------

def label_codes(df: DataFrame, col: str = "connector_type") -> DataFrame:
    """M-01 codes: distinct values in alphabetical order -> 0..k-1.

    The distinct set is aggregated first (map-side partial aggregation), so
    the ranking window only sees one row per category.
    """
    cats = df.select(F.col(col).cast("string").alias(col)).distinct()
    return cats.select(F.col(col).alias("_category"),
                       (F.row_number().over(Window.orderBy(F.col(col).asc_nulls_first())) - 1)
                       .cast("int").alias(f"{col}_encoded"))


def encode_categoricals(df: DataFrame, col: str = "connector_type", codes: DataFrame | None = None) -> DataFrame:
    """M-01: attach the label code; values unseen in ``codes`` get 0 (inference rule)."""
    if col not in df.columns:
        return df
    codes = codes if codes is not None else label_codes(df, col)
    joined = df.join(codes, F.col(col).cast("string").eqNullSafe(F.col("_category")), "left")  # strategy: the planner's
    return (joined.drop("_category")
            .withColumn(f"{col}_encoded", F.coalesce(F.col(f"{col}_encoded"), F.lit(0))))


def split_bucket(key: Column, buckets: int = 100) -> Column:
    """Deterministic bucket of an integral key (independent of partitioning and
    of task order, so a retried task gives the same split)."""
    return F.pmod(key.cast("long") * 7919, F.lit(buckets))


def train_test_split(df: DataFrame, key: str = "session_id", train_fraction: float = 0.8):
    """M-03 / U-03: disjoint 80/20 split by a key hash; the union is the input."""
    b = split_bucket(F.col(key))
    cut = int(round(train_fraction * 100))
    return df.where(b < cut), df.where(b >= cut)


def scale_features(train: DataFrame, test: DataFrame, cols) -> tuple[DataFrame, DataFrame]:
    """M-02: standardise with train mean and population std (as sklearn's StandardScaler)."""
    stats = train.select(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c)
                                    for c in cols]).alias("st")).scalar()

    def apply(df):
        return df.withColumns({
            c: (F.col(c) - stats[c]["m"]) / F.when(stats[c]["s"] == 0, F.lit(1.0)).otherwise(stats[c]["s"])
            for c in cols if c in df.columns})

    return apply(train), apply(test)


def preprocess(raw_stations: DataFrame, raw_sessions: DataFrame, traffic: DataFrame | None = None,
               weather: dict | None = None):
    """M-20: clean stations and sessions, merge, encode, split -> (train, test, merged)."""
    st = clean_stations(raw_stations)
    ses = clean_sessions(raw_sessions)
    tr = clean_traffic(traffic) if traffic is not None else None
    merged = encode_categoricals(merge_datasets(st, ses, tr, weather or {"temperature_c": 20.0,
                                                                         "precipitation_mm": 0.0}))
    train, test = train_test_split(merged)
    return train, test, merged
