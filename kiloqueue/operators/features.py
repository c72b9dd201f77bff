"""Feature engineering (X-02..X-11, X-18, J-05, W-01..W-05, P-22, P-23, M-19).

Rolling and lag columns are computed over ranges of (station, time) that carry
copies of the few rows before them (``functions.ranked``), so that a station of
any size is spread over tasks; all of them share one window specification.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiloqueue.functions import geo, ranked, spatial
from kiloqueue.functions.scalars import (
    CYCLIC_PERIODS, cyclic, day_of_week, is_rush_hour, is_weekend, part_of_day, traffic_level,
)
from kiloqueue.operators.clean import drop_columns, numeric_columns
from kiloqueue.session import materialise
from kiloqueue.sources.adapter import CITY_LAT, CITY_LNG

TARGET = "wait_time_minutes"
ROLLING_WINDOWS = {"1h": 6, "3h": 18, "6h": 36}
LAGS = [1, 2, 3, 6, 12, 24]
NEARBY_RADIUS_KM = 2.0
NEARBY_DEFAULT = 3


def add_temporal_features(df: DataFrame, ts_col: str = "session_start") -> DataFrame:
    """X-02..X-06 (cyclic names hour_sin/day_sin/month_sin, quirk K-01)."""
    ts = F.col(ts_col)
    out = df.withColumns({
        "hour_of_day": F.hour(ts),
        "day_of_week": day_of_week(ts),
        "month": F.month(ts),
        "day_of_month": F.dayofmonth(ts),
        "week_of_year": F.weekofyear(ts),
    })
    out = out.withColumns({
        "is_weekend": is_weekend(F.col("day_of_week")),
        "is_rush_hour": is_rush_hour(F.col("hour_of_day")),
        "part_of_day": part_of_day(F.col("hour_of_day")),
    })
    cyc = {}
    for prefix, (col, period) in CYCLIC_PERIODS.items():
        s, c = cyclic(F.col(col), period)
        cyc[f"{prefix}_sin"], cyc[f"{prefix}_cos"] = s, c
    return out.withColumns(cyc)


def add_traffic_features(df: DataFrame) -> DataFrame:
    """X-07, X-08 (absent hour counts as 12, absent weekend as 0)."""
    if "traffic_score" not in df.columns:
        return df
    t = F.col("traffic_score")
    hour = F.col("hour_of_day") if "hour_of_day" in df.columns else F.lit(12)
    wkd = F.col("is_weekend") if "is_weekend" in df.columns else F.lit(0)
    return df.withColumns({
        "traffic_x_hour": t * hour / 24.0,
        "traffic_x_weekend": t * wkd,
        "traffic_level": traffic_level(t),
    })


def utilization_columns(df: DataFrame) -> dict[str, Column]:
    """X-09: total 0 -> 1; avail into [0, total]; utilisation, pct, ratio, queue pressure."""
    avail0 = F.col("available_ports") if "available_ports" in df.columns else F.lit(2)
    total0 = F.col("num_ports") if "num_ports" in df.columns else F.lit(4)
    total = F.when(total0 == 0, F.lit(1)).otherwise(total0)
    avail = F.least(F.greatest(avail0, F.lit(0)), total)
    util = F.least(F.greatest((total - avail) / total, F.lit(0.0)), F.lit(1.0))
    queue = F.col("queue_size") if "queue_size" in df.columns else F.lit(0)
    return {
        "available_ports": avail,
        "num_ports": total,
        "station_utilization": util,
        "utilization_pct": util * 100.0,
        "port_availability_ratio": F.least(F.greatest(avail / total, F.lit(0.0)), F.lit(1.0)),
        "queue_pressure": queue / (avail + 1),
    }


def add_utilization_features(df: DataFrame) -> DataFrame:
    cols = utilization_columns(df)
    # avail/total must be computed from the original values: one select.
    return df.withColumns(cols)


def add_weather_features(df: DataFrame) -> DataFrame:
    """X-11."""
    temp = F.col("temperature_c") if "temperature_c" in df.columns else F.lit(20.0)
    precip = F.col("precipitation_mm") if "precipitation_mm" in df.columns else F.lit(0.0)
    cold = F.coalesce(temp < 5, F.lit(False)).cast("int")
    hot = F.coalesce(temp > 35, F.lit(False)).cast("int")
    rain = F.coalesce(precip > 0.1, F.lit(False)).cast("int")
    return df.withColumns({"is_cold": cold, "is_hot": hot, "is_raining": rain,
                           "weather_demand_boost": rain * 0.15 + cold * 0.10})


def distance_to_centre(df: DataFrame, centre=(CITY_LAT, CITY_LNG)) -> Column:
    """X-18: haversine to the city centre, 5.0 when the table has no coordinates."""
    if "lat" in df.columns and "lng" in df.columns:
        return geo.haversine_km(F.col("lat"), F.col("lng"), F.lit(centre[0]), F.lit(centre[1]))
    return F.lit(5.0)


def nearby_counts(points: DataFrame, stations: DataFrame, radius_km: float = NEARBY_RADIUS_KM,
                  lat: str = "lat", lng: str = "lng") -> DataFrame:
    """J-05 core: for each distinct (lat, lng) of ``points``, the number of
    stations strictly closer than ``radius_km``.

    Query locations and stations are de-duplicated first, so the work depends
    on distinct locations, not on rows; then two trees of boxes are compared
    (``spatial``), so a dense place makes no pairs of all its points.
    """
    locs = points.select(F.col(lat).alias("_qlat"), F.col(lng).alias("_qlng")).where(
        F.col("_qlat").isNotNull() & F.col("_qlng").isNotNull()).distinct()
    st = (stations.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
          .groupBy(F.col("lat").alias("_qlat"), F.col("lng").alias("_qlng")).agg(F.count(F.lit(1)).alias("n")))
    counts = spatial.counts_within(locs, st, radius_km, "_qlat", "_qlng")
    return counts.select("_qlat", "_qlng", F.col("n_near").cast("int").alias("nearby_stations_count"))


def add_geospatial_features(df: DataFrame, stations: DataFrame | None = None,
                            radius_km: float = NEARBY_RADIUS_KM) -> DataFrame:
    """X-18 + J-05: distance to centre; stations within 2 km (null lat -> 3)."""
    out = df.withColumn("distance_to_city_center_km", distance_to_centre(df))
    if stations is None or "lat" not in df.columns:
        return out.withColumn("nearby_stations_count", F.lit(NEARBY_DEFAULT))
    counts = nearby_counts(out, stations, radius_km)
    joined = out.join(counts, (out["lat"] == counts["_qlat"]) & (out["lng"] == counts["_qlng"]), "left")
    n = F.when(F.col("lat").isNull(), F.lit(NEARBY_DEFAULT)).otherwise(
        F.coalesce(F.col("nearby_stations_count"), F.lit(0)))
    return joined.drop("_qlat", "_qlng").withColumn("nearby_stations_count", n.cast("int"))


ORDER = ("session_start", "session_id")


def rolling_columns(target: str, window, windows=ROLLING_WINDOWS) -> dict[str, Column]:
    """W-01, W-02: previous n rows (current excluded), min 1 row; std 0 when undefined."""
    cols = {}
    for label, n in windows.items():
        frame = window.rowsBetween(-n, -1)
        cols[f"rolling_mean_{label}"] = F.avg(target).over(frame)
        cols[f"rolling_std_{label}"] = F.coalesce(F.stddev_samp(target).over(frame), F.lit(0.0))
    return cols


def lag_columns(target: str, window, lags=LAGS) -> dict[str, Column]:
    """W-04."""
    return {f"lag_{k}": F.lag(target, k).over(window) for k in lags}


def add_history_features(df: DataFrame, target: str = TARGET, group_col: str = "station_id", order_cols=ORDER,
                         windows=ROLLING_WINDOWS, lags=LAGS) -> DataFrame:
    """W-01, W-02 and W-04 together: one pass over ranges with the rows before them."""
    w = ranked.halo_window(group_col, order_cols)
    spread = ranked.with_halo(df, group_col, order_cols, max([0, *windows.values(), *lags]))
    return ranked.without_halo(spread.withColumns({**rolling_columns(target, w, windows), **lag_columns(target, w, lags)}))


def add_expanding_features(df: DataFrame, target: str = TARGET, group_col: str = "station_id",
                           order_cols=ORDER) -> DataFrame:
    """W-03: mean / std over all rows up to and including the current one, under every window's name."""
    run = ranked.running_moments(df, group_col, order_cols, target)
    cols = {}
    for label in ROLLING_WINDOWS:
        cols[f"rolling_mean_{label}"] = F.col("run_mean")
        cols[f"rolling_std_{label}"] = F.coalesce("run_std", F.lit(0.0))
    return run.withColumns(cols).drop("run_n", "run_mean", "run_std")


def add_rolling_features(df: DataFrame, group_col: str = "station_id", target: str = TARGET, order_cols=ORDER) -> DataFrame:
    if target not in df.columns:
        return df
    if "session_start" in df.columns and group_col in df.columns:
        return add_history_features(df, target, group_col, order_cols, lags=())
    return add_expanding_features(df, target, group_col, order_cols)


def add_lag_features(df: DataFrame, target: str = TARGET, group_col: str = "station_id", order_cols=ORDER, lags=LAGS) -> DataFrame:
    if target not in df.columns:
        return df
    if group_col not in df.columns:
        return add_global_lags(df, target, order_cols, lags)
    return add_history_features(df, target, group_col, order_cols, windows={}, lags=lags)


def add_global_lags(df: DataFrame, target: str = TARGET, order_cols=ORDER, lags=LAGS) -> DataFrame:
    """W-05: lags over all rows in one order; the table is one key that is spread over ranges like any other."""
    one = df.withColumn("_all", F.lit(0))
    return add_history_features(one, target, "_all", order_cols, windows={}, lags=lags).drop("_all")


def fill_numeric_medians(df: DataFrame, cols=None) -> DataFrame:
    """P-22: +-inf -> null, then each numeric column's nulls -> its median (0 if all null).

    All exact medians come from one pass and become literals; a column without gaps needs none.
    """
    cols = cols if cols is not None else numeric_columns(df)
    if not cols:
        return df

    def clean(c):
        x = F.col(c).cast("double")
        return F.when(F.abs(x) == float("inf"), F.lit(None).cast("double")).otherwise(x)

    cleaned = df.select(*[clean(c).alias(c) for c in cols])
    gaps = cleaned.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first().asDict()
    open_ = [c for c in cols if gaps[c]]
    found = ranked.quantiles(cleaned, open_, [0.5]).collect() if open_ else []  # a row per column
    meds = {r["column"]: r["q"][0] for r in found}
    # Filled columns are double (as pandas makes any column that had a NaN).
    return df.withColumns({c: F.coalesce(clean(c), F.lit(meds.get(c, 0.0))) for c in cols})


def final_corrections(df: DataFrame) -> DataFrame:
    """P-23: avail into [0, ports]; utilisation and pct recomputed."""
    if "available_ports" not in df.columns or "num_ports" not in df.columns:
        return df
    avail = F.least(F.greatest(F.col("available_ports"), F.lit(0)), F.col("num_ports"))
    util = F.least(F.greatest((F.col("num_ports") - avail) / F.col("num_ports"), F.lit(0.0)), F.lit(1.0))
    return df.withColumns({"available_ports": avail, "station_utilization": util,
                           "utilization_pct": util * 100.0})


KEY_COLUMNS = ("station_id", "session_id")


def non_features(df: DataFrame) -> list[str]:
    """Columns that are no model inputs: times and texts."""
    return [c for c, kind in df.dtypes if kind in ("date", "timestamp", "timestamp_ntz", "string")]


def engineer_features(df: DataFrame, stations: DataFrame | None = None, keep_keys: bool = False) -> DataFrame:
    """M-19: the reference pipeline order, as chained transforms.

    ``keep_keys`` keeps ``session_id`` (useful to join results back).  The input is written once: its places are looked up
    before its rows are joined with them.
    """
    out = (materialise(df, "merged").transform(add_temporal_features)
           .transform(add_traffic_features)
           .transform(add_utilization_features)
           .transform(add_weather_features)
           .transform(lambda d: add_geospatial_features(d, stations))
           .transform(add_history_features))
    out = materialise(drop_columns(out, non_features(out)), "features")
    out = final_corrections(fill_numeric_medians(out, numeric_columns(out, exclude=KEY_COLUMNS)))
    return out if keep_keys else drop_columns(out, ["session_id"])
