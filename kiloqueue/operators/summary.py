"""Network, quality and exploratory summaries (A-01..A-24, A-30..A-37, W-07, O-06).

Every summary is one aggregate (partial aggregation before the shuffle) or a
grouped aggregate; exact percentiles come from range-partitioned value counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiloqueue.functions import ranked
from kiloqueue.functions.geo import haversine_km
from kiloqueue.functions.ranked import cumulative_counts, quantiles, running_moments


def mean_9(col) -> Column:
    """Mean, rounded to nine decimals (the order of summation shows only beyond them)."""
    return F.round(F.avg(col), 9)


def utilisation_summary(stations: DataFrame, wait_col: str = "wait_time_minutes") -> DataFrame:
    """A-01: network totals, occupied ports, utilisation %, mean wait, operational count."""
    tp = F.sum(F.coalesce("num_ports", F.lit(0))).cast("long")
    ta = F.sum(F.coalesce("available_ports", F.lit(0))).cast("long")
    wait = F.coalesce(F.col(wait_col), F.lit(0.0)) if wait_col in stations.columns else F.lit(0.0)
    return stations.agg(
        F.count(F.lit(1)).alias("total_stations"),
        F.count_if(F.coalesce(F.col("status").contains("Operational"), F.lit(False))).alias("operational_stations"),
        tp.alias("total_ports"), ta.alias("available_ports"), (tp - ta).alias("occupied_ports"),
        F.round((tp - ta) / F.greatest(tp, F.lit(1)) * 100.0, 1).alias("network_utilization_pct"),
        F.sum(F.coalesce("queue_size", F.lit(0))).cast("long").alias("total_vehicles_waiting"),
        F.round(mean_9(wait), 1).alias("avg_predicted_wait_min"),
    )


def live_summary(snapshot: DataFrame, wait_col: str = "wait_min") -> DataFrame:
    """A-02: mean / max / min wait, stations with and without free ports."""
    return snapshot.agg(
        F.round(mean_9(wait_col), 1).alias("avg_wait_min"),
        F.max(wait_col).alias("max_wait_min"), F.min(wait_col).alias("min_wait_min"),
        F.count_if(F.col("available_ports") > 0).alias("stations_available"),
        F.count_if(F.col("available_ports") == 0).alias("stations_full"),
    )


def kpi_row(stations: DataFrame) -> DataFrame:
    """A-03: sums of ports and waiting vehicles, mean predicted wait, exact status == 'Operational' count."""
    return stations.agg(
        F.count(F.lit(1)).alias("stations"),
        F.sum("num_ports").cast("long").alias("total_ports"),
        F.sum("available_ports").cast("long").alias("available_ports"),
        F.sum("queue_size").cast("long").alias("vehicles_waiting"),
        mean_9("predicted_wait_min").alias("avg_predicted_wait_min"),
        F.count_if(F.col("status") == "Operational").alias("operational"),
    )


def client_stats(stations: DataFrame, wait_col: str = "wait_min", pred_col: str = "predicted_wait_min") -> DataFrame:
    """A-04: mean of per-station utilisation; wait falls through 0/null to the prediction."""
    util = (F.col("num_ports") - F.col("available_ports")) / F.greatest(F.col("num_ports"), F.lit(1))
    w = F.coalesce(F.nullif(F.col(wait_col), F.lit(0.0)), F.nullif(F.col(pred_col), F.lit(0.0)), F.lit(0.0))
    return stations.agg(
        F.count(F.lit(1)).alias("stations"),
        F.round(F.avg(util) * 100.0, 6).alias("avg_utilization_pct"),
        F.round(mean_9(w), 6).alias("avg_wait_min"),
    )


def mobile_summary(stations: DataFrame, lat: float, lng: float, wait_col: str = "wait_min") -> DataFrame:
    """A-05 / O-09: nearest station, number available, rounded mean wait (0/null -> 10)."""
    d = haversine_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))
    w = F.when(F.coalesce(F.col(wait_col), F.lit(0.0)) == 0, F.lit(10.0)).otherwise(F.col(wait_col))
    return stations.agg(
        F.min_by("station_id", d).alias("nearest_station_id"),
        F.count_if((F.col("status") == "Operational") & (F.col("available_ports") > 0)).alias("n_available"),
        F.round(mean_9(w), 0).alias("mean_wait_rounded"),
    )


def wait_by(df: DataFrame, keys, target: str = "wait_time_minutes", with_std: bool = True) -> DataFrame:
    """A-06..A-08, A-10-style grouped mean (and sample std)."""
    aggs = [mean_9(target).alias("mean_wait"), F.count(target).alias("n")]
    if with_std:
        aggs.append(F.round(F.stddev_samp(target), 9).alias("std_wait"))
    return df.groupBy(*keys).agg(*aggs)


def station_profile(sessions: DataFrame) -> DataFrame:
    """A-10: per-station mean wait, session count, mean duration."""
    return sessions.groupBy("station_id").agg(
        mean_9("wait_time_minutes").alias("avg_wait"), F.count(F.lit(1)).alias("session_count"),
        mean_9("session_duration_min").alias("avg_duration"))


def median_by(df: DataFrame, key: str, target: str = "wait_time_minutes") -> DataFrame:
    """A-11: exact median per group."""
    return quantiles(df, [target], [0.5], (key,)).select(key, F.col("q")[0].alias("median_wait"))


def pivot_mean(df: DataFrame, row: str, col: str, values, target: str = "wait_time_minutes") -> DataFrame:
    """A-09 / A-12: row x col mean table; explicit pivot values avoid an extra job."""
    means = df.groupBy(row).pivot(col, list(values)).agg(mean_9(target))
    return means.select(row, *[F.col(f"`{v}`").alias(f"{col}_{v}") for v in values])


def describe(df: DataFrame, cols) -> DataFrame:
    """A-13: count, mean, std, min, 25/50/75 %, max per column (exact, long format)."""
    aggs = [F.struct(F.lit(c).alias("column"), F.count(c).cast("double").alias("count"), mean_9(c).alias("mean"),
                     F.round(F.stddev_samp(c), 9).alias("std"), F.min(c).cast("double").alias("min"),
                     F.max(c).cast("double").alias("max")).alias(c) for c in cols]
    long = df.agg(*aggs).select(F.inline(F.array(*[F.col(c) for c in cols])))
    q = quantiles(df, cols, [0.25, 0.5, 0.75])
    return long.join(q, "column", "left").select(
        "column", "count", "mean", "std", "min", *[F.col("q")[i].alias(p) for i, p in enumerate(("p25", "p50", "p75"))], "max")


def mean_median_p95(df: DataFrame, col: str) -> DataFrame:
    """A-14."""
    q = quantiles(df, [col], [0.5, 0.95])
    means = df.agg(mean_9(col).alias("mean")).withColumn("column", F.lit(col))
    return means.join(q, "column", "left").select("mean", F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"))


def share_below(df: DataFrame, col: str, limits=(15, 30)) -> DataFrame:
    """A-15: percent of rows under each limit."""
    n = F.count(F.lit(1))
    return df.agg(*[(F.count_if(F.col(col) < x) / n * 100.0).alias(f"pct_under_{x}") for x in limits])


def traffic_buckets(df: DataFrame, col: str = "traffic_score", target: str = "wait_time_minutes") -> DataFrame:
    """A-16: 5 right-closed bins of .2 on (0, 1]; 0 itself is outside every bin."""
    x = F.col(col)
    b = (F.when((x > 0.0) & (x <= 0.2), "(0.0, 0.2]").when((x > 0.2) & (x <= 0.4), "(0.2, 0.4]")
         .when((x > 0.4) & (x <= 0.6), "(0.4, 0.6]").when((x > 0.6) & (x <= 0.8), "(0.6, 0.8]")
         .when((x > 0.8) & (x <= 1.0), "(0.8, 1.0]"))
    return (df.withColumn("traffic_bin", b).where(F.col("traffic_bin").isNotNull())
            .groupBy("traffic_bin").agg(mean_9(target).alias("mean_wait"),
                                        F.round(F.stddev_samp(target), 9).alias("std_wait"),
                                        F.count(F.lit(1)).alias("n")))


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """A-17: equal-width bins from min to max, last bin closed.  min/max are a
    one-row scalar subquery; the binning is a grouped count."""
    mm = df.select(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("m")).scalar()
    lo, hi = mm["lo"], mm["hi"]
    width = (hi - lo) / F.lit(float(bins))
    idx = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1)).cast("int"))
    return (df.where(F.col(col).isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
            .withColumn("bin_start", lo + F.col("bin") * width))


def frequency(df: DataFrame, col: str) -> DataFrame:
    """A-18 / A-34: value counts normalised to a probability (the total is one scalar of the table)."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    return g.withColumn("probability", F.col("count") / df.agg(F.count(F.lit(1)).alias("n")).scalar())


def correlation_matrix(df: DataFrame, cols) -> DataFrame:
    """A-21: Pearson r for every pair (pairwise complete rows), one aggregate, long form."""
    pairs = [(a, b) for a in cols for b in cols]
    wide = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    stack = F.explode(F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                                         F.round(F.col(f"{a}__{b}"), 9).alias("r")) for a, b in pairs]))
    return wide.select(stack.alias("p")).select("p.*")


def target_correlation(df: DataFrame, cols, target: str = "wait_time_minutes") -> DataFrame:
    """A-22: correlation of every column with the target, by absolute value desc."""
    wide = df.agg(*[F.corr(c, target).alias(c) for c in cols])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.col(c), 9).alias("r"))
                                           for c in cols])).alias("p")).select("p.*")
    return long.orderBy(F.abs("r").desc_nulls_last())


def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """A-23: least-squares slope / intercept and Pearson r."""
    return df.agg(F.round(F.regr_slope(y, x), 9).alias("slope"), F.round(F.regr_intercept(y, x), 9).alias("intercept"),
                  F.round(F.corr(x, y), 9).alias("r"))


def busiest(df: DataFrame, key: str = "station_id") -> DataFrame:
    """A-24: group with the most rows (ties -> smallest key)."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.max_by(F.col(key), F.struct(F.col("n"), -F.col(key))).alias(key), F.max("n").alias("n"))


def largest_queue(df: DataFrame, order_col: str = "station_id") -> DataFrame:
    """A-30: row with the largest queue; on ties the later row (by ``order_col``) wins."""
    cols = df.columns
    return df.agg(F.max_by(F.struct(*cols), F.struct("queue_size", order_col)).alias("r")).select("r.*")


def running_mean(df: DataFrame, key: str, order_cols, target: str) -> DataFrame:
    """A-32 batch form: incremental mean = expanding average per key."""
    run = running_moments(df, key, order_cols, target)
    return run.withColumn("running_mean", F.round("run_mean", 9)).drop("run_n", "run_mean", "run_std")


def normalise_0_1(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """A-33: min-max to [0, 1], constant column -> 0 (min/max as a one-row scalar subquery)."""
    mm = df.select(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("m")).scalar()
    lo, hi = mm["lo"], mm["hi"]
    return df.withColumn(out or f"{col}_norm",
                         F.when(hi == lo, F.lit(0.0)).otherwise((F.col(col) - lo) / (hi - lo)))


def hourly_traffic_profile(sessions: DataFrame) -> DataFrame:
    """A-36: date x hour mean traffic from observed sessions, with day of week."""
    return (sessions.withColumn("date", F.to_date("session_start"))
            .groupBy("date", F.hour("session_start").alias("hour"))
            .agg(mean_9("traffic_score").alias("traffic_score"))
            .withColumn("day_of_week", F.weekday("date")))


def hourly_demand_curve(sessions: DataFrame, stations: DataFrame) -> DataFrame:
    """A-37: sessions per hour scaled to the busiest hour; free ports = int(ports * (1 - demand)).

    The hourly curve (at most 24 entries) is one array from a scalar subquery,
    exploded per station: no join, and nothing that grows with the data is
    shipped to every task."""
    h = sessions.groupBy(F.hour("session_start").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    curve = h.select(F.collect_list(F.struct("hour", "n")).alias("c")).scalar()
    peak = h.select(F.max("n")).scalar()
    return (stations.select("station_id", "num_ports", F.explode(curve).alias("e"))
            .select("station_id", F.col("e.hour").alias("hour"),
                    (F.col("e.n") / peak).alias("_d"), "num_ports")
            .select("station_id", "hour", F.round("_d", 9).alias("demand"),
                    F.floor(F.col("num_ports") * (F.lit(1.0) - F.col("_d"))).cast("int").alias("free_ports")))


def empirical_cdf(df: DataFrame, col: str) -> DataFrame:
    """W-07: ECDF value -> share of rows <= value, on the distinct values with their cumulative counts."""
    c = cumulative_counts(df, [col])
    return c.select(F.col("value").alias(col), (F.col("upto") / F.col("total")).alias("cdf"))


def first_k(df: DataFrame, k: int, order_cols) -> DataFrame:
    """O-05: the first ``k`` rows in an order (a distributed top-k, no full sort)."""
    return df.orderBy(*order_cols).limit(k)


def naive_error_by_look_back(series: DataFrame, lengths=(6, 12, 18, 24, 36, 48), key: str = "station_id",
                             val_ratio: float = 0.2) -> DataFrame:
    """A-35: RMSE of "the next value is the last one" on the validation sequences, by look-back length.

    A series of n points has n - L sequences of length L; the last ``val_ratio`` of them validate.
    Only series longer than 2 L take part.
    """
    w = Window.partitionBy(key).orderBy("pos")
    errors = series.withColumns({"_n": F.count(F.lit(1)).over(Window.partitionBy(key)),
                                 "_e": F.col("value") - F.lag("value", 1).over(w)})
    each = errors.withColumn("seq_len", F.explode(F.array(*map(F.lit, lengths))))
    train = F.floor((F.col("_n") - F.col("seq_len")) * (1.0 - val_ratio))
    val = each.where((F.col("_n") > 2 * F.col("seq_len")) & (F.col("pos") - F.col("seq_len") >= train))
    return val.groupBy("seq_len").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(F.col("_e") * F.col("_e"))), 9).alias("rmse"))


def client_sort(df: DataFrame, by: str = "wait") -> DataFrame:
    """O-06: client-side orderings with their defaults for missing values."""
    if by == "wait":
        key = F.coalesce(F.nullif(F.col("wait_min"), F.lit(0.0)), F.lit(99.0))
    elif by == "distance":
        key = F.coalesce(F.col("distance_km"), F.lit(99.0))
    elif by == "availability":
        key = -F.coalesce(F.col("available_ports"), F.lit(0))
    else:
        key = F.col("name")
    return df.withColumn("sort_key", key).orderBy(key, "station_id")


def client_places(df: DataFrame, by: str = "wait") -> DataFrame:
    """O-06: each row's ``place`` in a client's ordering, without a window over the whole table."""
    keyed = client_sort(df, by).withColumn("_all", F.lit(0))
    return ranked.row_positions(keyed, "_all", ["sort_key", "station_id"]).withColumnRenamed("row_pos", "place").drop("_all", "key_rows")
