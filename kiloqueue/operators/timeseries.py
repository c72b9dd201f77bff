"""Time-series operators (T-01..T-07, W-08..W-12), per station.

Everything starts from the hourly series of T-01, which is a grouped
aggregate: its size is stations x hours of the observed span, independent of
how many sessions a station has, so per-station windows over it stay small
even for the busiest station.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiloqueue.functions import ranked
from kiloqueue.session import shuffle_partitions


def _w(key: str = "station_id", order: str = "pos") -> Window:
    return Window.partitionBy(key).orderBy(order)


def hourly_series(sessions: DataFrame, value: str = "wait_time_minutes", key: str = "station_id",
                  ts: str = "session_start") -> DataFrame:
    """T-01: hourly mean per key, on a continuous hourly calendar from the key's
    first to last hour, gaps forward-filled (W-09); ``pos`` = hour index from 0."""
    hourly = (sessions.groupBy(key, F.date_trunc("hour", ts).alias("hour_ts"))
              .agg(F.avg(value).alias("_v")))
    # a row a key is few bytes, but its calendar is long: the number of tasks is stated
    # (another one than the session's, as Spark takes a repartition like the aggregate's own for needless)
    n = 2 * shuffle_partitions(sessions.sparkSession)
    span = hourly.groupBy(key).agg(F.min("hour_ts").alias("_lo"), F.max("hour_ts").alias("_hi")).repartition(n, key)
    cal = span.select(key, F.posexplode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 HOUR"))).alias("pos", "hour_ts"))
    joined = cal.join(hourly, [key, "hour_ts"], "left").repartition(n, key)
    ffill = F.last("_v", ignorenulls=True).over(_w(key).rowsBetween(Window.unboundedPreceding, 0))
    return joined.select(key, "pos", "hour_ts", ffill.alias("value"), F.col("_v").isNull().alias("filled"))


def rolling_24(series: DataFrame, n: int = 24, key: str = "station_id") -> DataFrame:
    """W-08: n-point rolling mean / std, null until n rows exist."""
    fr = _w(key).rowsBetween(-(n - 1), 0)
    full = F.count("value").over(fr) == n
    return series.withColumns({"rolling_mean": F.when(full, F.avg("value").over(fr)),
                               "rolling_std": F.when(full, F.stddev_samp("value").over(fr))})


def lag_pairs(series: DataFrame, key: str = "station_id") -> DataFrame:
    """W-10: (x_t, x_t+1) pairs, last row dropped."""
    return (series.withColumn("next_value", F.lead("value", 1).over(_w(key)))
            .where(F.col("next_value").isNotNull()).select(key, "pos", "value", "next_value"))


def decompose(series: DataFrame, period: int = 24, key: str = "station_id") -> DataFrame:
    """T-02: additive decomposition (centred 2 x period moving average trend,
    phase-mean seasonal centred to zero, residual).  Keys with fewer than
    2 x period points are left out."""
    half = period // 2
    w = _w(key)
    fr = w.rowsBetween(-half, half)
    if period % 2 == 0:
        full = F.count("value").over(fr) == (2 * half + 1)
        total = F.sum("value").over(fr) - 0.5 * F.lag("value", half).over(w) - 0.5 * F.lead("value", half).over(w)
    else:
        full = F.count("value").over(fr) == period
        total = F.sum("value").over(fr)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    d = (series.withColumn("_n", n).where(F.col("_n") >= 2 * period)
         .withColumn("trend", F.when(full, total / float(period)))
         .withColumn("phase", F.col("pos") % period))
    phase_mean = (d.groupBy(key, "phase").agg(F.avg(F.col("value") - F.col("trend")).alias("_pm")))
    centred = phase_mean.withColumn("seasonal", F.col("_pm") - F.avg("_pm").over(Window.partitionBy(key)))
    out = d.join(centred.select(key, "phase", "seasonal"), [key, "phase"])
    return out.select(key, "pos", "value", "trend", "seasonal",
                      (F.col("value") - F.col("trend") - F.col("seasonal")).alias("resid"))


def dickey_fuller(series: DataFrame, key: str = "station_id") -> DataFrame:
    """T-03 (lag 0, constant): regress dy_t on y_{t-1}; t = slope / se(slope).
    Compare with the 5 % critical value -2.86."""
    d = (series.withColumn("_ylag", F.lag("value", 1).over(_w(key)))
         .withColumn("_dy", F.col("value") - F.col("_ylag")).where(F.col("_ylag").isNotNull()))
    g = d.groupBy(key).agg(F.regr_slope("_dy", "_ylag").alias("slope"), F.regr_sxx("_dy", "_ylag").alias("sxx"),
                           F.regr_syy("_dy", "_ylag").alias("syy"), F.regr_sxy("_dy", "_ylag").alias("sxy"),
                           F.regr_count("_dy", "_ylag").alias("n"))
    ssr = F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")
    se = F.sqrt(ssr / (F.col("n") - 2) / F.col("sxx"))
    return g.select(key, "n", F.col("slope"), F.try_divide(F.col("slope"), se).alias("adf_stat"),
                    (F.try_divide(F.col("slope"), se) < -2.86).alias("stationary_5pct"))


def kpss(series: DataFrame, lags: int = 12, key: str = "station_id") -> DataFrame:
    """T-04 level KPSS with a fixed Bartlett lag: sum(S_t^2) / (n^2 * lrv).  Critical value .463."""
    w = _w(key)
    mean = F.avg("value").over(Window.partitionBy(key))
    d = series.withColumn("_e", F.col("value") - mean)
    d = d.withColumn("_s", F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    prods = {f"_p{k}": F.col("_e") * F.lag("_e", k).over(w) for k in range(1, lags + 1)}
    d = d.withColumns(prods)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(F.col("_s") * F.col("_s")).alias("ss"),
            F.sum(F.col("_e") * F.col("_e")).alias("e2")]
    aggs += [F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)).alias(f"c{k}") for k in range(1, lags + 1)]
    g = d.groupBy(key).agg(*aggs)
    lrv = F.col("e2")
    for k in range(1, lags + 1):
        lrv = lrv + 2.0 * (1.0 - k / (lags + 1.0)) * F.col(f"c{k}")
    lrv = lrv / F.col("n")
    stat = F.col("ss") / (F.col("n") * F.col("n") * lrv)
    return g.select(key, "n", stat.alias("kpss_stat"), (stat < 0.463).alias("stationary_5pct"))


# Published polynomials of the Dickey-Fuller distribution (one series, constant) and KPSS level quantiles.
ADF_SMALL, ADF_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
ADF_STAR, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74
KPSS_VALUES, KPSS_P = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)


def most_lags(n: int) -> int:
    """The largest lag order tried for ``n`` values."""
    return max(min(int(np.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2), 0)


def adf_p(stat: float) -> float:
    if stat > ADF_MAX or stat < ADF_MIN:
        return float(stat > ADF_MAX)
    poly = ADF_SMALL if stat <= ADF_STAR else ADF_LARGE
    return 0.5 * (1 + math.erf(sum(c * stat**k for k, c in enumerate(poly)) / math.sqrt(2)))


def _eliminate(gram: np.ndarray, column: int) -> np.ndarray:
    """The sums of squares and products of what a regression on ``column`` leaves."""
    pivot = gram[column, column]
    return gram if pivot <= 0 else gram - np.outer(gram[:, column], gram[column]) / pivot


def _best_adf(grams: np.ndarray, n: int) -> tuple[int, float]:
    """Lag order of least AIC and the t statistic of the level, from the sums by lags at hand.

    ``grams[a]``: the rows with ``a`` earlier differences (the last: or more) of (1, level, differences by lag, difference).
    All orders are compared on the rows that have every lag; the chosen one is fitted to all rows that have its lags.
    """
    top, y = most_lags(n), grams.shape[1] - 1
    full, rows, best = grams[top:].sum(0), n - 1 - top, (np.inf, 0)
    left = _eliminate(_eliminate(full, 0), 1)
    for order in range(top + 1):
        if order:
            left = _eliminate(left, 1 + order)
        if left[y, y] > 0:
            best = min(best, (rows * np.log(left[y, y] / rows) + 2 * (2 + order), order))
    order = best[1]
    left = _eliminate(grams[order:].sum(0), 0)
    for k in range(order):
        left = _eliminate(left, 2 + k)
    level, cross = left[1, 1], left[1, y]
    rest, free = left[y, y] - cross * cross / level if level > 0 else 0.0, n - 1 - order - (2 + order)
    return order, cross / level / math.sqrt(rest / free / level) if rest > 0 and free > 0 else math.nan


def adf(series: DataFrame, key: str = "station_id") -> DataFrame:
    """T-03: augmented Dickey-Fuller with a constant, the lag order by AIC: key, n, lags, adf_stat, p_value.

    The sums of squares and products of the rows with all lags go out as one array per key and Arrow batch, the few rows
    with less lags at hand (one for each number) as they are; every lag order is solved from them, so the values are read once.
    """
    top = most_lags(series.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0)
    size = top + 3
    w = _w(key)
    d = series.withColumn("_level", F.lag("value", 1).over(w)).withColumn("_d", F.col("value") - F.col("_level"))
    past = [f"_d{k}" for k in range(1, top + 1)]
    rows = d.where(F.col("_level").isNotNull() & F.col(key).isNotNull()).withColumns(
        {"_have": F.least(F.row_number().over(w) - 1, F.lit(top)), **{c: F.coalesce(F.lag("_d", k).over(w), F.lit(0.0)) for k, c in enumerate(past, 1)}})

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = np.column_stack([np.ones(len(pdf)), pdf[["_level", *past, "_d"]].to_numpy(float)])
            full = pdf["_have"].to_numpy() == top
            part, out = pdf.loc[~full, [key]].assign(a=pdf.loc[~full, "_have"], v=list(z[~full])), []
            whole = z[full]
            for k, at in pdf[full].groupby(key).indices.items():
                y = whole[at]
                out.append((k, top, (y.T @ y).ravel()))
            yield pd.concat([part, pd.DataFrame(out, columns=[key, "a", "v"])]) if out else part

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        grams = np.zeros((top + 1, size, size))
        for a, v in zip(pdf["a"], pdf["v"]):
            grams[a] += np.outer(v, v) if a < top else np.reshape(v, (size, size))
        n = int(round(grams[:, 0, 0].sum())) + 1
        order, stat = _best_adf(grams, n)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n": [n], "lags": [order], "adf_stat": [stat], "p_value": [adf_p(stat)]})

    kind = series.schema[key].dataType.simpleString()
    parts = rows.select(key, "_have", "_level", *past, "_d").mapInPandas(sums, f"{key} {kind}, a int, v array<double>")
    return parts.groupBy(key).applyInPandas(solve, f"{key} {kind}, n long, lags int, adf_stat double, p_value double")


def _lag_products(series: DataFrame, lags: int, key: str) -> DataFrame:
    """Per key: n, ss (squared partial sums of the deviations from the mean), e2, and ``c``, the products by lag from 1."""
    w = _w(key)
    d = series.withColumn("_e", F.col("value") - F.avg("value").over(Window.partitionBy(key)))
    d = d.withColumn("_s", F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumns({f"_p{k}": F.col("_e") * F.lag("_e", k).over(w) for k in range(1, lags + 1)})
    c = [F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)) for k in range(1, lags + 1)]
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_s") * F.col("_s")).alias("ss"), F.sum(F.col("_e") * F.col("_e")).alias("e2"),
                              (F.array(*c) if c else F.array().cast("array<double>")).alias("c"))


def _weighted(c: Column, upto: Column, weight) -> Column:
    """The sum over lags 1 to ``upto`` of weight(lag) times the lag's product."""
    return F.aggregate(F.transform(c, lambda x, i: F.when(i < upto, weight(i + 1) * x).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def kpss_auto(series: DataFrame, key: str = "station_id") -> DataFrame:
    """T-04: level KPSS with the bandwidth drawn from the data: key, n, lags, kpss_stat, p_value (within the table's ends)."""
    longest = series.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    first = _lag_products(series, int(longest ** (2.0 / 9.0)), key)
    upto = F.floor(F.pow(F.col("n").cast("double"), F.lit(2.0 / 9.0)))
    s0 = F.col("e2") / F.col("n") + _weighted(F.col("c"), upto, lambda k: F.lit(1.0)) / (F.col("n") / 2.0)
    s1 = _weighted(F.col("c"), upto, lambda k: k.cast("double")) / (F.col("n") / 2.0)
    share = F.try_divide(s1, s0)
    third = F.lit(1.0 / 3.0)
    wide = F.floor(1.1447 * F.pow(share * share, third) * F.pow(F.col("n").cast("double"), third))
    chosen = first.select(key, F.least(F.coalesce(wide, F.lit(0)), F.col("n") - 1).cast("int").alias("lags"))
    sums = _lag_products(series, chosen.agg(F.max("lags")).first()[0] or 0, key).join(chosen, key)
    spread = F.col("e2") + 2.0 * _weighted(F.col("c"), F.col("lags"), lambda k: 1.0 - k / (F.col("lags") + 1.0))
    out = sums.select(key, "n", "lags", F.try_divide(F.col("ss"), F.col("n") * spread).alias("kpss_stat"))
    stat = F.col("kpss_stat")
    p = F.when(stat <= KPSS_VALUES[0], KPSS_P[0])
    for v0, v1, p0, p1 in zip(KPSS_VALUES, KPSS_VALUES[1:], KPSS_P, KPSS_P[1:]):
        p = p.when(stat <= v1, p0 + (stat - v0) / (v1 - v0) * (p1 - p0))
    return out.withColumn("p_value", p.when(stat > KPSS_VALUES[-1], KPSS_P[-1]))


def acf(series: DataFrame, nlags: int = 48, key: str = "station_id") -> DataFrame:
    """T-05 / W-14: autocorrelation for lags 0..nlags with the +-1.96/sqrt(n) band (long form)."""
    w = _w(key)
    d = series.withColumn("_x", F.col("value") - F.avg("value").over(Window.partitionBy(key)))
    d = d.withColumns({f"_l{k}": F.lag("_x", k).over(w) for k in range(1, nlags + 1)})
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(F.col("_x") * F.col("_x")).alias("c0")]
    aggs += [F.coalesce(F.sum(F.col("_x") * F.col(f"_l{k}")), F.lit(0.0)).alias(f"c{k}")
             for k in range(1, nlags + 1)]
    g = d.groupBy(key).agg(*aggs)
    arr = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"c{k}") / F.col("c0")).alias("acf"))
                    for k in range(0, nlags + 1)])
    return (g.select(key, "n", F.explode(arr).alias("a"))
            .select(key, F.col("a.lag").alias("lag"), F.col("a.acf").alias("acf"),
                    (F.lit(1.96) / F.sqrt("n")).alias("band")))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def pacf(acf_long: DataFrame, key: str = "station_id") -> DataFrame:
    """T-06: partial autocorrelation by the Durbin-Levinson recursion, folded over each key's array of
    autocorrelations (nlags + 1 values).

    ``phi``: the coefficients of the last order, ``v``: its share of unexplained variance, ``out``: the answer
    so far.  Once nothing is left to explain (v = 0) the rest is 0.
    """
    r = F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda e: e["acf"])

    def order(state: Column, k: Column, acf: Column) -> Column:
        missed = F.get(acf, k) - _dot(state["phi"], F.reverse(F.slice(acf, F.lit(2), k - 1)))
        new = F.when(state["v"] != 0, missed / F.when(state["v"] != 0, state["v"])).otherwise(F.lit(0.0))
        return _let(F.struct(new.alias("p"), state.alias("s")), lambda e: F.struct(
            F.concat(F.zip_with(e["s"]["phi"], F.reverse(e["s"]["phi"]), lambda x, y: x - e["p"] * y), F.array(e["p"])).alias("phi"),
            (e["s"]["v"] * (1.0 - e["p"] * e["p"])).alias("v"), F.concat(e["s"]["out"], F.array(e["p"])).alias("out")))

    g = acf_long.groupBy(key).agg(r.alias("_r")).where(F.size("_r") > 1)
    start = F.struct(F.array().cast("array<double>").alias("phi"), F.get("_r", F.lit(0)).alias("v"), F.array(F.lit(1.0)).alias("out"))
    done = g.select(key, F.aggregate(F.sequence(F.lit(1), F.size("_r") - 1), start, lambda s, k: order(s, k, F.col("_r")), lambda s: s["out"]).alias("_p"))
    return done.select(key, F.posexplode("_p").alias("lag", "pacf"))


def sequence_windows(df: DataFrame, features, target: str, seq_len: int = 24, key: str = "station_id",
                     order_cols=("session_start", "session_id")) -> DataFrame:
    """W-11: previous ``seq_len`` feature vectors -> X, current target -> y; the
    first ``seq_len`` rows of each key are dropped; nulls -> 0 (quirk K-09:
    per key).  Columns are pruned to the features first; a key of any size is
    spread over ranges that carry the ``seq_len`` rows before them."""
    w = ranked.halo_window(key, order_cols)
    vec = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    x = F.collect_list(vec).over(w.rowsBetween(-seq_len, -1))
    names = list(dict.fromkeys([key, *order_cols, *features, target]))
    spread = ranked.with_halo(df.select(*names), key, order_cols, seq_len).withColumn("X", x)
    out = ranked.without_halo(spread)
    return out.where(F.size("X") == seq_len).select(key, *order_cols, "X", F.coalesce(F.col(target).cast("double"), F.lit(0.0)).alias("y"))


def temporal_split(df: DataFrame, val_ratio: float = 0.2, key: str = "station_id",
                   order_cols=("session_start", "session_id")) -> DataFrame:
    """W-12: per key, the first int(n*(1-v)) rows (in time order) are train, the rest validation."""
    placed = ranked.row_positions(df, key, order_cols)
    return placed.withColumn("is_train", F.col("row_pos") <= F.floor(F.col("key_rows") * (1.0 - val_ratio))).drop("row_pos", "key_rows")


def sequence_counts(series: DataFrame, seq_len: int = 24, key: str = "station_id",
                    train_fraction: float = 0.8) -> DataFrame:
    """T-07: usable sequences n - L per key and their 80/20 sizes."""
    g = series.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    s = F.greatest(F.col("n") - seq_len, F.lit(0))
    tr = F.floor(s * train_fraction).cast("long")
    return g.select(key, "n", s.alias("sequences"), tr.alias("train"), (s - tr).alias("test"))


def forecast_band(steps: Column, lo: float = 2.0, hi: float = 8.0, n: int = 12) -> Column:
    """M-13: half-width of the forecast band for step i: linspace(lo, hi, n)[i]."""
    return F.lit(lo) + (F.lit(hi) - F.lit(lo)) * steps / F.lit(float(n - 1))
