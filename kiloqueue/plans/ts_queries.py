"""Registered queries: hourly series and time-series statistics (T-*, W-08..W-12, M-13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiloqueue.operators import timeseries as ts
from kiloqueue.plans.oracle_base import avg_9
from kiloqueue.plans.registry import register
from kiloqueue.sources import adapter as ad

_SER = f"""
hourly AS (SELECT station_id, date_trunc('hour', session_start) AS hour_ts,
  avg(wait_time_minutes) AS v FROM sessions GROUP BY ALL),
span AS (SELECT station_id, min(hour_ts) AS lo, max(hour_ts) AS hi FROM hourly GROUP BY 1),
cal AS (SELECT station_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour_ts FROM span),
ser AS (SELECT c.station_id, cast(row_number() OVER (PARTITION BY c.station_id ORDER BY c.hour_ts) - 1 AS int) AS pos,
  c.hour_ts, last_value(h.v IGNORE NULLS) OVER (PARTITION BY c.station_id ORDER BY c.hour_ts
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value, h.v IS NULL AS filled
  FROM cal c LEFT JOIN hourly h USING (station_id, hour_ts))"""

_WP = "OVER (PARTITION BY station_id ORDER BY pos)"


def _series(spark, sf_dir):
    return ts.hourly_series(ad.sessions(spark, sf_dir))


@register("t_01_w_09_hourly_series", sql="""
SELECT station_id, pos, strftime(hour_ts, '%Y-%m-%d %H:%M:%S') AS hour_ts, round(value, 9) AS value, filled FROM ser""", ctes=_SER)
def t_01_w_09_hourly_series(spark, sf_dir):
    s = _series(spark, sf_dir)
    return s.select("station_id", "pos", F.date_format("hour_ts", "yyyy-MM-dd HH:mm:ss").alias("hour_ts"),
                    F.round("value", 9).alias("value"), "filled")


@register("w_08_rolling_24", sql=f"""
SELECT station_id, pos,
  CASE WHEN count(value) OVER (PARTITION BY station_id ORDER BY pos ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) = 24
    THEN {avg_9('value', 'OVER (PARTITION BY station_id ORDER BY pos ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)')}
    END AS rolling_mean,
  CASE WHEN count(value) OVER (PARTITION BY station_id ORDER BY pos ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) = 24
    THEN round(stddev_samp(value) OVER (PARTITION BY station_id ORDER BY pos ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 9)
    END AS rolling_std
FROM ser""", ctes=_SER)
def w_08_rolling_24(spark, sf_dir):
    r = ts.rolling_24(_series(spark, sf_dir))
    return r.select("station_id", "pos", F.round("rolling_mean", 9).alias("rolling_mean"), F.round("rolling_std", 9).alias("rolling_std"))


@register("w_10_lag_pairs", sql=f"""
SELECT station_id, pos, round(value, 9) AS value, round(next_value, 9) AS next_value FROM (
  SELECT station_id, pos, value, lead(value, 1) {_WP} AS next_value FROM ser) x WHERE next_value IS NOT NULL""",
          ctes=_SER)
def w_10_lag_pairs(spark, sf_dir):
    p = ts.lag_pairs(_series(spark, sf_dir))
    return p.select("station_id", "pos", F.round("value", 9).alias("value"), F.round("next_value", 9).alias("next_value"))


@register("t_02_decomposition", sql=f"""
WITH d AS (
  SELECT station_id, pos, value, pos % 24 AS phase,
    CASE WHEN count(value) OVER (PARTITION BY station_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) = 25
      THEN (sum(value) OVER (PARTITION BY station_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)
        - 0.5e0 * lag(value, 12) {_WP} - 0.5e0 * lead(value, 12) {_WP}) / 24e0 END AS trend
  FROM ser WHERE station_id IN (SELECT station_id FROM ser GROUP BY 1 HAVING count(*) >= 48)),
pm AS (SELECT station_id, phase, avg(value - trend) AS m FROM d GROUP BY ALL),
sc AS (SELECT station_id, phase, m - avg(m) OVER (PARTITION BY station_id) AS seasonal FROM pm)
SELECT station_id, pos, round(value, 9) AS value, round(trend, 9) AS trend, round(seasonal, 9) AS seasonal,
  round(value - trend - seasonal, 9) AS resid
FROM d JOIN sc USING (station_id, phase)""", ctes=_SER)
def t_02_decomposition(spark, sf_dir):
    d = ts.decompose(_series(spark, sf_dir), 24)
    return d.select("station_id", "pos", *[F.round(c, 9).alias(c) for c in ("value", "trend", "seasonal", "resid")])


@register("t_03_dickey_fuller", sql=f"""
SELECT station_id, n, round(slope, 9) AS slope, round(adf, 6) AS adf_stat, adf < -2.86 AS stationary_5pct FROM (
  SELECT station_id, cast(regr_count(dy, yl) AS bigint) AS n, regr_slope(dy, yl) AS slope,
    regr_slope(dy, yl) / sqrt((regr_syy(dy, yl) - regr_sxy(dy, yl) * regr_sxy(dy, yl) / regr_sxx(dy, yl))
      / (regr_count(dy, yl) - 2) / regr_sxx(dy, yl)) AS adf
  FROM (SELECT station_id, value - lag(value, 1) {_WP} AS dy, lag(value, 1) {_WP} AS yl FROM ser) x
  WHERE yl IS NOT NULL GROUP BY station_id) g""", ctes=_SER)
def t_03_dickey_fuller(spark, sf_dir):
    d = ts.dickey_fuller(_series(spark, sf_dir))
    return d.select("station_id", "n", F.round("slope", 9).alias("slope"), F.round("adf_stat", 6).alias("adf_stat"),
                    "stationary_5pct")


_K = 12
_KPSS_SQL = f"""
WITH e AS (SELECT station_id, pos, value - avg(value) OVER (PARTITION BY station_id) AS e FROM ser),
s AS (SELECT station_id, pos, e, sum(e) OVER (PARTITION BY station_id ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s, {", ".join(f"e * lag(e, {k}) OVER (PARTITION BY station_id ORDER BY pos) AS p{k}" for k in range(1, _K + 1))}
  FROM e),
g AS (SELECT station_id, count(*) AS n, sum(s*s) AS ss, sum(e*e) AS e2, {", ".join(f"coalesce(sum(p{k}), 0e0) AS c{k}" for k in range(1, _K + 1))}
  FROM s GROUP BY station_id)
SELECT station_id, n, round(ss / (n * n * ((e2 {"".join(f" + 2e0 * (1e0 - {k}e0 / {_K + 1}e0) * c{k}" for k in range(1, _K + 1))}) / n)), 6)
  AS kpss_stat,
  ss / (n * n * ((e2 {"".join(f" + 2e0 * (1e0 - {k}e0 / {_K + 1}e0) * c{k}" for k in range(1, _K + 1))}) / n)) < 0.463
  AS stationary_5pct
FROM g"""


@register("t_04_kpss", sql=_KPSS_SQL, ctes=_SER)
def t_04_kpss(spark, sf_dir):
    k = ts.kpss(_series(spark, sf_dir), _K)
    return k.select("station_id", "n", F.round("kpss_stat", 6).alias("kpss_stat"), "stationary_5pct")


# lag orders by AIC: regressions by elimination of one column after the other from the sums of squares and products;
# the hourly series span a month, for which at most _AL lags are tried
_AL = 20
_AD = _AL + 3


def _gram_sql(v: list[str]) -> str:
    """The matrix of sums as a list of rows, from a row's values."""
    sums = {(i, j): f"sum({v[i]} * {v[j]})" for i in range(_AD) for j in range(i, _AD)}
    return "[" + ", ".join("[" + ", ".join(sums[min(i, j), max(i, j)] for j in range(_AD)) + "]" for i in range(_AD)) + "]"


def _eliminate_sql(m: str, k: str) -> str:
    return (f"CASE WHEN {m}[{k}][{k}] <= 0 THEN {m} ELSE list_transform({m}, lambda r: list_transform(r, lambda x, j: "
            f"x - r[{k}] * {m}[{k}][j] / {m}[{k}][{k}])) END")


_ADF_SQL = f"""
WITH RECURSIVE x AS (SELECT station_id, pos, lag(value) {_WP} AS yl, value - lag(value) {_WP} AS d, count(*) OVER (PARTITION BY station_id) AS n FROM ser),
z AS (SELECT *, greatest(least(cast(ceil(12e0 * pow(n / 100e0, 0.25e0)) AS int), cast(n // 2 - 2 AS int)), 0) AS m,
  {", ".join(f"coalesce(lag(d, {k}) {_WP}, 0e0) AS d{k}" for k in range(1, _AL + 1))} FROM x),
g AS (SELECT station_id, any_value(n) AS n, any_value(m) AS m, {_gram_sql(["1e0", "yl", *[f"d{k}" for k in range(1, _AL + 1)], "d"])} AS a
  FROM z WHERE pos >= m + 1 GROUP BY station_id),
e(station_id, n, m, k, a) AS (
  SELECT station_id, n, m, 0, a FROM g
  UNION ALL SELECT station_id, n, m, k + 1, {_eliminate_sql("a", "(k + 1)")} FROM e WHERE k < 2 + m),
best AS (SELECT station_id, any_value(n) AS n, arg_min(k - 2, struct_pack(aic := (n - 1 - m) * ln(a[{_AD}][{_AD}] / (n - 1 - m)) + 2 * k, k := k)) AS p
  FROM e WHERE k >= 2 AND a[{_AD}][{_AD}] > 0 GROUP BY station_id),
h AS (SELECT z.station_id, any_value(z.n) AS n, any_value(p) AS p,
    {_gram_sql(["1e0", *[f"(CASE WHEN {k} <= p THEN d{k} ELSE 0e0 END)" for k in range(1, _AL + 1)], "yl", "d"])} AS a
  FROM z JOIN best ON z.station_id = best.station_id WHERE pos >= p + 1 GROUP BY z.station_id),
f(station_id, n, p, k, a) AS (
  SELECT station_id, n, p, 0, a FROM h
  UNION ALL SELECT station_id, n, p, k + 1, {_eliminate_sql("a", "(k + 1)")} FROM f WHERE k < 1 + p),
l AS (SELECT station_id, n, p, a[{_AD - 1}][{_AD - 1}] AS yy, a[{_AD - 1}][{_AD}] AS yd, a[{_AD}][{_AD}] AS dd FROM f WHERE k = 1 + p)
SELECT station_id, n, cast(p AS int) AS lags, round(yd / yy / sqrt((dd - yd * yd / yy) / (n - 1 - p - (2 + p)) / yy), 6) AS adf_stat FROM l"""


@register("t_03_adf_lag_order", sql=_ADF_SQL, ctes=_SER)
def t_03_adf_lag_order(spark, sf_dir):
    return ts.adf(_series(spark, sf_dir)).select("station_id", "n", "lags", F.round("adf_stat", 6).alias("adf_stat"))


_KPSS_AUTO_SQL = """
WITH e AS (SELECT station_id, pos, value - avg(value) OVER (PARTITION BY station_id) AS e, count(*) OVER (PARTITION BY station_id) AS n FROM ser),
c AS (SELECT a.station_id, any_value(a.n) AS n, b.pos - a.pos AS k, sum(a.e * b.e) AS s
  FROM e a JOIN e b ON a.station_id = b.station_id AND b.pos BETWEEN a.pos AND a.pos + 200 GROUP BY a.station_id, b.pos - a.pos),
w AS (SELECT station_id, any_value(n) AS n, sum(CASE WHEN k = 0 THEN s / n WHEN k <= floor(pow(n, 2e0 / 9e0)) THEN s / (n / 2e0) END) AS s0,
  sum(CASE WHEN k BETWEEN 1 AND floor(pow(n, 2e0 / 9e0)) THEN k * s / (n / 2e0) ELSE 0e0 END) AS s1 FROM c GROUP BY station_id),
l AS (SELECT station_id, n, least(cast(floor(1.1447e0 * pow(s1 / s0 * (s1 / s0), 1e0 / 3e0) * pow(n, 1e0 / 3e0)) AS int), n - 1) AS lags FROM w),
v AS (SELECT station_id, any_value(l.n) AS n, any_value(lags) AS lags,
    sum(CASE WHEN k = 0 THEN s WHEN k <= lags THEN 2e0 * (1e0 - k / (lags + 1e0)) * s ELSE 0e0 END) AS spread
  FROM c JOIN l USING (station_id) GROUP BY station_id),
s AS (SELECT station_id, sum(s * s) AS ss FROM (
  SELECT station_id, sum(e) OVER (PARTITION BY station_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM e) q GROUP BY station_id),
k AS (SELECT station_id, n, lags, ss / (n * spread) AS stat FROM v JOIN s USING (station_id))
SELECT station_id, n, cast(lags AS int) AS lags, round(stat, 6) AS kpss_stat, round(CASE WHEN stat <= 0.347 THEN 0.1e0
  WHEN stat <= 0.463 THEN 0.1e0 - (stat - 0.347e0) / 0.116e0 * 0.05e0 WHEN stat <= 0.574 THEN 0.05e0 - (stat - 0.463e0) / 0.111e0 * 0.025e0
  WHEN stat <= 0.739 THEN 0.025e0 - (stat - 0.574e0) / 0.165e0 * 0.015e0 ELSE 0.01e0 END, 6) AS p_value FROM k"""


@register("t_04_kpss_bandwidth", sql=_KPSS_AUTO_SQL, ctes=_SER)
def t_04_kpss_bandwidth(spark, sf_dir):
    return ts.kpss_auto(_series(spark, sf_dir)).select(
        "station_id", "n", "lags", F.round("kpss_stat", 6).alias("kpss_stat"), F.round("p_value", 6).alias("p_value"))


_NL = 48
_ACF_SQL = f"""
WITH x AS (SELECT station_id, pos, value - avg(value) OVER (PARTITION BY station_id) AS x FROM ser),
l AS (SELECT station_id, x, {", ".join(f"lag(x, {k}) OVER (PARTITION BY station_id ORDER BY pos) AS l{k}" for k in range(1, _NL + 1))} FROM x),
g AS (SELECT station_id, count(*) AS n, sum(x*x) AS c0, {", ".join(f"coalesce(sum(x*l{k}), 0e0) AS c{k}" for k in range(1, _NL + 1))} FROM l GROUP BY station_id)
SELECT station_id, lag, round(acf, 9) AS acf, round(1.96e0 / sqrt(n), 9) AS band FROM (
  {" UNION ALL ".join(f"SELECT station_id, n, {k} AS lag, c{k} / c0 AS acf FROM g" for k in range(0, _NL + 1))}) u"""


@register("t_05_w_14_acf", sql=_ACF_SQL, ctes=_SER)
def t_05_w_14_acf(spark, sf_dir):
    a = ts.acf(_series(spark, sf_dir), _NL)
    return a.select("station_id", "lag", F.round("acf", 9).alias("acf"), F.round("band", 9).alias("band"))


# the recursion of orders; list index i + 1 is lag i
_PACF_SQL = f"""
WITH RECURSIVE a AS (SELECT station_id, list(acf ORDER BY lag) AS r FROM (SELECT station_id, lag, acf FROM acf_long) q GROUP BY station_id),
walk(station_id, k, r, phi, v, p) AS (
  SELECT station_id, 0, r, cast([] AS DOUBLE[]), r[1], 1e0 FROM a
  UNION ALL
  SELECT station_id, k + 1, r, list_append(list_transform(range(1, k + 1), lambda i: phi[i] - n * phi[k + 1 - i]), n), v * (1e0 - n * n), n
  FROM (SELECT *, CASE WHEN v = 0 THEN 0e0 ELSE
      (r[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[k + 2 - i])), 0e0)) / v END AS n
    FROM walk WHERE k < {_NL}) w)
SELECT station_id, cast(k AS int) AS lag, round(p, 6) AS pacf FROM walk"""


@register("t_06_pacf", sql=_PACF_SQL, ctes=_SER + ", acf_long AS (" + _ACF_SQL.replace("round(acf, 9)", "acf") + ")")
def t_06_pacf(spark, sf_dir):
    return ts.pacf(ts.acf(_series(spark, sf_dir), _NL)).select("station_id", "lag", F.round("pacf", 6).alias("pacf"))


@register("t_07_sequence_counts", sql="""
SELECT station_id, n, greatest(n - 24, 0) AS sequences, cast(floor(greatest(n - 24, 0) * 0.8e0) AS bigint) AS train,
  greatest(n - 24, 0) - cast(floor(greatest(n - 24, 0) * 0.8e0) AS bigint) AS test
FROM (SELECT station_id, count(*) AS n FROM ser GROUP BY 1) g""", ctes=_SER)
def t_07_sequence_counts(spark, sf_dir):
    return ts.sequence_counts(_series(spark, sf_dir))


_SEQ_W = "OVER (PARTITION BY station_id ORDER BY session_start, session_id ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"


@register("w_11_sequence_windows", sql=f"""
SELECT station_id, session_id, X, y FROM (
  SELECT station_id, session_id,
    list([coalesce(cast(queue_size AS double), 0e0), coalesce(cast(available_ports AS double), 0e0),
          coalesce(traffic_score, 0e0)]) {_SEQ_W} AS X,
    coalesce(wait_time_minutes, 0e0) AS y
  FROM sessions) s WHERE len(X) = 24""")
def w_11_sequence_windows(spark, sf_dir):
    s = ts.sequence_windows(ad.sessions(spark, sf_dir), ["queue_size", "available_ports", "traffic_score"],
                            "wait_time_minutes", 24)
    return s.select("station_id", "session_id", "X", "y")


@register("w_12_temporal_split", sql="""
SELECT session_id, row_number() OVER (PARTITION BY station_id ORDER BY session_start, session_id)
  <= floor(count(*) OVER (PARTITION BY station_id) * 0.8e0) AS is_train FROM sessions""")
def w_12_temporal_split(spark, sf_dir):
    return ts.temporal_split(ad.sessions(spark, sf_dir)).select("session_id", "is_train")


@register("m_13_forecast_band", sql="""
SELECT station_id, cast(o AS int) AS step, round(value, 9) AS forecast,
  round(greatest(value - (2e0 + 6e0 * o / 11e0), 0e0), 9) AS lower, round(value + (2e0 + 6e0 * o / 11e0), 9) AS upper
FROM (SELECT station_id, arg_max(value, pos) AS value FROM ser GROUP BY 1) l, range(0, 12) t(o)""", ctes=_SER)
def m_13_forecast_band(spark, sf_dir):
    last = _series(spark, sf_dir).groupBy("station_id").agg(F.max_by("value", "pos").alias("value"))
    g = last.select("station_id", "value", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("step"))
    band = ts.forecast_band(F.col("step"))
    return g.select("station_id", "step", F.round("value", 9).alias("forecast"),
                    F.round(F.greatest(F.col("value") - band, F.lit(0.0)), 9).alias("lower"),
                    F.round(F.col("value") + band, 9).alias("upper"))


@register("a_35_look_back_error", sql=f"""
SELECT seq_len, count(*) AS n, round(sqrt(avg(e * e)), 9) AS rmse FROM (
  SELECT cast(l AS int) AS seq_len, e FROM (
    SELECT station_id, pos, count(*) OVER (PARTITION BY station_id) AS n, value - lag(value, 1) {_WP} AS e FROM ser) x,
    (VALUES (6), (12), (18), (24), (36), (48)) t(l)
  WHERE n > 2 * l AND pos - l >= floor((n - l) * 0.8e0)) y GROUP BY seq_len""", ctes=_SER)
def a_35_look_back_error(spark, sf_dir):
    from kiloqueue.operators.summary import naive_error_by_look_back

    return naive_error_by_look_back(_series(spark, sf_dir))
