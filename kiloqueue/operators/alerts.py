"""Alert rules, cooldown and history (L-04..L-06, J-04, N-05, N-06, X-34, X-35, P-27)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiloqueue.functions import ranked

# Thresholds and texts of the alert rules.
WAIT_THRESHOLD_MIN = 30
UTIL_THRESHOLD = 0.9
COOLDOWN_SECONDS = 600
OFFLINE_MESSAGE = "Station is offline or unreachable"

ALERT_SCHEMA = ("station_id long, station_name string, alert_type string, message string, "
                "severity string, metric double, rule_order int")


def station_predictions(stations: DataFrame, predictions: DataFrame, order_col: str = "seq") -> DataFrame:
    """J-04: stations left-joined with their latest prediction; missing -> zeros."""
    pred = predictions.groupBy("station_id").agg(
        F.max_by(F.struct("predicted_wait_min", "utilization_pct"), order_col).alias("_p"))
    return (stations.join(pred, "station_id", "left")
            .withColumn("predicted_wait_min", F.coalesce(F.col("_p.predicted_wait_min"), F.lit(0.0)))
            .withColumn("utilization_pct", F.coalesce(F.col("_p.utilization_pct"), F.lit(0.0)))
            .drop("_p"))


def _fmt_threshold(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)


def alert_array(wait_threshold: float = WAIT_THRESHOLD_MIN, util_threshold: float = UTIL_THRESHOLD) -> Column:
    """L-04 / N-05: array of the alerts one station triggers, in rule order."""
    sid = F.col("station_id")
    name = F.coalesce(F.col("name").cast("string"), F.concat(F.lit("Station "), sid.cast("string")))
    wait = F.coalesce(F.col("predicted_wait_min"), F.lit(0.0))
    util = F.coalesce(F.col("utilization_pct"), F.lit(0.0)) / 100.0
    status = F.coalesce(F.col("status").cast("string"), F.lit("Unknown"))

    def rec(kind, message, sev, metric, order):
        return F.struct(sid.alias("station_id"), name.alias("station_name"), F.lit(kind).alias("alert_type"),
                        message.alias("message"), sev.alias("severity"),
                        metric.cast("double").alias("metric"), F.lit(order).alias("rule_order"))

    wt = _fmt_threshold(wait_threshold)
    ut = f"{util_threshold * 100:.0f}"
    return F.array_compact(F.array(
        F.when(wait >= wait_threshold, rec(
            "HIGH_WAIT_TIME",
            F.format_string(f"Predicted wait time %.1f min exceeds threshold ({wt} min)", wait),
            F.when(wait >= wait_threshold * 2, "CRITICAL").otherwise("WARNING"), wait, 1)),
        F.when(util >= util_threshold, rec(
            "HIGH_UTILIZATION",
            F.format_string(f"Station utilisation %.1f%% exceeds threshold ({ut}%%)", util * 100.0),
            F.lit("WARNING"), util * 100.0, 2)),
        F.when(status.contains("Offline"), rec(
            "STATION_OFFLINE", F.lit(OFFLINE_MESSAGE), F.lit("CRITICAL"), F.lit(None), 3)),
    ))


def evaluate_network(stations: DataFrame, predictions: DataFrame | None = None,
                     wait_threshold: float = WAIT_THRESHOLD_MIN, util_threshold: float = UTIL_THRESHOLD,
                     extra_cols=()) -> DataFrame:
    """L-04: one row per triggered alert (explode of the per-station array, U-02)."""
    base = station_predictions(stations, predictions) if predictions is not None else stations
    return base.select(*extra_cols, F.explode(alert_array(wait_threshold, util_threshold)).alias("a")) \
        .select(*extra_cols, "a.*")


def threshold_alerts(snapshot: DataFrame, wait_col: str = "wait_min", threshold: float = 30.0) -> DataFrame:
    """P-27 / L-03: rows at or above the threshold, flagged with a message."""
    return (snapshot.where(F.col(wait_col) >= threshold)
            .withColumn("alert", F.lit(True))
            .withColumn("message", F.format_string(f"Wait %.1f min at or above {threshold:g} min",
                                                   F.col(wait_col))))


def cooldown_fold(times: Column, cooldown_s: int = COOLDOWN_SECONDS) -> Column:
    """N-08 fold over a time-sorted array of epoch seconds: keep t when no kept
    alert lies within the previous ``cooldown_s`` seconds."""
    init = F.array().cast("array<double>")
    return F.aggregate(
        times, init,
        lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) >= cooldown_s),
                              F.concat(acc, F.array(t))).otherwise(acc))


def _next_allowed(t: np.ndarray, gap: int) -> np.ndarray:
    """For every alert of a sorted array, the index of the first one a cooldown later (len(t) if none)."""
    return np.searchsorted(t, t + gap)


def _chain_ends(t: np.ndarray, gap: int) -> np.ndarray:
    """For every alert, the last alert emitted if it is the first one, by pointer jumping."""
    nxt = _next_allowed(t, gap)
    at = np.where(nxt < len(t), nxt, np.arange(len(t)))
    while True:
        further = at[at]
        if (further == at).all():
            return at
        at = further


def apply_cooldown(alerts: DataFrame, time_col: str = "event_time", cooldown_s: float = COOLDOWN_SECONDS,
                   key_cols=("station_id", "alert_type")) -> DataFrame:
    """L-05 batch form: per key, emit an alert if nothing was emitted in the last
    ``cooldown_s`` seconds; suppressed alerts do not extend the cooldown.

    Alerts are dealt into ranges of (key, time).  A key within one range is judged as it is read, in time
    order.  For a key that spans ranges, each range is summed up as a step function from the time at which
    the key may emit again, on entry, to that time on exit (a few steps: chains of emitted alerts soon meet);
    the steps of a key are composed in order, and then its ranges are judged like the others.
    """
    keys, gap = list(key_cols), int(cooldown_s * 1_000_000)
    rows = alerts.select(*keys, F.col(time_col).alias("_t"), F.unix_micros(F.col(time_col).cast("timestamp")).alias("_us"),
                         F.to_json(F.struct(*keys)).alias("_key")).where(F.col("_us").isNotNull())
    spread = ranked.in_ranges(rows, "_key", ["_us"])
    part, never = ranked.PART, np.iinfo(np.int64).min

    def steps(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["_us"].to_numpy(np.int64))
        reach = int(np.searchsorted(t, t[0] + gap)) + 1  # no earlier alert blocks longer
        ends = t[_chain_ends(t, gap)][:reach] + gap
        last = np.append(np.flatnonzero(np.diff(ends)), len(ends) - 1)
        return pd.DataFrame({"_key": key[0], part: key[1], "upto": t[last], "exit": ends[last]})

    def compose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        free, out = never, []
        for p, own in pdf.sort_values([part, "upto"]).groupby(part, sort=True):
            out.append((key[0], p, free))
            at = int(np.searchsorted(own["upto"].to_numpy(), free))
            free = int(own["exit"].iloc[at]) if at < len(own) else free
        return pd.DataFrame(out, columns=["_key", part, "_free"])

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, free = None, never
        for pdf in batches:
            t, key, place, entry = (pdf[c].to_numpy() for c in ("_us", "_key", part, "_free"))
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (place[1:] != place[:-1])) + 1).tolist(), len(t)]
            kept = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                if (key[lo], place[lo]) != group:  # otherwise it goes on from the batch before
                    group, free = (key[lo], place[lo]), entry[lo]
                at = lo + int(np.searchsorted(t[lo:hi], free))
                while at < hi:  # one step per emitted alert
                    kept.append(at)
                    free = t[at] + gap
                    at = max(at + 1, lo + int(np.searchsorted(t[lo:hi], free)))
            yield pdf.iloc[kept][[*keys, "_t"]]

    many = spread.select("_key", part).distinct().groupBy("_key").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("_key")
    maps = spread.join(many, "_key", "left_semi").groupBy("_key", part).applyInPandas(steps, f"_key string, {part} int, upto long, exit long")
    entries = maps.groupBy("_key").applyInPandas(compose, f"_key string, {part} int, _free long")
    held = spread.join(entries, ["_key", part], "left").withColumn("_free", F.coalesce("_free", F.lit(never)))
    schema = ", ".join(f"{c} {t}" for c, t in spread.select(*keys, "_t").dtypes)
    in_order = held.repartition("_key", part).sortWithinPartitions("_key", part, "_us")
    return in_order.mapInPandas(emit, schema).withColumnRenamed("_t", time_col)


def history(alerts: DataFrame, last_n: int = 50, time_col: str = "event_time", cap: int | None = None,
            tiebreak=("station_id", "rule_order")) -> DataFrame:
    """L-06 / W-13: the newest ``last_n`` alerts (a top-k, not a full sort); ``cap`` bounds a caller's request."""
    n = last_n if cap is None else min(last_n, cap)
    return alerts.orderBy(F.col(time_col).desc(), *[F.col(c).desc() for c in tiebreak]).limit(n)


def dismiss(alerts: DataFrame, station_id) -> DataFrame:
    """L-06: drop a station's alerts."""
    return alerts.where(F.col("station_id") != F.lit(station_id))


def alert_data(wait_threshold: float = WAIT_THRESHOLD_MIN) -> Column:
    """The ``data`` record of an alert: what its rule looked at (absent fields are null, which JSON leaves out)."""
    kind, value = F.col("alert_type"), F.col("metric")
    return F.struct(F.when(kind == "HIGH_WAIT_TIME", value).alias("predicted_wait_min"),
                    F.when(kind == "HIGH_WAIT_TIME", F.lit(wait_threshold)).alias("threshold_min"),
                    F.when(kind == "HIGH_UTILIZATION", value).alias("utilization_pct"),
                    F.when(kind == "STATION_OFFLINE", F.lit("Offline")).alias("status"))


def webhook_payload(alerts: DataFrame, source: str = "ev-wait-alerts", as_of=None, group_col: str = "severity",
                    page_size: int = 10) -> DataFrame:
    """N-06: per group, messages of at most ``page_size`` alerts: the envelope {source, timestamp, alerts[],
    count, page} as JSON, and the alerts' texts as message sections.  Every alert is in one page."""
    ts = F.lit(as_of) if as_of is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    placed = ranked.row_positions(alerts, group_col, ["station_id", "rule_order"]) \
        .withColumn("page", F.floor((F.col("row_pos") - 1) / page_size).cast("int"))
    rec = F.struct("station_id", "station_name", "alert_type", "message", "severity", alert_data().alias("data"))
    agg = placed.groupBy(group_col, "page").agg(F.array_sort(F.collect_list(F.struct("row_pos", rec.alias("r")))).alias("_items"))
    items = F.transform("_items", lambda x: x["r"])
    envelope = F.struct(F.lit(source).alias("source"), ts.alias("timestamp"), items.alias("alerts"), F.size(items).alias("count"), "page")
    return agg.select(group_col, "page", F.size(items).alias("count"), F.to_json(envelope).alias("payload"),
                      F.transform(items, lambda r: F.concat(F.lit("["), r["severity"], F.lit("] "), r["station_name"],
                                                            F.lit(": "), r["message"])).alias("blocks"))


def latest_per_key(df: DataFrame, key: str = "station_id", time_col: str = "event_time",
                   tiebreak: str | None = None) -> DataFrame:
    """L-02 batch twin: newest row per key (max_by on a struct, no window)."""
    order = F.struct(time_col, tiebreak) if tiebreak else F.col(time_col)
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(key, "_r.*")
