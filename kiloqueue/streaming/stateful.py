"""Streams with keyed state, timers and watermarks (L-05, L-06, L-08, L-10, J-13).

The jobs of ``jobs.py`` write what each micro-batch adds and merge on reading,
so their cost of reading grows with the history.  Here the open part of a
result lives in Spark's state store instead, bounded by the watermark's delay
(or by a ring's size), and what is final is appended once:

* a row in time order up to the delay is judged in its place, whatever batch
  brings it; a row that comes after its result was given out is returned with
  kind ``late`` and changes nothing;
* timers close what the watermark passes, also for keys without a new row;
* after a restart with the same ``work`` folder a job goes on from its state.

A job's answer so far is what it has appended plus what is still open, read
from the state store of its last batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from kiloqueue.operators import alerts as al
from kiloqueue.streaming import jobs

#: keyed state with timers needs this store; set for the start of a job only
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
HOUR_MS = 3_600_000
#: rings that a station's alerts are dealt over, so that no station is one task
SHARDS = 4


def _run(df: DataFrame, work: str, sink: str = "parquet") -> None:
    """Run a stateful job over all that is there now; the watermark that it reached is written down."""
    spark, (key, value) = df.sparkSession, PROVIDER
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        writer = df.writeStream.format(sink).outputMode("append")
        query = jobs._drain(writer.option("path", f"{work}/out") if sink == "parquet" else writer, work)
    finally:
        spark.conf.set(key, before)
    reached = [p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in p["eventTime"]]
    if reached:
        spark.createDataFrame([(max(reached),)], "watermark string").coalesce(1).write.mode("overwrite").parquet(f"{work}/watermark")


def _watermark(spark: SparkSession, work: str) -> str:
    return spark.read.parquet(f"{work}/watermark").first()[0]


def _appended(df: DataFrame, work: str) -> DataFrame:
    _run(df, work)
    return df.sparkSession.read.schema(df.schema).parquet(f"{work}/out")


def open_state(spark: SparkSession, work: str, name: str) -> DataFrame:
    """The values (key, value) of one state variable after the job's last batch."""
    return spark.read.format("statestore").option("path", f"{work}/checkpoint").option("stateVarName", name).load().select("key", "value")


def _together(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True)


# ------------------------------------------------------------------ L-08 hourly means

class HourlyMeans(StatefulProcessor):
    """Sums and counts of a station's open hours; an hour that the watermark passes is given out and forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "hour array<long>, total array<double>, n array<long>")

    def _store(self, hours: dict[int, tuple[float, int]]) -> None:
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        if not hours:
            self.open.clear()
            return
        self.open.update((list(hours), [float(s) for s, _ in hours.values()], [int(n) for _, n in hours.values()]))
        self.handle.registerTimer(min(hours) + HOUR_MS)

    def _stored(self) -> dict[int, tuple[float, int]]:
        if not self.open.exists():
            return {}
        hour, total, n = self.open.get()
        return {int(h): (float(s), int(c)) for h, s, c in zip(hour, total, n)}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got, passed = _together(rows), timerValues.getCurrentWatermarkInMs()
        late = got["hour"] + HOUR_MS <= passed
        if late.any():
            out = got[late]
            yield pd.DataFrame({"kind": "late", "station_id": key[0], "hour": out["hour"], "total": out["value"], "n": out["value"].notna().astype("int64")})
        hours = self._stored()
        for h, s, n in got[~late].groupby("hour")["value"].agg(["sum", "count"]).itertuples():
            before = hours.get(int(h), (0.0, 0))
            hours[int(h)] = (before[0] + s, before[1] + n)
        self._store(hours)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        hours, passed = self._stored(), timerValues.getCurrentWatermarkInMs()
        done = sorted(h for h in hours if h + HOUR_MS <= passed)
        if done:
            yield pd.DataFrame({"kind": "mean", "station_id": key[0], "hour": done, "total": [hours[h][0] for h in done], "n": [hours[h][1] for h in done]})
        self._store({h: v for h, v in hours.items() if h not in set(done)})

    def close(self) -> None:
        pass


def windowed_means(spark: SparkSession, sf_dir: str, delay: str = "2 hours", work: str | None = None, **source) -> tuple[DataFrame, DataFrame]:
    """L-08: (means, late): the hourly mean per station, and the rows whose hour was closed before they came.

    State holds the hours within ``delay`` of the newest reading only."""
    work = work or jobs.work_dir(spark, "windows")
    rows = jobs.session_stream(spark, sf_dir, **source).withWatermark("session_start", delay).select(
        "station_id", F.unix_millis(F.date_trunc("hour", "session_start")).alias("hour"), F.col("wait_time_minutes").alias("value"))
    out = _appended(rows.groupBy("station_id").transformWithStateInPandas(
        HourlyMeans(), "kind string, station_id long, hour long, total double, n long", "Append", "EventTime"), work)
    left = open_state(spark, work, "open").select("key.station_id", F.inline(F.arrays_zip("value.hour", "value.total", "value.n")))
    every = out.filter("kind = 'mean'").drop("kind").unionByName(left)
    hour = F.timestamp_millis("hour")
    return (every.select("station_id", hour.alias("hour"), F.try_divide("total", "n").alias("value")),
            out.filter("kind = 'late'").select("station_id", hour.alias("hour"), F.col("total").alias("value")))


# ------------------------------------------------------------------ L-10 freshness

class Freshness(StatefulProcessor):
    """The newest reading of a station while it is younger than the time to live; a timer gives out its end."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "us long, session_id long, score double")

    def _end(self, us: int) -> int:
        return -(-(us + self.ttl_us) // 1000)

    def _change(self, key, us: int, session_id: int, score: float | None, fresh: bool) -> pd.DataFrame:
        return pd.DataFrame({"station_id": [key[0]], "us": [us], "session_id": [session_id], "score": [score], "fresh": [fresh]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = _together(rows).sort_values(["us", "session_id"]).iloc[-1]
        us, session_id = int(last["us"]), int(last["session_id"])
        score = None if pd.isna(last["score"]) else float(last["score"])
        if self._end(us) <= timerValues.getCurrentWatermarkInMs():
            return  # too old when it came
        if self.newest.exists():
            before = self.newest.get()
            if (before[0], before[1]) >= (us, session_id):
                return
            self.handle.deleteTimer(self._end(before[0]))
        self.newest.update((us, session_id, score))
        self.handle.registerTimer(self._end(us))
        yield self._change(key, us, session_id, score, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.newest.exists():
            us, session_id, score = self.newest.get()
            if self._end(us) <= timerValues.getCurrentWatermarkInMs():
                self.newest.clear()
                yield self._change(key, us, session_id, score, False)

    def close(self) -> None:
        pass


def freshness_changes(spark: SparkSession, sf_dir: str, ttl_s: float = 300.0, delay: str = "0 seconds", work: str | None = None, **source) -> DataFrame:
    """L-10: (station_id, reading_time, session_id, traffic_score, fresh): each new reading, and each end of one by time alone.

    Times are judged to the millisecond."""
    work = work or jobs.work_dir(spark, "freshness")
    rows = jobs.session_stream(spark, sf_dir, **source).withWatermark("session_start", delay).select(
        "station_id", F.unix_micros("session_start").alias("us"), "session_id", F.col("traffic_score").alias("score"))
    out = _appended(rows.groupBy("station_id").transformWithStateInPandas(
        Freshness(int(ttl_s * 1_000_000)), "station_id long, us long, session_id long, score double, fresh boolean", "Append", "EventTime"), work)
    return out.select("station_id", F.timestamp_micros("us").alias("reading_time"), "session_id", F.col("score").alias("traffic_score"), "fresh")


def fresh_now(changes: DataFrame) -> DataFrame:
    """Per station the newest reading, if nothing has ended it."""
    last = changes.groupBy("station_id").agg(
        F.max_by(F.struct("reading_time", "traffic_score", "fresh"), F.struct("reading_time", "session_id", ~F.col("fresh"))).alias("r"))
    return last.filter("r.fresh").select("station_id", "r.reading_time", "r.traffic_score")


# ------------------------------------------------------------------ L-05 cooldown

def let_through(times: np.ndarray, last: int | None, gap: int) -> list[int]:
    """Of sorted times, those at least ``gap`` after the one let through before."""
    out: list[int] = []
    at = 0 if last is None else int(np.searchsorted(times, last + gap))
    while at < len(times):
        last = int(times[at])
        out.append(last)
        at = max(at + 1, int(np.searchsorted(times, last + gap)))
    return out


class Cooldown(StatefulProcessor):
    """The last alert let through and the sorted alerts that the watermark has not passed; those it passes are judged in time order."""

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "last long, us array<long>")

    def _stored(self) -> tuple[int | None, np.ndarray]:
        if not self.pending.exists():
            return None, np.zeros(0, np.int64)
        last, us = self.pending.get()
        return None if last is None else int(last), np.asarray(us, np.int64)

    def _judge(self, key, last: int | None, us: np.ndarray, passed_us: int) -> Iterator[pd.DataFrame]:
        cut = int(np.searchsorted(us, passed_us, side="right"))
        done, rest = let_through(us[:cut], last, self.gap_us), us[cut:]
        last = done[-1] if done else last
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        self.pending.update((last, [int(x) for x in rest]))
        if len(rest):
            self.handle.registerTimer(-(-int(rest[0]) // 1000))
        if done:
            yield self._rows(key, "alert", done)

    def _rows(self, key, kind: str, us: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"kind": kind, "station_id": key[0], "alert_type": key[1], "us": us})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        last, us = self._stored()
        got = np.sort(_together(rows)["us"].to_numpy(np.int64))
        cut = int(np.searchsorted(got, passed, side="right"))
        if cut:
            yield self._rows(key, "late", [int(x) for x in got[:cut]])
        if cut < len(got):
            yield from self._judge(key, last, np.sort(np.concatenate([us, got[cut:]])), passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, us = self._stored()
        yield from self._judge(key, last, us, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def judged_cooldown(spark: SparkSession, sf_dir: str, cooldown_s: float = 600.0, delay: str = "1 hour", work: str | None = None,
                    **source) -> tuple[DataFrame, DataFrame]:
    """L-05, N-08: (alerts let through, late alerts) per (station, type), each (station_id, alert_type, event_time).

    A batch costs what it brings: a key's state is its last alert and those within ``delay``.  An alert is
    judged when the watermark passes it, in time order; those still open are judged on reading."""
    work, gap = work or jobs.work_dir(spark, "cooldown"), int(cooldown_s * 1_000_000)
    rows = jobs.alert_stream(spark, sf_dir, **source).withWatermark("event_time", delay).select(
        "station_id", "alert_type", F.unix_micros("event_time").alias("us"))
    out = _appended(rows.groupBy("station_id", "alert_type").transformWithStateInPandas(
        Cooldown(gap), "kind string, station_id long, alert_type string, us long", "Append", "EventTime"), work)

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [let_through(np.asarray(us, np.int64), None if pd.isna(last) else int(last), gap) for last, us in zip(pdf["last"], pdf["us"])]
            yield pdf[["station_id", "alert_type"]].assign(us=found).explode("us").dropna().astype({"us": "int64"})

    left = open_state(spark, work, "pending").filter(F.size("value.us") > 0).select("key.station_id", "key.alert_type", "value.last", "value.us")
    open_ones = left.mapInPandas(rest, "station_id long, alert_type string, us long")
    at = F.timestamp_micros("us").alias("event_time")
    return (out.filter("kind = 'alert'").drop("kind").unionByName(open_ones).select("station_id", "alert_type", at),
            out.filter("kind = 'late'").select("station_id", "alert_type", at))


# ------------------------------------------------------------------ L-06 bounded history

class AlertRing(StatefulProcessor):
    """The newest alerts of a key, at most ``size``, that no dismissal of their time or a later one has taken away."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "upto long, us array<long>, rule_order array<int>, session_id array<long>, alert_type array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # plain lists: most keys have a few rows, for which a table costs more than the work
        held, upto = [], None
        for got in rows:
            columns = [got[c].tolist() for c in ("us", "rule_order", "session_id", "alert_type")]
            for us, rule, session, kind in zip(*columns):
                if not pd.isna(kind):
                    held.append((us, rule, session, kind))
                elif not pd.isna(us):
                    upto = us if upto is None else max(upto, us)
        if (stored := self.ring.get()) is not None:
            before, *columns = stored
            upto = before if upto is None else upto if before is None else max(upto, before)
            held += zip(*columns)
        if upto is not None:
            upto = int(upto)
            held = [r for r in held if r[0] > upto]
        held.sort(key=lambda r: r[:3], reverse=True)
        del held[self.size:]
        self.ring.update((upto, *([convert(r[i]) for r in held] for i, convert in enumerate((int, int, int, str)))))
        return iter(())

    def close(self) -> None:
        pass


def alert_history(spark: SparkSession, sf_dir: str, dismissals: DataFrame, last_n: int = 50, cap: int = 1000, shards: int = SHARDS,
                  work: str | None = None, **source) -> DataFrame:
    """L-06 / W-13: the newest ``last_n`` alerts of the stream, less those that the stream ``dismissals`` (station_id,
    event_time) takes away: a station's alerts up to that time, whichever of the two comes first.

    State: ``cap`` alerts per station and shard at most; a station's alerts are dealt over the shards, each
    dismissal goes to all of them."""
    work = work or jobs.work_dir(spark, "history")
    alerts = jobs.alert_details(spark, sf_dir, **source).select(
        "station_id", F.pmod(F.xxhash64("session_id"), F.lit(shards)).cast("int").alias("shard"), F.unix_micros("event_time").alias("us"),
        "rule_order", "session_id", "alert_type")
    none = F.lit(None)
    ends = dismissals.select("station_id", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.unix_micros("event_time").alias("us"),
                             none.cast("int").alias("rule_order"), none.cast("long").alias("session_id"), none.cast("string").alias("alert_type"))
    out = alerts.unionByName(ends).groupBy("station_id", "shard").transformWithStateInPandas(AlertRing(cap), "station_id long", "Append", "None")
    _run(out, work, "noop")
    ring = open_state(spark, work, "ring").select(
        "key.station_id", F.inline(F.arrays_zip("value.us", "value.rule_order", "value.session_id", "value.alert_type")))
    alerts = ring.select("station_id", F.timestamp_micros("us").alias("event_time"), "rule_order", "session_id", "alert_type")
    return al.history(alerts, last_n, cap=cap, tiebreak=("station_id", "rule_order", "session_id"))


# ------------------------------------------------------------------ J-13 live merge

def merged_readings(base: DataFrame, updates: DataFrame, key: str = "session_id", time: str = "event_time", delay: str = "1 hour",
                    work: str | None = None) -> tuple[DataFrame, Column]:
    """J-13 / N-09 live: base readings overridden field by field by the updates of the same key and time.

    Both streams' open rows are kept for ``delay``; a matched pair is given out at once, a row without a
    partner when the watermark passes it.  Returns the merge so far and the watermark up to which it is whole."""
    spark = base.sparkSession
    work = work or jobs.work_dir(spark, "merge")
    fields = [c for c in base.columns if c not in (key, time)]
    b = base.withWatermark(time, delay).select(F.col(key).alias("bk"), F.col(time).alias("bt"), *[F.col(c).alias(f"_b_{c}") for c in fields])
    u = updates.withWatermark(time, delay).select(F.col(key).alias("uk"), F.col(time).alias("ut"), *[F.col(c).alias(f"_u_{c}") for c in fields])
    joined = b.join(u, (F.col("bk") == F.col("uk")) & (F.col("bt") == F.col("ut")), "full_outer")
    merged = joined.select(
        F.coalesce("bk", "uk").alias(key), F.coalesce("bt", "ut").alias(time), *[F.coalesce(f"_u_{c}", f"_b_{c}").alias(c) for c in fields])
    out = _appended(merged, work)
    return out, F.lit(_watermark(spark, work)).cast("timestamp")


__all__ = ["alert_history", "fresh_now", "freshness_changes", "judged_cooldown", "merged_readings", "open_state", "windowed_means"]
