"""Structured Streaming jobs (L-01..L-03, L-05, L-07..L-10).

The reference polls every five minutes and keeps state in Python dicts.  Here
the same behaviours are streaming queries over the folder of the events table.
A stateless job appends to a Parquet sink.  A job with a result per key writes,
for each micro-batch, what the batch adds to the result (newest rows, sums and
counts, alerts) under the batch's number; the reader merges the batches.  So
the result does not depend on how rows are dealt into batches or on their order,
no row is too late, and a batch that is run again replaces its own files.

Every job takes a ``work`` folder for its sink and checkpoint: started again
with the same folder, it goes on where it stopped.  Without one it takes a fresh
folder below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from kiloqueue.operators import alerts as al
from kiloqueue.operators.predict import predict_table
from kiloqueue.session import shared_folder
from kiloqueue.sources import adapter as ad
from kiloqueue.sources.io import is_folder
from kiloqueue.streaming.runs import Runs

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one job's sink and checkpoint, inside the shared folder."""
    return shared_folder(spark, f"stream-{name}")


def session_stream(spark: SparkSession, sf_dir: str, max_files: int = 1, events: str | None = None) -> DataFrame:
    """The events table (a file, or a folder that files are added to) as a stream, mapped to sessions (B2).

    The station count (modulus of the user id) is one number read once from
    the static supplier table."""
    n_stations = ad.table(spark, sf_dir, "supplier").count()
    path = events or f"{sf_dir.rstrip('/')}/events.parquet"
    reader = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max_files)
    if not is_folder(spark, path):  # a table in one file is the only one of its name in its folder
        folder, _, name = path.rpartition("/")
        path, reader = folder, reader.option("pathGlobFilter", name)
    ev = reader.parquet(path)
    k = F.get_json_object("props", "$.k").cast("int")
    eid = F.col("event_id")
    avail = F.floor(k / 8.0).cast("int") % 8
    return ev.select(
        eid.alias("session_id"), (F.col("user_id") % n_stations).alias("station_id"),
        F.col("ts").cast("timestamp").alias("session_start"),
        (k % 8).cast("int").alias("queue_size"), avail.alias("available_ports"),
        (((eid * 37) % 100).cast("double") / 1e2).alias("traffic_score"),
        F.greatest(F.lit(0.0), F.least(F.lit(90.0), (k % 8) * 11.5 + ((eid * 37) % 100).cast("double") / 1e1
                                       - avail * 3.0)).alias("wait_time_minutes"))


def _drain(writer, work: str) -> StreamingQuery:
    """Run a streaming query over all that is there now."""
    query = writer.option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _append(df: DataFrame, work: str) -> DataFrame:
    """Append the stream's rows to a Parquet sink and read it."""
    _drain(df.writeStream.format("parquet").option("path", f"{work}/out").outputMode("append"), work)
    return df.sparkSession.read.schema(df.schema).parquet(f"{work}/out")


def _per_batch(df: DataFrame, work: str, add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Write ``add(batch)`` of every micro-batch under its number, and read all of them."""
    def sink(batch: DataFrame, number: int) -> None:
        add(batch).write.mode("overwrite").parquet(f"{work}/out/batch={number}")

    _drain(df.writeStream.foreachBatch(sink), work)
    return df.sparkSession.read.parquet(f"{work}/out").drop("batch")


def enrich_and_predict(spark: SparkSession, sf_dir: str, work: str | None = None, **source) -> DataFrame:
    """L-01: session readings joined with static station metadata and traffic
    (stream-static joins), predicted with M-14, appended to a parquet sink."""
    st = ad.stations(spark, sf_dir).select("station_id", "name", "num_ports", "status")
    tr = ad.traffic(spark, sf_dir).withColumnRenamed("traffic_score", "station_traffic")
    s = session_stream(spark, sf_dir, **source)
    j = (s.join(st, "station_id").join(tr, "station_id", "left")
         .withColumn("traffic_score", F.coalesce("traffic_score", "station_traffic", F.lit(0.3))))
    out = predict_table(j.drop("station_traffic")).select(
        "session_id", "station_id", "session_start", "predicted_wait_min", "recommendation", "utilization_pct")
    return _append(out, work or work_dir(spark, "enrich"))


def latest_state(spark: SparkSession, sf_dir: str, work: str | None = None, **source) -> DataFrame:
    """L-02: latest reading per station, upserted each micro-batch (foreachBatch).

    A batch adds its newest rows as one run; runs are merged by ``max_by`` on (time, id) as they grow, so the
    sink holds at most twice the state and a batch seldom rewrites all of it."""
    s = session_stream(spark, sf_dir, **source).select(
        "station_id", F.col("session_start").alias("event_time"), "session_id", "wait_time_minutes")

    def newest(rows: DataFrame) -> DataFrame:
        return al.latest_per_key(rows, "station_id", "event_time", "session_id")

    work = work or work_dir(spark, "latest")
    state = Runs(spark, f"{work}/state", s.schema, newest)
    _drain(s.writeStream.foreachBatch(lambda batch, number: state.add(newest(batch), number)), work)
    return state.read()


def threshold_stream(spark: SparkSession, sf_dir: str, threshold: float = 30.0, station_id: int | None = None,
                     work: str | None = None, **source) -> DataFrame:
    """L-03 / L-07: stateless threshold alerts (optionally for one station)."""
    s = session_stream(spark, sf_dir, **source)
    if station_id is not None:
        s = s.where(F.col("station_id") == station_id)
    out = al.threshold_alerts(s, "wait_time_minutes", threshold).select("session_id", "station_id", "alert")
    return _append(out, work or work_dir(spark, "threshold"))


def _sums(rows: DataFrame, *keys) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("wait_time_minutes").alias("s"), F.count("wait_time_minutes").alias("n"))


def hourly_means(spark: SparkSession, sf_dir: str, work: str | None = None, **source) -> DataFrame:
    """L-08: tumbling one-hour event-time mean per station: each batch adds sums and counts to its hours."""
    s = session_stream(spark, sf_dir, **source).select(
        "station_id", F.date_trunc("hour", "session_start").alias("hour"), "wait_time_minutes")
    parts = _per_batch(s, work or work_dir(spark, "hourly"), lambda b: _sums(b, "station_id", "hour"))
    return parts.groupBy("station_id", "hour").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("value")).select(
        "station_id", F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour_ts"), "value")


def running_means(spark: SparkSession, sf_dir: str, work: str | None = None, **source) -> DataFrame:
    """L-09: incremental mean per station: each batch adds its sum and count."""
    s = session_stream(spark, sf_dir, **source).select("station_id", "wait_time_minutes")
    parts = _per_batch(s, work or work_dir(spark, "running"), lambda b: _sums(b, "station_id"))
    return parts.groupBy("station_id").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("running_mean"), F.sum("n").alias("n"))


def alert_details(spark: SparkSession, sf_dir: str, **source) -> DataFrame:
    """The alerts (station_id, alert_type, event_time, session_id, rule_order) that the session stream triggers."""
    st = ad.stations(spark, sf_dir).select("station_id", "name", "num_ports", "status")
    s = session_stream(spark, sf_dir, **source).join(st, "station_id")
    avail = F.least(F.col("available_ports"), F.col("num_ports"))
    readings = s.select("session_id", "station_id", "name", "status", F.col("session_start").alias("event_time"),
                        F.col("wait_time_minutes").alias("predicted_wait_min"),
                        F.round((F.col("num_ports") - avail) / F.col("num_ports") * 100.0, 1).alias("utilization_pct"))
    return al.evaluate_network(readings, None, extra_cols=("event_time", "session_id")).select(
        "station_id", "alert_type", "event_time", "session_id", "rule_order")


def alert_stream(spark: SparkSession, sf_dir: str, **source) -> DataFrame:
    """The alerts (station_id, alert_type, event_time) that the session stream triggers."""
    return alert_details(spark, sf_dir, **source).select("station_id", "alert_type", "event_time")


def cooldown_stream(spark: SparkSession, sf_dir: str, cooldown_s: float = 600.0, work: str | None = None, **source) -> DataFrame:
    """L-05: alerts from the session stream, de-duplicated per (station, type) with a cooldown.

    The stream lands every alert; the rule is applied in event time to all that have landed, so alerts that
    come late or out of order are judged in their place."""
    landed = _append(alert_stream(spark, sf_dir, **source), work or work_dir(spark, "cooldown"))
    return al.apply_cooldown(landed, "event_time", cooldown_s)


def live_cooldown_fn(cooldown_s: float):
    """State function of the live form: the times that are let through, in order of arrival of the batches.

    A key's rows of a batch are put in time order whatever Arrow chunks they come in.  An alert older
    than the last one let through can't be judged any more: it is returned with ``late`` true.
    """
    import numpy as np
    import pandas as pd

    def fn(key, pdfs, state):
        every = pd.concat([p["event_time"] for p in pdfs], ignore_index=True).sort_values(kind="mergesort")
        t = every.to_numpy("datetime64[us]").astype(np.int64)
        gap, kept = int(cooldown_s * 1_000_000), []
        last = state.get[0] if state.exists else None
        late = int(np.searchsorted(t, last)) if last is not None else 0
        i = late if last is None else int(np.searchsorted(t, last + gap))
        while i < len(t):
            kept.append(i)
            i = int(np.searchsorted(t, t[i] + gap))
        if kept:
            state.update((int(t[kept[-1]]),))
        at = [*range(late), *kept]
        if at:
            yield pd.DataFrame({"station_id": key[0], "alert_type": key[1], "event_time": every.iloc[at].to_numpy(),
                                "late": [True] * late + [False] * len(kept)})

    return fn


def live_cooldown(spark: SparkSession, sf_dir: str, cooldown_s: float = 600.0, work: str | None = None, **source) -> DataFrame:
    """L-05, N-08 live: alerts let through as batches arrive, one number of state per key; late ones are flagged."""
    out = alert_stream(spark, sf_dir, **source).groupBy("station_id", "alert_type").applyInPandasWithState(
        live_cooldown_fn(cooldown_s), "station_id long, alert_type string, event_time timestamp, late boolean",
        "last long", "append", GroupStateTimeout.NoTimeout)
    return _append(out, work or work_dir(spark, "live"))


def freshness_stream(spark: SparkSession, sf_dir: str, ttl_s: float = 300.0, work: str | None = None, **source) -> DataFrame:
    """L-10: newest reading per station, only while younger than the TTL at the newest event time seen."""
    s = session_stream(spark, sf_dir, **source).select(
        "station_id", F.col("session_start").alias("event_time"), "session_id", "traffic_score")
    parts = _per_batch(s, work or work_dir(spark, "fresh"), lambda b: al.latest_per_key(b, "station_id", "event_time", "session_id"))
    now = parts.select(F.max("event_time")).scalar()
    return fresh_readings(parts, now, ttl_s, tiebreak="session_id").select(
        "station_id", F.col("event_time").alias("reading_time"), "traffic_score")


def fresh_readings(readings: DataFrame, as_of, ttl_s: float = 300.0, key: str = "station_id",
                   time_col: str = "event_time", tiebreak: str | None = None) -> DataFrame:
    """S-16: per key, the newest reading not older than the TTL at ``as_of`` (a time or a column)."""
    cutoff = (as_of if hasattr(as_of, "cast") else F.lit(as_of)).cast("timestamp")
    recent = readings.where((F.col(time_col) > cutoff - F.expr(f"INTERVAL {int(ttl_s)} SECONDS"))
                            & (F.col(time_col) <= cutoff))
    return al.latest_per_key(recent, key, time_col, tiebreak)


__all__ = ["alert_details", "alert_stream", "cooldown_stream", "enrich_and_predict", "fresh_readings", "freshness_stream", "hourly_means",
           "latest_state", "live_cooldown", "running_means", "session_stream", "threshold_stream", "work_dir"]
