"""Streams with keyed state: shuffled files, late rows, timers, restarts; and the runs of the latest state."""

import os
import shutil

import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kiloqueue.operators import alerts as al
from kiloqueue.operators.joins import live_merge
from kiloqueue.plans import stream_queries
from kiloqueue.streaming import jobs, stateful
from kiloqueue.streaming.runs import Runs
from tests.conftest import SF


def same(a, b):
    a, b = (x.toPandas() for x in (a, b))
    columns = sorted(a.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9, check_dtype=False)


@pytest.fixture(scope="module")
def parts(tmp_path_factory):
    """Six files of events in rising time on the whole, each with its rows in reverse and a fifth of them dealt a file later."""
    folder = tmp_path_factory.mktemp("parts")
    table = pq.read_table(f"{SF}/events.parquet").sort_by("ts")
    n = table.num_rows
    file = [min(5, 6 * i // n + (i % 5 == 0)) for i in range(n)]
    paths = []
    for k in range(6):
        pq.write_table(table.take([i for i in range(n) if file[i] == k][::-1]), paths.append(f"{folder}/p{k}.parquet") or paths[-1])
    return paths


def resumed(parts, folder, job):
    """The job's last answer: four files, then two more in a second run with the same work folder."""
    os.makedirs(folder)

    def land(which):
        for k in which:
            path = shutil.copy(parts[k], folder)
            os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))  # read in this order

    land(range(4))
    job(folder)
    land(range(4, 6))
    return job(folder)


def sessions(spark):
    """The same sessions as a table."""
    stream = jobs.session_stream(spark, SF)
    work = jobs.work_dir(spark, "all")
    return jobs._append(stream, work)


def test_windowed_means(spark, parts, tmp_path):
    s = sessions(spark)
    want = s.groupBy("station_id", F.date_trunc("hour", "session_start").alias("hour")).agg(F.avg("wait_time_minutes").alias("value"))
    means, late = resumed(parts, f"{tmp_path}/e", lambda e: stateful.windowed_means(spark, SF, "40 days", f"{tmp_path}/w", events=e))
    assert late.count() == 0
    same(means, want)
    # with a short delay some rows come too late: they are given out, and the means are those of the others
    means, late = resumed(parts, f"{tmp_path}/e2", lambda e: stateful.windowed_means(spark, SF, "2 hours", f"{tmp_path}/w2", events=e))
    assert 0 < late.count() < s.count() / 4
    lost = late.groupBy("station_id", "hour").agg(F.sum("value").alias("l"), F.count("*").alias("k"))
    sums = s.groupBy("station_id", F.date_trunc("hour", "session_start").alias("hour")).agg(F.sum("wait_time_minutes").alias("t"), F.count("*").alias("n"))
    rest = sums.join(lost, ["station_id", "hour"], "left").fillna(0, ["l", "k"]).where("n > k").select("station_id", "hour", ((F.col("t") - F.col("l")) / (F.col("n") - F.col("k"))).alias("value"))
    same(means, rest)
    # the state holds the hours within the delay alone
    held = stateful.open_state(spark, f"{tmp_path}/w2", "open").select(F.explode("value.hour").alias("hour"))
    newest = s.agg(F.max(F.unix_millis("session_start"))).first()[0]
    assert held.agg(F.min("hour")).first()[0] >= newest - 4 * stateful.HOUR_MS


def test_freshness_ends_by_time_alone(spark, parts, tmp_path):
    s = sessions(spark)
    now = s.agg(F.max("session_start")).first()[0]
    for ttl in (300.0, 86_400.0):
        want = jobs.fresh_readings(s.withColumnRenamed("session_start", "event_time"), now, ttl, tiebreak="session_id").select("station_id", F.col("event_time").alias("reading_time"), "traffic_score")
        changes = resumed(parts, f"{tmp_path}/e{ttl}", lambda e: stateful.freshness_changes(spark, SF, ttl, work=f"{tmp_path}/w{ttl}", events=e))
        same(stateful.fresh_now(changes), want)
    ends = changes.where("not fresh")
    assert ends.count() > 0
    # what ended had begun before, and nothing newer of the station was needed for it
    assert ends.join(changes.where("fresh"), ["station_id", "session_id"], "left_anti").count() == 0
    assert stateful.open_state(spark, f"{tmp_path}/w86400.0", "newest").count() == stateful.fresh_now(changes).count()


def test_cooldown_judges_late_alerts_in_their_place(spark, parts, tmp_path):
    landed = jobs._append(jobs.alert_stream(spark, SF), jobs.work_dir(spark, "landed"))
    want = al.apply_cooldown(landed, "event_time", 21_600.0)
    through, late = resumed(parts, f"{tmp_path}/e", lambda e: stateful.judged_cooldown(spark, SF, 21_600.0, "40 days", f"{tmp_path}/w", events=e))
    assert late.count() == 0
    same(through, want)
    through, late = resumed(parts, f"{tmp_path}/e2", lambda e: stateful.judged_cooldown(spark, SF, 21_600.0, "1 hour", f"{tmp_path}/w2", events=e))
    assert late.count() > 0
    kept = landed.exceptAll(late)
    same(through, al.apply_cooldown(kept, "event_time", 21_600.0))
    pending = stateful.open_state(spark, f"{tmp_path}/w2", "pending").select(F.size("value.us").alias("n"))
    assert pending.agg(F.sum("n")).first()[0] < landed.count() / 10


def test_let_through():
    import numpy as np

    t = np.array([0, 100, 599, 600, 700, 1201])
    assert stateful.let_through(t, None, 600) == [0, 600, 1201]
    assert stateful.let_through(t, -1, 600) == [599, 1201]
    assert stateful.let_through(t[:0], 5, 600) == []


def test_history_of_two_streams(spark, parts, tmp_path):
    s = sessions(spark)
    ends = stream_queries._dismissals(s)
    alerts = jobs._append(jobs.alert_details(spark, SF), jobs.work_dir(spark, "details"))
    gone = alerts.alias("a").join(ends.alias("d"), (F.col("a.station_id") == F.col("d.station_id")) & (F.col("d.event_time") >= F.col("a.event_time")), "left_semi")
    left = alerts.join(gone, ["station_id", "session_id", "alert_type"], "left_anti")
    for last_n, cap in ((50, 1000), (5, 3)):
        want = al.history(left, last_n, cap=cap, tiebreak=("station_id", "rule_order", "session_id"))
        got = resumed(parts, f"{tmp_path}/e{cap}", lambda e: stateful.alert_history(
            spark, SF, stream_queries._dismissals(jobs.session_stream(spark, SF, events=e)), last_n, cap, work=f"{tmp_path}/w{cap}", events=e))
        assert [tuple(r) for r in got.select("session_id", "alert_type", "event_time").collect()] == [tuple(r) for r in want.select("session_id", "alert_type", "event_time").collect()]
    ring = stateful.open_state(spark, f"{tmp_path}/w3", "ring").select(F.size("value.us").alias("n"))
    assert ring.agg(F.max("n")).first()[0] <= 3


def test_merge_of_two_streams(spark, parts, tmp_path):
    base, new = stream_queries.merge_inputs(sessions(spark))
    want = live_merge(base.withColumn("k", F.struct("session_id", "event_time")).drop("session_id", "event_time"),
                      new.withColumn("k", F.struct("session_id", "event_time")).drop("session_id", "event_time"), "k").select("k.*", "station_id", "wait_time_minutes", "queue_size")
    merged, closed = resumed(parts, f"{tmp_path}/e", lambda e: stateful.merged_readings(
        *stream_queries.merge_inputs(jobs.session_stream(spark, SF, events=e)), delay="12 days", work=f"{tmp_path}/w"))
    got = merged.where(F.col("event_time") <= closed)
    assert got.count() > want.count() / 3
    same(got, want.where(F.col("event_time") <= closed))


def test_runs_hold_at_most_twice_the_state(spark, tmp_path):
    """Sixty batches of a hundred keys each over a thousand keys; one of them is run again, one fails before its manifest."""
    schema = "k long, at long, v double"
    newest = lambda rows: al.latest_per_key(rows, "k", "at")
    runs = Runs(spark, str(tmp_path / "runs"), spark.createDataFrame([], schema).schema, newest)
    want, most = {}, 0
    for number in range(60):
        rows = [((number * 37 + i * 7) % 1000, number, float(i)) for i in range(100)]
        want.update({k: (a, v) for k, a, v in rows})
        if number == 30:  # half written, then started again
            runs._write(spark.createDataFrame(rows[:3], schema), "30")
        runs.add(newest(spark.createDataFrame(rows, schema)), number)
        if number == 45:
            runs.add(newest(spark.createDataFrame([(1, 10**9, -1.0)], schema)), number)  # a batch that was committed is passed over
        last, live = runs.manifest()
        assert last == number and sum(n for _, n in live) <= 2 * len(want)
        assert sorted(runs._names("runs")) == sorted(name for name, _ in live)
        most = max(most, len(live))
    assert {r.k: (r.at, r.v) for r in runs.read().collect()} == want
    assert most <= 8
    again = Runs(spark, str(tmp_path / "runs"), runs.schema, newest)
    assert again.manifest() == runs.manifest() and again.read().count() == len(want)
    assert Runs(spark, str(tmp_path / "none"), runs.schema, newest).read().count() == 0


def test_alert_ring_works_without_tables(monkeypatch):
    """A key's rows are handled as lists: what is dismissed goes, the newest stay, a dismissal holds for later alerts."""
    import pandas as pd

    class Value:
        held = None

        def get(self):
            return self.held

        def exists(self):
            return self.held is not None

        def update(self, row):
            self.held = row

    def rows(*data):
        return iter([pd.DataFrame([d], columns=["us", "rule_order", "session_id", "alert_type"]) for d in data])

    def fail(*a, **k):
        raise AssertionError("no table a key")

    ring = stateful.AlertRing(2)
    ring.ring = Value()
    monkeypatch.setattr(stateful.pd, "concat", fail)
    list(ring.handleInputRows((1, 0), rows((10, 1, 5, "a"), (10, 2, 5, "b"), (3, 1, 4, "a"), (None, None, None, None)), None))
    assert ring.ring.held == (None, [10, 10], [2, 1], [5, 5], ["b", "a"])
    list(ring.handleInputRows((1, 0), rows((10, None, None, None), (12, 1, 7, "a")), None))
    list(ring.handleInputRows((1, 0), rows((9, 1, 8, "a")), None))
    assert ring.ring.held == (10, [12], [1], [7], ["a"])
