"""Streams over folders of files, out of time order, with a restart in the middle."""

import os
import shutil

import pandas as pd
import pytest

import __spark_entry__ as ent
from kiloqueue.streaming import jobs
from tests.conftest import SF


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    """Six files of events, dealt without regard to time, and a folder that two of them have been put into."""
    import pyarrow.parquet as pq

    folder, parts = str(tmp_path_factory.mktemp("events")), tmp_path_factory.mktemp("parts")
    table = pq.read_table(f"{SF}/events.parquet")
    paths = []
    for k in range(6):
        pq.write_table(table.take(list(range(k, table.num_rows, 6))[::-1]), paths.append(f"{parts}/p{k}.parquet") or paths[-1])
    return folder, paths


def test_jobs_resume_and_equal_the_batch_answer(spark, events, tmp_path):
    folder, paths = events
    runs = {"l_02_stream_latest_state": jobs.latest_state, "l_08_stream_hourly_mean": jobs.hourly_means,
            "l_09_a_32_stream_running_mean": jobs.running_means, "l_10_stream_freshness": jobs.freshness_stream,
            "l_05_stream_cooldown": jobs.cooldown_stream, "l_03_l_07_stream_threshold": jobs.threshold_stream}
    for p in paths[:4]:
        shutil.copy(p, folder)
    for name, job in runs.items():
        job(spark, SF, work=f"{tmp_path}/{name}", events=folder)  # four batches
    for p in paths[4:]:
        shutil.copy(p, folder)
    for name, job in runs.items():
        resumed = job(spark, SF, work=f"{tmp_path}/{name}", events=folder)  # goes on with two more
        whole = job(spark, SF)
        assert sorted(map(str, resumed.collect()))[:3] and resumed.count() == whole.count(), name
        a, b = (x.toPandas().sort_values(list(x.columns)).reset_index(drop=True) for x in (resumed, whole))
        pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9)
    assert len(os.listdir(f"{tmp_path}/l_08_stream_hourly_mean/out")) >= 6
    assert set(runs) <= set(ent.queries())


def test_live_cooldown_over_chunks():
    class State:
        exists, value = False, None

        @property
        def get(self):
            return (self.value,)

        def update(self, v):
            self.exists, self.value = True, v[0]

    def chunk(*seconds):
        return pd.DataFrame({"event_time": pd.to_datetime(list(seconds), unit="s")})

    fn, state = jobs.live_cooldown_fn(600), State()
    first = pd.concat(fn((1, "A"), [chunk(1400, 2100), chunk(0, 700)], state))
    assert first.event_time.astype("datetime64[s]").astype("int64").tolist() == [0, 700, 1400, 2100] and not first.late.any()
    second = pd.concat(fn((1, "A"), [chunk(2200, 50, 2700)], state))
    assert second.event_time.astype("datetime64[s]").astype("int64").tolist() == [50, 2700] and second.late.tolist() == [True, False]
