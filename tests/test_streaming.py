"""Streams in several batches, continued streams, late rows and timeouts."""

import random

import pandas as pd

from viewmill.session import scratch_path, table
from viewmill.streaming import steps as st

D = "/root/testdata/sf0.001"


def split_folder(spark, name, parts):
    """The table as a folder of files, in random order."""
    path = f"{scratch_path(spark, 'stream')}"
    table(spark, D, name).orderBy("ingested_at" if name == "method_steps" else "event_id").repartition(parts).write.parquet(f"{path}/{name}.parquet")
    return path


def final(df):
    best = {}
    for r in df.collect():
        if (r.run_id, r.start_view_id) not in best or r.n_steps > best[r.run_id, r.start_view_id][1]:
            best[r.run_id, r.start_view_id] = (r.stable_at, r.n_steps)
    return best


def test_batches_do_not_change_results(spark):
    folder = split_folder(spark, "method_steps", 4)
    whole = final(st.drained(st.stabilisation(st.file_stream(spark, D, "method_steps")), "a", "update"))
    parts = final(st.drained(st.stabilisation(st.file_stream(spark, folder, "method_steps", 1)), "b", "update"))
    assert {k: v[1] for k, v in whole.items()} == {k: v[1] for k, v in parts.items()} and whole
    assert sum(whole[k] != parts[k] for k in whole) == 0
    events = split_folder(spark, "events", 3)
    counts = lambda d, n: {(r.start, r.event_type): r.n for r in st.drained(st.windowed_counts(st.file_stream(spark, d, "events", n), "3650 days", "6 hours"), "w", "update").groupBy("start", "event_type").agg({"n": "max"}).withColumnRenamed("max(n)", "n").collect()}
    assert counts(D, None) == counts(events, 1)


def test_a_stream_goes_on_in_its_folder(spark):
    data, folder = split_folder(spark, "method_steps", 1), scratch_path(spark, "goes-on")
    first = st.drained(st.first_deliveries(st.file_stream(spark, data, "method_steps"), "3650 days"), "d", folder=folder).count()
    table(spark, D, "method_steps").write.mode("append").parquet(f"{data}/method_steps.parquet")
    again = st.drained(st.first_deliveries(st.file_stream(spark, data, "method_steps"), "3650 days"), "d", folder=folder)
    assert again.count() == first > 0


class State:
    def __init__(self, value=None, timed_out=False):
        self.value, self.hasTimedOut, self.timeout = value, timed_out, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):  # noqa: N802
        self.timeout = ms


def test_idle_runs_are_closed():
    rows = pd.DataFrame({"row_id": [1, 2, 3, 4], "step_id": [0, 1, 2, 3], "covered_voxel_count": [100, 200, 201, 202]})
    state = State()
    out = next(st._stabilise((7, 0), iter([rows]), state, 0.05, 2, 500))
    assert out.iloc[0].tolist() == [7, 0, 3, 4, False] and state.timeout == 500
    state.hasTimedOut = True
    out = next(st._stabilise((7, 0), iter([]), state, 0.05, 2, 500))
    assert out.iloc[0].tolist() == [7, 0, 3, 4, True] and not state.exists


def test_late_steps_take_their_place():
    rng = random.Random(1)
    rows = pd.DataFrame({"row_id": range(9), "step_id": range(9), "covered_voxel_count": [10, 50, 90, 91, 120, 121, 122, 123, 124]})
    want = st.stable_step(list(rows.step_id), list(rows.covered_voxel_count), 0.05, 2)
    for _ in range(20):
        order = list(range(9))
        rng.shuffle(order)
        state = State()
        for i in range(0, 9, 2):
            out = next(st._stabilise((1, 0), iter([rows.iloc[order[i : i + 2]]]), state, 0.05, 2, None))
        assert out.stable_at.iloc[0] == want == 6
