"""Streams whose rows arrive out of order, late, or again."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from gatelake.operators import associate, confirm, text
from gatelake.streaming import arrivals, inorder, streams, versions
from tests.test_folds import OBS, random_observations


def test_late_and_on_time_rows_are_the_input(spark, tmp_path):
    own, path = streams.stream_session(spark), str(tmp_path)
    schema = "k int, ts timestamp_ntz"
    t0 = dt.datetime(2026, 1, 1)
    batches = [[(1, t0), (2, t0 + dt.timedelta(minutes=10))], [(3, t0 + dt.timedelta(minutes=5)), (4, t0 + dt.timedelta(minutes=7)), (5, None)],
               [(6, t0 + dt.timedelta(minutes=6))]]
    for rows in batches:
        own.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        arrivals.split_late(own.readStream.schema(schema).parquet(f"{path}/in"), "ts", 4 * 60 * 1_000_000, f"{path}/door")
    parsed = own.createDataFrame([], schema).schema
    late = {r.k for r in arrivals.late_rows(own, f"{path}/door", parsed).collect()}
    taken = streams.run_available(arrivals.on_time(own, f"{path}/door", parsed), f"{path}/out")
    assert late == {3, 5} and {r.k for r in taken.collect()} == {1, 2, 4, 6}


def test_readers_between_batches_see_one_row_per_event(spark):
    rows = random_observations(21, 120)
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, OBS)
    want = {(r.id, r.container_number, r.status) for r in associate.gate_events(associate.associate_events(df)).collect()}
    seen = []

    def drive(arriving, path):
        assigned, events = streams.run_events(streams.stream_events(arriving), path, compact_after=None if len(seen) == 1 else 1)
        ids = [r.id for r in events.collect()]
        assert len(ids) == len(set(ids))
        started = {r.event_id for r in assigned.where("created").collect()}
        assert started == set(ids)
        seen.append(len(ids))
        return events

    events, late = streams.replay(df, "frame_timestamp", "test-events", drive, slices=2)
    assert {(r.id, r.container_number, r.status) for r in events.collect()} == want
    assert late.count() == 0 and seen == sorted(seen) and 0 < seen[-2] < seen[-1] == len(want)


def test_versions_are_read_by_the_last_and_compacted(spark, tmp_path):
    path, schema = str(tmp_path / "v"), "k int, version int, state string"
    parsed = spark.createDataFrame([], schema).schema
    for batch, rows in enumerate([[(1, 1, "a"), (2, 1, "a")], [(1, 2, "b")], [(3, 1, "a"), (2, 2, "b")]]):
        versions.put(spark.createDataFrame(rows, schema), path, batch)
        versions.put(spark.createDataFrame(rows, schema), path, batch)  # a repeated batch
        if batch == 1:
            versions.compact(spark, path, parsed, ["k"])
    for _ in range(2):
        assert {r.k: r.state for r in versions.current(spark, path, parsed, ["k"]).collect()} == {1: "b", 2: "b", 3: "a"}
        versions.compact(spark, path, parsed, ["k"])
    assert versions._folders(spark, path, "base") == [2] and versions._folders(spark, path, "batch_id") == []


READS = ("site_id string, camera_id string, gate_id string, direction string, origin_key string, track_id bigint, sequence bigint, "
         "frame_timestamp timestamp_ntz, started_at timestamp_ntz, arrival bigint, raw_text string, confidence double")


def random_reads(seed, origins):
    rng, t0, rows = random.Random(seed), dt.datetime(2026, 1, 1), []
    for k in range(origins):
        start = t0 + dt.timedelta(seconds=rng.randrange(600))
        for sequence in range(rng.randrange(1, 8)):
            for _ in range(rng.choice([1, 1, 2])):
                rows.append((f"S{k % 2}", "c", "g", "ENTRY", f"o{k}", k, sequence, start + dt.timedelta(seconds=sequence), start,
                             rng.choice([None, 1, 2, 3]), rng.choice(["CSQU3054383", "MSCU6639870", "x"]), rng.choice([0.5, 0.7, 0.9])))
    return rows


def test_confirmation_in_session_windows_equals_the_batch_and_runs_no_python_per_origin(spark):
    df = spark.createDataFrame(random_reads(5, 60), READS)
    columns = ["site_id", "origin_key", "sequence", "frame_timestamp", "raw_text", "confidence", "confirmed", "container_number", "attempts"]
    want = confirm.confirm_reads(text.validate_reads(confirm.first_attempts(df)), decisive=True).select(columns)
    plans = []

    def drive(rows, path):
        stream = streams.stream_confirm(text.validate_reads(rows))
        plans.append(stream._jdf.queryExecution().analyzed().toString())
        return streams.run_available(stream, path)

    got, late = streams.replay(df, "frame_timestamp", "test-confirm", drive, slices=2, timed=True)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.collect())) and late.count() == 0
    assert not any("InPandas" in plan for plan in plans)


class FakeState:
    """Map and value state of one key in memory; counts listings of slots."""

    def __init__(self):
        self.held, self.listed, self.timers = {}, 0, []

    def getMapState(self, *_):  # noqa: N802
        return self

    def getValueState(self, *_):  # noqa: N802
        return FakeValue()

    def registerTimer(self, ms):  # noqa: N802
        self.timers.append(ms)

    def getValue(self, key):  # noqa: N802
        return self.held.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.held[key] = value

    def removeKey(self, key):  # noqa: N802
        del self.held[key]

    def keys(self):
        self.listed += 1
        return iter(list(self.held))


class FakeValue:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class FakeTime:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_waiting_slots_are_listed_once_a_firing_and_rows_are_taken_in_order():
    state, second = FakeState(), 1_000_000
    events = inorder.Events(10 * second, 30 * second)
    events.init(state)
    rows = [(i * 100 * second, f"o{i}", True, "CSQU3054383", f"e{i}") for i in range(300)]
    random.Random(1).shuffle(rows)
    list(events.handleInputRows(("S", "g", "ENTRY"), [pd.DataFrame(rows, columns=events.columns)], FakeTime(0)))
    assert len(state.timers) == 1  # one a key, not one a slot
    seen, fired = [], 0
    for watermark in (9_999_999, 20_000_000, 2**50):
        while any(t <= watermark for t in state.timers):
            state.timers.remove(next(t for t in state.timers if t <= watermark))
            fired += 1
            for out in events.handleExpiredTimer(("S", "g", "ENTRY"), FakeTime(watermark), None):
                seen += list(out["us"])
        assert seen == sorted(r[0] for r in rows if r[0] < (watermark + 1) * 1000)
    assert fired == state.listed == 3 and state.held == {}


class CountedState(FakeState):
    """Counts how often a stored value is read and written."""

    def __init__(self):
        super().__init__()
        self.read, self.written = 0, 0

    def getValue(self, key):  # noqa: N802
        self.read += 1
        return super().getValue(key)

    def updateValue(self, key, value):  # noqa: N802
        self.written += 1
        super().updateValue(key, value)


def test_waiting_rows_are_written_once_and_read_once_however_many_a_batch_has(monkeypatch):
    monkeypatch.setattr(inorder, "GATHERED", 100)
    monkeypatch.setattr(inorder, "PACKED", 10, raising=False)
    state, second, key = CountedState(), 1_000_000, ("S", "g", "ENTRY")
    events = inorder.Events(10 * second, 30 * second)
    events.init(state)
    rng = random.Random(2)
    rows = [(rng.randrange(4_000) * second, f"o{i}", True, rng.choice([None, "CSQU3054383", "MSCU6639870"]), f"e{i}") for i in range(2_000)]
    rows += [(2_000 * second + i, f"p{i}", False, None, f"f{i}") for i in range(300)]  # more in a slot than is stored together
    rng.shuffle(rows)
    for part in (rows[:1_500], rows[1_500:]):
        pages = [pd.DataFrame(part[at:at + 50], columns=events.columns) for at in range(0, len(part), 50)]
        list(events.handleInputRows(key, pages, FakeTime(0)))
    assert state.read == 0 and state.written == len(state.held) < len(rows) / 4
    got = []
    for watermark in (1_999_999, 2**50):
        before = state.read
        for out in events.handleExpiredTimer(key, FakeTime(watermark), None):
            got += list(out.itertuples(index=False))
        assert state.read - before <= state.written
    _, want = inorder.Events(second, 30 * second).fold(key, None, sorted(rows, key=events.order))
    assert [tuple(r) for r in got] == want and state.held == {}
