"""Evidence, search and registry rules on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gatelake.operators import associate, evidence, ledger, search
from gatelake.params import GateParams
from gatelake.session import work_dir
from gatelake.sources import store as event_store
from gatelake.sources import tables

T0 = dt.datetime(2026, 1, 1)


def store(spark, n):
    events = spark.createDataFrame([("S", "e", "lane", T0, None, "ENTRY", "NEEDS_REVIEW")],
                                   "site_id string, id string, gate_id string, timestamp timestamp_ntz, "
                                   "container_number string, event_type string, status string")
    detections = spark.range(n).selectExpr(
        "'S' as site_id", "concat('d', id) as id", "'e' as event_id", "'c' as camera_id", "concat('o', id) as origin_key",
        "id as track_id", "'feet' as class_name", "0.5D as confidence", "array(1D, 2D, 3D, 4D) as bbox",
        "cast(timestamp_micros(1767225600000000 + id * 500000) as timestamp_ntz) as timestamp")
    ocr = detections.selectExpr(
        "site_id", "concat('r', id) as id", "id as detection_id", "'t' as raw_text", "'t' as corrected_text",
        "'T' as normalized_text", "confidence", "false as valid_format", "false as valid_check_digit",
        "'INVALID_FORMAT' as validation_status", "timestamp")
    snapshots = detections.selectExpr("site_id", "concat('s', id) as id", "event_id", "camera_id", "id as image_path", "timestamp")
    return events, detections, ocr, snapshots


def test_documents_are_cut_by_time_only(spark, tmp_path):
    one = evidence.event_documents(*store(spark, 9)).collect()
    assert [r.part for r in one] == [0]
    times = [d.timestamp for d in one[0].detections]
    assert times[:3] == ["2026-01-01T00:00:00Z", "2026-01-01T00:00:00.500000Z", "2026-01-01T00:00:01Z"]
    assert one[0].container_size == "FEET DETECTED"
    many = evidence.event_documents(*store(spark, 900), slice_seconds=100)
    rows = many.collect()
    assert sorted((r.part, len(r.detections), len(r.ocr_results), len(r.snapshots)) for r in rows) == [
        (i, 200, 200, 200) for i in range(4)] + [(4, 100, 100, 100)]
    assert {r.container_size for r in rows} == {"FEET DETECTED"}
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4
    assert sorted(d.id for r in rows for d in r.detections) == sorted(f"d{i}" for i in range(900))
    assert sum(len(r.ocr_results) for r in rows) == sum(len(r.snapshots) for r in rows) == 900
    evidence.write_event_documents(many, str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).count() == len(rows)


def test_replay_adds_nothing(spark):
    rows = spark.createDataFrame([("S", "a", 1, "x"), ("S", "a", 1, "y"), ("S", "b", 2, "z")],
                                 "site_id string, origin_key string, sequence int, raw_text string")
    keys, order = ["site_id", "origin_key", "sequence"], ["raw_text"]
    empty = rows.limit(0)
    stored = associate.idempotent_append(empty, rows, keys, order)
    assert sorted(r.raw_text for r in stored.collect()) == ["x", "z"]
    assert associate.idempotent_append(stored, rows, keys, order).count() == 0


def test_companions_fill_absent_cameras(spark):
    assigned = spark.createDataFrame([("S", "e", "c1", 7, "o", T0, True)],
                                     "site_id string, event_id string, camera_id string, track_id long, origin_key string, "
                                     "frame_timestamp timestamp_ntz, confirmed boolean")
    companions = spark.createDataFrame([("S", "e", c, T0) for c in ("c1", "c2", "c3", "c4")],
                                       "site_id string, event_id string, camera_id string, timestamp timestamp_ntz")
    assert evidence.snapshot_manifest(assigned, companions).count() == 4


def test_page_bounds(spark):
    events, detections, _, _ = store(spark, 2)
    assert search.search_events(events, detections, camera_id="c", limit=200).count() == 1
    assert search.search_events(events, detections, container="csqu3054383").count() == 0
    for bad in ({"limit": 0}, {"limit": 201}, {"offset": -1}):
        with pytest.raises(ValueError):
            search.search_events(events, detections, **bad)
    with pytest.raises(ValueError):
        GateParams(ocr_confirmations=5)


def test_back_off(spark):
    df = spark.createDataFrame([("S", i, i, False, T0, T0) for i in range(7)],
                               "site_id string, delivery_id long, failures int, delivered boolean, "
                               "enqueued_at timestamp_ntz, last_attempt_at timestamp_ntz")
    got = ledger.outbox_schedule(df, max_retries=6).orderBy("delivery_id").collect()
    assert [r.wait_seconds for r in got] == [None, 2, 4, 8, 16, 30, None]
    assert [got[0].delivery_state, got[6].delivery_state] == ["QUEUED", "EXHAUSTED"]


def test_unknown_direction_is_delivered_as_entry(spark):
    df = spark.createDataFrame([("S", "g", "c", "UNKNOWN", "o", T0, "CSQU3054383", True, "e", 0.9)],
                               "site_id string, gate_id string, camera_id string, direction string, origin_key string, "
                               "frame_timestamp timestamp_ntz, normalized_text string, confirmed boolean, event_id string, "
                               "detection_confidence double")
    row = ledger.outbox_payloads(df).first()
    assert '"eventType":"ENTRY"' in row.payload and '"timestamp":"2026-01-01T00:00:00.000Z"' in row.payload
    assert (row.scac, row.direction_raw) == ("CSQU", "UNKNOWN")


def test_image_listing_against_the_manifest(spark, tmp_path):
    for name in ("e/c1/1.jpg", "e/c2/2.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    files = tables.image_files(spark, str(tmp_path), "S")
    snapshots = spark.createDataFrame([("S", "e/c1/1.jpg"), ("S", "e/c3/3.jpg")], "site_id string, image_path string")
    got = {(r.image_path, r.problem) for r in evidence.orphan_images(files, snapshots).collect()}
    assert got == {("e/c2/2.jpg", "UNREFERENCED_FILE"), ("e/c3/3.jpg", "MISSING_FILE")}


class FakeConf(dict):
    """Stands for a session with a given master and settings."""

    def __init__(self, master, **settings):
        super().__init__(settings)
        self.conf, self.sparkContext, self.master = self, self, master


def test_work_folder_follows_the_session():
    shared = {"spark.checkpoint.dir": "hdfs://shared/work"}
    assert work_dir(FakeConf("yarn", **shared), "x").startswith("hdfs://shared/work/x-")
    assert "gatelake-" in work_dir(FakeConf("local[2]"), "x")
    with pytest.raises(RuntimeError):
        work_dir(FakeConf("yarn"), "x")


def test_registry_keeps_rows_with_missing_values(spark):
    schema = ("site_id string, id string, name string, gate_id string, source_env string, capture_fps double, inference_fps double, "
              "frame_skip int, ocr_roi array<double>, line_position double, line_deadband double, role string")
    good = ("S", "a", "n", "g", "CAM_1", 15.0, None, 0, [0.0, 0.0, 1.0, 1.0], 0.5, 0.1, "LEFT")
    rows = [good, ("S", None, *good[2:]), ("S", "b", "n", None, *good[4:]), ("S", "c", *good[2:11], "TOP"), (None, *good[1:])]
    found = {(r.site_id, r.id): r.violations for r in tables.camera_registry_check(spark.createDataFrame(rows, schema)).collect()}
    assert found == {("S", "a"): [], ("S", None): ["required"], ("S", "b"): ["required"], ("S", "c"): ["role"], (None, "a"): []}


def test_the_last_of_repeated_incoming_rows_counts(spark):
    schema = "site_id string, id string, name string"
    current = spark.createDataFrame([("S", "a", "old")], schema).selectExpr(
        "*", "timestamp_ntz'2026-01-01' as created_at", "timestamp_ntz'2026-01-01' as updated_at")
    incoming = spark.createDataFrame([("S", "a", "one"), ("S", "a", "two"), ("S", "b", "x")], schema)
    rows = tables.upsert_cameras(current, incoming, "2026-02-01 00:00:00").collect()
    assert sorted((r.id, r.name, r.created_at.month) for r in rows) == [("a", "two", 1), ("b", "x", 2)]


def test_only_written_days_are_replaced(spark, tmp_path):
    path = str(tmp_path / "days")
    documents = evidence.event_documents(*store(spark, 4))
    evidence.write_event_documents(documents.withColumn("event_date", F.lit("2025-12-31").cast("date")), path)
    evidence.write_event_documents(documents, path)
    assert spark.read.json(path).select("event_date").distinct().count() == 2


def test_stored_events_are_pruned_by_day_and_written_again_unchanged(spark, tmp_path):
    path = str(tmp_path / "store")
    events, detections, ocr, snapshots = store(spark, 6)
    later = events.selectExpr("site_id", "'f' as id", "gate_id", "timestamp + interval 1 day as timestamp", "container_number",
                              "event_type", "status")
    for _ in range(2):
        event_store.write_events(events.union(later), detections, ocr, snapshots, path, files_per_day=2)
    whole = event_store.read_events(spark, path)
    assert [t.count() for t in (whole.events, whole.detections, whole.ocr, whole.snapshots)] == [2, 6, 6, 6]
    event_store.write_events(later, detections.limit(0), ocr.limit(0), snapshots.limit(0), path)
    assert event_store.read_events(spark, path).detections.count() == 6
    one = event_store.read_events(spark, path, since="2026-01-02")
    assert [r.id for r in one.events.collect()] == ["f"] and one.detections.count() == 0
    plan = one.events._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_companions_are_the_nearest_frames_of_the_lane(spark):
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    events = spark.createDataFrame([("S", "in", "e", at(100.0))], "site_id string, gate_id string, id string, timestamp timestamp_ntz")
    frames = spark.createDataFrame(
        [("S", "in", "a", at(t)) for t in (94.9, 98.0, 102.0, 104.0)] + [("S", "in", "b", at(105.0)), ("S", "in", "c", at(105.1)),
         ("S", "out", "d", at(100.0)), ("T", "in", "a", at(100.0))], "site_id string, gate_id string, camera_id string, frame_timestamp timestamp_ntz")
    got = {r.camera_id: r.timestamp for r in evidence.companion_frames(events, frames).collect()}
    assert got == {"a": at(98.0), "b": at(105.0)}


def test_the_last_incoming_camera_counts(spark):
    current = spark.createDataFrame([("S", "c", "old", dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 1))],
                                    "site_id string, id string, name string, created_at timestamp_ntz, updated_at timestamp_ntz")
    incoming = spark.createDataFrame([("S", "c", "z", 1), ("S", "c", "a", 2)], "site_id string, id string, name string, n int")
    row = tables.upsert_cameras(current, incoming, "2026-02-01 00:00:00", "n").first()
    assert row.name == "a" and row.created_at == dt.datetime(2026, 1, 1)
