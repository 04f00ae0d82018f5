"""Registered queries: every operator applied to tables derived from the session's star-schema tables.

Nested results are returned as JSON text, so that any engine can compare them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.operators import associate, confirm, detect, evidence, ledger, metrics, search, text
from gatelake.plans import pipeline
from gatelake.session import materialize, work_dir
from gatelake.sources import driver_tables as d
from gatelake.sources import store as event_store
from gatelake.sources import tables
from gatelake.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _reads(s, sf):
    return d.reads(s, sf)


def _once(s, sf):
    return confirm.first_arrivals(d.reads(s, sf), ["site_id", "origin_key", "sequence"])


def _assigned(s, sf):
    return pipeline.assignments(d.reads(s, sf))


def _store(s, sf):
    return pipeline.event_tables(_assigned(s, sf))


def _clean(s, sf):
    return detect.clean_detections(d.raw_detections(s, sf))


def _tracked(s, sf):
    return detect.track_objects(_clean(s, sf))


def _directed(s, sf):
    return pipeline.directed_tracks(d.raw_detections(s, sf), d.cameras(s))


def _jobs(s, sf):
    once = _once(s, sf)
    return d.spool_jobs(text.validate_reads(once))


# Sources and sinks --------------------------------------------------------------------------------


@query
def load_detections(s, sf):
    path = work_dir(s, "raw-detections")
    d.raw_detections(s, sf).write.parquet(path)
    return tables.load_detections(s, path)


@query
def parse_ocr_jobs(s, sf):
    parsed = tables.parse_ocr_jobs(_jobs(s, sf)).withColumns({c: F.to_json(c) for c in ("bbox", "ocr_roi")})
    other = F.get("all_detections", F.lit(0))
    return parsed.withColumns({"other_class": other["class_name"], "other_bbox": F.to_json(other["bbox"])}).drop(
        "all_detections", "read_text")


@query
def camera_registry_check(s, sf):
    checked = tables.camera_registry_check(d.camera_registry(s, sf))
    return checked.withColumn("violations", F.to_json("violations"))


@query
def upsert_cameras(s, sf):
    return tables.upsert_cameras(d.registered_cameras(s, sf), d.incoming_cameras(s, sf), "2026-03-01 00:00:00", "arrival")


@query
def fk_violations(s, sf):
    store = _store(s, sf)
    known = d.cameras(s).where("not (site_id = 'S2' and camera_id = 'gate-out-4')")
    return evidence.fk_violations(
        known, store.events.where("status = 'CONFIRMED'"), store.detections, store.ocr, store.snapshots,
        evidence.audit_log(store.assignments), detection_parents=store.detections.where("track_id % 11 <> 0"))


@query
def event_documents(s, sf):
    store = _store(s, sf)
    documents = evidence.event_documents(store.events, store.detections, store.ocr, store.snapshots)
    return documents.withColumns({c: F.to_json(c) for c in ("detections", "ocr_results", "snapshots")}).withColumn(
        "event_date", F.col("event_date").cast("string"))


@query
def audit_log(s, sf):
    return evidence.audit_log(_assigned(s, sf)).withColumn("context", F.to_json("context"))


@query
def orphan_images(s, sf):
    store = _store(s, sf)
    on_disk = _reads(s, sf).where("camera_id <> 'gate-in-3'").select(
        "site_id", F.concat_ws("/", associate.stable_id("event", F.col("origin_key")), "camera_id",
                               F.concat("track_id", F.lit(".jpg"))).alias("path"))
    return evidence.orphan_images(on_disk, store.snapshots)


# Text ---------------------------------------------------------------------------------------------

_READ = ["origin_key", "sequence", "arrival", "raw_text"]


@query
def normalize_text(s, sf):
    return text.normalize_text(_reads(s, sf).select(_READ))


@query
def iso6346_check_digit(s, sf):
    return text.iso6346_check_digit(_reads(s, sf).select(_READ))


@query
def fix_size_code(s, sf):
    return text.fix_size_code(_reads(s, sf).select(_READ))


@query
def validate_reads(s, sf):
    return text.validate_reads(_reads(s, sf).select(*_READ, "confidence"))


@query
def container_feet_size(s, sf):
    return text.container_feet_size(_reads(s, sf).select(_READ))


@query
def extract_size_code(s, sf):
    return text.extract_size_code(text.fix_size_code(_reads(s, sf).select(_READ)).drop("raw_text").withColumnRenamed(
        "corrected_text", "raw_text"))


@query
def clean_generated_text(s, sf):
    return text.clean_generated_text(d.generated_texts(s, sf))


@query
def assemble_fragments(s, sf):
    return text.assemble_fragments(d.ocr_fragments(s, sf), d.ocr_crops(s, sf))


# Detections ---------------------------------------------------------------------------------------


@query
def clean_detections(s, sf):
    return _clean(s, sf)


@query
def ocr_region(s, sf):
    return detect.ocr_region(_clean(s, sf), d.cameras(s)).drop("width", "height")


@query
def iou_pairs(s, sf):
    return detect.iou_pairs(_clean(s, sf))


@query
def evidence_keys(s, sf):
    keyed = _reads(s, sf).select("site_id", "camera_id", F.lit("src0-generation-1").alias("source_id"), "origin_key",
                                 "track_id", "sequence", F.lit("feet").alias("class_name"),
                                 (F.lit(12.7) + F.col("track_id") % 5).alias("x1"))
    return evidence.evidence_keys(keyed, d.RUN_ID).drop("x1", "class_name")


@query
def event_table_rows(s, sf):
    store = _store(s, sf)
    sizes = evidence.event_sizes(store.detections, store.ocr).withColumnRenamed("event_id", "id")
    return evidence.event_table_rows(store.events.join(sizes, ["site_id", "id"], "left"))


@query
def track_objects(s, sf):
    return _tracked(s, sf).select("site_id", "camera_id", "source_id", "sequence", "det_index", "class_name", "track_id",
                                  "hits", "first_seen")


@query
def line_crossing_direction(s, sf):
    return _directed(s, sf).select("site_id", "camera_id", "source_id", "sequence", "det_index", "track_id",
                                   "track_direction")


@query
def sample_min_spacing(s, sf):
    frames = detect.frames_of(d.raw_detections(s, sf))
    return detect.sample_min_spacing(frames, detect.SOURCE, 1 / 3).select(*detect.SOURCE, "sequence")


@query
def sample_inference_rate(s, sf):
    frames = detect.frames_of(d.raw_detections(s, sf))
    return detect.sample_inference_rate(frames, d.cameras(s)).select(*detect.SOURCE, "sequence")


@query
def ocr_candidates(s, sf):
    directed = materialize(_directed(s, sf), "directed")
    return detect.ocr_candidates(directed).select(
        "site_id", "camera_id", "source_id", "track_id", "sequence", "det_index", "hits", "track_direction")


@query
def dropped_frames(s, sf):
    return detect.dropped_frames(d.raw_detections(s, sf))


# Confirmation and association ---------------------------------------------------------------------


@query
def confirm_reads(s, sf):
    decisive = confirm.first_attempts(d.reads(s, sf))
    return confirm.confirm_reads(text.validate_reads(decisive, ordered=True), decisive=True).drop("arrival", "started_at", "corrected_text")


@query
def read_votes(s, sf):
    return confirm.read_votes(text.validate_reads(_once(s, sf)))


@query
def associate_events(s, sf):
    return _assigned(s, sf).select("site_id", "gate_id", "direction", "origin_key", "frame_timestamp", "confirmed",
                                   "container_number", "event_id", "created", "promoted", "event_timestamp")


@query
def gate_events(s, sf):
    return _store(s, sf).events


@query
def dedup_visits(s, sf):
    return associate.dedup_visits(pipeline.observations(d.reads(s, sf)))


@query
def confirmed_visits(s, sf):
    return pipeline.confirmed_visits(s, sf)


@query
def idempotent_append(s, sf):
    stored = d.job_transitions(s, sf).where("kind = 'completed'").select(
        "site_id", F.col("job_id").alias("track_id")).distinct()
    incoming = _reads(s, sf).select("site_id", "track_id", "sequence", "arrival", "raw_text", "confidence").withColumn(
        "site_id", F.concat(F.lit("S"), F.col("track_id") % 4))
    return associate.idempotent_append(stored, incoming, ["site_id", "track_id"],
                                       ["sequence", "arrival", "raw_text", "confidence"])


@query
def evidence_rows(s, sf):
    return _store(s, sf).detections.withColumn("bbox", F.to_json("bbox"))


# Joins --------------------------------------------------------------------------------------------


@query
def enrich_with_camera(s, sf):
    reads = _reads(s, sf).select("site_id", "camera_id", "origin_key", "sequence", "arrival")
    return detect.enrich_with_camera(reads, d.cameras(s), ["role", "gate_id", "direction", "ocr_roi"]).withColumn(
        "ocr_roi", F.to_json("ocr_roi"))


@query
def events_seen_by_camera(s, sf):
    store = _store(s, sf)
    return search.events_seen_by_camera(store.events, store.detections, "gate-in-2")


@query
def event_evidence(s, sf):
    store = _store(s, sf)
    return search.event_evidence(store.events, store.detections, store.ocr)


@query
def event_images(s, sf):
    store = _store(s, sf)
    return search.event_images(store.events, store.snapshots)


@query
def candidate_events(s, sf):
    store = _store(s, sf)
    return associate.candidate_events(store.assignments, store.events)


@query
def overlay_asof(s, sf):
    raw = d.raw_detections(s, sf)
    frames = detect.frames_of(raw)
    return detect.overlay_asof(frames, frames.where("sequence % 3 = 0"))


@query
def overlay_nearby(s, sf):
    return detect.overlay_nearby(detect.frames_of(d.raw_detections(s, sf)), _clean(s, sf))


# Query surface ------------------------------------------------------------------------------------


def _written_store(s, sf):
    """The event store on disk, written once per application and input; searches only read it."""
    def build():
        store, path = _store(s, sf), work_dir(s, "event-store")
        event_store.write_events(store.events, store.detections, store.ocr, store.snapshots, path)
        return path
    return event_store.kept_store(s, sf, build)


@query
def search_events(s, sf):
    store = event_store.read_events(s, _written_store(s, sf))
    return search.search_events(store.events, store.detections, store.ocr, camera_id="gate-in-1", event_type="ENTRY",
                                status="CONFIRMED", limit=50, offset=10).drop("day")


@query
def count_events(s, sf):
    store = event_store.read_events(s, _written_store(s, sf))
    return search.count_events(store.events, store.detections, camera_id="gate-in-1", event_type="ENTRY",
                               status="CONFIRMED")


@query
def search_store(s, sf):
    stored = event_store.read_events(s, _written_store(s, sf), since="2026-01-01", until="2026-01-02")
    return search.search_events(stored.events, stored.detections, stored.ocr, container="tclu0316764", limit=200).drop("day")


@query
def search_pages(s, sf):
    """The second page of the confirmed entries of a camera, by the cursor of the first; empty if there is none."""
    path, filters = _written_store(s, sf), {"camera_id": "gate-in-1", "event_type": "ENTRY", "status": "CONFIRMED"}
    _, cursor = event_store.search_page(s, path, 20, sizes=False, **filters)
    return event_store.search_page(s, path, 20, cursor or (dt.datetime.min, "", ""), **filters)[0].drop("day")


@query
def event_sizes(s, sf):
    store = _store(s, sf)
    return evidence.event_sizes(store.detections, store.ocr)


@query
def recent_ocr(s, sf):
    return search.recent_ocr(_store(s, sf).ocr, 50, 25)


@query
def recent_detections(s, sf):
    return search.recent_detections(_clean(s, sf), 20, "gate-in-3").drop("width", "height")


@query
def rows_for_ids(s, sf):
    store = _store(s, sf)
    asked = _reads(s, sf).select("site_id", associate.stable_id("event", F.col("origin_key")).alias("id"))
    found, missing = search.rows_for_ids(store.events, asked)
    return found.select("site_id", "id", "status").unionByName(
        missing.select("site_id", "id", F.lit("MISSING").alias("status")))


@query
def next_jobs(s, sf):
    return search.next_jobs(_jobs(s, sf), 200.0, 100).select("site_id", "id", "origin", "sequence", "retry_at", "turn")


@query
def next_job_per_origin(s, sf):
    return search.next_job_per_origin(_jobs(s, sf), 200.0)


@query
def snapshot_manifest(s, sf):
    store = _store(s, sf)
    frames = _reads(s, sf).select("site_id", "gate_id", "camera_id", "frame_timestamp")
    return evidence.snapshot_manifest(store.assignments, evidence.companion_frames(store.events, frames))


# Ledger and outbox --------------------------------------------------------------------------------


@query
def job_ledger(s, sf):
    return ledger.job_ledger(d.job_transitions(s, sf))


@query
def recover_evidence(s, sf):
    return ledger.recover_evidence(_jobs(s, sf)).withColumn("read_texts", F.to_json("read_texts"))


@query
def spool_replay(s, sf):
    """Observations after a restart of the edge from its spool; they are those of an uninterrupted run."""
    texts = _once(s, sf).select("site_id", F.col("origin_key").alias("origin"), "sequence", "raw_text", "confidence")
    return confirm.replay_spool(_jobs(s, sf), texts).select(
        "site_id", "origin_key", "sequence", "frame_timestamp", "normalized_text", "confidence", "confirmed",
        "container_number", "attempts", "known_event_id")


@query
def spool_status(s, sf):
    return ledger.spool_status(_jobs(s, sf), max_bytes=9_000_000)


@query
def outbox_payloads(s, sf):
    return ledger.outbox_payloads(_assigned(s, sf))


@query
def outbox_schedule(s, sf):
    return ledger.outbox_schedule(d.outbox_attempts(s, sf))


@query
def outbox_counts(s, sf):
    return ledger.outbox_counts(ledger.outbox_schedule(d.outbox_attempts(s, sf)))


# Metrics ------------------------------------------------------------------------------------------


@query
def counters(s, sf):
    return metrics.counters(d.metric_samples(s, sf))


@query
def latency_quantiles(s, sf):
    return metrics.latency_quantiles(d.metric_samples(s, sf))


@query
def rolling_fps(s, sf):
    return metrics.rolling_fps(detect.frames_of(d.raw_detections(s, sf)))


@query
def fleet_status(s, sf):
    jobs = ledger.job_ledger(d.job_transitions(s, sf)).where("job_id % 2 = 0").select(
        F.concat(F.lit("N"), F.col("job_id") % 40).alias("site_id"), "state", "error_type")
    spool = jobs.groupBy("site_id").agg(F.count_if(F.col("state") == "PENDING").alias("pending"),
                                        F.count("error_type").alias("failed"))
    return metrics.fleet_status(d.camera_status(s, sf), spool)


@query
def event_summary(s, sf):
    return metrics.event_summary(_store(s, sf).events)


@query
def event_latency(s, sf):
    return metrics.event_latency(_assigned(s, sf))


# Streams ------------------------------------------------------------------------------------------


@query
def stream_tracks(s, sf):
    tracked, _ = streams.replay(_clean(s, sf), "frame_timestamp", "stream-tracks",
                                lambda rows, path: streams.run_available(streams.stream_tracks(rows), path))
    return tracked


@query
def stream_confirm(s, sf):
    emitted, _ = streams.replay(
        d.reads(s, sf), "frame_timestamp", "stream-confirm", timed=True,
        drive=lambda rows, path: streams.run_available(streams.stream_confirm(text.validate_reads(rows)), path))
    return emitted.select("site_id", "origin_key", "sequence", "frame_timestamp", "normalized_text", "confidence",
                          "confirmed", "container_number", "attempts")


def _streamed_events(s, sf, table):
    rows = pipeline.observations(d.reads(s, sf)).select("site_id", "gate_id", "direction", "origin_key", "frame_timestamp",
                                                        "confirmed", "container_number")
    found, _ = streams.replay(rows, "frame_timestamp", "stream-events",
                              lambda rows, path: streams.run_events(streams.stream_events(rows), path)[table])
    return found.drop("version")


@query
def stream_events(s, sf):
    return _streamed_events(s, sf, 0)


@query
def stream_gate_events(s, sf):
    return _streamed_events(s, sf, 1)


@query
def stream_dedup(s, sf):
    once, _ = streams.replay(d.reads(s, sf), "frame_timestamp", "stream-dedup", delay="10 minutes",
                             drive=lambda rows, path: streams.run_available(streams.stream_dedup(rows), path))
    return once


@query
def stream_fps(s, sf):
    keys = ["site_id", "camera_id", "window_start"]
    rates, _ = streams.replay(detect.frames_of(d.raw_detections(s, sf)), "frame_timestamp", "stream-fps", delay=None,
                              drive=lambda rows, path: streams.run_updates(streams.stream_fps(rows, delay="1 day"), path, keys))
    return rates


@query
def stream_late_rows(s, sf):
    """Reads of which some arrive three slices late: what the stream takes, and what it sets apart."""
    columns = ["site_id", "origin_key", "sequence", "arrival"]
    taken, late = streams.replay(
        d.reads(s, sf), "frame_timestamp", "stream-late", late=F.expr("(track_id * 7 + sequence) % 10 = 0"),
        drive=lambda rows, path: streams.run_available(rows.select(*columns), path))
    return taken.withColumn("late", F.lit(False)).unionByName(late.select(*columns).withColumn("late", F.lit(True)))


@query
def stream_outbox(s, sf):
    return streams.replay_outbox(_assigned(s, sf), "stream-outbox")
