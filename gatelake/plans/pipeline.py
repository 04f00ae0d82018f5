"""The two halves of the gate pipeline, composed from operators.

Detection side: raw detections -> cleaned -> tracked -> directed -> OCR candidates.
Event side: reads -> validated -> observations -> assignments -> events and their evidence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.operators import associate, confirm, detect, evidence, text
from gatelake.params import DEFAULTS, GateParams
from gatelake.session import materialize
from gatelake.sources import driver_tables


@dataclass(frozen=True)
class EventTables:
    """Relational event store derived from assignments."""

    assignments: DataFrame
    events: DataFrame
    detections: DataFrame
    ocr: DataFrame
    snapshots: DataFrame


def with_frame_evidence(observations: DataFrame) -> DataFrame:
    """Derived boxes of the frame an observation comes from: the container, and feet or a truck beside it."""
    item = "named_struct('class_name', '{0}', 'confidence', {1}D, 'bbox', array({2}, 60D, 40D, 78D))"
    feet = [item.format("feet", c, f"12.{d}D + track_id % 5") for c, d in ((0.5, 2), (0.6, 7))]
    truck = item.format("truck", 0.7, "3.5D + track_id % 9")
    same = item.format("container", 0.8, "1D")
    return observations.selectExpr(
        "*", "'container' as class_name", "(35 + track_id % 60) / 100D as detection_confidence",
        "array(10D + track_id % 50, 20D, 110D + track_id % 50, 80D) as bbox",
        f"concat(array({same}), if(track_id % 3 = 0, array({', '.join(feet)}), array()), "
        f"if(track_id % 4 = 0, array({truck}), array())) as all_detections")


def observations(reads: DataFrame, p: GateParams = DEFAULTS) -> DataFrame:
    """Written once: the segments and the ordered fold after it both read it."""
    return materialize(confirm.confirm_reads(
        text.validate_reads(confirm.first_attempts(reads, p), ordered=True), p, decisive=True), "observations")


def assignments(reads: DataFrame, p: GateParams = DEFAULTS) -> DataFrame:
    """Written once: every table of the event store is derived from it."""
    # The boxes are the same rows with or without an event, so the fold need not carry them.
    return materialize(with_frame_evidence(associate.associate_events(observations(reads, p), p)), "assignments")


def event_tables(assigned: DataFrame) -> EventTables:
    return EventTables(assigned, associate.gate_events(assigned), evidence.evidence_rows(assigned),
                       evidence.ocr_rows(assigned), evidence.snapshot_manifest(assigned))


def directed_tracks(raw: DataFrame, cameras: DataFrame, p: GateParams = DEFAULTS) -> DataFrame:
    """Tracks over the frames that each camera's frame skip lets through."""
    tracked = detect.track_objects(detect.clean_detections(detect.considered_frames(raw, cameras), p), p)
    return detect.line_crossing_direction(tracked, cameras)


def confirmed_visits(spark: SparkSession, sf_dir: str, gate_id: str = "lane-in") -> DataFrame:
    """Confirmed container visits of a lane, newest first: the flagship question."""
    lane = driver_tables.reads(spark, sf_dir).where(F.col("gate_id") == gate_id)
    visits = associate.dedup_visits(observations(lane))
    return visits.orderBy(F.desc("first_seen"), "site_id", "container_number")
