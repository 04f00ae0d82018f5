"""Readers, quarantine and registry maintenance for gate tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.operators.ordered import join_null_safe
from gatelake.schemas import DETECTION_ROWS, JOB_METADATA, JOB_VALIDATION

# Limits of the camera registry.
ID_PATTERN = r"^[A-Za-z0-9_-]{1,64}\z"
SOURCE_ENV_PATTERN = r"^[A-Z][A-Z0-9_]+\z"
MAX_VIEWS, MAX_SOURCES = 8, 32
DOMAINS = {
    "role": ("UNASSIGNED", "FRONT_TOP", "LEFT", "RIGHT", "REAR"), "direction": ("ENTRY", "EXIT", "UNKNOWN"),
    "source_type": ("rtsp", "file"), "line_axis": ("x", "y"), "positive_crossing": ("ENTRY", "EXIT"),
}


def load_detections(spark: SparkSession, path: str, streaming: bool = False, max_files: int = 64) -> DataFrame:
    """Detector rows from Parquet with a fixed schema; frames without detections are rows with a null box."""
    if streaming:
        return (spark.readStream.schema(DETECTION_ROWS).option("maxFilesPerTrigger", max_files).parquet(path))
    return spark.read.schema(DETECTION_ROWS).parquet(path)


def parse_ocr_jobs(jobs: DataFrame) -> DataFrame:
    """Typed columns of the JSON documents of a spool row; ``damaged`` marks rows whose JSON does not parse.

    Everything a replay of the spool needs is there: region, crop and image, and all detections of the frame.
    """
    parsed = jobs.select(
        "*", F.from_json("metadata", JOB_METADATA).alias("_m"), F.from_json("validation", JOB_VALIDATION).alias("_v"))
    moment = lambda c: F.try_to_timestamp(c).cast("timestamp_ntz")
    return parsed.select(
        "site_id", "id", "origin", "sequence", "state", "event_id", "attempts", "retry_at", "error_type",
        "payload_bytes", F.col("_m.gate_id").alias("gate_id"), F.col("_m.track_id").alias("track_id"),
        F.col("_m.direction").alias("direction"), F.col("_m.role").alias("role"),
        moment(F.col("_m.started_at")).alias("started_at"),
        F.col("_m.detection.camera_id").alias("camera_id"), F.col("_m.detection.class_name").alias("class_name"),
        F.col("_m.detection.confidence").alias("detection_confidence"), F.col("_m.detection.bbox").alias("bbox"),
        moment(F.col("_m.frame.timestamp")).alias("frame_timestamp"), F.col("_m.frame.source_id").alias("source_id"),
        F.size("_m.all_detections").alias("detections_on_frame"), F.col("_m.all_detections").alias("all_detections"),
        F.col("_m.roi").alias("ocr_roi"), "crop", "image", F.col("_v.raw_text").alias("read_text"),
        F.col("_v.normalized_text").alias("normalized_text"), F.col("_v.validation_status").alias("validation_status"),
        F.col("_v.valid_check_digit").alias("valid_check_digit"), F.col("_v.confidence").alias("read_confidence"),
        (F.col("_m.frame.sequence").isNull()
         | (F.col("validation").isNotNull() & F.col("_v.validation_status").isNull())).alias("damaged"))


def camera_registry_check(cameras: DataFrame) -> DataFrame:
    """Every view with the list of rules it breaks; a rule on a value that is missing does not apply, but ``required`` does."""
    roi = [F.get("ocr_roi", F.lit(i)) for i in range(4)]
    counts = cameras.where("id is not null").groupBy("site_id", "id").agg(F.count(F.lit(1)).alias("_same"))
    views = cameras.groupBy("site_id").agg(F.count(F.lit(1)).alias("_views"),
                                           F.countDistinct("source_env").alias("_sources"))
    required = [F.col(c).isNull() for c in ("id", "name", "gate_id", "source_env", "ocr_roi")]
    rules = [
        ("required", reduce(lambda a, b: a | b, required)),
        ("id_pattern", ~F.col("id").rlike(ID_PATTERN)),
        ("id_unique", F.col("_same") > 1),
        ("gate_id", (F.length("gate_id") < 1) | (F.length("gate_id") > 64)),
        ("source_env", ~F.col("source_env").rlike(SOURCE_ENV_PATTERN) | (F.length("source_env") > 100)),
        ("capture_fps", (F.col("capture_fps") <= 0) | (F.col("capture_fps") > 120)),
        ("inference_fps", (F.col("inference_fps") <= 0) | (F.col("inference_fps") > 60)),
        ("frame_skip", (F.col("frame_skip") < 0) | (F.col("frame_skip") > 120)),
        ("ocr_roi", ~((roi[0] >= 0) & (roi[0] < roi[2]) & (roi[2] <= 1)
                      & (roi[1] >= 0) & (roi[1] < roi[3]) & (roi[3] <= 1))),
        ("line_position", (F.col("line_position") <= 0) | (F.col("line_position") >= 1)),
        ("line_deadband", (F.col("line_deadband") < 0) | (F.col("line_deadband") >= 0.5)),
        ("name", F.length("name") > 100),
        *[(c, ~F.col(c).isin(*allowed)) for c, allowed in DOMAINS.items() if c in cameras.columns],
        ("max_views", F.col("_views") > MAX_VIEWS),
        ("max_sources", F.col("_sources") > MAX_SOURCES),
    ]
    broken = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules]), lambda x: x.isNotNull())
    counted = join_null_safe(join_null_safe(cameras, counts, ["site_id", "id"], "left"), views, ["site_id"])
    return counted.select("site_id", "id", "name", broken.alias("violations"))


def upsert_cameras(current: DataFrame, incoming: DataFrame, now: str, order: str | None = None) -> DataFrame:
    """Insert or overwrite by site and id; the creation time survives, the update time is ``now``.

    Of several incoming rows of one id the last by the column ``order`` counts, without one the largest by their values.
    All other incoming columns are stored.
    """
    keys = ["site_id", "id"]
    stamp = F.lit(now).cast("timestamp_ntz")
    fields = [c for c in incoming.columns if c not in (*keys, order)]
    values = F.struct(*fields)
    new = incoming.groupBy(*keys).agg((F.max(values) if order is None else F.max_by(values, order)).alias("_new"))
    old = current.select(*keys, F.struct(*fields).alias("_old"), "created_at", "updated_at")
    both = old.join(new, keys, "full_outer")
    return both.select(
        *keys, *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c)
                 for c in fields],
        F.coalesce("created_at", stamp).alias("created_at"),
        F.when(F.col("_new").isNotNull(), stamp).otherwise(F.col("updated_at")).alias("updated_at"))


def image_files(spark: SparkSession, root: str, site_id: str) -> DataFrame:
    """Files below a folder by relative path; their bytes are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.jpg").load(root).select("path")
    marker = root.rstrip("/") + "/"
    return listed.select(F.lit(site_id).alias("site_id"),
                         F.substring_index("path", marker, -1).alias("path"))
