"""Detections: cleaning, geometry, tracking, direction and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelake.functions.clock import to_us
from gatelake.functions.geometry import box, clipped, iou
from gatelake.operators import kernels
from gatelake.operators.ordered import bucket, fold_blocks, join_null_safe, mark_chain, newest_per_group, numbered, with_segments
from gatelake.session import materialize
from gatelake.params import CLASS_ALIASES, DEFAULTS, OCR_CLASSES, TARGET_CLASSES, GateParams, micros

CAMERA = ["site_id", "camera_id"]
SOURCE = [*CAMERA, "source_id"]
TRACK = [*SOURCE, "track_id"]


def clean_detections(raw: DataFrame, p: GateParams = DEFAULTS) -> DataFrame:
    """Detections of target classes with a finite, non-empty box inside the image.

    Labels are lower-cased and mapped to their class; rows without a detection are left out.
    """
    aliases = F.create_map(*[F.lit(v) for pair in CLASS_ALIASES.items() for v in pair])
    label = F.lower("label")
    x1, y1, x2, y2 = clipped(F.col("width"), F.col("height"))
    finite = [~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))) for c in ("confidence", "x1", "y1", "x2", "y2")]
    named = raw.withColumn("class_name", F.coalesce(F.try_element_at(aliases, label), label))
    kept = named.where(F.col("class_name").isin(*TARGET_CLASSES) & (F.col("confidence") >= p.confidence_threshold))
    for condition in finite:
        kept = kept.where(condition)
    return kept.select(
        *SOURCE, "sequence", "frame_timestamp", "width", "height", "det_index", "class_name", "confidence",
        x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"),
    ).where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def enrich_with_camera(df: DataFrame, cameras: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Left join with the camera dimension. Spark broadcasts it while it is below the size threshold."""
    chosen = columns or [c for c in cameras.columns if c not in CAMERA]
    return df.join(cameras.select(*CAMERA, *chosen), CAMERA, "left")


def ocr_region(detections: DataFrame, cameras: DataFrame) -> DataFrame:
    """Pixel rectangle of the region to read, with ``status`` REJECTED when it is empty."""
    x1, y1, x2, y2 = clipped(F.col("width"), F.col("height"))
    cut = enrich_with_camera(detections, cameras, ["ocr_roi"]).select(
        *detections.columns, "ocr_roi", x1.alias("_x1"), y1.alias("_y1"), x2.alias("_x2"), y2.alias("_y2"))
    roi = [F.coalesce(F.get("ocr_roi", F.lit(i)), F.lit(d)) for i, d in enumerate((0.0, 0.0, 1.0, 1.0))]

    def edge(low: str, high: str, share: Column) -> Column:
        return F.col(low) + (F.col(high) - F.col(low)) * share

    placed = cut.select(
        *detections.columns,
        ((F.col("_x2") > F.col("_x1")) & (F.col("_y2") > F.col("_y1"))).alias("_inside"),
        F.floor(edge("_x1", "_x2", roi[0])).cast("int").alias("left_px"),
        F.floor(edge("_y1", "_y2", roi[1])).cast("int").alias("top_px"),
        F.least(F.ceil(edge("_x1", "_x2", roi[2])), F.col("width")).cast("int").alias("right_px"),
        F.least(F.ceil(edge("_y1", "_y2", roi[3])), F.col("height")).cast("int").alias("bottom_px"))
    usable = (F.col("_inside") & (F.col("right_px") > F.col("left_px")) & (F.col("bottom_px") > F.col("top_px")))
    return placed.withColumn("status", F.when(usable, "OK").otherwise("REJECTED")).drop("_inside")


def iou_pairs(detections: DataFrame, stride: int = 1) -> DataFrame:
    """Overlap of same-class boxes in frames that follow each other at ``stride`` sequence numbers."""
    keys = [*SOURCE, "class_name", "sequence"]
    earlier = detections.select(
        *SOURCE, "class_name", (F.col("sequence") + stride).alias("sequence"), F.col("det_index").alias("prev_index"),
        *[c.alias(f"p_{n}") for n, c in zip(("x1", "y1", "x2", "y2"), box())])
    later = detections.select(*keys, "det_index", *box())
    return later.join(earlier, keys).select(
        *keys, "prev_index", "det_index", iou(box("p_"), box()).alias("iou"))


def considered_frames(raw: DataFrame, cameras: DataFrame) -> DataFrame:
    """Rows of the frames that are looked at: a camera with ``frame_skip`` n passes every (n + 1)th sequence number on.

    Detector and tracker never see the others, so this comes before tracking.
    """
    return enrich_with_camera(raw, cameras, ["frame_skip"]).where(
        F.col("sequence") % (F.coalesce("frame_skip", F.lit(0)) + 1) == 0).select(*raw.columns)


def track_objects(detections: DataFrame, p: GateParams = DEFAULTS, block_expiries: int = 256) -> DataFrame:
    """Append track_id, hits and first_seen. A detection that comes twice counts once.

    Only boxes of one class compete for a track, and after a pause longer than the track expiry no track is
    left, so (camera, source, class, segment) groups fold independently, those longer than ``block_expiries`` times the
    expiry in blocks. Ids count the track starts of a source in frame order.
    """
    keys, width = [*SOURCE, "class_name"], block_expiries * p.track_ttl_us
    once = detections.dropDuplicates([*SOURCE, "sequence", "det_index"])
    timed = once.withColumn("_us", to_us(F.col("frame_timestamp")))
    folded = fold_blocks(
        with_segments(timed, keys, "_us", p.track_ttl_us), keys, ["_us", "sequence", "det_index"], width,
        ["_us", "sequence", "det_index", "x1", "y1", "x2", "y2"], lambda by: kernels.tracking_fold(by, p.track_ttl_us, p.match_iou),
        lambda by: kernels.tracking_exits(by, p.track_ttl_us, p.match_iou, width),
        "hits bigint, start_us bigint, start_sequence bigint, start_index int")
    folded = materialize(folded, "folded-tracks")
    start = ["start_us", "start_sequence", "start_index"]
    starts = numbered(folded.where("hits = 1").select(*SOURCE, *start), SOURCE, start, micros(3600), "track_id")
    return join_null_safe(folded, starts, [*SOURCE, *start]).select(
        *detections.columns, F.col("track_id").cast("bigint").alias("track_id"), "hits",
        F.timestamp_micros("start_us").cast("timestamp_ntz").alias("first_seen"))


def line_crossing_direction(tracked: DataFrame, cameras: DataFrame) -> DataFrame:
    """Append the direction known at each detection of a track.

    Without a line it is the camera's own. With one, the first move between the two sides decides for good;
    as sides before that move are all equal, it happens when both sides have been seen for the first time,
    and two minimum aggregates per track are enough.
    """
    at = F.struct(F.col("frame_timestamp"), F.col("sequence"))
    joined = enrich_with_camera(
        tracked, cameras, ["direction", "line_axis", "line_position", "line_deadband", "positive_crossing"])
    position = F.when(F.col("line_axis") == "x", (F.col("x1") + F.col("x2")) / (F.col("width") * 2)).otherwise(
        (F.col("y1") + F.col("y2")) / (F.col("height") * 2))
    offset = position - F.col("line_position")
    side = F.when(F.col("line_axis").isNull(), F.lit(None)).when(offset > F.col("line_deadband"), 1).when(
        offset < -F.col("line_deadband"), -1).otherwise(0)
    sided = joined.withColumn("_at", at).withColumn("_side", side)
    crossings = sided.where("_side in (1, -1)").groupBy(*TRACK).agg(
        F.min(F.when(F.col("_side") == 1, F.col("_at"))).alias("_plus"),
        F.min(F.when(F.col("_side") == -1, F.col("_at"))).alias("_minus"),
    ).where("_plus is not null and _minus is not null").select(
        *TRACK, F.greatest("_plus", "_minus").alias("_crossed"), (F.col("_minus") < F.col("_plus")).alias("_positive"))
    other = F.when(F.col("positive_crossing") == "ENTRY", "EXIT").otherwise("ENTRY")
    return sided.join(crossings, TRACK, "left").select(
        *tracked.columns,
        F.when(F.col("line_axis").isNull(), F.col("direction"))
        .when(F.col("_at") >= F.col("_crossed"),
              F.when(F.col("_positive"), F.col("positive_crossing")).otherwise(other))
        .otherwise(F.lit("UNKNOWN")).alias("track_direction"),
        F.col("line_axis").isNotNull().alias("has_line"))


def sample_min_spacing(rows: DataFrame, keys: list[str], interval_seconds: float, max_n: int | None = None,
                       ties: tuple[str, ...] = ("sequence",)) -> DataFrame:
    """Rows of each key chosen greedily at least the interval after the last chosen one, at most ``max_n``."""
    order = ["_us", *ties]
    timed = rows.withColumn("_us", to_us(F.col("frame_timestamp")))
    chosen = mark_chain(timed, keys, order, micros(interval_seconds)).where("taken")
    if max_n is not None:
        chosen = newest_per_group(chosen, keys, [F.col(c) for c in order], max_n)
    return chosen.select(*rows.columns)


def sample_inference_rate(frames: DataFrame, cameras: DataFrame, p: GateParams = DEFAULTS) -> DataFrame:
    """The frames that each source passes to the detector: at most its camera's ``inference_fps``, the common rate if that
    is not set or zero."""
    rate = F.when(F.col("inference_fps") > 0, F.col("inference_fps")).otherwise(F.lit(p.inference_fps))
    timed = enrich_with_camera(frames, cameras, ["inference_fps"]).withColumn("_us", to_us(F.col("frame_timestamp")))
    chosen = mark_chain(timed, SOURCE, ["_us", "sequence"], F.round(F.lit(1_000_000) / rate)).where("taken")
    return chosen.select(*frames.columns)


def ocr_candidates(directed: DataFrame, p: GateParams = DEFAULTS) -> DataFrame:
    """Detections to read, of tracks over the considered frames: stable tracks of readable classes whose direction is settled, sampled in time."""
    ready = directed.where(
        (F.col("hits") >= p.min_track_hits) & F.col("class_name").isin(*OCR_CLASSES)
        & ~(F.col("has_line") & (F.col("track_direction") == "UNKNOWN")))
    return sample_min_spacing(ready, TRACK, p.ocr_interval_seconds, p.ocr_max_attempts, ("sequence", "det_index"))


def dropped_frames(frames: DataFrame, first_sequence: int | None = None) -> DataFrame:
    """Frames per source that were superseded before anything consumed them.

    Summing the jumps between consumed sequence numbers telescopes to last minus first plus one minus number consumed.
    ``first_sequence`` is the number that sources start with; give it only if the rows hold the sources from their
    start, as the frames before the first consumed one count as dropped then.
    """
    first = F.min("sequence") if first_sequence is None else F.lit(first_sequence)
    return frames.groupBy(*SOURCE).agg(
        F.countDistinct("sequence").alias("consumed"), (F.max("sequence") - first + 1).alias("_span")).select(
        *SOURCE, "consumed", (F.col("_span") - F.col("consumed")).alias("dropped"))


def overlay_asof(frames: DataFrame, inferences: DataFrame, max_age_seconds: float = 0.3) -> DataFrame:
    """For each preview frame the latest inference of its source that is not older than the limit.

    An inference can only serve frames of its own time bucket and the next one, so it is sent to these two
    and the ordered search runs per bucket instead of per camera.
    """
    age = micros(max_age_seconds)
    seen = inferences.select(
        *SOURCE, to_us(F.col("frame_timestamp")).alias("_us"), F.col("sequence").alias("_seq"), "n_detections")
    shared = seen.select(
        "*", F.explode(F.array(bucket(F.col("_us"), age), bucket(F.col("_us"), age) + 1)).alias("_bucket"))
    left = frames.select(*SOURCE, to_us(F.col("frame_timestamp")).alias("_us"), "sequence").withColumn(
        "_bucket", bucket(F.col("_us"), age))
    both = left.select(*SOURCE, "_bucket", "_us", "sequence", F.lit(1).alias("_kind"),
                       F.lit(None).cast("struct<us: bigint, seq: bigint, n: bigint>").alias("_hit")).unionByName(
        shared.select(*SOURCE, "_bucket", "_us", F.col("_seq").alias("sequence"), F.lit(0).alias("_kind"),
                      F.struct(F.col("_us").alias("us"), F.col("_seq").alias("seq"),
                               F.col("n_detections").cast("bigint").alias("n")).alias("_hit")))
    w = Window.partitionBy(*SOURCE, "_bucket").orderBy("_us", "_kind", "sequence").rowsBetween(
        Window.unboundedPreceding, 0)
    matched = both.withColumn("_last", F.last("_hit", ignorenulls=True).over(w)).where("_kind = 1")
    fresh = F.when(F.col("_us") - F.col("_last.us") <= age, F.col("_last"))
    return matched.withColumn("_last", fresh).select(
        *SOURCE, "sequence", F.col("_us").alias("frame_us"), F.col("_last.us").alias("inference_us"),
        F.col("_last.seq").alias("inference_sequence"), F.col("_last.n").alias("n_detections"))


def overlay_nearby(frames: DataFrame, detections: DataFrame, tolerance_seconds: float = 0.8, limit: int = 10) -> DataFrame:
    """Detections of the camera within the tolerance of a frame, the newest ``limit`` of them."""
    tolerance = micros(tolerance_seconds)
    left = frames.select(*CAMERA, "sequence", to_us(F.col("frame_timestamp")).alias("frame_us")).withColumn(
        "_bucket", bucket(F.col("frame_us"), tolerance))
    right = detections.select(
        *CAMERA, to_us(F.col("frame_timestamp")).alias("detection_us"), F.col("sequence").alias("detection_sequence"),
        "det_index", "class_name")
    right = right.withColumn("_bucket", F.explode(F.transform(
        F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: bucket(F.col("detection_us"), tolerance) + i)))
    near = left.join(right, [*CAMERA, "_bucket"]).where(
        F.abs(F.col("frame_us") - F.col("detection_us")) <= tolerance)
    w = Window.partitionBy(*CAMERA, "sequence", "frame_us").orderBy(
        F.desc("detection_us"), F.desc("detection_sequence"), F.desc("det_index"))
    return near.withColumn("nearness", F.row_number().over(w)).where(F.col("nearness") <= limit).drop("_bucket")


def frames_of(raw: DataFrame) -> DataFrame:
    """One row per frame with the number of raw detections on it (0 for an empty frame)."""
    return raw.groupBy(*SOURCE, "sequence", "frame_timestamp").agg(F.count("label").alias("n_detections"))
