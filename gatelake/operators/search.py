"""The read side: filters, paging, and bulk retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelake.operators.evidence import event_sizes

PAGE_MAX = 200  # fixed value: largest page a caller may ask for


def _checked(limit: int, offset: int) -> tuple[int, int]:
    if not 1 <= limit <= PAGE_MAX or offset < 0:
        raise ValueError(f"limit must be 1 to {PAGE_MAX} and offset not negative")
    return limit, offset


def events_seen_by_camera(events: DataFrame, detections: DataFrame, camera_id: str) -> DataFrame:
    """Events with at least one detection from the camera."""
    seen = detections.where(F.col("camera_id") == camera_id).select("site_id", F.col("event_id").alias("id"))
    return events.join(seen, ["site_id", "id"], "left_semi")


def matching_events(events: DataFrame, detections: DataFrame, container: str | None = None,
                    camera_id: str | None = None, event_type: str | None = None,
                    status: str | None = None) -> DataFrame:
    """All events that satisfy the given filters; filters not given do not apply."""
    result = events
    if container:
        result = result.where(F.col("container_number") == container.upper())
    if event_type:
        result = result.where(F.col("event_type") == event_type)
    if status:
        result = result.where(F.col("status") == status)
    if camera_id:
        result = events_seen_by_camera(result, detections, camera_id)
    return result


def search_events(events: DataFrame, detections: DataFrame, ocr: DataFrame | None = None, container: str | None = None,
                  camera_id: str | None = None, event_type: str | None = None, status: str | None = None,
                  limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of matching events, newest first, equal times by id; with ``ocr`` each has its size and size code.

    Sizes are looked up for the events of the page only.
    """
    limit, offset = _checked(limit, offset)
    found = matching_events(events, detections, container, camera_id, event_type, status)
    order = [F.desc("timestamp"), "id", "site_id"]
    page = found.orderBy(*order).offset(offset).limit(limit)
    return page if ocr is None else with_sizes(page, detections, ocr).orderBy(*order)


def with_sizes(page: DataFrame, detections: DataFrame, ocr: DataFrame) -> DataFrame:
    """The events of a page with size and size code, which are looked up for them only."""
    shown = page.select("site_id", F.col("id").alias("event_id"))
    evidence = detections.join(shown, ["site_id", "event_id"], "left_semi")
    reads = ocr.join(evidence.select("site_id", F.col("id").alias("detection_id")), ["site_id", "detection_id"], "left_semi")
    sizes = event_sizes(evidence, reads).withColumnRenamed("event_id", "id")
    return page.join(sizes, ["site_id", "id"], "left")


def count_events(events: DataFrame, detections: DataFrame, **filters) -> DataFrame:
    """Number of matching events before paging."""
    return matching_events(events, detections, **filters).agg(F.count(F.lit(1)).alias("total"))


def recent_ocr(ocr: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    limit, offset = _checked(limit, offset)
    return ocr.orderBy(F.desc("timestamp"), F.desc("id")).offset(offset).limit(limit)


def recent_detections(detections: DataFrame, limit: int = 50, camera_id: str | None = None,
                      buffer: int | None = None) -> DataFrame:
    """Newest detections of a camera; with ``buffer`` only those among the newest so many of all cameras."""
    order = [F.desc("frame_timestamp"), F.desc("site_id"), F.desc("camera_id"), F.desc("sequence"), F.desc("det_index")]
    newest = detections if buffer is None else detections.orderBy(*order).limit(buffer)
    if camera_id is not None:
        newest = newest.where(F.col("camera_id") == camera_id)
    return newest.orderBy(*order).limit(limit)


def rows_for_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows whose key is asked for, and the asked keys without a row."""
    wanted = ids.select("site_id", key).distinct()
    return df.join(wanted, ["site_id", key], "left_semi"), wanted.join(df, ["site_id", key], "left_anti")


def next_jobs(jobs: DataFrame, now: float, k: int = 1) -> DataFrame:
    """The oldest ``k`` pending jobs of a site that are due."""
    due = jobs.where((F.col("state") == "PENDING") & (F.col("retry_at") <= now))
    w = Window.partitionBy("site_id").orderBy("id")
    return due.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= k)


def next_job_per_origin(jobs: DataFrame, now: float) -> DataFrame:
    """The oldest due job of every origin."""
    due = jobs.where((F.col("state") == "PENDING") & (F.col("retry_at") <= now))
    return due.groupBy("site_id", "origin").agg(F.min("id").alias("id"))


def event_evidence(events: DataFrame, detections: DataFrame, ocr: DataFrame) -> DataFrame:
    """Events with their detections and reads, flat; events without evidence stay."""
    d = detections.select(
        "site_id", F.col("event_id").alias("id"), F.col("id").alias("detection_id"), "camera_id", "track_id",
        "class_name", F.col("confidence").alias("detection_confidence"))
    o = ocr.select("site_id", "detection_id", F.col("id").alias("ocr_id"), "normalized_text", "validation_status",
                   F.col("confidence").alias("ocr_confidence"))
    return events.join(d, ["site_id", "id"], "left").join(o, ["site_id", "detection_id"], "left")


def event_images(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Events with their images, flat."""
    s = snapshots.select("site_id", F.col("event_id").alias("id"), F.col("id").alias("snapshot_id"), "image_path",
                         F.col("camera_id").alias("image_camera_id"))
    return events.join(s, ["site_id", "id"], "left")
