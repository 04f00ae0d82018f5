"""Counters, latency ranks, rates and health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelake.functions.clock import to_us
from gatelake.operators.ordered import bucket, exact_quantiles, newest_per_group
from gatelake.params import micros


def counters(log: DataFrame) -> DataFrame:
    return log.groupBy("site_id", "key").agg(F.count(F.lit(1)).alias("occurrences"))


def latency_quantiles(samples: DataFrame, keep: int | None = None) -> DataFrame:
    """Count, p50 and p95 in milliseconds of all samples per key, or of the newest ``keep`` if a number is given.

    The quantile is the sorted sample at index floor((n - 1) * q): no interpolation. With ``keep`` a hot key is cut
    down in salted parts first.
    """
    keys = ["site_id", "key"]
    rows = samples if keep is None else newest_per_group(
        samples, keys, [F.desc("ts"), F.desc("sample_id")], keep, salt=F.col("sample_id"))
    return exact_quantiles(rows, keys, F.col("seconds") * 1000, {"p50_ms": 0.5, "p95_ms": 0.95})


def rolling_fps(stamps: DataFrame, window_seconds: float = 5.0) -> DataFrame:
    """Frames of the camera in the last window (strictly younger than it), per second, at every frame.

    The window reaches back into the bucket before, so every row is also sent to the next bucket and the
    ordered count runs per bucket.
    """
    width = micros(window_seconds)
    keys = ["site_id", "camera_id"]
    timed = stamps.select(*keys, "sequence", to_us(F.col("frame_timestamp")).alias("_us"))
    home = bucket(F.col("_us"), width)
    shared = timed.select("*", F.explode(F.array(home, home + 1)).alias("_bucket"))
    w = Window.partitionBy(*keys, "_bucket").orderBy("_us").rangeBetween(-(width - 1), 0)
    counted = shared.withColumn("frames_in_window", F.count(F.lit(1)).over(w)).where(F.col("_bucket") == home)
    return counted.select(*keys, "sequence", F.col("_us").alias("frame_us"), "frames_in_window",
                          (F.col("frames_in_window") / F.lit(window_seconds)).alias("fps"))


def fleet_status(camera_status: DataFrame, spool: DataFrame, models_ready: bool = True) -> DataFrame:
    """Counts of views per site, and READY when nothing failed and every enabled view delivers or is at rest."""
    enabled = F.col("enabled")
    playback = F.coalesce("playback_status", F.lit(""))
    usable = (F.col("status") == "ONLINE") | playback.isin("READY", "COMPLETED", "PAUSED")
    views = camera_status.groupBy("site_id").agg(
        F.count_if(enabled).alias("enabled_cameras"),
        F.count_if(enabled & (F.col("status") == "ONLINE")).alias("online_cameras"),
        F.count_if(enabled & (playback == "PLAYING")).alias("playing_cameras"),
        F.count_if(enabled & F.col("has_frame")).alias("cameras_with_video"),
        F.count_if(enabled & ~usable).alias("_unusable"))
    joined = views.join(spool.select("site_id", "pending", "failed"), "site_id", "left")
    ready = (F.lit(models_ready) & (F.coalesce("failed", F.lit(0)) == 0) & (F.col("enabled_cameras") > 0)
             & (F.col("_unusable") == 0))
    return joined.select(
        "site_id", "enabled_cameras", "online_cameras", "playing_cameras", "cameras_with_video",
        F.coalesce("pending", F.lit(0)).alias("pending_jobs"), F.coalesce("failed", F.lit(0)).alias("failed_jobs"),
        F.when(ready, "READY").otherwise("DEGRADED").alias("fleet_state"))


def event_summary(events: DataFrame) -> DataFrame:
    """Events per lane, direction and hour, the share in review, and the share that repeats a number of that hour."""
    return events.groupBy(
        "site_id", "gate_id", "event_type", F.date_trunc("hour", F.col("timestamp").cast("timestamp")).cast(
            "timestamp_ntz").alias("hour")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("status") == "NEEDS_REVIEW").alias("in_review"),
        F.countDistinct("container_number").alias("numbers"), F.count("container_number").alias("_numbered")).withColumns({
        "review_rate": F.col("in_review") / F.col("events"),
        "duplicate_rate": (F.col("_numbered") - F.col("numbers")) / F.col("events")}).drop("_numbered")


def event_latency(assignments: DataFrame) -> DataFrame:
    """Time from the first sight of a track to its event, split by whether the event is new."""
    samples = assignments.select(
        "site_id", F.when(F.col("created"), "events_created").otherwise("evidence_associated").alias("key"),
        F.col("frame_timestamp").alias("ts"), F.col("origin_key").alias("sample_id"),
        ((to_us(F.col("frame_timestamp")) - to_us(F.col("started_at"))) / 1_000_000).alias("seconds"))
    return latency_quantiles(samples)
