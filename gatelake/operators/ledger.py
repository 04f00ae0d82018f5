"""Spool jobs and the delivery outbox as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelake.functions.clock import iso_z_millis
from gatelake.operators.associate import stable_id
from gatelake.operators.ordered import exact_quantiles, join_null_safe, newest_per_group
from gatelake.schemas import JOB_VALIDATION

# Seconds before a failed read is tried again; delivery back-off and its limits.
OCR_RETRY_SECONDS = 5
BACKOFF_BASE, BACKOFF_MAX_SECONDS, MAX_RETRIES = 2.0, 30.0, 5
SPOOL_MAX_BYTES = 10240 * 1024 * 1024


def job_ledger(transitions: DataFrame) -> DataFrame:
    """Current state of every job from its log; one combinable aggregate."""
    kind = F.col("kind")
    grouped = transitions.groupBy("site_id", "job_id").agg(
        F.count_if(kind == "retried").cast("int").alias("attempts"),
        F.max(F.when(kind == "retried", F.struct("ts", "error_type"))).alias("_retry"),
        F.max(F.when(kind == "completed", F.struct("ts", "event_id"))).alias("_done"),
        F.bool_or(kind == "validated").alias("validated"))
    retried_later = F.col("_done").isNull() | (F.col("_retry.ts") > F.col("_done.ts"))
    return grouped.select(
        "site_id", "job_id", F.when(F.col("_done").isNotNull(), "DONE").otherwise("PENDING").alias("state"),
        "attempts", "validated",
        F.expr(f"_retry.ts + interval {OCR_RETRY_SECONDS} seconds").alias("retry_at"),
        F.when(retried_later, F.col("_retry.error_type")).alias("error_type"),
        F.col("_done.event_id").alias("event_id"))


def recover_evidence(jobs: DataFrame, n: int = 4) -> DataFrame:
    """Votes of an origin rebuilt from its last ``n`` finished jobs, in order."""
    done = jobs.where("state = 'DONE'").select("site_id", "origin", "id", "sequence", "validation", "event_id")
    last = newest_per_group(done, ["site_id", "origin"], [F.desc("id")], n)
    return last.groupBy("site_id", "origin").agg(
        F.sort_array(F.collect_list(F.struct(
            "id", F.from_json("validation", JOB_VALIDATION, {"mode": "PERMISSIVE"}).alias("read")))).alias("_reads"),
        F.min(F.when(F.col("event_id").isNotNull(), F.struct("id", "event_id"))).alias("_event"),
        F.max(F.struct("id", "sequence")).alias("_last"),
    ).select(
        "site_id", "origin",
        F.transform(F.filter("_reads", lambda r: r["read"].isNotNull() & r["read"]["normalized_text"].isNotNull()),
                    lambda r: r["read"]["normalized_text"]).alias("read_texts"),
        F.col("_event.event_id").alias("event_id"), F.col("_last.sequence").alias("last_sequence"))


def spool_status(jobs: DataFrame, max_bytes: int = SPOOL_MAX_BYTES, width: int = 1_000_000) -> DataFrame:
    """Totals per site and the first job, in id order, that would overflow the spool.

    Running sums are taken over id ranges first; only the one range in which the capacity is reached is
    summed row by row.
    """
    part = F.floor(F.col("id") / width).cast("bigint")
    ranges = jobs.groupBy("site_id", part.alias("_range")).agg(
        F.count(F.lit(1)).alias("_total"), F.count_if(F.col("state") == "PENDING").alias("_pending"),
        F.count(F.col("error_type")).alias("_failed"), F.sum("payload_bytes").alias("_bytes"))
    running = Window.partitionBy("site_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranges.withColumn("_before", F.coalesce(F.sum("_bytes").over(running), F.lit(0)))
    totals = summed.groupBy("site_id").agg(
        F.sum("_total").alias("total"), F.sum("_pending").alias("pending"), F.sum("_failed").alias("failed"),
        F.sum("_bytes").alias("payload_bytes"))
    # Payloads are not negative, so the capacity is crossed in exactly one range.
    crossing = summed.where(
        (F.col("_before") <= max_bytes) & (F.col("_before") + F.col("_bytes") > max_bytes)).select(
        "site_id", "_range", "_before")
    inside = Window.partitionBy("site_id", "_range").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    over = jobs.select("site_id", "id", "payload_bytes", part.alias("_range")).join(
        crossing, ["site_id", "_range"]).withColumn("_used", F.col("_before") + F.sum("payload_bytes").over(inside)
                                                    ).where(F.col("_used") > max_bytes)
    first = over.groupBy("site_id").agg(F.min("id").alias("first_rejected_id"))
    return totals.join(first, "site_id", "left")


def outbox_payloads(assignments: DataFrame, device_id: str = "device-0", kept: Sequence[str] = ()) -> DataFrame:
    """Delivery document of every confirmed observation, and its ``kept`` columns. An unknown direction is delivered as ENTRY."""
    number = F.nullif(F.col("normalized_text"), F.lit(""))
    event_type = F.when(F.col("direction").isin("ENTRY", "EXIT"), F.col("direction")).otherwise("ENTRY")
    owner = F.upper(F.substring("normalized_text", 1, 4))
    return assignments.where("confirmed").select(
        "site_id", stable_id("delivery", F.col("origin_key")).alias("delivery_id"), "event_id",
        F.to_json(F.struct(
            F.col("event_id").alias("id"), F.col("gate_id").alias("gateId"),
            iso_z_millis(F.col("frame_timestamp")).alias("timestamp"), number.alias("containerNumber"),
            number.alias("trailerNumber"), event_type.alias("eventType"), F.lit(device_id).alias("deviceId"),
            F.col("detection_confidence").alias("confidence")), {"ignoreNullFields": "false"}).alias("payload"),
        F.when(owner.rlike(r"^[A-Z]{4}\z"), owner).otherwise("UNKN").alias("scac"),
        F.col("direction").alias("direction_raw"), *kept)


def outbox_schedule(attempts: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """State of each delivery and the time of its next attempt."""
    failures = F.col("failures")
    state = F.when(F.col("delivered"), "SYNCED").when(failures >= max_retries, "EXHAUSTED").when(
        failures > 0, "RETRY").otherwise("QUEUED")
    wait = F.least(F.pow(F.lit(BACKOFF_BASE), failures), F.lit(BACKOFF_MAX_SECONDS)).cast("int")
    staged = attempts.withColumn("delivery_state", state).withColumn(
        "wait_seconds", F.when(F.col("delivery_state") == "RETRY", wait))
    return staged.select(
        "site_id", "delivery_id", "failures", "delivery_state", "wait_seconds",
        F.expr("last_attempt_at + make_dt_interval(0, 0, 0, wait_seconds)").alias("next_attempt_at"),
        F.when(F.col("delivered"), F.unix_micros(F.col("last_attempt_at").cast("timestamp"))
               - F.unix_micros(F.col("enqueued_at").cast("timestamp"))).alias("latency_us"))


def outbox_counts(schedule: DataFrame) -> DataFrame:
    """Deliveries per state, and mean, p50 and p95 of the latency of the delivered ones."""
    keys = ["site_id", "delivery_state"]
    counts = schedule.groupBy(*keys).agg(F.count(F.lit(1)).alias("deliveries"), F.sum("latency_us").alias("_sum"),
                                         F.count("latency_us").alias("_timed"))
    ranks = exact_quantiles(schedule, keys, F.col("latency_us"), {"p50_us": 0.5, "p95_us": 0.95})
    return join_null_safe(counts, ranks, keys, "left").select(
        *keys, "deliveries", (F.col("_sum") / F.col("_timed")).alias("mean_us"), "p50_us", "p95_us")
