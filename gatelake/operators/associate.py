"""Association of observations with gate events inside an anchored time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelake.functions.clock import from_us, to_us
from gatelake.operators import kernels
from gatelake.operators.ordered import bucket, fold_blocks, mark_chain, with_segments
from gatelake.params import DEFAULTS, GateParams

LANE = ["site_id", "gate_id", "direction"]


def stable_id(kind: str, *parts: Column) -> Column:
    """Deterministic identifier, so that a replay writes the same rows again."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(kind), *parts), 256), 1, 32)


def associate_events(observations: DataFrame, p: GateParams = DEFAULTS, block_windows: int = 64) -> DataFrame:
    """Append event_id, created, promoted and event_timestamp to every observation.

    Observations of a lane and direction are taken in (time, origin) order. A confirmed one joins the latest
    event with its number, else promotes the latest event without a number, else starts an event; an
    unconfirmed one joins the latest event of any kind. The window is anchored on the event's first
    observation, so a pause longer than the window separates the fold into independent segments. A segment longer
    than ``block_windows`` windows is folded in blocks.
    """
    timed = observations.withColumn("_us", to_us(F.col("frame_timestamp"))).withColumn(
        "observation_id", stable_id("event", F.col("origin_key")))
    width = block_windows * p.dedup_us
    folded = fold_blocks(
        with_segments(timed, LANE, "_us", p.dedup_us), LANE, ["_us", "origin_key"], width,
        ["_us", "origin_key", "container_number", "observation_id"],
        lambda by: kernels.association_fold(by, p.dedup_us), lambda by: kernels.association_exits(by, p.dedup_us, width),
        "event_id string, created boolean, promoted boolean, event_us bigint")
    return folded.select(*observations.columns, "event_id", "created", "promoted",
                         from_us(F.col("event_us")).alias("event_timestamp"))


def gate_events(assignments: DataFrame) -> DataFrame:
    """Current event rows: one combinable aggregate over the assignments."""
    names = F.col("created") | F.col("promoted")
    grouped = assignments.groupBy("site_id", "event_id").agg(
        F.any_value("gate_id").alias("gate_id"), F.any_value("direction").alias("event_type"),
        F.min("event_timestamp").alias("timestamp"),
        F.max(F.when(names, F.col("container_number"))).alias("container_number"))
    return grouped.select(
        "site_id", F.col("event_id").alias("id"), "gate_id", "timestamp", "container_number", "event_type",
        F.when(F.col("container_number").isNotNull(), "CONFIRMED").otherwise("NEEDS_REVIEW").alias("status"))


def dedup_visits(confirmed: DataFrame, p: GateParams = DEFAULTS) -> DataFrame:
    """Visits of a number: a confirmed observation later than the window after the visit's first starts a new one."""
    keys = [*LANE, "container_number"]
    timed = confirmed.where("confirmed").withColumn("_us", to_us(F.col("frame_timestamp")))
    marked = mark_chain(timed, keys, ["_us", "origin_key"], p.dedup_us + 1)
    return marked.groupBy(*keys, "anchor_us").agg(
        F.max("_us").alias("_last"), F.count(F.lit(1)).alias("observations")).select(
        *keys, from_us(F.col("anchor_us")).alias("first_seen"), from_us(F.col("_last")).alias("last_seen"),
        "observations")


def candidate_events(observations: DataFrame, events: DataFrame, p: GateParams = DEFAULTS) -> DataFrame:
    """All events of the lane and direction within the window around an observation, newest first.

    Equi-join on time buckets as wide as the window: an event is sent to its own bucket and both neighbours,
    so every pair meets exactly once.
    """
    left = observations.select(*LANE, "origin_key", to_us(F.col("frame_timestamp")).alias("observation_us")).withColumn(
        "_bucket", bucket(F.col("observation_us"), p.dedup_us))
    right = events.select(
        "site_id", "gate_id", F.col("event_type").alias("direction"), F.col("id").alias("event_id"),
        "container_number", to_us(F.col("timestamp")).alias("event_us"))
    right = right.withColumn("_bucket", F.explode(F.transform(
        F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: bucket(F.col("event_us"), p.dedup_us) + i)))
    near = left.join(right, [*LANE, "_bucket"]).where(
        F.abs(F.col("event_us") - F.col("observation_us")) <= p.dedup_us)
    w = Window.partitionBy("site_id", "origin_key").orderBy(F.desc("event_us"), "event_id")
    return near.withColumn("nearness", F.row_number().over(w)).select(
        *LANE, "origin_key", "observation_us", "event_id", "container_number", "event_us", "nearness")


def idempotent_append(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet, the first of each key."""
    rest = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(
        F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_first"))
    fresh = first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in incoming.columns])
    return fresh.join(existing.select(*keys), keys, "left_anti")
