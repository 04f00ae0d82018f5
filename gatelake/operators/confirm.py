"""Confirmation of numbers by repeated reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelake.functions.iso6346 import bound
from gatelake.operators.text import validate_reads
from gatelake.params import DEFAULTS, GateParams
from gatelake.session import materialize
from gatelake.sources.tables import parse_ocr_jobs

ORIGIN = ["site_id", "origin_key"]


def first_arrivals(reads: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the earliest arrival; a combinable minimum, so retries vanish before the shuffle."""
    rest = [c for c in reads.columns if c not in keys and c != "arrival"]
    first = reads.groupBy(*keys).agg(F.min(F.struct("arrival", *rest)).alias("_first"))
    return first.select(*[F.col(k) if k in keys else F.col(f"_first.{k}").alias(k) for k in reads.columns])


def first_attempts(reads: DataFrame, p: GateParams = DEFAULTS) -> DataFrame:
    """The reads that can decide an origin: its first ``ocr_max_attempts`` distinct sequences.

    Needs no validation, so it goes before it and spares the text work on every later read. Surplus sequences go before the
    shuffle, by a limit of the rank; retries after it, by a look at the rows beside. All of it takes the rows in the order of
    the limit, so they are dealt once and sorted once, by few columns.
    """
    order = Window.partitionBy(*ORIGIN).orderBy("sequence")
    few = reads.withColumn("_turn", F.dense_rank().over(order)).where(F.col("_turn") <= p.ocr_max_attempts).drop("_turn")
    # The rows of a sequence lie together; the first of them takes the values of their earliest arrival.
    values = F.struct("arrival", *[c for c in reads.columns if c not in (*ORIGIN, "sequence", "arrival")])
    other = (F.row_number().over(order) == 1) | ~F.lag("sequence").over(order).eqNullSafe(F.col("sequence"))
    kept = few.select(*ORIGIN, "sequence", F.min(values).over(order.rangeBetween(0, 0)).alias("_values"), other.alias("_first"))
    return kept.where("_first").select(*[
        F.col(c) if c in (*ORIGIN, "sequence") else F.col(f"_values.{c}").alias(c) for c in reads.columns])


def read_votes(validated: DataFrame, p: GateParams = DEFAULTS) -> DataFrame:
    """Votes of good reads per origin and number, their rank, and whether the rank is shared."""
    good = validated.where(F.col("valid_check_digit") & (F.col("confidence") >= p.ocr_min_confidence))
    votes = good.groupBy(*ORIGIN, "normalized_text").agg(F.count(F.lit(1)).alias("votes"))
    ranked = votes.withColumn("rank", F.rank().over(Window.partitionBy(*ORIGIN).orderBy(F.desc("votes"))))
    return ranked.withColumn("tied", F.count(F.lit(1)).over(Window.partitionBy(*ORIGIN, "votes")) > 1)


def _emission(reads: Column, p: GateParams) -> Column:
    """At which read an origin emits, and the number then confirmed; null while it is pending.

    A number comes to lead by a vote of its own, so the first read that confirms one bears it: a good read whose number has
    enough votes so far, more than any other.
    """
    def votes(texts: Column, k: Column, text: Column) -> Column:
        return F.size(F.filter(F.slice(texts, F.lit(1), k), lambda t: t == text))

    def leads(texts: Column, k: Column, text: Column) -> Column:
        """Only its own votes are of a number with so many."""
        def alone(own: Column) -> Column:
            as_many = F.filter(F.slice(texts, F.lit(1), k), lambda t: votes(texts, k, t) >= own)
            return (own >= p.ocr_confirmations) & (F.size(as_many) == own)

        return bound(votes(texts, k, text), alone)

    def emitting(texts: Column) -> Column:
        leading = F.filter(F.transform(texts, lambda text, i: F.when(text.isNotNull() & leads(texts, i + 1, text), F.struct(
            (i + 1).alias("k"), text.alias("number")))), lambda v: v.isNotNull())
        return F.get(leading, F.lit(0))

    first = bound(F.transform(reads, lambda r: F.when(r["good"], r["normalized_text"])), emitting)
    last = F.when(F.size(reads) >= p.ocr_max_attempts, F.struct(
        F.lit(p.ocr_max_attempts).alias("k"), F.lit(None).cast("string").alias("number")))
    return F.coalesce(first, last)


def _selected(reads: Column, emission: Column) -> Column:
    """The read an observation shows: the surest good read of the number, the earliest of equals, else the last."""
    used = F.slice(reads, F.lit(1), emission["k"])
    supporters = F.filter(used, lambda r: r["good"] & (r["normalized_text"] == emission["number"]))
    best = bound(supporters, lambda s: F.aggregate(
        s, F.get(s, F.lit(0)), lambda a, r: F.when(r["confidence"] > a["confidence"], r).otherwise(a)))
    return F.when(emission["number"].isNotNull(), best).otherwise(F.get(reads, emission["k"] - 1))


def confirm_reads(validated: DataFrame, p: GateParams = DEFAULTS, pending: bool = False,
                  decisive: bool = False) -> DataFrame:
    """One observation per origin, emitted at the read that confirms a number or at the last allowed read.

    Only the first ``ocr_max_attempts`` distinct sequences of an origin matter: the window limit is applied
    before the shuffle, and what is gathered per origin is that small. ``decisive=True`` tells that the
    input went through ``first_attempts`` already. ``pending=True`` returns the origins that have not
    emitted yet with their number of reads instead.
    """
    few = validated if decisive else first_attempts(validated, p)
    rest = [c for c in few.columns if c not in ORIGIN]
    # The few reads of an origin lie in order already: its first one looks ahead at the others, no aggregate sorts them again.
    order = Window.partitionBy(*ORIGIN).orderBy("sequence")
    read = F.struct("sequence", "good", *[c for c in rest if c != "sequence"])
    gathered = with_good(few, p).select(
        *ORIGIN, F.lag(F.lit(1)).over(order).isNull().alias("_first"),
        F.array(read, *[F.lead(read, i).over(order) for i in range(1, p.ocr_max_attempts)]).alias("_reads")).where("_first").select(
        *ORIGIN, F.filter("_reads", lambda r: r.isNotNull()).alias("reads"))
    if pending:
        return gathered.where(_emission(F.col("reads"), p).isNull()).select(*ORIGIN, F.size("reads").alias("reads"))
    return emitted(gathered, rest, p)


def with_good(validated: DataFrame, p: GateParams = DEFAULTS) -> DataFrame:
    """Reads with ``good``: those that may vote."""
    return validated.withColumn("good", F.col("valid_check_digit") & (F.col("confidence") >= p.ocr_min_confidence))


def attempt(columns: list[str]) -> Column:
    """A read as an element whose order is that of attempts: by sequence, and of one sequence the earliest arrival first."""
    return F.struct("sequence", "arrival", *[c for c in columns if c not in ("sequence", "arrival")])


def first_sequences(reads: Column, n: int) -> Column:
    """The first ``n`` distinct sequences among attempts, of each the earliest arrival."""
    return bound(F.sort_array(reads), lambda s: F.slice(F.filter(s, lambda r, i: (i == 0) | ~F.get(s, i - 1)["sequence"].eqNullSafe(
        r["sequence"])), 1, n))


def emitted(gathered: DataFrame, rest: list[str], p: GateParams = DEFAULTS) -> DataFrame:
    """Observations of the origins whose ordered ``reads`` decide them; ``rest`` names the columns of a read."""
    # Pending origins give no element, so the emission is computed once and explode drops them.
    decided = gathered.select(*ORIGIN, "reads", F.explode(F.filter(
        F.array(_emission(F.col("reads"), p)), lambda e: e.isNotNull())).alias("emission"))
    chosen = decided.select(
        *ORIGIN, "emission", F.get("reads", F.col("emission.k") - 1).alias("current"),
        _selected(F.col("reads"), F.col("emission")).alias("selected"))
    text = ["raw_text", "corrected_text", "normalized_text", "confidence", "valid_format", "valid_check_digit",
            "validation_status", "check_digit_derived"]
    return chosen.select(
        *ORIGIN,
        *[F.col(f"current.{c}").alias(c) for c in rest if c not in (*text, "arrival")],
        *[F.col(f"selected.{c}").alias(c) for c in text],
        F.col("emission.number").isNotNull().alias("confirmed"),
        F.col("emission.number").alias("container_number"),
        F.col("emission.k").alias("attempts"))


def replay_spool(jobs: DataFrame, texts: DataFrame, p: GateParams = DEFAULTS) -> DataFrame:
    """Confirmation continued after a restart: the observations of an uninterrupted run, with ``known_event_id``.

    Finished jobs of the spool bring their stored validation; jobs that were pending, and those whose stored validation is
    damaged, are validated from ``texts`` (site_id, origin, sequence, raw_text, confidence), what the reader now says of
    their crops. Jobs without readable metadata can't be placed and are left out. ``known_event_id`` is the event that a
    finished job of the origin was already given, so its observation must not start another.
    """
    # Written once: three branches read it, and each would build and parse the documents again.
    written = materialize(parse_ocr_jobs(jobs).select(
        "site_id", "id", "origin", "sequence", "state", "event_id", "gate_id", "track_id", "direction", "started_at", "camera_id",
        "frame_timestamp", "read_text", "read_confidence", "normalized_text", "validation_status", "valid_check_digit"), "parsed-jobs")
    parsed = written.where("frame_timestamp is not null")
    place = ["site_id", F.col("origin").alias("origin_key"), "sequence", F.col("id").alias("arrival"), "camera_id", "gate_id",
             "direction", "track_id", "frame_timestamp", "started_at"]
    saved = (F.col("state") == "DONE") & F.col("validation_status").isNotNull()
    stored = parsed.where(saved).select(
        *place, F.col("read_text").alias("raw_text"), F.col("read_confidence").alias("confidence"),
        F.col("read_text").alias("corrected_text"), "normalized_text", F.lit(None).cast("boolean").alias("valid_format"),
        "valid_check_digit", "validation_status", F.lit(None).cast("boolean").alias("check_digit_derived"))
    again = validate_reads(parsed.where(~F.coalesce(saved, F.lit(False))).join(
        texts, ["site_id", "origin", "sequence"]).select(*place, "raw_text", "confidence"))
    known = written.where("state = 'DONE' and event_id is not null").groupBy("site_id", F.col("origin").alias("origin_key")).agg(
        F.min_by("event_id", "id").alias("known_event_id"))
    return confirm_reads(stored.unionByName(again.select(*stored.columns)), p).join(known, ORIGIN, "left")
