"""The door of the streams: rows behind the watermark are set apart, the others carry the watermark they arrived under.

Spark drops a row that is behind the watermark without a trace. Here the first query of every stream writes each
micro-batch once, in two folders: rows on time, and late rows. Nothing is lost, so the two add up to the input. Rows on
time also carry ``arrival_watermark``, the watermark before their batch: no row that arrives later can be older than it.
A stateful query that follows takes it as its event time. Then Spark's own late filter never fires, however the second
query cuts its batches, and its timers tell exactly up to where the input is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelake.functions.clock import to_us

#: A time after all data: the watermark of the row that ends an input. The first watermark, after Spark's own of zero.
END, FIRST_US = "9999-12-31 00:00:00", 1_000_000
_ADDED = "arrival_watermark timestamp, batch_id bigint, late boolean"


def _with_added(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + T.StructType.fromDDL(_ADDED).fields)


def _newest_before(spark: SparkSession, path: str, batch_id: int) -> int | None:
    """The newest event time of all batches before, as written by the last of them."""
    if batch_id == 0:
        return None
    row = spark.read.schema("seen_us bigint").parquet(f"{path}/seen/batch_id={batch_id - 1}").first()
    return row.seen_us


def split_late(stream: DataFrame, ts: str, delay_us: int, path: str, files_per_batch: int = 1024) -> None:
    """Write everything that has arrived, on-time and late rows apart, and remember how far the input has come.

    The watermark of a batch is the newest event time before it less ``delay_us``. A batch that is repeated after a failure
    overwrites its own folders. Rows without an event time are late.
    """
    spark = stream.sparkSession

    def sort_out(batch: DataFrame, batch_id: int) -> None:
        before = _newest_before(spark, path, batch_id)
        us = to_us(F.col(ts))
        edge = F.lit(FIRST_US if before is None else max(FIRST_US, before - delay_us))
        late = us.isNull() | (F.lit(before is not None) & (us < edge))
        seen = Observation()
        batch.observe(seen, F.max(us).alias("us")).select(
            *batch.columns, F.timestamp_micros(edge).alias("arrival_watermark"), late.alias("late")).write.mode(
            "overwrite").partitionBy("late").parquet(f"{path}/rows/batch_id={batch_id}")
        newest = max((u for u in (before, seen.get["us"]) if u is not None), default=None)
        spark.range(1).select(F.lit(newest).cast("bigint").alias("seen_us")).coalesce(1).write.mode("overwrite").parquet(
            f"{path}/seen/batch_id={batch_id}")

    stream.writeStream.foreachBatch(sort_out).option("checkpointLocation", f"{path}/split-state").trigger(
        availableNow=True).start().awaitTermination()


def on_time(spark: SparkSession, path: str, schema: T.StructType, delay: str | None = "1 millisecond",
            files_per_batch: int | None = None, ts: str | None = None) -> DataFrame:
    """The rows on time as a stream; its watermark is that of the arrivals, less ``delay``, or none at all.

    With ``ts`` the rows also have ``event_time``, by which Spark's own windows can be formed: it is a second event time,
    and as no row on time is older than the watermark of the arrivals, that one stays the smaller and counts.
    """
    reader = spark.readStream.schema(_with_added(schema))
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(f"{path}/rows").where("not late")
    rows = rows if delay is None else rows.withWatermark("arrival_watermark", delay)
    newest = F.col("arrival_watermark")
    if ts is not None:
        rows = rows.withColumn("event_time", F.coalesce(F.col(ts).cast("timestamp"), newest)).withWatermark("event_time", "0 seconds")
        newest = F.greatest(newest, "event_time")
    # The last row of an input only moves the watermark; the comparison keeps this filter behind it.
    return rows.where(newest < F.lit(END).cast("timestamp")).drop("batch_id", "late")


def late_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows that came behind the watermark."""
    return spark.read.schema(_with_added(schema)).option("basePath", f"{path}/rows").parquet(f"{path}/rows").where(
        "late").select(*schema.names)


def end(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Tell the stateful queries that nothing follows, so that they give what they hold. To be called once."""
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    spark.range(1).select(*empty, F.lit(END).cast("timestamp").alias("arrival_watermark"), F.lit(False).alias("late")).coalesce(
        1).write.partitionBy("late").parquet(f"{path}/rows/batch_id={2**62}")
