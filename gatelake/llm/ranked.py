"""Consecutive positions inside groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelake.llm.common import keep
from gatelake.operators.ordered import join_null_safe


def laid_out(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """The rows stored in the order of ``by``, with ``part`` (range partition) and ``at`` (place in it).

    ``rows`` should be stored, as the ranges are sampled first. Both columns are written with the rows, so they stay
    what they are whatever is computed again later.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *by).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id()  # partition number in the upper bits, row number in the lower 33
    stored, _ = keep(dealt.withColumn("_place", place).select(
        *rows.columns, F.shiftright("_place", 33).cast("int").alias("part"),
        F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), name)
    return stored


def spans(stored: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """(keys, part, start, n): what to add to ``at`` for the position in the group, and the size of the group.

    One row for each group and range partition; only these are put in order, at most one per partition and group.
    """
    blocks = stored.groupBy(*keys, "part").agg(F.min("at").alias("_low"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*keys)
    before = F.sum("_rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return blocks.select(*keys, "part", (F.coalesce(before, F.lit(0)) - F.col("_low")).alias("start"),
                         F.sum("_rows").over(whole).alias(n))


def positions(stored: DataFrame, keys: Sequence[str], n: str = "n", pos: str = "pos") -> DataFrame:
    """The rows of ``laid_out`` with their position in the group, from 0, and the size of the group."""
    found = join_null_safe(stored, spans(stored, keys, n), [*keys, "part"])
    return found.withColumn(pos, F.col("at") + F.col("start")).drop("part", "at", "start")
