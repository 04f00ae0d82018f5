"""Ordered processing that does not put a hot key into one task.

Spark's own ordered windows sort all rows of a key in one task. The helpers here first reduce the rows to one
summary per key and time bucket with a combinable aggregate; only the summaries, whose number is bounded by
the covered time divided by the bucket width, are ordered per key. Rows find their summary again by an
equi-join on key and bucket, which spreads a hot key over its buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelake.operators import kernels
from gatelake.session import materialize


def bucket(ts_us: Column, width_us: int) -> Column:
    return F.floor(ts_us / F.lit(width_us)).cast("bigint")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key meets a null key, so rows with an unknown key are kept."""
    other = right.select(*[F.col(k).alias(f"_other_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys))
    return left.join(other, same, how).drop(*[f"_other_{k}" for k in keys])


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: Column, quantiles: dict[str, float]) -> DataFrame:
    """(keys, samples, one column per quantile): the sorted value at index floor((n - 1) * q), over all rows.

    Equal values are counted first, counts are added up per range of values (64 ranges to an octave, so their number
    is bounded), and only the ranges that hold a wanted rank are gone through in order. Null values do not count.
    """
    v, size = F.col("_v"), F.floor(F.log2(1 + F.abs(F.col("_v"))) * 64)
    span = F.when(F.isnan(v), F.lit(2**62)).when(v < 0, -size).otherwise(size).cast("bigint")
    counted = rows.select(*keys, value.cast("double").alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(
        F.count(F.lit(1)).alias("_n")).withColumn("_span", span)
    whole = Window.partitionBy(*keys)
    before = F.sum("_c").over(whole.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    spans = counted.groupBy(*keys, "_span").agg(F.sum("_n").alias("_c")).select(
        *keys, "_span", "_c", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_c").over(whole).alias("samples"))
    wanted = spans.select("*", F.explode(F.array(*[F.struct(
        F.lit(name).alias("name"), F.floor((F.col("samples") - 1) * F.lit(q)).alias("at")) for name, q in quantiles.items()
    ])).alias("_q")).where("_q.at >= _before and _q.at < _before + _c")
    inside = Window.partitionBy(*keys, "_span", "_q").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    reached = join_null_safe(counted, wanted, [*keys, "_span"]).withColumn(
        "_upto", F.col("_before") + F.sum("_n").over(inside))
    hit = reached.where("_q.at < _upto and _q.at >= _upto - _n")
    return hit.groupBy(*keys).agg(F.max("samples").alias("samples"), *[
        F.max(F.when(F.col("_q.name") == name, F.col("_v"))).alias(name) for name in quantiles])


def with_segments(df: DataFrame, keys: Sequence[str], ts: str, gap_us: int) -> DataFrame:
    """Append ``segment_us``, the start of the row's segment.

    A segment is a run of rows of a key whose neighbours are at most ``gap_us`` apart in the microsecond
    column ``ts``. Rows of one bucket of that width are closer than the gap, so segments can only end
    between buckets.
    """
    rows = df.withColumn("_bucket", bucket(F.col(ts), max(gap_us, 1)))
    spans = rows.groupBy(*keys, "_bucket").agg(
        F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    running = Window.partitionBy(*keys).orderBy("_bucket")
    opens = F.coalesce(F.col("_lo") - F.lag("_hi").over(running) > gap_us, F.lit(True))
    segments = spans.withColumn("_opens", F.when(opens, F.col("_lo"))).select(
        *keys, "_bucket",
        F.last("_opens", ignorenulls=True).over(running.rowsBetween(Window.unboundedPreceding, 0)).alias("segment_us"))
    return join_null_safe(rows, segments, [*keys, "_bucket"]).drop("_bucket")


def fold_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], fold: Callable, added: str) -> DataFrame:
    """Run a streaming fold over the rows of each group in order; ``added`` is the DDL of its columns."""
    schema = T.StructType(df.schema.fields + T.StructType.fromDDL(added).fields)
    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(fold, schema)


def fold_blocks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], width_us: int, used: Sequence[str],
                fold: Callable, exits: Callable, added: str) -> DataFrame:
    """Run an ordered fold over the segments of ``rows``, the long ones in blocks of ``width_us`` that fold side by side.

    ``fold(by)`` gives the kernel that appends the columns ``added``, ``exits(by)`` the one that gives the open state at
    the end of every block; both begin a block with the state in ``start``. Blocks of a long segment are first folded from
    nothing. Then those whose predecessor hands over something else than they were folded from are folded again from that,
    until none is left; every round settles one more block of a segment at least, and all blocks behind a moment at which
    the open state no longer depends on what was before. Only the columns ``used`` take part in that.
    """
    by = [*keys, "segment_us", "_block"]
    ts = F.col(order[0])
    cut = materialize(rows.withColumn("_block", F.floor((ts - F.col("segment_us")) / width_us)), "blocks")
    nothing = F.lit(None).cast("string").alias("start")
    # Blocks are counted from the start of the segment, so there is a second one only where a segment is long.
    long = cut.where("_block > 0").select(*keys, "segment_us").distinct()
    if long.isEmpty():
        return fold_rows(cut.select("*", nothing), by, order, fold(by), added).drop("_block", "start")
    narrow = materialize(join_null_safe(cut.select(*by, *used), long, [*keys, "segment_us"]), "long-segments")
    schema = T.StructType([*narrow.select(*by).schema.fields, *T.StructType.fromDDL("start string, exit string").fields])

    def left(blocks: DataFrame) -> DataFrame:
        return blocks.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(exits(by), schema)

    states = materialize(left(narrow.select("*", nothing)), "block-states")
    while True:
        before = Window.partitionBy(*keys, "segment_us").orderBy("_block")
        handed = F.when(F.lag("_block").over(before) == F.col("_block") - 1, F.lag("exit").over(before))
        met = states.withColumn("_handed", handed)
        open_blocks = materialize(met.where(~F.col("start").eqNullSafe(F.col("_handed"))).select(
            *by, F.col("_handed").alias("start")), "open-blocks")
        if open_blocks.isEmpty():
            break
        settled = join_null_safe(states, open_blocks.select(*by, F.lit(1).alias("_open")), by, "left").where("_open is null")
        states = materialize(settled.select(*states.columns).unionByName(left(join_null_safe(narrow, open_blocks, by))), "block-states")
    entered = join_null_safe(cut, states.select(*by, "start"), by, "left")
    return fold_rows(entered, by, order, fold(by), added).drop("_block", "start")


def mark_chain(df: DataFrame, keys: Sequence[str], order: Sequence[str], step_us: int | Column, block_steps: int = 1024) -> DataFrame:
    """Append ``taken`` and ``anchor_us``: greedy choice of rows at least ``step_us`` apart per key.

    The step may be a column that is the same for all rows of a key. Time is cut into blocks of ``block_steps`` steps. A
    block is first reduced to a map from the row at which a chain may enter it to the last row it takes there; the maps of
    a key, one row a block, are gone through in order; then every block is marked from where the chain enters it. So no
    task holds or walks more than a block, pause or not.
    """
    step = step_us if isinstance(step_us, Column) else F.lit(step_us)
    rows = df.withColumn("_step", step.cast("bigint")).withColumn(
        "_block", F.floor(F.col(order[0]) / (F.col("_step") * block_steps)).cast("bigint"))
    by = [*keys, "_step", "_block"]
    times = rows.select(*by, order[0]).distinct()
    spans = T.StructType([*times.select(*by).schema.fields, *T.StructType.fromDDL("entries array<bigint>, exits array<bigint>").fields])
    maps = times.repartition(*by).sortWithinPartitions(*by, order[0]).mapInArrow(kernels.chain_map(by, order[0], block_steps), spans)
    entered = fold_rows(maps, by[:-1], ["_block"], kernels.chain_starts(by[:-1]), "start_us bigint").select(*by, "start_us")
    folded = fold_rows(join_null_safe(rows, entered, by), by, order, kernels.chain_fold(by, order[0]),
                       "taken boolean, anchor_us bigint")
    return folded.select(*df.columns, "taken", "anchor_us")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], width_us: int, name: str) -> DataFrame:
    """Append the 1-based position of each row within its key, counted bucket by bucket."""
    rows = df.withColumn("_bucket", bucket(F.col(order[0]), width_us))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return join_null_safe(rows, offsets, [*keys, "_bucket"]).withColumn(
        name, F.col("_before") + F.row_number().over(inside)).drop("_bucket", "_before")


def newest_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salt: Column | None = None,
                     salts: int = 64) -> DataFrame:
    """The first ``n`` rows of each key in the given order.

    With a salt a hot key is first cut down inside each of its salted parts; a row among the first ``n`` of
    the key is always among the first ``n`` of its part, so the result is the same.
    """
    rank = "_rank"
    rows = df
    if salt is not None:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
        parts = Window.partitionBy(*keys, "_salt").orderBy(*order)
        rows = rows.withColumn(rank, F.row_number().over(parts)).where(F.col(rank) <= n).drop(rank, "_salt")
    whole = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= n).drop(rank)
