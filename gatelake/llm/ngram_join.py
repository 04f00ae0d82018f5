"""Similarity join of documents on word shingles by rare-first prefixes.

Two documents link when the Jaccard similarity of their sets of distinct k-word shingles reaches ``threshold``.
Equal sets form a class first. Each class representative posts the rarest part of its set, long enough that two linked
documents share a posted shingle; only posted shingles of at least two documents go on. Pairs pass the length,
positional and suffix filters and are then verified once on the whole sets.

Large groups of near copies would give a square of pairs. So for some turns each document is verified against the hubs of
its buckets only, if they are of another component: in the first turn against one, the hub with which it shares most
posted shingles, then against the hubs of several orders. A posted shingle whose documents are then all in one component
can add nothing and leaves. In the end every pair of different components that is left is verified, so the components
are exact whatever the turns have found: pair by pair between small components, and every document of a smaller one
against all members of a large one in one lookup.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelake.llm import words
from gatelake.llm.common import bounded_broadcast, drop_table, keep, small_batches
from gatelake.llm.components import components

#: Bins of the shingle frequency table that sets the rare-first order: 128 KB, whatever the corpus.
FREQUENCY_BINS = 1 << 15
#: Documents from which a component is compared as a whole, shingles of one cell of it, and visitors at a time.
CROWD, CELL_SHINGLES, VISITORS = 64, 1 << 19, 4096
#: Hash ranges of the suffix filter.
RANGES = 16

_PROFILE = "doc long, n_shingles long, d1 long, d2 long, ranges array<int>, sketch binary"


def _shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for row, hashes in words.row_words(column):
        h = np.sort(words.windows(hashes, k))
        yield row, h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _bins(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(20)).astype(np.int64) & (FREQUENCY_BINS - 1)


def _profiles(docs: DataFrame, k: int) -> DataFrame:
    """Size, digest and range counts of every row's set; one more row per partition holds its frequency table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(FREQUENCY_BINS, np.int64)
        for batch in batches:
            sizes, first, second, ranges = [], [], [], []
            for _, s in _shingle_sets(batch.column(1), k):
                sketch += np.bincount(_bins(s), minlength=FREQUENCY_BINS) if len(s) > 4096 else 0
                if 0 < len(s) <= 4096:
                    np.add.at(sketch, _bins(s), 1)
                d = _digest(s)
                sizes.append(len(s))
                first.append(d[0])
                second.append(d[1])
                ranges.append(np.bincount((s >> np.uint64(60)).astype(np.int64), minlength=RANGES).astype(np.int32))
            flat = np.concatenate(ranges) if ranges else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                 pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, RANGES, dtype=np.int32), pa.array(flat)),
                 pa.nulls(len(sizes), pa.binary())], names=["doc", "n_shingles", "d1", "d2", "ranges", "sketch"])
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.list_(pa.int32())), pa.array([sketch.tobytes()], pa.binary())],
            names=["doc", "n_shingles", "d1", "d2", "ranges", "sketch"])
    return small_batches(docs).mapInArrow(run, _PROFILE)


def _frequencies(sketches: DataFrame) -> np.ndarray:
    """The sum of the partitions' tables, added up in two levels; one table reaches the driver."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FREQUENCY_BINS, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.frombuffer(value.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sketch"])
    partial = sketches.repartition(32).mapInArrow(add, "sketch binary")
    row = partial.coalesce(1).mapInArrow(add, "sketch binary").first()
    return np.frombuffer(row.sketch, np.int64)


def _posted(docs: DataFrame, k: int, num: int, den: int, order) -> DataFrame:
    """(doc, d1, d2, n, posted): the rarest n - ceil(threshold * n) + 1 shingles of each set, rarest first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order.value
        for batch in batches:
            # Smaller pieces, as the posted shingles of a batch are as long as a third of its texts.
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes, first, second, posted = [], [], [], []
                for _, s in _shingle_sets(part.column(1), k):
                    n = len(s)
                    length = n - -(-num * n // den) + 1 if n else 0
                    rank = np.argsort(counts[_bins(s)], kind="stable")[:length]
                    d = _digest(s)
                    sizes.append(n)
                    first.append(d[0])
                    second.append(d[1])
                    posted.append(s[rank].view(np.int64))
                offsets = np.concatenate(([0], np.cumsum([len(p) for p in posted]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(sizes, pa.int32()),
                     pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(posted), pa.int64()))],
                    names=["doc", "d1", "d2", "n", "posted"])
    return docs.mapInArrow(run, "doc long, d1 long, d2 long, n int, posted array<long>")


def _sets_of(docs: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """(doc, shingles) of the wanted documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [s.view(np.int64) for _, s in _shingle_sets(part.column(1), k)]
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets), pa.int64()))],
                    names=["doc", "shingles"])
    return docs.join(wanted, "doc", "left_semi").mapInArrow(run, "doc long, shingles array<long>")


def _size(n: Column) -> Column:
    """Size of the set that a posting's ``n`` names: the lower half; the upper half tells texts of one id apart."""
    return n.bitwiseAND(F.lit((1 << 32) - 1))


def _may_link(met: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, shared) of the pairs that meet in posted shingles and pass the length and the positional filter.

    In the common order, what both sets share beyond the last posted shingle they share stands behind it in either set.
    And beyond the shorter of the two posted parts nothing is left but the rest of that set.
    """
    size_a, size_b = (_size(F.col(n)) for n in ("n_a", "n_b"))
    near = met.where(den * F.least(size_a, size_b) >= num * F.greatest(size_a, size_b))
    pairs = near.groupBy("a", "b", "n_a", "n_b").agg(
        F.count("*").alias("shared"), F.max("pos_a").alias("at_a"), F.max("pos_b").alias("at_b"))
    pairs = pairs.withColumns({"n_a": size_a, "n_b": size_b})
    behind = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) - 1
    unposted = F.ceil(num * F.greatest("n_a", "n_b") / den) - 1
    most = F.col("shared") + F.least(behind, unposted)
    return pairs.where((num + den) * most >= num * (F.col("n_a") + F.col("n_b"))).select("a", "b", "shared")


def _verified(pairs: DataFrame, docs: DataFrame, profiles: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. Pairs are distinct and stored."""
    sizes = profiles.select("doc", F.col("n_shingles").alias("n"), "ranges").distinct()
    named = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct()
    sizes, _ = keep(sizes.join(named, "doc", "left_semi"), "pair-sizes")
    left, right = (sizes.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("ranges").alias(f"r_{x}"))
                   for x in "ab")
    apart = F.aggregate(F.zip_with("r_a", "r_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda t, x: t + x)
    # At most (n_a + n_b - apart) / 2 shingles are common, as the counts of every hash range differ at least so much.
    total = F.col("n_a") + F.col("n_b")
    may = (den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b")) & (
        (num + den) * (total - apart) >= 2 * num * total)
    likely, _ = keep(pairs.join(left, "a").join(right, "b").where(may).select("a", "b").distinct(), "likely-pairs")
    wanted, _ = keep(likely.select(F.col("a").alias("doc")).union(likely.select(F.col("b").alias("doc"))).distinct(),
                     "pair-documents")
    sets, _ = keep(_sets_of(docs, k, bounded_broadcast(wanted)), "pair-sets")
    one, other = (sets.select(F.col("doc").alias(x), F.col("shingles").alias(f"s_{x}")) for x in "ab")
    common = F.size(F.array_intersect("s_a", "s_b"))
    union = F.size("s_a") + F.size("s_b") - common
    return likely.join(one, "a").join(other, "b").where(den * common >= num * union).select("a", "b").distinct()


def _crowd_cells(cells: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): one link of each visitor to a member of its cell, if there is one.

    A partition is sorted by cell, members first. The members of a cell, whose size is bounded, become one sorted list
    of shingles; a visitor's overlap with all of them is one lookup and one count, so no pair becomes a row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, sets, index = None, [], [], None
        for batch in batches:
            found: tuple[list[int], list[int]] = ([], [])
            keys = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
            shingles = batch.column(5)
            for row, (*key, visits, doc) in enumerate(keys):
                if key != cell:
                    cell, ids, sets, index = key, [], [], None
                own = np.asarray(shingles[row].values)
                if not visits:
                    ids.append(doc)
                    sets.append(own)
                    continue
                if not sets:
                    continue
                if index is None:
                    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                    order = np.argsort(flat, kind="stable")
                    index = flat[order], of[order], np.array([len(s) for s in sets])
                flat, of, sizes = index
                lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
                count = hi - lo
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(count)))[:-1], count) + np.arange(count.sum())
                common = np.bincount(of[at], minlength=len(sizes))
                hit = np.flatnonzero(den * common >= num * (sizes + len(own) - common))
                if len(hit):
                    found[0].append(doc)
                    found[1].append(ids[hit[0]])
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], names=["a", "b"])
    return cells.mapInArrow(run, "a long, b long")


def _linked_to_crowds(open_rows: DataFrame, crowds: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links between large components and the documents of smaller ones that share an open shingle with them.

    A component is dealt out in cells by its shingles, its visitors by their number; each visitor sees every member.
    """
    inside = open_rows.join(crowds, "c")
    doors = inside.select("token", F.col("c").alias("big"), F.col("size").alias("big_size")).distinct()
    outside = open_rows.join(crowds, "c", "left").select("token", "doc", "c", F.coalesce("size", F.lit(0)).alias("size"))
    smaller = (F.col("c") != F.col("big")) & (F.struct("size", "c") < F.struct("big_size", "big"))
    visits, _ = keep(outside.join(doors, "token").where(smaller).select("big", "doc").distinct(), "visits")
    plan = (visits.groupBy("big").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("turns"))
            .join(crowds.withColumnRenamed("c", "big"), "big")
            .select("big", "turns", F.ceil(F.col("shingles") / CELL_SHINGLES).cast("int").alias("blocks")))
    plan, _ = keep(plan, "crowd-cells")
    plan = bounded_broadcast(plan)
    hosts = inside.select(F.col("c").alias("big"), "doc").distinct().join(plan, "big").select(
        "big", F.pmod(F.xxhash64("doc"), "blocks").cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(0).alias("visits"), "doc")
    guests = visits.join(plan, "big").select(
        "big", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("doc"), "turns").cast("int").alias("turn"), F.lit(1).alias("visits"), "doc")
    seats, _ = keep(hosts.union(guests), "seats")
    sets, _ = keep(_sets_of(docs, k, bounded_broadcast(seats.select("doc").distinct())), "crowd-sets")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = seats.join(sets, "doc").select("big", "block", "turn", "visits", "doc", "shingles")
    return _crowd_cells(cells.repartition(n, "big", "block", "turn").sortWithinPartitions(
        "big", "block", "turn", "visits", "doc"), num, den)


def join_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                   threshold: tuple[int, int] = (3, 4), hub_orders: tuple[int, ...] = (1, 4)) -> DataFrame:
    """One row per row of ``docs``: the id, n_shingles (size of its set) and component_id (smallest id reachable).

    Words are runs without ASCII white space, A-Z in lower case. A text of fewer than ``k`` words is one shingle; a
    null text or one without words has an empty set and links with nothing, so its component is itself. Rows that share
    an id are one document: what any of them links to is linked. A null id links with nothing and its component is
    null. Other columns are ignored. An empty table gives an empty result.
    """
    num, den = threshold
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    stored, _ = keep(_profiles(docs, k), "profiles")
    profiles = stored.where("sketch is null")
    sketches = stored.where("sketch is not null").select("sketch")
    order = spark.sparkContext.broadcast(np.minimum(_frequencies(sketches), np.iinfo(np.uint32).max).astype(np.uint32))

    full = profiles.where("n_shingles > 0 and doc is not null")
    classes = full.groupBy("d1", "d2").agg(F.min("doc").alias("head"))
    members, _ = keep(full.select("doc", "d1", "d2").join(classes, ["d1", "d2"]).select("doc", "d1", "d2", "head").distinct(),
                      "classes")
    copies = members.where("doc <> head").select("doc", "d1", "d2")

    posted = _posted(docs.where("doc is not null"), k, num, den, order).join(
        bounded_broadcast(copies), ["doc", "d1", "d2"], "left_anti")
    named = F.shiftleft(F.col("d1").bitwiseAND(F.lit((1 << 31) - 1)), 32).bitwiseOR(F.col("n").cast("long")).alias("n")
    rows = posted.select("doc", named, F.posexplode("posted").alias("pos", "token"))
    # A token that two ids have keeps all its rows, also those of several texts of one id.
    token = Window.partitionBy("token")
    same = rows.select("token", "doc", "n", "pos", F.min("doc").over(token).alias("low"), F.max("doc").over(token).alias("high"))
    repeated, rows_path = keep(same.where("low <> high").select("token", "doc", "n", "pos"), "postings")

    open_rows, path = repeated.withColumn("c", F.col("doc")), rows_path
    links = tried = None
    for turn, orders in enumerate(hub_orders):
        # The smallest id first, which often is the original that the others were copied from.
        ranks = [F.col("doc") if turn == i == 0 else F.xxhash64("doc", F.lit(turn), F.lit(i)) for i in range(orders)]
        hubs = open_rows.groupBy("token").agg(F.array(*(
            F.min(F.struct(rank.alias("h"), "doc", "n", "pos", "c")) for rank in ranks)).alias("hubs"))
        hubs = hubs.select("token", F.explode(F.array_distinct(F.transform("hubs", lambda h: h.dropFields("h")))).alias("hub"))
        to_hub = open_rows.join(hubs, "token").where(F.col("c") != F.col("hub.c")).select(
            F.col("hub.doc").alias("a"), F.col("hub.n").alias("n_a"), F.col("hub.pos").alias("pos_a"),
            F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"))
        votes = _may_link(to_hub, num, den)
        if orders == 1:
            votes = votes.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
        asked = votes.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        asked, _ = keep(asked if tried is None else asked.join(tried, ["a", "b"], "left_anti"), "hub-pairs")
        new, _ = keep(_verified(asked, docs, profiles, k, num, den), "hub-links")
        tried, links = (asked, new) if tried is None else (tried.union(asked), links.union(new))
        known = components(links, "a", "b").withColumnRenamed("node", "doc")
        placed, placed_path = keep(open_rows.drop("c").join(known, "doc", "left").select(
            "token", "doc", "n", "pos", F.coalesce("component", "doc").alias("c")), "placed-postings")
        tokens = placed.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
        left, left_path = keep(placed.join(tokens.select("token"), "token", "left_semi"), "open-postings")
        drop_table(spark, path)
        drop_table(spark, placed_path)
        open_rows, path = left, left_path

    crowds, _ = keep(open_rows.select("doc", "n", "c").distinct().groupBy("c").agg(
        F.count("*").alias("size"), F.sum(_size(F.col("n"))).alias("shingles")).where(F.col("size") >= CROWD), "crowds")
    crowds = bounded_broadcast(crowds)
    scattered = open_rows.join(crowds.select("c"), "c", "left_anti")
    a, b = (scattered.select("token", *(F.col(x).alias(f"{x}_{side}") for x in ("doc", "n", "pos", "c"))) for side in "ab")
    met = a.join(b, "token").where("doc_a < doc_b and c_a <> c_b").withColumnsRenamed({"doc_a": "a", "doc_b": "b"})
    rest, _ = keep(_may_link(met, num, den).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    more = _verified(rest, docs, profiles, k, num, den).union(_linked_to_crowds(open_rows, crowds, docs, k, num, den))

    alike = members.where("doc <> head").select(F.col("head").alias("a"), F.col("doc").alias("b"))
    # Rows of one id with different texts are in several classes and tie these together.
    whole = components(links.union(more).union(alike), "a", "b")
    return (profiles.select(F.col("doc").alias("doc_id"), "n_shingles")
            .join(whole.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))
