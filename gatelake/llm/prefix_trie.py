"""Trie of the turn prefixes of conversations, screened by a count-min sketch.

Every prefix has a digest. A count-min sketch of all prefix digests never counts too few, so a count of one proves that a
prefix belongs to a single conversation: such tails need no grouping and leave with what their own row knows. Only
prefixes that may be shared are shuffled and grouped exactly. The sketch grows with the number of prefixes up to
``max_cells`` a row; with more prefixes it screens less, and the grouping takes what is left.

Sums over subtrees need no walk. A conversation owns the nodes of which it is the smallest member: they are its prefixes
from some depth r on. So of every node above r the other bytes of the conversation are saved, and the leaf it owns counts
for each of its prefixes: one grouping of the members gives both sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelake.llm import ranked
from gatelake.llm.common import crc32_sql, keep

#: Turns of a conversation in one block of running sums, ids in one pack of a node's end list, slices of a sketch row.
BLOCK_TURNS, PACK_IDS, SLICES = 1024, 8192, 32

NODE = ["depth", "k1", "k2"]
_LOW = (1 << 32) - 1


def turn_digest(role: Column, text: Column) -> Column:
    """Digest of a turn; a null role or text is empty."""
    role = F.coalesce(role.cast("string"), F.lit(""))
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, F.coalesce(text.cast("string"), F.lit(""))), 256)


def ordered_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(conv, i, own, token, bytes): the turns of each conversation by turn (null first), then by digest; ``own`` of them."""
    slim, _ = keep(turns.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
        turn_digest(F.col(f"`{role_col}`"), F.col(f"`{text_col}`")).alias("token"),
        F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("row")), "turns")
    stored = ranked.laid_out(slim, ["conv", "turn", "token", "row"], "ordered-turns")
    placed, _ = keep(ranked.positions(stored, ["conv"], "own", "i").select("conv", "i", "own", "token", "bytes"), "placed-turns")
    return placed


def spliced(ordered: DataFrame, family: int = 5, modulus: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their family: (conv, depth, length, token, bytes) and (conv, length).

    Conversation c takes the first h turns of c - c % family, h being the CRC-32 of the decimal c modulo ``modulus``, and
    goes on with its own turns behind its first h.
    """
    sizes, _ = keep(ordered.groupBy("conv").agg(F.any_value("own").alias("own")), "conversations")
    base = F.col("conv") - F.col("conv") % family
    heads = ordered.where(f"conv % {family} = 0 and i < {modulus - 1}").groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("i", "token", "bytes"))).alias("head"))
    plan = (sizes.select("conv", "own", base.alias("base"),
                         (F.crc32(F.col("conv").cast("string").cast("binary")) % modulus).cast("int").alias("h"))
            .join(heads.select(F.col("conv").alias("base"), "head"), "base", "left"))
    plan = plan.select("conv", "h", F.slice(F.coalesce("head", F.array().cast("array<struct<i:bigint,token:string,bytes:bigint>>")),
                                            F.lit(1), F.col("h")).alias("head"), "own")
    plan, _ = keep(plan.withColumn("length", F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "splices")
    first = plan.select("conv", "length", F.explode("head").alias("t")).select(
        "conv", (F.col("t.i") + 1).alias("depth"), "length", "t.token", "t.bytes")
    rest = ordered.drop("own").join(plan.select("conv", "length", "h", F.size("head").alias("taken")), "conv").where(
        "i >= h").select("conv", (F.col("taken") + F.col("i") - F.col("h") + 1).alias("depth"), "length", "token", "bytes")
    return first.unionByName(rest), plan.select("conv", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, length, k1, k2, p1, p2, bytes, upto): digest of every prefix and of the one before, bytes up to it.

    A digest is the sum of 128-bit hashes of (turn, depth) in four lanes, so it can be added up block by block and a
    conversation of any length is spread over tasks.
    """
    hashes = [F.xxhash64("token", "depth"), F.xxhash64(F.lit(17), "depth", F.reverse("token"))]
    lanes = [lane for h in hashes for lane in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(_LOW)))]
    rows = turns.select("*", F.floor((F.col("depth") - 1) / BLOCK_TURNS).alias("block"),
                        *(lane.alias(f"x{i}") for i, lane in enumerate(lanes)))
    inside = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running, _ = keep(rows.select("conv", "depth", "length", "block", "bytes", *(f"x{i}" for i in range(4)), *(
        F.sum(c).over(inside).alias(f"s_{c}") for c in ("x0", "x1", "x2", "x3", "bytes"))), "running")
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Only conversations of several blocks have anything to add.
    totals = running.where(f"length > {BLOCK_TURNS}").groupBy("conv", "block").agg(
        *(F.max(f"s_{c}").alias(c) for c in ("x0", "x1", "x2", "x3", "bytes")))
    before = totals.select("conv", "block", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"b_{c}")
                                              for c in ("x0", "x1", "x2", "x3", "bytes")))
    whole = running.join(before, ["conv", "block"], "left")
    sums = [F.col(f"s_x{i}") + F.coalesce(F.col(f"b_x{i}"), F.lit(0)) for i in range(4)]
    less = [s - F.col(f"x{i}") for i, s in enumerate(sums)]

    def key(high: Column, low: Column) -> Column:
        return F.shiftleft(high.bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))
    return whole.select("conv", "depth", "length", key(*sums[:2]).alias("k1"), key(*sums[2:]).alias("k2"),
                        key(*less[:2]).alias("p1"), key(*less[2:]).alias("p2"), "bytes",
                        (F.col("s_bytes") + F.coalesce("b_bytes", F.lit(0))).alias("upto"))


def _sketch(rows: DataFrame, cells: int) -> np.ndarray:
    """Two rows of bits over ``cells`` cells: whether more than one prefix falls into the cell.

    Tasks count their own prefixes and send, slice by slice, only cells that are not empty; slices are added up apart.
    """
    width = cells // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, cells), np.uint8)
        for batch in batches:
            for line in range(2):
                cell, times = np.unique(np.asarray(batch.column(line)).view(np.uint64) & np.uint64(cells - 1), return_counts=True)
                seen[line, cell] = np.minimum(seen[line, cell] + np.minimum(times, 2), 2)
        slices, once, twice = [], [], []
        for i, part in enumerate(seen.reshape(2 * SLICES, width)):
            if part.any():
                slices.append(i)
                once.append(np.flatnonzero(part == 1).astype(np.uint32).tobytes())
                twice.append(np.flatnonzero(part == 2).astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())],
                                         names=["slice", "once", "twice"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(of: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), pa.array([np.packbits(total > 1).tobytes()], pa.binary())],
                                              names=["slice", "bits"])
        current, total = None, None
        for batch in batches:
            for of, once, twice in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if of != current:
                    if current is not None:
                        yield packed(current)
                    current, total = of, np.zeros(width, np.uint8)
                for given, times in ((once, 1), (twice, 2)):
                    cell = np.frombuffer(given, np.uint32)
                    total[cell] = np.minimum(total[cell] + times, 2)
        if current is not None:
            yield packed(current)
    partial = rows.select("k1", "k2").mapInArrow(count, "slice int, once binary, twice binary")
    added = partial.repartition(SLICES, "slice").sortWithinPartitions("slice").mapInArrow(add, "slice int, bits binary")
    bits = np.zeros((2 * SLICES, width // 8), np.uint8)
    for row in added.collect():  # the sketch itself, whose size is bounded by max_cells
        bits[row.slice] = np.frombuffer(row.bits, np.uint8)
    return bits.reshape(2, cells // 8)


def screened(rows: DataFrame, max_cells: int) -> DataFrame:
    """The prefixes with ``alone`` and ``parent_alone``: proven to belong to one conversation. The root is not."""
    count = rows.count()
    cells = min(max(1 << (8 * count).bit_length(), 1 << 13), max_cells)
    sketch = rows.sparkSession.sparkContext.broadcast(_sketch(rows, cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sketch.value

        def shared(one: pa.Array, other: pa.Array) -> np.ndarray:
            hit = np.ones(len(one), bool)
            for line, column in enumerate((one, other)):
                cell = np.asarray(column).view(np.uint64) & np.uint64(cells - 1)
                hit &= (bits[line, cell >> np.uint64(3)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1 == 1
            return hit
        for batch in batches:
            at = batch.schema.get_field_index
            own = shared(batch.column(at("k1")), batch.column(at("k2")))
            parent = shared(batch.column(at("p1")), batch.column(at("p2"))) | (np.asarray(batch.column(at("depth"))) == 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(~own), pa.array(~parent)],
                                             names=[*batch.schema.names, "alone", "parent_alone"])
    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", alone boolean, parent_alone boolean")


def _end_lists(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): digest of the ids that end at a node, ascending, joined by commas.

    Ids are packed into texts of bounded length first; a node's packs stream through one hash, never held together.
    """
    stored, _ = keep(ends, "ends")
    packs = (ranked.laid_out(stored, [*NODE, "conv"], "ordered-ends")
             .groupBy(*NODE, "part", F.floor(F.col("at") / PACK_IDS).alias("pack"))
             .agg(F.array_join(F.sort_array(F.collect_list("conv")), ",").alias("ids")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, total = None, None

        def rows(done: list) -> pa.RecordBatch:
            keys = [pa.array([d[0][i] for d in done], pa.int64()) for i in range(3)]
            return pa.RecordBatch.from_arrays([*keys, pa.array([d[1].hexdigest() for d in done], pa.string())],
                                              names=[*NODE, "ends_sha256"])
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key != node:
                    if node is not None:
                        done.append((node, total))
                    node, total = key, hashlib.sha256(ids.encode())
                else:
                    total.update(b"," + ids.encode())
            yield rows(done)
        if node is not None:
            yield rows([(node, total)])
    ordered = packs.repartition(*NODE).sortWithinPartitions(*NODE, "part", "pack").select(*NODE, "ids")
    return ordered.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def build(turns: DataFrame, conversations: DataFrame, max_cells: int = 1 << 25) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv, depth, length, token, bytes) of ``conversations`` (conv, length).

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes that a
    shared prefix saves in the subtree), ends_sha256. Without conversations there is no node, the root included.
    """
    of_all, _ = keep(prefixes(turns), "prefixes")
    rows, _ = keep(screened(of_all, max_cells), "screened-prefixes")
    member = ["conv", *NODE, "p1", "p2", "bytes", "upto", "parent_alone", (F.col("depth") == F.col("length")).alias("last")]
    zero = F.lit(0).cast("long")
    roots = conversations.select("conv", *(zero.alias(c) for c in (*NODE, "p1", "p2", "bytes", "upto")),
                                 F.lit(False).alias("parent_alone"), (F.col("length") == 0).alias("last"))
    members = rows.where("not alone").select(*member).unionByName(roots)
    tails = rows.where("alone").select(*member)
    firsts = tails.where("not parent_alone")

    nodes, _ = keep(members.groupBy(*NODE).agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"),
        *(F.any_value(c).alias(c) for c in ("p1", "p2", "bytes", "upto", "parent_alone"))), "shared-nodes")
    above = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    below = nodes.where("depth > 0 and not parent_alone").select(*above).union(firsts.select(*above))
    children, _ = keep(below.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children")), "children")
    counted, _ = keep(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))),
                      "counted-nodes")

    # The depth from which a conversation owns its nodes, the bytes before it, and whether it owns a leaf.
    before = (F.col("upto") - F.col("bytes")).alias("spared")
    own = (counted.select("conv", "depth", before, (F.col("n_children") == 0).cast("long").alias("leaf"))
           .union(firsts.select("conv", "depth", before, F.lit(0)))
           .union(tails.where("last").select("conv", F.col("depth") + 1, "upto", F.lit(1)))
           .union(members.where("last").select("conv", F.col("depth") + 1, "upto", F.lit(0))))
    owners, _ = keep(own.groupBy("conv").agg(F.min(F.struct("depth", "spared")).alias("own"), F.max("leaf").alias("leaf"))
                     .select("conv", F.col("own.depth").alias("from"), "own.spared", "leaf"), "owners")
    spared = F.when(F.col("depth") < F.col("from"), F.col("spared") - (F.col("upto") - F.col("bytes")))
    sums = members.join(owners, "conv").groupBy(*NODE).agg(
        F.sum("leaf").alias("n_leaves"), F.coalesce(F.sum(spared), F.lit(0)).alias("saved_tokens"))

    parents = counted.select(F.col("depth") + 1, F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("up")).toDF(
        "depth", "p1", "p2", "up")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    shared = (counted.join(parents, ["depth", "p1", "p2"], "left").join(sums, NODE)
              .join(_end_lists(members.where("last").select(*NODE, "conv")), NODE, "left")
              .select("conv", "depth", F.when(F.col("depth") > 0, F.coalesce("up", "conv")).alias("up"), "n_convs", "n_children",
                      "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256")))
    single = [F.lit(1).cast("long"), F.when(F.col("last"), 0).otherwise(1).cast("long"), F.lit(1).cast("long"), zero,
              F.when(F.col("last"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(empty)]
    local = tails.where("parent_alone").select("conv", "depth", F.col("conv").alias("up"), *single)
    hung = firsts.join(parents, ["depth", "p1", "p2"]).select("conv", "depth", "up", *single)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return shared.union(local).union(hung).toDF(*names)


def conversation_trie(table: DataFrame, max_cells: int = 1 << 25) -> DataFrame:
    """The trie of a conversation table (conv_id, turn, role, text) after splicing families.

    Rows with a null conv_id belong to no conversation and are left out. Turns with equal numbers, repeated rows too, are
    turns of their own, ordered by digest. Null roles and texts are empty. Other columns are ignored.
    """
    turns, conversations = spliced(ordered_turns(table))
    return build(turns, conversations, max_cells)


def oracle_sql() -> str:
    """The trie for DuckDB, with whole prefixes as keys and subtree sums over the path of each node's smallest member."""
    return f"""
WITH ordered AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, token) - 1 AS i, token, bytes FROM (
    SELECT conv_id, turn, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS token,
      octet_length(encode(coalesce(text, ''))) AS bytes FROM conversations WHERE conv_id IS NOT NULL)),
convs AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32_sql('CAST(conv_id AS VARCHAR)')} % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM ordered)),
plans AS MATERIALIZED (
  SELECT c.conv_id, base, h, (SELECT count(*) FROM ordered o WHERE o.conv_id = c.base AND o.i < c.h) AS taken FROM convs c),
rebuilt AS MATERIALIZED (
  SELECT p.conv_id, o.i + 1 AS depth, token, bytes FROM plans p JOIN ordered o ON o.conv_id = base AND o.i < h
  UNION ALL SELECT p.conv_id, taken + o.i - h + 1, token, bytes FROM plans p JOIN ordered o ON o.conv_id = p.conv_id AND o.i >= h),
paths AS MATERIALIZED (
  SELECT conv_id, depth, string_agg(token, '') OVER (PARTITION BY conv_id ORDER BY depth) AS node, bytes FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
ends AS (SELECT conv_id, arg_max(node, depth) AS node FROM paths GROUP BY 1),
lists AS (SELECT node, sha256(string_agg(conv_id, ',' ORDER BY conv_id)) AS ends_sha256 FROM ends GROUP BY 1),
nodes AS MATERIALIZED (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM paths GROUP BY 1, 2),
children AS (SELECT left(node, 64 * (depth - 1)) AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS MATERIALIZED (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
subtrees AS (
  SELECT a.node, count(*) FILTER (y.n_children = 0) AS n_leaves, sum((y.n_convs - 1) * y.bytes) AS saved_tokens
  FROM counted y JOIN paths a ON a.conv_id = y.conv_id AND a.depth <= y.depth GROUP BY 1)
SELECT c.conv_id, c.depth, up.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM counted c JOIN subtrees USING (node) LEFT JOIN lists USING (node)
LEFT JOIN nodes up ON up.depth = c.depth - 1 AND up.node = left(c.node, 64 * (c.depth - 1))"""
