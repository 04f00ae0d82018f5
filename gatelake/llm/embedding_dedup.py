"""Near duplicates among embeddings by cross-polytope hashing with verified pairs.

A vector is rotated by random sign flips and fast Hadamard transforms; its hash is the coordinate of largest size with
its sign. Two independent hashes make a bucket, several tables of buckets give a pair several chances, and every vector
also enters the buckets that swap one of its hashes for the runner-up. Equal vectors are one class first. Within a
bucket all pairs are compared by cosine in double precision; a pair counts in the first bucket that it shares, so it is
counted once however many it shares. Large buckets are dealt out as pairs of blocks of bounded size.

What leaves a bucket is linear in its members: the number of linked vectors of each and a spanning forest of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.llm.common import bounded_broadcast, keep
from gatelake.llm.components import components

#: Members of one block of a bucket.
BLOCK = 1024
_PAIRS = 1 << 18


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x


def codes(unit: np.ndarray, tables: int, probes: int, seed: int) -> np.ndarray:
    """(vectors, tables * (1 + probes)) sorted bucket numbers of unit vectors of one dimension."""
    m, dim = unit.shape
    width = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((m, width))
    padded[:, :dim] = unit
    rng = np.random.Generator(np.random.PCG64([seed, dim]))
    out = np.empty((m, tables, 1 + probes), np.int64)
    rows = np.arange(m)
    for t in range(tables):
        best, second, loss = [], [], []
        for _ in range(2):
            x = padded
            for _ in range(3):
                x = _hadamard(x * rng.choice((-1.0, 1.0), width)) / np.sqrt(width)
            both = np.concatenate((x, -x), axis=1)
            order = np.argpartition(-both, probes, axis=1)[:, :probes + 1]
            ranked = order[rows[:, None], np.argsort(-both[rows[:, None], order], axis=1, kind="stable")]
            value = both[rows[:, None], ranked]
            best.append(ranked[:, 0])
            second.append(ranked[:, 1:])
            loss.append(value[:, :1] - value[:, 1:])
        sides = 2 * width
        changed = np.concatenate((second[0] * sides + best[1][:, None], best[0][:, None] * sides + second[1]), axis=1)
        take = np.argsort(np.concatenate(loss, axis=1), axis=1, kind="stable")[:, :probes]
        out[:, t, 0] = best[0] * sides + best[1]
        out[:, t, 1:] = changed[rows[:, None], take]
        out[:, t] += t * sides * sides
    return np.sort(out.reshape(m, -1) * 4096 + dim, axis=1)


def _unit(values: np.ndarray) -> np.ndarray:
    scaled = values / np.abs(values).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _bucket_rows(classes: DataFrame, tables: int, probes: int, seed: int) -> DataFrame:
    """(doc, weight, unit, codes) of every class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            length = np.diff(np.asarray(column.offsets))
            flat, start = np.asarray(column.values, float), np.asarray(column.offsets)[:-1]
            for dim in np.unique(length):
                rows = np.flatnonzero(length == dim)
                unit = _unit(flat[start[rows][:, None] + np.arange(dim)])
                own = codes(unit, tables, probes, seed)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)),
                     pa.array([u.tobytes() for u in unit], pa.binary()), pa.array(list(own), pa.list_(pa.int64()))],
                    names=["doc", "weight", "unit", "codes"])
    return classes.mapInArrow(run, "doc long, weight long, unit binary, codes array<long>")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest member) with the components of the links between local numbers a and b."""
    nodes, local = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = local[:len(a)], local[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _linked(rows: DataFrame, num: float) -> DataFrame:
    """(doc, other, n): per cell the weight of the links of each member (other null), and a forest of its links.

    Rows are sorted by cell within a partition; a cell has at most two blocks. Only the open cell is carried over.
    """
    def compare(cell, ids, weight, unit, own, half):
        """Links of one cell as local pairs; between the halves if the blocks differ."""
        count = len(ids)
        left = np.flatnonzero(half == 0) if half.any() else np.arange(count)
        right = np.flatnonzero(half == 1) if half.any() else left
        step = max(1, _PAIRS // max(1, len(right)))
        for at in range(0, len(left), step):
            some = left[at:at + step]
            close = unit[some] @ unit[right].T >= num
            i, j = np.nonzero(close)
            a, b = some[i], right[j]
            ok = (a != b) if half.any() else (a < b)
            a, b = a[ok], b[ok]
            for piece in range(0, len(a), 1 << 16):
                p, q = a[piece:piece + (1 << 16)], b[piece:piece + (1 << 16)]
                # The first bucket that both share; codes are sorted.
                first = np.full(len(p), np.iinfo(np.int64).max)
                for c in range(own.shape[1]):
                    shared = (own[p, c][:, None] == own[q]).any(axis=1)
                    first = np.where(shared & (own[p, c] < first), own[p, c], first)
                here = first == cell
                if here.any():
                    yield p[here], q[here]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_cells: list[pa.RecordBatch] = []

        def closed(table: pa.Table, last: bool):
            """Results of the cells that are complete, and the rows of the open one."""
            table = table.combine_chunks()
            bucket, lo, hi = (np.asarray(table.column(c)) for c in ("bucket", "low", "high"))
            change = np.flatnonzero((bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            edges = np.concatenate(([0], change, [len(bucket)]))
            if not last:
                rest = table.slice(int(edges[-2]))
                edges = edges[:-1]
            else:
                rest = table.slice(len(bucket))
            ids, weight, part = (np.asarray(table.column(c)) for c in ("doc", "weight", "part"))
            docs, others, amounts = [], [], []
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if end - start < 2:
                    continue
                piece = table.slice(int(start), int(end - start))
                raw = piece.column("unit").to_pylist()
                unit = np.frombuffer(b"".join(raw)).reshape(len(raw), -1)
                own = np.array(piece.column("codes").to_pylist(), np.int64)
                half = (part[start:end] != lo[start]).astype(int)
                if lo[start] != hi[start] and (half.all() or not half.any()):
                    continue
                here, w = ids[start:end], weight[start:end]
                total = np.zeros(len(here), np.int64)
                links = []
                for p, q in compare(bucket[start], here, w, unit, own, half):
                    np.add.at(total, p, w[q])
                    np.add.at(total, q, w[p])
                    links.append(_forest(p, q))
                if not links:
                    continue
                some = np.flatnonzero(total)
                docs.append(here[some])
                others.append(np.full(len(some), -1))
                amounts.append(total[some])
                member, root = (np.concatenate(x) for x in zip(*links, strict=True))
                apart = member != root
                docs.append(here[member[apart]])
                others.append(here[root[apart]])
                amounts.append(np.zeros(int(apart.sum()), np.int64))
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            link = cat(amounts) == 0
            return pa.RecordBatch.from_arrays(
                [pa.array(cat(docs)), pa.array(cat(others), mask=~link), pa.array(cat(amounts))],
                names=["doc", "other", "n"]), rest
        for batch in batches:
            done, rest = closed(pa.Table.from_batches([*open_cells, batch]), False)
            yield done
            open_cells = rest.to_batches()
        if open_cells:
            yield closed(pa.Table.from_batches(open_cells), True)[0]
    return rows.mapInArrow(run, "doc long, other long, n long")


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
                 tables: int = 6, probes: int = 2, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors link at a cosine of ``threshold`` or more; ``n_links`` counts the other vectors linked directly, equal ones
    included, and ``component_id`` is the smallest id reachable. Null vectors, empty or zero ones and those with a null
    or non-finite component link with nothing, and so do null ids (their component and kept are null and false).
    Vectors of different length never link. Rows that repeat id and vector are one vector and each get its row; one id
    with several vectors is one node with the links of all. Other columns are ignored. No pair below the threshold is
    linked; recall is a matter of tables and probes (0.99 and more with these, measured against brute force).
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = (F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
            & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("v", lambda x: x != 0))
    usable = rows.where(F.coalesce(good, F.lit(False)))
    key = F.sha2(F.array_join(F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")), ","), 256)
    keyed = usable.select("vec_id", "v", key.alias("key"))
    members = keyed.select("vec_id", "key").distinct()
    classes = members.groupBy("key").agg(F.min("vec_id").alias("head"), F.count("*").alias("weight"))
    members, _ = keep(members.join(classes, "key"), "vector-classes")
    heads = keyed.join(bounded_broadcast(members.where("vec_id = head").select("key", "head", "weight"), wide=True), "key")
    heads = heads.where("vec_id = head").dropDuplicates(["key", "head"]).select(F.col("head").alias("doc"), "weight", "v")
    stored, _ = keep(_bucket_rows(heads, tables, probes, seed), "vector-codes")

    placed = stored.select("doc", "weight", F.explode("codes").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    sizes, _ = keep(sizes, "bucket-sizes")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    part = F.pmod(F.xxhash64("doc", "bucket"), blocks).cast("int")
    dealt = (stored.select("doc", "weight", "unit", "codes", F.explode("codes").alias("bucket"))
             .join(bounded_broadcast(sizes), "bucket").withColumn("part", part)
             .withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select("bucket", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "part",
                     "doc", "weight", "unit", "codes"))
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = dealt.repartition(n, "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    found, _ = keep(_linked(cells, threshold), "vector-links")

    direct = found.where("other is null").groupBy("doc").agg(F.sum("n").alias("n"))
    joined = components(found.where("other is not null").select("doc", "other").union(
        members.where("vec_id <> head").select("head", "vec_id")), "doc", "other")
    per_vector = (members.join(direct, F.col("head") == F.col("doc"), "left")
                  .groupBy("vec_id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    component = F.coalesce("component", "vec_id")
    return (rows.select("vec_id").join(per_vector, "vec_id", "left")
            .join(joined.withColumnRenamed("node", "vec_id"), "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept")))
