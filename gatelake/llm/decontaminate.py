"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Words are runs of letters and digits in lower case; a text is its sequence of ``k``-word shingles with multiplicity.
Similarity is the weighted Jaccard of a window and an item: sum of the smaller over sum of the larger multiplicities.

* A window has as many words as the item (a shorter document is one window). Such a window can only reach the threshold
  if a fixed share of its shingles occurs in some item, so windows below that share, read off a bitmap of the
  benchmark's shingles, are not fingerprinted. The bitmap has a fixed size; false positives cost time only.
* Fingerprints have 128 bits in 16 blocks of 8. Two within ``radius`` agree in some block but for radius // 16 bits, so
  the items post every block value at most that far away and the windows look up theirs: no pair within is missed.
* Pairs within the radius are verified on their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.llm import words
from gatelake.llm.common import bounded_broadcast, keep, small_batches

BLOCKS, BLOCK_BITS = 16, 8
GATE_BITS = 1 << 21
_SALTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], np.uint64)


def _row_words(column: pa.Array):
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for at in range(0, len(column), 512):
        for row, hashes in words.row_words(pc.utf8_lower(column.slice(at, 512)), words.PUNCTUATION, None):
            yield at + row, hashes


def _signs(shingles: np.ndarray) -> np.ndarray:
    """128 signs of every shingle."""
    lanes = words.mix(shingles[:, None] ^ _SALTS[None, :])
    return np.unpackbits(lanes.view(np.uint8).reshape(len(shingles), 16), axis=1).astype(np.int32) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.int64).reshape(-1, 2)


def _gate_slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(17)).astype(np.int64) & (GATE_BITS - 1)


def _items(benchmark: DataFrame, k: int) -> DataFrame:
    """(item_id, size, f1, f2, shingles) of every item with a word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, prints, shingles = [], [], [], []
            for row, hashes in _row_words(batch.column(1)):
                if len(hashes):
                    s = words.windows(hashes, k)
                    rows.append(row)
                    sizes.append(len(hashes))
                    prints.append(_fingerprints(_signs(s).sum(axis=0, keepdims=True))[0])
                    shingles.append(s.view(np.int64))
            prints = np.array(prints, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(sizes, pa.int32()), pa.array(prints[:, 0].copy()),
                 pa.array(prints[:, 1].copy()), pa.array(shingles, pa.list_(pa.int64()))],
                names=["item_id", "size", "f1", "f2", "shingles"])
    return benchmark.mapInArrow(run, "item_id long, size int, f1 long, f2 long, shingles array<long>")


def _gate(items: DataFrame) -> np.ndarray:
    """The bitmap of all item shingles, one byte array of fixed size, joined on the executors."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(GATE_BITS, bool)
        for batch in batches:
            bits[_gate_slots(batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64))] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(GATE_BITS // 8, np.uint8)
        for batch in batches:
            for value in batch.column(0):
                bits |= np.frombuffer(value.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])
    row = items.select("shingles").mapInArrow(mark, "bits binary").repartition(32).coalesce(1).mapInArrow(join, "bits binary").first()
    return np.unpackbits(np.frombuffer(row.bits, np.uint8)).astype(bool)


def _needed(window: int, item: int, num: int, den: int) -> int:
    """Common shingles without which a window and an item of so many shingles stay below the threshold."""
    return -(-num * (window + item) // (num + den))


def _windows_of(hashes: np.ndarray, k: int, sizes: list[int], gate: np.ndarray, num: int, den: int):
    """(start, item size, words, shingles, shingles in the window) of the windows that can match an item of that size."""
    shingles = words.windows(hashes, k)
    hits = gate[_gate_slots(shingles)]
    total, smallest = None, sizes[0]
    # What is needed grows with the size of item and window, so the smallest item sets the least.
    if smallest >= k and np.count_nonzero(hits) < _needed(max(1, min(smallest, len(hashes)) - k + 1), smallest - k + 1, num, den):
        return
    for size in sizes:
        width = min(size, len(hashes))
        inside = max(1, width - k + 1)
        need = _needed(inside, max(1, size - k + 1), num, den)
        if need > inside:
            continue
        if width < min(k, len(hashes)):  # windows of fewer words than a shingle are sequences of their own
            s = words.windows(hashes, width)
            for start in np.flatnonzero(gate[_gate_slots(s)]):
                yield int(start), size, width, s, 1
            continue
        if total is None:
            total = np.concatenate(([0], np.cumsum(hits)))
        if total[-1] < need:
            continue
        for start in np.flatnonzero(total[inside:] - total[:-inside] >= need):
            yield int(start), size, width, shingles, inside


def _window_rows(docs: DataFrame, k: int, sizes: list[int], gate, num: int, den: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = gate.value
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]

            def flush():
                prints = np.array(out[4], np.int64).reshape(-1, 2)
                done = pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(out[0], pa.int32())), pa.array(out[1], pa.int32()),
                     pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()), pa.array(prints[:, 0].copy()),
                     pa.array(prints[:, 1].copy()), pa.array(out[5], pa.list_(pa.int64()))],
                    names=["doc", "start", "size", "n_words", "f1", "f2", "shingles"])
                for part in out:
                    part.clear()
                return done
            for row, hashes in _row_words(batch.column(1)):
                if not len(hashes):
                    continue
                for start, size, width, s, inside in _windows_of(hashes, k, sizes, marked, num, den):
                    part = s[start:start + inside]
                    sums = _signs(part).sum(axis=0, keepdims=True)
                    for column, value in zip(out, (row, start, size, width, _fingerprints(sums)[0], part.view(np.int64)),
                                             strict=True):
                        column.append(value)
                    if len(out[0]) >= 4096:
                        yield flush()
            yield flush()
    return small_batches(docs).mapInArrow(run, "doc long, start int, size int, n_words int, f1 long, f2 long, shingles array<long>")


def _similarity(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            values = []
            for own, item in zip(batch.column(names.index("shingles")), batch.column(names.index("item_shingles")),
                                 strict=True):
                a, n_a = np.unique(np.asarray(own.values), return_counts=True)
                b, n_b = np.unique(np.asarray(item.values), return_counts=True)
                _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
                common = int(np.minimum(n_a[i], n_b[j]).sum())
                values.append((common, int(n_a.sum() + n_b.sum()) - common))
            common, union = (pa.array([v[i] for v in values], pa.int32()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index(c)) for c in ("doc", "item_id", "start", "n_words")] + [common, union],
                names=["doc", "item_id", "start", "n_words", "common", "total"])
    return pairs.mapInArrow(run, "doc long, item_id long, start int, n_words int, common int, total int")


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", k: int = 5, threshold: tuple[int, int] = (3, 4),
                  radius: int = 40) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): for every document and item that match, the best window.

    Ties go to the first window. Null and wordless texts, null items and an empty table on either side match nothing;
    texts shorter than an item are one window; items of fewer than ``k`` words match as a whole sequence. Rows that
    share an id are one document, and so are null ids, whose matches come out under a null id. Repeated items each
    match. Other columns are ignored. The default radius is more than four standard deviations above the expected
    distance at the threshold.
    """
    num, den = threshold
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    items, _ = keep(_items(benchmark.select(F.col(item_col).cast("long").alias("item_id"),
                                            F.col(item_text).cast("string").alias("text")), k), "items")
    sizes = sorted(r.size for r in items.select("size").distinct().collect())  # at most as many as words in the longest item
    gate = spark.sparkContext.broadcast(_gate(items) if sizes else np.zeros(GATE_BITS, bool))
    windows, _ = keep(_window_rows(docs, k, sizes or [k], gate, num, den), "windows")

    near = [m for r in range(radius // BLOCKS + 1) for m in (sum(1 << b for b in bits)
                                                             for bits in combinations(range(BLOCK_BITS), r))]
    def block(i):
        lane, shift = ("f1", 8 * i) if i < 8 else ("f2", 8 * (i - 8))
        return F.shiftrightunsigned(F.col(lane), shift).bitwiseAND(0xFF).cast("int")
    blocks = F.posexplode(F.array(*(block(i) for i in range(BLOCKS)))).alias("block", "value")
    posted = (items.select("item_id", "size", F.col("f1").alias("g1"), F.col("f2").alias("g2"), blocks)
              .withColumn("mask", F.explode(F.array(*(F.lit(m) for m in near))))
              .select("item_id", "size", "g1", "g2", "block", F.col("value").bitwiseXOR(F.col("mask")).alias("value")))
    posted, _ = keep(posted, "posted-items")
    apart = F.bit_count(F.col("f1").bitwiseXOR(F.col("g1"))) + F.bit_count(F.col("f2").bitwiseXOR(F.col("g2")))
    found = (windows.select("doc", "start", "size", "f1", "f2", "shingles", "n_words", blocks)
             .join(bounded_broadcast(posted), ["size", "block", "value"]).where(apart <= radius)
             .dropDuplicates(["doc", "start", "size", "item_id", "f1", "f2", "g1", "g2"]))
    texts = items.select(F.col("item_id").alias("of_item"), F.col("size").alias("of_size"), F.col("f1").alias("of_1"),
                         F.col("f2").alias("of_2"), F.col("shingles").alias("item_shingles"))
    near_items = found.join(bounded_broadcast(texts, wide=True), F.col("item_id").eqNullSafe(F.col("of_item")) & (
        F.col("size") == F.col("of_size")) & (F.col("g1") == F.col("of_1")) & (F.col("g2") == F.col("of_2")))
    checked = _similarity(near_items.select("doc", "item_id", "start", "n_words", "shingles", "item_shingles"))
    hit = checked.where(den * F.col("common") >= num * F.col("total"))
    best = F.struct((F.col("common") / F.col("total")).alias("similarity"), (-F.col("start")).alias("back"), "n_words")
    return (hit.groupBy("doc", "item_id").agg(F.max(best).alias("best"))
            .select(F.col("doc").alias("doc_id"), "item_id", (-F.col("best.back")).alias("start_word"),
                    F.col("best.n_words").alias("n_words"), F.col("best.similarity").alias("similarity")))
