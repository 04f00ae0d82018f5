"""Removal of globally repeated multi-line passages by content-defined chunks of lines.

A rolling hash over the hashes of the last lines says of every line whether it opens a chunk, closes one or does neither.
Rules with a window of one line cut by the line alone, so whatever stands around a passage, its inner chunks are the same.
Rules differ in how rare their borders are, so short lines have long chunks as well; each repeated chunk is a seed. A seed
is grown line by line to both sides as long as it agrees with its first occurrence, and what has grown is compared byte by
byte, so passages go whole although their first and last lines may be in no chunk of their own. Lines that go round with a
short period look alike to any rule, so there every shortest stretch of two lines and ``min_bytes`` is a chunk. An
unwrapped paragraph (a line with ``long_line`` blanks or more) is several lines on the page, and so is a chunk of its own
under every rule. A passage of hardly more than ``min_bytes`` in many tiny lines may be missed: no chunk need lie inside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelake.llm import words
from gatelake.llm.common import drop_table, keep, sent_if_small, small_batches

#: (rarity of openers and of closers, lines the rolling hash covers, number of such rules).
RULES = ((2, 1, 20), (8, 1, 4), (32, 1, 4), (4, 2, 2))
#: Numbers of lines after which lines may go round without a border of their own.
PERIODS = (1, 2, 3, 4)
_CHUNK = "doc long, first int, n int, size int, hash long"
_SLICE = "doc long, first int, n int, sides int, bytes binary, before array<binary>, after array<binary>"
#: Which place of a range a slice is: the later one, the earlier one, or of some ranges this and of others that.
LATER, EARLIER = 1, 2
#: Bytes in memory up to which repeated chunks are sent. Shuffled they are a small part of the input, unlike the texts that
#: lists of lines are joined with.
CHUNKS_HELD = 16 << 20


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every line (without its newline) and the index of each row's first line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    ends = np.sort(np.concatenate((offsets[1:], breaks)), kind="stable")
    per_row = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    return starts, ends, np.concatenate(([0], np.cumsum(per_row)))


def _rolling(hashes: np.ndarray, within: np.ndarray, window: int) -> np.ndarray:
    """Hash of the last ``window`` lines of the same row; ``within`` numbers the lines of a row."""
    rolling = np.zeros(len(hashes), np.uint64)
    for back in range(min(window, len(hashes))):
        own = within[back:] >= back
        rolling[back:][own] += (hashes[:len(hashes) - back] * np.uint64(pow(int(words._STEP), back + 1, 1 << 64)))[own]
    return rolling


def _stretches(hashes, starts, ends, row_last, min_bytes: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of the shortest chunks from every line on where lines go round with a period, twice at least."""
    line = np.arange(len(hashes))
    stops = np.append(period + np.flatnonzero((hashes[period:] != hashes[:-period]) | (row_last[period:] != row_last[:-period])),
                      len(hashes))
    run_end = stops[np.minimum(np.searchsorted(stops, line + period), len(stops) - 1)] - 1
    last = np.maximum(np.searchsorted(ends, starts + min_bytes), line + 1)
    inside = np.flatnonzero((last <= run_end) & (run_end >= line + 2 * period - 1))
    return inside, last[inside]


def _chunks(data, offsets, rules: tuple, long_line: int, min_bytes: int):
    """(row, first line, lines, bytes, hash) of the chunks of all rules, each once."""
    starts, ends, row_first = _lines(data, offsets)
    count = len(starts)
    hashes = words.span_hashes(data, starts, ends)
    blanks = np.flatnonzero(words.SPACES[data])
    is_long = np.searchsorted(blanks, ends) - np.searchsorted(blanks, starts) >= long_line
    within = np.arange(count) - np.repeat(row_first[:-1], np.diff(row_first))
    forced = is_long.copy()
    forced[:-1] |= is_long[1:]
    forced[row_first[1:] - 1] = True
    spans, salt = [], 0
    for every, window, times in rules:
        rolling = _rolling(hashes, within, window)
        for _ in range(times):
            salt += 1
            kind = words.mix(rolling + np.uint64(salt * int(words._BASE) % (1 << 64))) % np.uint64(every)
            border = forced | (kind == 0)
            border[:-1] |= kind[1:] == 1
            last = np.flatnonzero(border)
            first = np.concatenate(([0], last[:-1] + 1))
            some = (last > first) | is_long[first]
            spans.append(first[some] * np.int64(count) + last[some])
    row_last = np.repeat(row_first[1:], np.diff(row_first))
    for period in PERIODS:
        first, last = _stretches(hashes, starts, ends, row_last, min_bytes, period)
        spans.append(first * np.int64(count) + last)
    spans = np.unique(np.concatenate(spans))
    first, last = spans // count, spans % count
    size = ends[last] - starts[first]
    fit = size >= min_bytes
    first, last, size = first[fit], last[fit], size[fit]
    up, down = words._power_arrays(count + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1])))
    chunk = words.mix((total[last + 1] - total[first]) * down[first] + (last - first).astype(np.uint64) * words._STEP)
    row = np.searchsorted(row_first, first, "right") - 1
    return row, first - row_first[row], last - first + 1, size, chunk


def _chunk_rows(docs: DataFrame, **how) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in words.text_blocks(batch.column(1)):
                row, first, n, size, chunk = _chunks(data, offsets, **how)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at).take(pa.array(row)), pa.array(first, pa.int32()),
                     pa.array(n, pa.int32()), pa.array(size, pa.int32()), pa.array(chunk.view(np.int64))],
                    names=["doc", "first", "n", "size", "hash"])
    return small_batches(docs).mapInArrow(run, _CHUNK)


def _digest(value: bytes) -> bytes:
    return hashlib.blake2b(value, digest_size=16).digest()


def _slices(docs: DataFrame, asked: DataFrame, reach: int) -> DataFrame:
    """As ``_kept_slices``, for those that stay."""
    return _kept_slices(docs, asked, reach)[0]


def _kept_slices(docs: DataFrame, asked: DataFrame, reach: int) -> tuple[DataFrame, str]:
    """(doc, first, n, sides, bytes, before, after) of the asked line ranges; up to ``reach`` lines on each side, nearest first.

    ``sides`` is passed on, both if it is not given. With a reach, digests stand for range and lines, as they only decide how
    far to grow. The rows are stored, with their path.
    """
    sent = _digest if reach else bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, firsts, counts, sides, parts, before, after = [], [], [], [], [], [], []
                for i, (text, ranges) in enumerate(zip(part.column(1), part.column(2), strict=True)):
                    lines = (text.as_py() or "").encode().split(b"\n")
                    for r in ranges.as_py():
                        first, n = r >> 32, r >> 2 & 0x3FFFFFFF
                        end = first + n
                        if end <= len(lines):
                            ids.append(i)
                            firsts.append(first)
                            counts.append(n)
                            sides.append(r & 3)
                            parts.append(sent(b"\n".join(lines[first:end])))
                            before.append([sent(x) for x in lines[max(0, first - reach):first][::-1]])
                            after.append([sent(x) for x in lines[end:end + reach]])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(ids, pa.int32())), pa.array(firsts, pa.int32()), pa.array(counts, pa.int32()),
                     pa.array(sides, pa.int32()), pa.array(parts, pa.binary()), pa.array(before, pa.list_(pa.binary())),
                     pa.array(after, pa.list_(pa.binary()))],
                    names=["doc", "first", "n", "sides", "bytes", "before", "after"])
    # One number a range: as structs, the lists would take twice the memory where they are sent.
    sides = F.col("sides") if "sides" in asked.columns else F.lit(LATER | EARLIER)
    ranges = F.shiftleft(F.col("first").cast("long"), 32) + F.shiftleft(F.col("n").cast("long"), 2) + sides
    lists, listed = keep(asked.groupBy("doc").agg(F.collect_set(ranges).alias("ranges")), "asked-lines")
    stored = keep(docs.join(sent_if_small(lists, 8 * F.size("ranges")), "doc").select("doc", "text", "ranges").mapInArrow(
        run, _SLICE), "slices", "zstd")
    drop_table(docs.sparkSession, listed)
    return stored


def _alike(a: str, b: str) -> Column:
    """How many lines two lists have in common from their start."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(same, False).cast("int")
    return F.when(stop == 0, F.size(same)).otherwise(stop - 1)


def _asked(ranges: DataFrame) -> DataFrame:
    """(doc, first, n, sides) of both places of the ranges."""
    later = ranges.select("doc", "first", "n", F.lit(LATER).alias("sides"))
    both = later.union(ranges.select("at", "at_first", "n", F.lit(EARLIER)))
    return both.groupBy("doc", "first", "n").agg(F.bit_or("sides").alias("sides"))


def _both_places(ranges: DataFrame, slices: DataFrame) -> DataFrame:
    """Ranges whose two places are alike, with the lines around both. A slice goes only where its place is asked for.

    Never by broadcast: lines around ranges that repeat are hundreds of times as large in memory as in their files.
    """
    later = slices.where(F.col("sides").bitwiseAND(LATER) != 0).drop("sides")
    earlier = slices.where(F.col("sides").bitwiseAND(EARLIER) != 0).select(
        F.col("doc").alias("at"), F.col("first").alias("at_first"), "n", F.col("bytes").alias("held"),
        F.col("before").alias("held_before"), F.col("after").alias("held_after"))
    return ranges.join(later.hint("merge"), ["doc", "first", "n"]).join(earlier.hint("merge"), ["at", "at_first", "n"]).where(
        "bytes = held")


def _grown(docs: DataFrame, ranges: DataFrame, reach: int) -> DataFrame:
    """Ranges (doc, first, n, at, at_first) grown line by line as far as both places agree.

    Ranges that still agree at the end of what was sent go on with eight times as many lines, until none is left.
    """
    done = None
    while True:
        slices, path = _kept_slices(docs, _asked(ranges), reach)
        alike = _both_places(ranges, slices).withColumn("up", _alike("before", "held_before")).withColumn(
            "down", _alike("after", "held_after"))
        grown, _ = keep(alike.select(
            "doc", (F.col("first") - F.col("up")).alias("first"), (F.col("n") + F.col("up") + F.col("down")).alias("n"), "at",
            (F.col("at_first") - F.col("up")).alias("at_first"),
            ((F.col("up") == reach) | (F.col("down") == reach)).alias("goes_on")).distinct(), "grown-ranges")
        drop_table(docs.sparkSession, path)
        closed = grown.where("not goes_on").drop("goes_on")
        done = closed if done is None else done.union(closed)
        ranges = grown.where("goes_on").drop("goes_on")
        if ranges.isEmpty():
            return done.distinct()
        reach *= 8


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      rules: tuple[tuple[int, int, int], ...] = RULES, long_line: int = 49, min_bytes: int = 64) -> DataFrame:
    """(doc, first, n): ranges of lines, counted from 0, whose bytes stand earlier in the corpus.

    Earlier is by (id, line), so of every line that is cut one copy stays. A chunk counts if it has two lines or is one
    long line, and has ``min_bytes`` bytes. Equal hashes only propose; ranges go after a comparison of their bytes.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    named = docs.where("doc is not null")
    chunks = _chunk_rows(named, rules=rules, long_line=long_line, min_bytes=min_bytes)
    place = F.struct("doc", "first")
    groups = (chunks.groupBy("hash", "size").agg(F.min(place).alias("low"), F.max(place).alias("high"))
              .where("low <> high").select("hash", "size", "low"))
    groups, grouped = keep(groups, "repeated-chunks")
    later = chunks.join(sent_if_small(groups, F.lit(56), CHUNKS_HELD), ["hash", "size"]).where(place != F.col("low"))
    moved = later.select("doc", "first", F.col("low.doc").alias("at"), (F.col("low.first") - F.col("first")).alias("delta"),
                         (F.col("first") + F.col("n")).alias("end")).distinct()
    # Chunks of different rules that follow or overlap each other in the same two places are one range.
    order = Window.partitionBy("doc", "at", "delta").orderBy("first", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = moved.withColumn("new", F.coalesce((F.col("first") > reach).cast("int"), F.lit(1))).withColumn(
        "island", F.sum("new").over(order))
    ranges = islands.groupBy("doc", "at", "delta", "island").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    ranges, _ = keep(ranges.select("doc", "first", (F.col("end") - F.col("first")).alias("n"), "at",
                                   (F.col("first") + F.col("delta")).alias("at_first")), "repeated-ranges")
    drop_table(docs.sparkSession, grouped)
    grown, _ = keep(_grown(named, ranges, reach=4), "whole-ranges")
    return _both_places(grown, _slices(named, _asked(grown), reach=0)).select("doc", "first", "n").distinct()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with repeated passages cut out of the text, and ``cut_lines``: the removed lines, counted from 0.

    Texts without a repeat stay as they are, byte for byte; ``cut_lines`` is then empty. Null texts stay null, and rows
    with a null id stay whole. Rows that share an id are one document: what stands at the same line of both is no
    repeat. A text that only repeats earlier ones becomes empty; what to do with it is the caller's choice. Other
    columns pass through; a column of the name ``cut_lines`` is replaced.
    """
    ranges = repeated_passages(docs, id_col, text_col, **how)
    cuts = ranges.groupBy("doc").agg(F.collect_list(F.struct("first", "n")).alias("ranges"))
    cuts, _ = keep(cuts.select(F.col("doc").alias("_cut_doc"), F.array_sort(F.array_distinct(F.flatten(F.transform(
        "ranges", lambda r: F.sequence(r["first"], r["first"] + r["n"] - 1))))).alias("_cut")), "cut-lines")
    # The rows travel as one struct, so no column name of theirs can meet one of ours.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    joined = rows.join(sent_if_small(cuts, 4 * F.size("_cut")), F.col("_row")[id_col].cast("long") == F.col("_cut_doc"), "left")
    lines = F.split(F.col("_row")[text_col], "\n", -1)
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_cut"))
    left = F.array_join(F.transform(rest, lambda i: F.element_at(lines, i + 1)), "\n")
    columns = [F.when(F.col("_cut").isNull(), F.col("_row")[c]).otherwise(left).alias(c) if c == text_col
               else F.col("_row")[c].alias(c) for c in docs.columns if c != "cut_lines"]
    return joined.select(*columns, F.coalesce("_cut", F.array().cast("array<int>")).alias("cut_lines"))
