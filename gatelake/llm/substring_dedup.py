"""Removal of word passages that stand in an earlier document, by suffix automata of reference shards.

A window of ``window`` words is repeated if its words also start in a document with a smaller id. The reference is what
such windows are repeated from: each repeated window once, in the first document that has it. It is cut into shards of
bounded size; a shard's suffix automaton is sent to the tasks that stream the documents which may repeat something of it.
Streaming gives matching statistics (how many words up to here stand in the reference, and the smallest document that
holds the last ``window`` of them), and maximal spans of matched windows are removed. The automata compare words.

Which texts meet which shard is screened by hashes. Every window selects the smallest hash of its ``gram`` words
(minimizer); neighbouring windows that select the same place are a region. Equal windows select equal grams, so only
regions whose gram is in several documents can hold a repeat. Of these each distinct region is opened once, and its windows
are grouped by a 128-bit hash to find the first document. A region whose gram has no other form needs no opening.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.llm import words
from gatelake.llm.common import keep, keep_bucketed, small_batches, small_table

#: Windows of a document in one piece of a shard, words of a shard, and texts streamed through one copy of its automaton.
PIECE, SHARD_WORDS, TURN = 2048, 1 << 16, 2048
#: Rows whose words are in memory at a time.
ROWS = 256
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)

_REGION = "doc long, td long, start int, n int, a long, g long"
_ROW = ["doc", "td"]


def _minimizers(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value among each ``width`` neighbours."""
    value, place, done = h, np.arange(len(h)), 1
    while done < width:
        step = min(done, width - done)
        left = value[:-step] <= value[step:]
        value, place = np.where(left, value[:-step], value[step:]), np.where(left, place[:-step], place[step:])
        done += step
    return place


def _sums(h: np.ndarray) -> np.ndarray:
    up, _ = words._power_arrays(len(h) + 1)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[:-1])))


def _span(sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from ``first`` up to ``end``, wherever they stand."""
    _, down = words._power_arrays(len(sums))
    return words.mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64) * words._STEP)


def _regions(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = []
                for row, h in words.row_words(part.column(2), lower=None):
                    if len(h) < window:
                        continue
                    grams = words.windows(h, gram)
                    place = _minimizers(grams, window - gram + 1)
                    start = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
                    end = np.append(start[1:], len(place))
                    content = _span(_sums(h), start, end + (window - 1)) + (place[start] - start).astype(np.uint64) * _OTHER
                    found.append((np.full(len(start), row), start, end - start, grams[place[start]], content))
                if found:
                    row, start, n, a, g = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(start, pa.int32()),
                         pa.array(n, pa.int32()), pa.array(a.view(np.int64)), pa.array(g.view(np.int64))],
                        names=["doc", "td", "start", "n", "a", "g"])
    return small_batches(docs).mapInArrow(run, _REGION)


def _asked(docs: DataFrame, asked: DataFrame, name: str) -> DataFrame:
    """(doc, td, text, asked): the rows of ``docs`` that something is asked of, with all that is asked."""
    rest = [c for c in asked.columns if c not in _ROW]
    lists, _ = keep(asked.groupBy(*_ROW).agg(F.collect_set(F.struct(*rest)).alias("asked")), name)
    return docs.join(lists, _ROW).select(*_ROW, "text", "asked")


def _opened(docs: DataFrame, regions: DataFrame, window: int) -> DataFrame:
    """(doc, td, pos, w1, w2, a, g, high) of every window of the regions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = []
                for row, h in words.row_words(part.column(2), lower=None):
                    asked = part.column(3)[row].values
                    start, n, *of = (np.asarray(asked.field(i)) for i in range(5))
                    which = np.repeat(np.arange(len(start)), n)
                    pos = start[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                    found.append((np.full(len(pos), row), pos, _span(_sums(h), pos, pos + window),
                                  _span(_sums(words.mix(h ^ _OTHER)), pos, pos + window), *(x[which] for x in of)))
                if found:
                    row, pos, w1, w2, a, g, high = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(pos, pa.int32()),
                         pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(a), pa.array(g), pa.array(high)],
                        names=["doc", "td", "pos", "w1", "w2", "a", "g", "high"])
    return _asked(docs, regions.select(*_ROW, "start", "n", "a", "g", "high"), "opened-regions").mapInArrow(
        run, "doc long, td long, pos int, w1 long, w2 long, a long, g long, high long")


def _texts(docs: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """(shard, guest, doc, td, at, words): the words of the asked windows, neighbouring ones in one text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows, shards, guests, places, texts = [], [], [], [], []
                for row, (text, asks) in enumerate(zip(part.column(2), part.column(3), strict=True)):
                    own = text.as_py().encode().split()
                    runs: list[list] = []
                    for key in sorted((a["guest"], a["shard"], a["first"], a["end"]) for a in asks.as_py()):
                        if runs and runs[-1][:2] == list(key[:2]) and key[2] <= runs[-1][3]:
                            runs[-1][3] = max(runs[-1][3], key[3])
                        else:
                            runs.append(list(key))
                    for guest, shard, first, end in runs:
                        rows.append(row)
                        shards.append(shard)
                        guests.append(guest)
                        places.append(first)
                        texts.append(b" ".join(own[first:end + window - 1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards, pa.int32()), pa.array(guests, pa.int32()), part.column(0).take(pa.array(rows, pa.int32())),
                     part.column(1).take(pa.array(rows, pa.int32())), pa.array(places, pa.int32()), pa.array(texts, pa.binary())],
                    names=["shard", "guest", "doc", "td", "at", "words"])
    return _asked(docs, asked, "asked-texts").mapInArrow(run, "shard int, guest int, doc long, td long, at int, words binary")


class SuffixAutomaton:
    """All substrings of several word sequences; every state knows the smallest document that its substrings stand in."""

    def __init__(self):
        self.next, self.link, self.length, self.first = [{}], [-1], [0], [None]

    def _state(self, length, link, following, first):
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _after(self, state, word):
        """The state of all that ``state`` and ``word`` end with, where a sequence that is known already goes on."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        split = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]), self.first[target])
        self.link[target] = split
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = split
            state = self.link[state]
        return split

    def add(self, sequence, doc):
        last = 0
        for word in sequence:
            if word in self.next[last]:
                last = self._after(last, word)
            else:
                new = self._state(self.length[last] + 1, 0, {}, None)
                state = last
                while state >= 0 and word not in self.next[state]:
                    self.next[state][word] = new
                    state = self.link[state]
                if state >= 0:
                    self.link[new] = self._after(state, word)
                last = new
            if self.first[last] is None or doc < self.first[last]:
                self.first[last] = doc

    def finish(self):
        """Hand the documents of longer substrings down to their suffixes."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            shorter, doc = self.link[state], self.first[state]
            if shorter > 0 and (self.first[shorter] is None or doc < self.first[shorter]):
                self.first[shorter] = doc

    def spans(self, sequence, doc, window):
        """Maximal spans (first, end) of words in windows that a document before ``doc`` has."""
        found, state, matched = [], 0, 0
        following, link, length, first = self.next, self.link, self.length, self.first
        for i, word in enumerate(sequence):
            target = following[state].get(word)
            while target is None and state:
                state = link[state]
                matched = length[state]
                target = following[state].get(word)
            if target is None:
                continue
            state, matched = target, matched + 1
            if matched < window:
                continue
            while length[link[state]] >= window:
                state = link[state]
            matched = window  # only the last words count, so longer matches need not be told apart
            if first[state] < doc:
                if found and i + 1 - window <= found[-1][1]:
                    found[-1][1] = i + 1
                else:
                    found.append([i + 1 - window, i + 1])
        return found


def _streamed(seats: DataFrame, window: int) -> DataFrame:
    """(doc, td, first, end): spans of the guests' texts. Rows of a shard's turn come in order, the reference first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seat, automaton, ready, last = None, None, False, None
        for batch in batches:
            out = []
            for shard, turn, guest, doc, td, at, text in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if (shard, turn, guest, doc, td, at) == last:
                    continue  # a repeated row of the table
                last = (shard, turn, guest, doc, td, at)
                if (shard, turn) != seat:
                    seat, automaton, ready = (shard, turn), SuffixAutomaton(), False
                if not guest:
                    automaton.add(text.split(), doc)
                    continue
                if not ready:
                    automaton.finish()
                    ready = True
                out += [(doc, td, at + first, at + end) for first, end in automaton.spans(text.split(), doc, window)]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                                              pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())],
                                             names=["doc", "td", "first", "end"])
    return seats.mapInArrow(run, "doc long, td long, first int, end int")


def repeated_spans(docs: DataFrame, window: int = 50, gram: int = 8) -> DataFrame:
    """(doc, td, first, end): spans of words of ``docs`` (doc, td, text) that are covered by repeated windows."""
    regions, _ = keep(_regions(docs, window, gram), "regions")
    grams = regions.groupBy("a").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("g").alias("g0"),
                                     F.max("g").alias("g1")).where("low < high")
    grams, _ = keep(grams.select("a", (F.col("g0") == F.col("g1")).alias("uniform")), "shared-grams")
    shared, _ = keep(regions.join(grams, "a"), "shared-regions")
    kinds, _ = keep(shared.groupBy("a", "g", "n", "uniform").agg(
        F.min(F.struct("doc", "td", "start")).alias("low"), F.max("doc").alias("high")), "distinct-regions")

    opened, _ = keep(_opened(docs, kinds.where("not uniform").select("low.*", "n", "a", "g", "high"), window), "windows")
    owners, _ = keep(opened.groupBy("w1", "w2").agg(F.min(F.struct("doc", "td", "pos")).alias("own"), F.max("high").alias("last"))
                     .where("own.doc < last").select("w1", "w2", "own"), "owned-windows")
    piece = F.floor(F.col("own.pos") / PIECE).cast("int")
    mixed = opened.join(owners, ["w1", "w2"]).groupBy("a", "g").agg(
        F.collect_set(F.struct("own.doc", "own.td", piece.alias("piece"))).alias("pieces"))
    alone = kinds.where("uniform")
    parts = F.sequence(F.floor(F.col("low.start") / PIECE).cast("int"), F.floor((F.col("low.start") + F.col("n") - 1) / PIECE).cast("int"))
    plain = alone.select("a", "g", F.transform(parts, lambda p: F.struct("low.doc", "low.td", p.alias("piece"))).alias("pieces"))

    # The reference: windows in the first document that has them, by piece of that document.
    first, end = F.col("low.start"), F.col("low.start") + F.col("n")
    cut = alone.select("low.doc", "low.td", F.explode(parts).alias("piece"), first.alias("f"), end.alias("e")).select(
        "doc", "td", "piece", F.greatest("f", F.col("piece") * PIECE).alias("first"), F.least("e", (F.col("piece") + 1) * PIECE).alias("end"))
    single = owners.select("own.doc", "own.td", piece.alias("piece"), F.col("own.pos").alias("first"), (F.col("own.pos") + 1).alias("end"))
    reference, _ = keep(cut.union(single).distinct(), "reference")
    held = reference.agg(F.sum(F.col("end") - F.col("first"))).first()[0] or 0
    shards = max(1, -(-held // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("p.doc", "p.td", "p.piece"), F.lit(shards)).cast("int").alias("shard")
    hosts = reference.select("doc", "td", F.struct("doc", "td", "piece").alias("p"), "first", "end").select(
        *_ROW, shard, F.lit(0).alias("guest"), "first", "end")
    routes = plain.union(mixed).withColumnRenamed("pieces", "ps")
    guests = (shared.join(routes, ["a", "g"]).select("doc", "td", "start", "n", F.explode("ps").alias("p")).where("p.doc < doc")
              .select(*_ROW, shard, F.lit(1).alias("guest"), F.col("start").alias("first"), (F.col("start") + F.col("n")).alias("end")))
    texts, _ = keep(_texts(docs, hosts.union(guests), window), "passages")

    turns, _ = keep(texts.where("guest = 1").groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / TURN).cast("int").alias("turns")), "turns")
    turn = F.when(F.col("guest") == 1, F.array(F.pmod(F.xxhash64("doc", "td", "at"), "turns").cast("int"))).otherwise(
        F.sequence(F.lit(0), F.col("turns") - 1))
    seats = texts.join(small_table(turns), "shard").select("shard", F.explode(turn).alias("turn"), "guest", "doc", "td", "at", "words")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _streamed(seats.repartition(n, "shard", "turn").sortWithinPartitions("shard", "turn", "guest", "doc", "td", "at"), window)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 8) -> DataFrame:
    """``docs`` with the words of repeated windows taken out, and n_words, n_removed and ``removed``, the spans of words.

    Words are runs without ASCII white space; the kept ones are joined by one space. A null text stays null and has no
    words. Rows that share an id are one document: they repeat nothing of each other, each row is judged for itself. A row
    with a null id stays whole and nothing repeats it. Windows are judged on the texts as given, so a passage stays in its
    first document and goes in all others. Other columns pass through; columns with the names of the new ones are replaced.
    """
    added = ["n_words", "n_removed", "removed"]
    columns = [c for c in docs.columns if c not in added]
    rest = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in columns if c != text_col)).alias("rest")
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(text).alias("td"), text, rest)
    judged = F.col("doc").isNotNull() & F.col("text").isNotNull()
    # Texts are dealt out once; whatever is asked of them later comes to where they are.
    held = keep_bucketed(rows.where(judged), _ROW, "texts")
    spans = repeated_spans(held.select(*_ROW, "text"), window, gram)
    lists, _ = keep(spans.groupBy(*_ROW).agg(F.array_sort(F.collect_set(F.struct("first", "end"))).alias("spans")), "removed-spans")
    none = F.lit(None).cast("array<struct<first:int,end:int>>").alias("spans")
    joined = held.join(lists, _ROW, "left").select("rest", "text", "spans").union(rows.where(~judged).select("rest", "text", none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                kept, counts, gone, cut = [], [], [], []
                for value, ranges in zip(part.column(1), part.column(2), strict=True):
                    text = value.as_py()
                    own = (text or "").encode().split()
                    merged: list[list[int]] = []
                    for r in ranges.as_py() or ():
                        if merged and r["first"] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], r["end"])
                        else:
                            merged.append([r["first"], r["end"]])
                    left, place = [], 0
                    for first, end in merged:
                        left += own[place:first]
                        place = end
                    left += own[place:]
                    kept.append(None if text is None else b" ".join(left).decode())
                    counts.append(len(own))
                    gone.append(len(own) - len(left))
                    cut.append([{"first": f, "end": e} for f, e in merged])
                kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(cut, kind)], names=["rest", "text", *added])
    schema = joined.select("rest", "text", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"),
                           F.array().cast("array<struct<first:int,end:int>>").alias("removed")).schema
    done = joined.mapInArrow(run, schema)
    return done.select(*(F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in columns), *added)


def oracle_sql(window: int = 50) -> str:
    """The same for DuckDB: every window by its digest."""
    word = "[^\\x20\\x09-\\x0D]+"
    return f"""
WITH texts AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{word}') AS words FROM documents),
windows AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(words[i:i + {window - 1}], ' ')) AS key
  FROM texts, unnest(range(1, len(words) - {window - 2})) AS t(i)),
earliest AS (SELECT key, min(doc_id) AS low FROM windows GROUP BY key),
gone AS MATERIALIZED (
  SELECT DISTINCT doc_id, i + j AS at_word FROM windows JOIN earliest USING (key), range({window}) AS r(j) WHERE low < doc_id),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS at_word FROM texts),
kept AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.at_word) AS rest, count(*) AS n
  FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.at_word = p.at_word WHERE g.doc_id IS NULL GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)"""
