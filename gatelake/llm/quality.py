"""Document quality by a generalised additive model with pairwise interactions.

Each feature is cut into bins; its contribution is a lookup table that shallow trees learn in turn, one feature after
the other, a small step each round (cyclic boosting). Pairs of features with the largest rest of structure get tables
over two binned features in the same way. A score is a sum of table entries, so scoring is vectorised additions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.llm import words
from gatelake.llm.common import small_batches

FEATURES = (
    "log_bytes", "log_words", "bytes_per_word", "upper", "digits", "sentence_marks", "exclamations", "pipes", "symbols",
    "other_marks", "non_ascii", "line_breaks", "bytes_per_line", "words_with_mark_at_end", "words_with_symbol_at_end",
    "words_in_capitals_first", "short_words", "long_words", "longest_word", "distinct_words", "distinct_lines",
    "most_frequent_word",
)


def _byte_classes() -> np.ndarray:
    groups = [bytes(range(65, 91)), bytes(range(48, 58)), b".?,;:", b"!", b"|", b"#$%&*~^@<>{}[]\\=+", b"\"'()-_/`",
              bytes(range(128, 256)), b"\n"]
    table = np.zeros((256, len(groups)))
    for i, group in enumerate(groups):
        table[list(group), i] = 1
    return table


_CLASSES = _byte_classes()
_MARKS = np.zeros(256, bool)
_MARKS[list(b".?,;:!")] = True
_SYMBOLS = _CLASSES[:, 5].astype(bool) | _CLASSES[:, 4].astype(bool)
_UPPER = _CLASSES[:, 0].astype(bool)


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; an empty or null text has zeros only."""
    out = np.zeros((len(column), len(FEATURES)))
    for first, end, data, offsets in words.text_blocks(column):
        starts, ends = words.word_bounds(data, offsets, words.SPACES)
        hashes = words.span_hashes(data, starts, ends)
        cuts = np.searchsorted(starts, offsets)
        breaks = np.flatnonzero(data == 10)
        line_cuts = np.searchsorted(breaks, offsets)
        length = ends - starts
        flags = np.stack([_MARKS[data[ends - 1]], _SYMBOLS[data[ends - 1]], _UPPER[data[starts]], length <= 3, length >= 15],
                         axis=1) if len(starts) else np.zeros((0, 5), bool)
        for i in range(end - first):
            lo, hi, a, b = offsets[i], offsets[i + 1], cuts[i], cuts[i + 1]
            size, n = int(hi - lo), int(b - a)
            if not size:
                continue
            part = data[lo:hi]
            share = (np.bincount(part, minlength=256) @ _CLASSES) / size
            own = np.sort(hashes[a:b])
            runs = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True]))) if n else np.zeros(1, int)
            inner = breaks[line_cuts[i]:line_cuts[i + 1]]
            edges = np.concatenate(([lo - 1], inner, [hi]))
            line_start, line_end = edges[:-1] + 1, edges[1:]
            lines = len(np.unique(words.span_hashes(data, line_start, line_end)))
            m = max(n, 1)
            out[first + i] = (
                np.log1p(size), np.log1p(n), size / m, *share[:8], share[8] * size / m, np.log1p(size / len(line_start)),
                *(flags[a:b].sum(axis=0) / m), np.log1p(length[a:b].max() if n else 0), (len(runs) - 1) / m,
                lines / len(line_start), (np.diff(runs).max() / n) if n else 0.0)
    return out


@dataclass
class AdditiveModel:
    """Bin edges and tables; pairs are (i, j, table) over the coarse bins of features i and j."""

    intercept: float = 0.0
    edges: list = field(default_factory=list)
    coarse: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], "right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and position of the best cut of consecutive bins in two."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g ** 2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g ** 2 / (all_h + ridge)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Newton steps of a tree with up to three leaves over the bins."""
    _, cut = _best_cut(g, h, ridge)
    parts = [slice(0, cut), slice(cut, len(g))] if cut else [slice(0, len(g))]
    options = [(_best_cut(g[p], h[p], ridge), i) for i, p in enumerate(parts)]
    (gain, second), i = max(options)
    if gain > 0:
        p = parts[i]
        parts[i:i + 1] = [slice(p.start, p.start + second), slice(p.start + second, p.stop)]
    step = np.zeros(len(g))
    for p in parts:
        step[p] = g[p].sum() / (h[p].sum() + ridge)
    return step


def _four_leaves(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and steps of the best tree that cuts both features of a pair once."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, step = 0.0, np.zeros_like(g)
    if min(g.shape) < 2:
        return best, step
    quads = []
    for s in (gs, hs):
        a = s[:-1, :-1]
        quads.append((a, s[:-1, -1:] - a, s[-1:, :-1] - a, s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + a))
    gain = sum(x ** 2 / (y + ridge) for x, y in zip(*quads, strict=True))
    r, c = np.unravel_index(int(np.argmax(gain)), gain.shape)
    best = float(gain[r, c] - gs[-1, -1] ** 2 / (hs[-1, -1] + ridge))
    value = [x[r, c] / (y[r, c] + ridge) for x, y in zip(*quads, strict=True)]
    step[:r + 1, :c + 1], step[:r + 1, c + 1:], step[r + 1:, :c + 1], step[r + 1:, c + 1:] = value
    return best, step


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 48, coarse_bins: int = 12,
        n_pairs: int = 8, pair_rounds: int = 60, ridge: float = 5.0) -> AdditiveModel:
    """Fit on a feature matrix and labels in [0, 1]. Without rows the score is one half; of one class only, its rate."""
    model = AdditiveModel()
    if not len(y):
        return model
    mean = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(mean / (1 - mean)))
    model.edges = [_cuts(x[:, f], bins) for f in range(x.shape[1])]
    model.coarse = [_cuts(x[:, f], coarse_bins) for f in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    fine = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    total = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-total))
            step = rate * _shallow_tree(np.bincount(fine[f], y - p, len(table)), np.bincount(fine[f], p * (1 - p), len(table)),
                                        ridge)
            table += step
            total += step[fine[f]]
    rough = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.coarse)]
    width = [len(e) + 1 for e in model.coarse]

    def rest(i, j):
        p = 1 / (1 + np.exp(-total))
        cell, shape = rough[i] * width[j] + rough[j], (width[i], width[j])
        g, h = (np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p)))
        return _four_leaves(g, h, ridge)
    gains = sorted(((rest(i, j)[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((width[i], width[j]))) for gain, i, j in gains[:n_pairs] if gain > 0]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            step = rate * rest(i, j)[1]
            table += step
            total += step[rough[i], rough[j]]
    return model


def _with_features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(
                    pa.list_(pa.float64()))], names=["doc", "x"])
    return small_batches(docs).mapInArrow(run, "doc long, x array<double>")


def held_out(id_col: str) -> F.Column:
    """True for the fifth of the ids that no label is learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_rows: int = 20_000) -> AdditiveModel:
    """Learn from at most ``max_rows`` labelled ids (the smallest hashes of those not held out).

    Null labels and labels without a document are left out; an id with several labels counts with their mean, an id with
    several texts with one of them, chosen by hash. Only the feature matrix of at most ``max_rows`` rows reaches the driver.
    """
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
             .groupBy(F.col(id_col).cast("long").alias("doc")).agg(F.avg(label_col).alias("y")))
    chosen = known.orderBy(F.xxhash64("doc"), "doc").limit(max_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    one_each = _with_features(texts.join(F.broadcast(chosen.select("doc")), "doc", "left_semi")).groupBy("doc").agg(
        F.min_by("x", F.xxhash64("x")).alias("x"))
    rows = one_each.join(F.broadcast(chosen), "doc").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    y = rows["y"].to_numpy(float)
    order = np.lexsort((*x.T, y, rows["doc"].to_numpy()))
    return fit(x[order], y[order])


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; a null text scores as an empty one, a null id stays null.

    Other columns are ignored and repeated rows each get their row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = shared.value.score(features(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "score"])
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return small_batches(texts).mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
