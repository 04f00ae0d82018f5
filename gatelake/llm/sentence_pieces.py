"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text is cut between two characters that are neighbours in no piece: before every run of spaces, and often in scripts without
spaces; no piece reaches over such a cut. Hashes of all substrings of segments of equal length probe the sorted keys of
the pieces at once. Then the distinct segments advance together, one end position at a time, and the best admissible
candidate of every segment is stored with its start as backpointer.

For a unigram model every piece is admissible after every other and the largest sum of scores wins. In a BPE model the
scores only order the merges, so the largest sum is not its segmentation. There a piece is admissible after the piece
that ends where it starts if merging would leave exactly these two of their text; adjacent pairs decide the whole, so
one candidate is admissible at every position and the search returns what merging returns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.llm import words
from gatelake.llm.common import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_BYTES = 1 << 20
_SPACE = "▁"
_UNKNOWN = -2
_FAR = np.int32(1 << 30)
_MEMO = 1 << 20
#: Segments whose pieces a worker remembers; beyond that it starts anew.
_REMEMBERED = 400_000


@dataclass
class Pieces:
    """A model as arrays. Searchable pieces are numbered 0..m-1; ``ids`` has their ids in the model."""

    bpe: bool
    keys: np.ndarray
    key_piece: np.ndarray
    ids: np.ndarray
    score: np.ndarray
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pair_keys: np.ndarray
    pair_rank: np.ndarray
    longest: int
    byte_ids: np.ndarray
    unknown_id: int
    byte_fallback: bool
    beside: np.ndarray
    out_bytes: np.ndarray
    out_offsets: np.ndarray
    dummy_prefix: bool


def _code_hash(codes: np.ndarray) -> int:
    total, power = 0, 1
    for c in codes.tolist():
        total = (total + (c + 1) * power) % (1 << 64)
        power = power * int(words._BASE) % (1 << 64)
    return total


def _spoilt(rank, left, right, combined, a: int, b: int, limit: int) -> bool:
    """Whether merging would join something across the border of pieces a and b before rank ``limit``."""
    while True:
        if combined.get((a, b), _FAR) < limit:
            return True
        if rank[a] > rank[b]:
            limit, a = rank[a], right[a]
        elif rank[b] < 0:
            return False
        else:
            limit, b = rank[b] + 1, left[b]


def load(model_path: str) -> Pieces:
    """Read a model file (driver side) and derive the merge tables of a BPE model."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(model_path, "rb") as f:
        model.ParseFromString(f.read())
    norm, train = model.normalizer_spec, model.trainer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("only models with the identity normalisation are supported")
    if train.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")
    bpe = train.model_type == 2
    kinds = {"normal": 1, "unknown": 2, "user": 4, "byte": 6}
    entries = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type in (kinds["normal"], kinds["user"])]
    if any(_SPACE in text.lstrip(_SPACE) for _, text, _ in entries):
        raise ValueError("pieces that reach over a space are not supported")
    number = {text: n for n, (_, text, _) in enumerate(entries)}
    by_score = sorted(range(len(entries)), key=lambda n: -entries[n][2])
    rank, left, right, combined, reachable = [-1] * len(entries), list(range(len(entries))), list(range(len(entries))), {}, set()
    for order, n in enumerate(by_score):
        text = entries[n][1]
        if len(text) == 1 or not bpe:
            reachable.add(n)
    if bpe:
        for order, n in enumerate(by_score):
            text = entries[n][1]
            if len(text) == 1:
                continue
            halves = [(number[text[:i]], number[text[i:]]) for i in range(1, len(text))
                      if text[:i] in number and text[i:] in number]
            halves = [h for h in halves if h[0] in reachable and h[1] in reachable]
            for a, b in halves:
                if not _spoilt(rank, left, right, combined, a, b, order):
                    rank[n], left[n], right[n] = order, a, b
                    reachable.add(n)
                    break
            if n in reachable:
                for h in halves:
                    combined[h] = order
    # A pair found before one of its halves was reachable is added now.
    for n in reachable if bpe else ():
        text = entries[n][1]
        for i in range(1, len(text)):
            h = (number.get(text[:i]), number.get(text[i:]))
            if h[0] in reachable and h[1] in reachable:
                combined[h] = rank[n]
    codes = [np.array([ord(c) for c in text], np.int64) for _, text, _ in entries]
    found = np.array(sorted(reachable), np.int64)
    keys = words.mix(np.array([_code_hash(codes[n]) for n in found], np.uint64) + np.array(
        [len(codes[n]) for n in found], np.uint64) * words._STEP)
    sorting = np.argsort(keys)
    pairs = sorted(((a << 20) | b, r) for (a, b), r in combined.items())
    byte_ids = np.full(256, -1, np.int32)
    spelled: list[bytes] = []
    for i, p in enumerate(model.pieces):
        if p.type == kinds["byte"]:
            value = int(p.piece[3:5], 16)
            byte_ids[value] = i
            spelled.append(bytes([value]))
        elif p.type == kinds["unknown"]:
            spelled.append(train.unk_surface.encode())
        elif p.type in (kinds["normal"], kinds["user"]):
            spelled.append(p.piece.replace(_SPACE, " ").encode())
        else:
            spelled.append(b"")
    beside = {(ord(a) << 21) | ord(b) for _, text, _ in entries for a, b in zip(text, text[1:])}
    return Pieces(
        bpe=bpe, keys=keys[sorting], key_piece=found[sorting].astype(np.int32),
        ids=np.array([i for i, _, _ in entries], np.int32), score=np.array([s for _, _, s in entries]),
        rank=np.array(rank, np.int32), left=np.array(left, np.int32), right=np.array(right, np.int32),
        pair_keys=np.array([k for k, _ in pairs], np.int64), pair_rank=np.array([r for _, r in pairs], np.int32),
        longest=max(map(len, codes), default=1), byte_ids=byte_ids,
        unknown_id=next((i for i, p in enumerate(model.pieces) if p.type == kinds["unknown"]), 0),
        byte_fallback=bool(train.byte_fallback), beside=np.array(sorted(beside), np.int64),
        out_bytes=np.frombuffer(b"".join(spelled), np.uint8),
        out_offsets=np.concatenate(([0], np.cumsum([len(s) for s in spelled]))).astype(np.int64),
        dummy_prefix=bool(norm.add_dummy_prefix))


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated slices of a flat array."""
    total = np.concatenate(([0], np.cumsum(lengths)))
    return flat[np.repeat(starts - total[:-1], lengths) + np.arange(total[-1])]


class Encoder:
    """Encodes blocks of texts; remembers the pieces of the segments it has met."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.known = np.zeros(0, np.uint64)
        self.where = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.store = np.zeros(0, np.int32)
        self.memo_key = np.full(_MEMO, -1, np.int64)
        self.memo_value = np.zeros(_MEMO, bool)
        self.ascii_beside = np.zeros(1 << 14, bool)
        before, after = pieces.beside >> 21, pieces.beside & 0x1FFFFF
        plain = (before < 128) & (after < 128)
        self.ascii_beside[(before[plain] << 7) | after[plain]] = True
        self.gate = np.zeros(1 << 18, bool)
        self.gate[(pieces.keys >> np.uint64(40)).astype(np.int64) & (len(self.gate) - 1)] = True

    def _probe(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """The piece of every substring, or -1."""
        keys = words.mix(hashes + np.uint64(length * int(words._STEP) % (1 << 64)))
        found = np.full(len(keys), -1, np.int32)
        maybe = np.flatnonzero(self.gate[(keys >> np.uint64(40)).astype(np.int64) & (len(self.gate) - 1)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.p.keys, keys[maybe]), len(self.p.keys) - 1)
            found[maybe] = np.where(self.p.keys[at] == keys[maybe], self.p.key_piece[at], -1)
        return found

    def _whole(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves a pair of pieces apart."""
        key = (a.astype(np.int64) << 20) | b
        slot = (words.mix(key.view(np.uint64)) & np.uint64(_MEMO - 1)).astype(np.int64)
        new = np.flatnonzero(self.memo_key[slot] != key)
        out = self.memo_value[slot]
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            value = self._decide((fresh >> 20).astype(np.int32), (fresh & 0xFFFFF).astype(np.int32))
            out[new] = value[back]
            at = (words.mix(fresh.view(np.uint64)) & np.uint64(_MEMO - 1)).astype(np.int64)
            _, chosen = np.unique(at, return_index=True)
            self.memo_key[at[chosen]], self.memo_value[at[chosen]] = fresh[chosen], value[chosen]
        return out

    def _decide(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p = self.p
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), _FAR, np.int64)
        while len(live):
            key = (a.astype(np.int64) << 20) | b
            at = np.minimum(np.searchsorted(p.pair_keys, key), max(len(p.pair_keys) - 1, 0))
            joined = np.where(p.pair_keys[at] == key, p.pair_rank[at], _FAR) if len(p.pair_keys) else np.full(len(a), _FAR)
            spoilt = joined < limit
            out[live[spoilt]] = False
            rank_a, rank_b = p.rank[a], p.rank[b]
            go = ~spoilt & ((rank_a >= 0) | (rank_b >= 0))
            left_first = rank_a > rank_b
            limit = np.where(left_first, rank_a, rank_b.astype(np.int64) + 1)[go]
            a, b = np.where(left_first, p.right[a], a)[go], np.where(left_first, b, p.left[b])[go]
            live = live[go]
        return out

    def _candidates(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Begin, segment and piece of every substring that is a piece (or one character), by end, segment and size.

        Last come the borders between the ends. One probe a size serves all positions of all segments.
        """
        m, length = codes.shape
        up, down = words._power_arrays(length + 1)
        total = np.zeros((length + 1, m), np.uint64)
        np.cumsum(((codes + 1).astype(np.uint64) * up[:length]).T, axis=0, out=total[1:])
        places, pieces = [], []
        for size in range(1, min(self.p.longest, length) + 1):
            piece = self._probe(((total[size:] - total[:-size]) * down[:length - size + 1, None]).ravel(), size)
            if size == 1:
                piece[piece < 0] = _UNKNOWN
            at = np.flatnonzero(piece != -1)
            places.append(((at + (size - 1) * m) << 8) | size)
            pieces.append(piece[at])
        place = np.concatenate(places)
        order = np.argsort(place)
        place = place[order]
        end, segment = np.divmod(place >> 8, m)
        return (end + 1 - (place & 255)), segment, np.concatenate(pieces)[order], np.searchsorted(end, np.arange(length + 1))

    def _search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of segments of equal length: (segment, end position, piece or unknown) along the best paths."""
        p, (m, length) = self.p, codes.shape
        begins, segments, found, cuts = self._candidates(codes)
        last = np.full((length + 1, m), -1, np.int32)
        start = np.zeros((length + 1, m), np.int32)
        best = np.full((length + 1, m), -np.inf)
        best[0] = 0
        floor = (p.score.min() if len(p.score) else 0.0) - 10
        for end in range(1, length + 1):
            some = slice(cuts[end - 1], cuts[end])
            begin, at, own = begins[some], segments[some], found[some]
            value = best[begin, at]
            if p.bpe:
                before = last[begin, at]
                both = np.flatnonzero((own >= 0) & (before >= 0) & (value > -np.inf))
                value[both[~self._whole(before[both], own[both])]] = -np.inf
            else:
                value += np.where(own >= 0, p.score[np.maximum(own, 0)], floor)
            # Candidates stand by segment, shorter pieces first; the first of the largest wins.
            heads = np.flatnonzero(np.diff(at, prepend=-1))
            largest = np.maximum.reduceat(value, heads)
            won = np.flatnonzero((value == np.repeat(largest, np.diff(heads, append=len(at)))) & (value > -np.inf))
            won = won[np.diff(at[won], prepend=-1) != 0]
            best[end, at[won]], last[end, at[won]], start[end, at[won]] = value[won], own[won], begin[won]
        segment, position = np.arange(m), np.full(m, length)
        path: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(segment):
            path.append((segment, position, last[position, segment]))
            position = start[position, segment]
            segment, position = segment[position > 0], position[position > 0]
        return tuple(np.concatenate(x) for x in zip(*path, strict=True))

    def _new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (flat) and their number for every given segment."""
        raw = _gather(data, starts, ends - starts)
        edge = np.concatenate(([0], np.cumsum(ends - starts)))
        lead = (raw & 0xC0) != 0x80
        char_edge = np.concatenate(([0], np.cumsum(lead)))[edge]
        codes = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(codes == 0x20, ord(_SPACE), codes).astype(np.int64)
        length = np.diff(char_edge)
        parts = []
        for size in np.unique(length):
            of = np.flatnonzero(length == size)
            step = max(1, (1 << 18) // int(size + 1))
            for i in range(0, len(of), step):
                some = of[i:i + step]
                block = codes[char_edge[some][:, None] + np.arange(size)]
                segment, end, piece = self._search(block)
                parts.append((some[segment], end, piece, block[segment, end - 1]))
        segment, end, piece, code = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((end, segment))
        segment, piece, code = segment[order], piece[order], code[order]
        ids = np.where(piece >= 0, self.p.ids[np.maximum(piece, 0)], self.p.unknown_id).astype(np.int32)
        per = np.ones(len(ids), np.int64)
        unknown = np.flatnonzero(piece < 0) if self.p.byte_fallback else np.zeros(0, np.int64)
        if len(unknown):
            spelled = [chr(c).encode("utf-8", "surrogatepass") for c in code[unknown].tolist()]
            per[unknown] = [len(s) for s in spelled]
            wide = np.repeat(ids, per)
            at = np.concatenate(([0], np.cumsum(per)))[unknown]
            flat = self.p.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
            wide[np.repeat(at - np.concatenate(([0], np.cumsum(per[unknown])))[:-1], per[unknown]) + np.arange(len(flat))] = flat
            ids = wide
        return ids, np.bincount(segment, per, len(starts)).astype(np.int64)

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        """Whether a byte starts a character that follows the one before it in no piece."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        if len(lead) == len(data):
            codes = data.astype(np.int64)
        else:
            codes = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"),
                                  np.uint32).astype(np.int64)
        codes[codes == 0x20] = ord(_SPACE)
        first = np.zeros(len(data), bool)
        first[lead[0]] = True
        plain = (codes[:-1] < 128) & (codes[1:] < 128)
        cut = ~self.ascii_beside[np.where(plain, (codes[:-1] << 7) | codes[1:], 0)]
        other = np.flatnonzero(~plain)
        pairs = (codes[other] << 21) | codes[other + 1]
        at = np.minimum(np.searchsorted(self.p.beside, pairs), max(len(self.p.beside) - 1, 0))
        cut[other] = self.p.beside[at] != pairs if len(self.p.beside) else True
        first[lead[1:][cut]] = True
        return first

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the row offsets into them. Rows start with the prefix space already."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        first = self._cuts(data)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data))
        hashes, example, back = np.unique(words.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > _REMEMBERED:
            self.known, self.where, self.count = self.known[:0], self.where[:0], self.count[:0]
            self.store = self.store[:0]
        at = np.searchsorted(self.known, hashes)
        missing = np.ones(len(hashes), bool)
        inside = at < len(self.known)
        missing[inside] = self.known[at[inside]] != hashes[inside]
        if missing.any():
            new = example[missing]
            ids, count = self._new(data, starts[new], ends[new])
            where = len(self.store) + np.concatenate(([0], np.cumsum(count)))[:-1]
            self.store = np.concatenate((self.store, ids))
            slot = at[missing]
            self.known = np.insert(self.known, slot, hashes[missing])
            self.where, self.count = np.insert(self.where, slot, where), np.insert(self.count, slot, count)
            at = np.searchsorted(self.known, hashes)
        count = self.count[at][back]
        flat = _gather(self.store, self.where[at][back], count)
        total = np.concatenate(([0], np.cumsum(count)))
        return flat, total[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and row offsets, the prefix space still in front."""
        start, size = self.p.out_offsets[ids], np.diff(self.p.out_offsets)[ids]
        total = np.concatenate(([0], np.cumsum(size)))
        return _gather(self.p.out_bytes, start, size), total[offsets]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder per worker process and model, so what it remembers serves all tasks."""
    value = shared.value
    if id(value) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[id(value)] = Encoder(value)
    return _ENCODERS[id(value)]


def _prefixed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with one space put before each that is not empty."""
    full = np.diff(offsets) > 0
    moved = offsets + np.concatenate(([0], np.cumsum(full)))
    return np.insert(data, offsets[:-1][full], 0x20), moved


def encode(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip) for every row, by whole texts.

    A null or empty text has no tokens. ``round_trip`` says that the decoded ids are the text again, byte for byte; it
    is false only for texts with the model's own space mark or with characters it can't spell. Repeated rows each get
    their row, null ids stay null, other columns are ignored. Segments of any length are encoded.
    """
    pieces = load(model_path)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            marked = pc.fill_null(pc.match_substring(batch.column(1), _SPACE), False).to_numpy(zero_copy_only=False)
            texts = pc.replace_substring(batch.column(1), _SPACE, " ") if marked.any() else batch.column(1)
            for first, end, data, offsets in words.text_blocks(texts, BLOCK_BYTES):
                if encoder.p.dummy_prefix:
                    data, offsets = _prefixed(data, offsets)
                ids, cuts = encoder.encode(data, offsets)
                back, edges = encoder.decode(ids, cuts)
                if np.array_equal(edges, offsets) and np.array_equal(back, data):
                    same = np.ones(end - first, bool)
                else:
                    same = np.array([np.array_equal(back[edges[i]:edges[i + 1]], data[offsets[i]:offsets[i + 1]])
                                     for i in range(end - first)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(np.diff(cuts).astype(np.int32)),
                     pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(ids)), pa.array(same & ~marked[first:end])],
                    names=["doc_id", "n_tokens", "token_ids", "round_trip"])
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return small_batches(texts).mapInArrow(run, "doc_id long, n_tokens int, token_ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(doc_id, text) of rows of ids; null or empty lists give an empty text, control ids give nothing.

    Bytes that form no character come out as the replacement character. A null within a list counts as unknown.
    """
    pieces = load(model_path)
    shared = tokens.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [np.array([pieces_unknown if x is None else x for x in v], np.int64) for v in
                         (x or [] for x in part.column(1).to_pylist())]
                cuts = np.concatenate(([0], np.cumsum([len(v) for v in lists]))).astype(np.int64)
                data, edges = encoder.decode(np.concatenate(lists) if lists else np.zeros(0, np.int64), cuts)
                texts = [data[edges[i]:edges[i + 1]].tobytes() for i in range(len(lists))]
                if encoder.p.dummy_prefix:
                    texts = [t[1:] if t[:1] == b" " else t for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())],
                    names=["doc_id", "text"])
    pieces_unknown = pieces.unknown_id
    rows = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return small_batches(rows).mapInArrow(run, "doc_id long, text string")
