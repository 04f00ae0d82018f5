"""Against the reference encoder of the model's library, a plain Viterbi for unigram scores, and round trips."""

import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from gatelake.llm import sentence_pieces, words


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)


def test_same_ids_as_the_library(spark, library):
    rng = random.Random(5)
    signs = "abcdefghtheing ▁.,()  \n\tABé漢😀0123"
    texts = ["", " ", "a", "  lead", "trail ", "Hello  world, this is 1 test.", "x" * 2000, "\x00", "日本語 naïve", "ﬁ Ⅳ"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: r for r in sentence_pieces.encode(docs).collect()}
    assert all(found[i].token_ids == library.encode(t) for i, t in enumerate(texts))
    assert all(found[i].round_trip == ("▁" not in t) and found[i].n_tokens == len(found[i].token_ids) for i, t in enumerate(texts))
    back = {r.doc_id: r.text for r in sentence_pieces.decode(spark.createDataFrame(
        [(i, found[i].token_ids) for i in found], "doc_id long, token_ids array<int>")).collect()}
    assert all(back[i] == t.replace("▁", " ") for i, t in enumerate(texts))


def test_unigram_scores_take_the_best_sum():
    pieces = sentence_pieces.load(sentence_pieces.MODEL)
    rng = np.random.default_rng(2)
    pieces.bpe = False
    pieces.score = -rng.integers(1, 1000, len(pieces.score)) / 7.0
    text = "thnttionwh"
    codes = np.array([[ord(c) for c in text]], np.int64)
    encoder = sentence_pieces.Encoder(pieces)
    segment, end, piece = encoder._search(codes)
    total = sum(pieces.score[p] for p in piece)
    up = {int(k): int(p) for k, p in zip(pieces.keys, pieces.key_piece, strict=True)}
    best = [0.0] + [-np.inf] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - pieces.longest), e):
            h = np.array([sentence_pieces._code_hash(codes[0, s:e])], np.uint64)
            key = int(words.mix(h + np.uint64((e - s) * int(words._STEP) % (1 << 64)))[0])
            if key in up:
                best[e] = max(best[e], best[s] + pieces.score[up[key]])
    assert np.isclose(total, best[-1]) and sorted(end)[-1] == len(text)


def test_forgetting_and_blocks_change_nothing(library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "_REMEMBERED", 10)
    encoder = sentence_pieces.Encoder(sentence_pieces.load(sentence_pieces.MODEL))
    texts = [f"some text number {i} with words w{i * i}" for i in range(60)]
    out = []
    for first, end, data, offsets in words.text_blocks(pa.array(texts), 300):
        ids, cuts = encoder.encode(*sentence_pieces._prefixed(data, offsets))
        out += [ids[cuts[i]:cuts[i + 1]].tolist() for i in range(end - first)]
    assert out == library.encode(texts)


def test_odd_rows(spark, odd_docs, library):
    rows = sentence_pieces.encode(odd_docs).collect()
    assert sorted((r.doc_id or -1, tuple(r.token_ids)) for r in rows) == sorted(
        (r.doc_id or -1, tuple(library.encode(r.text or ""))) for r in odd_docs.collect())
    assert all(r.round_trip for r in rows)
    assert sentence_pieces.encode(odd_docs.limit(0)).count() == 0
    lists = spark.createDataFrame([(1, None), (2, []), (3, [1, 2]), (None, [None, 306])], "doc_id long, token_ids array<int>")
    assert {(r.doc_id, r.text) for r in sentence_pieces.decode(lists).collect()} == {
        (1, ""), (2, ""), (3, ""), (None, "⁇ " + library.id_to_piece(306).replace("▁", " "))}


def test_long_texts_without_blanks(library):
    rng = random.Random(9)
    encoder = sentence_pieces.Encoder(sentence_pieces.load(sentence_pieces.MODEL))
    for signs in (range(0x4E00, 0x9FA0), range(ord("a"), ord("z") + 1), (0x61,), (0x3042, 0x7684, 0x61, 0x1F600)):
        text = " " + "".join(chr(rng.choice(signs)) for _ in range(8000))
        data = np.frombuffer(text.encode(), np.uint8)
        ids, cuts = encoder.encode(data, np.array([0, len(data)]))
        assert ids.tolist() == library.encode(text[1:]) and cuts.tolist() == [0, len(ids)]


def test_cuts_of_unseen_neighbours():
    pieces = sentence_pieces.load(sentence_pieces.MODEL)
    encoder = sentence_pieces.Encoder(pieces)
    data = np.frombuffer("the 漢漢漢".encode(), np.uint8)
    cuts = np.flatnonzero(encoder._cuts(data)).tolist()
    assert 0 in cuts and 3 in cuts and not {1, 2} & set(cuts) and {7, 10} <= set(cuts)
