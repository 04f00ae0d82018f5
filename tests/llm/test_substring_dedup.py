"""Removed windows against a plain list of all windows, and the automaton against plain search."""

import hashlib
import random

import pytest

from gatelake.llm import substring_dedup as sd
from tests.llm.conftest import LONG


def brute(rows, window):
    """Sorted (doc, number of words, removed words, kept words)."""
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, own in split:
        for i in range(len(own) - window + 1) if d is not None else ():
            key = tuple(own[i:i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, own in split:
        gone = set()
        for i in range(len(own) - window + 1) if d is not None else ():
            if first[tuple(own[i:i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(own), len(gone), b" ".join(w for i, w in enumerate(own) if i not in gone).decode()))
    return sorted(out, key=repr)


def result(df, **how):
    rows = sd.remove_repeats(df, **how).collect()
    for r in rows:
        assert sum(s["end"] - s["first"] for s in r.removed) == r.n_removed
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text or "") for r in rows), key=repr)


def test_automaton_finds_what_plain_search_finds():
    dice = random.Random(3)
    for _ in range(60):
        held = [(dice.randrange(9), [dice.choice("ab") for _ in range(dice.randrange(1, 25))]) for _ in range(dice.randrange(1, 6))]
        automaton = sd.SuffixAutomaton()
        for doc, sequence in held:
            automaton.add(sequence, doc)
        automaton.finish()
        text, doc, window = [dice.choice("abc") for _ in range(40)], dice.randrange(9), dice.randrange(1, 7)
        gone = set()
        for i in range(len(text) - window + 1):
            if any(d < doc and s[j:j + window] == text[i:i + window] for d, s in held for j in range(len(s))):
                gone.update(range(i, i + window))
        assert {p for a, b in automaton.spans(text, doc, window) for p in range(a, b)} == gone


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, seed, monkeypatch):
    """Short windows over few words, so that passages overlap, repeat inside a document and share their edges."""
    for name, small in (("PIECE", 16), ("SHARD_WORDS", 64), ("TURN", 4)):
        monkeypatch.setattr(sd, name, small)
    dice = random.Random(seed)
    passages = [[dice.choice("abcdefgh") for _ in range(dice.randrange(6, 40))] for _ in range(8)]
    rows = []
    for d in range(90):
        own = []
        for _ in range(dice.randrange(0, 5)):
            own += dice.choice(passages) if dice.random() < 0.6 else [f"{d}x{dice.randrange(99)}" for _ in range(dice.randrange(12))]
        rows.append((d, dice.choice([" ", "\n", "\t "]).join(own)))
    dice.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(df, window=8, gram=3) == brute(rows, 8)


def test_production_parameters(spark):
    dice = random.Random(8)

    def fresh(n):
        return [f"w{dice.randrange(10**6)}" for _ in range(n)]
    exact, longer = fresh(50), fresh(400)
    rows = [(5, fresh(30) + exact + fresh(5)), (1, exact + fresh(20)), (9, exact[:-1] + fresh(70)), (7, longer), (3, longer[100:260] + fresh(9)),
            (4, fresh(60) + longer[150:300]), (8, longer), (8, longer + fresh(50)), (12, exact + exact + fresh(1) + exact)]
    rows = [(d, " ".join(own)) for d, own in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(df) == brute(rows, 50)
    gone = {(r[0], r[1]): r[2] for r in result(df)}
    assert gone[9, 119] == 0 and gone[12, 151] == 150


def test_odd_rows(spark, odd_docs):
    assert result(odd_docs) == brute([(r.doc_id, r.text) for r in odd_docs.collect()], 50)
    cut = sd.remove_repeats(odd_docs)
    assert cut.columns == [*odd_docs.columns, "n_words", "n_removed", "removed"]
    second = cut.where("doc_id = 2").first()
    assert second.text == "" and second.n_removed == len(LONG.split())
    assert cut.where("doc_id = 3").first().text is None
    assert result(odd_docs.limit(0)) == []
    assert hashlib.sha256(b"").hexdigest() == cut.selectExpr("sha2(coalesce(text, ''), 256) h").where("h like 'e3b0%'").first().h
