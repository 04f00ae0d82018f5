"""Links against all pairs of a small corpus."""

import random
import re

from gatelake.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def shingles(text, k=5):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows):
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    sets = [(i, shingles(t)) for i, t in rows]
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if s and t and 100 * both >= 75 * (len(s) + len(t) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for i, s in sets)


def corpus(seed, size):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice((1, 3, 5, 6, 30, 80, 200)))] for _ in range(12)]
    rows = []
    for i in range(size):
        words = list(rng.choice(bases)) if i % 3 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i * 7 % 1009, rng.choice((" ", "\n", "  ")).join(words)))
    return rows


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_equals_all_pairs(spark):
    rows = corpus(3, 240)
    found = result(ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert found == brute(rows)
    assert len({c for _, _, c in found}) < 200


def test_turns_only_save_work(spark):
    rows = corpus(5, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(ngram_join.join_documents(docs, hub_orders=(1,))) == brute(rows)


def test_large_components_are_compared_as_a_whole(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CROWD", 2)
    monkeypatch.setattr(ngram_join, "VISITORS", 3)
    monkeypatch.setattr(ngram_join, "CELL_SHINGLES", 150)
    rng = random.Random(8)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    found = result(ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hub_orders=(1,)))
    assert found == brute(rows)
    assert 1 < len({c for _, _, c in found}) < 120


def test_odd_rows(spark, odd_docs):
    found = ngram_join.join_documents(odd_docs).collect()
    assert len(found) == odd_docs.count()
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[2].component_id == 1 and by_id[9].component_id == 8 and by_id[7].component_id == 6
    assert [by_id[i].n_shingles for i in (3, 4, 5)] == [0, 0, 0] and by_id[4].component_id == 4
    assert all(r.component_id is None for r in found if r.doc_id is None)
    assert ngram_join.join_documents(odd_docs.limit(0)).count() == 0


def test_texts_of_one_id_keep_their_own_postings(spark):
    rng = random.Random(12)

    def some(n):
        return [f"w{rng.randrange(1_000_000)}" for _ in range(n)]
    common = some(110)
    rows = [(10_000 + i, " ".join(common + some(60))) for i in range(12)]
    for i in range(24):
        text = some(104)
        near = text[:50] + some(1) + text[51:]
        both = [(2 * i, " ".join(text)), (2 * i, " ".join(text + common))]
        rows += both[::1 if i % 2 else -1] + [(2 * i + 1, " ".join(near))]
    found = ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    component = {r.doc_id: r.component_id for r in found}
    assert all(component[2 * i + 1] == component[2 * i] == 2 * i for i in range(24))


def test_texts_of_one_id_with_equally_many_shingles_are_told_apart(spark):
    words = [f"w{i}" for i in range(40)]
    other = [f"v{i}" for i in range(40)]
    near = words[:37] + ["x", "y", "z"]
    rows = [(1, " ".join(words)), (1, " ".join(other)), (2, " ".join(near)), (3, " ".join(other[:38] + ["x", "y"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.join_documents(df).collect()} == {1: 1, 2: 1, 3: 1}
