"""Matches against every window of every document."""

import random
from collections import Counter

from pyspark.sql import functions as F

from gatelake.llm import decontaminate


def shingles(words, k=5):
    return Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else Counter([tuple(words)])


def brute(docs, items):
    out = {}
    for d, text in docs:
        words = text.lower().split()
        for i, item in items:
            b = shingles(item.lower().split())
            size = len(item.split())
            for start in range(max(1, len(words) - size + 1)):
                a = shingles(words[start:start + size])
                common = sum((a & b).values())
                union = sum((a | b).values())
                if words and 4 * common >= 3 * union and common / union > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (common / union, start)
    return out


def test_equals_every_window(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.choice((3, 7, 20, 45, 60)))) for i in range(20)]
    docs = []
    for d in range(80):
        words = text(rng.randint(1, 150))
        item = list(items[d % 20][1])
        for _ in range(d % 4):
            item[rng.randrange(len(item))] = rng.choice(vocabulary)
        at = rng.randrange(len(words))
        docs.append((d, " ".join(words[:at] + item[:len(item) - d % 3] + words[at:]) if d % 5 else " ".join(item)))
    items = [(i, " ".join(w)) for i, w in items]
    found = decontaminate.find_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                                        spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in found.collect()}
    expected = brute(docs, items)
    assert got == expected and len(got) > 15
    assert any(v[0] < 1 for v in got.values())


def test_case_and_punctuation_do_not_hide_a_passage(spark):
    item = " ".join(f"word{i}" for i in range(30))
    hidden = "Start here. " + item.upper().replace(" ", ",***\n") + "!! and more"
    docs = spark.createDataFrame([(1, hidden), (2, "nothing of it here at all, not even a bit")], "doc_id long, text string")
    found = decontaminate.find_passages(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.start_word, r.similarity) for r in found] == [(1, 5, 2, 1.0)]


def test_odd_rows(spark, odd_docs):
    bench = odd_docs.select(F.col("doc_id").alias("item_id"), "text", "n", "pos").where("doc_id in (1, 3, 4, 8) or doc_id is null")
    found = decontaminate.find_passages(odd_docs, bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    assert {(1, 1), (2, 1), (8, 8), (9, 8), (None, 8), (8, None)} <= pairs and not {3, 4, 5} & {d for d, _ in pairs}
    assert decontaminate.find_passages(odd_docs.limit(0), bench).count() == 0
    assert decontaminate.find_passages(odd_docs, bench.limit(0)).count() == 0


def test_different_items_of_one_id_each_match(spark):
    rng = random.Random(11)
    texts = [[" ".join(f"w{rng.randrange(10_000)}" for _ in range(12)) for _ in range(2)] for _ in range(20)]
    ids = [i if i < 15 else None for i in range(20)]
    items = [(ids[i], text) for i, both in enumerate(texts) for text in both]
    docs = [(100 * j + i, "before " + both[j] + " after") for i, both in enumerate(texts) for j in range(2)]
    found = decontaminate.find_passages(spark.createDataFrame(docs, "doc_id long, text string"),
                                        spark.createDataFrame(items, "item_id long, text string"), radius=127).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(doc, ids[doc % 100]) for doc, _ in docs}
