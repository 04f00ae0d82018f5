"""Held-out accuracy, tables, and odd rows."""

import zlib

import numpy as np
import pyarrow as pa

from gatelake.llm import quality
from gatelake.llm.common import read_table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    scores = quality.score(docs, quality.train(docs, labels)).toPandas()
    assert len(scores) == docs.count() and scores.score.between(0, 1).all()
    assert (scores.held_out == scores.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (scores.predicted == (scores.score >= 0.3)).all()
    joined = scores[scores.held_out].merge(labels.toPandas(), on="doc_id")
    assert len(joined) > 50 and (joined.predicted == joined.quality).mean() > 0.97


def test_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95
    assert {(i, j) for i, j, _ in model.pairs} >= {(1, 0)}


def test_score_is_the_sum_of_its_tables():
    rng = np.random.default_rng(1)
    x = rng.random((500, 4))
    model = quality.fit(x, (x[:, 2] > 0.4).astype(float), rounds=20, pair_rounds=5)
    for row in x[:20]:
        total = model.intercept + sum(t[sum(row[f] >= e for e in model.edges[f])] for f, t in enumerate(model.tables))
        total += sum(t[sum(row[i] >= e for e in model.coarse[i]), sum(row[j] >= e for e in model.coarse[j])]
                     for i, j, t in model.pairs)
        assert np.isclose(model.score(row[None])[0], 1 / (1 + np.exp(-total)))


def test_features_by_hand():
    x = quality.features(pa.array(["Hello, WORLD!!\nab ab ab", "", None]))
    f = dict(zip(quality.FEATURES, x[0], strict=True))
    assert np.isclose(f["log_words"], np.log1p(5)) and np.isclose(f["distinct_words"], 3 / 5)
    assert np.isclose(f["upper"], 6 / 23) and np.isclose(f["exclamations"], 2 / 23) and f["distinct_lines"] == 1
    assert np.isclose(f["most_frequent_word"], 3 / 5) and np.isclose(f["words_with_mark_at_end"], 2 / 5)
    assert not x[1].any() and not x[2].any()


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (8, 0), (9, None), (None, 1), (77, 1)], "doc_id long, quality int")
    model = quality.train(odd_docs, labels)
    found = quality.score(odd_docs, model)
    assert found.count() == odd_docs.count() and found.where("score is null or held_out is null").count() == 0
    assert quality.score(odd_docs.limit(0), model).count() == 0
    nothing = quality.train(odd_docs, labels.limit(0))
    assert {r.score for r in quality.score(odd_docs, nothing).collect()} == {0.5}
