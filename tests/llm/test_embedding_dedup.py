"""Links against all pairs."""

import numpy as np
import pytest

from gatelake.llm import embedding_dedup


def brute(ids, vectors, threshold=0.95):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    close = unit @ unit.T >= threshold
    np.fill_diagonal(close, False)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(close), strict=True):
            low = min(label[ids[a]], label[ids[b]])
            for x in (ids[a], ids[b]):
                changed |= label[x] != low
                label[x] = low
    return {i: (int(close[n].sum()), label[i]) for n, i in enumerate(ids)}


@pytest.mark.parametrize("block", [1024, 16])
def test_equals_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 64))
    vectors = np.concatenate([rng.normal(size=(300, 64)), base[rng.integers(0, 40, 300)] + rng.normal(size=(300, 64)) * 0.12,
                              np.repeat(base[:3], 20, axis=0), base[:1] + rng.normal(size=(150, 64)) * 0.1])
    ids = rng.permutation(5000)[:len(vectors)].tolist()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    found = {r.vec_id: r for r in embedding_dedup.link_vectors(rows.repartition(4)).collect()}
    want = brute(ids, vectors)
    true, got = sum(n for n, _ in want.values()), sum(r.n_links for r in found.values())
    assert all(found[i].n_links <= n for i, (n, _) in want.items()) and got >= 0.97 * true
    assert sum(found[i].component_id == c for i, (_, c) in want.items()) >= 0.97 * len(ids)
    assert all(r.kept == (r.component_id == r.vec_id) for r in found.values())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    unit = [1.0, 0.0, 0.5]
    rows = [(1, unit), (2, unit), (3, [2.0, 0.0, 1.0]), (4, None), (5, []), (6, [0.0, -0.0, 0.0]), (7, [nan, 1.0, 1.0]),
            (8, [inf, 1.0, 1.0]), (9, [None, 1.0, 1.0]), (10, [1.0, 0.0, 0.5, 0.0]), (None, unit), (1, unit), (11, [1e200, 0.0, 5e199]),
            (12, [1e-200, 0.0, 5e-201]), (13, [-1.0, 0.0, -0.5]), (14, [1.0, -0.0, 0.5])]
    table = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<double>, doc string, n int")
    found = embedding_dedup.link_vectors(table).collect()
    assert len(found) == len(rows)
    by_id = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found}
    assert all(by_id[i][:2] == (5, 1) for i in (1, 2, 3, 11, 12, 14)) and by_id[1][2] and not by_id[2][2]
    assert all(by_id[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 13)) and by_id[None] == (0, None, False)
    assert embedding_dedup.link_vectors(table.limit(0)).count() == 0
