"""The manifest against a plain tree."""

import hashlib
import random
import zlib

from gatelake.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests, fanout=3):
    """Root, and the (left, right) siblings of every leaf by level."""
    paths, level, of = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for i, p in enumerate(of):
            run = p // fanout * fanout
            paths[i].append(("".join(level[run:p]), "".join(level[p + 1:run + fanout])))
        level = [h(*level[i:i + fanout]) for i in range(0, len(level), fanout)]
        of = [p // fanout for p in of]
    return (level[0] if level else None), paths


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    found, subroots = {}, []
    for source in order:
        held = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r["text"]) for r in groups[source]),
                      key=lambda t: t[:3])
        of = {(leaf(r, r["text"])): r for r in groups[source]}
        subroot, paths = tree([t[2] for t in held])
        subroots.append(subroot)
        found[source] = [(of[t[2]], t[2], p) for t, p in zip(held, paths)]
    root, tops = tree(subroots)
    out = []
    for source, subroot, top in zip(order, subroots, tops):
        for row, digest, path in found[source]:
            path = path + top
            text = row["text"]
            if row["doc_id"] is not None and text is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            again = leaf(row, text)
            for left, right in path:
                again = h(left, again, right)
            out.append((row["doc_id"], digest, subroot, root, h(*(x for side in path for x in side)), again, again == root))
    return sorted(out, key=repr)


def result(df):
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in merkle.document_manifest(df).select(columns).collect()), key=repr)


def test_against_a_plain_tree(spark):
    dice = random.Random(5)
    rows = [{"doc_id": i, "text": dice.choice(["a\nb", "", None, "é漢", f"t{i}\n"]), "lang": dice.choice(["en", None]),
             "source": s, "n_chars": dice.choice([None, 3])}
            for i, s in enumerate(["hot"] * 82 + ["é", None, "z", "Z", ""] + [None] * 3 + ["two"] * 2 + ["nine"] * 9 + ["ten"] * 10)]
    dice.shuffle(rows)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = result(df.repartition(5))
    assert found == brute(rows)
    assert {r[-1] for r in found} == {True, False}


def test_one_group_and_one_row(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    one = [(7, "a\nb", None, "s", 3)]
    assert result(spark.createDataFrame(one, schema)) == brute([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), one[0]))])
    assert result(spark.createDataFrame([], schema)) == []


def test_odd_rows(spark, odd_docs):
    assert result(odd_docs) == brute([r.asDict() for r in odd_docs.collect()])
