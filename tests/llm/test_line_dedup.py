"""What is cut stands earlier, nothing is lost, planted passages go."""

import itertools
import random

import pyarrow as pa

from gatelake.llm import common, line_dedup, words


def line(rng, words=9):
    return " ".join(f"w{rng.randrange(10_000)}" for _ in range(words))


def earlier_lines(rows):
    """Every cut line must have an uncut copy that comes first by (id, line)."""
    kept, cut = {}, []
    for doc, text, _, lines in rows:
        for i, x in enumerate(text.split("\n")):
            if i in lines:
                cut.append(((doc, i), x))
            else:
                kept.setdefault(x, (doc, i))
    assert all(x in kept and kept[x] < place for place, x in cut)
    return len(cut)


def run(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r for r in line_dedup.remove_repeats(docs, **how).collect()}
    out = []
    for doc, text in rows:
        lines = set(found[doc].cut_lines)
        assert found[doc].text == "\n".join(x for i, x in enumerate(text.split("\n")) if i not in lines)
        out.append((doc, text, found[doc].text, lines))
    return sorted(out)


def test_planted_passages(spark):
    rng = random.Random(1)
    passage = [line(rng) for _ in range(8)]
    paragraph = line(rng, 100)
    rows = []
    for i in range(60):
        lines = [line(rng) for _ in range(rng.randint(3, 12))]
        at = rng.randrange(len(lines))
        rows.append((i, "\n".join(lines[:at] + (passage if i % 2 else [paragraph]) + lines[at:])))
    found = run(spark, rows)
    assert earlier_lines(found) > 0
    left = sum(paragraph in text for _, _, text, _ in found)
    assert left == 1 and "".join(t for d, _, t, _ in found if d == 0).count(paragraph) == 1
    holders = [text for d, _, text, _ in found if d % 2]
    whole = sum("\n".join(passage) in t for t in holders)
    remaining = sum(sum(x in t for x in passage) for t in holders) / (8 * len(holders))
    assert whole == 1 and remaining < 0.2
    own = {x for d, t, _, _ in found for x in t.split("\n")} - {paragraph, *passage}
    assert own <= {x for _, _, t, _ in found for x in t.split("\n")}


def test_short_passages_are_cut_whole(spark):
    rng = random.Random(5)
    passages = [[line(rng, 30) for _ in range(2)], [line(rng, 40), "", line(rng, 20)], [line(rng, 20) for _ in range(3)],
                [line(rng, 11) for _ in range(5)], [line(rng, 6) for _ in range(10)], ["a b c d e f"] + [line(rng, 1) for _ in range(50)],
                ["Title", line(rng, 60), "End"]]
    passages = [p if len(p) > 3 else [x + f" v{copy}" if x else x for x in p] for p in passages for copy in range(12)]
    passages = [[f"{x}{i}" if x else x for x in p] for i, p in enumerate(passages)]
    rows, held = [], []
    for i, passage in enumerate(passages):
        assert len(" ".join(passage).split()) > 50
        for _ in range(2 if i % 3 else 9):
            before, after = ([line(rng) for _ in range(rng.randint(0, 4))] for _ in range(2))
            held.append((i, len(rows), range(len(before), len(before) + len(passage))))
            rows.append((len(rows), "\n".join(before + passage + after)))
    found = run(spark, rows)
    earlier_lines(found)
    for i in range(len(passages)):
        _, *others = [(doc, lines) for p, doc, lines in held if p == i]
        assert all(found[doc][3] == set(lines) for doc, lines in others), (i, others)
    assert sum(len(lines) for *_, lines in found) == sum(len(x) for i, d, x in held) - sum(map(len, passages))


def test_copies_and_single_lines(spark):
    rng = random.Random(2)
    text = "\n".join(line(rng) for _ in range(6))
    short = line(rng)
    rows = [(1, text), (2, text), (3, short + "\n" + line(rng)), (4, line(rng) + "\n" + short)]
    found = run(spark, rows)
    assert found[0][2] == text and found[1][2] == ""
    assert found[2][3] == set() and found[3][3] == set()


def test_equal_hashes_are_compared_byte_by_byte(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(line(rng) for _ in range(4))) for i in range(4)]
    rows = [(i, "\n".join(x[:40].ljust(40, "z") for x in t.split("\n"))) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ranges = spark.createDataFrame([(0, 0, 4)], "doc long, first int, n int")
    slices = line_dedup._slices(docs.select(docs.doc_id.alias("doc"), "text"), ranges, 0).collect()
    assert [bytes(r.bytes).decode() for r in slices] == [rows[0][1]]


def test_neighbours_in_a_block_do_not_matter():
    rng = random.Random(4)
    texts = ["\n".join(line(rng) for _ in range(rng.randint(1, 9))) for _ in range(50)]

    def chunks(some):
        out = []
        for _, _, data, offsets in words.text_blocks(pa.array(some)):
            row, *rest = line_dedup._chunks(data, offsets, line_dedup.RULES, 49, 64)
            out += [(some[r], *map(int, x)) for r, *x in zip(row, *rest, strict=True)]
        return sorted(out)
    assert chunks(texts) == sorted(c for t in texts for c in chunks([t]))


def test_odd_rows(spark, odd_docs):
    found = line_dedup.remove_repeats(odd_docs)
    assert set(found.columns) == {*odd_docs.columns, "cut_lines"}
    assert found.count() == odd_docs.count()
    by_id = {r.doc_id: r for r in found.collect()}
    assert by_id[1].text and by_id[2].text == "" and by_id[3].text is None and by_id[12].text == "\x00\r\n\n"
    assert by_id[10].cut_lines == []
    assert line_dedup.remove_repeats(odd_docs.limit(0)).count() == 0


def plain_cuts(rows, min_bytes=64, long_line=49):
    """Lines in a stretch of two lines and ``min_bytes``, or one long line, that stands earlier; by looking at them all."""
    first, found = {}, set()
    for doc, text in sorted(rows):
        lines = text.split("\n")
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                part = "\n".join(lines[i:j + 1])
                if len(part.encode()) >= min_bytes and (j > i or part.count(" ") >= long_line):
                    if first.setdefault(part, (doc, i)) != (doc, i):
                        found |= {(doc, k) for k in range(i, j + 1)}
    return found


def test_cuts_are_those_of_a_plain_search(spark):
    rng = random.Random(8)
    pool = [[line(rng, rng.choice((1, 3, 9, 12, 55))) for _ in range(rng.randint(1, 7))] for _ in range(25)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += rng.choice(pool) if rng.random() < 0.5 else [line(rng) for _ in range(rng.randint(1, 3))]
            parts += rng.choice(([], [], [""], ["}", ""] * 30, [line(rng)] * 4, ["aa", "bb", "cc"] * 15))
        rows.append((i, "\n".join(parts)))
    expected = plain_cuts(rows)
    got = {(doc, i) for doc, _, _, lines in run(spark, rows) for i in lines}
    assert got <= expected
    assert len(expected) > 500 and len(got) >= 0.98 * len(expected), (len(got), len(expected), sorted(expected - got)[:20])


def test_tables_that_nothing_reads_any_more_are_dropped(spark, tmp_path, monkeypatch):
    counted = itertools.count()
    monkeypatch.setattr(common, "work_dir", lambda session, name: f"{tmp_path}/{name}.{next(counted)}")
    passage = "\n".join(f"line {i} of a passage that stands in both of the texts" for i in range(60))
    docs = spark.createDataFrame([(1, f"one\n{passage}\nend"), (2, f"two\n{passage}\nother end")], "doc_id long, text string")
    found = line_dedup.repeated_passages(docs).collect()
    assert sum(r.n for r in found if r.doc == 2) >= 60 and not [r for r in found if r.doc == 1]
    left = [p.name.split(".")[0] for p in tmp_path.iterdir()]
    assert left.count("slices") == 1 and "asked-lines" not in left and "repeated-chunks" not in left


def test_tables_too_large_for_the_driver_are_shuffled_with_the_same_cuts(spark, monkeypatch):
    rng = random.Random(6)
    pool = [[line(rng) for _ in range(rng.randint(2, 7))] for _ in range(40)]
    rows = []
    for i in range(120):
        rows.append((i, "\n".join(x for _ in range(rng.randint(1, 4)) for x in (*rng.choice(pool), line(rng)))))
    whole, marked = run(spark, rows), []
    monkeypatch.setattr(common, "BROADCAST_HELD", 100, raising=False)
    monkeypatch.setattr(line_dedup, "CHUNKS_HELD", 100, raising=False)
    monkeypatch.setattr(common.F, "broadcast", lambda df: marked.append(df) or df)
    assert run(spark, rows) == whole and sum(len(lines) for *_, lines in whole) > 100
    assert marked == []


def test_lines_around_ranges_are_never_sent_to_the_driver(spark):
    ranges = spark.createDataFrame([(2, 0, 2, 1, 0)], "doc long, first int, n int, at long, at_first int")
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nb\nd")], "doc long, text string")
    alike = line_dedup._both_places(ranges, line_dedup._slices(docs, line_dedup._asked(ranges), 4))
    plan = alike._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan
    assert [(r.doc, r.at, len(r.after), len(r.held_after)) for r in alike.collect()] == [(2, 1, 1, 1)]
