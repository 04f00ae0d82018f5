"""The trie against a plain one built from dictionaries."""

import hashlib
import random
import zlib

import pytest

from gatelake.llm import prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string, depth string, k1 int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    def token(role, text):
        return sha(f"{len(role.encode())}:{role}{text}")
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, token(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(turns, key=lambda t: t[:3])] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(abs(c) % 5 * (1 if c >= 0 else -1))
        rebuilt[c] = (*own.get(base, [])[:h], *turns[h:])
    members, ends = {}, {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
        ends.setdefault(turns, []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[b] for b in below) or 1
        saved[node] = sum(saved[b] for b in below) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(children.get(n, [])), leaves[n], saved[n],
                   sha(",".join(map(str, sorted(ends.get(n, [])))))) for n, m in members.items())


def result(df, **how):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = prefix_trie.conversation_trie(df, **how).select(names).collect()
    return sorted(tuple(-1 if v is None else v for v in r) for r in rows)


@pytest.fixture(scope="module")
def rows():
    dice = random.Random(11)
    rows = []
    for c in [*range(-7, 60), 1000, 1001, 1003]:
        if c % 7 == 3:
            continue  # some families lack their first conversation
        same = dice.random() < 0.4
        for t in range(dice.randrange(1, 13)):
            text = dice.choice(["hi", "", None, "é漢😀", "yes"]) if same or dice.random() < 0.5 else f"{c} says {t}"
            rows.append((c, dice.choice([t, t, t, 3, None]), dice.choice(["user", "user", "bot", None]), text))
    rows += [(None, 1, "user", "nobody"), (5, 2, "user", "again"), (5, 2, "user", "again")]
    dice.shuffle(rows)
    return rows


@pytest.mark.parametrize("cells", [1 << 13, 1 << 25])
def test_against_dictionaries(spark, rows, cells, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PACK_IDS", 3)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert result(df.repartition(6), max_cells=cells) == brute(rows)


def test_crowded_sketch_only_screens_less(spark, rows, monkeypatch):
    """Every cell is hit twice, so every prefix goes to the exact grouping."""
    monkeypatch.setattr(prefix_trie, "SLICES", 1)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    turns, conversations = prefix_trie.spliced(prefix_trie.ordered_turns(df))
    prefixes = prefix_trie.prefixes(turns)
    assert prefix_trie.screened(prefixes, 8).where("alone").count() == 0
    assert sorted(tuple(-1 if v is None else v for v in r)
                  for r in prefix_trie.build(turns, conversations, 8).collect()) == brute(rows)


def test_long_conversations_are_dealt_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", 16)
    rows = [(c, t, "user", f"turn {t}") for c in (10, 20, 31, 32) for t in range(70)] + [(20, 70, "bot", "more"), (0, 0, "a", "b" * 10_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert result(df) == brute(rows)


def test_empty_tables(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []
    assert result(spark.createDataFrame([(None, 1, "user", "x", "y", 1)], SCHEMA)) == []
    # h of conversation 4 is above its number of turns and its family has no first: only the root is left.
    h = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    assert result(spark.createDataFrame([(h, 1, "user", "x", "y", 1)], SCHEMA)) == [(h, 0, -1, 1, 0, 1, 0, sha(str(h)))]
