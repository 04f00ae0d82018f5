"""Merkle manifest of a table: a tree of digests per group, and one over the groups.

Slot pivot: the children of a parent are spread into one column per slot by conditional aggregates. The concatenated
columns, hashed, are the parent; the columns left and right of a child's own are its siblings. Trees are built upwards
one grouping a level, each a ``fanout``-th of the one before, and the sibling lists are handed down from the root by one
join a level, so a group may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelake.llm import ranked
from gatelake.llm.common import crc32_sql, keep
from gatelake.operators.ordered import join_null_safe

_PATH = "array<struct<left string, right string>>"


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of the values, each as its UTF-8 length, a colon and the text, or ``-`` for a null."""
    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.sha2(F.concat(*(field(c) for c in columns)), 256)


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path to the root give."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))


@dataclass(frozen=True)
class _Tree:
    """Stored pivots from the leaves up, and the top of every group with its number of levels."""

    levels: list[DataFrame]
    tops: DataFrame


def _pivoted(nodes: DataFrame, fanout: int) -> DataFrame:
    """(gid, pos, n, digest, s0, s1, ...): one row a parent, its children in slots; ``n`` nodes are on the parents' level."""
    held = F.struct(*(c for c in nodes.columns if c not in ("gid", "pos", "n")))
    slots = [F.max(F.when(F.pmod("pos", F.lit(fanout)) == i, held)).alias(f"s{i}") for i in range(fanout)]
    parents = nodes.where("n > 1").groupBy("gid", F.floor(F.col("pos") / fanout).alias("pos"), "n").agg(*slots)
    joined = F.concat(*(F.coalesce(F.col(f"s{i}.digest"), F.lit("")) for i in range(fanout)))
    return parents.select("gid", "pos", F.ceil(F.col("n") / fanout).alias("n"), F.sha2(joined, 256).alias("digest"),
                          *(f"s{i}" for i in range(fanout)))


def _grown(nodes: DataFrame, fanout: int, name: str) -> _Tree:
    """The tree above stored nodes (gid, pos, n, digest, ...); ``n`` is the number of nodes of the group."""
    widest = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops = [], [nodes.where("n = 1").select("gid", F.lit(0).alias("depth"), "digest")]
    while widest > 1:
        nodes, _ = keep(_pivoted(nodes, fanout), f"{name}-{len(levels) + 1}")
        levels.append(nodes)
        tops.append(nodes.where("n = 1").select("gid", F.lit(len(levels)).alias("depth"), "digest"))
        nodes = nodes.select("gid", "pos", "n", "digest")
        widest = -(-widest // fanout)
    return _Tree(levels, reduce(DataFrame.union, tops))


def _handed_down(tree: _Tree, tops: DataFrame, fanout: int) -> DataFrame | None:
    """(held columns of every leaf below a pivot, subroot, root, path), from (gid, depth, subroot, root, path) of the tops."""
    known = None
    for depth in range(len(tree.levels), 0, -1):
        here = tops.where(F.col("depth") == depth).select("gid", F.lit(0).cast("long").alias("pos"), "subroot", "root", "path")
        known = here if known is None else known.union(here)
        met = tree.levels[depth - 1].drop("n", "digest").join(known, ["gid", "pos"])
        digests = [F.coalesce(F.col(f"s{i}.digest"), F.lit("")) for i in range(fanout)]
        sides = [F.struct(F.concat(F.lit(""), *digests[:i]).alias("left"), F.concat(F.lit(""), *digests[i + 1:]).alias("right"))
                 for i in range(fanout)]
        children = F.filter(F.array(*(F.struct(
            (F.col("pos") * fanout + i).alias("pos"), F.col(f"s{i}").alias("held"), sides[i].alias("side"))
            for i in range(fanout))), lambda c: c["held"].isNotNull())
        opened = met.select("gid", F.explode(children).alias("c"), "subroot", "root", "path")
        path = F.concat(F.array("c.side"), F.col("path")).alias("path")
        known = opened.select(*(["c.held.*"] if depth == 1 else ["gid", "c.pos"]), "subroot", "root", path)
    return known


def build(rows: DataFrame, columns: Sequence[str], id_col: str, group_col: str, fanout: int = 3,
          carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, ``carry`` columns, subroot, root, path) of every row.

    ``path`` has the siblings of each level from the leaf to the root, those on the left and on the right joined. In a
    group, rows follow each other by id (null first), rows of one id by their digest; equal rows are leaves of their own.
    Groups follow by value (null first, by bytes); a null is a group. A lone leaf is its group's subroot, a lone subroot
    the root. An empty table gives no rows. ``carry`` are short values of the row, in addition to its own digest.
    """
    carry = carry or {}
    leaves, _ = keep(rows.select(
        F.col(f"`{group_col}`").alias("_group"), F.col(f"`{id_col}`").alias("_id"),
        leaf_digest([F.col(f"`{c}`") for c in columns]).alias("digest"),
        *(c.alias(f"_carry_{name}") for name, c in carry.items()),
        F.monotonically_increasing_id().alias("_row")), "leaves")
    stored = ranked.laid_out(leaves, ["_group", "_id", "digest", "_row"], "ordered-leaves")
    places, _ = keep(ranked.spans(stored, ["_group"]), "leaf-places")
    sizes, _ = keep(places.select("_group", "n").distinct(), "groups")
    groups = ranked.positions(ranked.laid_out(sizes.select("_group"), ["_group"], "ordered-groups"), [], "groups", "gid")
    groups, _ = keep(groups, "numbered-groups")
    placed = join_null_safe(places, groups.select("_group", "gid"), ["_group"])
    numbered = join_null_safe(stored, placed, ["_group", "part"]).select(
        "gid", (F.col("at") + F.col("start")).alias("pos"), "n", "digest", "_id", *(f"_carry_{name}" for name in carry))
    nodes, _ = keep(numbered, "leaf-nodes")

    tree = _grown(nodes, fanout, "level")
    subroots, _ = keep(tree.tops, "subroots")
    upper, _ = keep(subroots.join(groups.select("gid", "groups"), "gid").select(
        F.lit(0).cast("long").alias("gid"), F.col("gid").alias("pos"), F.col("groups").alias("n"), "digest",
        F.col("gid").alias("of"), "depth"), "top-nodes")
    top = _grown(upper, fanout, "top-level")
    none = F.array().cast(_PATH)
    root = top.tops.select("gid", "depth", F.lit("").alias("subroot"), F.col("digest").alias("root"), none.alias("path"))
    lone = upper.where("n = 1").select(F.col("of").alias("gid"), "depth", F.col("digest").alias("subroot"),
                                       F.col("digest").alias("root"), none.alias("path"))
    below = _handed_down(top, root, fanout)
    tops = lone if below is None else lone.union(below.select(
        F.col("of").alias("gid"), "depth", F.col("digest").alias("subroot"), "root", "path"))
    tops, _ = keep(tops, "tops")

    held = ["digest", "_id", *(f"_carry_{name}" for name in carry)]
    single = nodes.where("n = 1").select("gid", *held).join(
        tops.where("depth = 0").select("gid", "subroot", "root", "path"), "gid").select(*held, "subroot", "root", "path")
    below = _handed_down(tree, tops, fanout)
    whole = single if below is None else single.union(below.select(*held, "subroot", "root", "path"))
    return whole.select(F.col("_id").alias(id_col), F.col("digest").alias("leaf"),
                        *(F.col(f"_carry_{name}").alias(name) for name in carry), "subroot", "root", "path")


def document_manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
                      id_col: str = "doc_id", group_col: str = "source", text_col: str = "text") -> DataFrame:
    """Digests and proof of every document, and whether a copy of the table that was tampered with still verifies.

    The copy has no newlines in the texts of documents for which 2 divides the CRC-32 of the decimal id. Rows of a null id
    are never tampered with. Columns other than those named are ignored.
    """
    even = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 2 == 0
    touched = F.when(even, F.translate(F.col(f"`{text_col}`").cast("string"), "\n", "")).otherwise(F.col(f"`{text_col}`"))
    other = leaf_digest([touched if c == text_col else F.col(f"`{c}`") for c in columns])
    rows = build(docs, columns, id_col, group_col, carry={"tampered_leaf": other})
    again = folded(F.col("tampered_leaf"), F.col("path"))
    proved = rows.select(F.col(id_col).alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                         again.alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode(CAST({value} AS VARCHAR))) || ':' || {value} END"


def oracle_sql(fanout: int = 3) -> str:
    """The manifest for DuckDB: levels by recursion, siblings by range, the fold by recursion over the levels."""
    leaf = "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
    even = f"doc_id IS NOT NULL AND ({crc32_sql('CAST(doc_id AS VARCHAR)')}) % 2 = 0"
    up = (f"SELECT l + 1, gid, pos // {fanout}, (n + {fanout - 1}) // {fanout}, sha256(string_agg(digest, '' ORDER BY pos)) "
          "FROM {0} WHERE n > 1 GROUP BY l, gid, pos // %d, n" % fanout)
    return f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, source, {leaf.format(text='text')} AS leaf, {leaf.format(text='changed')} AS tampered FROM (
    SELECT *, CASE WHEN {even} THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents)),
grouped AS MATERIALIZED (SELECT *, row_number() OVER () AS rid,
  dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS gid FROM leaves),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  count(*) OVER (PARTITION BY gid) AS n FROM grouped),
low(l, gid, pos, n, digest) AS (
  SELECT 0, gid, pos, n, leaf FROM placed UNION ALL {up.format('low')}),
subroots AS MATERIALIZED (SELECT l AS depth, gid, digest AS subroot FROM low WHERE n = 1),
high(l, gid, pos, n, digest) AS (
  SELECT 0, 0::BIGINT, gid, (SELECT count(*) FROM subroots), subroot FROM subroots UNION ALL {up.format('high')}),
chains AS MATERIALIZED (
  SELECT rid, low.l AS k, placed.gid, placed.pos // power({fanout}, low.l)::BIGINT AS pos
  FROM placed JOIN (SELECT DISTINCT l, gid FROM low WHERE n > 1) low USING (gid)),
sides AS MATERIALIZED (
  SELECT rid, k, coalesce(string_agg(digest, '' ORDER BY s.pos) FILTER (s.pos < c.pos), '') AS lefts,
    coalesce(string_agg(digest, '' ORDER BY s.pos) FILTER (s.pos > c.pos), '') AS rights
  FROM chains c JOIN low s ON s.l = c.k AND s.gid = c.gid AND s.pos // {fanout} = c.pos // {fanout} GROUP BY rid, k
  UNION ALL
  SELECT rid, depth + h.l, coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos < p), ''),
    coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos > p), '')
  FROM (SELECT rid, depth, h.l, gid // power({fanout}, h.l)::BIGINT AS p
        FROM placed JOIN subroots USING (gid) CROSS JOIN (SELECT DISTINCT l FROM high WHERE n > 1) h) h
  JOIN high s ON s.l = h.l AND s.pos // {fanout} = p // {fanout} GROUP BY rid, depth, h.l),
proofs AS (SELECT rid, sha256(string_agg(lefts || rights, '' ORDER BY k)) AS proof FROM sides GROUP BY rid),
folds(rid, k, digest) AS (
  SELECT rid, 0, tampered FROM placed UNION ALL
  SELECT f.rid, f.k + 1, sha256(lefts || digest || rights) FROM folds f JOIN sides s ON s.rid = f.rid AND s.k = f.k),
tops AS (SELECT rid, arg_max(digest, k) AS folded_root FROM folds GROUP BY rid)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN subroots USING (gid) CROSS JOIN (SELECT digest AS root FROM high WHERE n = 1)
JOIN tops USING (rid) LEFT JOIN proofs USING (rid)"""
