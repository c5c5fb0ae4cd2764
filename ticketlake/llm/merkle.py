"""Merkle manifest of a dataset, grown by appends that keep every leaf's witness.

A block of ``2 ** LEVELS`` leaves is appended one by one to a frontier of open
subtrees.  Every open subtree carries the partial witnesses of its leaves; when
its sibling is complete the two merge, and the witnesses on either side are
extended by the other's root.  A block is aligned, so its root is a node of the
whole tree: block roots are further appends to the next frontier, as many to a
group, until one root is left, and their witnesses extend those of their blocks.
A task never holds more than a block's nodes, whatever the size of a language.

Positions in a language come from a range sort and prefix sums, so a hot
language is many ranges and blocks.  Digests are hex text; a node without a
sibling is hashed alone.  A witness is an array from the leaf up: ``L`` or ``R``
and the sibling's digest (it stands left or right), or '' where there is none.

Edge rows: a null value is hashed as ``-``; rows that repeat a doc_id are leaves
of their own, in order of their digest; a null doc_id comes first; a null lang is a
language of its own, first in order; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import ship_package, sized_broadcast
from .blocks import cut
from .ordered import running_sums

# A block holds 2 ** LEVELS nodes.
LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Block roots and languages are broadcast up to this many rows, beyond it joined by shuffle.
UPPER_BROADCAST = 100_000


def digest(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


class Frontier:
    """Open subtrees from left to right, heights falling; each (height, root, first leaf, end)."""

    def __init__(self):
        self.open: list[tuple[int, str, int, int]] = []
        self.witness: list[list[str]] = []

    def append(self, leaf: str) -> None:
        n = len(self.witness)
        self.witness.append([])
        self.open.append((0, leaf, n, n + 1))
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._merge()

    def _merge(self) -> None:
        height, right, middle, end = self.open.pop()
        _, left, first, _ = self.open.pop()
        for i in range(first, middle):
            self.witness[i].append("R" + right)
        for i in range(middle, end):
            self.witness[i].append("L" + left)
        self.open.append((height + 1, digest(left + right), first, end))

    def _raise(self, height: int) -> None:
        """The last subtree has no sibling up to ``height``: its root is hashed alone."""
        h, root, first, end = self.open.pop()
        for _ in range(height - h):
            root = digest(root)
            for i in range(first, end):
                self.witness[i].append("")
        self.open.append((height, root, first, end))

    def close(self, height: int | None) -> str:
        """Root over all leaves; with ``height``, as the node of a larger tree on that level."""
        while len(self.open) > 1:
            self._raise(self.open[-2][0])
            self._merge()
        if height is not None:
            self._raise(height)
        return self.open[0][1]


def _append_block(table: pa.Table, levels: int) -> pa.Table:
    """The nodes of one block with their witnesses inside it; the first carries the block's root."""
    table = table.sort_by("pos")
    frontier = Frontier()
    for h in table.column("node").to_pylist():
        frontier.append(h)
    root = frontier.close(levels if table.column("n")[0].as_py() > 1 << levels else None)
    return (table.append_column("path", pa.array(frontier.witness, pa.list_(pa.string())))
            .append_column("root", pa.array([root] + [None] * (table.num_rows - 1), pa.string())))


def grow(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``nodes`` (tree, pos from 0, n nodes in the tree, node, further columns) with
    ``path``, the node's witness up to the root of its tree, and ``root``."""
    ship_package(nodes.sparkSession)
    nodes = nodes.withColumn("block", F.shiftright("pos", levels))
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema] + ["path array<string>", "root string"])
    low = cut(nodes.groupBy("tree", "block").applyInArrow(lambda table: _append_block(table, levels), fields))
    up = low.where("root is not null").select("tree", F.col("block").alias("pos"), F.shiftright(F.col("n") + ((1 << levels) - 1), levels).alias("n"),
                                              F.col("root").alias("node"))
    if low.where(F.col("n") > 1 << levels).limit(1).count():
        up = grow(up, levels).select("tree", F.col("pos").alias("block"), F.col("path").alias("rest"), F.col("root").alias("top"))
    else:
        up = up.select("tree", F.col("pos").alias("block"), F.array().cast("array<string>").alias("rest"), F.col("node").alias("top"))
    both = low.drop("root").join(sized_broadcast(up, UPPER_BROADCAST), ["tree", "block"])
    return both.select(*[c for c in nodes.columns if c != "block"], F.concat("path", "rest").alias("path"), F.col("top").alias("root"))


def leaf_digest(columns: dict[str, Column]) -> Column:
    """H of the values, each as UTF-8 byte count, ``:`` and value, null as ``-``."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*[part(columns[c]) for c in FIELDS]), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a witness give."""
    def up(node: Column, step: Column) -> Column:
        sibling = F.substr(step, F.lit(2))
        return F.sha2(F.when(step == "", node).when(F.startswith(step, F.lit("L")), F.concat(sibling, node))
                      .otherwise(F.concat(node, sibling)), 256)
    return F.aggregate(path, leaf, up)


def siblings_digest(path: Column) -> Column:
    """H of the witness's siblings, from the leaf up."""
    there = F.transform(F.filter(path, lambda s: s != ""), lambda s: F.substr(s, F.lit(2)))
    return F.sha2(F.array_join(there, ""), 256)


def document_columns(docs: DataFrame) -> dict[str, Column]:
    return {c: docs[c] for c in FIELDS}


def build_manifest(docs: DataFrame, more: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per document: doc_id, lang, leaf, position (in its language), subroot, root,
    path (its witness up to the root), and the columns ``more`` computed from ``docs``."""
    more = more or {}
    leaves = cut(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"),
                             leaf_digest(document_columns(docs)).alias("node"), *[c.alias(f"more_{n}") for n, c in more.items()]))
    in_order = [F.col("lang").asc_nulls_first()]
    langs = running_sums(leaves.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), in_order, {"tree": "1", "start": "n"})
    placed = running_sums(leaves, [*in_order, F.col("doc_id").asc_nulls_first(), F.col("node")], {"at": "1"})
    langs = langs.withColumnRenamed("lang", "of")
    inside = placed.join(sized_broadcast(langs, UPPER_BROADCAST), F.col("lang").eqNullSafe(F.col("of")))
    trees = grow(inside.select("tree", (F.col("at") - F.col("start")).alias("pos"), "n", "node", "doc_id", "lang",
                               *[f"more_{n}" for n in more]), levels)
    tops = trees.where("pos = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("root").alias("node"))
    tops = grow(tops.withColumn("n", F.lit(langs.count()).cast("long")), levels).select(
        F.col("pos").alias("tree"), F.col("path").alias("rest"), F.col("root").alias("top"))
    return trees.join(sized_broadcast(tops, UPPER_BROADCAST), "tree").select(
        "doc_id", "lang", F.col("node").alias("leaf"), F.col("pos").alias("position"), F.col("root").alias("subroot"),
        F.col("top").alias("root"), F.concat("path", "rest").alias("path"), *[F.col(f"more_{n}").alias(n) for n in more])


def verify_manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; where 7 divides the
    crc32 of the decimal doc_id, the leaf is folded with 1 added to n_chars."""
    of = document_columns(docs)
    hit = F.crc32(docs["doc_id"].cast("long").cast("string").cast("binary")) % 7 == 0
    changed = F.when(hit & docs["n_chars"].isNotNull(), leaf_digest(of | {"n_chars": docs["n_chars"] + 1}))
    m = build_manifest(docs, {"changed": changed}, levels)
    out = m.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"),
                   folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(table: str = "documents") -> str:
    """DuckDB SQL of verify_manifest, level by level."""
    def leaf(n_chars: str) -> str:
        cols = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text"]
        return "sha256(" + " || ".join(f"coalesce(CAST(strlen({c}) AS VARCHAR) || ':' || {c}, '-')" for c in cols) + ")"

    def tree(name: str, base: str) -> str:
        return f"""{name}(tree, lvl, pos, h) AS (
  {base}
  UNION ALL
  SELECT tree, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}) WHERE n > 1 GROUP BY tree, lvl, pos // 2)"""

    return f"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, b:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))),
ids AS (
  SELECT doc_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) AS crc32 FROM (SELECT DISTINCT doc_id FROM {table}), crc),
leaves AS (
  SELECT d.doc_id, d.lang, {leaf('n_chars')} AS leaf,
    CASE WHEN crc32 % 7 = 0 AND n_chars IS NOT NULL THEN {leaf('n_chars + 1')} ELSE {leaf('n_chars')} END AS used
  FROM {table} d LEFT JOIN ids USING (doc_id)),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
{tree('low', "SELECT tree, 0, pos, leaf FROM placed")},
subs AS (SELECT tree, h AS subroot, lvl AS height FROM low QUALIFY lvl = max(lvl) OVER (PARTITION BY tree)),
{tree('top', "SELECT 0, 0, tree, subroot FROM subs")},
roots AS (SELECT h AS root FROM top ORDER BY lvl DESC LIMIT 1),
heights AS (SELECT max(lvl) AS height FROM top),
steps AS (
  SELECT p.tree, p.pos, l.lvl AS step, (p.pos >> CAST(l.lvl AS INTEGER)) % 2 AS side, sib.h AS sibling
  FROM placed p JOIN subs s USING (tree) JOIN (SELECT DISTINCT lvl FROM low) l ON l.lvl < s.height
  LEFT JOIN low sib ON sib.tree = p.tree AND sib.lvl = l.lvl AND sib.pos = xor(p.pos >> CAST(l.lvl AS INTEGER), 1)
  UNION ALL
  SELECT p.tree, p.pos, 1000 + l.lvl, (p.tree >> CAST(l.lvl AS INTEGER)) % 2, sib.h
  FROM placed p JOIN (SELECT DISTINCT lvl FROM top) l ON true JOIN heights ON l.lvl < heights.height
  LEFT JOIN top sib ON sib.lvl = l.lvl AND sib.pos = xor(p.tree >> CAST(l.lvl AS INTEGER), 1)),
proofs AS (SELECT tree, pos, sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS proof FROM steps GROUP BY tree, pos),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tree, pos ORDER BY step) AS nth FROM steps),
fold(tree, pos, nth, h) AS (
  SELECT tree, pos, CAST(0 AS BIGINT), used FROM placed
  UNION ALL
  SELECT f.tree, f.pos, f.nth + 1,
    sha256(CASE WHEN sibling IS NULL THEN h WHEN side = 1 THEN sibling || h ELSE h || sibling END)
  FROM fold f JOIN numbered n ON n.tree = f.tree AND n.pos = f.pos AND n.nth = f.nth + 1),
ends AS (SELECT tree, pos, h AS folded_root FROM fold QUALIFY nth = max(nth) OVER (PARTITION BY tree, pos))
SELECT p.doc_id, p.leaf, s.subroot, r.root, coalesce(q.proof, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = r.root AS verified
FROM placed p JOIN subs s USING (tree) JOIN ends e USING (tree, pos) LEFT JOIN proofs q USING (tree, pos), roots r"""
