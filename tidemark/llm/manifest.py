"""Merkle manifest of a table: fractal traversal of blocks, with the proofs above them from Spark.

A group's leaves stand in one order; every ARITY consecutive nodes have their hash as parent, until one is left.
A block is the HEIGHT lowest levels over ARITY ** HEIGHT aligned leaves.  The roots of all blocks
are the leaves of the next round, and so on, so that no task holds more than a block and a group may have
any number of leaves.  The groups' roots make one more tree in the same way.

Paths come down again: a task walks its block's leaves from left to right and emits their authentication
paths one after the other.  It cuts the block's height into layers and keeps for each layer two stacked subtrees:
the existing one, which has the siblings of the leaf at hand, and the desired one next to it, which takes
one leaf a step and is ready when the walk gets there.  The path of the block's root follows.

Defined results: order within a source is by doc_id (null first), then leaf; rows that repeat everything
are leaves of their own; a null source is a source, the first; a tree of one leaf has an empty path; an empty
table gives no rows.  A null doc_id is never tampered with.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, stage, table
from tidemark.llm.order import positions
from tidemark.session import ship

ARITY = 3
#: Levels of a block (2,187 leaves), and of a layer within it.
HEIGHT, LAYER = 7, 2
PATH = "array<struct<before:string,after:string>>"


def digest(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def levels_of(n: int) -> int:
    """Levels until one node of n is left."""
    return next(k for k in range(64) if ARITY**k >= n)


class Subtree:
    """The nodes at heights low to high - 1 over the leaves taken so far, and the unfinished runs of each height."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high
        self.nodes: list[list[str]] = [[] for _ in range(high - low)]
        self.runs: list[list[str]] = [[] for _ in range(high)]

    def take(self, node: str, height: int = 0) -> None:
        while True:
            if height >= self.low:
                self.nodes[height - self.low].append(node)
            run = self.runs[height]
            run.append(node)
            if len(run) < ARITY:
                return
            self.runs[height] = []
            height += 1
            if height == self.high:
                return
            node = digest(run)

    def close(self) -> None:
        """No leaf follows: unfinished runs become nodes."""
        for height in range(self.high - 1):
            run, self.runs[height] = self.runs[height], []
            if run:
                self.take(digest(run), height + 1)


def traverse(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """Of each leaf in turn, its siblings before and after it on every level from below."""
    n, layers = len(leaves), []
    for low in range(0, levels, LAYER):
        high = min(low + LAYER, levels)
        span, existing = ARITY**high, Subtree(low, high)
        for leaf in leaves[:span]:
            existing.take(leaf)
        if n <= span:
            existing.close()
        layers.append([span, existing, Subtree(low, high)])
    for at in range(n):
        path = []
        for layer in layers:
            span, existing, desired = layer
            if at and at % span == 0:
                existing, desired = desired, Subtree(existing.low, existing.high)
                layer[1:] = existing, desired
            if at + span < n:
                desired.take(leaves[at + span])
                if at + span == n - 1:
                    desired.close()
            inside = at % span
            for level, nodes in enumerate(existing.nodes, existing.low):
                own = inside // ARITY**level
                first = own - own % ARITY
                path.append(("".join(nodes[first:own]), "".join(nodes[own + 1 : first + ARITY])))
        yield path


def block_of(height: int) -> Column:
    return F.expr(f"pos div {ARITY**height}").alias("block")


def rounds_of(nodes: DataFrame, height: int) -> list[DataFrame]:
    """``nodes`` (grp, pos, n, node), the roots of its blocks, the roots of theirs, ... until each group has one."""

    def block_root(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        nodes, n, block = group["node"].to_pylist(), group["n"][0].as_py(), ARITY**height
        for _ in range(min(height, levels_of(n))):
            nodes = [digest(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]
        return pa.table({"grp": group["grp"][:1], "pos": pa.array([group["pos"][0].as_py() // block]), "n": pa.array([-(-n // block)]), "node": nodes})

    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        own = rounds[-1].select("grp", "pos", "n", "node", block_of(height))
        rounds.append(stage(own.groupBy("grp", "block").applyInArrow(block_root, "grp string, pos long, n long, node string"), "roots"))
    return rounds


def with_paths(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """Adds path, subroot and root to nodes; ``above`` has them for the roots of the nodes' blocks."""
    names = [f.name for f in nodes.schema]
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def walk(block: pa.Table, upper: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        rest = [(x["before"], x["after"]) for x in upper["path"][0].as_py()]
        before, after, ends = [], [], [0]
        for path in traverse(block["node"].to_pylist(), min(height, levels_of(block["n"][0].as_py()))):
            for siblings in (path, rest):
                before += [s[0] for s in siblings]
                after += [s[1] for s in siblings]
            ends.append(len(before))
        struct = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], names=["before", "after"])
        block = block.select(names).append_column("path", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct).cast(kind))
        for name in ("subroot", "root"):
            block = block.append_column(name, pa.array([upper[name][0].as_py()] * block.num_rows, pa.string()))
        return block

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    own = nodes.withColumn("block", block_of(height)).groupBy("grp", "block")
    tops = above.select("grp", F.col("pos").alias("block"), "path", "subroot", "root").groupBy("grp", "block")
    return own.cogroup(tops).applyInArrow(walk, f"{schema}, path {PATH}, subroot string, root string")


def down(rounds: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """Paths of the first round's nodes, from those of the last round's."""
    for k in range(len(rounds) - 2, -1, -1):
        above = with_paths(rounds[k], above, height)
        above = stage(above, "paths") if k else above
    return above


def manifest(leaves: DataFrame, height: int = HEIGHT) -> DataFrame:
    """grp, doc_id, node and any other columns to pos, n, path, subroot and root; grp is a text that isn't null."""
    ship(leaves.sparkSession)
    rounds = rounds_of(positions(leaves, "grp", ["doc_id", "node"], "leaves"), height)
    subroots = rounds[-1].select(F.lit("").alias("grp"), F.col("grp").alias("of"), "node")
    upper = rounds_of(positions(subroots, "grp", ["of"], "subroots"), height)
    root = upper[-1].select("grp", "pos", F.array().cast(PATH).alias("path"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    tops = root.join(upper[0].select("grp", "of", "node"), "grp").drop("pos") if len(upper) == 1 else down(upper, root, height)
    tops = stage(tops.select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", F.col("node").alias("subroot"), "root"), "tops")
    if len(rounds) == 1:  # every group has one leaf
        return rounds[0].join(tops.drop("pos"), "grp")
    return down(rounds, tops, height)


def field(column: str | Column) -> Column:
    """A value with its length before it, or a dash for null."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: str | Column) -> Column:
    return F.sha2(F.concat(field("doc_id"), field("source"), field("lang"), field("n_chars"), field(text)).cast("binary"), 256)


def folded(node: str | Column, path: str = "path") -> Column:
    """The root that a leaf and its path give."""
    start = F.col(node) if isinstance(node, str) else node
    return F.aggregate(path, start, lambda own, s: F.sha2(F.concat(s["before"], own, s["after"]).cast("binary"), 256))


def proofs(documents: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, node (leaf), tampered (the leaf after tampering), pos, n, path, subroot, root of every document."""
    altered = F.when(crc_mod("doc_id", 2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    grp = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    leaves = documents.select(grp.alias("grp"), "doc_id", leaf("text").alias("node"), leaf(altered).alias("tampered"))
    return manifest(stage(leaves, "hashed"), height).drop("grp")  # so that ordering them, which looks twice, doesn't read texts again


def checked(found: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of proofs: whether each, with its leaf after tampering, still holds."""
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    out = found.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), folded("tampered").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document."""
    return checked(proofs(table(spark, sf_dir, "documents")))


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_field_sql(x) for x in ('CAST(doc_id AS VARCHAR)', 'source', 'lang', 'CAST(n_chars AS VARCHAR)', text))})"


def _crc_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text, bit by bit: a byte is mixed in, then come eight shifts."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END), 4294967295)"


OP12_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, * FROM (
    SELECT coalesce('s' || source, '') AS grp, doc_id, {_leaf_sql("text")} AS leaf,
      CASE WHEN {_crc_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS tampered
    FROM documents) AS d
), low AS (
  SELECT 0 AS lvl, grp, pos, leaf AS node, count(*) OVER (PARTITION BY grp) AS n FROM docs
  UNION ALL
  SELECT lvl + 1, grp, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 2) // 3) FROM low WHERE n > 1 GROUP BY lvl, grp, pos // 3
), high AS (
  SELECT 0 AS lvl, row_number() OVER (ORDER BY grp) - 1 AS pos, grp, node, count(*) OVER () AS n FROM low WHERE n = 1
  UNION ALL
  SELECT lvl + 1, pos // 3, NULL, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 2) // 3) FROM high WHERE n > 1 GROUP BY lvl, pos // 3
), runs AS (
  SELECT FALSE AS up, grp, lvl, pos // 3 AS run, list(node ORDER BY pos) AS nodes FROM low WHERE n > 1 GROUP BY grp, lvl, pos // 3
  UNION ALL
  SELECT TRUE, '', lvl, pos // 3, list(node ORDER BY pos) FROM high WHERE n > 1 GROUP BY lvl, pos // 3
), walk AS (
  SELECT row_number() OVER () AS row, FALSE AS up, grp, 0 AS lvl, pos, leaf, tampered AS acc, '' AS siblings, doc_id FROM docs
  UNION ALL
  SELECT w.row, w.up OR r.run IS NULL, w.grp, CASE WHEN r.run IS NULL THEN 0 ELSE w.lvl + 1 END,
    CASE WHEN r.run IS NULL THEN h.pos ELSE w.pos // 3 END, w.leaf,
    CASE WHEN r.run IS NULL THEN w.acc ELSE sha256(array_to_string(r.nodes[: w.pos % 3] || [w.acc] || r.nodes[w.pos % 3 + 2 :], '')) END,
    CASE WHEN r.run IS NULL THEN w.siblings ELSE w.siblings || array_to_string(r.nodes[: w.pos % 3] || r.nodes[w.pos % 3 + 2 :], '') END, w.doc_id
  FROM walk AS w LEFT JOIN runs AS r ON r.up = w.up AND r.grp = CASE WHEN w.up THEN '' ELSE w.grp END AND r.lvl = w.lvl AND r.run = w.pos // 3
  LEFT JOIN high AS h ON NOT w.up AND h.lvl = 0 AND h.grp = w.grp
  WHERE r.run IS NOT NULL OR NOT w.up
), last AS (SELECT * FROM walk WHERE up QUALIFY row_number() OVER (PARTITION BY row ORDER BY lvl DESC) = 1)
SELECT doc_id, leaf, s.node AS subroot, t.node AS root, sha256(siblings) AS proof_sha256, acc AS folded_root, acc = t.node AS verified
FROM last AS l JOIN (SELECT grp, node FROM high WHERE lvl = 0) AS s USING (grp), (SELECT node FROM high WHERE n = 1) AS t
"""
