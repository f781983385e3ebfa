"""A Merkle manifest of a dataset, its subtrees in van Emde Boas layout.

Leaves of a tree are numbered by a range sort that is written. Every 4096 consecutive nodes form an aligned block, the
leaves of one subtree of four levels of eight; its root is a node of the next level of blocks, until one node is left.
A block is one byte string: a tree of k levels is stored as the tree of its upper k // 2 levels, then each of the trees
below in order, each of them stored in the same way. So a path through a block touches few stretches of memory, at any
size of cache. Construction and sibling retrieval find nodes by address arithmetic alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from offerlake.llm.common import written

ARITY = 8
LEVELS = 4  # levels of hashing in a block: 4096 leaves
BYTES = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BLOCK = "tree string, level int, block long, width long, root binary, nodes binary"
PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def tree_size(levels: int) -> int:
    """Nodes of a complete tree with so many levels of nodes."""
    return (ARITY**levels - 1) // (ARITY - 1)


@cache
def layout(levels: int) -> tuple[np.ndarray, ...]:
    """Addresses of the nodes of a complete tree, by depth and place from the left."""

    def address(levels: int, depth: int, at: np.ndarray) -> np.ndarray:
        if levels == 1:
            return np.zeros_like(at)
        upper = levels // 2
        if depth < upper:
            return address(upper, depth, at)
        lower, below = levels - upper, ARITY ** (depth - upper)
        return tree_size(upper) + at // below * tree_size(lower) + address(lower, depth - upper, at % below)

    return tuple(address(levels, d, np.arange(ARITY**d)) for d in range(levels))


def height(width: int, most: int) -> int:
    """Levels of hashing within a block of a level that has `width` nodes: all, or as many as leave one node."""
    up = 0
    while up < most and ARITY**up < width:
        up += 1
    return up


def digest(parts: list[bytes]) -> bytes:
    """SHA-256 of digests written in hex, one after another."""
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


class Subtree:
    """A block's nodes at their addresses; nodes that don't exist are empty places."""

    def __init__(self, width: int, block: int, most: int, nodes: bytes | None = None):
        self.up = height(width, most)
        self.leaves = min(ARITY**most, width - block * ARITY**most)
        self.at = layout(self.up + 1)
        self.nodes = np.frombuffer(nodes, f"V{BYTES}") if nodes else np.zeros(tree_size(self.up + 1), f"V{BYTES}")

    def count(self, depth: int) -> int:
        return -(-self.leaves // ARITY ** (self.up - depth))

    def row(self, depth: int) -> list[bytes]:
        """The nodes of a depth in order."""
        return [x.tobytes() for x in self.nodes[self.at[depth][: self.count(depth)]]]

    def built(self, leaves: list[bytes]) -> bytes:
        for depth in range(self.up, -1, -1):
            if depth < self.up:
                leaves = [digest(leaves[k : k + ARITY]) for k in range(0, len(leaves), ARITY)]
            self.nodes[self.at[depth][: len(leaves)]] = np.frombuffer(b"".join(leaves), f"V{BYTES}")
        return self.nodes.tobytes()

    def steps(self, leaf: int) -> list[tuple[bytes, bytes]]:
        """For each level from the leaf up: the siblings to the left and to the right."""
        out = []
        for depth in range(self.up, 0, -1):
            first = leaf // ARITY * ARITY
            run = self.nodes[self.at[depth][first : min(first + ARITY, self.count(depth))]]
            out.append((run[: leaf - first].tobytes(), run[leaf - first + 1 :].tobytes()))
            leaf //= ARITY
        return out


def packed(steps: list[tuple[bytes, bytes]]) -> bytes:
    """A path as bytes: for each level the number of siblings left and right, then they themselves."""
    return b"".join(bytes([len(a) // BYTES, len(b) // BYTES]) + a + b for a, b in steps)


def unpacked(path: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 0
    while at < len(path):
        a, b = path[at] * BYTES, path[at + 1] * BYTES
        out.append((path[at + 2 : at + 2 + a], path[at + 2 + a : at + 2 + a + b]))
        at += 2 + a + b
    return out


def folded(leaf: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its path give."""
    for left, right in steps:
        leaf = digest([left, leaf, right])
    return leaf


def counted(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[counted(c) for c in fields.values()]), 256))


def tree_of(lang: Column) -> Column:
    """A language's tree: empty for null, which comes first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """tree, doc_id, leaf and, where `tampered`, the leaf of the text with A-Z in lower case. Other columns aren't read."""
    own = {c: F.col(c) for c in FIELDS}
    changed = own | {"text": F.translate("text", UPPER, LOWER)}
    return docs.select(tree_of(F.col("lang")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(own).alias("leaf"), F.when(tampered, leaf_digest(changed)).alias("changed"))


def numbered(leaves: DataFrame, *order: str) -> DataFrame:
    """Adds `at`, a leaf's place in its tree, from 0, and `width`, the tree's leaves.

    A range sort by tree, order and row, so that neither a tree nor equal rows land in one task. Both steps are written,
    so that a task that runs again can't change a place. The rows of a tree before a partition are then added; that
    window sees one row a partition for each tree.
    """
    rows = written(leaves.withColumn("__row", F.monotonically_increasing_id()), "leaves")
    rows = rows.orderBy("tree", *order, "__row").withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    rows = written(rows.drop("__row"), "sorted")
    runs = rows.groupBy("tree", "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(W.partitionBy("tree").orderBy("__part")) - F.col("__n")
    runs = runs.select("tree", "__part", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(W.partitionBy("tree")).alias("width"))
    return rows.join(runs, ["tree", "__part"]).withColumn("at", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def built(nodes: DataFrame, level: int, deep: int) -> DataFrame:
    """The blocks of a level, from its nodes (tree, at, width, leaf)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        tree, block, width = (table.column(c)[0].as_py() for c in ("tree", "block", "width"))
        subtree = Subtree(width, block, deep)
        own = subtree.built(table.column("leaf").to_pylist())
        return pa.table({"tree": [tree], "level": pa.array([level], pa.int32()), "block": [block], "width": [width], "root": pa.array([own[:BYTES]], pa.binary()), "nodes": pa.array([own], pa.binary())})

    keyed = nodes.select("tree", F.expr(f"at div {ARITY**deep}").alias("block"), "at", "width", "leaf")
    return keyed.groupBy("tree", "block").applyInArrow(run, BLOCK)


@dataclass
class Forest:
    """Trees over numbered leaves: the blocks of each level, lowest first, and how many levels of hashing a block has."""

    leaves: DataFrame
    levels: list[DataFrame]
    deep: int

    @property
    def span(self) -> int:
        return ARITY**self.deep

    @property
    def tops(self) -> DataFrame:
        """tree and root. A tree's top is the one block of a level that fits in a block."""
        out = [blocks.where(F.col("width") <= self.span).select("tree", "root") for blocks in self.levels]
        whole = out[0]
        for more in out[1:]:
            whole = whole.unionAll(more)
        return whole


def planted(leaves: DataFrame, deep: int) -> Forest:
    """The trees of numbered leaves; each level's blocks are written. The longest tree's width goes through the driver."""
    width = leaves.agg(F.max("width")).first()[0] or 0
    levels, nodes, span = [], leaves, ARITY**deep
    while not levels or width > 1:
        blocks = written(built(nodes, len(levels), deep), "blocks")
        levels.append(blocks)
        width = -(-width // span)
        above = F.expr(f"(width + {span - 1}) div {span}")
        nodes = blocks.where(F.col("width") > span).select("tree", F.col("block").alias("at"), above.alias("width"), F.col("root").alias("leaf"))
    return Forest(leaves, levels, deep)


def met(blocks: DataFrame, members: DataFrame, deep: int, use: Callable[[Subtree, list, list[int], pa.Table, dict], dict], schema: str) -> DataFrame:
    """Members (tree, at and more) beside the block that holds them as leaves; `use` makes columns of them from the
    block's subtree, its path and their places in the block."""
    names = StructType.fromDDL(schema).fields
    kinds = {f.name: to_arrow_type(f.dataType) for f in names}
    span = ARITY**deep

    def run(own: pa.Table, block: pa.Table) -> pa.Table:
        made = {f.name: [] for f in names}
        if own.num_rows and block.num_rows:
            row = block.to_pylist()[0]
            places = [at % span for at in own.column("at").to_pylist()]
            made = use(Subtree(row["width"], row["block"], deep, row["nodes"]), unpacked(row["path"]), places, own, row)
        return pa.table([pa.array(made[f.name], kinds[f.name]) for f in names], names=list(kinds))

    keyed = members.withColumn("block", F.expr(f"at div {span}"))
    return keyed.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(run, schema)


def path_of(subtree: Subtree, path: list, places: list[int], own: pa.Table, _: dict) -> dict:
    return {c: own.column(c).to_pylist() for c in own.column_names} | {"path": [packed(subtree.steps(at) + path) for at in places]}


def with_paths(forest: Forest, above: DataFrame | None = None) -> DataFrame:
    """The lowest blocks with `path`, the siblings from each one's root up; `above` (tree, path) goes on from the tops.

    Level by level from the top, each block's leaves are the roots of the blocks below it.
    """
    down = None
    for k in range(len(forest.levels) - 1, -1, -1):
        blocks = forest.levels[k]
        top = blocks.where(F.col("width") <= forest.span)
        here = top.withColumn("path", F.lit(b"").cast("binary")) if above is None else top.join(above, "tree")
        if down is not None:
            below = met(down, blocks.where(F.col("width") > forest.span).select("tree", F.col("block").alias("at")), forest.deep, path_of, "tree string, at long, path binary")
            here = here.unionByName(blocks.join(below.withColumnRenamed("at", "block"), ["tree", "block"]))
        down = written(here, "paths") if k else here
    return down


def proved(subtree: Subtree, path: list, places: list[int], own: pa.Table, row: dict) -> dict:
    """A proof and the root that it gives for each leaf of a block."""
    out: dict[str, list] = {c.split()[0]: [] for c in PROVED.split(", ")}
    for at, doc, leaf, changed in zip(places, *(own.column(c).to_pylist() for c in ("doc_id", "leaf", "changed")), strict=True):
        steps = subtree.steps(at) + path
        found = folded(leaf if changed is None else changed, steps)
        made = (doc, leaf.hex(), row["subroot"].hex(), row["whole"].hex(), digest([x for both in steps for x in both]).hex(), found.hex(), found == row["whole"])
        for column, value in zip(out.values(), made, strict=True):
            column.append(value)
    return out


def verify(docs: DataFrame, tampered: Column, deep: int = LEVELS) -> DataFrame:
    """Builds the manifest of `docs`, a tree for each lang and one over their roots, and holds every row against it, with
    its text in lower case where `tampered`: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Every row is a leaf, repeated ones too. Leaves of a lang go by doc_id (null first), then by digest; a null lang has
    its own tree, before all others. Null fields are leaves' `-`. An empty table gives no rows. Only the five columns of
    documents are read. Paths through a tree's blocks meet its leaves block by block, 8**deep at a time.
    """
    forest = planted(numbered(document_leaves(docs, tampered), "doc_id", "leaf"), deep)
    tops = written(forest.tops, "tops")
    crown = planted(numbered(tops.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("leaf")), "key"), deep)
    above = met(with_paths(crown), crown.leaves.select("tree", "at", "key"), deep, path_of, "tree string, at long, key string, path binary")
    whole = crown.tops.select(F.col("root").alias("whole"))  # one row
    blocks = with_paths(forest, written(above.select(F.col("key").alias("tree"), "path"), "above"))
    blocks = blocks.join(tops.withColumnRenamed("root", "subroot"), "tree").join(F.broadcast(whole))
    return met(blocks, forest.leaves.drop("width"), deep, proved, PROVED)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `documents` as a leaf, its proof, and the root that it folds to; where 3 divides the crc32 of a row's
    doc_id its text's A-Z are in lower case by then. A null doc_id isn't tampered with. Other cases as in `verify`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    return verify(docs, F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False)))


# crc32 by its bits over the digits of an id; then each tree level by level, and each leaf's way up.
SQL = """
WITH RECURSIVE d AS (
  SELECT *, coalesce('=' || lang, '') AS tree, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS crc
  FROM documents
), e AS (
  SELECT row_number() OVER () AS r, doc_id, tree, coalesce(xor(crc, 4294967295) % 3 = 0, false) AS tampered,
    concat({doc_id}, {source}, {lang}, {n_chars}) AS head, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM d
), f AS (
  SELECT r, doc_id, tree, sha256(concat(head, {text})) AS leaf, CASE WHEN tampered THEN sha256(concat(head, {low})) ELSE sha256(concat(head, {text})) END AS given FROM e
), t AS (
  SELECT tree, 0 AS depth, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, leaf AS node FROM f
), up AS (
  SELECT * FROM t
  UNION ALL
  SELECT tree, depth + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM up) WHERE n > 1 GROUP BY tree, depth, pos // 8
), subroots AS (
  SELECT tree, max_by(node, depth) AS subroot, max(depth) AS depth FROM up GROUP BY tree
), top AS (
  SELECT 0 AS depth, row_number() OVER (ORDER BY tree) - 1 AS pos, subroot AS node FROM subroots
  UNION ALL
  SELECT depth + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY depth, pos // 8
), nodes AS (
  SELECT u.tree, u.depth, u.pos, u.node FROM up u JOIN subroots s USING (tree) WHERE u.depth < s.depth
  UNION ALL
  SELECT s.tree, s.depth + x.depth, x.pos, x.node FROM (SELECT *, row_number() OVER (ORDER BY tree) - 1 AS own FROM subroots) s, top x
), own AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos FROM f
), places AS (
  SELECT *, row_number() OVER (ORDER BY tree) - 1 AS place, (SELECT max(depth) FROM top) AS tops FROM subroots
), ways AS (
  SELECT o.r, o.doc_id, o.tree, o.leaf, o.given, p.subroot, p.depth + p.tops AS height, unnest(range(p.depth + p.tops)) AS depth, p.depth AS own_depth, o.pos, p.place FROM own o JOIN places p USING (tree)
), spots AS (
  SELECT *, CASE WHEN depth < own_depth THEN pos >> (3 * depth) ELSE place >> (3 * (depth - own_depth)) END AS spot FROM ways
), siblings AS (
  SELECT s.r, s.depth, coalesce(string_agg(n.node, '' ORDER BY n.pos) FILTER (n.pos < s.spot), '') AS a, coalesce(string_agg(n.node, '' ORDER BY n.pos) FILTER (n.pos > s.spot), '') AS b
  FROM spots s JOIN nodes n ON n.tree = s.tree AND n.depth = s.depth AND n.pos // 8 = s.spot // 8 GROUP BY s.r, s.depth
), steps AS (
  SELECT r, list(struct_pack(a := a, b := b) ORDER BY depth) AS path, string_agg(a || b, '' ORDER BY depth) AS proof FROM siblings GROUP BY r
), done AS (
  SELECT o.r, o.doc_id, o.leaf, p.subroot, (SELECT max_by(node, depth) FROM top) AS root, sha256(coalesce(s.proof, '')) AS proof_sha256,
    list_reduce(list_prepend(struct_pack(a := o.given, b := ''), coalesce(s.path, [])), lambda x, y: struct_pack(a := sha256(concat(y.a, x.a, y.b)), b := '')).a AS folded_root
  FROM own o JOIN places p USING (tree) LEFT JOIN steps s USING (r)
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM done
""".format(**{c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(octet_length(encode({c}::VARCHAR)), ':', {c}) END" for c in (*FIELDS, "low")})
