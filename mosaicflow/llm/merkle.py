"""Merkle manifest of a dataset: a tree of digests for each language, their roots under one root, and a proof for every row.

Spark numbers the leaves of each language in order and cuts them into aligned blocks of 2 ** BLOCK_BITS, so a language of any
size is many tasks. DuckDB builds the levels of a block's tree in the executors, each by an ordered string_agg and a sha256.
Block roots are the leaves of the next tier, until one node of each language is left; those are numbered and built up in the
same way. Proofs come down again: a block's rows meet the one path of their block's root.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, discard, written

#: Nodes of a block are 2 ** this; a block's siblings take some MB.
BLOCK_BITS = 10
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
NODES = "tree string, pos long, node string, total long"
PATHS = "tree string, pos long, siblings array<string>, right array<boolean>, top string"


def digest(*parts: Column) -> Column:
    """SHA-256, in hex, of texts joined."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as a leaf holds it: - if null, else its bytes' number, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**instead: Column) -> Column:
    """The digest of a row of documents, with other values in place of those named."""
    return digest(*(field(instead.get(c, F.col(c))) for c in FIELDS))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with pos, from 0 in order within its group, and total, its group's rows; no group is one task's.

    Range partitions count their own rows of each group; sums of those counts, at most one row for each partition and group there, are added.
    """
    bound_batches(rows.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def count(batches):
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            out = []
            for g in batch.column(group).to_pylist():
                n = n + 1 if g == last else 0
                last = g
                out.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(out), pa.int32()), pa.array(out, pa.int64())], names=[*batch.schema.names, "part_", "in_part_"])

    # A table first: range partitions sample what they deal out, which else would be computed twice.
    rows = written(rows, "unsorted")
    found = written(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).mapInArrow(count, f"{schema}, part_ int, in_part_ long"), "sorted")
    discard(rows)
    counts = found.groupBy(group, "part_").agg(F.count("*").alias("n_"))
    whole = Window.partitionBy(group)
    counts = counts.select(group, "part_", (F.sum("n_").over(whole.orderBy("part_")) - F.col("n_")).alias("before_"), F.sum("n_").over(whole).alias("total"))
    return found.join(counts, [group, "part_"]).withColumn("pos", F.col("before_") + F.col("in_part_")).drop("part_", "in_part_", "before_")


@functools.lru_cache(maxsize=1)
def _engine():
    """One DuckDB in a worker, of one thread and bounded memory."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})


def height(total: int, bits: int) -> int:
    """Levels of a block in a tree of total nodes: all of them, unless the tree is this block alone."""
    return bits if total > 1 << bits else (total - 1).bit_length()


def block_root(block: pa.Table, levels: int) -> str:
    """The root of a block's (pos, node)."""
    return _levels(block, levels).execute("SELECT node FROM tree WHERE level = $1", [levels]).fetchall()[0][0]


def _levels(block: pa.Table, levels: int):
    """A connection with tree(level, pos, node) of a block."""
    con = _engine()
    con.register("leaves", block.select(["pos", "node"]))
    con.execute("CREATE OR REPLACE TEMP TABLE tree AS SELECT 0 AS level, pos, node FROM leaves").fetchall()
    con.unregister("leaves")
    for level in range(levels):
        con.execute("INSERT INTO tree SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM tree WHERE level = $1 GROUP BY level, pos // 2", [level]).fetchall()
    return con


def block_paths(block: pa.Table, levels: int) -> pa.Table:
    """(pos, siblings, right) of a block's nodes: their siblings from below upwards, null where a run is the node alone, and whether the node is the right one.

    Lists of no levels are null.
    """
    paths = _levels(block, levels).sql(
        """WITH n AS (SELECT pos, unnest(range(-1, $1)) AS l FROM tree WHERE level = 0)
        SELECT n.pos, list(s.node ORDER BY l) FILTER (l >= 0) AS siblings, list((n.pos >> greatest(l, 0)) % 2 = 1 ORDER BY l) FILTER (l >= 0) AS "right"
        FROM n LEFT JOIN tree AS s ON s.level = l AND s.pos = xor(n.pos >> greatest(l, 0), 1::BIGINT) GROUP BY n.pos ORDER BY n.pos""",
        params=[levels],
    )
    return paths.to_arrow_table()


class Manifest(NamedTuple):
    """Tiers of nodes, from the leaves to the root, as written tables of NODES: the tiers of languages, then those above."""

    leaves: DataFrame
    lower: list[DataFrame]
    upper: list[DataFrame]


def _tiers(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """nodes and the block roots above them, until every tree has one node."""

    def root(group: pa.Table) -> pa.Table:
        total, first = group.column("total")[0].as_py(), group.column("pos")[0].as_py()
        node = block_root(group, height(total, bits))
        return pa.table([group.column("tree").slice(0, 1), pa.array([first >> bits]), pa.array([node]), pa.array([max(1, -(-total >> bits))])], names=["tree", "pos", "node", "total"])

    tiers = [nodes.select("tree", "pos", "node", "total")]
    while True:
        block = F.shiftright("pos", bits)
        up = written(tiers[-1].groupBy("tree", block).applyInArrow(root, NODES), "merkle-tier")
        tiers.append(up)
        if not up.where("total > 1").limit(1).count():
            return tiers


def build(docs: DataFrame, bits: int = BLOCK_BITS, leaves: dict[str, Column] | None = None) -> Manifest:
    """The tree of docs, of FIELDS, whatever other columns there are; leaves adds columns to its rows.

    Rows of a lang stand by doc_id, null first, and by their digest where ids repeat; equal rows are a leaf each. A null lang is a language, the first one.
    Without rows there are no tiers but empty ones.
    """
    lang = F.col("lang").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string"), lang.alias("lang"), F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string"))
    rows = rows.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), leaf().alias("node"), *(c.alias(n) for n, c in (leaves or {}).items()))
    rows = written(numbered(rows, "tree", "doc_id", "node"), "merkle-leaves")
    lower = _tiers(rows, bits)
    roots = lower[-1].select("tree", "node").withColumns({"subtree": F.col("tree"), "tree": F.lit("all")})
    roots = written(numbered(roots, "tree", "subtree"), "merkle-roots")
    return Manifest(rows, lower, [roots, *_tiers(roots, bits)[1:]])


def _down(tier: DataFrame, above: DataFrame | None, bits: int, extra: str = "") -> DataFrame:
    """PATHS of a tier's nodes, from those of the tier above; extra names columns of the tier, with types, that come along."""
    names = [x.split()[0] for x in extra.split(", ")] if extra else []

    def run(block: pa.Table, outer: pa.Table) -> pa.Table:
        block = block.sort_by("pos").combine_chunks()
        own = block_paths(block, height(block.column("total")[0].as_py(), bits))
        sib, right, top = (outer.column(c)[0].as_py() for c in ("siblings", "right", "top"))
        siblings = pa.array([(x or []) + sib for x in own.column("siblings").to_pylist()], pa.list_(pa.string()))
        sides = pa.array([(x or []) + right for x in own.column("right").to_pylist()], pa.list_(pa.bool_()))
        columns = [block.column("tree"), block.column("pos"), siblings, sides, pa.array([top] * len(block)), *(block.column(n) for n in names)]
        return pa.table(columns, names=["tree", "pos", "siblings", "right", "top", *names])

    left = tier.groupBy(F.col("tree"), F.shiftright("pos", bits).alias("block"))
    return left.cogroup(above.groupBy(F.col("tree"), F.col("pos").alias("block"))).applyInArrow(run, PATHS + (f", {extra}" if extra else ""))


def proofs(made: Manifest, bits: int = BLOCK_BITS, extra: str = "") -> DataFrame:
    """(doc_id, leaf, siblings, right, subroot, root) of every leaf, with the extra columns that build() was given.

    siblings go from the leaf to the root, null where a node is alone in its run; right tells that the node is the right one of its run.
    """
    none = F.array().cast("array<string>"), F.array().cast("array<boolean>")
    top = made.upper[-1].select("tree", "pos", none[0].alias("siblings"), none[1].alias("right"), F.col("node").alias("top"))
    for k, tier in enumerate(reversed(made.upper[:-1])):
        is_last = k == len(made.upper) - 2
        top = written(_down(tier, top, bits, "subtree string, node string" if is_last else ""), "merkle-paths")
    # The root's own proof is each language's: its path goes on from there, with the language's root beside it.
    path = top.select(F.col("subtree").alias("tree"), F.lit(0).cast("long").alias("pos"), "siblings", "right", F.concat_ws(",", "node", "top").alias("top"))
    for tier in reversed(made.lower[1:-1]):
        path = written(_down(tier, path, bits), "merkle-paths")
    columns = "doc_id long, node string" + (f", {extra}" if extra else "")
    found = _down(made.leaves, path, bits, columns)
    names = [x.split()[0] for x in extra.split(", ")] if extra else []
    return found.select("doc_id", F.col("node").alias("leaf"), "siblings", "right", F.substring_index("top", ",", 1).alias("subroot"), F.substring_index("top", ",", -1).alias("root"), *names)


def folded(start: Column, siblings: Column, right: Column) -> Column:
    """The root that a leaf and its siblings give."""
    step = lambda at, s: F.sha2(F.when(s["right"], F.concat(F.coalesce(s["sibling"], F.lit("")), at)).otherwise(F.concat(at, F.coalesce(s["sibling"], F.lit("")))).cast("binary"), 256)
    return F.aggregate(F.arrays_zip(siblings.alias("sibling"), right.alias("right")), start, step)


def proof_digest(siblings: Column) -> Column:
    """The digest of all siblings, in order, as one short text for a proof."""
    return F.sha2(F.array_join(siblings, "").cast("binary"), 256)
