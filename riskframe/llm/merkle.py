"""Merkle manifest of a table: a leaf per row, a tree per group, a tree over the groups, a proof per row.

Concatenated-level strings: an aligned block of 256 nodes keeps each of its levels as one string of hex digests.  A
parent is the hash of a fixed-width substring of the level below, the siblings of a node are the substrings that flank
it in its run of 16, and the roots of the blocks are the nodes of the next round.  Rows get their places by one range
shuffle of digests; texts are read once and never moved.

Defined results: null columns are written ``-``; an empty text is ``0:``; texts of any length cost one hash; a null key
sorts first; rows that share a key are ordered by leaf, and exact copies are interchangeable; an empty table gives no
rows; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import only, written

FANOUT = 16
BLOCK = FANOUT * FANOUT
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def placed(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``pos`` (place in the group ``grp``, from 0) and ``size`` (nodes of the group).

    One range shuffle sorts the table by group and ``order``; a row's number in its partition and the counts of the
    group's earlier partitions give its place, so a group of any size stays spread over partitions.  Rows that agree in
    all of ``order`` are cut apart by the number of their input row.
    """
    width = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["grp", *order, "_tie"]
    ranged = nodes.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(width, *keys)
    ranged = ranged.sortWithinPartitions(*keys).drop("_tie")
    numbered = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "placed")
    numbered = numbered.withColumn("_part", F.shiftright("_at", 33))
    parts = numbered.groupBy("grp", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy("grp")
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        "grp",
        "_part",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(group).alias("size"),
    )
    joined = numbered.join(starts, ["grp", "_part"])
    return joined.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def parents(level: Column) -> Column:
    """The level above: one digest per run of 16 digests of this level."""
    width = FANOUT * HEX
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / width).cast("int"))
    return F.array_join(F.transform(runs, lambda r: F.sha2(F.substring(level, r * width + 1, F.lit(width)), 256)), "")


def blocks_of(nodes: DataFrame, payload: Sequence[str]) -> DataFrame:
    """One row per aligned block of 256 nodes: its members in order, its two lower levels as strings, and its root.

    A group of one node is its own root; groups of at most 16 stop after one level.
    """
    member = F.struct("pos", "node", *payload)
    gathered = nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        F.first("size").alias("size"), F.array_sort(F.collect_list(member)).alias("members")
    )
    lowest = gathered.withColumn("level0", F.array_join(F.transform("members", lambda m: m["node"]), ""))
    upper = lowest.withColumn("level1", F.when(F.col("size") > 1, parents(F.col("level0"))))
    root = F.when(F.col("size") > FANOUT, parents(F.col("level1"))).when(F.col("size") > 1, F.col("level1"))
    return upper.withColumn("root", F.coalesce(root, F.col("level0")))


def flanks(level: Column, at: Column) -> Column:
    """The rest of the run of the node ``at`` of a level: digests to its left and to its right."""
    inside = at % FANOUT
    run = F.substring(level, (at - inside) * HEX + 1, F.lit(FANOUT * HEX))
    return F.struct(
        F.substring(run, F.lit(1), inside * HEX).alias("left"),
        F.substring(run, (inside + 1) * HEX + 1, F.lit(FANOUT * HEX)).alias("right"),
    )


def climb(nodes: DataFrame, payload: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The blocks of all nodes, and for each block the path above it and the root of its group.

    Block roots are the nodes of the next round, a 256th in number, until every group is one block; only the size of
    the largest group comes to the driver.
    """
    blocks = written(blocks_of(nodes, payload), "blocks")
    own = blocks.select("grp", "block", F.array().cast(PATH).alias("path"), F.col("root").alias("top"), "size")
    largest = blocks.agg(F.max("size")).first()[0] or 0
    if largest <= BLOCK:
        return blocks, own.drop("size")
    roots = blocks.where(F.col("size") > BLOCK).select(
        "grp",
        F.col("block").alias("pos"),
        F.ceil(F.col("size") / BLOCK).alias("size"),
        F.col("root").alias("node"),
    )
    higher = unfold(*climb(roots, []))
    small = own.where(F.col("size") <= BLOCK).drop("size")
    return blocks, small.unionByName(higher.select("grp", F.col("pos").alias("block"), "path", "top"))


def unfold(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """One row per node: its group, place and payload, the siblings on its way up level by level, and the top."""

    def row(member: Column, at: Column) -> Column:
        first = F.when(F.col("size") > 1, F.array(flanks(F.col("level0"), at)))
        second = F.when(F.col("size") > FANOUT, F.array(flanks(F.col("level1"), F.floor(at / FANOUT).cast("int"))))
        none = F.array().cast(PATH)
        own = F.concat(F.coalesce(first, none), F.coalesce(second, none))
        return F.struct(member.alias("member"), own.alias("own"))

    joined = blocks.join(above, ["grp", "block"])
    rows = joined.select("grp", "path", "top", F.inline(F.transform("members", row)))
    return rows.select("grp", "member.*", F.concat("own", "path").alias("path"), "top")


def manifest(leaves: DataFrame, key: str, group: str, payload: Sequence[str] = ()) -> DataFrame:
    """Tree over ``leaves`` (columns ``key``, ``group``, ``leaf`` and the payload): one row per leaf with its subroot,
    the root over all groups (null group first, then by UTF-8 bytes), and ``path``, the siblings level by level."""
    nodes = leaves.select(
        F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("-")).alias("grp"),
        F.col("leaf").alias("node"),
        F.col(key).alias("key"),
        *payload,
    )
    blocks, above = climb(placed(written(nodes, "leaves"), ["key", "node"]), ["key", *payload])
    tops = above.where("block = 0").select(F.lit("all").alias("grp"), F.col("grp").alias("of"), F.col("top").alias("node"))
    groups = unfold(*climb(placed(tops, ["of"]), ["of"])).select(
        F.col("of").alias("grp"), F.col("path").alias("_rest"), F.col("top").alias("root")
    )
    whole = above.join(groups, "grp").withColumn("path", F.concat("path", "_rest")).drop("_rest")
    roots = whole.select("grp", "block", "path", F.struct("top", "root").alias("top"))
    return unfold(blocks, roots).select(
        F.col("key").alias(key),
        F.col("node").alias("leaf"),
        *payload,
        F.col("top.top").alias("subroot"),
        F.col("top.root").alias("root"),
        "path",
    )


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def document_manifest(docs: DataFrame) -> DataFrame:
    """Manifest of ``documents`` by source, and what a check of every fifth hashed document finds when its text was
    changed to lower case."""
    rows = only(docs, *COLUMNS)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    changed = leaf([lower if c == "text" else F.col(c) for c in COLUMNS])
    leaves = rows.select(
        "doc_id", "source", leaf([F.col(c) for c in COLUMNS]).alias("leaf"), F.when(touched, changed).alias("changed")
    )
    found = manifest(leaves, "doc_id", "source", ["changed"])
    again = found.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    return again.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
