"""Exact dedup through an extendible-hash index on shared files, with DataFrame functions only.

The directory starts at the depth that the number of keys asks for and doubles while a bucket holds more keys than its
capacity; only overfull buckets split.  A row's leading key bits are its slot, the slot names its bucket, and a bucket is a
range of keys with one owner task.  Copies are combined by their bytes on their way (a few salted rows are left of a group of
any size); the owner puts the texts of its buckets in order, compares each with the one before it in the chain of its key,
and writes an entry per distinct text: bucket, key, place in the chain, digest, smallest row, rows.  Rows then look their
entry up through the directory again, by bucket, key and digest.

Null text counts as empty, and all empty texts are equal; texts of any length are compared whole.  Of rows that repeat the
smallest doc_id of a group, one stays.  A null doc_id sorts before all others.  An empty table gives an empty result.
Columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import SPACE, text_or_empty, written

#: Keys that a bucket holds before it splits.
CAPACITY = 5_000
#: Rows that are left of a group of copies before they move to the bucket's owner.
SALTS = 8
#: Directory slots up to which the directory goes to every task.
MOST_SENT = 1 << 20


def normal_text(name: str = "text") -> Column:
    """Text with every run of white space as one space."""
    return F.regexp_replace(text_or_empty(name), SPACE, " ")


def slot_of(depth: int) -> Column:
    """Leading bits of the key: its slot in a directory of this depth."""
    return F.shiftrightunsigned(F.col("key"), 64 - depth) if depth else F.lit(0).cast("long")


def directory(entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(slot, bucket, depth) rows for every slot in use, and the global depth as ``global_depth``."""
    keys = entries.select("key").distinct()
    depth = max(0, (keys.count() // capacity).bit_length())
    leaves, open_slots = None, None
    while True:
        rows = keys if open_slots is None else keys.withColumn("parent", slot_of(depth - 1)).join(open_slots, "parent", "left_semi")
        counted = written(rows.groupBy(slot_of(depth).alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "buckets")
        over = F.col("n") > capacity
        full = counted.where(over if depth < 63 else F.lit(False))
        level = counted.where(~over if depth < 63 else F.lit(True)).select("bucket", F.lit(depth).alias("depth"))
        leaves = level if leaves is None else leaves.unionByName(level)
        if full.isEmpty():
            break
        open_slots = full.select(F.col("bucket").alias("parent"))
        depth += 1
    spread = F.lit(depth) - F.col("depth")
    first = F.call_function("shiftleft", F.col("bucket"), spread)
    last = F.call_function("shiftleft", F.col("bucket") + 1, spread) - 1
    return leaves.select(F.explode(F.sequence(first, last)).alias("slot"), "bucket", "depth", F.lit(depth).alias("global_depth"))


def placed(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """The rows that the directory has a slot for, with their bucket (first slot and depth)."""
    named = slots.select("slot", F.struct("bucket", "depth").alias("bucket"))
    named = F.broadcast(named) if 1 << depth <= MOST_SENT else named
    return rows.withColumn("slot", slot_of(depth)).join(named, "slot").drop("slot")


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(rows, index).  rows: row_id, doc_id, key, sha, bucket.  index: bucket, key, chain, sha, keep_id, keep_row, group_size."""
    texts = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), normal_text().alias("body"))
    rows = written(texts.select("row_id", "doc_id", F.xxhash64("body").alias("key"), F.unhex(F.sha2("body", 256)).alias("sha")), "rows")
    slots = written(directory(rows, capacity), "directory")
    depth = slots.agg(F.max("global_depth")).first()[0] or 0
    least, n = F.min(F.struct("doc_id", "row_id")).alias("least"), F.count(F.lit(1)).alias("n")
    bodies = placed(texts.withColumn("key", F.xxhash64("body")), slots, depth).withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)))
    few = bodies.groupBy("bucket", "key", "body", "salt").agg(least, n)
    # the owner of a bucket: its chains in order of key and bytes
    owned = few.repartition("bucket")
    chain = Window.partitionBy("bucket", "key").orderBy("body")
    told = owned.withColumn("new", F.when(F.col("body") == F.lag("body").over(chain), 0).otherwise(1))
    told = told.withColumn("chain", F.sum("new").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    digest = F.when(F.col("new") == 1, F.unhex(F.sha2("body", 256)))
    entries = told.select("bucket", "key", "chain", digest.alias("sha"), "least", "n")
    entries = entries.groupBy("bucket", "key", "chain").agg(F.first("sha", ignorenulls=True).alias("sha"), F.min("least").alias("least"), F.sum("n").alias("n"))
    index = written(entries.select("bucket", "key", "chain", "sha", "least.*", "n").toDF("bucket", "key", "chain", "sha", "keep_id", "keep_row", "group_size"), "index")
    twins = index.where("chain > 1").groupBy("bucket", "key", "sha").count().where("count > 1")
    if not twins.isEmpty():
        raise ValueError("two texts share a key and a SHA-256 digest")
    return placed(rows, slots, depth), index


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: row_id, doc_id, keep_id, group_size, kept, text_sha256."""
    rows, index = build_index(docs, capacity)
    found = rows.join(index.drop("chain"), ["bucket", "key", "sha"])
    return found.select(
        "row_id", "doc_id", "keep_id", "group_size",
        (F.col("row_id") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows that stay, with the columns of the input."""
    found = exact_dedup(docs, capacity)
    stays = written(found.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")), "stays")
    again = found.groupBy("doc_id", "text_sha256").count().where("count > 1").isEmpty()
    marked = docs.withColumn("_sha2", F.sha2(normal_text(), 256))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_sha2") == F.col("_sha"))
    kept = marked.join(stays, same, "left_semi")
    return (kept if again else kept.dropDuplicates(["doc_id", "_sha2"])).drop("_sha2")
