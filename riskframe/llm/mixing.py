"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source is a queue of its documents in shuffled (hash) order, repeated while its target asks for more.  A document
finishes at virtual time (source words up to and with it) / (target words of the source): all queues drain side by side
at rates proportional to their targets.  The mix is the global order of these finish times, cut at the total budget.

Null text has no words.  A null source is a source of its own, last in order.  Repeated rows are documents of their
own; rows that share a doc_id are drawn to one place of their queue.  A text of any length is one entry.  An empty table
gives an empty mix.  Columns other than doc_id, source and text, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import cells_for, running_sum, text_or_empty, words, written

#: Times that a document may enter the mix.
MOST_COPIES = 3


def cyclic_weight(rank: Column, period: int = 3) -> Column:
    """Weights 1, 2, ..., period, repeating over the sources in code point order."""
    return (rank - 1) % period + 1


def source_targets(sizes: DataFrame, weight: Callable[[Column], Column], most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, size) rows: weights share all words, no source above ``most`` times
    its size, excess shared again by weight.

    With sources in order of most * size / weight, the share of the rest per weight after the first k are full is
    ``rest / weights left``; the first source below its limit at that share tells the level for all.  The rows of this
    table are sources, of which a corpus has few.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("weight", weight(F.row_number().over(by_name)))
    limit = F.col("source_size") * most
    fill = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum(limit).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum(
        "weight"
    ).over(fill.rowsBetween(0, Window.unboundedFollowing))
    filled = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= limit)
    share = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(
        fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.coalesce(F.least(limit.cast("double"), share * F.col("weight")), limit.cast("double"))
    return filled.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame, weight: Callable[[Column], Column] = cyclic_weight, most: int = MOST_COPIES, seed: int = 42
) -> DataFrame:
    """One row per document and copy in the mix: row_id, doc_id, source, size, source_size, target, copy, taken,
    finish (virtual time), position (words of the mix before it), tie (hash of the text).  Documents the mix leaves out have one row with
    copy null and taken 0.  Only the last copy of a source that reaches its target is cut."""
    spark = docs.sparkSession
    text = text_or_empty()
    narrow = written(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.size(words(text)).cast("long").alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("shuffle"),
            F.xxhash64(text).alias("tie"),
        ),
        "mix",
    )
    cells = cells_for(narrow.count())
    budget = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget")).first()["budget"]
    targets = written(source_targets(narrow, weight, most).withColumn("queue", F.xxhash64("source", F.col("source").isNull())), "targets")
    queued = (
        narrow.withColumn("queue", F.xxhash64("source", F.col("source").isNull()))
        .withColumn("cell", F.floor(F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("double") * cells / 2**32).cast("long"))
        .drop("source")
    )
    order = [F.col("shuffle"), F.col("doc_id"), F.col("tie"), F.col("row_id")]
    queued = running_sum(queued, ["queue"], "cell", order, "size", "before").join(targets, "queue")
    goal = F.floor("target").cast("long")
    start = F.col("before") + F.col("copy") * F.col("source_size")
    copies = (
        queued.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
        .withColumn("served", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - start)))
        .withColumn("finish", F.least(goal, start + F.col("size")) / F.greatest(F.col("target"), F.lit(1.0)))
        .where((F.col("copy") == 0) | (F.col("served") > 0))
        .withColumn("lane", F.lit(0))
        .withColumn("cell", F.when(F.col("served") > 0, F.least(F.lit(cells - 1), F.floor(F.col("finish") * cells))).otherwise(F.col("cell") % cells))
    )
    copies = running_sum(copies, ["lane"], "cell", [F.col("finish"), F.col("queue"), F.col("copy"), *order], "served", "position")
    taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("served"), F.lit(budget).cast("long") - F.col("position")))
    return copies.select(
        "row_id", "doc_id", "source", "size", "source_size", "target",
        F.when(taken > 0, F.col("copy")).alias("copy"), taken.alias("taken"), "finish", "position", "tie",
    )


def mixed_sizes(mix: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    return mix.groupBy("row_id").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("size").alias("size"),
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.sum("taken").alias("taken"),
    ).drop("row_id")


def mixed_documents(docs: DataFrame, weight: Callable[[Column], Column] = cyclic_weight, most: int = MOST_COPIES, seed: int = 42) -> DataFrame:
    """The mix as documents, with the columns of the input: a row for each copy taken, in the order of the mix (by range
    over partitions, sorted in each, so that a written table keeps it).  A cut copy ends with the last word it takes, and
    ``n_chars``, where there is one, is counted again."""
    mix = mix_sources(docs, weight, most, seed).where("taken > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("tie").alias("_mark"), "taken", "position"
    )
    # Rows that repeat a document in every respect that counts are one entry with several copies here, so that each
    # copy of the mix meets one row of the input.
    same = ["_id", "_source", "_size", "_mark"]
    wanted = mix.groupBy(*same).agg(F.sort_array(F.collect_list(F.struct("taken", "position")), asc=False).alias("_copies"))
    text = text_or_empty()
    rows = docs.withColumn("_tie", F.xxhash64(text))
    repeats = rows.groupBy(F.col("doc_id").cast("long").alias("_i"), F.col("source").cast("string").alias("_s"), "_tie").count().where("count > 1")
    if not repeats.isEmpty():
        rows = rows.dropDuplicates(["doc_id", "source", "_tie"])
    match = (
        F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
        & F.col("source").cast("string").eqNullSafe(F.col("_source"))
        & (F.col("_tie") == F.col("_mark"))
    )
    copies = rows.join(wanted, match).withColumn("_copy", F.explode("_copies"))
    copies = copies.withColumn("_taken", F.col("_copy.taken")).withColumn("_at", F.col("_copy.position"))
    # Pieces of a word and the space before it.
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("_taken").cast("int")), "")
    short = F.col("_taken") < F.col("_size")
    out = copies.withColumn("_text", F.when(short, cut).otherwise(F.col("text")))
    out = out.repartitionByRange("_at", "_mark").sortWithinPartitions("_at", "_mark")
    swap = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        swap["n_chars"] = F.when(short, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[swap.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
