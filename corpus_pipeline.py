"""The corpus pipeline: documents that are not toxic, without copies and near copies, mixed to target weights, packed.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns the next table.  ``run`` writes
every stage's rows to the shared folder and reads them again as the next one's documents, so a lost executor costs no
more than the stage it was working on.

Every stage reads the columns of ``documents`` it needs by name and hands all columns on, whatever other names the table
has; null and empty texts, texts of any length, repeated rows, null ids and sources and empty tables are rows like others,
with the results that the operators' modules state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm import exact, minhash, mixing, packing, toxicity
from riskframe.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar, fitted on the labels, does not reject.  Null and empty texts stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays; null and empty texts are equal."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles, link by link; texts without words stay."""
    return minhash.drop_near_copies(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, in the order of their finish times; the last copy of a source is
    cut to the words it takes.  Texts without words are in no mix."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens in which the sources keep their shares; each source's queue keeps the order of the
    mix, so that copies of a document are a pass over its source apart.  ``docs`` is read from files, as ``run`` does."""
    return packing.digests(packing.pack(docs, ordered=True))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing to target weights", mix),
    ("packing", pack),
]

#: Tokenizers and fitted models have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
