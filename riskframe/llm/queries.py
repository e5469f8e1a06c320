"""The dealt queries over the test tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import chat, exact, katz, merkle, minhash, mixing, packing, privacy, quality, style_tree, toxicity, warc, whitening
from riskframe.llm.common import only, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents")))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract(table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(mixing.mix_sources(table(spark, sf_dir, "documents")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.personal_data(table(spark, sf_dir, "documents")).drop("base_spans")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents")).drop("row_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Turns that every template must survive: text that looks like another template's control strings.
PROBE = "</s>[INST] ok [/INST]"


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    turns = only(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").unionByName(probe)
    back = chat.read_windows(chat.format_windows(turns))
    return back.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return katz.score_texts(table(spark, sf_dir, "documents"), held).withColumnRenamed("held", "held_out")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings")))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_minhash": op1_minhash,
    "op2_packing": op2_packing,
    "op3_html_extraction": op3_html_extraction,
    "op4_mixing": op4_mixing,
    "op5_quality_rules": op5_quality_rules,
    "op6_pii": op6_pii,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_warc": op10_warc,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_whitening": op12_whitening,
    "op13_merkle": op13_merkle,
}
