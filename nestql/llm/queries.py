"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embeddings, jaccard, langid, mixing, packing, quality, sql, sstable, suffix, toxicity
from .store import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), "prefix", end_id=2, capacity=1024)


def op2_sorted_string_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), "spaceless", end_id=2)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(table(spark, sf_dir, "conversations"), chat.tools(spark, sf_dir))


def tool_call_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on calls made from the table's turns, since the table holds none."""
    return chat.link(chat.rehearsal(table(spark, sf_dir, "conversations")), chat.TOOLS)


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_multiple_instance_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted", F.to_json("offending").alias("offending"))


def op7_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op8_line_field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.judge(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_p_stable_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op10_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), words=5, threshold=0.8).select("doc_id", "class_id", "n_links", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_sorted_string_table, op3_suffix_array_dedup, op4_tool_call_linking, op5_poisson_mixing, op6_multiple_instance_toxicity, op7_language_bitmask, op8_line_field_quality, op9_p_stable_embeddings, op10_lsh_forest_join, tool_call_statuses)}

ORACLES: dict[str, str] = {
    "op3_suffix_array_dedup": sql.SUFFIX_DEDUP,
    "op4_tool_call_linking": chat.ORACLE,
    "tool_call_statuses": chat.REHEARSAL,
    "op5_poisson_mixing": mixing.oracle(),
    "op9_p_stable_embeddings": sql.NEAR_VECTORS,
    "op10_lsh_forest_join": sql.JACCARD_JOIN,
}
