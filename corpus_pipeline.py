"""A corpus from documents to packed sequences, in five stages.

Each stage works on all that its predecessor kept, and returns the columns of documents, but for the last, which returns the
pieces of sequences. Nulls, empty texts, repeated rows and empty tables are treated as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nestql.llm import jaccard, langid, mixing, packing, suffix
from nestql.llm.queries import tokenizer
from nestql.llm.store import Scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    return langid.known(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return jaccard.one_each(docs, words=5, threshold=0.8)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a smaller doc_id holds too are cut out; every document stays."""
    return suffix.without_repeats(docs)


def poisson_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources of equal weight, as many characters as there are, in a global random order; copies share a doc_id."""
    return mixing.repeated(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), "prefix", end_id=2, capacity=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("suffix_dedup", suffix_dedup),
    ("poisson_mixing", poisson_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the tokenizer, the filters or the suffix order; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs, name)
    return docs
