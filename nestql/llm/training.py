"""Bounded samples of labelled documents, for the models that are trained here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out() -> Column:
    """Rows that no model may learn labels from: crc32 of the id as text is 1 modulo 3. A null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> list[tuple[str, object]]:
    """At most rows (text, label) that aren't held out, the first in the order of a hash of the id.

    The choice is made on ids and labels alone; only the texts chosen are read to the end and reach the driver.
    """
    chosen = labels.select("doc_id", F.col(label).alias("_label")).filter(F.col("_label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = chosen.orderBy(F.xxhash64(F.col("doc_id").cast("long"), F.lit(11)), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").filter("text is not null")
    got = texts.join(chosen, "doc_id").orderBy(F.xxhash64(F.col("doc_id").cast("long"), F.lit(11)), "doc_id", "text").limit(rows)
    return [(r["text"], r["_label"]) for r in got.select("text", "_label").collect()]


def sample_each(docs: DataFrame, label: str, rows: int, least: int) -> tuple[list[tuple[str, object]], list[object]]:
    """Rows (text, label) that aren't held out, dealt evenly to the labels, and the labels, most frequent first.

    Each label has its own first ids in the order of a hash; turn by turn a label gives one more, until there are rows, or
    least of each label if that is more. Of rows that agree in id and label one is chosen.
    """
    named = docs.select("doc_id", "text", F.col(label).alias("_label")).filter(F.col("_label").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    ids = named.select("doc_id", "_label")
    counts = ids.groupBy("_label").count().collect()
    labels = [r["_label"] for r in sorted(counts, key=lambda r: (-r["count"], str(r["_label"])))]
    top = max(rows, least * len(labels))
    turn = F.xxhash64(F.col("doc_id").cast("long"), F.lit(11))
    ids = ids.distinct().withColumn("_n", F.row_number().over(Window.partitionBy("_label").orderBy(turn, "doc_id"))).filter(F.col("_n") <= top)
    chosen = ids.orderBy("_n", turn, "doc_id", "_label").limit(top)
    got = named.join(chosen, ["doc_id", "_label"]).withColumn("_c", F.row_number().over(Window.partitionBy("doc_id", "_label").orderBy("text"))).filter("_c = 1")
    return [(r["text"], r["_label"]) for r in got.select("text", "_label", "_n").orderBy("_n", "_label").collect()], labels
