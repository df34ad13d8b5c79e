"""Connected components of a distributed list of links, without gathering anything anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """links: a, b (long). Returns node, component (the smallest node it reaches), for nodes with a link to another.

    Alternating star contraction: each round links every node to the smallest node in sight, from above (large star)
    and from below (small star), until nothing changes; the number of rounds grows with the logarithm of the size.
    A node's neighbours are reduced to their minimum with partial aggregation, but the links of a hub meet its minimum in one task
    unless AQE splits the join; a link is two numbers, whatever the documents' size.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = scratch.write(edges, f"{name}-0")
    last, turn = None, 0
    while True:
        turn += 1
        # large star: each node's larger neighbours point to the smallest of all its neighbours and itself
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.write(large.distinct(), f"{name}-l{turn}")
        # small star: a node and its smaller neighbours point to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        small = small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct()
        small = scratch.write(small, f"{name}-s{turn}")
        now = small.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        for old in (f"{name}-{turn - 1}" if turn == 1 else f"{name}-s{turn - 1}", f"{name}-l{turn}"):
            scratch.drop(old)
        if now == last:
            return small.select(F.col("a").alias("node"), F.col("b").alias("component"))
        edges, last = small, now
