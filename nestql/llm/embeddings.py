"""Near-duplicate vectors by p-stable locality-sensitive hashing, then exact cosines.

Unit vectors are projected on random Gaussian directions, shifted and cut in steps of ``WIDTH``; ``ROWS`` such numbers make
a bucket of a table, and there are ``TABLES`` tables. For unit vectors the Euclidean distance is a function of the cosine:
at 0.95 it is 0.316, one number agrees with probability 0.874, and a pair meets in some table with probability 0.97.
All pairs that meet are checked in double precision; a pair counts in the first table in which it meets.

A bucket may hold a third of all rows. In a bucket of over ``HOT`` vectors the one with the smallest id is its pivot.
Vectors at half the angle limit or less from a pivot are all linked with each other, by the triangle inequality: they
form a canopy, counted without comparing. Each vector belongs to one canopy at most; what is left of a hot bucket is
compared with it in blocks, the canopy's own vectors only once each.

Each dimension has its own projections and buckets, so only vectors of equal dimension meet.

Cases: vectors that are null, empty, zero, or hold null or non-finite parts link with nothing. Repeated rows with equal vec_id are rows of their own, and link if their vectors do. A null vec_id takes part;
its component is the smallest id that is there. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .memory import tidy, tidy_group
from .store import Scratch
from .textvec import BASE, U, mix

TABLES, ROWS, WIDTH, SEED = 28, 16, 2.0, 9
HOT, BLOCK = 1024, 1024


def hyperplanes(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.standard_normal((dim, TABLES * ROWS)), rng.uniform(0, WIDTH, TABLES * ROWS)


def keys(x: np.ndarray) -> np.ndarray:
    """A bucket number in each table for each row of unit vectors; the dimension is part of it."""
    a, b = hyperplanes(x.shape[1])
    q = np.floor((x @ a + b) / WIDTH).astype(np.int64).astype(U).reshape(len(x), TABLES, ROWS)
    out = np.broadcast_to(np.arange(TABLES, dtype=U) + U(TABLES * x.shape[1]), (len(x), TABLES))
    for j in range(ROWS):
        out = mix(out * U(BASE) + q[:, :, j])
    return out


def units(df: DataFrame) -> DataFrame:
    """vec_id, node (unique), unit (doubles) and keys; null unit and keys for a vector that links with nothing."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            unit, key = [None] * len(rows), [None] * len(rows)
            by: dict[int, list[int]] = {}
            for i, r in enumerate(rows):
                if r and None not in r:
                    by.setdefault(len(r), []).append(i)
            for ok in by.values():
                x = np.array([rows[i] for i in ok], np.float64)
                big = np.abs(x).max(axis=1, initial=0)
                fine = np.isfinite(big) & (big > 0)
                ok, x, big = np.array(ok, np.int64)[fine], x[fine], big[fine]
                x = x / big[:, None]
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                for i, u, k in zip(ok.tolist(), x, keys(x) if len(x) else [], strict=True):
                    unit[i], key[i] = u.tobytes(), k.astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(unit, pa.binary()), pa.array(key, pa.list_(pa.int64()))], names=["vec_id", "node", "unit", "keys"])

    df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("node"), F.col("embedding").cast("array<double>").alias("v"))
    return df.mapInArrow(run, "vec_id long, node long, unit binary, keys array<long>")


def angles(df: DataFrame, keep: list[str], schema: str) -> DataFrame:
    """keep and angle, between unit and pivot."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float64).reshape(n, -1) for c in ("unit", "pivot"))
            angle = 2 * np.arcsin(np.clip(np.sqrt(((x - y) ** 2).sum(axis=1)) / 2, 0, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(angle)], names=[*keep, "angle"])

    return df.select(*keep, "unit", "pivot").mapInArrow(run, f"{schema}, angle double")


def _one(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)


def united(root: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """root with the sets that links join made one: each number's smallest member that it reaches."""
    while True:
        a, b = root[r], root[c]
        open_ = a != b
        if not open_.any():
            return root
        r, c, a, b = r[open_], c[open_], a[open_], b[open_]
        low, root = np.minimum(a, b), root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root[root] != root).any():
            root = root[root]


def compare(threshold: float):
    """Links found in each task of each bucket: a count and one link of a spanning forest for each vector.

    A task's vectors of side 0 are compared with those of side 1, or with each other if there are none.
    """

    @tidy_group
    def run(table: pa.Table) -> pa.Table:
        node, canopy, side, spot, key = (table.column(c).to_numpy() for c in ("node", "canopy", "side", "spot", "key"))
        unit, sign = _one(table.column("unit")), _one(table.column("keys")).flatten().to_numpy().reshape(-1, TABLES)
        at = np.frombuffer(unit.buffers()[1], np.int32, count=len(unit) + 1, offset=4 * unit.offset)
        parts = np.frombuffer(unit.buffers()[2], np.float64, count=at[-1] // 8) if len(unit) else np.zeros(0)
        at, size = at[:-1] // 8, np.diff(at) // 8  # sizes differ if keys of two dimensions clash
        order = np.lexsort((size, spot, key))
        cuts = np.flatnonzero((np.diff(key[order]) != 0) | (np.diff(spot[order]) != 0) | (np.diff(size[order]) != 0)) + 1
        out: list[tuple[np.ndarray, ...]] = []
        for idx in np.split(order, cuts):
            if len(idx) < 2:
                continue
            x, s = parts[at[idx][:, None] + np.arange(size[idx[0]])], sign[idx]
            here = int(np.flatnonzero((s == key[idx[0]]).all(axis=0))[0])
            group, right = canopy[idx], np.flatnonzero(side[idx])
            cross = len(right) > 0
            left, right = (np.flatnonzero(side[idx] == 0), right) if cross else (np.arange(len(idx)), np.arange(len(idx)))
            count, root = np.zeros(len(idx), np.int64), np.arange(len(idx))
            for a in range(0, len(left), 256):
                i = left[a : a + 256]
                r, c = np.nonzero((x[i] @ x[right].T) >= threshold)
                r, c = i[r], right[c]
                ok = (group[r] != group[c]) | (group[r] < 0)
                if not cross:
                    ok &= r < c
                for t in range(here):  # a pair counts where it meets first
                    ok &= s[r, t] != s[c, t]
                r, c = r[ok], c[ok]
                count += np.bincount(r, minlength=len(idx)) + np.bincount(c, minlength=len(idx))
                root = united(root, r, c)
            has = np.flatnonzero(count)
            out.append((node[idx][has], count[has], node[idx][root[has]]))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("node", "links", "peer"), cols, strict=True)})

    return run


def near(df: DataFrame, threshold: float = 0.95, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of df (vec_id, embedding)."""
    spark = df.sparkSession
    scratch, limit = Scratch(spark, "embeddings"), math.acos(threshold)
    rows = scratch.write(units(df), "units")
    valid = rows.filter("unit is not null")
    placed = scratch.write(valid.select("vec_id", "node", F.explode("keys").alias("key")), "placed")
    size = placed.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("vec_id", "node")).alias("first")).filter("size > 1")
    size = scratch.write(size.select("key", "size", F.col("first.node").alias("first")), "sizes")
    large = size.filter(F.col("size") > hot)
    pivots = large.join(valid.select(F.col("node").alias("first"), F.col("unit").alias("pivot")), "first").select("key", "first", "pivot")
    near_pivot = placed.join(pivots, "key").join(valid.select("node", "unit"), "node")
    near_pivot = angles(near_pivot.filter("octet_length(unit) = octet_length(pivot)"), ["node", "first"], "node long, first long").filter(F.col("angle") <= limit / 2 - 1e-9)
    canopies = scratch.write(near_pivot.groupBy("node").agg(F.min("first").alias("canopy")), "canopies")
    inside = placed.join(size, "key").join(canopies, "node", "left").withColumn("canopy", F.coalesce("canopy", F.lit(-1)))
    inside = scratch.write(inside.select("key", "node", "size", "canopy"), "inside")
    # in a hot bucket: its main canopy, whose vectors are not compared with each other, and the others, which are loose
    top = inside.filter(F.col("size") > hot).groupBy("key", "canopy", "size").agg(F.count("*").alias("n"))
    top = top.groupBy("key", "size").agg(F.max(F.when(F.col("canopy") >= 0, F.struct("n", "canopy"))).alias("t"))
    main_n = F.coalesce("t.n", F.lit(0))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("int")
    top = top.select("key", F.coalesce("t.canopy", F.lit(-2)).alias("main"), parts(main_n).alias("mains"), parts(F.col("size") - main_n).alias("looses"), (F.col("size") > main_n).alias("some"))
    dealt = inside.join(top, "key", "left").filter(F.coalesce("some", F.lit(True)))
    task = lambda a, b, side: F.struct((a.cast("long") * (1 << 20) + b).alias("spot"), side.cast("int").alias("side"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("main") == F.col("canopy"), F.col("mains")).otherwise(F.col("looses"))).cast("int")
    dealt = dealt.withColumn("own", own)
    with_loose = F.transform(F.sequence(F.lit(0), F.col("looses") - 1), lambda q: task(F.least("own", q), F.greatest("own", q), F.col("own") > q))
    with_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda m: task(F.col("own"), F.lit(1 << 19) + m, F.lit(0)))
    as_main = F.transform(F.sequence(F.lit(0), F.col("looses") - 1), lambda p: task(p, F.lit(1 << 19) + F.col("own"), F.lit(1)))
    tasks = F.when(F.col("size") <= hot, F.array(F.struct(F.lit(-1).cast("long").alias("spot"), F.lit(0).alias("side"))))
    tasks = tasks.when(F.col("main") == F.col("canopy"), as_main).when(F.col("main") == -2, with_loose).otherwise(F.concat(with_loose, with_main))
    dealt = dealt.withColumn("task", F.explode(tasks)).select("key", "node", "canopy", "task.spot", "task.side").join(valid.select("node", "unit", "keys"), "node")
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.withColumn("bucket", F.when(F.col("spot") < 0, F.pmod(F.xxhash64("key"), F.lit(n))).otherwise(F.xxhash64("key", "spot")))
    found = scratch.write(dealt.groupBy("bucket").applyInArrow(compare(threshold), "node long, links long, peer long"), "found")
    sizes = canopies.groupBy("canopy").agg((F.count("*") - 1).alias("inner"), F.min("node").alias("least"))
    stars = canopies.join(sizes, "canopy")
    links = found.select("node", "links").union(stars.select("node", F.col("inner"))).groupBy("node").agg(F.sum("links").alias("n_links"))
    edges = found.select(F.col("node").alias("a"), F.col("peer").alias("b")).union(stars.select(F.col("node"), F.col("least")))
    comp = components(edges, scratch, "links")
    out = rows.select("vec_id", "node").join(links, "node", "left").join(comp, "node", "left")
    out = scratch.write(out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "node").alias("component")), "rows")
    least = out.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return out.join(least, "component").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
