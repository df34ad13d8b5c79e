"""Similarity join on word shingles: a MinHash LSH forest, then exact verification.

The forest has ``TREES`` prefix tries. A document's label in a trie is ``DEPTH`` MinHash values; documents whose labels begin alike
share a path, and the longer it is, the more alike they are. Prefixes are shortened, from ``DEPTH`` values down, until a
pair at the threshold shares one in some trie with the target recall, 1 - (1 - t^d)^TREES (d is 5 at 0.8).

1. The tries are dealt out by their upper levels: documents that share the shortest prefix in use meet. Those that meet, directly or
   through others, form a group. A group of over ``LARGE`` documents (a chain of boilerplate, say) isn't one place of work:
   there each prefix is, and a pair counts in the first trie in which it meets.
2. In each place the labels of each trie are sorted. Neighbours' common prefixes give those of all pairs; from the longest to
   the shortest in use, pairs that meet are verified by their shingles, each once, until the target depth or until all
   have met. Pairs that share no prefix in use are never compared.

Work is dealt in blocks of bounded weight, large places in pairs of blocks; only counts and a spanning forest of the links
leave a block. Documents with the same shingle set are one node with a multiplicity, so copies are never compared.

Cases: a text of fewer than ``words`` words, but at least one, has one shingle of all its words; a null, empty or blank
text links with nothing. A null doc_id takes part; a class without any id has a null class_id. Repeated rows link with
each other, and of rows that agree in doc_id and text one stays. An empty table gives no rows. Other columns don't matter,
whatever their names. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .memory import tidy, tidy_group
from .store import Scratch, small_batches
from .textvec import BASE, U, grouped, mix, shingles

TREES, DEPTH, RECALL = 24, 8, 0.9999
#: Shingles and documents in a block, and bytes of text hashed at once. Documents of a group that is one place of work.
BLOCK_SHINGLES, BLOCK_DOCS, SLICE, LARGE = 500_000, 512, 1 << 20, 4096


def depth_for(threshold: float, trees: int = TREES, deepest: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold is found with the recall asked for."""
    d = deepest
    while d > 1 and 1 - (1 - threshold**d) ** trees < recall:
        d -= 1
    return d


def signature(s: np.ndarray, n: int, of: int = DEPTH) -> np.ndarray:
    """MinHash values of a set of hashes: of n, the first of each DEPTH."""
    a = (mix(np.arange(1, n + 1, dtype=U) * U(BASE)) | U(1)).reshape(-1, DEPTH)[:, :of].ravel()
    best = np.full(len(a), ~U(0))
    for i in range(0, len(s), 1024):
        np.minimum(best, (s[i : i + 1024, None] * a).min(axis=0), out=best)
    return mix(best)


def labels(s: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """The first depth values of the label in each trie, each as 16 bits."""
    # a trie's values stay the same whatever the depth
    return (signature(s, trees * DEPTH, depth) >> U(48)).astype(np.uint16).reshape(trees, depth)


def prefixes(label: np.ndarray) -> np.ndarray:
    """A key for each trie: its number and the values of the label."""
    key = np.arange(len(label), dtype=U)
    for j in range(label.shape[1]):
        key = mix(key * U(BASE) + label[:, j])
    return key


def _encode(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def nodes(docs: DataFrame, words: int, depth: int) -> DataFrame:
    """doc_id, text_hash, node (0 if there is no word), n_shingles, keys: a row for each document."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, node, size, keys = _encode(batch.column(2).to_pylist()), [], [], []
            for a, b in grouped(texts, SLICE):
                for s in shingles(texts[a:b], words):
                    size.append(len(s))
                    node.append(int((mix(s).sum() + U(len(s))).astype(np.int64)) if len(s) else 0)
                    keys.append(prefixes(labels(s, TREES, depth)).astype(np.int64) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "node", "n_shingles", "keys"],
            )

    small_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    docs = docs.toDF(*names).select(doc_id.cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return docs.mapInArrow(run, "doc_id long, text_hash long, node long, n_shingles long, keys array<long>")


def sets(docs: DataFrame, words: int) -> DataFrame:
    """node, grp, tree, blocks, copies, set and label of each member, from docs that carry those and text."""
    keep = ["node", "grp", "tree", "blocks", "copies"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out, label = _encode(batch.column("text").to_pylist()), [], []
            for a, b in grouped(texts, SLICE):
                for s in shingles(texts[a:b], words):
                    out.append(s.tobytes())
                    label.append(labels(s, TREES, DEPTH).astype(">u2").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.binary()), pa.array(label, pa.binary())], names=[*keep, "set", "label"])

    return docs.select(*keep, "text").mapInArrow(run, "node long, grp long, tree int, blocks int, copies long, set binary, label binary")


def meetings(label: np.ndarray, place: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of documents of the same place: the longest prefix that they share in a trie, 0 if it is shorter than the
    shortest, and the first trie in which they share one. label: bytes, a row for each document."""
    n = len(label)
    long, first = np.zeros((n, n), np.int8), np.full((n, n), -1, np.int8)
    for t in range(TREES):
        own = np.ascontiguousarray(label[:, 2 * DEPTH * t : 2 * DEPTH * (t + 1)])
        halves = own.view(">u8").astype(U)
        order = np.lexsort((halves[:, 1], halves[:, 0], place))
        values = own.view(np.uint16)[order]
        common = np.cumprod(values[1:] == values[:-1], axis=1).sum(axis=1)
        common[place[order][1:] != place[order][:-1]] = 0
        # the trie's nodes are stretches of the order: what two share is the least of what neighbours between them share
        at, low = np.flatnonzero(common >= shortest), common[common >= shortest]
        far = 1
        while len(at):
            i, j = order[at], order[at + far]
            i, j = np.minimum(i, j), np.maximum(i, j)
            first[i, j] = np.where(first[i, j] < 0, t, first[i, j])
            long[i, j] = np.maximum(long[i, j], low)
            on = at + far < len(common)
            at, low = at[on], low[on]
            low = np.minimum(low, common[at + far])
            at, low = at[low >= shortest], low[low >= shortest]
            far += 1
    return long, first


class Sets:
    """Sets of hashes, for counting what one has in common with others."""

    def __init__(self, sets_: list[np.ndarray]):
        flat, inverse = np.unique(np.concatenate(sets_), return_inverse=True)
        self.size = np.array([len(s) for s in sets_])
        self.begin = np.cumsum(self.size) - self.size
        self.cat, self.mark = inverse.astype(np.int32), np.zeros(len(flat), np.int8)

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        own = self.cat[self.begin[i] : self.begin[i] + self.size[i]]
        self.mark[own] = 1
        if 4 * len(others) > len(self.size):
            out = np.add.reduceat(self.mark[self.cat], self.begin, dtype=np.int64)[others]
        else:
            size = self.size[others]
            at = np.cumsum(size) - size
            spots = np.repeat(self.begin[others] - at, size) + np.arange(size.sum())
            out = np.add.reduceat(self.mark[self.cat[spots]], at, dtype=np.int64)
        self.mark[own] = 0
        return out


def compare(threshold: float, shortest: int):
    """For the rows of a bucket: links counted for each node, and a link of a spanning forest (to itself if none)."""

    @tidy_group
    def run(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_numpy() for c in ("node", "grp", "tree", "p", "q", "own", "copies")}
        raw, label = table.column("set"), table.column("label")
        order = np.lexsort((col["node"], col["q"], col["p"], col["tree"], col["grp"]))
        tag = np.stack([col[c][order].astype(np.int64) for c in ("grp", "tree", "p", "q")])
        fresh = np.append(True, (tag[:, 1:] != tag[:, :-1]).any(axis=0))
        order, fresh = order[keep := fresh | np.append(True, np.diff(col["node"][order]) != 0)], fresh[keep]  # repeated rows come more than once
        place = np.cumsum(fresh) - 1
        # small places are compared together
        cuts = np.flatnonzero(fresh)
        ends, starts = np.append(cuts[1:], len(order)), []
        weight = np.append(0, np.cumsum(pc.binary_length(raw).to_numpy()[order] // 8))
        for a, b in zip(cuts.tolist(), ends.tolist(), strict=True):
            if not starts or b - starts[-1] > BLOCK_DOCS or weight[b] - weight[starts[-1]] > BLOCK_SHINGLES:
                starts.append(a)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for part in np.split(np.arange(len(order)), starts[1:]):
            if len(part) < 2:
                continue
            idx, spot = order[part], place[part]
            names = np.stack([np.frombuffer(label[int(i)].as_py(), np.uint8) for i in idx])
            long, first = meetings(names, spot, shortest)
            if not long.any():
                continue
            members = Sets([np.frombuffer(raw[int(i)].as_py(), U) for i in idx])
            node, copies, size = col["node"][idx], col["copies"][idx], members.size
            own, cross = col["own"][idx], col["p"][idx] != col["q"][idx]
            tree = col["tree"][idx]
            open_ = (long > 0) & ((tree[:, None] < 0) | (first == tree[:, None])) & (~cross[:, None] | (own[:, None] != own[None, :]))
            open_ &= np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :]) - 1e-9
            count, root = np.zeros(len(idx), np.int64), np.arange(len(idx))
            for depth in range(DEPTH, shortest - 1, -1):  # shorten the prefixes, until all that can have met
                if not open_.any():
                    break
                now = open_ & (long >= depth)
                open_ &= ~now
                for i in np.flatnonzero(now.any(axis=1)).tolist():
                    others = np.flatnonzero(now[i])
                    both = members.common(i, others)
                    others = others[both / (size[i] + size[others] - both) >= threshold]
                    if len(others):
                        count[i] += copies[others].sum()
                        count[others] += copies[i]
                        met = np.unique(root[np.append(others, i)])
                        if len(met) > 1:
                            root[np.isin(root, met)] = met[0]
            has = np.flatnonzero(count)
            out.append((node[has], count[has], node[root[has]]))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("node", "links", "peer"), cols, strict=True)})

    return run


def join(docs: DataFrame, words: int = 5, threshold: float = 0.8, large: int = LARGE) -> DataFrame:
    """doc_id, text_hash, class_id (the smallest doc_id in the component of links), n_links (other documents at or above
    the threshold), kept (the row of that doc_id), alone (no word): a row for each document."""
    spark = docs.sparkSession
    scratch, depth = Scratch(spark, "jaccard"), depth_for(threshold)
    signed = scratch.write(nodes(docs, words, depth), "nodes")
    classes = signed.filter("n_shingles > 0").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("rep"), F.count("*").alias("copies"), F.any_value("n_shingles").alias("n_shingles")
    )
    classes = scratch.write(classes.select("node", "rep.doc_id", "rep.text_hash", "copies", "n_shingles"), "classes")
    one = signed.select("node", "doc_id", "text_hash", "keys").join(classes.select("node", "doc_id", "text_hash").withColumnsRenamed({"doc_id": "d", "text_hash": "t", "node": "n"}), (F.col("node") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left_semi")
    keyed = scratch.write(one.select("node", F.posexplode("keys").alias("tree", "key")), "keys")
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key", "low")
    stars = keyed.join(shared, "key").select(F.col("node").alias("a"), F.col("low").alias("b"))
    groups = scratch.write(components(stars, scratch, "candidates").withColumnRenamed("component", "grp"), "groups")
    # the smallest node of a group is in its own list too, as a center of a star
    members = groups.select("node", "grp").union(groups.select(F.col("grp"), F.col("grp"))).distinct().join(classes, "node")
    members = scratch.write(members, "members")
    sizes = members.groupBy("grp").agg(F.sum("n_shingles").alias("w"), F.count("*").alias("n"))
    small = sizes.filter(F.col("n") <= large).select("grp", "w", "n", F.lit(-1).alias("tree"))
    placed = members.select("node", "grp").join(small, "grp").select("node", "grp", "tree")
    # in a group that is too large, the places are the prefixes
    loose = members.join(sizes.filter(F.col("n") > large).select("grp"), "grp", "left_semi").select("node", "n_shingles")
    loose = loose.join(keyed.join(shared, "key", "left_semi"), "node")
    loose = scratch.write(loose.select("node", F.col("key").alias("grp"), "tree", "n_shingles"), "loose")
    scratch.drop("keys")
    shape = small.union(loose.groupBy("grp", "tree").agg(F.sum("n_shingles").alias("w"), F.count("*").alias("n")).select("grp", "w", "n", "tree"))
    blocks = F.greatest(F.ceil(F.col("w") / BLOCK_SHINGLES), F.ceil(F.col("n") / BLOCK_DOCS)).cast("int")
    shape = shape.select("grp", "tree", blocks.alias("blocks"))
    placed = placed.union(loose.select("node", "grp", "tree")).join(shape, ["grp", "tree"])
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    whole = docs.toDF(*names).select(doc_id.cast("long").alias("_d"), F.xxhash64(text).alias("_t"), text.alias("text"))
    # by shuffle at every size: a broadcast of the members would only do while they are few
    dealt = placed.join(members.select("node", "doc_id", "text_hash", "copies"), "node")
    dealt = dealt.join(whole.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")))
    dealt = sets(dealt, words).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a member goes to each pair of blocks that its own is part of
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda c: F.struct(F.least("own", c).alias("p"), F.greatest("own", c).alias("q")))
    dealt = dealt.withColumn("pair", F.explode(pair)).select("node", "grp", "tree", "own", "copies", "set", "label", "pair.p", "pair.q", "blocks")
    dealt = dealt.withColumn("bucket", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("grp", "tree"), F.lit(n))).otherwise(F.xxhash64("grp", "tree", "p", "q")))
    found = dealt.groupBy("bucket").applyInArrow(compare(threshold, depth), "node long, links long, peer long")
    found = scratch.write(found, "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("node").alias("a"), F.col("peer").alias("b")), scratch, "links")
    per = classes.join(links, "node", "left").join(comp, "node", "left")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash").alias("own")
    per = per.select("node", own, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    per = scratch.write(per, "per")
    first = per.groupBy("component").agg(F.min("own").alias("first"))
    per = per.join(first, "component").select(F.col("node").alias("_node"), "n_links", F.col("first.doc_id").alias("class_id"), F.col("first.text_hash").alias("class_hash"))
    per = scratch.write(per, "result")
    for name in ("classes", "groups", "members", "loose", "found", "per"):
        scratch.drop(name)
    rows = signed.select("doc_id", "text_hash", "n_shingles", F.col("node").alias("_node")).join(per, "_node", "left")
    alone = F.col("n_shingles") == 0
    class_id = F.when(alone, F.col("doc_id")).otherwise(F.col("class_id"))
    kept = alone | (F.col("class_id").eqNullSafe(F.col("doc_id")) & (F.col("class_hash") == F.col("text_hash")))
    return rows.select("doc_id", "text_hash", class_id.alias("class_id"), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).alias("n_links"), kept.alias("kept"), alone.alias("alone"))


def one_each(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs with one document of each class: the smallest doc_id. Texts without a word are no class and stay."""
    scratch = Scratch(docs.sparkSession, "one-each")
    rows = scratch.write(join(docs, words, threshold), "rows")
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    docs_ = docs.toDF(*names)

    def same(other: DataFrame) -> tuple:
        return other.hint("merge"), F.xxhash64(text).eqNullSafe(F.col("_t")) & doc_id.cast("long").eqNullSafe(F.col("_d"))

    key = [F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")]
    out = docs_.join(*same(rows.filter("not kept").select(*key).distinct()), "left_anti")
    again = rows.filter("kept and not alone").groupBy(*key).count().filter("count > 1").select("_d", "_t")
    if not again.isEmpty():
        twice = [names[docs.columns.index(c)] for c in ("doc_id", "text")]
        out = out.join(*same(again), "left_anti").unionByName(out.join(*same(again), "left_semi").dropDuplicates(twice))
    return out.toDF(*docs.columns)
