"""Repeated passages, found by distributed suffix sorting with a difference cover.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id. So only the order of the
first 50 bytes of suffixes matters, and the suffix array can be built in parts: equal strings of 50 bytes have the same
smallest 24-byte hash inside (their minimizer), and all windows with the same minimizer are sorted in the same part.

1. Documents become segments, a table that is bucketed, so that later steps read it in place.
2. Neighbouring windows with the same minimizer form a run. Runs meet by minimizer, as sorted arrays of fingerprints: a
   minimizer of one document only can't repeat; runs of equal fingerprints are taken to be equal, without
   comparing bytes, and have one representative, in the smallest doc_id; the others are removed on that alone.
3. Representatives meet with their bytes and are suffix-sorted: positions that are 1 or 2 modulo 3 are sampled; their
   triples of eight-byte words are sorted and named; on the names one level of recursion sorts and names triples again, which
   reaches 56 bytes. The remaining suffixes are sorted by their first byte and the name behind it, and merged with the sample:
   one or two bytes and a name decide between any two. Neighbours in that one order are then compared byte by byte; those
   that agree in 50 bytes share their smallest doc_id.
4. The matched windows go back to their segments, where the bytes are cut out.

Every exchange moves at most one entry for each distinct run of a segment, so copies, however many, add nothing to a
part beyond an entry for each segment that holds them.

Cases: a null text counts as empty. A null doc_id counts as the largest that there can be, 2^63 - 1; rows of equal doc_id never
affect each other. Texts under 50 bytes are kept. Repeated rows are treated one by one. An empty table gives no rows. Columns
other than doc_id and text are carried along, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import tidy, tidy_group
from .store import Scratch, small_batches
from .textvec import U, grouped, mix, prefix, spans, windows

LENGTH, SEED, NAME = 50, 24, 24
#: Bytes of a segment, segments of a group, bytes hashed at once, windows of a run.
SEGMENT, GROUP, SLICE, RUN = 2 << 20, 4, 1 << 19, 64
#: Bytes of text for each part, bytes that are suffix-sorted at once, and the finest division of a part.
PART, SORTED, FINE = 4 << 20, 400_000, 4096
DEEP = 2 * NAME + 16
LAST = (1 << 63) - 1
SEGMENTS = "grp long, seg long, ids array<long>, sizes array<long>, data binary, extra binary"


def _zip(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(1).compress(raw)


def _unzip(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def _shuffled(x: np.ndarray) -> bytes:
    """Integers byte plane by byte plane: the high planes of small numbers compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8).T).tobytes()


def _straight(raw: bytes, n: int, dtype: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(dtype).ravel()


def _cuts(texts: pa.Array) -> list[tuple[int, int]]:
    """Ranges of rows of about half a segment."""
    whole = texts.fill_null(b"").cast(pa.large_binary())
    size = np.frombuffer(whole.buffers()[1], np.int64, count=len(texts) + 1, offset=8 * whole.offset) if len(texts) else np.zeros(1, np.int64)
    at = (size[:-1] - size[0]) // (SEGMENT // 2)
    ends = np.append(np.flatnonzero(np.diff(at)) + 1, len(texts)).tolist() if len(texts) else []
    return list(zip([0, *ends[:-1]], ends, strict=True)) if ends else []


def segments(docs: DataFrame) -> DataFrame:
    """Whole documents in order, about SEGMENT bytes a row."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, size = TaskContext.get().partitionId(), 0, 0
        ids, sizes, texts, rest = [], [], [], []  # rest: the other columns, as a stream that is being written

        def row() -> pa.RecordBatch:
            sink, writer = rest
            writer.close()
            data, extra = _zip(b"".join(texts)), _zip(sink.getvalue())
            cols = [pa.array([(part << 24) + n // GROUP], pa.int64()), pa.array([(part << 24) + n], pa.int64()), *(pa.array([np.concatenate(x)], pa.list_(pa.int64())) for x in (ids, sizes)), pa.array([data]), pa.array([extra])]
            for x in (ids, sizes, texts, rest):
                x.clear()
            return pa.RecordBatch.from_arrays(cols, names=["grp", "seg", "ids", "sizes", "data", "extra"])

        for batch in batches:
            side = batch.select([0, *range(2, batch.num_columns)])
            for a, b in _cuts(batch.column(1)):
                whole = batch.column(1).slice(a, b - a).fill_null(b"").cast(pa.large_binary())
                at = np.frombuffer(whole.buffers()[1], np.int64, count=b - a + 1, offset=8 * whole.offset)
                ids.append(np.array(batch.column(0).slice(a, b - a).fill_null(LAST)))  # copies: no batch is held
                sizes.append(np.diff(at))
                texts.append(whole.buffers()[2][int(at[0]) : int(at[-1])].to_pybytes() if at[-1] > at[0] else b"")
                if not rest:
                    sink = pa.BufferOutputStream()
                    rest += sink, pa.ipc.new_stream(sink, side.schema)
                rest[1].write_batch(side.slice(a, b - a))
                size += len(texts[-1])
                if size >= SEGMENT:
                    yield row()
                    n, size = n + 1, 0
        if rest:
            yield row()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *[F.col(f"`{c}`") for c in others]).mapInArrow(run, SEGMENTS)


class Runs:
    """The runs of a segment, and its entries: the distinct (minimizer, fingerprint) pairs in order."""

    def __init__(self, data: bytes, sizes: np.ndarray, ids: np.ndarray):
        self.begin = np.cumsum(sizes) - sizes
        texts = [data[a : a + n] for a, n in zip(self.begin.tolist(), sizes.tolist(), strict=True)]
        found: list[tuple[np.ndarray, ...]] = []
        for a, b in grouped(texts, SLICE):
            found += self._slice(texts[a:b], a)
        start, n, low, mark, doc = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 5
        self.start, self.n, self.doc = start.astype(np.int64), n.astype(np.int64), ids[doc.astype(np.int64)]
        low, mark = low.astype(U) >> U(16), mark.astype(U) >> U(16)
        order = np.lexsort((self.start, self.doc, mark, low))
        first = np.ones(len(order), bool)
        first[1:] = (np.diff(low[order]) != 0) | (np.diff(mark[order]) != 0)
        self.entry = np.zeros(len(order), np.int64)
        self.entry[order] = np.cumsum(first) - 1
        self.head = order[first]  # the run of each entry that is in its smallest document
        self.low, self.mark, self.least = low[self.head], mark[self.head], self.doc[self.head]
        most = np.maximum.reduceat(self.doc[order], np.flatnonzero(first)) if len(order) else self.least
        self.many = most != self.least

    def _slice(self, texts: list[bytes], at: int) -> list[tuple[np.ndarray, ...]]:
        size = np.array([len(t) for t in texts], np.int64)
        if len(texts) == 1 and size[0] > 2 * SLICE:  # a very long document, window by window
            out = []
            for a in range(0, int(size[0]) - LENGTH + 1, SLICE):
                for start, *rest in self._windows(np.frombuffer(texts[0], np.uint8, count=min(SLICE + LENGTH - 1, int(size[0]) - a), offset=a), size[:1] - a, at):
                    out.append((start + a, *rest))
            return out
        return self._windows(np.frombuffer(b"".join(texts), np.uint8), size, at)

    def _windows(self, buf: np.ndarray, size: np.ndarray, at: int) -> list[tuple[np.ndarray, ...]]:
        n = len(buf) - LENGTH + 1
        if n <= 0:
            return []
        c = prefix(buf)
        low, k, width = windows(c, SEED), 1, LENGTH - SEED + 1
        while 2 * k <= width:
            low, k = np.minimum(low[:-k], low[k:]), 2 * k
        if width > k:
            low = np.minimum(low[: k - width], low[width - k :])
        doc = np.repeat(np.arange(len(size)), np.minimum(size, len(buf)))[: len(buf)]
        inside = doc[:n] == doc[LENGTH - 1 :]
        fresh = inside.copy()
        fresh[1:] &= (low[1:] != low[:-1]) | (doc[1:n] != doc[: n - 1])
        start = np.flatnonzero(fresh)
        if not len(start):
            return []
        last = np.cumsum(inside)  # windows up to each place
        count = np.diff(np.append(last[start] - 1, last[-1]))
        pieces = -(-count // RUN)
        if pieces.max() > 1:
            extra = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start, count = np.repeat(start, pieces) + RUN * extra, np.minimum(np.repeat(count, pieces) - RUN * extra, RUN)
        mark = mix(spans(c, start, start + count + LENGTH - 1) + count.astype(U))
        # the smallest of many hashes is a small one: mixed again, minimizers spread evenly over the parts
        return [(start + self.begin[at], count, mix(low[start]), mark, doc[start] + at)]


def _of(row: dict) -> tuple[bytes, Runs]:
    data = _unzip(row["data"])
    return data, Runs(data, np.array(row["sizes"], np.int64), np.array(row["ids"], np.int64))


def _parts(low: np.ndarray, parts: int) -> np.ndarray:
    return ((low >> U(16)) * U(parts)) >> U(32)


def offer(parts: int):
    """Entries of each segment, by the part of their minimizers."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                runs = _of(row)[1]
                part, out = _parts(runs.low, parts), []
                cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, np.int64)
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    p = int(part[a])
                    low, base = runs.low[a:b], int(runs.least[a:b].min())
                    raw = _shuffled(np.diff(low, prepend=U(0))) + _shuffled(runs.mark[a:b]) + _shuffled(runs.least[a:b] - base) + runs.many[a:b].tobytes()
                    out.append((p, row["grp"], row["seg"], int(b - a), base, _zip(raw)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["part", "grp", "seg", "n", "base", "blob"])

    return run


@tidy_group
def represent(table: pa.Table) -> pa.Table:
    """For each entry of a part: 0 can't repeat, 1 equals a run of a smaller document, 2 stands for its equals."""
    rows = table.to_pylist()
    low, mark, least, many = [], [], [], []
    for r in rows:
        raw, n = _unzip(r["blob"]), r["n"]
        low.append(np.cumsum(_straight(raw[: 8 * n], n, U), dtype=U))
        mark.append(_straight(raw[8 * n : 16 * n], n, U))
        least.append(_straight(raw[16 * n : 24 * n], n, np.int64) + r["base"])
        many.append(np.frombuffer(raw[24 * n :], bool))
    low, mark, least, many = (np.concatenate(x) for x in (low, mark, least, many))
    order = np.lexsort((least, mark, low))
    low, mark, doc = low[order], mark[order], least[order]
    new = np.ones(len(order), bool)
    new[1:] = low[1:] != low[:-1]
    at, group = np.flatnonzero(new), np.cumsum(new) - 1
    alive = ((np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)) | np.logical_or.reduceat(many[order], at))[group]
    new[1:] |= mark[1:] != mark[:-1]
    own = doc == doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    code = np.zeros(len(order), np.uint8)
    code[order] = np.where(alive, np.where(own, 2, 1), 0)
    ends = np.cumsum([r["n"] for r in rows])
    blobs = [_zip(code[e - r["n"] : e].tobytes()) for r, e in zip(rows, ends, strict=True)]
    return pa.table({"grp": pa.array([r["grp"] for r in rows], pa.int64()), "seg": pa.array([r["seg"] for r in rows], pa.int64()), "part": pa.array([r["part"] for r in rows], pa.int64()), "codes": pa.array(blobs, pa.binary())})


def _codes(answers: pa.Table) -> dict[int, np.ndarray]:
    by: dict[int, list[tuple[int, bytes]]] = {}
    for r in answers.to_pylist():
        if r["codes"] is not None:
            by.setdefault(r["seg"], []).append((r["part"], r["codes"]))
    return {seg: np.frombuffer(b"".join(_unzip(c) for _, c in sorted(x)), np.uint8) for seg, x in by.items()}


def _show(parts: int):
    """The bytes of the representatives, by part."""

    @tidy_group
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        codes, out = _codes(right), []
        for row in left.to_pylist():
            data, runs = _of(row)
            entry = np.flatnonzero(codes.get(row["seg"], np.zeros(0, np.uint8)) == 2)
            head = runs.head[entry]
            low, start, n = runs.low[entry], runs.start[head], runs.n[head]
            part, fine = _parts(low, parts), low % U(FINE)
            for i in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1) if len(part) else []:
                p = part[i[0]]
                raw = b"".join(data[a : a + k + LENGTH - 1] for a, k in zip(start[i].tolist(), n[i].tolist(), strict=True))
                out.append((int(p), row["grp"], row["seg"], entry[i].tolist(), runs.least[entry[i]].tolist(), n[i].tolist(), fine[i].astype(np.int64).tolist(), _zip(raw)))
        cols = list(zip(*out, strict=True)) if out else [[]] * 8
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 4 + [pa.binary()]
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["part", "grp", "seg", "entry", "doc", "n", "fine", "data"])

    return run


def _named(*keys: np.ndarray) -> np.ndarray:
    """Names from 0 in the order of the keys, the first first: equal keys have the same one."""
    wide = [int(k.max()).bit_length() for k in keys]
    if sum(wide) > 64:
        order = np.lexsort(keys[::-1])
    else:  # in one integer
        key = np.zeros(len(keys[0]), U)
        for k, w in zip(keys, wide, strict=True):
            key = (key << U(w)) | k if w < 64 else k
        keys, order = (key,), np.argsort(key)
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    out = np.zeros(len(order), U)
    out[order] = np.cumsum(new).astype(U)
    return out


def suffix_order(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places at of buf in the order of the suffixes there, as far as 56 bytes. buf reaches DEEP bytes beyond them."""
    word = np.lib.stride_tricks.as_strided(buf, (len(buf) - 7, 8), (1, 1))
    # the sample: places that are 1 or 2 modulo 3, where a suffix starts or up to two bytes later
    need = np.zeros(len(buf), bool)
    for shift in range(3):
        need[at + shift] = True
    need[::3] = False
    deep = need.copy()
    deep[NAME:] |= need[:-NAME]
    words = deep.copy()
    words[8:] |= deep[:-8]
    words[16:] |= deep[:-16]
    words[48:] |= need[:-48]
    place = np.zeros(len(buf), np.int64)

    def name(mask: np.ndarray, *keys: np.ndarray) -> np.ndarray:
        place[mask] = np.arange(np.count_nonzero(mask))
        return _named(*keys)

    letters = name(words, np.ascontiguousarray(word[np.flatnonzero(words)]).view(">u8").ravel().astype(U))
    sampled = np.flatnonzero(deep)
    last = letters[place[np.flatnonzero(need) + 48]]
    triples = name(deep, *(letters[place[sampled + 8 * k]] for k in range(3)))
    # recursion: names 24 bytes apart are the letters of a string of their own
    sampled = np.flatnonzero(need)
    names = name(need, triples[place[sampled]], triples[place[sampled + NAME]], last)
    # the others are sorted by a byte and a name, and merged: those before one are counted in each half of the sample
    b8, rest = buf.astype(U), at % 3
    two = at[rest > 0]
    two = two[np.argsort(names[place[two]], kind="stable")]
    one = at[rest == 0]

    def keys(i: np.ndarray, shift: int) -> np.ndarray:
        return (b8[i] << U(32)) | names[place[i + 1]] if shift == 1 else (b8[i] << U(40)) | (b8[i + 1] << U(32)) | names[place[i + 2]]

    one = one[np.argsort(keys(one, 1), kind="stable")]
    before = np.zeros(len(one), np.int64)
    for shift in (1, 2):
        before += np.searchsorted(np.sort(keys(at[rest == shift], shift)), keys(one, shift))
    spot = np.maximum.accumulate(before) + np.arange(len(one))  # alike in 57 bytes: any order will do
    out, free = np.zeros(len(at), np.int64), np.ones(len(at), bool)
    out[spot], free[spot] = one, False
    out[free] = two
    return out


def smallest(data: bytes, n: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Suffix-sort runs by 50 bytes; for each window of each run, the smallest document that has its string.

    data: the runs one after another, of n windows and so n + 49 bytes each.
    """
    buf = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(DEEP, np.uint8)])
    begin = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())  # where each window starts
    order = suffix_order(buf, at)
    number = np.zeros(len(buf), np.int64)
    number[at] = np.arange(len(at))
    # neighbours in the order: do their first 50 bytes agree?
    word = np.lib.stride_tricks.as_strided(buf, (len(buf) - 7, 8), (1, 1))
    same = np.arange(1, len(order))
    for k in (42, 0, 8, 16, 24, 32, 40):
        x, y = (np.ascontiguousarray(word[order[same - j] + k]).view(U).ravel() for j in (0, 1))
        same = same[x == y]
    new = np.ones(len(order), bool)
    new[same] = False
    first = np.flatnonzero(new)
    owner = np.repeat(doc, n)
    low = np.zeros(len(at), np.int64)
    low[number[order]] = np.repeat(np.minimum.reduceat(owner[number[order]], first), np.diff(np.append(first, len(order))))
    return low


@tidy_group
def resolve(table: pa.Table) -> pa.Table:
    """For each representative of a part, the windows whose strings also start in a smaller document, as bits."""
    rows = table.to_pylist()
    n, doc, fine = (np.array([x for r in rows for x in r[c]], np.int64) for c in ("n", "doc", "fine"))
    data = b"".join(_unzip(r["data"]) for r in rows)
    size = n + LENGTH - 1
    start, bits = np.cumsum(size) - size, np.zeros(len(n), np.int64)
    # equal strings have the same minimizer, so what differs in it can be sorted apart
    order = np.argsort(fine, kind="stable")
    held = np.bincount(fine, weights=size, minlength=FINE)
    chunk = (np.cumsum(held) - held)[fine[order]] // SORTED
    for idx in np.split(order, np.flatnonzero(np.diff(chunk)) + 1) if len(order) else []:
        raw = b"".join([data[a : a + k] for a, k in zip(start[idx].tolist(), size[idx].tolist(), strict=True)])
        count = n[idx]
        begin = np.cumsum(count) - count
        hit = smallest(raw, count, doc[idx]) < np.repeat(doc[idx], count)
        value = np.where(hit, U(1) << (np.arange(len(hit)) - np.repeat(begin, count)).astype(U), U(0))
        bits[idx] = np.add.reduceat(value, begin).astype(np.int64)
    cuts = np.cumsum([len(r["entry"]) for r in rows])
    return pa.table({"grp": pa.array([r["grp"] for r in rows], pa.int64()), "seg": pa.array([r["seg"] for r in rows], pa.int64()), "entry": pa.array([r["entry"] for r in rows], pa.list_(pa.int64())), "bits": pa.array([x.tolist() for x in np.split(bits, cuts[:-1])], pa.list_(pa.int64()))})


def _cut(with_text: bool):
    """Remove the matched bytes of each segment."""

    @tidy_group
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        codes, bits = _codes(right), {}
        for r in right.to_pylist():
            if r["entry"] is not None:
                bits.setdefault(r["seg"], []).append((r["entry"], r["bits"]))
        tables = []
        for row in left.to_pylist():
            data, runs = _of(row)
            code = codes.get(row["seg"], np.zeros(0, np.uint8))
            seen = np.zeros(len(runs.head), U)
            for entry, value in bits.get(row["seg"], []):
                seen[entry] = np.array(value, np.int64).astype(U)
            step = np.zeros(len(data) + 1, np.int32)  # where removed stretches begin and end
            e = runs.entry
            whole = (code[e] == 1) | ((code[e] == 2) & (runs.doc > runs.least[e])) if len(e) else np.zeros(0, bool)
            np.add.at(step, runs.start[whole], 1)
            np.subtract.at(step, runs.start[whole] + runs.n[whole] + LENGTH - 1, 1)
            part = np.flatnonzero(~whole & (seen[e] != 0)) if len(e) else np.zeros(0, np.int64)
            single = [runs.start[part[(seen[e[part]] >> U(k)) & U(1) == 1]] + k for k in range(RUN)]
            a = np.concatenate(single)
            np.add.at(step, a, 1)
            np.subtract.at(step, a + LENGTH, 1)
            gone = np.cumsum(step[:-1], out=step[:-1]) > 0
            buf, out = np.frombuffer(data, np.uint8), []
            for a, n in zip(runs.begin.tolist(), row["sizes"], strict=True):
                g = gone[a : a + n]
                removed = int(np.count_nonzero(g))
                kept = buf[a : a + n][~g].tobytes() if removed else data[a : a + n]
                count = int(np.count_nonzero(g[1:] & ~g[:-1]) + g[0]) if removed else 0
                out.append((kept.decode("utf-8", "ignore") if with_text else None, n, removed, count, hashlib.sha256(kept).hexdigest()))
            extra = pa.ipc.open_stream(_unzip(row["extra"])).read_all()
            cols = list(zip(*out, strict=True))
            new = [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            names = ["text", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            keep = [c for c in extra.column_names if c not in names]
            tables.append(pa.table([*(extra.column(c) for c in keep), *new], names=[*keep, *names]))
        return pa.concat_tables(tables)

    return run


def dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """docs with the repeated bytes removed from text (null unless with_text; a cut character goes), and n_bytes,
    n_removed, n_spans, kept_sha256 of the bytes. Columns of these names are replaced. The order of rows is lost."""
    spark, digest = docs.sparkSession, ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in digest])
    scratch, width = Scratch(spark, "suffix"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    seg = scratch.write_bucketed(segments(docs), "segments", "grp", width)
    parts = max(width, -(-seg.count() * SEGMENT // PART))
    offers = seg.select("grp", "seg", "ids", "sizes", "data").mapInArrow(offer(parts), "part long, grp long, seg long, n long, base long, blob binary")
    codes = scratch.write(offers.groupBy("part").applyInArrow(represent, "grp long, seg long, part long, codes binary"), "codes")
    kind = "part long, grp long, seg long, entry array<long>, doc array<long>, n array<long>, fine array<long>, data binary"
    shown = seg.select("grp", "seg", "ids", "sizes", "data").groupBy("grp").cogroup(codes.groupBy("grp")).applyInArrow(_show(parts), kind)
    found = scratch.write(shown.groupBy("part").applyInArrow(resolve, "grp long, seg long, entry array<long>, bits array<long>"), "found")
    answers = codes.unionByName(found, allowMissingColumns=True)
    rest = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *rest, T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType() if c == "kept_sha256" else T.LongType()) for c in digest]])
    out = seg.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(_cut(with_text), schema)
    if not with_text:  # small rows: nothing of the scratch space is needed after them
        out = scratch.write(out, "result")
        scratch.drop("segments")
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """The columns of docs, whatever their names, with the repeated bytes removed from text; n_chars, if there, counts what is left."""
    names = [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)]
    out = dedup(docs.toDF(*names))
    n_chars = F.length("text").cast("long")
    return out.select(*[(n_chars if c == "n_chars" else F.col(n)).alias(c) for c, n in zip(docs.columns, names, strict=True)])
