"""Best-fit packing of token sequences, after Martello-Toth dominance reduction.

Bin packing depends on lengths alone, and lengths are integers up to the capacity, so the whole corpus is a histogram
of at most ``capacity`` counts: the reduction and the fit run on it exactly, whatever the number of documents. Their
outcome is a bounded list of bin patterns with multiplicities; each piece then finds its place from its rank among the
pieces of its length. Ranks come from per-partition counts, so no length is ever gathered in one task.

Cases: a null text counts as empty (one piece, the end id); repeated rows and repeated ids are packed row by row; a
null doc_id is kept; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .memory import tidy
from .store import Scratch, small_batches
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


def cut(docs: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int) -> DataFrame:
    """A row for each piece. rank: its number among the pieces of its length in its partition."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer, kind), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out: list[tuple] = []
            ids, at = enc.encode(batch.column(1), end_id)
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B") if len(ids) else b""
            for doc, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                n, start = b - a, 0
                size = n if n <= capacity else n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    crc = zlib.crc32(raw[4 * (a + start) : 4 * (a + start + size)])
                    out.append((doc, piece, start, size, crc, part, int(seen[size])))
                    seen[size] += 1
                    start, size = start + size, capacity
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


class Lengths:
    """Counts by length, with the present lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {length: n for length, n in counts.items() if n > 0}
        self.order = sorted(self.count)

    def take(self, length: int, n: int = 1) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            self.order.pop(bisect_right(self.order, length) - 1)

    def largest(self, limit: int) -> int:
        """The largest length up to limit, 0 if there is none."""
        i = bisect_right(self.order, limit)
        return self.order[i - 1] if i else 0

    def smallest(self, k: int, above: int = 0) -> list[int]:
        """The k smallest items longer than above, each as often as it is there."""
        out: list[int] = []
        for length in self.order[bisect_right(self.order, above) :]:
            out += [length] * min(self.count[length], k - len(out))
            if len(out) == k:
                break
        return out

    def pair(self, limit: int) -> tuple[int, int]:
        """Two items with the largest sum up to limit, the longer first; (0, 0) if none fit."""
        best, low, high = (0, 0), 0, bisect_right(self.order, limit) - 1
        while low <= high:
            a, b = self.order[high], self.order[low]
            if a + b > limit or (low == high and self.count[a] < 2):
                high -= 1
            else:
                best = max(best, (a, b), key=sum)
                low += 1
        return best


def reduce(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fix bins that some best packing has: for each item, longest first, a set with it of three items at most that
    dominates every other feasible set with it. Returns the bins fixed, and the counts that remain."""
    left, fixed = Lengths(counts), []

    def fix(items: list[int], times: int) -> None:
        need: dict[int, int] = {}
        for x in items:
            need[x] = need.get(x, 0) + 1
        for x, n in need.items():
            left.take(x, n * times)
        fixed.append((tuple(sorted(need.items(), reverse=True)), times))

    def times(*items: int) -> int:
        return min(left.count.get(x, 0) // items.count(x) for x in items)

    changed = True
    while changed:
        changed = False
        for j in reversed(list(left.order)):
            while j in left.count:
                left.take(j)  # one j is set aside; what follows asks what may join it
                room, fits = capacity - j, 0
                for x in left.smallest(4):
                    room -= x
                    fits += room >= 0
                one = left.largest(capacity - j)
                dominating: list[int] | None = None
                if not fits:
                    dominating = [j]
                elif fits == 1 or j + one == capacity:
                    dominating = [j, one]
                elif fits == 2:
                    a, b = left.pair(capacity - j)
                    if one >= a + b:
                        dominating = [j, one]
                    elif one == a and (two := left.smallest(2, b)) and (len(two) < 2 or j + sum(two) > capacity):
                        dominating = [j, a, b]
                left.count[j] = left.count.get(j, 0) + 1
                if left.count[j] == 1:
                    insort(left.order, j)
                if dominating is None:
                    break
                fix(dominating, times(*dominating))
                changed = True
    return fixed, left.count


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on counts: alike bins are filled together."""
    bins: dict[int, list[tuple[Pattern, int]]] = {}  # by the room left
    rooms: list[int] = []

    def put(pattern: Pattern, n: int, room: int) -> None:
        if n:
            if room not in bins:
                bins[room] = []
                insort(rooms, room)
            bins[room].append((pattern, n))

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            i = bisect_right(rooms, length - 1)
            if i < len(rooms):
                room = rooms[i]
                pattern, n = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(i)
            else:
                room, pattern, n = capacity, (), todo
            each = room // length
            full = min(n, todo // each)
            put((*pattern, (length, each)), full, room - each * length)
            todo -= full * each
            n -= full
            if n and todo:  # fewer than a bin takes
                put((*pattern, (length, todo)), 1, room - todo * length)
                todo, n = 0, n - 1
            if pattern:
                put(pattern, n, room)
    return [x for group in bins.values() for x in group]


def slots(bins: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, items a bin, offset in the bin), in the order of ranks."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, n in bins:
        offset = 0
        for length, each in pattern:
            rows.setdefault(length, []).append((used.get(length, 0), sequence, each, offset))
            used[length] = used.get(length, 0) + n * each
            offset += length * each
        sequence += n
    return {length: np.array(x, np.int64) for length, x in rows.items()}


def pack(docs: DataFrame, tokenizer: str, kind: str = "prefix", end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Pack every document of docs (doc_id, text) into sequences of capacity tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document longer than the capacity is cut so
    that its first piece has the rest; full pieces are sequences of their own, numbered below zero.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = scratch.write(cut(docs, tokenizer, kind, end_id, capacity), "pieces")
    parts = pieces.filter(F.col("length") < capacity).groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = scratch.write(parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "parts")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    fixed, rest = reduce(counts, capacity)
    where = slots(fixed + best_fit(rest, capacity))

    @tidy
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for idx in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                rows, r, size = where[int(length[idx[0]])], rank[idx], int(length[idx[0]])
                first, base, each, at = rows[np.searchsorted(rows[:, 0], r, side="right") - 1].T
                sequence[idx] = base + (r - first) // each
                offset[idx] = at + (r - first) % each * size
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = pieces.filter(F.col("length") < capacity).join(parts.select("part", "length", "before"), ["part", "length"])
    ranked = ranked.select(*keep, (F.col("rank") + F.col("before")).alias("rank"))
    placed = ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    own = -1 - (F.shiftleft(F.col("part").cast("long"), 40) + F.col("rank"))
    full = pieces.filter(F.col("length") == capacity).select(*keep, own.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)
