import functools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from nestql.llm import packing, sstable, tokens
from nestql.llm.queries import tokenizer
from nestql.llm.store import Scratch
from nestql.llm.tokens import Encoder

from .helpers import crowded, documents, frame

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
ODD = ["a  b", "a \n b", " x", "x ", "  ", "a\tb  c\n\n d", "’s it's 'S  ﬁ ǅ Σας é ́x", "<|endoftext|> a<|endoftext|>", "1 2 34 , ,, é\x1c \x1cd \x85 q", "a\n", "\n", "\nb", "a b\n", "x\t y", "İx ẞ", " ́a", "\r\n x", "😀 👨‍👩‍👧 ok"]


@functools.cache
def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(name))


def plain(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "kind"), [(BYTE, "prefix"), (WORD, "spaceless")])
def test_cached_ids_equal_whole_encoding(name, kind):
    e, rng = Encoder(tokenizer(name), kind), random.Random(1)
    texts = [*ODD, *[d[1] for d in documents()], *["".join(rng.choice("ab é.,'1\n\t ") for _ in range(60)) for _ in range(200)]]
    texts += ["".join(rng.choice(["a", "Z", "'s", "'t", "é", "×", "Σ", "\u00a0", "\u0301", "\x85", " ", "\n", " the", "中", "<|endoftext|>", "-", "7"]) for _ in range(12)) for _ in range(300)]
    for column in (pa.array(texts), pa.array(["x", *texts])[1:], pa.chunked_array([texts]).combine_chunks()):  # the second time from memory
        for end in (None, 2):
            ids, at = e.encode(column, end)
            for i, t in enumerate(texts):
                assert ids[at[i] : at[i + 1]].tolist() == plain(name, t) + ([] if end is None else [end]), repr(t)[:80]
    for nothing in (pa.array([], pa.string()), pa.array([None, ""], pa.string())):
        ids, at = e.encode(nothing)
        assert len(ids) == 0 and at.tolist() == [0] * (len(nothing) + 1)


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 100)
    monkeypatch.setattr(tokens, "SLICE", 64)
    monkeypatch.setattr(tokens, "JOINED", 64)
    e, rng = Encoder(tokenizer(BYTE), "prefix"), random.Random(3)
    for _ in range(30):
        texts = ["".join(rng.choice("abc .") for _ in range(50)) for _ in range(10)]
        ids, at = e.encode(pa.array(texts), 2)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [[*plain(BYTE, t), 2] for t in texts]
        assert len(e.number) < 400


def optimum(items, capacity):
    """Fewest bins, by trying everything."""
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_dominance_reduction_keeps_an_optimum():
    rng, reduced = random.Random(2), 0
    for _ in range(150):
        capacity = rng.choice([10, 20, 50])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = {x: items.count(x) for x in items}
        fixed, rest = packing.reduce(dict(counts), capacity)
        left = [x for x, n in rest.items() for _ in range(n)]
        assert all(sum(a * b for a, b in p) <= capacity for p, _ in fixed)
        used = {x: sum(n * dict(p).get(x, 0) for p, n in fixed) + rest.get(x, 0) for x in counts}
        assert used == counts
        assert sum(n for _, n in fixed) + optimum(sorted(left, reverse=True), capacity) == optimum(items, capacity)
        reduced += bool(fixed)
        bins = fixed + packing.best_fit(rest, capacity)
        assert {x: sum(n * sum(k for y, k in p if y == x) for p, n in bins) for x in counts} == counts
        assert all(sum(a * b for a, b in p) <= capacity for p, _ in bins)
    assert reduced > 100


@pytest.mark.parametrize("make", [frame, crowded])
def test_pack(spark, make):
    rows = documents()
    got = packing.pack(make(spark, rows), tokenizer(BYTE)).collect()
    want = {}
    for doc, text, *_ in rows:
        ids = [*plain(BYTE, text), 2]
        size = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        start, piece = 0, 0
        while start < len(ids):
            part = np.array(ids[start : start + size], "<u4").tobytes()
            key = (doc, piece, start, len(part) // 4, zlib.crc32(part))
            want[key] = want.get(key, 0) + 1
            start, size, piece = start + size, 1024, piece + 1
    have = {}
    for r in got:
        have[tuple(r)[:5]] = have.get(tuple(r)[:5], 0) + 1
    assert have == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= -(-sum(r["length"] for r in got) // 1024) + 1


def test_pack_empty(spark):
    assert packing.pack(frame(spark, []), tokenizer(BYTE)).count() == 0


@pytest.mark.parametrize("make", [frame, crowded])
def test_shards_round_trip(spark, make):
    rows = documents()
    got = sstable.round_trip(make(spark, rows), tokenizer(WORD)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for doc, text, *_ in order:
        ids = np.array([*plain(WORD, text), 2], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sstable.round_trip(frame(spark, []), tokenizer(WORD)).count() == 0


def test_lookup_and_blocks(tmp_path):
    rng = np.random.default_rng(3)
    docs = [None, -5, *sorted([*range(0, 4000, 3), 300, 300]), 2**62]
    values = [rng.integers(0, 60_000 if i % 5 else 90_000, rng.integers(1, 400)).astype("<u4") for i in range(len(docs))]
    path = tmp_path / "x.sst"
    with path.open("wb") as f:
        w = sstable.Writer(f)
        for d, v in zip(docs, values, strict=True):
            w.add(sstable.key_of(d), v)
        w.close()
    r = sstable.opened(f"file://{path}")
    assert len(r.index) > 5 and r.entries == len(docs) and r.ids == sum(map(len, values))
    assert [sstable.doc_of(k) for k, _ in r.scan()] == docs
    for d in (None, -5, 0, 3, 300, 3999, 2**62):
        found = r.get(d)
        assert [x.tolist() for x in found] == [v.tolist() for k, v in zip(docs, values, strict=True) if k == d]
    missing = [i for i in range(4000) if i % 3 and i != 300]
    assert not any(r.get(i) for i in missing)
    bits = [r.bits[sstable._bits([sstable.key_of(i)], len(r.bits)).astype(int).ravel()].all() for i in missing]
    assert sum(bits) < 0.03 * len(bits)


def test_a_failed_attempt_leaves_no_trace(spark):
    scratch = Scratch(spark, "twice")
    df = frame(spark)
    first = scratch.write(sstable.write_shards(df, scratch.path("s"), tokenizer(WORD), "spaceless", 2), "m1")
    again = scratch.write(sstable.write_shards(df, scratch.path("s"), tokenizer(WORD), "spaceless", 2), "m2")
    assert sorted(map(tuple, sstable.read_shards(first).collect()), key=repr) == sorted(map(tuple, sstable.read_shards(again).collect()), key=repr)
