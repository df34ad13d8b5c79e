import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestql.llm import embeddings, jaccard, suffix
from nestql.llm.components import components
from nestql.llm.store import Scratch

from .helpers import crowded, documents, frame, words


def union_find(items, pairs):
    up = {i: i for i in items}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in items}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(200, 260)] + [(500, i) for i in range(501, 560)] + [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "c"), "x").collect()}
    want = union_find({x for p in pairs for x in p}, pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert {k: got.get(k, k) for k in want} == want and set(got) <= linked


def brute_suffix(rows):
    owner = {}
    last = (1 << 63) - 1
    for doc, text, *_ in rows:
        raw, d = (text or "").encode(), last if doc is None else doc
        for i in range(len(raw) - 49):
            w = raw[i : i + 50]
            owner[w] = min(owner.get(w, d), d)
    out = []
    for doc, text, *_ in rows:
        raw, d = (text or "").encode(), last if doc is None else doc
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if owner[raw[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    return sorted(map(repr, out))


@pytest.mark.parametrize("make", [frame, crowded])
def test_suffix_dedup(spark, make):
    rows = documents()
    df = make(spark, rows)
    got = suffix.dedup(df)
    assert set(df.columns) <= set(got.columns)
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == brute_suffix(rows)
    clashing = df.withColumns({"n_bytes": F.lit("x"), "n_spans": F.lit("y")})
    cut = suffix.without_repeats(clashing)
    assert cut.columns == clashing.columns
    assert {(r["n_bytes"], r["n_spans"]) for r in cut.collect()} == {("x", "y")}


def test_suffix_dedup_random_overlaps(spark, monkeypatch):
    rng = random.Random(4)
    pool = [words(rng, 25) for _ in range(6)] + ["ab" * 60, "z" * 200]
    rows = []
    for i in range(60):
        text = ""
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) // 2)
            text += p[a : a + rng.randint(30, 150)] + rng.choice(["", " ", words(rng, 3)])
        rows.append((i // 2 * 2 if rng.random() < 0.1 else i, text, None, None, None))
    got = suffix.dedup(frame(spark, rows, 5), with_text=False).collect()
    want = [w[: w.rindex(", ")] for w in brute_suffix(rows)]
    assert sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))[:-1] for r in got) == sorted(want)


def test_smallest_agrees_with_sets():
    rng = np.random.default_rng(5)
    for _ in range(20):
        pool = [bytes(rng.integers(97, 99, 120)) for _ in range(3)]
        runs, docs = [], []
        for d in range(12):
            p = pool[rng.integers(3)]
            a = int(rng.integers(0, 40))
            runs.append(p[a : a + int(rng.integers(50, 80))])
            docs.append(int(rng.integers(0, 9)))
        n = np.array([len(r) - 49 for r in runs])
        got = suffix.smallest(b"".join(runs), n, np.array(docs))
        least = {}
        for r, d in zip(runs, docs, strict=True):
            for i in range(len(r) - 49):
                least[r[i : i + 50]] = min(d, least.get(r[i : i + 50], d))
        assert got.tolist() == [least[r[i : i + 50]] for r in runs for i in range(len(r) - 49)]


def test_suffix_order_is_one_order():
    rng = np.random.default_rng(6)
    for letters in (1, 2, 26):
        raw = bytes(rng.integers(97, 97 + letters, 700))
        at = np.sort(rng.choice(600, 400, replace=False))
        order = suffix.suffix_order(np.frombuffer(raw + bytes(suffix.DEEP), np.uint8), at)
        assert sorted(order.tolist()) == at.tolist()
        heads = [(raw + bytes(suffix.DEEP))[i : i + 50] for i in order.tolist()]
        assert heads == sorted(heads)


def test_suffix_very_long_document_in_windows(spark, monkeypatch):
    rng = random.Random(6)
    long = words(rng, 30_000)
    runs = suffix.Runs(long.encode(), np.array([len(long)]), np.array([7]))
    monkeypatch.setattr(suffix, "SLICE", 10_000)
    pieces = suffix.Runs(long.encode(), np.array([len(long)]), np.array([7]))
    cover = [sorted(x for a, n in zip(r.start.tolist(), r.n.tolist(), strict=True) for x in range(a, a + n)) for r in (runs, pieces)]
    assert cover[0] == cover[1] == list(range(len(long) - 49))


def test_suffix_empty(spark):
    assert suffix.dedup(frame(spark, [])).count() == 0


def shingle_set(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_jaccard(rows, t=0.8):
    sets = [shingle_set(r[1]) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= t]
    comp = union_find(range(len(rows)), pairs)
    links = [sum(i in p for p in pairs) for i in range(len(rows))]
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in comp if comp[j] == comp[i] and rows[j][0] is not None]
        out.append((r[0], min(ids) if ids else None, links[i]))
    return sorted(map(repr, out))


def similar(rng, n, start):
    rows, base = [], words(rng, 150).split()
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((start + i, " ".join(w), "en", "s0", 0))
    return rows


@pytest.mark.parametrize("make", [frame, crowded])
def test_jaccard_join(spark, make):
    rows = documents() + similar(random.Random(7), 40, 100) + [(900, " ".join(words(random.Random(8), 3).split()), None, None, None)] * 2
    got = jaccard.join(make(spark, rows)).collect()
    assert sorted(repr((r["doc_id"], r["class_id"], r["n_links"])) for r in got) == brute_jaccard(rows)


def test_jaccard_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 16)
    rows = similar(random.Random(9), 70, 0) + similar(random.Random(10), 5, 200)
    got = jaccard.join(frame(spark, rows)).collect()
    assert sorted(repr((r["doc_id"], r["class_id"], r["n_links"])) for r in got) == brute_jaccard(rows)


def test_jaccard_places_of_too_large_groups_are_prefixes(spark, monkeypatch):
    rows = similar(random.Random(13), 60, 0) + similar(random.Random(14), 20, 200) + documents()
    for docs in (1024, 16):
        monkeypatch.setattr(jaccard, "BLOCK_DOCS", docs)
        got = jaccard.join(frame(spark, rows), large=8).collect()
        assert sorted(repr((r["doc_id"], r["class_id"], r["n_links"])) for r in got) == brute_jaccard(rows)


def test_meetings_are_the_longest_shared_prefixes():
    rng, n = np.random.default_rng(15), 40
    label = rng.integers(0, 2, (n, jaccard.TREES, jaccard.DEPTH)).astype(">u2")
    place = np.sort(rng.integers(0, 3, n))
    long, first = jaccard.meetings(label.reshape(n, -1).view(np.uint8), place, 5)
    for i in range(n):
        for j in range(n):
            same = np.cumprod(label[i] == label[j], axis=1).sum(axis=1)
            deep = same.max() if i < j and place[i] == place[j] else 0
            assert long[i, j] == (deep if deep >= 5 else 0)
            assert first[i, j] == (int(np.flatnonzero(same >= 5)[0]) if deep >= 5 else -1)


@pytest.mark.parametrize("n", range(6))
def test_tiny_texts(spark, n):
    text = " ".join("abcde"[:n])
    rows = [(1, text, None, None, None), (2, text, None, None, None)][: 1 + (n % 2)]
    got = jaccard.join(frame(spark, rows, 1)).collect()
    assert sorted(repr((r["doc_id"], r["class_id"], r["n_links"])) for r in got) == brute_jaccard(rows)


def test_one_each(spark):
    rows = documents()
    clashing = frame(spark, rows).withColumns({"_d": F.lit(1), "_t": F.lit(2), "node": F.lit("x")})
    assert jaccard.one_each(clashing).columns == clashing.columns
    got = jaccard.one_each(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    texts = sorted(repr((r["doc_id"], r["text"])) for r in got.collect())
    base = rows[0][1]
    gone = [(1, base), (2, rows[2][1]), (None, base), (9, "a"), (3, rows[3][1])]
    want = [repr((r[0], r[1])) for r in rows]
    for g in gone:
        want.remove(repr(g))
    assert texts == sorted(want)
    assert jaccard.one_each(frame(spark, [])).count() == 0


def test_recall_of_the_forest():
    assert jaccard.depth_for(0.8) == 5 and jaccard.depth_for(0.99) > 5
    rng, found, n = np.random.default_rng(11), 0, 200
    for _ in range(n):
        a = rng.integers(0, 2**63, 450).astype(np.uint64)
        b = np.append(a[:400], rng.integers(0, 2**63, 50).astype(np.uint64))  # 400 / 500
        la, lb = (jaccard.labels(jaccard.mix(x), jaccard.TREES, 5) for x in (a, b))
        found += bool((la == lb).all(axis=1).any())
    assert found >= n - 1


def vectors(n_hot=300):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((200, 16))
    hot = x[0] + 0.02 * rng.standard_normal((n_hot, 16))
    wide = x[1] + 0.28 * rng.standard_normal((60, 16))
    rows = [v.tolist() for v in (*x, *hot, *wide)]
    rows += [rows[5], (3 * np.array(rows[6])).tolist(), None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 15, [float("inf")] * 16]
    ids = list(range(len(rows)))
    ids[-1] = None
    return list(zip(ids, rows, strict=True)) + [(7, rows[7])]


@pytest.mark.parametrize(("hot", "block"), [(10_000, 1024), (64, 32)])
def test_embeddings(spark, hot, block):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, node string")
    got = embeddings.near(df, 0.95, hot, block).collect()
    good = [i for i, (_, v) in enumerate(rows) if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([rows[i][1] for i in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(good[a], good[b]) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1)), strict=True)]
    comp = union_find(range(len(rows)), pairs)
    have = sum(r["n_links"] for r in got)
    assert len(got) == len(rows) and 0.97 * 2 * len(pairs) <= have <= 2 * len(pairs)
    tight = {rows[i][0] for i in range(200, 500)} | {0}
    assert {r["component_id"] for r in got if r["vec_id"] in tight} == {0}
    assert all(r["n_links"] == 0 and r["kept"] for r in got if r["vec_id"] is not None and r["vec_id"] >= 562 and r["vec_id"] not in (562, 563))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    exact = {rows[i][0]: min(rows[j][0] for j in comp if comp[j] == comp[i] and rows[j][0] is not None) for i in good}
    assert sum(r["component_id"] == exact.get(r["vec_id"], r["vec_id"]) for r in got) > 0.97 * len(rows)


def test_united_sets():
    rng = np.random.default_rng(16)
    for _ in range(30):
        n = int(rng.integers(2, 40))
        pairs = rng.integers(0, n, (int(rng.integers(1, 40)), 2))
        root = embeddings.united(np.arange(n), *pairs[:10].T)
        root = embeddings.united(root, *pairs[10:].T)
        assert root.tolist() == list(union_find(range(n), pairs.tolist()).values())


def test_embeddings_empty(spark):
    assert embeddings.near(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize(("hot", "block"), [(10_000, 1024), (8, 4)])
def test_embeddings_of_mixed_dimensions(spark, hot, block):
    rng = np.random.default_rng(3)
    rows = [(n, v.tolist()) for n, v in enumerate(rng.standard_normal((60, 16)))]
    small = [v.tolist() for v in rng.standard_normal((5, 8))]
    rows += [(100 + i, small[i % 5]) for i in range(60)] + [(200, [2.0]), (201, [5.0]), (202, [-1.0]), (203, small[0] + [0.0])]
    got = {r["vec_id"]: r for r in embeddings.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95, hot, block).collect()}
    assert {(got[100 + i]["n_links"], got[100 + i]["component_id"]) == (11, 100 + i % 5) for i in range(60)} == {True}
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in (200, 201, 202, 203)] == [(1, 200), (1, 200), (0, 202), (0, 203)]
    assert all(got[i]["n_links"] == 0 for i in range(60))
