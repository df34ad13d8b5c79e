import json
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nestql.llm import chat, langid, mixing, quality, suffix, toxicity
from nestql.llm.training import sample

from .helpers import crowded, documents, frame, words

DE = "der die und ist nicht ein schön groß wir haben heute viel zeit für das haus am fluss mit freunden"
EN = "the house by the river with friends is not very big but we have enough time for reading today"


def sentences(rng, text, n):
    return " ".join(rng.choice(text.split()) for _ in range(n)) + "."


def corpus(n=240):
    """Two languages; toxic documents have one bad sentence; labels and rows that are held out."""
    rng, rows, labels = random.Random(3), [], []
    for i in range(n):
        text = [sentences(rng, DE if i % 2 else EN, 12) for _ in range(6)]
        toxic = i % 5 == 0
        if toxic:
            text[rng.randrange(6)] = f"You are a {rng.choice(['rotten', 'nasty'])} {rng.choice(['grumblings', 'grumbler', 'snarfs'])}."
        rows.append((i, " ".join(text), "de" if i % 2 else "en", "s", 0))
        labels.append((i, int(i % 7 != 0), int(toxic)))
    return rows, labels


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 3 == 1


# --- language ------------------------------------------------------------------------------------------------------


def test_language_on_held_out_rows(spark):
    rows, _ = corpus()
    got = {r["doc_id"]: r for r in langid.predict(frame(spark, rows)).collect()}
    assert all(got[r[0]]["held_out"] == held(r[0]) and got[r[0]]["lang_pred"] == r[2] and 0 <= got[r[0]]["score"] <= 1 for r in rows)


@pytest.mark.parametrize("make", [frame, crowded])
def test_language_cases(spark, make):
    rows = documents() + corpus(60)[0]
    got = langid.predict(make(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["lang_pred"]) for r in got}
    for doc, text, *_ in rows:
        if not text or not any(map(str.isalpha, text)):
            assert (doc, "und") in by
    assert langid.predict(frame(spark, [])).count() == 0
    assert {r["lang_pred"] for r in langid.predict(frame(spark, [(1, EN, None, None, None)])).collect()} == {"und"}
    kept = langid.known(make(spark, rows))
    assert kept.columns == make(spark, rows).columns
    assert {r["doc_id"] for r in kept.collect()} >= {r[0] for r in corpus(60)[0]} - {r[0] for r in documents()}


def test_bloom_filter_returns_all_languages_and_windows_agree(monkeypatch):
    rows = [(EN, "en")] * 3 + [(DE, "de")] * 3
    f = langid.Filters.learn(rows)
    for lang, text in (("en", EN), ("de", DE)):
        bit = f.languages.index(lang)
        for s in langid.Filters.slots(langid.grams(langid.padded(text))):
            assert ((f.masks[s] >> langid.U(bit)) & langid.U(1)).all()
    whole = f.shares([EN * 50, DE, ""])
    monkeypatch.setattr(langid, "WINDOW", 500)
    assert (abs(f.shares([EN * 50, DE, ""]) - whole) < 1e-12).all()


def test_languages_equal_exact_sets_of_ngrams(spark):
    """The filters against sets: shares may differ by the filters' false positives only."""
    rows = corpus(120)[0] + [(5000 + i, EN[:40] + " " + DE[:30] + " zzz" * i, None, None, None) for i in range(8)]
    learnt = [r for r in rows if r[2] and not held(r[0])]

    def ngrams(text):
        raw = b"   " + text.lower().encode() + b"   "
        raw = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in raw)
        return [raw[i : i + 4] for i in range(len(raw) - 3) if raw[i : i + 4].strip()]

    known = {}
    for lang in ("en", "de"):
        texts = [r[1] for r in learnt if r[2] == lang]
        n = Counter(g for t in texts for g in set(ngrams(t)))
        known[lang] = {g for g, k in n.items() if k >= max(2, langid.MIN_SHARE * len(texts))}
    got = {r["doc_id"]: r for r in langid.predict(frame(spark, rows)).collect()}
    for doc, text, *_ in rows:
        g = ngrams(text)
        share = {lang: sum(x in s for x in g) / len(g) for lang, s in known.items()}
        best = max(share, key=share.get)
        assert abs(got[doc]["score"] - share[best]) < 1e-3
        assert got[doc]["lang_pred"] == best or abs(share["en"] - share["de"]) < 1e-3


def test_languages_beyond_one_mask_and_rare_ones(spark, monkeypatch):
    rng = random.Random(5)
    own = {f"x{k:02}": ["".join(rng.choices("bcdfghjklmnpqrstvwxz", k=7)) for _ in range(30)] for k in range(70)}
    rows = [(1000 * k + i, " ".join(rng.choices(v, k=40)), lang, "s", 0) for k, (lang, v) in enumerate(own.items()) for i in range(12)]
    got = langid.predict(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {r[0]: r[2] for r in rows}
    # a language of a hundredth of the rows, and a sample of a tenth of them
    common = [(i, " ".join(rng.choices(own["x00"], k=40)), "x00", "s", 0) for i in range(600)]
    rare = [(10_000 + i, " ".join(rng.choices(own["x01"], k=40)), "x01", "s", 0) for i in range(6)]
    monkeypatch.setattr(langid, "SAMPLE", 60)
    got = {r["doc_id"]: r for r in langid.predict(frame(spark, common + rare)).collect()}
    assert all(got[r[0]]["lang_pred"] == r[2] and got[r[0]]["score"] > 0.25 for r in rare)


# --- toxicity ------------------------------------------------------------------------------------------------------


def test_toxicity_finds_sentences(spark):
    rows, labels = corpus()
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.learn(docs, marks)).collect()
    truth = {x[0]: x[2] for x in labels}
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["predicted"] == truth[r["doc_id"]] for r in got)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        if truth[r["doc_id"]]:
            assert [texts[r["doc_id"]][s["start"] : s["end"]].strip()[:9] for s in r["offending"]] == ["You are a"]


def test_noisy_or_is_what_combines():
    m = toxicity.Model(-2.0, {"bad": 3.0})
    one, _ = m.offences("bad.")
    both, found = m.offences("bad. bad")
    assert math.isclose(one, 1 / (1 + math.exp(-1))) and math.isclose(both, 1 - (1 - one) ** 2) and len(found) == 2
    assert m.offences("")[0] == 0 and m.offences(" . \n")[0] == 0


@pytest.mark.parametrize("make", [frame, crowded])
def test_toxicity_scores_equal_brute_force(spark, make):
    rng = random.Random(8)
    vocabulary = sorted({w for r in documents() if r[1] for w in re.split(r"[^a-z]+", r[1].lower()) if w})[:400]
    weight = {w: rng.uniform(-3, 3) for w in rng.sample(vocabulary, 200)} | {w[:k] + "*": rng.uniform(-1, 1) for w in vocabulary[:100] for k in range(3, min(7, len(w)) + 1)}
    bias = -3.0
    want = []
    for doc, text, *_ in documents():
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", text or ""):
            w = set(re.sub(r"[^\w\s😀]|[\d_]", " ", sentence.lower()).split())
            if not sentence.strip():
                continue
            z = bias + sum(weight.get(x, 0) + sum(weight.get(x[:k] + "*", 0) for k in range(3, min(7, len(x)) + 1)) for x in w)
            clean *= 1 - 1 / (1 + math.exp(-z))
        want.append((doc, 1 - clean))
    got = toxicity.score(make(spark), toxicity.Model(bias, weight)).collect()
    key = lambda x: repr((x[0], round(x[1], 6)))
    assert sorted(map(key, ((r["doc_id"], r["score"]) for r in got))) == sorted(map(key, want))


@pytest.mark.parametrize("make", [frame, crowded])
def test_toxicity_cases(spark, make):
    marks = spark.createDataFrame([(999, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    docs = make(spark)
    got = toxicity.score(docs, toxicity.learn(docs, marks)).collect()
    assert len(got) == len(documents()) and all(r["score"] < 1e-3 and r["predicted"] == 0 for r in got)
    assert toxicity.score(frame(spark, []), toxicity.Model()).count() == 0


def test_sample_is_bounded_and_leaves_out(spark):
    rows, labels = corpus()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sample(frame(spark, rows), marks, "toxic", 50)
    allowed = {r[1] for r in rows if not held(r[0])}
    assert len(got) == 50 and all(t in allowed for t, _ in got)
    assert got == sample(frame(spark, rows, 7), marks, "toxic", 50)


# --- quality -------------------------------------------------------------------------------------------------------


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    again = {i + k for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


@pytest.mark.parametrize("make", [frame, crowded])
def test_quality_counts(spark, make):
    rows = documents() + [(800, "a b\x1c c d " * 30, None, None, None), (801, "a b c a b c # | <x>\n#\n#\n \n \n", None, None, None)]
    got = quality.judge(make(spark, rows), quality.Field()).collect()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(repr(tuple(r[c] for c in names)) for r in got) == sorted(repr((r[0], *brute_quality(r[1]))) for r in rows)
    assert all(r["kept"] == (not r["base_failed"]) for r in got)  # an untrained field calls all lines content
    assert quality.judge(frame(spark, []), quality.Field()).count() == 0


def test_a_label_without_words_is_no_label():
    assert quality.Field.fit([("good words here.", 1), (" \n ", 0)]) == quality.Field() == quality.Field.fit([("", 1), ("", 0)])


def test_viterbi_is_the_best_labelling():
    rng = random.Random(4)
    for _ in range(60):
        m = quality.Field([rng.uniform(-2, 2) for _ in range(quality.FEATURES)], [[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)])
        found = [[0, rng.randrange(1, quality.FEATURES)] for _ in range(rng.randint(1, 7))]

        def score(y, m=m, found=found):
            return sum(sum(m.weight[k] for k in f) for f, a in zip(found, y, strict=True) if a) + sum(m.step[a][b] for a, b in zip(y, y[1:], strict=False))

        best = max(score([n >> i & 1 for i in range(len(found))]) for n in range(1 << len(found)))
        assert math.isclose(score(m.decode(found)), best, abs_tol=1e-9)


def test_field_learns_lines(spark):
    rng, rows, labels = random.Random(5), [], []
    for i in range(200):
        good = i % 4 != 0
        lines = [sentences(rng, EN, 14).capitalize() for _ in range(8)] if good else [" | ".join(words(rng, 9).split()) for _ in range(8)]
        rows.append((i, "\n".join(lines), "en", "s", 0))
        labels.append((i, int(good), 0))
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.judge(docs, quality.learn(docs, marks)).collect()
    assert all(r["kept"] == bool(labels[r["doc_id"]][1]) or r["base_failed"] for r in got)
    mixed = quality.learn(docs, marks).decode(quality.lines("\n".join([rows[1][1], rows[0][1]]).encode())[0])
    assert mixed == [0] * 8 + [1] * 8


# --- mixing --------------------------------------------------------------------------------------------------------


def brute_mix(rows, seed=17):
    import hashlib

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    chars, n = Counter(), Counter()
    for _, t, _, s, _ in rows:
        chars[s] += len(t or "")
        n[s] += 1
    out = []
    for d, t, _, s, _ in rows:
        mean = 1 / len(n) * (sum(chars.values()) / chars[s] if chars[s] else sum(n.values()) / n[s])
        name = "~" if d is None else str(d)
        u = int(md5(f"{seed}|count|{name}|{md5(t or '')}|1")[:13], 16) / 2**52
        p = c = math.exp(-mean)
        k = 0
        while c <= u:
            k += 1
            p *= mean / k
            c += p
        out += [(d, r) for r in range(k)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("make", [frame, crowded])
def test_mix_equals_brute_force(spark, make):
    rows = documents()
    df = make(spark, rows)
    out = mixing.mix(df)
    assert [c for c in df.columns if c != "replica"] + ["replica", "shuffle_key"] == out.columns
    got = out.collect()
    assert sorted(repr((r["doc_id"], r["replica"])) for r in got) == brute_mix(rows)
    assert [r["shuffle_key"] for r in got] == sorted(r["shuffle_key"] for r in got)
    assert mixing.mix(frame(spark, [])).count() == 0


def test_mixing_keeps_columns_of_any_name(spark):
    docs = crowded(spark).withColumns({c: F.lit(c) for c in ("_source", "_rate", "_n", "replica", "shuffle_key", "digest", "u", "low", "table")})
    got = mixing.repeated(docs, size=3.0)
    assert got.columns == docs.columns
    assert all(r["replica"] == "replica" and r["_n"] == "_n" and r["low"] == "low" for r in got.collect())
    assert mixing.repeated(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).columns[-2:] == ["replica", "shuffle_key"]


def test_large_means_are_inverted_exactly(spark):
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (0.3, 40.0, 900.0, 5000.0)])).alias("mean"))
    rows = rows.withColumn("low", F.greatest(F.lit(0), F.floor(F.col("mean") - 12 * F.sqrt("mean") - 20)).cast("int"))
    for r in rows.withColumn("table", mixing.cumulative(F.col("mean"), F.col("low"))).collect():
        logs = [k * math.log(r["mean"]) - r["mean"] - math.lgamma(k + 1) for k in range(r["low"], r["low"] + len(r["table"]))]
        total = 0.0
        for x, c in zip(logs, r["table"], strict=True):
            total += math.exp(x)
            assert abs(total - c) < 1e-9
        assert r["table"][-1] == 1.0


def test_mix_reaches_weights(spark):
    rows = [(i, "x" * 10, None, "abc"[(i % 10 > 5) + (i % 10 > 8)], None) for i in range(6000)]
    n = Counter(r["source"] for r in mixing.mix(frame(spark, rows), {"a": 1.0, "b": 2.0, "c": 1.0}, size=2.0).collect())
    assert all(abs(n[s] - 12000 * w / 4) < 350 for s, w in (("a", 1), ("b", 2), ("c", 1)))
    many = mixing.mix(frame(spark, rows[:60]), {"c": 1.0}, default_weight=0.0, size=200.0).count()
    assert abs(many - 12000) < 600  # rates of over 500 are sums of draws


# --- chat ----------------------------------------------------------------------------------------------------------

SCHEMAS = {"add": {"type": "object", "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "number"}}, "required": ["a"], "additionalProperties": False}}


def call(i, name="add", after=(), **arguments):
    return "<tool_call>" + json.dumps({"id": i, "name": name, "arguments": arguments, "after": list(after)}) + "</tool_call>"


def test_tool_calls(spark):
    turns = [
        (1, 0, "user", "Hi é \"q\""), (1, 1, "assistant", "Let me " + call("x", a=1) + call("y", after=["x"], a=-1)), (1, 2, "tool", '{"tool_call_id": "y", "content": {"z": 1, "a": 2}}'),
        (1, 3, "tool", '{"tool_call_id": "x", "content": 3}'), (1, 4, "tool", '{"tool_call_id": "nobody", "content": null}'), (1, 5, "assistant", call("x", a=2)),
        (2, 0, "tool", '{"tool_call_id": "p", "content": "early"}'), (2, 1, "assistant", call("p", a=1, q=1) + call("u", name="sub")), (2, 2, "assistant", "<tool_call>not json</tool_call>"),
        (3, 0, "assistant", call("m", after=["n"], a=1)), (3, 1, "assistant", call("n", after=["m"], a=1)), (3, 2, "tool", '{"tool_call_id": "m", "content": 1}'), (3, 3, "tool", '{"tool_call_id": "n", "content": 1}'),
        (None, None, None, None),
    ]
    got = chat.link(spark.createDataFrame([(*t, 5) for t in turns], "conv_id long, turn long, role string, text string, id int"), SCHEMAS).collect()
    status = {(r["conv_id"], r["kind"], r["call_id"], r["turn"]): r["status"] for r in got}
    assert status[1, "call", "x", 1] == "ok" and status[1, "result", "x", 3] == "ok"
    assert status[1, "call", "y", 1] == "$.a: out of range"
    assert status[1, "result", "nobody", 4] == "orphan" and status[1, "call", "x", 5] == "duplicate"
    assert status[2, "call", "p", 1] == "$.q: unknown" and status[2, "call", "u", 1] == "unknown tool sub"
    assert {v for k, v in status.items() if k[0] == 3} == {"cyclic"}
    order = [(r["kind"], r["call_id"]) for r in got if r["conv_id"] == 1 and r["kind"] != "message"]
    assert order.index(("call", "x")) < order.index(("result", "x")) < order.index(("call", "y")) < order.index(("result", "y"))
    assert [r["kind"] for r in got if r["conv_id"] == 2 and r["call_id"] == "p"] == ["call", "result"]
    texts = {(r["conv_id"], r["turn"], r["kind"]): r["json"] for r in got}
    assert texts[1, 0, "message"] == '{"content":"Hi é \\"q\\"","role":"user"}'
    assert texts[1, 2, "result"] == '{"content":{"a":2,"z":1},"role":"tool","tool_call_id":"y"}'
    assert texts[None, None, "message"] == '{"content":"","role":null}'
    assert texts[2, 2, "message"] == '{"content":"<tool_call>not json</tool_call>","role":"assistant"}'
    assert chat.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_query_checks_arguments(spark, tmp_path):
    from nestql.llm.queries import op4_tool_call_linking

    turns = [(1, 0, "assistant", call("x", "search", query="q", limit=2) + call("y", "search", query=1) + call("z", "add", a=1) + call("w", "add", a=-1))]
    turns += [(1, i + 1, "tool", json.dumps({"tool_call_id": k, "content": 0})) for i, k in enumerate("xyzw")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))

    def status():
        return {r["call_id"]: r["status"] for r in op4_tool_call_linking(spark, str(tmp_path)).collect() if r["kind"] == "call"}

    assert status() == {"x": "ok", "y": "$.query: not string", "z": "unknown tool add", "w": "unknown tool add"}
    (tmp_path / "tools.json").write_text(json.dumps(SCHEMAS, indent=1))
    assert status() == {"x": "unknown tool search", "y": "unknown tool search", "z": "ok", "w": "$.a: out of range"}


# --- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    rows = documents() + [(r[0] + 1000, *r[1:]) for r in corpus(60)[0]]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == columns
    known, one, cut, mixed, packed = seen.values()
    assert all(r["text"] for r in known)
    from .test_dedup import brute_jaccard, brute_suffix

    classes = {eval(x)[1] for x in brute_jaccard([tuple(r) for r in known])}  # noqa: S307  one of our own reprs
    assert {r["doc_id"] for r in one} == classes - {None}
    want = sorted(eval(x)[-1] for x in brute_suffix([tuple(r) for r in one]))  # noqa: S307
    assert sorted(r["text"] for r in cut) == want and all(r["n_chars"] == len(r["text"]) for r in cut)
    assert sorted(repr(r["doc_id"]) for r in mixed) == sorted(repr(eval(x)[0]) for x in brute_mix([tuple(r) for r in cut]))  # noqa: S307
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: repr(tuple(r)[:5])
    assert sorted(map(key, whole)) == sorted(map(key, packed))
    assert suffix.LENGTH == 50


def test_pipeline_stages_of_empty_and_crowded_tables(spark, tmp_path):
    names = {c: F.lit(c) for c in ("_d", "_t", "lang_pred", "n_bytes", "shuffle_key", "_rate", "c0", "seg")}
    crowd = crowded(spark, documents() + [(r[0] + 1000, *r[1:]) for r in corpus(60)[0]]).withColumns(names)
    for docs in (frame(spark, []), crowd):
        columns, there = docs.columns, docs is crowd
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            if i < 4:
                assert docs.columns == columns, name
            docs.write.mode("overwrite").parquet(str(tmp_path / f"{name}-{there}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}-{there}"))
            if there and i < 4:
                assert {tuple(r) for r in docs.select(*names).distinct().collect()} == {tuple(names)}
        assert (docs.count() > 0) == there
