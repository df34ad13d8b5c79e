"""Toxicity by multiple-instance learning: sentences are the instances, documents the bags.

A sentence's score is the logistic function of a bias and the weights of its words and their beginnings; a document's is the noisy-or of its
sentences', 1 - prod(1 - p). Only documents have labels: the weights are fitted to them through the noisy-or, on at most
SAMPLE labelled documents that aren't held out, with words that MIN_DOCS of them hold and that
go with the labels (likelihood ratio over EVIDENCE, beyond what chance gives any of some 100,000 words). Their log odds
over documents are where the fit starts. Scoring then also tells which
sentences offend.

Cases: a null text, or one without a word, has no sentence and scores 0. Without labels every score is 0. Repeated rows
are scored one by one; extra columns are ignored; an empty table gives no rows. Labels of ids that aren't there are
ignored; of several labels of an id, each counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import tidy
from .store import small_batches
from .training import held_out, sample

SAMPLE, MIN_DOCS, EVIDENCE, STEPS, RATE, SHRINK = 4000, 4, 24.0, 250, 0.1, 1e-5
THRESHOLD, OFFENDS, TINY, REMEMBERED = 0.7, 0.5, 0.1, 500_000
_SENTENCE = re.compile(r"[^.!?\n]+")
_END = re.compile(r"[.!?\n]")
_NO_WORD = str.maketrans({c: " " for c in "\t\r\v\f,;:\"'()[]{}<>*#$%&|/\\+=_~^`-–—«»“”„…0123456789"})


def sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _SENTENCE.finditer(text)]


def words(text: str) -> list[str]:
    return text.lower().translate(_NO_WORD).split()


def features(word: str) -> list[str]:
    """The word, and its beginnings: inflected forms share them."""
    return [word, *(word[:k] + "*" for k in range(3, min(7, len(word)) + 1))]


@dataclass
class Model:
    bias: float = -20.0
    weight: dict[str, float] = field(default_factory=dict)
    known: dict[str, float] = field(default_factory=dict, repr=False)  # sums for words, as they come

    def __getstate__(self) -> dict:
        return {"bias": self.bias, "weight": self.weight, "known": {}}

    def of(self, word: str) -> float:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        w = self.known[word] = sum(self.weight.get(f, 0.0) for f in features(word))
        return w

    @classmethod
    def fit(cls, rows: list[tuple[str, int]]) -> Model:
        if not any(y for _, y in rows):
            return cls()
        n, positive = len(rows), sum(1 for _, t in rows if t)
        seen, toxic_docs = Counter(), Counter()
        parts: dict[str, list[str]] = {}
        for text, t in rows:
            found: set[str] = set()
            for x in set(words(_END.sub(" ", text))):
                if x not in parts:
                    parts[x] = features(x)
                found.update(parts[x])
            seen.update(found)
            if t:
                toxic_docs.update(found)
        kept, start = {}, []
        for x, k in sorted(seen.items()):
            if k < MIN_DOCS:
                continue
            table = np.array([[toxic_docs[x], k - toxic_docs[x]], [positive - toxic_docs[x], n - positive - k + toxic_docs[x]]], np.float64)
            expected = table.sum(axis=1, keepdims=True) * table.sum(axis=0, keepdims=True) / n
            if 2 * (table * np.log(np.maximum(table, 1e-9) / np.maximum(expected, 1e-9))).sum() > EVIDENCE:
                (a, b), (c, d) = table + 0.5
                kept[x] = len(kept)
                start.append(np.clip(np.log(a * d / (b * c)), -2, 8))
        held = {x: [kept[f] for f in fs if f in kept] for x, fs in parts.items()}
        index, ends, bag = [], [], []
        for d, (text, _) in enumerate(rows):
            for a, b in sentences(text):
                for x in set(words(text[a:b])):
                    index.extend(held.get(x, ()))
                ends.append(len(index))
                bag.append(d)
        index, bag = np.array(index, np.int64), np.array(bag, np.int64)
        ends = np.array(ends, np.int64)
        sentence = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        y, v = np.array([t for _, t in rows], np.float64), len(kept)
        w, bias = np.array(start, np.float64), -6.0
        m1, m2 = np.zeros(v + 1), np.zeros(v + 1)
        for step in range(1, STEPS + 1):
            z = bias + np.bincount(sentence, weights=w[index], minlength=len(ends))
            p = 1 / (1 + np.exp(-np.clip(z, -40, 30)))
            clean = np.exp(np.bincount(bag, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n))
            toxic = np.maximum(1 - clean, 1e-9)
            g = np.where(y[bag] > 0, -p * (clean / toxic)[bag], p)
            grad = np.append(np.bincount(index, weights=g[sentence], minlength=v) / n + SHRINK * w, g.sum() / n)
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
            move = RATE * (1 - step / (STEPS + 1)) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            w -= move[:-1]
            bias -= move[-1]
        return cls(float(bias), {x: float(w[i]) for x, i in kept.items() if abs(w[i]) > TINY})

    def offences(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and start, end (in characters) and score of each sentence that offends."""
        get, clean, found = self.known.get, 0.0, []
        base = np.logaddexp(0, self.bias)
        for a, b in sentences(text):
            z = self.bias
            for word in set(words(text[a:b])):
                w = get(word)
                z += self.of(word) if w is None else w
            if z == self.bias and not text[a:b].strip():
                continue
            loss = float(base if z == self.bias else np.logaddexp(0, z))  # -log(1 - p)
            clean += loss
            if loss > -np.log1p(-OFFENDS):
                found.append((a, b, float(-np.expm1(-loss))))
        return float(-np.expm1(-clean)), found


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    return Model.fit([(t, int(y)) for t, y in sample(docs, labels, label, SAMPLE)])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and offending: start, end and score of sentences."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            got = [model.offences(t) if t else (0.0, []) for t in batch.column(1).to_pylist()]
            spans = [[{"start": a, "end": b, "score": s} for a, b, s in x] for _, x in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "offending"])

    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.mapInArrow(run, "doc_id long, score double, offending array<struct<start:int,end:int,score:double>>")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")
