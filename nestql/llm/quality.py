"""Quality rules: a linear-chain conditional random field labels each line as content or boilerplate.

The base rules count words, symbols, repeated lines and repeated three-word windows. Then Viterbi decoding finds the most
likely labels of the document's lines, and the share of words in content lines decides.

The field has a weight for each feature of a line (layout, symbols, capitals, repetition) and for each pair of
neighbouring labels. It is trained by maximum likelihood, with the forward-backward algorithm, on at most SAMPLE documents
with a quality label that aren't held out: their lines carry the label of the document, since no lines are labelled.

Cases: a null text counts as empty: no words, so it fails. Lines without a word are no lines for the field. Without
labels, or with one kind of label only on texts that have words, each line is content. Repeated rows are judged one by one, extra columns are
ignored, an empty table gives no rows. Long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import tidy
from .store import small_batches
from .textvec import BASE, U, grouped, mix, word_hashes
from .training import sample

SAMPLE, STEPS, RATE, SHRINK = 3000, 120, 0.15, 1e-3
MIN_WORDS, REPEATED, CONTENT = 50, 0.5, 0.5
SLICE = 1 << 20
SYMBOLS = b"#*$%&|<>"
_UPPER, _DIGIT = bytes(range(65, 91)), b"0123456789"
FEATURES = 14


def features(line: bytes, again: bool) -> list[int]:
    w = line.split()
    n = len(w)
    size = len(line)
    marks = size - len(line.translate(None, SYMBOLS))
    out = [0]
    if n <= 3:
        out.append(1)
    if n > 100:
        out.append(2)
    if 5 * marks > n:
        out.append(3)
    if marks > n:
        out.append(4)
    if 3 * (size - len(line.translate(None, _UPPER))) > size:
        out.append(5)
    if 3 * line.count(b"!") > n:
        out.append(6)
    if 2 * len(set(w)) < n:
        out.append(7)
    if 3 * sum(a == b for a, b in zip(w, w[1:], strict=False)) > n:
        out.append(8)
    if 5 * (size - len(line.translate(None, _DIGIT))) > size:
        out.append(9)
    last = w[-1][-1:]
    if last in (b".", b"!", b"?"):
        out.append(10)
    if last == b"." and marks == 0:
        out.append(11)
    if again:
        out.append(12)
    if line.count(b" | ") > 1:
        out.append(13)
    return out


def lines(text: bytes) -> tuple[list[list[int]], list[int], int]:
    """Features and word counts of the lines with a word, and how many of them equal an earlier line."""
    found, sizes, seen, twice = [], [], set(), 0
    for line in text.split(b"\n"):
        n = len(line.split())
        if n:
            again = line in seen
            twice += again
            seen.add(line)
            found.append(features(line, again))
            sizes.append(n)
    return found, sizes, twice


@dataclass
class Field:
    """Label 1 is boilerplate; label 0 has no feature weights."""

    weight: list[float] = field(default_factory=lambda: [-1.0] + [0.0] * (FEATURES - 1))
    step: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])

    @classmethod
    def fit(cls, rows: list[tuple[str, int]]) -> Field:
        if len({bool(q) for _, q in rows}) < 2:
            return cls()
        chains = [(lines(t.encode("utf-8", "surrogatepass"))[0], 0 if q else 1) for t, q in rows]
        chains = sorted((c for c in chains if c[0]), key=lambda c: -len(c[0]))
        if len({y for _, y in chains}) < 2:  # the texts of a label are all blank
            return cls()
        size = np.array([len(c) for c, _ in chains])
        label = np.array([y for _, y in chains])
        x = np.zeros((size.sum(), FEATURES))
        for i, f in enumerate(f for c, _ in chains for f in c):
            x[i, f] = 1
        begin, top, n = np.cumsum(size) - size, int(size.max()), size.sum()
        live = [int(np.searchsorted(-size, -t)) for t in range(top)]  # chains longer than t
        y = np.repeat(label, size)
        w, step = np.zeros(FEATURES), np.zeros((2, 2))
        square = [np.zeros(FEATURES), np.zeros((2, 2))]
        for _ in range(STEPS):
            z = x @ w
            state = np.stack([np.zeros(n), z], axis=1)
            ahead = np.zeros((n, 2))
            ahead[begin] = state[begin]
            for t in range(1, top):
                at = begin[: live[t]] + t
                ahead[at] = state[at] + np.logaddexp(ahead[at - 1, :1] + step[0], ahead[at - 1, 1:] + step[1])
            back, pair = np.zeros((n, 2)), np.zeros((2, 2))
            total = np.logaddexp(*ahead[begin + size - 1].T)
            for t in range(top - 1, 0, -1):
                at = begin[: live[t]] + t
                after = state[at] + back[at]
                back[at - 1] = np.logaddexp(after[:, :1] + step[:, 0], after[:, 1:] + step[:, 1])
                joint = ahead[at - 1][:, :, None] + step + after[:, None, :] - total[: live[t], None, None]
                pair += np.exp(joint).sum(axis=0)
            share = np.exp((ahead + back - np.repeat(total, size)[:, None])[:, 1])
            seen = np.diag([((size - 1) * (label == k)).sum() for k in (0, 1)])
            grads = [x.T @ (y - share) / n - SHRINK * w, (seen - pair) / n - SHRINK * step]
            for value, g, s in zip((w, step), grads, square, strict=True):
                s += g * g
                value += RATE * g / (np.sqrt(s) + 1e-8)
        return cls(w.tolist(), step.tolist())

    def decode(self, found: list[list[int]]) -> list[int]:
        """The most likely labels (Viterbi)."""
        w, ((aa, ab), (ba, bb)) = self.weight, self.step
        a, b, came = 0.0, 0.0, []
        for i, f in enumerate(found):
            z = sum([w[k] for k in f])
            if i:
                to_a, to_b = a + aa >= b + ba, a + ab >= b + bb
                a, b = (a + aa if to_a else b + ba), (a + ab if to_b else b + bb) + z
                came.append((0 if to_a else 1, 0 if to_b else 1))
            else:
                b = z
        label = [int(b > a)] if found else []
        for step in reversed(came):
            label.append(step[label[-1]])
        return label[::-1]


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Field:
    return Field.fit([(t, int(q)) for t, q in sample(docs, labels, label, SAMPLE)])


def counts(texts: list[bytes]) -> list[tuple[int, int, int, int]]:
    """n_words, word_chars, n_symbols, n_repeat_words of each text."""
    out = []
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    for i, j in grouped(texts, SLICE):
        h, at = word_hashes(texts[i:j])
        n = np.diff(at)
        text = np.repeat(np.arange(j - i), n)
        repeated = np.zeros(len(h), bool)
        if len(h) > 2:
            g = mix(h[:-2] * U(BASE) + mix(h[1:-1] * U(BASE) + mix(h[2:] + text[2:].astype(U))))
            g = g[ok] if not (ok := text[:-2] == text[2:]).all() else g
            where = np.flatnonzero(ok)
            _, inverse, times = np.unique(g, return_inverse=True, return_counts=True)
            twice = where[times[inverse] > 1]
            for k in range(3):
                repeated[twice + k] = True
        again = np.bincount(text[repeated], minlength=j - i)
        for t, words, r in zip(texts[i:j], n.tolist(), again.tolist(), strict=True):
            b = np.frombuffer(t, np.uint8)
            solid = (b != 32) & ((b < 9) | (b > 13)) & ((b & 0xC0) != 0x80)
            out.append((words, int(np.count_nonzero(solid)), int(np.count_nonzero(symbol[b])), r))
    return out


def judge(docs: DataFrame, model: Field, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, then the counts, base_failed, content_share (of words), labels (1: boilerplate) and kept."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(batch.num_columns - 1).to_pylist()]
            out = []
            for text, (n, chars, symbols, repeated) in zip(texts, counts(texts), strict=True):
                found, sizes, twice = lines(text)
                label = model.decode(found)
                content = sum(s for s, y in zip(sizes, label, strict=True) if not y)
                share, failed = content / n if n else 0.0, n < MIN_WORDS or repeated > REPEATED * n
                out.append((n, chars, symbols, twice, repeated, failed, share, label, not failed and share >= CONTENT))
            cols = list(zip(*out, strict=True)) or [[]] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.list_(pa.int32()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=[*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "labels", "kept"])

    small_batches(docs.sparkSession)
    out = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[:-1])
    return out.mapInArrow(run, f"{types}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, labels array<int>, kept boolean")
