"""Language identification by language-bitmask n-gram filters.

All languages share one bit-sliced Bloom filter: each slot holds a mask with a bit for each language, of as many 64-bit
words as that takes. An n-gram of a
language sets its bit in HASHES slots; a lookup ANDs the slots' masks and so returns all languages that contain the
n-gram at once. For a text, each language's bits are counted over all n-grams, and the count is corrected for the false
positives to be expected from the share of slots that have the language's bit. The language with the largest
corrected share decides.

Learnt from a bounded sample of the documents with a language that aren't held out: SAMPLE documents dealt evenly to the
languages, but EACH of a language at least, or all it has. An n-gram belongs to a language if at least MIN_SHARE of the
language's sampled documents, and two of them, hold it.

Cases: ``und`` with score 0 for a text that is null or without a letter, or if there was nothing to learn from. A text
with letters but no known n-gram gets the most frequent language, with score 0; ties go to the more frequent language.
Repeated rows are scored one by one; extra columns are ignored; an empty table gives no rows. Long texts are scored
whole, in windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import tidy
from .store import small_batches
from .textvec import BASE, U, grouped, mix
from .training import held_out, sample_each

SAMPLE, EACH, N, SLOTS, HASHES, MIN_SHARE = 6000, 20, 4, 1 << 20, 3, 0.02
WINDOW = 1 << 20


def grams(raw: bytes) -> np.ndarray:
    """Codes of N bytes in a row that hold a letter's byte at least; what is no letter counts as a space."""
    buf = np.frombuffer(raw, np.uint8)
    letter = ((buf >= 97) & (buf <= 122)) | (buf >= 128)
    buf = np.where(letter, buf, 32).astype(np.uint32)
    n = len(buf) - N + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    code, count = np.zeros(n, np.uint32), np.zeros(n, np.int8)
    for i in range(N):
        code = (code << np.uint32(8)) | buf[i : i + n]
        count += letter[i : i + n]
    return code[count >= 1]


def padded(text: str) -> bytes:
    return b"   " + text.lower().encode("utf-8", "surrogatepass") + b"   "


@dataclass
class Filters:
    languages: list[str]  # most frequent first
    masks: np.ndarray
    wrong: np.ndarray  # by language, the chance that an n-gram it lacks is found

    @staticmethod
    def slots(code: np.ndarray) -> list[np.ndarray]:
        h = mix(code.astype(U) + U(BASE))
        return [((h >> U(20 * i)) % U(SLOTS)).astype(np.int64) for i in range(HASHES)]

    @classmethod
    def learn(cls, rows: list[tuple[str, str]], languages: list[str] | None = None) -> Filters:
        """languages: the most frequent first, if the rows don't tell."""
        by: dict[str, list[str]] = {}
        for text, lang in rows:
            by.setdefault(lang, []).append(text)
        languages = languages or sorted(by, key=lambda x: (-len(by[x]), x))
        masks = np.zeros((SLOTS, -(-len(languages) // 64)), U)
        fill = np.zeros(len(languages))
        for i, lang in enumerate(languages):
            word, bit = divmod(i, 64)
            found = np.concatenate([np.unique(grams(padded(t))) for t in by.get(lang, [""])])
            code, n = np.unique(found, return_counts=True)
            for s in cls.slots(code[n >= max(2, MIN_SHARE * len(by.get(lang, ())))]):
                masks[s, word] |= U(1) << U(bit)
            fill[i] = np.count_nonzero(masks[:, word] & (U(1) << U(bit))) / SLOTS
        return cls(languages, masks, fill**HASHES)

    def shares(self, texts: list[str]) -> np.ndarray:
        """A row for each text: the share of its n-grams that each language contains, corrected."""
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        raw = [padded(t) for t in texts]
        for a, b in grouped(raw, WINDOW):
            pieces = raw[a:b]
            if b - a == 1 and len(raw[a]) > 2 * WINDOW:
                pieces = [raw[a][i : i + WINDOW + N - 1] for i in range(0, len(raw[a]) - N + 1, WINDOW)]
                owner = [a] * len(pieces)
            else:
                owner = list(range(a, b))
            codes = [grams(p) for p in pieces]
            size = np.array([len(c) for c in codes])
            code = np.concatenate(codes)
            first, *rest = self.slots(code)
            text = np.repeat(np.array(owner), size)
            total += np.bincount(text, minlength=len(texts))
            for word in range(self.masks.shape[1]):
                masks = self.masks[:, word]
                mask = masks[first]
                for s in rest:
                    mask &= masks[s]
                for bit, i in enumerate(range(64 * word, min(64 * word + 64, len(self.languages)))):
                    hits[:, i] += np.bincount(text[(mask >> U(bit)) & U(1) == 1], minlength=len(texts))
        wrong = self.wrong[None, :]
        return np.clip((hits / np.maximum(total, 1)[:, None] - wrong) / np.maximum(1 - wrong, 1e-9), 0, 1)


def learn(docs: DataFrame) -> Filters:
    rows, languages = sample_each(docs, "lang", SAMPLE, EACH)
    return Filters.learn([(t, str(x)) for t, x in rows], [str(x) for x in languages])


def identify(docs: DataFrame, filters: Filters, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns keep, then lang_pred and score (the corrected share of n-grams of the language that decides)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            shares = filters.shares(texts) if filters.languages else np.zeros((len(texts), 1))
            best = shares.argmax(axis=1)
            lang, score = [], []
            for t, k, s in zip(texts, best.tolist(), shares, strict=True):
                known = bool(filters.languages) and any(map(str.isalpha, t))
                lang.append(filters.languages[k] if known else "und")
                score.append(float(s[k]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    small_batches(docs.sparkSession)
    out = docs.select(*[F.col(f"`{c}`") for c in keep], *(["text"] if "text" not in keep else []))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[: len(keep)])
    return out.mapInArrow(run, f"{types}, lang_pred string, score double")


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    out = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), learn(docs), ("doc_id",))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def known(docs: DataFrame, least: float = 0.25) -> DataFrame:
    """docs without those whose language can't be told: ``und``, or a score under least."""
    aside = {c: f"_own_{c}" for c in docs.columns if c.lower() in ("lang_pred", "score")}
    renamed = docs.withColumnsRenamed(aside)
    out = identify(renamed, learn(docs), tuple(renamed.columns)).filter(F.col("score") >= least).filter("lang_pred <> 'und'")
    return out.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])
