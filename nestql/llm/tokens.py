"""Exact, cached token ids: the text is cut where no token can cross, and each distinct piece is encoded once.

A subword model of this kind merges inside pre-tokens only, and its pre-tokens never cross the cuts made here:

* between a letter and an ASCII character that is none (a run of letters ends there, whatever follows);
* before ASCII white space. ``prefix`` models (byte-level, a space belongs to the word that follows) treat a run of white space as
  a whole, so only the start of a run is such a place; ``spaceless`` models drop white space, so each one is.

A batch of texts is one buffer, its pieces are stretches of it, and Arrow's hash table finds the distinct ones. The tokenizers
library encodes those that aren't known yet; ids of known ones lie in one flat array, from which a batch is gathered. Pieces
are compared byte by byte, so the result equals the encoding of the whole text (tests compare them). A text that holds an
added token's string (``<|endoftext|>``) is encoded whole, as the library treats such strings before it cuts anything.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .memory import keeps

#: Pieces and ids that a worker remembers; when there are more, the half of the pieces that is used most stays.
CACHE, FLAT = 800_000, 8 << 20
#: Longer pieces are encoded anew in each batch. Bytes that are cut, and that the library gets, at once.
LONGEST, SLICE, JOINED = 64, 1 << 20, 1 << 18
_LOADED: dict[tuple[str, str], Encoder] = {}

_ASCII = np.arange(256)
_LETTER = ((_ASCII | 32) >= 97) & ((_ASCII | 32) <= 122)
_SPACE = (_ASCII == 32) | ((_ASCII >= 9) & (_ASCII <= 13))
_OTHER = (_ASCII < 128) & ~_LETTER
_PRINTED = (_ASCII > 32) & (_ASCII < 127)


def cuts(buf: np.ndarray, spaceless: bool) -> np.ndarray:
    """Places before which a text may be cut."""
    found = [np.zeros(0, np.int64)]
    for a in range(0, len(buf), SLICE):
        b = buf[a - 2 : a + SLICE] if a else np.concatenate([np.zeros(2, np.uint8), buf[:SLICE]])
        before, last, here = b[:-2], b[1:-1], b[2:]
        # U+00C0 to U+00FF are letters, but for the signs of multiplication and division
        letter = _LETTER[last] | ((before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))
        space = _SPACE[here]
        found.append(np.flatnonzero((letter & _OTHER[here]) | (space if spaceless else space & _PRINTED[last])) + a)
    return np.concatenate(found)


class Encoder:
    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.spaceless = kind == "spaceless"
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        vocab = self.tok.get_vocab()
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)  # byte-level tokens have a character for each byte
        for token, i in vocab.items():
            self.n_bytes[i] = len(token.removesuffix("</w>") if self.spaceless else token)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.begin, self.count, self.used = (np.zeros(1 << 16, np.int64) for _ in range(3))
        self.flat = np.zeros(1 << 18, np.uint32)
        self.pieces = self.size = 0

    def _special(self, raw: bytes) -> bool:
        return any(t in raw for t in self.added)

    def _put(self, ids: np.ndarray, counts: np.ndarray) -> int:
        """Remember ids of pieces; returns the number of the first."""
        first, n = self.pieces, len(counts)
        while first + n > len(self.begin):
            self.begin, self.count, self.used = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count, self.used))
        if self.size + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[self.size : self.size + len(ids)] = ids
        self.count[first : first + n] = counts
        self.begin[first : first + n] = self.size + np.cumsum(counts) - counts
        self.used[first : first + n] = 0
        self.pieces, self.size = first + n, self.size + len(ids)
        return first

    def _trim(self) -> None:
        """Keep the half of the remembered pieces that is used most."""
        number, names = np.array(list(self.number.values()), np.int64), list(self.number)
        keep = np.argsort(-self.used[number], kind="stable")[: CACHE // 2]
        begin, count, used, flat = self.begin[number[keep]], self.count[number[keep]], self.used[number[keep]], self.flat
        self._forget()
        ids = flat[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())] if len(keep) else flat[:0]
        self._put(ids, count)
        self.used[: len(keep)] = used // 2
        self.number = {names[k]: i for i, k in enumerate(keep.tolist())}

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)

    def _joined(self, pieces: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces between which one text of them all is cut. sizes: bytes without white space that is dropped."""
        text = b"".join(pieces).decode()
        if self.spaceless and not text.isascii():  # normal forms and lower case change lengths
            e = self.tok.encode(text, add_special_tokens=False)
            ids, at = np.array(e.ids, np.uint32), np.array([a for a, _ in e.offsets], np.int64)
            ends = np.searchsorted(at, np.cumsum([len(p.decode()) for p in pieces]))
            return ids, np.diff(ends, prepend=0)
        ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        size, at = np.cumsum(sizes), np.append(0, np.cumsum(self.n_bytes[ids]))
        ends = np.searchsorted(at, size)
        if ends[-1] == len(at) or (at[ends] != size).any():
            raise ValueError("a token crosses a place where the text was cut")
        return ids, np.diff(ends, prepend=0)

    def _learn(self, new: list[bytes]) -> np.ndarray:
        """Numbers of pieces that weren't known."""
        size = np.fromiter(map(len, new), np.int64, len(new))
        raw = b"".join(new)
        buf, end = np.frombuffer(raw, np.uint8), np.cumsum(size)
        first, last = buf[end - size], buf[end - 1]
        space, wide = _SPACE[first], np.add.reduceat(buf >= 128, end - size, dtype=np.int64) > 0
        if self.spaceless:
            joined = np.ones(len(new), bool)
            new = [p if s else b" " + p for p, s in zip(new, space.tolist(), strict=True)]
        else:
            second, before = buf[np.minimum(end - size + 1, len(buf) - 1)], buf[end - 2]
            joined = space & (size > 1) & (_PRINTED[second] | (second == 0xC3)) & (_PRINTED[last] | (before == 0xC3))
        if self._special(raw):
            joined &= ~np.array([self._special(p) for p in new], bool)
        out, net = np.zeros(len(new), np.int64), size - space if self.spaceless else size
        for group in (np.flatnonzero(joined & ~wide), np.flatnonzero(joined & wide)):
            at = np.cumsum(size[group]) // JOINED
            for idx in np.split(group, np.flatnonzero(np.diff(at)) + 1) if len(group) else []:
                out[idx] = self._put(*self._joined([new[i] for i in idx.tolist()], net[idx])) + np.arange(len(idx))
        alone = np.flatnonzero(~joined)
        if len(alone):
            out[alone] = self._put(*self._each([new[i].decode() for i in alone.tolist()])) + np.arange(len(alone))
        return out

    def _numbers(self, buf: pa.Buffer, places: np.ndarray) -> np.ndarray:
        """The number of each piece of a buffer, cut at places (its ends among them)."""
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), buf]).dictionary_encode()
        names = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        get = self.number.get
        number = np.array([get(p, -1) for p in names], np.int64)
        if len(new := np.flatnonzero(number < 0)):
            fresh = [names[i] for i in new.tolist()]
            number[new] = self._learn(fresh)
            self.number.update((p, i) for p, i in zip(fresh, number[new].tolist(), strict=True) if len(p) <= LONGEST)
        self.used[number] += 1
        return number[np.asarray(pieces.indices)]

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's begin in it (one more at the end). None counts as the empty text.

        With an end_id, each text's ids end with it.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        at = np.frombuffer(texts.buffers()[1], np.int64, count=n + 1, offset=8 * texts.offset) if n else np.zeros(1, np.int64)
        if len(self.number) > CACHE or self.size > FLAT:
            self._trim()
        end = np.zeros(0, np.int64) if end_id is None else np.array([self._put(np.array([end_id], np.uint32), np.ones(1, np.int64))])
        raw = texts.buffers()[2] if at[-1] > at[0] else pa.py_buffer(b"")
        buf = np.frombuffer(raw, np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        raw = pa.py_buffer(buf)
        places = np.sort(np.concatenate([cuts(buf, self.spaceless), at]))
        places = places[np.append(True, places[1:] != places[:-1])]
        if self._special(buf.tobytes()):
            for i in range(n):
                if self._special(buf[at[i] : at[i + 1]].tobytes()):  # such a text is one piece
                    places = places[(places <= at[i]) | (places >= at[i + 1])]
        first = np.searchsorted(places, at)  # the first piece of each text
        number = self._numbers(raw, places) if len(places) > 1 else np.zeros(0, np.int64)
        if len(end):
            number = np.insert(number, first[1:], end[0])
            first = first + np.arange(n + 1)
        count = self.count[number]
        total = np.append(0, np.cumsum(count))
        return self.flat[np.repeat(self.begin[number] - total[:-1], count) + np.arange(total[-1])], total[first]


def encoder(path: str, kind: str) -> Encoder:
    """One encoder for each worker process, kept between tasks of an operator."""
    if (path, kind) not in _LOADED:
        _LOADED[path, kind] = Encoder(path, kind)
    return _LOADED[path, kind]


keeps(_LOADED.clear)
