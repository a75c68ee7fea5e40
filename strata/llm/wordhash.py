"""Words of many texts at once, as 64-bit hashes in numpy arrays.

Texts are laid end to end as UTF-8, A-Z lower-cased by a byte table. A word is a maximal run of the alphabet's bytes.
Its hash is a polynomial over random byte values, taken as a difference of running sums and shifted to one position, then
mixed; equal words have equal hashes wherever they stand, in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
CHUNK = 1 << 20

#: Bytes that part words. "space": 20 and 09-0D. "alnum": all ASCII but digits and lower-case letters.
SPACE = bytes([*range(0x09, 0x0E), 0x20])
ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a run of texts, in order."""

    doc: np.ndarray  # index of the text
    hash: np.ndarray
    counts: np.ndarray  # words of each text
    start: np.ndarray  # byte offsets in the joined buffer
    end: np.ndarray
    buffer: bytes


class WordHasher:
    def __init__(self, separators: bytes):
        self.sep = separators[:1] if b" " not in separators else b" "
        word = np.ones(256, bool)
        word[list(separators)] = False
        self.is_word = word[list(LOWER)]  # upper-case letters part words only if their lower-case forms do
        table = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        self.value = table[list(LOWER)]
        self._pow = self._inv = np.empty(0, np.uint64)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_pow", "_inv")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._pow = self._inv = np.empty(0, np.uint64)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        done, step = 1, base
        while done < n:  # doubling: out[done:2*done] = out[:done] * base**done
            k = min(done, n - done)
            out[done : done + k] = out[:k] * np.uint64(step)
            step = step * step % 2**64
            done += k
        return out

    def batch(self, texts: list[bytes]) -> Words:
        buffer = self.sep.join(texts) + self.sep
        data = np.frombuffer(buffer, np.uint8)
        if len(self._pow) < len(data):
            n = max(len(data), CHUNK + 4096)
            self._pow, self._inv = self._powers(_BASE, n), self._powers(pow(_BASE, -1, 2**64), n)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], self.is_word[data]]).astype(np.int8)))
        start, end = edges[0::2], edges[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self._pow[: len(data)], out=sums[1:])
        h = mix((sums[end] - sums[start]) * self._inv[start] + (end - start).astype(np.uint64))
        ends = np.cumsum([len(t) + 1 for t in texts])
        doc = np.searchsorted(ends, start, side="right")
        return Words(doc, h, np.bincount(doc, minlength=len(texts)), start, end, buffer)


def runs(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Slices of about `limit` bytes at most; a longer text is a slice of its own, whole."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) + 1 > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every run of k words; a text of fewer words, but one at least, has all its words as one."""
    odd = (np.random.default_rng(41).integers(1, 2**63, k + 1, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    n = len(words.hash)
    doc, out = np.empty(0, np.int64), np.empty(0, np.uint64)
    if n >= k:
        ok = words.doc[: n - k + 1] == words.doc[k - 1 :]
        total = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            total += words.hash[j : n - k + 1 + j] * odd[j]
        doc, out = words.doc[: n - k + 1][ok], mix(total[ok])
    few = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(few):
        first = np.concatenate([[0], np.cumsum(words.counts)])[few]
        extra = np.array([mix((words.hash[a : a + c] * odd[:c]).sum(keepdims=True, dtype=np.uint64) + odd[k : k + 1] * np.uint64(c))[0] for a, c in zip(first, words.counts[few], strict=True)], np.uint64)
        doc, out = np.concatenate([doc, few]), np.concatenate([out, extra])
        order = np.argsort(doc, kind="stable")
        doc, out = doc[order], out[order]
    return doc, out
