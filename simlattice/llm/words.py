"""Vectorised words of UTF-8 text: spans, 64-bit word hashes and five-word shingles.

A word is a run of bytes other than space and 0x09-0x0D; A-Z are lower-cased. The hash of a word is a polynomial over
random byte values modulo 2^64, taken from running sums, so a whole slice of texts needs a few numpy passes.
"""

from __future__ import annotations

import hashlib

import numpy as np

SHINGLE = 5
_SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_BASE = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2^64


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of MurmurHash3 (public domain) for 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(_SEPARATORS)] = True
_VALUE = mix(LOWER.astype(np.uint64) + np.uint64(1000003))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_PLACE = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


#: Powers that a worker keeps (16 MB); longer slices compute theirs and give the memory back.
_KEPT = 1 << 20


def _steps(size: int) -> list[np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, out=steps))
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if n > _KEPT:
        return tuple(_steps(n))
    if len(_POWERS[0]) < n:
        _POWERS[:] = _steps(_KEPT)
    return _POWERS[0], _POWERS[1]


class Words:
    """The words of several texts: ``start``/``end`` into ``data`` (lower-cased), ``doc`` and ``hash`` of each."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.n_docs = len(texts)
        space = IS_SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(data) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.data = LOWER[data]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        first = np.concatenate([[0], np.cumsum(sizes)])
        #: words[offset[d]:offset[d + 1]] are those of text d
        self.offset = np.searchsorted(self.start, first)
        self.counts = np.diff(self.offset)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)
        power, inverse = powers(len(data))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * power[:len(data)])])
        size = (self.end - self.start).astype(np.uint64)
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start] + size)

    def bytes_of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Concatenated bytes and lengths of the chosen words."""
        start, size = self.start[which], self.end[which] - self.start[which]
        shift = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return self.data[np.arange(int(size.sum())) + shift], size

    def shingles(self) -> list[np.ndarray]:
        """For each text the sorted distinct shingle hashes (the whole sequence as one below five words)."""
        weighted = [self.hash * p for p in _PLACE]
        n = len(self.hash) - SHINGLE + 1
        whole = sum(w[i:n + i] for i, w in enumerate(weighted)) if n > 0 else np.zeros(0, np.uint64)
        whole = mix(whole)
        out = []
        for a, b in zip(self.offset[:-1].tolist(), self.offset[1:].tolist()):
            if b - a >= SHINGLE:
                h = np.sort(whole[a:b - SHINGLE + 1])
                keep = np.empty(len(h), bool)
                keep[0] = True
                np.not_equal(h[1:], h[:-1], out=keep[1:])
                out.append(h[keep])
            elif b > a:
                h = sum(weighted[i][a + i:a + i + 1] for i in range(b - a)) + np.uint64(b - a)
                out.append(mix(h))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def set_name(shingles: np.ndarray) -> int:
    """64-bit name (signed) of a sorted set of hashes."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)
