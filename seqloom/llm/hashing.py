"""Hashes of many stretches of bytes at once: polynomial prefix sums modulo 2^64, then mixed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that are hashed together; texts beyond that are taken in pieces that end at white space.
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes(b + 32 if 0x41 <= b < 0x5B else b for b in range(256))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1)."""
    out = np.empty(n, np.uint64)
    out[:1] = 1
    done = 1
    while done < n:  # doubles what is known
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """64-bit hashes of the words of texts; A-Z counts as a-z, words end at ASCII white space."""

    def __init__(self):
        self.up, self.down = powers(BASE, 1), powers(INVERSE, 1)

    def _pieces(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        start = 0
        while len(data) - start > PIECE:
            cut = _SPACE.search(data, start + PIECE)
            if cut is None:
                break
            yield start, data[start : cut.start()]
            start = cut.start()
        yield start, data[start:]

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words, and for each text and the end the number of words before it."""
        raw = [t.encode("utf-8") for t in texts]
        data = b"\n".join(raw).translate(_LOWER)
        firsts, hashes = [], []
        for offset, piece in self._pieces(data):
            a = np.frombuffer(piece, np.uint8)
            gap = np.ones(len(a) + 2, np.int8)
            gap[1:-1] = (a == 32) | ((a >= 9) & (a <= 13))
            turns = np.diff(gap)
            starts, ends = np.flatnonzero(turns == -1), np.flatnonzero(turns == 1)
            if len(a) > len(self.up):
                self.up, self.down = powers(BASE, len(a)), powers(INVERSE, len(a))
            sums = np.zeros(len(a) + 1, np.uint64)
            np.cumsum((a.astype(np.uint64) + np.uint64(1)) * self.up[: len(a)], out=sums[1:])
            hashes.append(mix((sums[ends] - sums[starts]) * self.down[starts]))
            firsts.append(starts + offset)
        firsts, hashes = np.concatenate(firsts), np.concatenate(hashes)
        offsets = np.cumsum([0] + [len(r) + 1 for r in raw])
        return hashes, np.searchsorted(firsts, offsets)


def shingle_sets(hasher: WordHasher, texts: list[str], size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``size``-word shingles.

    Of fewer words, the whole sequence is the only shingle; without words there is none.
    """
    words, begins = hasher.words(texts)
    n = max(0, len(words) - size + 1)
    sums = np.zeros(n, np.uint64)
    for i in range(size):
        sums = sums * np.uint64(BASE) + words[i : i + n]
    sums = mix(sums)
    for start, end in zip(begins[:-1].tolist(), begins[1:].tolist()):
        if end - start >= size:
            yield np.unique(sums[start : end - size + 1])
        elif end > start:
            short = np.full(1, end - start, np.uint64)
            for i in range(start, end):
                short = short * np.uint64(BASE) + words[i : i + 1]
            yield mix(short ^ np.uint64(0x5DEECE66D))
        else:
            yield np.empty(0, np.uint64)
