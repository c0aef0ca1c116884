"""Words and word n-grams of many texts at once, as numpy arrays of hashes.

A batch of texts is one byte array; a rolling polynomial hash over it gives the
hash of any stretch of bytes by two look-ups, so words and n-grams cost a few
array operations a byte and no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd multiplier of the polynomial hash modulo 2**64, and its inverse.
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
STEP = np.uint64(0xD6E8FEB86659FD93)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n; kept for the worker's life."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, BASE, np.uint64), np.full(size, UNBASE, np.uint64)
        up[0] = down[0] = 1
        have = _powers[0] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have[0][:n], have[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a hash over all 64 bits (changes ``h``)."""
    h ^= h >> np.uint64(32)
    h *= STEP
    h ^= h >> np.uint64(29)
    return h


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Q with Q[r] - Q[l] = BASE**l times the hash of values[l:r]."""
    q = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(len(values))[0], out=q[1:])
    return q


def stretch(q: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (q[right] - q[left]) * powers(len(q))[1][left]


def _fold(keep: np.ndarray) -> np.ndarray:
    lut = np.where(keep, np.arange(256), 0).astype(np.uint8)
    lut[65:91] = np.where(keep[65:91], np.arange(97, 123), 0)
    return lut


_byte = np.arange(256)
#: Byte of a word, A-Z lower-cased, or 0: anything but white space; letters, digits and non-ASCII.
UNSPACED = _fold(~((_byte == 32) | ((_byte >= 9) & (_byte <= 13))))
UNSPACED[0] = 255  # a zero byte is part of a word
LETTERS = _fold(((_byte >= 48) & (_byte <= 57)) | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128))


def pieces(texts: list[str | None], most: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about ``most`` bytes: first index and the UTF-8 texts."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        raw = b"" if t is None or t != t else t.encode("utf-8", "replace")
        if held and size + len(raw) > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, held


class Words:
    """hash, start, end (in the joined bytes) and text number of each word."""

    def __init__(self, raws: list[bytes], lut: np.ndarray = UNSPACED) -> None:
        lens = np.fromiter((len(r) for r in raws), np.int64, len(raws))
        self.base = np.cumsum(lens + 1) - lens - 1
        self.data = lut[np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)]
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[1:] = self.data != 0
        edges = np.flatnonzero(np.diff(inside))
        self.start, self.end = edges[0::2], edges[1::2]
        self.q = prefix_sums(self.data)
        self.hash = mixed(stretch(self.q, self.start, self.end))
        self.doc = np.searchsorted(self.base, self.start, "right") - 1 if len(raws) else self.start
        bounds = np.searchsorted(self.start, np.append(self.base, len(self.data)))
        self.first, self.count = bounds[:-1], np.diff(bounds)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word's number of each run of n words within a text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = self.hash[:m].copy()
        for j in range(1, n):
            h *= STEP
            h += self.hash[j:j + m]
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1:])
        return mixed(h[at]), at
