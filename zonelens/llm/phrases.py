"""Phrases of a prefix-free parse, as numpy arrays.

Every string of ``length`` bytes elects as its trigger the leftmost ``grain``-byte
string in it with the least rolling hash.  The strings that elect one trigger start at
neighbouring positions; the stretch that they cover is the trigger's phrase, and
consecutive phrases overlap by ``length`` - 1 bytes.  Election depends on the string's
bytes alone, so equal strings elect equal triggers at equal offsets, wherever they
stand, and no phrase is longer than 2 * ``length`` - ``grain`` bytes, whatever the text."""

from __future__ import annotations

import numpy as np

from zonelens.llm.words import STEP, mixed, powers, prefix_sums, stretch

#: Second polynomial, for fingerprints of 128 bits in all.
BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)
UNBASE2 = np.uint64(pow(int(BASE2), -1, 1 << 64))
_powers2: list[np.ndarray] = []


def _second_powers(n: int):
    if not _powers2 or len(_powers2[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, BASE2, np.uint64), np.full(size, UNBASE2, np.uint64)
        up[0] = down[0] = 1
        _powers2[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers2[0][:n], _powers2[1][:n]


class Fingerprints:
    """Two independent hashes of any stretch of the joined texts."""

    def __init__(self, data: np.ndarray) -> None:
        values = data.astype(np.uint64) + np.uint64(1)
        self.q = prefix_sums(values)
        self.q2 = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values * _second_powers(len(data))[0], out=self.q2[1:])

    def first(self, left, right):
        return mixed(stretch(self.q, left, right))

    def second(self, left, right):
        return mixed((self.q2[right] - self.q2[left]) * _second_powers(len(self.q2))[1][left])


def phrases(fp: Fingerprints, starts: np.ndarray, ends: np.ndarray, length: int, grain: int):
    """Text number, first string's start, number of strings and trigger of every phrase.

    starts, ends: of the texts in the joined bytes."""
    n = len(fp.q) - grain
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none
    at = np.arange(n, dtype=np.int64)
    # rank of each grain: hash, then position (leftmost of equals)
    rank = (fp.q[grain:] - fp.q[:n]) * powers(n)[1]
    rank ^= rank >> np.uint64(32)
    rank *= STEP
    rank &= np.uint64(0xFFFFFFFFFF000000)
    rank |= at.astype(np.uint64)
    span, have = length - grain + 1, 1
    least = rank
    while have < span:  # least of the next `span` ranks, by doubling
        step = min(have, span - have)
        m = len(least) - step
        if m <= 0:
            return none, none, none, none
        least = np.minimum(least[:m], least[step:])
        have += step
    elected = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    # strings that lie within one text
    doc = np.repeat(np.arange(len(starts)), np.maximum(0, ends - starts - length + 1))
    if not len(doc):
        return none, none, none, none
    first = np.cumsum(np.maximum(0, ends - starts - length + 1)) - np.maximum(0, ends - starts - length + 1)
    where = np.arange(len(doc)) - first[doc] + starts[doc]
    mine = elected[where]
    new = np.ones(len(doc), bool)
    new[1:] = (mine[1:] != mine[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    return doc[begin], where[begin], np.diff(np.append(begin, len(doc))), mine[begin]
