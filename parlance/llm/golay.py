"""The perfect binary Golay code (23, 12, 7) and fuzzy keys made from it.

Every 23-bit word lies within 3 bits of exactly one code word. The keys of a word are the indices of all code words
within 4 bits: six for 86.5 % of all words, else one. Two words u, v that differ in at most two bits share a key: some
word m is within one bit of both, its code word is within 3 bits of m, hence within 4 bits of u and of v.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

BITS, CHECK_BITS, GENERATOR = 23, 11, 0b110001110101


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator polynomial."""
    rest = words.astype(np.int64).copy()
    for bit in range(BITS - 1, CHECK_BITS - 1, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - CHECK_BITS), 0)
    return rest


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2,048 remainders: how many error patterns of weight 4 or less have it, and which (6 at most)."""
    patterns = np.array([sum(1 << b for b in bits) for n in range(5) for bits in combinations(range(BITS), n)], np.int64)
    of = syndrome(patterns)
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=1 << CHECK_BITS)
    table = np.zeros((1 << CHECK_BITS, counts.max()), np.int64)
    starts = np.cumsum(counts) - counts
    for i in range(counts.max()):
        has = counts > i
        table[has, i] = patterns[order[starts[has] + i]]
    return counts, table


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the 12-bit index of every code word within 4 bits of each word."""
    counts, table = tables()
    of = syndrome(words)
    rows = np.repeat(np.arange(len(words)), counts[of])
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(counts[of]) - counts[of], counts[of])
    return rows, (words.astype(np.int64)[rows] ^ table[of[rows], nth]) >> CHECK_BITS


#: A 64-bit fingerprint is cut into three segments (first bit, bits); each is padded with zeros to 23 bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fuzzy_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) such that fingerprints that differ in at most two bits share a key.

    Of three segments at least one has no error (pigeonhole); a key is that segment as it is and a Golay key of the
    next segment, which has two errors at most.
    """
    f = fingerprints.view(np.uint64)
    parts = [((f >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, out = [], []
    for s in range(3):
        row, key = keys(parts[(s + 1) % 3])
        rows.append(row)
        out.append(np.int64(s) << 40 | parts[s][row] << 12 | key)
    return np.concatenate(rows), np.concatenate(out)


@lru_cache(maxsize=1)
def code_words() -> np.ndarray:
    """All 4,096 code words, a column each, as signs."""
    words = np.arange(1 << (BITS - CHECK_BITS), dtype=np.int64) << CHECK_BITS
    words ^= syndrome(words)
    return np.ascontiguousarray(((words >> np.arange(BITS)[:, None] & 1) * 2 - 1).astype(np.float32))


def likeliest(margins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, agreement) of the ``n`` code words that agree best with each row of 23 margins, best first.

    A margin is how far a bit is from changing, its sign is the bit: a doubtful bit costs a code word little.
    """
    score = margins.astype(np.float32) @ code_words()
    rows = np.arange(len(score))
    index, agreement = np.empty((len(score), n), np.int64), np.empty((len(score), n), np.float32)
    for k in range(n):
        best = score.argmax(axis=1)
        index[:, k], agreement[:, k] = best, score[rows, best]
        score[rows, best] = -np.inf
    return index, agreement


def soft_keys(margins: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` likeliest pairs of code words of each row of two segments' margins (rows, 2, 23), as 24-bit numbers."""
    index, agreement = (x.reshape(-1, 2, n) for x in likeliest(margins.reshape(-1, BITS), n))
    i, j = np.array([(i, j) for i in range(n) for j in range(n) if (i + 1) * (j + 1) <= n]).T
    order = np.argsort(-(agreement[:, 0, i] + agreement[:, 1, j]), axis=1, kind="stable")[:, :n]
    return np.take_along_axis(index[:, 0, i] << 12 | index[:, 1, j], order, axis=1)
