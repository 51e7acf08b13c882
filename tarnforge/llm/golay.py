"""The binary Golay code of length 23: perfect, 12 information bits, distance 7."""

from __future__ import annotations

import numpy as np

#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def _remainder(words: np.ndarray) -> np.ndarray:
    """The 11-bit syndrome: the word modulo the generator."""
    w = words.astype(np.int64).copy()
    for k in range(22, 10, -1):
        w ^= np.where((w >> k) & 1 == 1, GENERATOR << (k - 11), 0)
    return w


def codewords() -> np.ndarray:
    info = np.arange(4096, dtype=np.int64) << 11
    return info | _remainder(info)


def correction_table() -> np.ndarray:
    """By syndrome, the patterns that lead from a word to each codeword at distance 4 or less:
    the nearest one first (distance 3 at most), then those at distance 4. There are five of the
    latter where the nearest is at distance 3, else none; -1 fills the rest."""
    bits = [1 << i for i in range(23)]
    patterns = np.array([0, *bits, *(bits[i] | bits[j] for i in range(23) for j in range(i)), *(bits[i] | bits[j] | bits[k] for i in range(23) for j in range(i) for k in range(j))], dtype=np.int64)
    leader = np.full(2048, -1, dtype=np.int64)
    leader[_remainder(patterns)] = patterns
    words = codewords()
    sevens = words[np.bitwise_count(words) == 7]
    table = np.full((2048, 6), -1, dtype=np.int64)
    for s, e in enumerate(leader.tolist()):
        table[s, 0] = e
        if e.bit_count() == 3:
            over = sevens[(sevens & e) == e] ^ e
            table[s, 1 : 1 + len(over)] = over
    return table


class Decoder:
    def __init__(self):
        self.table = correction_table()
        self.syndromes = _remainder(np.arange(1 << 12, dtype=np.int64) << 11)  # of the upper 12 bits

    def indices(self, words: np.ndarray) -> np.ndarray:
        """A row of up to six codeword indices (12 bits) for each 23-bit word, the nearest first; -1 fills."""
        s = self.syndromes[words >> 11] ^ (words & 2047)
        patterns = self.table[s]
        return np.where(patterns >= 0, (words[:, None] ^ np.maximum(patterns, 0)) >> 11, -1)
