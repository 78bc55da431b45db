"""The binary Golay code (23, 12): every word of 23 bits lies within distance 3 of just one codeword.

The keys of a word are the codeword indices of the decodings of the word and of its 23 neighbours. A word nearer than 3 to its
codeword has one key, any other has six. Words at distance 1 hold each other's decoding among their keys, and words at distance 2
share the decoding of a word between them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS = 23
GENERATOR = 0b101011100011


def _remainder(word: int) -> int:
    for k in range(BITS - 1, 10, -1):
        if word >> k & 1:
            word ^= GENERATOR << (k - 11)
    return word


def _syndrome(word: int) -> int:
    return _remainder(word & (1 << BITS) - 1)


#: Syndromes of the values of each byte of a word, and the error pattern of each syndrome.
_OF_BYTE = np.array([[_syndrome(v << 8 * b) for v in range(256)] for b in range(3)], np.int32)
_ERROR = np.zeros(2048, np.int32)
for _n in range(4):
    for _c in combinations(range(BITS), _n):
        _ERROR[_syndrome(sum(1 << k for k in _c))] = sum(1 << k for k in _c)


def decode(words: np.ndarray) -> np.ndarray:
    """The index (12 bits) of each word's codeword."""
    w = words.astype(np.int32)
    syndrome = _OF_BYTE[0][w & 255] ^ _OF_BYTE[1][w >> 8 & 255] ^ _OF_BYTE[2][w >> 16 & 127]
    return (w ^ _ERROR[syndrome]) >> 11


def keys(words: np.ndarray) -> np.ndarray:
    """Six columns of codeword indices for each word; -1 where there are fewer."""
    w = words.astype(np.int32)
    near = np.sort(decode(np.concatenate([w[:, None], w[:, None] ^ (1 << np.arange(BITS, dtype=np.int32))], 1).ravel()).reshape(len(w), BITS + 1), 1)
    first = np.concatenate([np.ones((len(w), 1), bool), near[:, 1:] != near[:, :-1]], 1)
    out = np.full((len(w), 6), -1, np.int32)
    row, col = np.nonzero(first)
    out[row, (np.cumsum(first, 1) - 1)[row, col]] = near[row, col]
    return out
