"""A counter-based stream of uniform draws: ChaCha with 8 rounds.

Any block of the stream is computed from its number alone, so a record's draw is a
function of seed and position, in any order and partitioning.  The key comes from a 64-bit
seed by a permuted congruential generator, two 32-bit words make a draw, and the upper 53
bits of these a number in [0, 1).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The cipher's first words, and what expands a seed to a key.
CONSTANTS = (0x61707865, 0x3320646E, 0x79622D32, 0x6B206574)
MULTIPLIER, INCREMENT = 6364136223846793005, 11634580027462260723
#: Which words each quarter round mixes: columns, then diagonals.
_QUARTERS = [(k, 4 + k, 8 + k, 12 + k) for k in range(4)] + [(k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4) for k in range(4)]
ROUNDS, DRAWS_A_BLOCK = 8, 8


def key_of(seed: int) -> list[int]:
    """Eight 32-bit words."""
    out, state, low = [], seed % (1 << 64), (1 << 32) - 1
    for _ in range(8):
        state = (state * MULTIPLIER + INCREMENT) % (1 << 64)
        x, turn = (((state >> 18) ^ state) >> 27) & low, state >> 59
        out.append(((x >> turn) | (x << (32 - turn))) & low)
    return out


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint32(bits)) | (x >> np.uint32(32 - bits))


def blocks(key: list[int], numbers: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Sixteen words (rows) of each block number."""
    n = np.asarray(numbers, np.uint64)
    first = np.empty((16, len(n)), np.uint32)
    first[:12] = np.array([*CONSTANTS, *key], np.uint32)[:, None]
    first[12], first[13], first[14:] = n & np.uint64(0xFFFFFFFF), n >> np.uint64(32), 0
    s = first.copy()
    for _ in range(rounds // 2):
        for a, b, c, d in _QUARTERS:
            for x, y, z, bits in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
                s[x] += s[y]
                s[z] = _turned(s[z] ^ s[x], bits)
    return s + first


def uniform(seed: int, positions: np.ndarray) -> np.ndarray:
    """The draws at the given places of the seed's stream; neighbours share a block."""
    at = np.asarray(positions, np.int64)
    known, which = np.unique(at // DRAWS_A_BLOCK, return_inverse=True)
    words, k = blocks(key_of(seed), known), 2 * (at % DRAWS_A_BLOCK)
    both = words[k, which].astype(np.uint64) | (words[k + 1, which].astype(np.uint64) << np.uint64(32))
    return (both >> np.uint64(11)).astype(np.float64) * 2.0**-53


def draw(seed: int, ord_: str | Column = "ord") -> Column:
    """``uniform`` of a position column, in Arrow batches."""

    @F.pandas_udf("double")
    def drawn(positions: pd.Series) -> pd.Series:
        return pd.Series(uniform(seed, positions.to_numpy()))

    return drawn(F.col(ord_) if isinstance(ord_, str) else ord_)
