"""A minimal perfect hash of 64-bit keys: n distinct keys to the numbers below n.

Level by level each key that is left asks for a bit of an array of about ROOM bits a key;
a bit that one key alone asks for is that key's, the others go on to the next level. A
key's number is the count of set bits before its own. About 4 bits a key.
"""

from __future__ import annotations

ROOM, LEVELS = 2, 64


def _bit_of(keys, level: int, size: int):
    import numpy as np

    x = keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PairHash:
    """sizes: bits of each level; words: the bits of all levels, in 64-bit words."""

    def __init__(self, sizes: list[int], words):
        import numpy as np

        self.sizes, self.words = sizes, np.asarray(words, np.uint64)
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64))
        self.starts = np.append(0, np.cumsum(sizes, dtype=np.int64)).tolist()

    @classmethod
    def of(cls, keys) -> PairHash:
        """The hash of distinct unsigned 64-bit keys."""
        import numpy as np

        left, sizes, bits = np.asarray(keys, np.uint64), [], []
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("the keys are not distinct")
            size = -(-max(64, ROOM * len(left)) // 64) * 64
            at = _bit_of(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(bits).view("<u8") if bits else np.zeros(0, np.uint64))

    def index(self, keys):
        """The number of each key; -1 or any number for keys that the hash was not made
        of, so compare the key that is kept at that number."""
        import numpy as np

        keys = np.asarray(keys, np.uint64)
        out, open_now = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_now):
                break
            at = _bit_of(keys[open_now], level, size) + self.starts[level]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            mine = word >> bit & np.uint64(1) == 1
            low = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_now[mine]] = (self.before[at >> 6] + np.bitwise_count(low))[mine]
            open_now = open_now[~mine]
        return out
