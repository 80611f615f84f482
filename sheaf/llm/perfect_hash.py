"""Minimal perfect hashing of distinct 64-bit hashes, in numpy.

Level by level, keys that hash alone into a bit vector take that bit; keys that collide go on to the next level.  The
slot of a key is the number of set bits before its own, so n keys get the slots 0 to n - 1.
"""

from __future__ import annotations

import numpy as np

from sheaf.llm.words import mix

#: Bits of a level for each key that reaches it.
ROOM = 2


def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    h = mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    return (((h >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The arrays of the function, and the slot of each key.  Keys that occur twice can't be told apart: they are kept in a sorted list of their own at the end."""
    left, sizes, levels = np.arange(len(keys)), [], []
    while len(left) and len(sizes) < 48:
        bits = -(-max(64, ROOM * len(left)) // 64) * 64
        at = _place(keys[left], len(sizes), bits)
        alone = np.bincount(at, minlength=bits) == 1
        sizes.append(bits)
        levels.append(alone)
        left = left[~alone[at]]
    flat = np.concatenate(levels) if levels else np.zeros(0, bool)
    words = np.packbits(flat, bitorder="little").view(np.uint64)
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.int64)
    rest = left[np.argsort(keys[left], kind="stable")]
    index = {"sizes": np.array(sizes, np.int64), "bits": words, "ranks": ranks, "rest": keys[rest]}
    slot, ok = find(index, keys)
    slot[rest] = ranks[-1] + np.arange(len(rest))
    return index, slot


def find(index: dict[str, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A slot for each key, and whether there is one.  A key that isn't listed may get any slot: compare fingerprints."""
    slot, ok = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    left, base = np.arange(len(keys)), 0
    for level, bits in enumerate(index["sizes"].tolist()):
        if not len(left):
            return slot, ok
        at = base + _place(keys[left], level, bits)
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        held = index["bits"][word]
        hit = (held >> bit) & np.uint64(1) == 1
        below = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1)))
        slot[left[hit]], ok[left[hit]] = (index["ranks"][word] + below)[hit], True
        left = left[~hit]
        base += bits
    rest = index["rest"]
    if len(rest) and len(left):
        at = np.minimum(np.searchsorted(rest, keys[left]), len(rest) - 1)
        hit = rest[at] == keys[left]
        slot[left[hit]], ok[left[hit]] = int(index["ranks"][-1]) + at[hit], True
    return slot, ok
