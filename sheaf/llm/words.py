"""Vectorised reading of text columns: byte buffers, words, lines and their 64-bit hashes.

Every Python operator of this subpackage works on slices of Arrow batches.  A slice holds whole texts of about
``SLICE_BYTES`` bytes (one longer text makes a slice of its own).  The batches themselves hold shared.BATCH bytes, or one
longer row, so memory follows the longest text and not the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from sheaf.llm.shared import bound_batches

SLICE_BYTES = 2 << 20
#: Words of more bytes than this are hashed one at a time.
LONG_WORD = 128

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_K1, _K2, _K3 = (np.uint64(k) for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= _K1
    x ^= x >> np.uint64(27)
    x *= _K2
    x ^= x >> np.uint64(31)
    return x


def mix1(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], np.uint64))[0])


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the len(col) + 1 offsets of its texts; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    _, offs, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


@lru_cache(1)
def _trim() -> Callable[[int], int] | None:
    import ctypes

    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives memory that isn't used any more back to the system, where the C library can: a worker lives longer than a task."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose texts hold about ``size`` bytes."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(lengths), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(at, stop - at)
        at = stop
    release()


def map_texts(df, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text"):
    """``df.mapInArrow`` with one call of ``fn`` for each slice."""
    bound_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, column):
                yield fn(piece)

    return df.mapInArrow(run, schema)


def per_text(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the ascending positions lie in each text."""
    return np.diff(np.searchsorted(positions, offsets))


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, eight bytes a step for all spans at once."""
    size = end - start
    h = size.astype(np.uint64) * _K3
    if not len(start):
        return h
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    words = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))
    long = size > LONG_WORD
    which: np.ndarray | None = np.flatnonzero(~long) if long.any() else None
    step = 0
    while True:
        at, left = (start, size) if which is None else (start[which], size[which])
        if step:
            more = left > step
            which = np.flatnonzero(more) if which is None else which[more]
            if not len(which):
                break
            at, left = start[which], size[which]
        part = words[at + step] & _MASKS[np.minimum(left - step, 8)]
        if which is None:
            h = mix(h ^ part) + _K3
        else:
            h[which] = mix(h[which] ^ part) + _K3
        step += 8
    if long.any():
        view = memoryview(np.ascontiguousarray(buf))
        for i in np.flatnonzero(long):
            h[i] = xxhash.xxh3_64_intdigest(view[start[i] : end[i]])
    return h


@dataclass
class Words:
    """The words of a slice: byte spans, the hash of each, and for text d the words first[d]:first[d + 1]."""

    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.buf, self.start, self.end)


def find_words(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes outside ``space``; none crosses the end of a text."""
    return find_runs(buf, offsets, ~space[buf])


def find_runs(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of bytes for which ``inside`` is true; none crosses the end of a text."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return Words(buf, offsets, none, none, np.zeros(len(offsets), np.int64))
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(buf), bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    before |= cut[:-1]
    start = np.flatnonzero(inside & before)
    after = np.empty(len(buf), bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    after |= cut[1:]
    end = np.flatnonzero(inside & after) + 1
    return Words(buf, offsets, start, end, np.searchsorted(start, offsets))


def words_of(col: pa.Array, lower: bool = False) -> Words:
    buf, offsets = text_buffer(col)
    return find_words(LOWER[buf] if lower else buf, offsets)


def coded(words: Words) -> tuple[np.ndarray, pa.Array]:
    """The distinct words as strings, and for each word which of them it is: equal bytes, not equal hashes."""
    if not len(words.start):
        return np.zeros(0, np.int32), pa.array([], pa.string())
    size = words.end - words.start
    ends = np.cumsum(size)
    data = words.buf[np.repeat(words.start - (ends - size), size) + np.arange(ends[-1])]
    offsets = np.concatenate([[0], ends]).astype(np.int32 if ends[-1] < 2**31 else np.int64)
    kind = pa.StringArray if offsets.dtype == np.int32 else pa.LargeStringArray
    found = kind.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.cast(pa.string())


_BASE = 0x5851F42D4C957F2D
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


class Rolling:
    """Rolling hashes of windows of any length over a sequence of hashes."""

    def __init__(self, h: np.ndarray):
        self.up, self.down = _powers(len(h) + 1)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.up[: len(h)], dtype=np.uint64, out=self.sums[1:])

    def windows(self, n: int) -> np.ndarray:
        """The hash of the n items from each place; empty if there are fewer."""
        count = len(self.sums) - n
        if count <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[n:] - self.sums[:count]) * self.down[:count] + np.uint64(n))


def whole_windows(words: Words, n: int) -> np.ndarray:
    """Which of the windows of ``Rolling.windows(n)`` lie in one text."""
    count = max(0, len(words.start) - n + 1)
    ok = np.zeros(count, bool)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True) if len(words.first) < 64 else ():
        ok[a : max(a, b - n + 1)] = True
    if len(words.first) >= 64:
        edge = np.zeros(len(words.start) + 1, np.int32)
        has = words.counts >= n
        np.add.at(edge, words.first[:-1][has], 1)
        np.add.at(edge, words.first[1:][has] - n + 1, -1)
        ok = np.cumsum(edge[:count]) > 0
    return ok


def covered(flags: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` items lie in a flagged window of n items."""
    edge = np.zeros(size + 1, np.int32)
    at = np.flatnonzero(flags)
    edge[at] += 1
    np.subtract.at(edge, at + n, 1)
    return np.cumsum(edge[:-1]) > 0


def sums_per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
