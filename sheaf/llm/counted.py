"""Counts of 64-bit hashes over a corpus: sorted runs from tasks, dealt by range, merged into sorted arrays.

The range says the first bits of a hash, and within a range 32 more are kept.  There are as many ranges as the corpus has
partitions (times a constant), so how seldom two hashes are taken for one doesn't change as the corpus grows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import shared
from sheaf.llm.words import slices

#: Hashes that a task sorts before it ships them.
RUN = 1_000_000
#: Ranges that a run is dealt to at most.
FAN = 1024


def packed(h: np.ndarray, ranges: int) -> np.ndarray:
    """For each hash its range, in the upper 32 bits, and its place within it; in the order of the hashes."""
    n = np.uint64(ranges)
    return (h >> np.uint64(32)) * n + (((h & np.uint64(2**32 - 1)) * n) >> np.uint64(32))


def _bounds(keys: np.ndarray, ranges: int) -> np.ndarray:
    return np.searchsorted(keys, np.append(np.arange(ranges, dtype=np.uint64) << np.uint64(32), np.uint64(2**64 - 1)))


RUNS = {"range": pa.int32(), "once": pa.binary(), "more": pa.binary(), "counts": pa.binary()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(RUNS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, RUNS.values(), strict=True)], list(RUNS))


def _dealt(keys: np.ndarray, counts: np.ndarray, first: int, ranges: int) -> list[tuple]:
    """Rows of packed keys, distinct and ascending, whose ranges count from ``first``: (range, those met once, others, how often)."""
    bounds, places, rows = _bounds(keys, ranges), keys.astype(np.uint32), []
    for r in np.flatnonzero(np.diff(bounds)).tolist():
        k, c = places[bounds[r] : bounds[r + 1]], counts[bounds[r] : bounds[r + 1]]
        rows.append((first + r, k[c == 1].tobytes(), k[c > 1].tobytes(), c[c > 1].astype(np.uint32).tobytes()))
    return rows


def _ship(read: Callable[[pa.RecordBatch], Iterable[np.ndarray]], ranges: int, step: int):
    """Runs of hashes by range, or by ``step`` ranges at a time if that is more than one."""

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(packed(np.concatenate(parts), ranges), return_counts=True)
        parts.clear()
        if step == 1:
            return _batch(_dealt(keys, counts, 0, ranges))
        bounds, rows = _bounds(keys, ranges)[::step], []
        for g, (a, b) in enumerate(zip(bounds, [*bounds[1:], len(keys)], strict=True)):
            if a < b:
                k, c = keys[a:b] - (np.uint64(g * step) << np.uint64(32)), counts[a:b]
                rows.append((g, k[c == 1].tobytes(), k[c > 1].tobytes(), c[c > 1].astype(np.uint32).tobytes()))
        return _batch(rows)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for piece in slices(batch):
                for s in read(piece):
                    parts.append(s)
                    held += len(s)
                if held >= RUN:
                    yield flush(parts)
                    held = 0
        if held:
            yield flush(parts)

    return run


def _deal_again(step: int):
    """Of rows in order of groups of ranges, runs by range."""

    def run(batches):
        group, held, size = -1, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([c for _, c in held]), len(keys)).astype(np.int64)
            held.clear()
            size = 0
            return _batch(_dealt(keys, counts, group * step, step))

        for batch in batches:
            for g, once, more, counts in zip(*(batch.column(c) for c in RUNS), strict=True):
                if (g.as_py() != group or size >= RUN) and held:
                    yield flush()
                group = g.as_py()
                for k, c in ((np.frombuffer(once.as_py(), np.uint64), None), (np.frombuffer(more.as_py(), np.uint64), np.frombuffer(counts.as_py(), np.uint32))):
                    held.append((k, np.ones(len(k), np.uint32) if c is None else c))
                    size += len(k)
        if held:
            yield flush()

    return run


def _count(folder: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        r = key[0].as_py()
        read = lambda name: [np.frombuffer(x, np.uint32) for x in table[name].to_pylist()]
        once = np.sort(np.concatenate(read("once")))
        first = np.flatnonzero(np.concatenate([[True], once[1:] != once[:-1]])) if len(once) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(once)))
        again = first[times > 1]
        keys, counts = once[again], times[times > 1]
        more = np.concatenate(read("more"))
        if len(more):
            # what is repeated in one run may occur once in others
            at = np.searchsorted(once, more)
            single = np.searchsorted(once, more, "right") - at
            is_new = single < 2
            extra = np.concatenate(read("counts")).astype(np.int64)
            names, where = np.unique(np.concatenate([keys, more]), return_inverse=True)
            total = np.bincount(where[: len(keys)], counts, len(names)) + np.bincount(where[len(keys) :], extra, len(names))
            lone = np.zeros(len(names))
            lone[where[len(keys) :][is_new]] = single[is_new]
            keys, counts = names, (total + lone).astype(np.int64)
        return pa.table({"range": pa.array([r], pa.int32()), "path": [shared.save(folder, f"counts-{r:06d}", {"keys": keys, "counts": np.minimum(counts, 2**32 - 1).astype(np.uint32)})]})

    return run


class Counts:
    """How often hashes were met; one where nothing is stored."""

    def __init__(self, paths: list[str | None]):
        self.paths = paths

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """For ascending 64-bit hashes."""
        out, n = np.ones(len(hashes), np.int64), len(self.paths)
        keys = packed(hashes, n)
        bounds, keys = _bounds(keys, n), keys.astype(np.uint32)
        for r in np.flatnonzero(np.diff(bounds)):
            if self.paths[r] is None:
                continue
            arrays, part = shared.load(self.paths[r], 1024), keys[bounds[r] : bounds[r + 1]]
            if len(arrays["keys"]):
                at = np.minimum(np.searchsorted(arrays["keys"], part), len(arrays["keys"]) - 1)
                out[bounds[r] : bounds[r + 1]] = np.where(arrays["keys"][at] == part, arrays["counts"][at], 1)
        return out


def count_hashes(texts: DataFrame, read: Callable[[pa.RecordBatch], Iterable[np.ndarray]], folder: str, ranges: int) -> Counts:
    """Counts of all hashes (arrays of uint64) that ``read`` gives for slices of the texts.

    A run has a row for each range.  With more than FAN ranges that would be rows of a few hashes, so runs are first dealt to
    groups of ranges, where tasks put them together and deal them out to the ranges of a group.
    """
    step, schema = -(-ranges // FAN), "range int, once binary, more binary, counts binary"
    runs = texts.mapInArrow(_ship(read, ranges, step), schema)
    if step > 1:
        tasks, groups = max(1, texts.rdd.getNumPartitions()), -(-ranges // step)
        salt = F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(max(1, tasks // groups)))
        runs = runs.withColumn("salt", salt).repartition(tasks, "range", "salt").sortWithinPartitions("range").drop("salt").mapInArrow(_deal_again(step), schema)
    paths: list[str | None] = [None] * ranges
    for r in runs.groupBy("range").applyInArrow(_count(folder), "range int, path string").collect():
        paths[r["range"]] = r["path"]
    return Counts(paths)
