"""LM scoring: an interpolated modified Kneser-Ney model of order two or three, counted in Spark and memory-mapped by the scorers.

1. Words.  Tasks count the lower-cased words of training texts by hash and ship sorted runs, dealt by hash range; a task
   for each range stores the sorted hashes and their counts.  A word's id is its place among all of them.
2. Trigrams (order three).  Training texts are read again as ids, with two starts before the first word and an end after
   the last.  Tasks ship sorted runs of trigrams, dealt by the middle word (by the first two where the middle one is so
   frequent that one shard would hold much of the corpus).  A task for each shard stores its trigrams and what follows
   each pair, and passes on how many words precede each pair, which is what order three counts pairs by.
3. Bigrams.  In order two tasks ship sorted runs of pairs and their numbers instead, with one start.  Either way pairs are
   dealt by the first word (by both where the first is frequent).  A task for each shard stores its pairs and counts, and
   passes on, by ranges of ids, how many pairs follow and precede each word.
4. Words' context counts are stored as arrays over ids, discounts come from the counts of counts.
5. Scoring.  Every text is read; its distinct words, pairs and trigrams are looked up in the sorted arrays.

All arrays lie in the shared folder in files of bounded size; only their addresses and a few totals reach the driver, so
memory follows neither the corpus nor the vocabulary.  Words are known by 64-bit hashes and pairs by two 32-bit ids, so
a model has fewer than 2**32 distinct words; more raise an error.

A null or empty text is one end token.  Every input row gives one row, repeated rows too.  A row with a null doc_id isn't
held out and is trained on.  Only doc_id and text are read.  Without training rows all counts are zero: base_score is then
that of V = 0 and the model gives every token the same share.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import shared
from sheaf.llm.words import mix, slices, words_of

#: Tokens that a task gathers before it ships a sorted run.
RUN = 3_000_000
#: Bytes of text that are scored at once: each lot visits the files of all its ranges and shards.
SCORED = 4 << 20
#: Ids of a range of context counts, on average.
IDS = 1 << 18


def is_held_out(doc_id: int | None, modulus: int = 7, rest: int = 2) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == rest


def squeeze(values: np.ndarray) -> bytes:
    """The bytes of a 32- or 64-bit array, first bytes first, compressed; its length comes before."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T) if len(values) else b""
    return len(values).to_bytes(8, "little") + pa.compress(pa.py_buffer(planes), "zstd", asbytes=True)


def loosen(data: bytes, kind) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(pa.py_buffer(data)[8:], n * width, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def pack(values: np.ndarray) -> bytes:
    """Differences of neighbours, which are small in ascending runs; those that fall wrap around."""
    return squeeze(np.diff(values, prepend=values.dtype.type(0)))


def unpack(data: bytes, kind) -> np.ndarray:
    return np.cumsum(loosen(data, kind), dtype=kind)


def joined(column: pa.ChunkedArray, read, kind) -> np.ndarray:
    return np.concatenate([read(x, kind) for x in column.to_pylist()])


def level(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of an ascending array, and where each begins, then the length."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.append(first, len(keys)).astype(np.uint32)


def bytewise(name: str, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts by one byte each; those of 255 or more stand apart."""
    large = np.flatnonzero(counts >= 255)
    return {name: np.minimum(counts, 255).astype(np.uint8), f"{name}_at": large.astype(np.uint32), f"{name}_of": counts[large].astype(np.uint64)}


def counts_at(arrays: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    out = arrays[name][at].astype(np.int64)
    large = np.flatnonzero(out == 255)
    out[large] = arrays[f"{name}_of"][np.searchsorted(arrays[f"{name}_at"], at[large])]
    return out


def halves(name: str, ascending: np.ndarray) -> dict[str, np.ndarray]:
    """Ascending 32-bit numbers by their lower halves, and where the upper half reaches 1, 2 and so on."""
    upper = ascending >> np.uint32(16)
    steps = np.searchsorted(upper, np.arange(1, int(upper[-1]) + 1, dtype=np.uint32))
    return {name: (ascending & np.uint32(0xFFFF)).astype(np.uint16), f"{name}_at": steps.astype(np.uint32)}


def whole(arrays: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    upper = np.searchsorted(arrays[f"{name}_at"], at.astype(np.uint32), "right").astype(np.int64)
    return (upper << 16) | arrays[name][at].astype(np.int64)


def within(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted values among the ascending values[low:high] of each; -1 where there is none."""
    at, end = low.astype(np.int64), high.astype(np.int64)
    stop, last = end.copy(), max(len(values) - 1, 0)
    while (more := at < end).any():
        middle = (at + end) >> 1
        less = more & (values[np.minimum(middle, last)] < wanted)
        at, end = np.where(less, middle + 1, at), np.where(more & ~less, middle, end)
    inside = at < stop
    inside[inside] = values[at[inside]] == wanted[inside]
    return np.where(inside, at, -1)


def below(bounds: np.ndarray, values: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted values among those that belong to the keys at the given places; -1 where there is none."""
    ok = np.flatnonzero(at >= 0)
    out = np.full(len(at), -1, np.int64)
    out[ok] = within(values, bounds[at[ok]], bounds[at[ok] + 1], wanted[ok].astype(values.dtype))
    return out


def place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted values among ascending keys; -1 where there is none."""
    at = np.minimum(np.searchsorted(keys, wanted.astype(keys.dtype)), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order].astype(np.int64), first) if len(keys) else v.astype(np.int64) for v in values)


def smallest(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(int(counts.max()))) if len(counts) else counts.astype(np.uint8)


def _range(h: np.ndarray, ranges: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], list(kinds))


def _training(batches, held):
    """Slices of the texts to learn from."""
    for batch in batches:
        use = pa.array([not held(i) for i in batch.column("doc_id").to_pylist()], pa.bool_())
        for piece in slices(batch.filter(use)):
            yield words_of(piece.column("text"), lower=True)


WORD_RUN = {"part": pa.int32(), "keys": pa.binary(), "counts": pa.binary(), "tokens": pa.int64(), "texts": pa.int64()}


def _ship_words(parts: int, held):
    def flush(gathered, tokens, texts):
        keys, counts = np.unique(np.concatenate(gathered) if gathered else np.zeros(0, np.uint64), return_counts=True)
        part = _range(keys, parts)
        bounds = np.searchsorted(part, np.arange(parts + 1))
        rows = [(int(p), pack(keys[bounds[p] : bounds[p + 1]]), squeeze(counts[bounds[p] : bounds[p + 1]].astype(np.uint32)), 0, 0) for p in np.unique(part)]
        yield _batch([*rows, (0, squeeze(keys[:0]), squeeze(keys[:0]), tokens, texts)], WORD_RUN)

    def run(batches):
        gathered, size, texts = [], 0, 0
        for words in _training(batches, held):
            gathered.append(words.hashes())
            size += len(gathered[-1])
            texts += len(words.counts)
            if size >= RUN:
                yield from flush(gathered, size, texts)
                gathered, size, texts = [], 0, 0
        if texts:
            yield from flush(gathered, size, texts)

    return run


def _store_words(folder: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        keys, counts = summed(joined(table["keys"], unpack, np.uint64), joined(table["counts"], loosen, np.uint32))
        shared.save(folder, f"words-{part:06d}", {"keys": keys, "counts": smallest(counts)})
        return pa.table({"part": pa.array([part], pa.int32()), "size": pa.array([len(keys)], pa.int64()), "tokens": [sum(table["tokens"].to_pylist())], "texts": [sum(table["texts"].to_pylist())]})

    return run


@dataclass
class Vocabulary:
    folder: str
    parts: int
    base: np.ndarray  # the id of the first word of each range, then the number of words
    stored: np.ndarray  # ranges that have a file
    words: int  # training words
    texts: int  # training texts, which is the number of ends

    @property
    def size(self) -> int:
        return int(self.base[-1])

    @property
    def end(self) -> int:
        return self.size

    @property
    def start(self) -> int:
        return self.size + 1

    @property
    def tokens(self) -> int:
        return self.words + self.texts

    @property
    def types(self) -> int:
        return self.size + (self.texts > 0)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of ascending hashes."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        part = _range(h, self.parts)
        bounds = np.searchsorted(part, np.arange(self.parts + 1))
        for p in np.flatnonzero((np.diff(bounds) > 0) & self.stored):
            arrays, own = shared.load(f"{self.folder}/words-{p:06d}", 4096), h[bounds[p] : bounds[p + 1]]
            if len(arrays["keys"]):
                at = np.minimum(np.searchsorted(arrays["keys"], own), len(arrays["keys"]) - 1)
                same = np.flatnonzero(arrays["keys"][at] == own)
                ids[bounds[p] + same] = self.base[p] + at[same]
                counts[bounds[p] + same] = arrays["counts"][at[same]]
        return ids, counts

    def read(self, words):
        """For a slice: the ids and counts of its tokens, ends included, those before them, the ids two before, and where each text starts."""
        distinct, where = np.unique(words.hashes(), return_inverse=True)
        ids, counts = self.find(distinct)
        texts = len(words.counts)
        at = np.arange(len(words.start)) + words.text_of
        token, count = np.full(len(at) + texts, self.end, np.int64), np.full(len(at) + texts, self.texts, np.int64)
        token[at], count[at] = ids[where], counts[where]
        first = words.first + np.arange(texts + 1)
        before, count_before = np.roll(token, 1), np.roll(count, 1)
        before[first[:-1]], count_before[first[:-1]] = self.start, self.texts
        earlier = np.roll(before, 1)
        earlier[first[:-1]] = self.start
        return token, count, before, count_before, earlier, first


def shard_of(before: np.ndarray, token: np.ndarray, frequent: np.ndarray, shards: int) -> np.ndarray:
    h = mix(before.astype(np.uint64) + np.uint64(1))
    h[frequent] = mix(h[frequent] ^ mix(token[frequent].astype(np.uint64)))
    return _range(h, shards)


PAIR_RUN = {"part": pa.int32(), "before": pa.binary(), "token": pa.binary(), "counts": pa.binary()}


def _ship_pairs(vocabulary: Vocabulary, shards: int, held):
    limit = max(1, vocabulary.tokens // (8 * shards))

    def flush(gathered):
        keys, counts = np.unique(np.concatenate([k for k, _ in gathered]), return_counts=True)
        hot = np.unique(np.concatenate([f for _, f in gathered]))
        before, token = keys >> np.uint64(32), keys & np.uint64(2**32 - 1)
        shard = shard_of(before, token, np.isin(before, hot), shards)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(shards + 1))
        rows = []
        for p in np.flatnonzero(np.diff(bounds)):
            at = order[bounds[p] : bounds[p + 1]]
            rows.append((int(p), pack(before[at].astype(np.uint32)), pack(token[at].astype(np.uint32)), squeeze(counts[at].astype(np.uint32))))
        yield _batch(rows, PAIR_RUN)

    def run(batches):
        gathered, size = [], 0
        for words in _training(batches, held):
            token, _, before, count_before, _, _ = vocabulary.read(words)
            gathered.append(((before.astype(np.uint64) << np.uint64(32)) | token.astype(np.uint64), np.unique(before[count_before > limit]).astype(np.uint64)))
            size += len(token)
            if size >= RUN:
                yield from flush(gathered)
                gathered, size = [], 0
        if size:
            yield from flush(gathered)

    return run


TRIPLE_RUN = {"part": pa.int32(), "middle": pa.binary(), "first": pa.binary(), "follow": pa.binary(), "token": pa.binary(), "counts": pa.binary(), "hot": pa.binary()}
LOW = np.uint64(2**32 - 1)


def _ship_triples(vocabulary: Vocabulary, shards: int, held):
    limit = max(1, vocabulary.tokens // (8 * shards))

    def flush(gathered):
        contexts, which = np.unique(np.concatenate([c for c, _, _ in gathered]), return_inverse=True)
        keys, counts = np.unique((which.astype(np.uint64) << np.uint64(32)) | np.concatenate([t for _, t, _ in gathered]), return_counts=True)
        hot = np.unique(np.concatenate([h for _, _, h in gathered]))
        middle, first = contexts >> np.uint64(32), contexts & LOW
        shard = shard_of(middle, first, np.isin(middle, hot), shards)[(keys >> np.uint64(32)).astype(np.int64)]
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(shards + 1))
        rows = []
        for p in np.flatnonzero(np.diff(bounds)):
            at = order[bounds[p] : bounds[p + 1]]
            own, starts = level((keys[at] >> np.uint64(32)).astype(np.int64))
            m = middle[own]
            rows.append((int(p), pack(m.astype(np.uint32)), pack(first[own].astype(np.uint32)), squeeze(np.diff(starts)), squeeze((keys[at] & LOW).astype(np.uint32)), squeeze(counts[at].astype(np.uint32)), squeeze(np.intersect1d(m, hot))))
        yield _batch(rows, TRIPLE_RUN)

    def run(batches):
        gathered, size = [], 0
        for words in _training(batches, held):
            token, _, before, count_before, earlier, _ = vocabulary.read(words)
            gathered.append(((before.astype(np.uint64) << np.uint64(32)) | earlier.astype(np.uint64), token.astype(np.uint32), np.unique(before[count_before > limit]).astype(np.uint64)))
            size += len(token)
            if size >= RUN:
                yield from flush(gathered)
                gathered, size = [], 0
        if size:
            yield from flush(gathered)

    return run


def _store_triples(folder: str, shards: int):
    """Stores a shard of trigrams and what follows their pairs; passes on, as runs of pairs, how many words precede each pair."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        follow = joined(table["follow"], loosen, np.uint32)
        contexts = (joined(table["middle"], unpack, np.uint32).astype(np.uint64) << np.uint64(32)) | joined(table["first"], unpack, np.uint32)
        contexts, which = np.unique(contexts, return_inverse=True)
        keys = (np.repeat(which.astype(np.uint64), follow) << np.uint64(32)) | joined(table["token"], loosen, np.uint32)
        keys, counts = summed(keys, joined(table["counts"], loosen, np.uint32))
        which, token = (keys >> np.uint64(32)).astype(np.int64), keys & LOW
        _, inner = level(which)
        middles, outer = level((contexts >> np.uint64(32)).astype(np.uint32))
        total = lambda x: np.add.reduceat(x.astype(np.int64), inner[:-1])
        arrays = {"keys": middles, "outer": outer, "firsts": (contexts & LOW).astype(np.uint32), "tokens": token.astype(np.uint32)} | halves("inner", inner)
        arrays |= bytewise("counts", counts) | bytewise("all", total(counts)) | bytewise("one", total(counts == 1)) | bytewise("two", total(counts == 2))
        part = key[0].as_py()
        shared.save(folder, f"triples-{part:06d}", arrays)
        pairs, kinds = np.unique((contexts >> np.uint64(32) << np.uint64(32))[which] | token, return_counts=True)
        before, token = pairs >> np.uint64(32), pairs & LOW
        shard = shard_of(before, token, np.isin(before, joined(table["hot"], loosen, np.uint64)), shards)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(shards + 1))
        rows = [(-1, squeeze(counts_of_counts(counts)), b"", b"")]  # passed on by _store_pairs
        for p in np.flatnonzero(np.diff(bounds)):
            at = order[bounds[p] : bounds[p + 1]]
            rows.append((int(p), pack(before[at].astype(np.uint32)), pack(token[at].astype(np.uint32)), squeeze(kinds[at].astype(np.uint32))))
        return pa.Table.from_batches([_batch(rows, PAIR_RUN)])

    return run


CONTEXT = {"part": pa.int32(), "kind": pa.string(), "ids": pa.binary(), "values": pa.binary()}


def counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.array([np.sum(counts == k) for k in (1, 2, 3, 4)] + [np.sum(counts >= 3)], np.int64)


def _store_pairs(folder: str, parts: int, total: int):
    """Stores a shard of pairs; passes on what follows and what precedes each word, and the counts of counts of pairs (part -1)
    and of triples (part -2)."""

    def by_range(kind: str, ids: np.ndarray, *values: np.ndarray):
        part = ids * parts // total
        bounds = np.searchsorted(part, np.arange(parts + 1))
        for p in np.unique(part):
            a, b = bounds[p], bounds[p + 1]
            yield int(p), kind, pack(ids[a:b].astype(np.uint32)), squeeze(np.concatenate([v[a:b].astype(np.uint32) for v in values]))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            total_of = np.sum([loosen(x, np.int64) for x in table["before"].to_pylist()], axis=0)
            return pa.Table.from_batches([_batch([(-2, "of counts", b"", squeeze(total_of))], CONTEXT)])
        before = joined(table["before"], unpack, np.uint32).astype(np.uint64)
        keys, counts = summed((before << np.uint64(32)) | joined(table["token"], unpack, np.uint32), joined(table["counts"], loosen, np.uint32))
        firsts, outer = level((keys >> np.uint64(32)).astype(np.uint32))
        shared.save(folder, f"pairs-{key[0].as_py():06d}", {"keys": firsts, "outer": outer, "tokens": (keys & LOW).astype(np.uint32)} | bytewise("counts", counts))
        before, token = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(2**32 - 1)).astype(np.int64)
        rows = [(-1, "of counts", b"", squeeze(counts_of_counts(counts)))]
        rows += by_range("follow", *summed(before, counts, counts == 1, counts == 2, counts >= 3))
        rows += by_range("precede", *summed(token, np.ones(len(token), np.int64)))
        return pa.Table.from_batches([_batch(rows, CONTEXT)])

    return run


def _store_contexts(folder: str, parts: int, total: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        if part < 0:
            stats = np.sum([loosen(x, np.int64) for x in table["values"].to_pylist()], axis=0)
            return pa.table({"part": pa.array([part], pa.int32()), "stats": pa.array([stats.tolist()], pa.list_(pa.int64()))})
        low, high = -(-part * total // parts), -(-(part + 1) * total // parts)
        arrays = {k: np.zeros(high - low, np.int64) for k in ("all", "one", "two", "more", "precede")}
        for kind, ids, values in zip(*(table[c].to_pylist() for c in ("kind", "ids", "values")), strict=True):
            at = unpack(ids, np.uint32).astype(np.int64) - low
            names = ("all", "one", "two", "more") if kind == "follow" else ("precede",)
            for name, v in zip(names, loosen(values, np.uint32).reshape(len(names), -1), strict=True):
                arrays[name][at] += v
        shared.save(folder, f"contexts-{part:06d}", {k: smallest(v) for k, v in arrays.items()})
        stats = [*counts_of_counts(arrays["precede"]).tolist(), int(arrays["precede"].sum())]
        return pa.table({"part": pa.array([part], pa.int32()), "stats": pa.array([stats], pa.list_(pa.int64()))})

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """What modified Kneser-Ney takes off counts of one, two and more, from the numbers of entries seen 1, 2, 3 and 4 times."""
    plain = np.array([0.5, 1.0, 1.5])  # for corpora too small to tell
    if min(n[:4]) <= 0:
        return plain
    y = n[0] / (n[0] + 2 * n[1])
    return np.clip([1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]], 0.01, [0.99, 1.99, 2.99])


@dataclass
class Model:
    vocabulary: Vocabulary
    folder: str
    shards: int
    has_pairs: np.ndarray
    parts: int
    has_contexts: np.ndarray
    cut2: np.ndarray
    cut1: np.ndarray
    kinds: int  # distinct pairs
    rest1: float  # the share that single words leave to the uniform distribution
    has_triples: np.ndarray | None = None  # None: a model of order two
    cut3: np.ndarray | None = None

    def context(self, ids: np.ndarray) -> dict[str, np.ndarray]:
        """Context counts of ids; zero for unknown ones."""
        total = self.vocabulary.size + 2
        out = {k: np.zeros(len(ids), np.int64) for k in ("all", "one", "two", "more", "precede")}
        part = np.where(ids < 0, -1, ids * self.parts // total)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(self.parts + 1))
        for p in np.flatnonzero((np.diff(bounds) > 0) & self.has_contexts):
            arrays, at = shared.load(f"{self.folder}/contexts-{p:06d}", 4096), order[bounds[p] : bounds[p + 1]]
            local = ids[at] - -(-p * total // self.parts)
            for k in out:
                out[k][at] = arrays[k][local]
        return out

    def pairs(self, before: np.ndarray, token: np.ndarray, frequent: np.ndarray) -> np.ndarray:
        """Counts of distinct pairs of ids."""
        out = np.zeros(len(before), np.int64)
        shard = np.where((before < 0) | (token < 0), -1, shard_of(before, token, frequent, self.shards))
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for p in np.flatnonzero((np.diff(bounds) > 0) & self.has_pairs):
            arrays, at = shared.load(f"{self.folder}/pairs-{p:06d}", 4096), order[bounds[p] : bounds[p + 1]]
            slot = below(arrays["outer"], arrays["tokens"], place(arrays["keys"], before[at]), token[at])
            out[at[slot >= 0]] = counts_at(arrays, "counts", slot[slot >= 0])
        return out

    def triples(self, earlier: np.ndarray, before: np.ndarray, token: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
        """Counts of distinct triples of ids, and of all tokens and those seen once, twice and more after their first two."""
        counts, seen, one, two, more = (np.zeros(len(before), np.int64) for _ in range(5))
        shard = np.where((earlier < 0) | (before < 0), -1, shard_of(before, earlier, frequent, self.shards))
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for p in np.flatnonzero((np.diff(bounds) > 0) & self.has_triples):
            arrays, at = shared.load(f"{self.folder}/triples-{p:06d}", 4096), order[bounds[p] : bounds[p + 1]]
            slot = below(arrays["outer"], arrays["firsts"], place(arrays["keys"], before[at]), earlier[at])
            at, slot = at[slot >= 0], slot[slot >= 0]
            seen[at], one[at], two[at] = (counts_at(arrays, k, slot) for k in ("all", "one", "two"))
            start, stop = whole(arrays, "inner", slot), whole(arrays, "inner", slot + 1)
            more[at] = stop - start - one[at] - two[at]
            slot = np.where(token[at] < 0, -1, within(arrays["tokens"], start, stop, np.maximum(token[at], 0).astype(np.uint32)))
            counts[at[slot >= 0]] = counts_at(arrays, "counts", slot[slot >= 0])
        return counts, seen, one, two, more

    def single(self, precede: np.ndarray) -> np.ndarray:
        """The lower-order share of tokens, by how many kinds of token precede them."""
        uniform = 1 / (self.vocabulary.types + 1)
        if not self.kinds:
            return np.full(len(precede), uniform)
        cut = np.concatenate([[0.0], self.cut1])[np.minimum(precede, 3)]
        return np.maximum(precede - cut, 0) / self.kinds + self.rest1 * uniform

    def log10(self, token: np.ndarray, before: np.ndarray, count_before: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """log10 of the model's share of each token after the one before it, in order three after the two before it."""
        share = self.after_one(token, before, count_before)
        if self.has_triples is None:
            return np.log10(share)
        contexts = ((before + 1).astype(np.uint64) << np.uint64(32)) | (earlier + 1).astype(np.uint64)
        which = np.unique(contexts, return_inverse=True)[1].astype(np.uint64)
        _, first, where = np.unique((which << np.uint64(32)) | (token + 1).astype(np.uint64), return_index=True, return_inverse=True)
        limit = max(1, self.vocabulary.tokens // (8 * self.shards))
        counts, seen, *kinds = self.triples(earlier[first], before[first], token[first], count_before[first] > limit)
        return np.log10(self.mixed(counts, seen, kinds, self.cut3, share[first]))[where]

    @staticmethod
    def mixed(counts: np.ndarray, seen: np.ndarray, kinds: list[np.ndarray], cuts: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Shares of tokens after contexts seen so often: what their counts keep, and what these leave dealt by the lower order."""
        cut = np.concatenate([[0.0], cuts])[np.minimum(counts, 3)]
        left = (cuts[0] * kinds[0] + cuts[1] * kinds[1] + cuts[2] * kinds[2]) / np.maximum(seen, 1)
        return np.where(seen > 0, np.maximum(counts - cut, 0) / np.maximum(seen, 1) + left * low, low)

    def after_one(self, token: np.ndarray, before: np.ndarray, count_before: np.ndarray) -> np.ndarray:
        """The share of each token after the one before it."""
        keys = ((before + 1).astype(np.uint64) << np.uint64(32)) | (token + 1).astype(np.uint64)
        keys, first, where = np.unique(keys, return_index=True, return_inverse=True)
        token, before, count_before = token[first], before[first], count_before[first]
        names, place = np.unique(np.concatenate([token, before]), return_inverse=True)
        context = self.context(names)
        precede = context["precede"][place[: len(token)]]
        of = {k: context[k][place[len(token) :]] for k in ("all", "one", "two", "more")}
        limit = max(1, self.vocabulary.tokens // (8 * self.shards))
        counts = self.pairs(before, token, count_before > limit)
        return self.mixed(counts, of["all"], [of["one"], of["two"], of["more"]], self.cut2, self.single(precede))[where]


def train(documents: DataFrame, held=is_held_out, order: int = 2) -> Model:
    """The model, of order two or three, of the texts of which ``held(doc_id)`` is false."""
    if order not in (2, 3):
        raise ValueError("the order is two or three")
    spark = documents.sparkSession
    folder = shared.folder(spark, "language-model")
    texts = documents.select("doc_id", "text")
    parts = max(32, 4 * texts.rdd.getNumPartitions())
    schema = lambda kinds: ", ".join(f"{k} {'int' if t == pa.int32() else 'long' if t == pa.int64() else str(t)}" for k, t in kinds.items())
    runs = texts.mapInArrow(_ship_words(parts, held), schema(WORD_RUN))
    found = runs.groupBy("part").applyInArrow(_store_words(folder), "part int, size long, tokens long, texts long").collect()
    sizes, stored = np.zeros(parts, np.int64), np.zeros(parts, bool)
    for r in found:
        sizes[r["part"]], stored[r["part"]] = r["size"], True
    base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    vocabulary = Vocabulary(folder, parts, base, stored, sum(r["tokens"] for r in found), sum(r["texts"] for r in found))
    if vocabulary.size > 2**32 - 4:
        raise ValueError("more than 2**32 distinct words")
    total = vocabulary.size + 2
    if order == 3:
        triples = texts.mapInArrow(_ship_triples(vocabulary, parts, held), schema(TRIPLE_RUN))
        pairs = triples.groupBy("part").applyInArrow(_store_triples(folder, parts), schema(PAIR_RUN))
    else:
        pairs = texts.mapInArrow(_ship_pairs(vocabulary, parts, held), schema(PAIR_RUN))
    # ranges of ids follow the vocabulary and not the corpus, so a shard has rows for no more ranges as shards grow in number
    ranges = min(parts, max(32, -(-total // IDS)))
    contexts = pairs.groupBy("part").applyInArrow(_store_pairs(folder, ranges, total), schema(CONTEXT))
    rows = contexts.groupBy("part").applyInArrow(_store_contexts(folder, ranges, total), "part int, stats array<bigint>").collect()
    has_contexts, n3, n2, n1, kinds = np.zeros(ranges, bool), *np.zeros((3, 5), np.int64), 0
    for r in rows:
        if r["part"] == -2:
            n3 = np.array(r["stats"])
        elif r["part"] == -1:
            n2 = np.array(r["stats"])
        else:
            has_contexts[r["part"]] = True
            n1, kinds = n1 + np.array(r["stats"][:5]), kinds + r["stats"][5]
    cut1 = discounts(n1)
    rest1 = float(cut1 @ [n1[0], n1[1], n1[4]]) / max(1, kinds)
    names = shared.names(folder)
    present = lambda what: np.array([f"{what}-{p:06d}" in names for p in range(parts)])
    model = Model(vocabulary, folder, parts, present("pairs"), ranges, has_contexts, discounts(n2), cut1, kinds, rest1)
    if order == 3:
        model.has_triples, model.cut3 = present("triples"), discounts(n3)
    return model


def _scores(model: Model, held):
    def run(batches):
        v = model.vocabulary
        for batch in batches:
            for piece in slices(batch, size=SCORED):
                token, count, before, count_before, earlier, first = v.read(words_of(piece.column("text"), lower=True))
                base = np.log10((count + 1) / (v.tokens + v.types + 1))
                score = model.log10(token, before, count_before, earlier)
                rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
                add = lambda x: np.bincount(rows, x, len(first) - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array([held(i) for i in piece.column("doc_id").to_pylist()], pa.bool_()),
                        pa.array(np.diff(first), pa.int64()),
                        pa.array(add(count > 0).astype(np.int64)),
                        pa.array(np.full(len(first) - 1, v.tokens)),
                        pa.array(add(base)),
                        pa.array(add(score)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score(documents: DataFrame, model: Model, held=is_held_out) -> DataFrame:
    """Token counts and log10 probabilities of each row of (doc_id, text); the perplexity is 10 ** (-score / n_tokens)."""
    return documents.select("doc_id", "text").mapInArrow(
        _scores(model, held), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(documents, train(documents, order=3))
