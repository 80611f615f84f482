"""Substring dedup: passages of 35 words and more that occur elsewhere are removed, by suffix automata of reference shards.

1. Suspects.  Of the 11-grams of each window of 35 words the one with the least hash is its anchor; equal windows have
   equal anchors.  Anchors are counted over the corpus (sorted runs, dealt by hash range; see counted.py).  A window whose
   anchor occurs once can't be repeated.
2. Owners.  Suspect windows are counted by 64-bit hash; each one met twice is owned by one of its occurrences, that with
   the least row key and place.  Owners lie in files of sorted arrays.  So far nothing is decided: hashes say what to compare.
3. Reference shards.  Runs of owned windows are the reference passages.  They are dealt into shards of bounded size, and
   a task for each shard builds the suffix automaton of its passages and stores it in the shared folder.
4. Streaming.  Documents stream past the automata: of each the runs of windows that are owned elsewhere, against the shard
   of their owner.  Where the matching statistics reach 35 words, the spans are to be removed on both sides: in the
   document, and in the reference passage at the place that the automaton's state names.  Runs are dealt out in ranges of
   shards, so a shard with very many is spread over tasks, each of which loads its automaton.
5. Spans are stored as arrays sorted by row key, and the documents are read once more without the words inside them.

No word is removed for a hash alone: a window goes if another occurrence of its words was compared word by word.  It goes
wherever it stands, and what is judged is the input.  Documents are rows, known by the hash of doc_id and text; in equal rows
each makes the other's windows repeated.  A null or empty text has no words; one of fewer than 35 words keeps all.  Only
doc_id and text are read by the query; ``remove_repeats`` passes other columns on.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import automaton, shared
from sheaf.llm.counted import Counts, count_hashes
from sheaf.llm.words import Rolling, Words, find_words, mix, slices, text_buffer, whole_windows

WINDOW, GRAM = 35, 11
#: Owned windows of a shard, on average, and of a passage at most.
SHARD_WINDOWS, PASSAGE = 20_000, 2_000
#: Suspect windows that a task gathers before it ships a sorted run.
RUN = 1_000_000


class Anchored:
    """The windows of a slice of texts: their places, the hash of the anchor of each and, when asked for, their own."""

    def __init__(self, texts: pa.Array):
        buf, offsets = text_buffer(texts)
        self.words: Words = find_words(buf, offsets)
        self.rolling = Rolling(self.words.hashes())
        self.at = np.flatnonzero(whole_windows(self.words, WINDOW))
        self.grams = self.rolling.windows(GRAM)
        n = WINDOW - GRAM + 1
        # the least of each n grams, by doubling; upper half: the hash, lower half: its place, so that the leftmost wins
        low = (self.grams & np.uint64(2**64 - 2**32)) | np.arange(len(self.grams), dtype=np.uint64)
        size = 1
        while 2 * size <= n and len(low) > size:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < n and len(low) > n - size:
            low = np.minimum(low[: len(low) - (n - size)], low[n - size :])
        self.anchors = (low[self.at] & np.uint64(2**32 - 1)).astype(np.int64) if len(self.at) else np.zeros(0, np.int64)

    def anchor_hashes(self) -> np.ndarray:
        """A hash of each anchor, once for each place that is one; least hashes are small, so they are mixed again."""
        return mix(self.grams[np.unique(self.anchors)])

    def suspects(self, counts: Counts) -> np.ndarray:
        """Places of windows whose anchor occurs elsewhere too."""
        distinct, where = np.unique(mix(self.grams[self.anchors]), return_inverse=True)
        return self.at[(counts.find(distinct) > 1)[where]]

    def hashes(self, at: np.ndarray) -> np.ndarray:
        return self.rolling.windows(WINDOW)[at]


def row_keys(piece: pa.RecordBatch) -> np.ndarray:
    """A 64-bit hash of doc_id and text of each row."""
    ids = piece.column("doc_id")
    none = ids.is_null().to_numpy(zero_copy_only=False)
    known = mix(ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(1))
    texts = np.array([xxhash.xxh3_64_intdigest(t or b"") for t in piece.column("text").cast(pa.large_binary()).to_pylist()], np.uint64)
    return mix(texts ^ np.where(none, np.uint64(0), known)).view(np.int64)


def _ship(counts: Counts, ranges: int):
    """Runs of suspect windows: range, hashes, least owner of each, and whether it was met twice."""

    def flush(parts):
        h, rows, places = (np.concatenate([p[k] for p in parts]) for k in range(3))
        h, rows, places, twice = _owners(h, rows, places, np.zeros(len(h), bool))
        part = (((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
        bounds = np.searchsorted(part, np.arange(ranges + 1))
        out = [(int(r), *(x[bounds[r] : bounds[r + 1]].tobytes() for x in (h, rows, places, twice))) for r in np.flatnonzero(np.diff(bounds))]
        cols = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]], ["part", "h", "rows", "places", "twice"])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for piece in slices(batch):
                own = Anchored(piece.column("text"))
                at = own.suspects(counts)
                if not len(at):
                    continue
                text = own.words.text_of[at]
                parts.append((own.hashes(at), row_keys(piece)[text], (at - own.words.first[text]).astype(np.int64)))
                size += len(at)
                if size >= RUN:
                    yield from flush(parts)
                    parts, size = [], 0
        if size:
            yield from flush(parts)

    return run


def _owners(h, rows, places, twice):
    """Distinct hashes, ascending, with their least owner and whether there is more than one occurrence."""
    order = np.lexsort((places, rows, h))
    h, rows, places, twice = h[order], rows[order], places[order], twice[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    many = np.diff(np.append(first, len(h))) > 1
    return h[first], rows[first], places[first], many | np.logical_or.reduceat(twice, first)


def _store_owners(folder: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        read = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in table[c].to_pylist()])
        h, rows, places, twice = _owners(read("h", np.uint64), read("rows", np.int64), read("places", np.int64), read("twice", bool))
        shared.save(folder, f"owners-{part:06d}", {"h": h[twice], "rows": rows[twice], "places": places[twice]})
        return pa.table({"part": pa.array([part], pa.int32()), "size": pa.array([int(twice.sum())], pa.int64())})

    return run


class Owners:
    def __init__(self, folder: str, ranges: int, stored: np.ndarray):
        self.folder, self.ranges, self.stored = folder, ranges, stored

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether a window was met twice, and the row and place of its owner."""
        ok, rows, places = np.zeros(len(h), bool), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        order = np.argsort(h)
        part = (((h[order] >> np.uint64(32)) * np.uint64(self.ranges)) >> np.uint64(32)).astype(np.int64)
        bounds = np.searchsorted(part, np.arange(self.ranges + 1))
        for r in np.flatnonzero((np.diff(bounds) > 0) & self.stored):
            arrays, at = shared.load(f"{self.folder}/owners-{r:06d}", 1024), order[bounds[r] : bounds[r + 1]]
            if len(arrays["h"]):
                slot = np.minimum(np.searchsorted(arrays["h"], h[at]), len(arrays["h"]) - 1)
                same = arrays["h"][slot] == h[at]
                ok[at[same]], rows[at[same]], places[at[same]] = True, arrays["rows"][slot[same]], arrays["places"][slot[same]]
        return ok, rows, places


def _shard(rows: np.ndarray, blocks: np.ndarray, shards: int) -> np.ndarray:
    h = mix(rows.view(np.uint64) ^ mix(blocks.astype(np.uint64) + np.uint64(1)))
    return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


PASSAGES = "shard long, owned boolean, row long, place long, words string"


def _passages(counts: Counts, owners: Owners, shards: int):
    """Runs of windows that were met twice: consecutive ones of one shard, all owned by the document or all not."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                own = Anchored(piece.column("text"))
                at = own.suspects(counts)
                ok, owner, places = owners.find(own.hashes(at))
                at, owner, places = at[ok], owner[ok], places[ok]
                if not len(at):
                    continue
                words, text = own.words, own.words.text_of[at]
                local = at - words.first[text]
                row = row_keys(piece)[text]
                mine = (owner == row) & (places == local)
                shard = _shard(owner, places // PASSAGE, shards)
                new = np.ones(len(at), bool)
                new[1:] = (np.diff(at) != 1) | (np.diff(text) != 0) | (np.diff(shard) != 0) | (mine[1:] != mine[:-1]) | (local[1:] % PASSAGE == 0)
                start = np.flatnonzero(new)
                size = np.diff(np.append(start, len(at)))
                data = words.buf.tobytes()
                spans = [b" ".join([data[words.start[k] : words.end[k]] for k in range(at[s], at[s] + n + WINDOW - 1)]).decode() for s, n in zip(start, size, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard[start]), pa.array(mine[start]), pa.array(row[start]), pa.array(local[start]), pa.array(spans, pa.string())], ["shard", "owned", "row", "place", "words"])

    return run


SPANS = "row long, start long, stop long"


def _spans(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*found, strict=True)) or [(), (), ()])], ["row", "start", "stop"])


def _automaton(folder: str):
    """Stores the automaton of a shard's reference passages; returns the spans of those that equal rows hold."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        rows = sorted(zip(*(table[c].to_pylist() for c in ("words", "row", "place")), strict=True))
        words, again = [], set()
        for k, (text, row, place) in enumerate(rows):
            if k and rows[k - 1][0] == text:
                again.update((r, p, p + text.count(" ") + 1) for r, p in (rows[k - 1][1:], (row, place)))
            else:
                words.append((text, row, place))
        arrays = automaton.build([w.split(" ") for w, _, _ in words])
        arrays |= {"rows": np.array([r for _, r, _ in words], np.int64), "places": np.array([p for _, _, p in words], np.int64)}
        shared.save(folder, f"automaton-{shard:08d}", arrays)
        return pa.Table.from_batches([_spans(sorted(again))])

    return run


def matched_runs(found: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Runs of places with a match of WINDOW words or more: the words they cover, from and to, and where the run ends in the reference."""
    runs: list[list[int]] = []
    for place, (size, end) in enumerate(found, 1):
        if size >= WINDOW:
            if runs and runs[-1][1] == place - 1 and runs[-1][2] == end - 1:
                runs[-1][1:] = place, end
            else:
                runs.append([place - WINDOW, place, end])
    return [(a, b, c) for a, b, c in runs]


def merged(runs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The words that runs in order of their places cover, as spans apart from each other."""
    spans: list[list[int]] = []
    for a, b, _ in runs:
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    return [(a, b) for a, b in spans]


def _stream(folder: str):
    """Of runs of words, in order of shards and words, the spans to be removed, on both sides."""

    def run(batches):
        matcher = current = arrays = last = None
        whole: list[tuple[int, int]] = []
        for batch in batches:
            out = []
            for shard, row, place, words in zip(*(batch.column(c).to_pylist() for c in ("shard", "row", "place", "words")), strict=True):
                if shard != current:
                    arrays = shared.load(f"{folder}/automaton-{shard:08d}", 8)
                    matcher, current, last = automaton.Matcher(arrays), shard, None
                if words != last:
                    runs, last = matched_runs(matcher.matches(words.split(" "))), words
                    for a, b, end in runs:
                        k = int(np.searchsorted(arrays["first"], end, "left")) - 1
                        stop = int(arrays["places"][k]) + end - int(arrays["first"][k])
                        out.append((int(arrays["rows"][k]), stop - (b - a), stop))
                    whole = merged(runs)
                out += [(row, place + a, place + b) for a, b in whole]
            yield _spans(out)

    return run


def _store_spans(folder: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part, table = key[0].as_py(), table.sort_by([("row", "ascending"), ("start", "ascending")])
        shared.save(folder, f"spans-{part:06d}", {c: table[c].to_numpy() for c in ("row", "start", "stop")})
        return pa.table({"part": pa.array([part], pa.int32())})

    return run


class Spans:
    """The spans of words to be removed, by row key."""

    def __init__(self, folder: str, ranges: int, stored: np.ndarray):
        self.folder, self.ranges, self.stored = folder, ranges, stored

    def find(self, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray] | None]:
        out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(rows)
        part = rows % self.ranges
        order = np.argsort(part, kind="stable")
        for k in order[self.stored[part[order]]].tolist():
            arrays = shared.load(f"{self.folder}/spans-{part[k]:06d}", 1024)
            a, b = np.searchsorted(arrays["row"], rows[k]), np.searchsorted(arrays["row"], rows[k], "right")
            if a < b:
                out[k] = arrays["start"][a:b], arrays["stop"][a:b]
        return out


def _removal(spans: Spans, emit):
    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                buf, offsets = text_buffer(piece.column("text"))
                words, data = find_words(buf, offsets), buf.tobytes()
                counts, removed, kept = words.counts, [], []
                for d, found in enumerate(spans.find(row_keys(piece))):
                    a, b = words.first[d], words.first[d + 1]
                    edge = np.zeros(b - a + 1, np.int64)
                    if found is not None:
                        np.add.at(edge, found[0], 1)
                        np.subtract.at(edge, found[1], 1)
                    stay = np.cumsum(edge[:-1]) == 0
                    removed.append(int(len(stay) - stay.sum()))
                    kept.append(b" ".join([data[s:e] for s, e in zip(words.start[a:b][stay].tolist(), words.end[a:b][stay].tolist(), strict=True)]))
                yield emit(piece, counts, removed, kept)

    return run


def _digest(piece, counts, removed, kept):
    return pa.RecordBatch.from_arrays(
        [piece.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], ["doc_id", "n_words", "n_removed", "kept_sha256"]
    )


def _texts(columns):
    def emit(piece, counts, removed, kept):
        new = [old if not n else k.decode() for old, n, k in zip(piece.column("text").to_pylist(), removed, kept, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(new, piece.schema.field("text").type) if c == "text" else piece.column(c) for c in columns], columns)

    return emit


def find_spans(documents: DataFrame) -> Spans:
    """The spans of repeated passages of (doc_id, text)."""
    spark, folder = documents.sparkSession, shared.folder(documents.sparkSession, "substrings")
    texts = documents.select("doc_id", "text")
    ranges = max(64, 4 * texts.rdd.getNumPartitions())
    counts = count_hashes(texts, lambda piece: [Anchored(piece.column("text")).anchor_hashes()], folder, ranges)

    runs = texts.mapInArrow(_ship(counts, ranges), "part int, h binary, rows binary, places binary, twice binary")
    found = runs.groupBy("part").applyInArrow(_store_owners(folder), "part int, size long").collect()
    stored = np.zeros(ranges, bool)
    stored[[r["part"] for r in found]] = True
    shards = max(16, -(-sum(r["size"] for r in found) // SHARD_WINDOWS))
    passages = shared.table(texts.mapInArrow(_passages(counts, Owners(folder, ranges, stored), shards), PASSAGES), folder, "passages")

    equal = shared.table(passages.filter("owned").select("shard", "words", "row", "place").groupBy("shard").applyInArrow(_automaton(folder), SPANS), folder, "equal")
    streamed = passages.filter("NOT owned").select("shard", "row", "place", "words")
    streamed = streamed.repartitionByRange(max(16, texts.rdd.getNumPartitions()), "shard", F.xxhash64("words"), "row", "place").sortWithinPartitions("shard", "words")
    spans = streamed.mapInArrow(_stream(folder), SPANS).unionByName(equal).distinct()
    parts = spans.withColumn("part", F.pmod("row", F.lit(ranges)).cast("int")).groupBy("part").applyInArrow(_store_spans(folder), "part int").collect()
    kept = np.zeros(ranges, bool)
    kept[[r["part"] for r in parts]] = True
    return Spans(folder, ranges, kept)


def remove_repeats(documents: DataFrame) -> DataFrame:
    """The documents, all columns; in texts with repeated passages the words that stay are joined by one space."""
    return documents.mapInArrow(_removal(find_spans(documents), _texts(documents.columns)), documents.schema)


def digest_removal(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of (doc_id, text)."""
    texts = documents.select("doc_id", "text")
    return texts.mapInArrow(_removal(find_spans(texts), _digest), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_removal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
