"""Line dedup: lines that many documents share are dropped, without a join of lines.

1. Every document gives the 128-bit hash of each of its distinct long line keys.  Spark counts the documents of a hash
   and keeps the largest doc_id (partial aggregates before the shuffle, so a line in every document is one row a task).
2. Hashes that reach the threshold are dealt into shards of bounded size.  A task builds a minimal perfect hash for each
   shard and stores three arrays in its order: 64-bit fingerprints, document counts and largest doc_ids.
3. Documents are read again; each line probes the array of its shard (memory-mapped from the shared folder) and is
   dropped if the fingerprint fits and the document is not the largest one that holds it.

A hash is the pair (h1, h2): h1 picks the shard and the slot, h2 is the fingerprint, so an unlisted line passes for a
listed one with a probability of 2**-64.  A row is a document: repeated rows count one each, and all rows with the
largest doc_id keep the line.  A null or empty text is one empty line; a null doc_id never is the largest and keeps a
listed line only if no holder has a doc_id.  Columns other than doc_id and text are passed on untouched by ``dedup_lines`` and not read
by ``op2_line_dedup``.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import perfect_hash, shared
from sheaf.llm.words import slices

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys of a shard, on average.
SHARD_KEYS = 200_000


def line_key(line: bytes) -> bytes:
    return line.strip(b" \t\n\v\f\r").lower()  # of bytes, lower() changes A-Z alone


def long_enough(key: bytes, least: int = MIN_CHARS) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def _hash(key: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(key)
    return x >> 64, x & (2**64 - 1)


def _line_hashes(least: int):
    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                high, low, ids = [], [], []
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    seen = {_hash(k) for line in (text or b"").split(b"\n") if len(line) >= least and long_enough(k := line_key(line), least)}
                    for a, b in seen:
                        high.append(a)
                        low.append(b)
                    ids += [doc_id] * len(seen)
                arrays = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (high, low)] + [pa.array(ids, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["h1", "h2", "doc_id"])

    return run


def _build(folder: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        h1, h2 = (table[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        order = np.lexsort((h2, h1))  # the same arrays in each attempt
        h1, h2 = h1[order], h2[order]
        index, slot = perfect_hash.build(h1)
        put = lambda v: v[order][np.argsort(slot)]
        arrays = {"prints": h2[np.argsort(slot)], "docs": put(table["docs"].to_numpy()), "largest": put(table["largest"].to_numpy())}
        name = shared.save(folder, f"lines-{shard:06d}", index | arrays)
        return pa.table({"shard": pa.array([shard], pa.int64()), "path": [name]})

    return run


class LineIndex:
    """The shards of an index; ``find`` gives for each hash the number of documents (0: not listed) and the largest doc_id."""

    def __init__(self, paths: list[str | None]):
        self.paths, self.open = paths, {}

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        docs, largest = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        shard = shard_of(h1, len(self.paths))
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(len(self.paths) + 1))
        for s in np.flatnonzero(np.diff(bounds)):
            if self.paths[s] is None:
                continue
            arrays = shared.load(self.paths[s])
            at = order[bounds[s] : bounds[s + 1]]
            slot, ok = perfect_hash.find(arrays, h1[at])
            at, slot = at[ok], slot[ok]
            same = arrays["prints"][slot] == h2[at]
            docs[at[same]], largest[at[same]] = arrays["docs"][slot[same]], arrays["largest"][slot[same]]
        return docs, largest


def shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a hash: its range among equal parts of the high 32 bits."""
    return ((h1 >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def build_index(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
    """The index of all line keys of at least ``min_chars`` code points in at least ``min_docs`` documents."""
    spark = documents.sparkSession
    folder = shared.folder(spark, "line-dedup")
    hashes = documents.select("doc_id", "text").mapInArrow(_line_hashes(min_chars), "h1 long, h2 long, doc_id long")
    counted = hashes.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("largest")).filter(F.col("docs") >= min_docs)
    counted = shared.table(counted, folder, "counted")
    shards = max(1, -(-counted.count() // SHARD_KEYS))
    shard = F.shiftright(F.shiftrightunsigned("h1", 32) * shards, 32).alias("shard")
    largest = F.coalesce("largest", F.lit(-(2**63)).cast("long")).alias("largest")
    built = counted.select(shard, "h1", "h2", "docs", largest).groupBy("shard").applyInArrow(_build(folder), "shard long, path string").collect()
    paths: list[str | None] = [None] * shards
    for r in built:
        paths[r["shard"]] = r["path"]
    return LineIndex(paths)


def _dedup(index: LineIndex, min_chars: int, min_docs: int, emit):
    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                texts = [(t or b"").split(b"\n") for t in piece.column("text").cast(pa.binary()).to_pylist()]
                where, high, low = [], [], []
                for d, lines in enumerate(texts):
                    for k, line in enumerate(lines):
                        if len(line) >= min_chars and long_enough(key := line_key(line), min_chars):
                            a, b = _hash(key)
                            where.append((d, k))
                            high.append(a)
                            low.append(b)
                docs, largest = index.find(np.array(high, np.uint64), np.array(low, np.uint64))
                ids = [-(2**63) if x is None else x for x in piece.column("doc_id").to_pylist()]
                gone: list[set[int]] = [set() for _ in texts]
                for i in np.flatnonzero(docs >= min_docs):
                    d, k = where[i]
                    if ids[d] != largest[i]:
                        gone[d].add(k)
                kept = [b"\n".join(x for k, x in enumerate(lines) if k not in g) if g else b"\n".join(lines) for lines, g in zip(texts, gone, strict=True)]
                yield emit(piece, [len(x) for x in texts], [len(g) for g in gone], kept)

    return run


def _digest(piece, lines, dropped, kept):
    return pa.RecordBatch.from_arrays(
        [piece.column("doc_id"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])],
        ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    )


def _texts(piece, lines, dropped, kept):
    new = [None if old is None and not n else x.decode("utf-8", "replace") for old, n, x in zip(piece.column("text").to_pylist(), dropped, kept, strict=True)]
    at = piece.schema.get_field_index("text")
    return piece.set_column(at, piece.schema.field(at), pa.array(new, piece.schema.field(at).type))


def dedup_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents, all columns, with shared lines taken out of text."""
    return documents.mapInArrow(_dedup(build_index(documents, min_chars, min_docs), min_chars, min_docs, _texts), documents.schema)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    run = _dedup(build_index(documents), MIN_CHARS, MIN_DOCS, _digest)
    return documents.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
