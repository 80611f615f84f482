"""Source divergence audit: how far the word use of each source of a language lies from that of every other.

1. Tasks count terms by language and source in numpy and ship one row for each language and term of a run, with the
   sources in which it was met.  Spark adds them up; one exchange by (lang, term) serves the sums and the gathering of a
   term's counts, sorted by source, which is its sparse source-count vector.  Terms in too few documents end there.
2. Terms with the same vector are one row with a multiplicity.  The smoothed share p of each source is computed for a
   distinct vector, every pair of sources is compared on it once, and the difference counts as often as there are terms.
   Sources are taken in tiles, so a task holds one table of TILE x TILE sums whatever their number.
3. Terms are ranked from the original rows: exact decimals, the first ``top`` of each group.

Shares are whole numbers, 1 + floor(1e9 * (count + 5) / (N + 5 V)), so sums don't depend on an order.  A null text, lang or source
is an empty string.  A row is a document: repeated rows count each time.  A group without any kept term has N = 0; if its
language keeps none at all, V is 0 and its pairs have the value 0.  Ties rank by the item's bytes.  Other columns aren't
read.  An empty table gives an empty result.  What one row holds is a term's sources, of which the result has the square.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.llm import shared
from sheaf.llm.words import LOWER, coded, find_words, slices, sums_per_text, text_buffer

MIN_DOCS, TOP = 30, 50
PRIOR, SCALE = 5, 1_000_000_000
#: Rows of counts that a task holds before it ships them.
RUN = 1_000_000
#: Sources of a tile.
TILE = 512
#: Cells of a block of vectors.
CELLS = 1 << 20
_VECTOR = "array<struct<source:string,n:bigint>>"

#: Bytes that are in no term: up to @, between Z and a, and from { to the end of ASCII.
OUTSIDE = np.zeros(256, bool)
OUTSIDE[:0x41] = OUTSIDE[0x5B:0x61] = OUTSIDE[0x7B:0x80] = True


def _merged(parts: list[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]], groups: list[tuple[str, str]]) -> pa.RecordBatch:
    """One row for each language and term of the parts: (group, term, occurrences, documents) of groups (lang, source)."""
    terms = pa.chunked_array([t for _, t, _, _ in parts]).combine_chunks().dictionary_encode()
    code, group = terms.indices.to_numpy().astype(np.int64), np.concatenate([g for g, _, _, _ in parts])
    langs = sorted({lang for lang, _ in groups})
    lang_of = np.array([langs.index(lang) for lang, _ in groups])
    # by language, term, group
    keys, where = np.unique((lang_of[group] * len(terms.dictionary) + code) * len(groups) + group, return_inverse=True)
    n, docs = (np.bincount(where, np.concatenate([p[k] for p in parts]), len(keys)).astype(np.int64) for k in (2, 3))
    head, source = keys // len(groups), keys % len(groups)
    first = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    bounds = np.append(first, len(keys))
    own = pa.StructArray.from_arrays([pa.array([s for _, s in groups], pa.string()).take(pa.array(source)), pa.array(n)], ["source", "n"])
    rows = [
        pa.array(langs, pa.string()).take(pa.array(head[first] // len(terms.dictionary))),
        terms.dictionary.take(pa.array(head[first] % len(terms.dictionary))),
        pa.array(sums_per_text(docs, bounds)),
        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), own),
    ]
    return pa.RecordBatch.from_arrays(rows, ["lang", "term", "docs", "own"])


def _count(batches):
    groups: dict[tuple[str, str], int] = {}
    parts, held = [], 0
    for batch in batches:
        for piece in slices(batch):
            pairs = zip(piece.column("lang").to_pylist(), piece.column("source").to_pylist(), strict=True)
            group = np.array([groups.setdefault(p, len(groups)) for p in pairs], np.int64)
            buf, offsets = text_buffer(piece.column("text"))
            words = find_words(LOWER[buf], offsets, OUTSIDE)
            code, names = coded(words)
            if not len(code):
                continue
            # by text and term, then by group and term
            each, times = np.unique(words.text_of * len(names) + code, return_counts=True)
            keys, where = np.unique(group[each // len(names)] * len(names) + each % len(names), return_inverse=True)
            parts.append((keys // len(names), names.take(pa.array(keys % len(names))), np.bincount(where, times), np.bincount(where)))
            held += len(keys)
            if held >= RUN:
                yield _merged(parts, list(groups))
                parts, held, groups = [], 0, {}
    if parts:
        yield _merged(parts, list(groups))


def term_vectors(documents: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, vector): the kept terms with their occurrences by source, sorted by source."""
    runs = documents.select("lang", "source", "text").mapInArrow(_count, f"lang string, term string, docs bigint, own {_VECTOR}")
    # one exchange for all that follows; a run's documents go with its first source
    dealt = runs.repartition("lang", "term").select("lang", "term", "docs", F.posexplode("own").alias("at", "own"))
    by_source = dealt.groupBy("lang", "term", F.col("own.source").alias("source")).agg(F.sum("own.n").alias("n"), F.sum(F.when(F.col("at") == 0, F.col("docs")).otherwise(0)).alias("docs"))
    gathered = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"))
    return gathered.filter(F.col("docs") >= min_docs).select("lang", "term", "vector")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), in decimals."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + PRIOR), wide(total + PRIOR * kept))


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """The same of an array, as 64-bit numbers; where a product wouldn't fit, in Python's own numbers."""
    whole = counts if not len(counts) or int(counts.max()) < 2**32 else counts.astype(object)
    return (1 + SCALE * (whole + PRIOR) // (total + PRIOR * kept)).astype(np.int64)


def _file(lang: str) -> str:
    return f"lang-{hashlib.sha256(lang.encode()).hexdigest()[:32]}"


def _save(folder: str):
    """Stores the sources of a language in order, with their sums, for the tasks that compare them."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("source")
        names = [s.encode() for s in table["source"].to_pylist()]
        arrays = {"names": np.frombuffer(b"".join(names), np.uint8), "ends": np.cumsum([len(n) for n in names]), "total": table["total"].to_numpy(), "kept": table["kept"].to_numpy()}
        shared.save(folder, _file(key[0].as_py()), arrays)
        return pa.table({"lang": pa.array([key[0].as_py()]), "tiles": pa.array([-(-len(names) // TILE)], pa.int64())})

    return run


class _Sources:
    """The sources of a language as its file has them."""

    def __init__(self, folder: str, lang: str):
        arrays = shared.load(f"{folder}/{_file(lang)}")
        ends = arrays["ends"].tolist()
        raw = arrays["names"].tobytes()
        self.names = [raw[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)]
        self.at = {name: k for k, name in enumerate(self.names)}
        self.total, self.kept = arrays["total"].tolist(), int(arrays["kept"][0])


def _pairs(folder: str):
    """Of rows in order of (lang, a, b), sums of differences for the pairs of a source of tile a and one of tile b."""

    def run(batches):
        now, sources, held = None, None, None

        def flush() -> pa.RecordBatch:
            lang, a, b = now
            i, j = np.nonzero(held)
            name = pa.array(sources.names, pa.string())
            rows = [pa.array([lang] * len(i), pa.string()), name.take(pa.array(i + a * TILE)), name.take(pa.array(j + b * TILE)), pa.array(held[i, j])]
            return pa.RecordBatch.from_arrays(rows, ["lang", "source", "item", "value"])

        def dense(part: pa.StructArray, bounds: np.ndarray, tile: int) -> np.ndarray:
            """The shares of a tile's sources, one row a vector."""
            low, width = tile * TILE, min(TILE, len(sources.names) - tile * TILE)
            at = np.array([sources.at[s] for s in part.field("source").to_pylist()], np.int64) - low
            row, mine = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), (at >= 0) & (at < width)
            counts = np.zeros((len(bounds) - 1, width), np.int64)
            counts[row[mine], at[mine]] = part.field("n").to_numpy()[mine]
            return np.stack([shares(counts[:, k], sources.total[low + k], sources.kept) for k in range(width)], 1)

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "a", "b")), strict=True))
            first = 0
            while first < batch.num_rows:
                if keys[first] != now:
                    if now is not None:
                        yield flush()
                    if now is None or now[0] != keys[first][0]:
                        sources = _Sources(folder, keys[first][0])
                    now = keys[first]
                    held = np.zeros(tuple(min(TILE, len(sources.names) - t * TILE) for t in now[1:]), np.int64)
                stop = first + 1
                while stop < batch.num_rows and keys[stop] == now and stop - first < CELLS // TILE:
                    stop += 1
                vectors = batch.column("vector").slice(first, stop - first)
                bounds, part = vectors.offsets.to_numpy() - vectors.offsets[0].as_py(), vectors.flatten()
                times = batch.column("times").slice(first, stop - first).to_numpy()[:, None]
                left = dense(part, bounds, now[1])
                right = left if now[1] == now[2] else dense(part, bounds, now[2])
                for k in range(left.shape[1]):  # each pair once: within a tile, with the sources after it
                    low = k + 1 if now[1] == now[2] else 0
                    held[k, low:] += (np.abs(right[:, low:] - left[:, k : k + 1]) * times).sum(0)
                first = stop
        if now is not None:
            yield flush()

    return run


def divergence(vectors: DataFrame, groups: DataFrame, folder: str) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language; groups: (lang, source, total, kept)."""
    tiles = shared.table(groups.groupBy("lang").applyInArrow(_save(folder), "lang string, tiles long"), folder, "tiles")
    span = F.sequence(F.lit(0), F.col("tiles") - 1)
    tiles = tiles.select("lang", "tiles", F.explode(span).alias("a")).select("lang", "a", F.explode(F.sequence("a", F.col("tiles") - 1)).alias("b"))
    distinct = vectors.groupBy("lang", "vector").agg(F.count("*").alias("times"))
    sums = distinct.join(tiles, "lang").sortWithinPartitions("lang", "a", "b").mapInArrow(_pairs(folder), "lang string, source string, item string, value long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sums = sums.select("lang", F.inline(F.array(F.struct("source", "item", "value"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), "value"))))
    names = groups.select("lang", "source")
    others = names.join(names.withColumnRenamed("source", "item"), "lang").filter(F.col("source") != F.col("item"))
    return others.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))


def typical_terms(vectors: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank) of the terms whose share in a group exceeds most that in the language."""
    whole = F.aggregate("vector", F.lit(0).cast("long"), lambda s, v: s + v["n"])
    lang = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    each = vectors.select("lang", F.col("term").alias("item"), whole.alias("whole"), F.inline("vector"))
    each = each.join(groups, ["lang", "source"]).join(lang, "lang")
    value = share(F.col("n"), F.col("total"), F.col("kept")) - share(F.col("whole"), F.col("lang_total"), F.col("kept"))
    found = each.select("lang", "source", "item", value.cast("long").alias("value")).filter(F.col("value") > 0)
    return _ranked(found).filter(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))


def audit(documents: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): the other sources by distance, and the terms that tell a source from its language."""
    folder = shared.folder(documents.sparkSession, "source-audit")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = documents.select(text("lang"), text("source"), text("text"))
    vectors = shared.table(term_vectors(rows, min_docs), folder, "vectors")
    kept = vectors.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = vectors.select("lang", F.inline("vector")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = shared.table(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept")), folder, "groups")
    parts = {"pair": _ranked(divergence(vectors, groups, folder)), "term": typical_terms(vectors, groups, top)}
    pair, term = (df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, df in parts.items())
    return pair.unionByName(term)


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
