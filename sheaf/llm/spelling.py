"""Spelling variant grouping: words one edit apart, each led to the far more frequent word that it misspells.

1. Tasks count words in numpy and ship one row for each distinct word of a run; Spark adds them up.
2. Symmetric-delete join: a word emits itself and its distinct single deletions, and words that share a key are compared.
   Two words one replacement apart share exactly one key, the text without that place, and two words one insertion apart
   exactly one, the shorter word; so each near pair is met once, and other candidates go by their exact distance.
   A key of m letters has at most (m + 1) x letters + 1 words, whatever the corpus.
3. Near words are aggregated by word: how many there are, and the one with most occurrences.  It is the word's form if it
   has at least ``ratio`` times as many.
4. Roots come from joins of the form table with itself, each of which doubles the length of the chains followed.  Along a chain counts
   grow by ``ratio``, so a few rounds end it; each is a written table.

Words are runs of letters of ASCII and of Latin-1 (U+00C0 to U+00FF), A-Z lower-cased.  Before they are counted, the
audit damages a known share of them: if ``every`` divides the crc32 of ``<doc_id>:<word>``, one letter is deleted, in
all places of that document.  Ties go to the least word by code points.  A row is a document: repeated rows count each
time.  A null text has no words; a null doc_id is an empty string in the crc.  Other columns aren't read.  An empty table gives an
empty result.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import shared
from sheaf.llm.words import LOWER, coded, find_runs, slices, text_buffer

MIN_CHARS, MIN_COUNT, RATIO, EVERY = 7, 2, 10, 31
#: Rows of counts that a task holds before it ships them.
RUN = 500_000

_ASCII = np.zeros(256, bool)
_ASCII[0x41:0x5B] = _ASCII[0x61:0x7B] = True


def _letters(buf: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters: ASCII ones, and both bytes of U+00C0 to U+00FF, all of which start with 0xC3."""
    inside = _ASCII[buf] | (buf == 0xC3)
    inside[1:] |= buf[:-1] == 0xC3
    return inside


def _merged(parts: list[tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
    words = pa.chunked_array([w for w, _ in parts]).combine_chunks().dictionary_encode()
    n = np.bincount(words.indices.to_numpy(), np.concatenate([n for _, n in parts]), len(words.dictionary)).astype(np.int64)
    return pa.RecordBatch.from_arrays([words.dictionary, pa.array(n)], ["word", "n"])


def _count(least: int, every: int):
    """(word, n) of words of at least ``least`` letters; every 0 damages none."""

    def read(piece: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
        buf, offsets = text_buffer(piece.column("text"))
        words = find_runs(LOWER[buf], offsets, _letters(buf))
        code, names = coded(words)
        listed = names.to_pylist()
        size = np.array([len(w) for w in listed], np.int64)
        keys, times = np.unique(words.text_of * max(1, len(listed)) + code, return_counts=True)
        text, code = keys // max(1, len(listed)), keys % max(1, len(listed))
        long = size[code] >= least
        text, code, times = text[long], code[long], times[long]
        if not every:
            return names, np.bincount(code, times, len(listed))
        raw = [w.encode() for w in listed]
        start = [crc32(f"{'' if d is None else d}:".encode()) for d in piece.column("doc_id").to_pylist()]
        h = np.array([crc32(raw[c], start[t]) for t, c in zip(text.tolist(), code.tolist(), strict=True)], np.int64)
        hit = h % every == 0
        own = np.bincount(code[~hit], times[~hit], len(listed))
        damaged, n = [], []
        for c, x, k in zip(code[hit].tolist(), h[hit].tolist(), times[hit].tolist(), strict=True):
            word = listed[c]
            if len(word) > least:
                at = x % len(word)
                damaged.append(word[:at] + word[at + 1 :])
                n.append(k)
        return pa.concat_arrays([names, pa.array(damaged, pa.string())]), np.concatenate([own, np.array(n, np.float64)])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for piece in slices(batch):
                names, n = read(piece)
                some = np.flatnonzero(n)
                if len(some):
                    parts.append((names.take(pa.array(some)), n[some]))
                    held += len(some)
                if held >= RUN:
                    yield _merged(parts)
                    parts, held = [], 0
        if held:
            yield _merged(parts)

    return run


def word_counts(documents: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n) of the distinct words of at least that many letters and occurrences."""
    runs = documents.select("doc_id", "text").mapInArrow(_count(min_chars, every), "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) of the words of (word, n) whose distance is one, a before b."""
    cut = lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word")))
    keys = F.concat(F.array("word"), F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word")), cut)))
    keyed = words.filter(F.length("word") > 0).select(F.explode(keys).alias("key"), "word", "n")
    a = keyed.select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = keyed.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
    # at most one: of different words with a key in common those at distance two are left out
    return a.join(b, "key").filter((F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n) of all words of (word, n)."""
    both = F.array(
        F.struct(F.col("a").alias("word"), F.col("n_b").alias("n"), F.col("b").alias("near")),
        F.struct(F.col("b").alias("word"), F.col("n_a").alias("n"), F.col("a").alias("near")),
    )
    near = near_pairs(words).select(F.inline(both))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    far = -F.col("best.less") >= ratio * F.col("n")
    form = [F.when(far, F.col("best.near")).alias("form"), F.when(far, -F.col("best.less")).alias("form_n")]
    return words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *form)


def roots(formed: DataFrame, folder: str) -> DataFrame:
    """(word, root) of the words that have a form: where the chain of forms ends."""
    found = formed.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"), F.lit(True).alias("open"))
    found = shared.table(found, folder, "roots-0")
    k = 0
    while not found.filter("open").isEmpty():
        k += 1
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("further"), F.col("open").alias("more"))
        doubled = found.filter("open").join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.coalesce("more", F.lit(False)).alias("open"))
        found = shared.table(doubled.unionByName(found.filter("NOT open")), folder, f"roots-{k}")
    return found.select("word", "root")


def spelling_variants(documents: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, every: int = EVERY) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    folder = shared.folder(documents.sparkSession, "spelling")
    words = shared.table(word_counts(documents, min_chars, min_count, every), folder, "words")
    formed = shared.table(forms(words, ratio), folder, "forms")
    ends = roots(formed, folder)
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
