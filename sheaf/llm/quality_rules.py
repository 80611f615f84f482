"""Quality rules: repetition coverage of whole texts.

Rolling hashes of word windows of several lengths are computed in numpy for a slice of texts at once.  For each length
the characters of words inside windows that repeat an earlier window of the same text are measured against all
characters in words; whole lines that repeat an earlier line are measured likewise.  A text is rejected when one of
these shares is above its bound (the published bounds for web text, see ``RULES``), or by the base rule.

Nulls and empty texts have no words and fail the base rule.  Every input row gives one row, repeated rows too; a null
doc_id is passed on.  Other columns of the input are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from sheaf.llm.words import Rolling, Words, covered, map_texts, mix, per_text, sums_per_text, text_buffer, find_words, whole_windows

#: Window length and the largest allowed share of characters, in percent, inside repeats of an earlier window.
RULES = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: The same for lines, by lines and by characters.
MAX_DUP_LINES, MAX_DUP_LINE_CHARS = 30, 20
MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_lines long, dup_line_chars long, " + ", ".join(f"dup_{n}gram_chars long" for n in RULES)
)


def _repeats(words: Words, rolling: Rolling, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of windows found twice or more in their text, and which of these are not the first of their kind."""
    ok = whole_windows(words, n)
    at = np.flatnonzero(ok)
    keys = rolling.windows(n)[at] ^ mix((words.text_of[at] + 1).astype(np.uint64)) if len(at) else np.zeros(0, np.uint64)
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    slot = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    hit = twice[slot] == keys
    at, slot = at[hit], slot[hit]
    later = np.ones(len(at), bool)
    later[np.unique(slot, return_index=True)[1]] = False
    return at, later


def _cover(at: np.ndarray, n: int, size: int) -> np.ndarray:
    flags = np.zeros(size, bool)
    flags[at] = True
    return covered(flags, n, size)


def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    buf, offsets = text_buffer(batch.column("text"))
    words = find_words(buf, offsets)
    rows, size = batch.num_rows, len(words.start)
    lead = np.flatnonzero((buf & 0xC0) == 0x80)  # bytes that continue a code point
    chars = np.searchsorted(lead, words.start)
    chars = words.end - words.start - (np.searchsorted(lead, words.end) - chars)  # code points of each word
    word_chars = sums_per_text(chars, words.first)
    out = {
        "doc_id": batch.column("doc_id"),
        "n_words": words.counts,
        "word_chars": word_chars,
        "n_symbols": per_text(np.flatnonzero(SYMBOL[buf]), offsets),
    }
    rolling = Rolling(words.hashes())
    at, _ = _repeats(words, rolling, WINDOW)
    out["n_repeat_words"] = sums_per_text(_cover(at, WINDOW, size), words.first)
    shares = {}
    for n in RULES:
        at, later = _repeats(words, rolling, n)
        shares[n] = sums_per_text(np.where(_cover(at[later], n, size), chars, 0), words.first)
    lines, dup_lines, dup_chars = (np.zeros(rows, np.int64) for _ in range(3))
    total = np.concatenate([[0], np.cumsum(chars)])
    data = memoryview(np.ascontiguousarray(buf))
    breaks = np.flatnonzero(buf == 10)
    spans = np.searchsorted(breaks, offsets)
    for d in range(rows):
        cuts = [offsets[d] - 1, *breaks[spans[d] : spans[d + 1]], offsets[d + 1]]
        if len(cuts) == 2:
            lines[d] = words.first[d] < words.first[d + 1]
            continue
        seen: set[bytes] = set()
        at_word = np.searchsorted(words.start, cuts)
        for k in range(len(cuts) - 1):
            if at_word[k] == at_word[k + 1]:
                continue
            lines[d] += 1
            key = xxhash.xxh3_128_digest(data[cuts[k] + 1 : cuts[k + 1]])
            if key in seen:
                dup_lines[d] += 1
                dup_chars[d] += total[at_word[k + 1]] - total[at_word[k]]
            seen.add(key)
    failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT * out["n_words"])
    bad = (100 * dup_lines > MAX_DUP_LINES * lines) | (100 * dup_chars > MAX_DUP_LINE_CHARS * word_chars)
    for n, most in RULES.items():
        bad |= 100 * shares[n] > most * word_chars
    out |= {"n_dup_lines": dup_lines, "base_failed": failed, "kept": ~failed & ~bad, "n_lines": lines, "dup_line_chars": dup_chars}
    out |= {f"dup_{n}gram_chars": shares[n] for n in RULES}
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(out[n]) if isinstance(out[n], np.ndarray) else out[n] for n in names], names)


def repetition(documents: DataFrame) -> DataFrame:
    """The measures and the verdict for each row of (doc_id, text)."""
    return map_texts(documents.select("doc_id", "text"), measure, SCHEMA)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(spark.read.parquet(f"{sf_dir}/documents.parquet"))
