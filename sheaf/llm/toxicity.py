"""Toxicity: averaged subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its byte n-grams (with a mark at both ends) and of itself, hashed into a table of embeddings; a
passage of ``PASSAGE`` words is the mean of the embeddings of all its subwords, and a linear softmax over the two
classes reads that mean.  A text scores as its worst passage, so one insult in a long text isn't diluted.  Training sees
the label of the whole text only: it starts from the passages with the most telling word by log odds, then fits
embeddings and softmax jointly and picks the worst passages anew, for toxic and for clean texts alike.

Misspellings that were never seen share n-grams with words that were.  The model is fitted on a bounded sample of
labelled texts (``PER_CLASS`` of each class, none above labelled.MAX_CHARS characters); its size is fixed.  Whole texts
are scored.  A null or empty text, or one without words, has no passage: its score is that of the bias alone.  If no
labelled text is usable, all scores are 0.  Every input row gives one row; only doc_id and text are read; a null doc_id
isn't held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import labelled
from sheaf.llm.words import Words, find_words, map_texts, mix, words_of

BUCKETS, DIMS, PASSAGE = 1 << 18, 6, 8
GRAMS = (3, 4, 5, 6)
PER_CLASS, ROUNDS, STEPS, RATE = 1000, 5, 12, 0.02
#: Bytes of distinct words whose subwords are listed at once, and of a text that is scored at once.
LETTERS, PART = 1 << 18, 2 << 20


@dataclass
class Bags:
    """The distinct words of some texts: their subword buckets, and the words of each passage of each text."""

    grams: np.ndarray  # buckets of all distinct words
    first: np.ndarray  # of word w: grams[first[w]:first[w + 1]]
    word: np.ndarray  # the distinct word at each place
    passage: np.ndarray  # the passage of each place
    text: np.ndarray  # the text of each passage
    texts: int


def _subwords(words: Words, which: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the subwords of the words at some places, and how many each has."""
    start, end = words.start[which], words.end[which]
    size = end - start + 1
    at = np.concatenate([[0], np.cumsum(size)])
    # " w1 w2 ... " : the space before a word and the one after it are the marks
    source = np.repeat(start - at[:-1] - 1, size) + np.arange(at[-1])
    line = np.full(int(at[-1]) + 9, 32, np.uint8)
    line[: at[-1]] = words.buf[np.maximum(source, 0)]
    line[at] = 32
    n = len(line) - 8
    loads = np.ndarray((n,), "<u8", line, 0, (1,))
    marks = np.concatenate([[0], np.cumsum(line == 32)])
    owner = np.append(np.repeat(np.arange(len(size), dtype=np.int32), size), np.int32(len(size)))[:n]
    places, values = [], []
    for g in GRAMS:
        i = np.arange(max(0, int(at[-1]) + 2 - g))
        i = i[marks[i + g - 1] == marks[i + 1]]
        places.append(owner[i])
        values.append((mix((loads[i] & np.uint64((1 << 8 * g) - 1)) + np.uint64(g)) & np.uint64(BUCKETS - 1)).astype(np.int32))
    places.append(np.arange(len(size), dtype=np.int32))
    values.append((mix(hashes + np.uint64(1)) & np.uint64(BUCKETS - 1)).astype(np.int32))
    place, value = np.concatenate(places), np.concatenate(values)
    return value[np.argsort(place, kind="stable")], np.bincount(place, minlength=len(size))


def bags(texts: pa.Array) -> Bags:
    words = words_of(texts, lower=True)
    hashes, firsts, word = np.unique(words.hashes(), return_index=True, return_inverse=True)
    grams, sizes, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
    letters = np.cumsum(words.end[firsts] - words.start[firsts] + 1)
    while at < len(firsts):  # some words at a time: the temporary arrays are many times as large as the result
        stop = max(at + 1, int(np.searchsorted(letters, (letters[at - 1] if at else 0) + LETTERS, "right")))
        value, size = _subwords(words, firsts[at:stop], hashes[at:stop])
        grams.append(value)
        sizes.append(size)
        at = stop
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    counts = words.counts
    within = np.arange(len(words.start)) - np.repeat(words.first[:-1], counts)
    per_text = -(-counts // PASSAGE)
    base = np.concatenate([[0], np.cumsum(per_text)])
    passage = np.repeat(base[:-1], counts) + within // PASSAGE
    return Bags(np.concatenate(grams), first, word.reshape(-1), passage, np.repeat(np.arange(len(counts)), per_text), len(counts))


def _per_word(bag: Bags, values: np.ndarray) -> np.ndarray:
    """The sum of a value of each bucket over the subwords of each distinct word; it doesn't depend on the other words."""
    if len(bag.first) < 2:
        return np.zeros(0)
    return np.add.reduceat(values[bag.grams].astype(np.float64), bag.first[:-1])


def segments(text: bytes, size: int) -> Iterator[bytes]:
    """A long text in parts of about ``size`` bytes, each of whole passages but for the last one's end."""
    at = 0
    while at < len(text):
        words = find_words(np.frombuffer(text, np.uint8, min(len(text) - at, size), at), np.array([0, min(len(text) - at, size)]))
        whole = (len(words.start) - 1) // PASSAGE * PASSAGE  # the last word may go on
        if at + size >= len(text):
            stop = len(text)
        elif whole > 0:
            stop = at + int(words.start[whole])
        else:
            size *= 2  # a passage longer than a part
            continue
        yield text[at:stop]
        at = stop


def passage_logits(bag: Bags, value: np.ndarray, bias: float) -> np.ndarray:
    sums, sizes = _per_word(bag, value), np.diff(bag.first).astype(np.float64)
    n = len(bag.text)
    return np.bincount(bag.passage, sums[bag.word], n) / np.maximum(1.0, np.bincount(bag.passage, sizes[bag.word], n)) + bias


def text_logits(bag: Bags, value: np.ndarray, bias: float) -> np.ndarray:
    """The largest logit among the passages of each text; the bias where there is none."""
    best = np.full(bag.texts, -np.inf)
    np.maximum.at(best, bag.text, passage_logits(bag, value, bias))
    return np.where(np.isfinite(best), best, bias)


def _worst(bag: Bags, scores: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` passages of each text, those with the highest scores."""
    order = np.lexsort((-scores, bag.text))
    start = np.searchsorted(bag.text[order], np.arange(bag.texts))
    rank = np.arange(len(order)) - start[bag.text[order]]
    return order[rank < most]


def fit(texts: list[str], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """The model, with its bias moved to the threshold that told the classes apart best on texts left out of training."""
    value, bias = _fit(texts, labels, seed)
    y = np.array(labels)
    if not len(y) or min(np.sum(y == 0), np.sum(y == 1)) < 10:
        return value, bias
    half, shifts = np.empty(len(y), int), []
    for c in (0, 1):
        half[y == c] = np.arange(np.sum(y == c)) % 2
    for k in (0, 1):
        train, test = np.flatnonzero(half != k), np.flatnonzero(half == k)
        model = _fit([texts[i] for i in train], [labels[i] for i in train], seed)
        logits = text_logits(bags(pa.array([texts[i] for i in test], pa.large_string())), *model)
        order = np.argsort(logits)
        ordered, hits = logits[order], y[test][order]
        # errors with a cut below each place: toxic ones under it, clean ones from it on
        errors = np.concatenate([[0], np.cumsum(hits)]) + (np.sum(hits == 0) - np.concatenate([[0], np.cumsum(hits == 0)]))
        best = np.flatnonzero(errors == errors.min())
        cut = best[len(best) // 2]
        shifts.append((ordered[max(0, cut - 1)] + ordered[min(len(ordered) - 1, cut)]) / 2)
    return value, bias - float(np.mean(shifts))


def _fit(texts: list[str], labels: list[int], seed: int) -> tuple[np.ndarray, float]:
    """For each bucket the dot product of its embedding with the difference of the two class vectors, and the bias."""
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return np.zeros(BUCKETS, np.float32), -50.0 if not y.sum() else 50.0
    bag = bags(pa.array(texts, pa.large_string()))
    counts = np.diff(bag.first)
    # log odds of words, for the first choice of passages
    of_text = bag.text[bag.passage]
    pairs = np.unique(of_text * np.int64(len(counts)) + bag.word)
    doc, word = pairs // len(counts), pairs % len(counts)
    seen = [np.zeros(BUCKETS) for _ in range(2)]
    for c in (0, 1):
        at = np.bincount(word[y[doc] == c], minlength=len(counts))
        np.add.at(seen[c], bag.grams, np.repeat(at, counts))
    n = [np.sum(y == c) for c in (0, 1)]
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    odds *= (seen[0] + seen[1]) / (seen[0] + seen[1] + 3)
    telling = _per_word(bag, odds) / np.maximum(counts, 1)
    scores = np.full(len(bag.text), -np.inf)
    np.maximum.at(scores, bag.passage, telling[bag.word])
    # the first embedding dimension starts as the log odds, so joint training begins at naive Bayes; the others at random
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.02, (DIMS, BUCKETS)).astype(np.float32)
    table[0] = odds
    heads, bias = rng.normal(0, 0.5, (2, DIMS)), np.zeros(2)
    heads[:, 0] = -0.5, 0.5
    params = [table, heads, bias]
    moments = [(np.zeros_like(p), np.zeros(1)) for p in params]
    step = 0
    for turn in range(ROUNDS):
        chosen = _worst(bag, scores, 2 if turn else 1)
        chosen = chosen[(y[bag.text[chosen]] == 0) | (np.isin(chosen, _worst(bag, scores, 1)))]
        slot = np.full(len(bag.text), -1)
        slot[chosen] = np.arange(len(chosen))
        inside = np.flatnonzero(slot[bag.passage] >= 0)
        used, word = np.unique(bag.word[inside], return_inverse=True)
        rows = slot[bag.passage[inside]]
        take = np.concatenate([np.arange(a, b) for a, b in zip(bag.first[used], bag.first[used + 1], strict=True)])
        grams, size = bag.grams[take], counts[used]
        edges = np.concatenate([[0], np.cumsum(size)])
        total = np.bincount(rows, size[word], len(chosen))
        target = y[bag.text[chosen]]
        # both classes weigh the same, but clean texts no less than half of what their number would give
        weight = np.where(target == 1, 0.5 / max(1, np.sum(target == 1)), 0.5 / max(1, np.sum(target == 0)))
        for _ in range(STEPS):
            step += 1
            mean = np.empty((DIMS, len(chosen)))
            for k in range(DIMS):
                run = np.concatenate([[0.0], np.cumsum(table[k][grams], dtype=np.float64)])
                per_word = run[edges[1:]] - run[edges[:-1]]
                mean[k] = np.bincount(rows, per_word[word], len(chosen)) / total
            logits = heads @ mean + bias[:, None]
            p = 1 / (1 + np.exp(np.clip(logits[0] - logits[1], -60, 60)))
            d1 = (p - target) * weight
            delta = np.stack([-d1, d1])
            back = heads.T @ delta / total
            grad_table = np.empty_like(table)
            for k in range(DIMS):
                per_word = np.bincount(word, back[k][rows], len(used))
                grad_table[k] = np.bincount(grams, np.repeat(per_word, size), BUCKETS)
            grads = [grad_table, delta @ mean.T, delta.sum(1)]
            # one step size for a whole table: subwords that many passages agree on move most, those met once hardly
            for p_, g, (m, v), rate in zip(params, grads, moments, (RATE, RATE, RATE), strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * ((g * g).sum() / max(1, np.count_nonzero(g)) - v)
                p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-12)
        value = ((heads[1] - heads[0]) @ table).astype(np.float32)
        scores = passage_logits(bag, value, bias[1] - bias[0])
    return value, float(bias[1] - bias[0])


def _probabilities(texts: pa.Array, value: np.ndarray, bias: float) -> np.ndarray:
    """Of the texts of a slice; a text that is longer than a part is a slice of its own and read in parts."""
    if len(texts) == 1 and len(long := texts[0].as_py() or "") > PART // 4 and len(raw := long.encode()) > PART:
        logits = np.array([max(text_logits(bags(pa.array([part], pa.large_binary()).cast(pa.large_string())), value, bias)[0] for part in segments(raw, PART))])
    else:
        logits = text_logits(bags(texts), value, bias)
    return 1 / (1 + np.exp(-np.clip(logits, -60, 60)))


def _scores(value: np.ndarray, bias: float):
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(_probabilities(piece.column("text"), value, bias))], ["doc_id", "score"])

    return run


def train(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> tuple[np.ndarray, float]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if documents is None else documents
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit(*labelled.sample(docs, labels, "toxic", labelled.remainder("doc_id", 5) != 0, PER_CLASS))


def score_toxicity(documents: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score) for each row."""
    return map_texts(documents.select("doc_id", "text"), _scores(*model), "doc_id long, score double")


def keep_clean(documents: DataFrame, model: tuple[np.ndarray, float], below: float = 0.5) -> DataFrame:
    """The documents, all columns, that score less than ``below``."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        return piece.filter(pa.array(_probabilities(piece.column("text"), *model) < below))

    return map_texts(documents, run, documents.schema)


def held_out(doc_id: str, modulus: int, rest: int) -> Column:
    return F.coalesce(labelled.remainder(doc_id, modulus) == rest, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_toxicity(documents, train(spark, sf_dir))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
