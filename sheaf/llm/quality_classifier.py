"""Quality classifier: naive Bayes support vectors over n-gram indicators.

The indicators of a text are its distinct byte n-grams and word pairs, hashed into a table.  Each is scaled by the log
ratio of its smoothed shares in the two classes, a text's vector is brought to unit length, and a linear hinge-loss
model is fitted by dual coordinate descent.  The score is a logistic curve of the margin.

The model is fitted on a bounded sample of labelled texts (``PER_CLASS`` of each class); its size is fixed.  Whole texts
are scored; a null or empty text has no indicators and scores by the bias alone.  If no labelled text is usable, or all
have one label, all scores are the same: 0.982 without labels or with label 1, else 0.018.  Every input row gives one row; only doc_id and text are read; a null doc_id isn't held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import labelled
from sheaf.llm.toxicity import held_out
from sheaf.llm.words import find_words, map_texts, mix, text_buffer

BITS = 20
BUCKETS = 1 << BITS
GRAMS = (1, 2, 3, 4)
PER_CLASS, COST, SWEEPS, SLOPE = 1000, 8.0, 15, 4.0


def indicators(texts: pa.Array):
    """For each text the buckets of its n-grams, with repeats."""
    buf, offsets = text_buffer(texts)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    loads = np.ndarray((len(buf),), "<u8", padded, 0, (1,))
    bucket = lambda h: (h >> np.uint64(64 - BITS)).astype(np.uint32)
    grams = [(n, bucket(mix((loads & np.uint64((1 << 8 * n) - 1)) + np.uint64(n)))) for n in GRAMS]
    words = find_words(buf, offsets)
    h = words.hashes()
    pairs = bucket(mix(h[:-1] * np.uint64(3) + h[1:]))
    for d in range(len(offsets) - 1):
        a, b = offsets[d], offsets[d + 1]
        yield [g[a : max(a, b - n + 1)] for n, g in grams] + [pairs[words.first[d] : max(words.first[d], words.first[d + 1] - 1)]]


def _present(parts: list[np.ndarray], last: np.ndarray) -> np.ndarray:
    """The distinct buckets of a text; ``last`` is room for a place in each bucket, with whatever is left in it."""
    every = np.concatenate(parts)
    places = np.arange(len(every), dtype=np.int32)
    last[every] = places
    return every[last[every] == places]


def fit(texts: list[str], labels: list[int], seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """The weight of each bucket times its log ratio, the ratio squared, and the bias."""
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return np.zeros(BUCKETS, np.float32), np.ones(BUCKETS, np.float32), 1.0 if not len(y) or y.min() else -1.0
    last = np.zeros(BUCKETS, np.int32)
    sets = [_present(parts, last) for k in range(0, len(texts), 200) for parts in indicators(pa.array(texts[k : k + 200], pa.large_string()))]
    counts = np.ones((2, BUCKETS))
    for s, c in zip(sets, labels, strict=True):
        counts[c, s] += 1
    shares = counts / counts.sum(1, keepdims=True)
    ratio = np.log(shares[1] / shares[0])
    rows = []
    for s in sets:
        v = ratio[s]
        rows.append((v / max(1e-9, np.sqrt(v @ v))).astype(np.float32))
    # hinge loss, l2 penalty: coordinates of the dual in a new random order each sweep; the bias is a constant feature
    w, bias, alpha, sign = np.zeros(BUCKETS), 0.0, np.zeros(len(y)), 2 * y - 1
    rng = np.random.default_rng(seed)
    norm = np.array([float(r @ r) + 1 for r in rows])
    for _ in range(SWEEPS):
        moved = 0.0
        for i in rng.permutation(len(y)):
            s, r = sets[i], rows[i]
            slope = sign[i] * (r @ w[s] + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), COST)
            if new != alpha[i]:
                change = (new - alpha[i]) * sign[i]
                moved = max(moved, abs(change))
                w[s] += change * r
                bias += change
                alpha[i] = new
        if moved < 1e-3:
            break
    return (w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), float(bias)


def margins(texts: pa.Array, model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    weight, squares, bias = model
    last = np.zeros(BUCKETS, np.int32)
    out = []
    for parts in indicators(texts):
        at = _present(parts, last)
        out.append(float(weight[at].sum(dtype=np.float64) / max(1e-9, np.sqrt(squares[at].sum(dtype=np.float64)))) + bias)
    return np.array(out)


def _scores(model):
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        score = 1 / (1 + np.exp(-SLOPE * np.clip(margins(piece.column("text"), model), -15, 15)))
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def train(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if documents is None else documents
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit(*labelled.sample(docs, labels, "quality", labelled.remainder("doc_id", 3) != 1, PER_CLASS))


def score_quality(documents: DataFrame, model) -> DataFrame:
    """(doc_id, score) for each row."""
    return map_texts(documents.select("doc_id", "text"), _scores(model), "doc_id long, score double")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_quality(documents, train(spark, sf_dir))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
