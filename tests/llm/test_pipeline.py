"""The pipeline, and the queries of classifiers, against plain Python over the same small tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import quality_classifier, toxicity
from sheaf.llm.words import mix1

WORD, PLAIN = re.compile("[^\x20\x09-\x0d]+"), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LICENCE = "This line is a licence that many documents share with others."


def rows():
    plain = [(k, f"Plain text number {k} about rivers and stones in the land {k * 7} with words " + " ".join(f"w{k}x{j}" for j in range(40))) for k in range(60)]
    more = [(100, plain[0][1] + " end"), (101, "stupid idiot " + plain[1][1].replace("w1x", "q")), (102, "some words before " + " ".join(f"bench{j}" for j in range(12)))]
    more += [(200 + k, f"Short text {k}\n{LICENCE}\n" + " ".join(f"v{k}y{j}" for j in range(30))) for k in range(6)]
    more += [(300, None), (301, ""), (302, " \n"), (None, plain[2][1]), (3, plain[3][1]), (3, plain[3][1]), (304, "stupid"), (None, "no id here at all"), (305, "word " * 500)]
    return [(i, t, "en", "s", 0) for i, t in plain + more]


def write(spark, path, documents=None, labels=None):
    spark.createDataFrame(rows() if documents is None else documents, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(k, k % 2, 0) for k in range(60)] + [(101, 1, 1), (304, 0, 1), (304, 0, 0), (None, 1, 1), (5, None, None), (7, 1, 0)] if labels is None else labels
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, " ".join(f"bench{j}" for j in range(12))), (2, None), (None, "stones")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def buckets(word):
    """The subwords of a word's bytes: n-grams of it between two marks, and itself."""
    from sheaf.llm.words import hash_spans

    marked = b" " + word + b" "
    out = [mix1(int.from_bytes(marked[i : i + g], "little") + g) for g in toxicity.GRAMS for i in range(len(marked) - g + 1)]
    own = int(hash_spans(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])
    return [h % toxicity.BUCKETS for h in [*out, mix1(own + 1)]]


def toxic_score(text, model):
    """The model's forward pass: the mean over the subwords of each eight words, the highest of these."""
    value, bias = model
    words = [low(w).encode() for w in WORD.findall(text or "")]
    logits = []
    for k in range(0, len(words), toxicity.PASSAGE):
        bag = [b for w in words[k : k + toxicity.PASSAGE] for b in buckets(w)]
        logits.append(sum(float(value[b]) for b in bag) / len(bag) + bias)
    return 1 / (1 + math.exp(-max(logits, default=bias)))


def without_shared_lines(docs):
    key = lambda x: low(x.strip(" \t\n\v\f\r"))
    held = collections.defaultdict(list)
    for i, t, *_ in docs:
        for k in {key(x) for x in (t or "").split("\n") if len(key(x)) >= 40}:
            held[k].append(-(2**63) if i is None else i)
    out = []
    for i, t, *rest in docs:
        own = -(2**63) if i is None else i
        kept = [x for x in (t or "").split("\n") if len(held[key(x)]) < 5 or max(held[key(x)]) == own]
        text = t if len(kept) == len((t or "").split("\n")) else "\n".join(kept)
        out.append((i, text, rest[0], rest[1], None if text is None else len(text)))
    return out


def one_of_each(docs):
    """Groups of near duplicates; for each what may stay."""
    sets = []
    for _, t, *_ in docs:
        w = WORD.findall(low(t or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, x in enumerate(sets):
        for b in range(a):
            if x and sets[b] and 100 * len(x & sets[b]) >= 80 * len(x | sets[b]):
                root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k, d in enumerate(docs):
        groups[find(k)].append(d)
    return [min(g, key=lambda d: (d[0] is None, d[0] or 0)) for g in groups.values()]


def clean_of(docs, items):
    plain = lambda t: PLAIN.findall(low(t or ""))
    windows = {tuple(w[k : k + 10]) for t in items for w in [plain(t)] for k in range(max(1, len(w) - 9)) if w}
    held = lambda w: any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    return [d for d in docs if not held(plain(d[1]))]


def test_all_stages_against_brute_force(spark, tmp_path):
    import public_tokenizers as P
    import tiktoken

    import corpus_pipeline
    from sheaf.llm import bpe

    path = write(spark, tmp_path)
    source = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity.train(spark, path, source)
    want = [d for d in rows() if toxic_score(d[1], model) < 0.5]
    assert {101, 304} & {d[0] for d in rows()} and not {101, 304} & {d[0] for d in want} and len(want) >= 70
    docs = source
    steps = [lambda d: d, without_shared_lines, one_of_each, lambda d: clean_of(d, [" ".join(f"bench{j}" for j in range(12)), "stones"])]
    for (_, stage), plain in zip(corpus_pipeline.STAGES[:4], steps, strict=True):
        want = plain(want)
        docs = stage(spark, docs, path)
        assert docs.columns == source.columns
        assert collections.Counter(map(tuple, docs.collect())) == collections.Counter(want)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.codec(P.path("byte_bpe_50k.tiktoken")).ranks, special_tokens={})
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [(d[0], own.encode_ordinary(d[1] or ""), d[1] or "") for d in want]
    final = corpus_pipeline.run(spark, path)
    assert final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert collections.Counter(map(tuple, final.collect())) == collections.Counter((i, len(x), sha(" ".join(map(str, x))), sha(t)) for i, x, t in ids)


def test_stages_pass_extra_columns_on(spark, tmp_path):
    import corpus_pipeline

    path = write(spark, tmp_path)
    names = ["_key", "_found", "_spans", "_words", "text_hash", "part", "fate", "shard", "path", "root", "score", "h"]
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({n: F.lit(n) for n in names})
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, path)
        assert docs.columns[-len(names) :] == names and docs.filter("h <> 'h' OR fate <> 'fate'").count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, docs, path).count() == docs.count() > 0


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline

    path = write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, path).count() == 0
    for query in (toxicity.op7_toxicity, quality_classifier.op8_quality_classifier):
        assert query(spark, path).count() == 0


def is_held_out(i, modulus, rest):
    return i is not None and zlib.crc32(str(i).encode()) % modulus == rest


def quality_score(text, model):
    """The model's margin over the distinct indicators of a text, scaled to unit length."""
    from sheaf.llm.words import hash_spans

    weight, squares, bias = model
    data = (text or "").encode()
    bucket = lambda h: h >> (64 - quality_classifier.BITS)
    found = {bucket(mix1(int.from_bytes(data[i : i + n], "little") + n)) for n in quality_classifier.GRAMS for i in range(len(data) - n + 1)}
    words = [w.encode() for w in WORD.findall(text or "")]
    own = [int(hash_spans(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words]
    found |= {bucket(mix1(a * 3 + b)) for a, b in zip(own, own[1:], strict=False)}
    at = sorted(found)
    margin = sum(float(weight[k]) for k in at) / max(1e-9, math.sqrt(sum(float(squares[k]) for k in at))) + bias
    return 1 / (1 + math.exp(-quality_classifier.SLOPE * min(15, max(-15, margin))))


@pytest.mark.parametrize("labels", [None, [], [(k, 1, 0) for k in range(60)]])
def test_classifier_queries_against_brute_force(spark, tmp_path, labels):
    path = write(spark, tmp_path, labels=labels)
    for query, model, plain, modulus, rest in (
        (toxicity.op7_toxicity, toxicity.train(spark, path), toxic_score, 5, 0),
        (quality_classifier.op8_quality_classifier, quality_classifier.train(spark, path), quality_score, 3, 1),
    ):
        got = query(spark, path).collect()
        want = [(i, is_held_out(i, modulus, rest), plain(t, model)) for i, t, *_ in rows()]
        order = lambda r: (r[0] is None, r[0] or 0, r[2])
        for a, b in zip(sorted(((r.doc_id, r.held_out, r.score) for r in got), key=order), sorted(want, key=order), strict=True):
            assert a[:2] == b[:2] and math.isclose(a[2], b[2], abs_tol=1e-5)
        assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)


def plain_descent(vectors, labels, seed=7):
    """Dual coordinate descent for the hinge loss, over dense vectors with a constant one."""
    x = np.hstack([vectors, np.ones((len(vectors), 1))])
    sign, alpha, w, rng = 2 * np.array(labels) - 1, np.zeros(len(x)), np.zeros(x.shape[1]), np.random.default_rng(seed)
    for _ in range(quality_classifier.SWEEPS):
        moved = 0.0
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (sign[i] * (x[i] @ w) - 1) / (x[i] @ x[i]), 0.0), quality_classifier.COST)
            moved = max(moved, abs(new - alpha[i]))
            w, alpha[i] = w + (new - alpha[i]) * sign[i] * x[i], new
        if moved < 1e-3:
            break
    return w


def test_quality_model_against_plain_descent():
    import pyarrow as pa

    texts, labels = [f"{'good calm' if k % 2 else 'BAD!! loud'} text {k * 37 % 11} " * 3 for k in range(30)], [k % 2 for k in range(30)]
    last = np.zeros(quality_classifier.BUCKETS, np.int32)
    sets = [set(quality_classifier._present(p, last).tolist()) for p in quality_classifier.indicators(pa.array(texts, pa.large_string()))]
    names = sorted(set().union(*sets))
    counts = np.array([[1 + sum(k in s for s, y in zip(sets, labels, strict=True) if y == c) for k in names] for c in (0, 1)], float)
    totals = counts.sum(1, keepdims=True) + quality_classifier.BUCKETS - len(names)
    ratio = np.log(counts[1] / totals[1] / (counts[0] / totals[0]))
    rows_ = np.array([[ratio[j] if k in s else 0 for j, k in enumerate(names)] for s in sets])
    w = plain_descent(rows_ / np.linalg.norm(rows_, axis=1, keepdims=True), labels)
    weight, squares, bias = quality_classifier.fit(texts, labels)
    assert np.allclose(weight[names], w[:-1] * ratio, atol=1e-3) and np.allclose(squares[names], ratio**2, rtol=1e-5) and abs(bias - w[-1]) < 1e-3
