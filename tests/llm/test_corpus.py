"""The audit of sources, SentencePiece and the grouping of spellings against brute force, a library and hand-made cases."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from sheaf.llm import piece_bpe, source_audit, spelling
from tests.llm.test_llm import ROWS, low, rows_of, sha

SCHEMA = "doc_id long, text string, lang string, source string, term string, word string, n long, value string"


def corpus():
    """Rows of several languages and sources: nulls, empty and very long texts, repeats, near spellings, a language without kept terms."""
    rng = random.Random(3)
    base = ["language", "spelling", "sentence", "document", "naïveté", "straße", "çedille", "zzzzzzz", "abcabcabc"]
    rows = []
    for k in range(150):
        words = [rng.choice(base) for _ in range(rng.randrange(40))] + [f"Word{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}" for _ in range(rng.randrange(9))]
        for _ in range(rng.randrange(3)):
            w = rng.choice(base)
            at = rng.randrange(len(w))
            words.append(rng.choice([w[:at] + w[at + 1 :], w[:at] + "q" + w[at + 1 :], w[:at] + "é" + w[at:]]))
        rng.shuffle(words)
        rows.append((k, rng.choice([" ", "-", "\n1 "]).join(words), rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", "s3", None, "ä"])))
    rows += [(500, None, "en", "only-null"), (501, "", "en", "s1"), (502, "lonely words", "xx", "s1"), (503, "", "xx", "s2"), (None, "language spelling", "en", "s2"), (504, "language " * 5000, "de", "s1"), (505, "x" * 5000, "en", "s2"), (506, "日本語 Ünï×÷ code", "en", "s3")]
    return rows + rows[:20]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, "t", "w", 1, "v") for r in corpus()], SCHEMA).repartition(5)


def audit_rows(rows, least, top):
    texts = [((lang or ""), (source or ""), collections.Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text or "")))) for _, text, lang, source in rows]
    found = collections.Counter()
    for lang in {t[0] for t in texts}:
        docs = collections.Counter(w for own, _, c in texts if own == lang for w in c)
        kept = [w for w, n in docs.items() if n >= least]
        count = {s: collections.Counter() for own, s, _ in texts if own == lang}
        for own, s, c in texts:
            if own == lang:
                count[s].update({w: n for w, n in c.items() if w in set(kept)})
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in count.items()}, share(sum(count.values(), collections.Counter()))
        for s in count:
            pairs = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in count if o != s]
            terms = [(q[w] - p[s][w], w.encode(), w) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                found.update((lang, s, part, item, -value, k) for k, (value, _, item) in enumerate(items, 1))
    return found


def test_source_audit(table, monkeypatch):
    columns = ("lang", "source", "part", "item", "value", "rank")
    for tile in (512, 2):  # with two sources a tile, pairs come from several
        monkeypatch.setattr(source_audit, "TILE", tile)
        want = audit_rows(corpus(), 30, 3)
        assert rows_of(source_audit.audit(table, top=3), *columns) == want
        assert len({r[:2] for r in want}) > 8 and any(r[0] == "xx" and r[4] == 0 for r in want)
    assert source_audit.audit(table.limit(0)).collect() == []


def test_source_audit_parts(monkeypatch):
    """Runs that are shipped early, and counts whose products pass 64 bits."""
    big = np.array([0, 7, 2**40, 3 * 10**12])
    assert source_audit.shares(big, 10**13, 50).tolist() == [1 + 10**9 * (c + 5) // (10**13 + 250) for c in big.tolist()]
    monkeypatch.setattr(source_audit, "RUN", 1)
    batch = pa.RecordBatch.from_pydict({"lang": ["a", "b", "a"], "source": ["x", "x", "y"], "text": ["u v u", "u", "u w"]})
    total = collections.Counter()
    for b in source_audit._count([batch, batch]):
        for r in b.to_pylist():
            total.update({(r["lang"], r["term"], o["source"]): o["n"] for o in r["own"]} | {(r["lang"], r["term"]): r["docs"]})
    assert total == {("a", "u", "x"): 4, ("a", "u", "y"): 2, ("a", "u"): 4, ("a", "v", "x"): 2, ("a", "v"): 2, ("a", "w", "y"): 2, ("a", "w"): 2, ("b", "u", "x"): 2, ("b", "u"): 2}


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_piece_bpe(spark, library):
    rows = [(i, t, "en", "s", 1, "x") for i, t in ROWS]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long, ids string").repartition(3)
    want = collections.Counter()
    for i, t in ROWS:
        ids = library.encode(t or "")
        want[i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))] += 1
    assert rows_of(piece_bpe.digest_pieces(table), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert piece_bpe.digest_pieces(table.limit(0)).collect() == []
    encoded = piece_bpe.decode_column(piece_bpe.encode_column(table, into="pieces"), column="pieces")
    assert all(r["pieces"] == library.encode(r["text"] or "") and r["decoded"] == (r["text"] or "") for r in encoded.collect())


def test_piece_bpe_codec(library):
    own, rng = piece_bpe.codec(public_tokenizers.path("piece_bpe_32k.model")), random.Random(2)
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "th", "in", "▁", "é", "中", "😀", "\x00", "<0x41>", "</s>", "<unk>", "1", "23", "don't", "�", " ⁇ ", "ﬁ"]
    texts = ["".join(rng.choices(parts, k=rng.choice([0, 1, 2, 5, 30, 300]))) for _ in range(1500)] + ["   ", "▁", "ab" * 4000, " " * 999]
    for text, (ids, said) in zip(texts, piece_bpe._many(texts, public_tokenizers.path("piece_bpe_32k.model")), strict=True):
        want = library.encode(text)
        assert ids == ",".join(map(str, want)) and own.encode(text) == want
        assert said == library.decode(want) == own.decode(want)
    for _ in range(1500):  # ids that no text gives
        ids = [rng.choice([0, 1, 2, 259, rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randrange(7))]
        assert own.decode(ids) == library.decode(ids)
    for _ in range(300):
        word = "".join(rng.choices("▁theinaéxz", k=rng.choice([2, 9, 40, 41, 60])))
        assert own.segment(word) == [own.ids[p] for p in own._alone(word)]


def test_piece_bpe_table(monkeypatch):
    """Words that leave the table and come back, and some that are too long for it."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    monkeypatch.setattr(piece_bpe, "TABLE_WORDS", 5)
    monkeypatch.setattr(piece_bpe, "WORD_CHARS", 8)
    monkeypatch.setattr(piece_bpe, "_TABLES", {})
    own = piece_bpe.codec(path)
    for texts in (["a b c", "d e"], ["f g abcdefghijkl", None], ["a b abcdefghijkl"], ["h i j k l m n o p"]):
        assert [x[0] for x in piece_bpe._many(texts, path)] == [",".join(map(str, own.encode(t or ""))) for t in texts]
        assert all(len(w) <= 8 for w in piece_bpe._TABLES[path].young)


def variants(rows, least=7, count=2, ratio=10, every=31):
    n = collections.Counter()
    for doc_id, text, *_ in rows:
        for w in map(low, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= least
    n = {w: c for w, c in n.items() if c >= count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, neighbours = {}, {w: [o for o in n if near(w, o)] for w in n}
    for w, others in neighbours.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return collections.Counter((w, form[w], root(w), n[w], len(neighbours[w]), n.get(form[w])) for w in n)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_spelling_variants(table):
    want = variants(corpus())
    assert sum(r[1] is not None for r in want) > 20
    assert rows_of(spelling.spelling_variants(table), *COLUMNS) == want
    assert rows_of(spelling.spelling_variants(table, every=0, min_count=1, ratio=3), *COLUMNS) == variants(corpus(), count=1, ratio=3, every=0)
    assert spelling.spelling_variants(table.limit(0)).collect() == []


def test_spelling_chains(spark):
    """Chains of forms of several steps, ties, words that share deletions without being near, and repeated letters."""
    times = {"aaaaaaa": 1, "aaaaaaab": 3, "aaaaaabb": 9, "aaaaabbb": 27, "aaaabbbb": 81, "aaabbbbb": 243, "abcdefgh": 5, "bacdefgh": 50, "abcdefgx": 10, "abcdefgy": 10, "éabcdefg": 2, "èabcdefg": 6}
    rows = [(k, " ".join([w] * n), None, None) for k, (w, n) in enumerate(times.items())]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = rows_of(spelling.spelling_variants(table, every=0, min_count=1, ratio=2), *COLUMNS)
    assert found == variants(rows, count=1, ratio=2, every=0)
    by_word = {r[0]: r for r in found}
    assert by_word["aaaaaaa"][2] == "aaabbbbb" and by_word["abcdefgh"][1] == "abcdefgx" and by_word["bacdefgh"][4] == 0


def test_spelling_runs(monkeypatch):
    monkeypatch.setattr(spelling, "RUN", 1)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, None, 2], "text": ["Letters letters, LETTERSé", None, "letters÷ short"]})
    total = collections.Counter()
    for b in spelling._count(7, 0)([batch, batch]):
        total.update(dict(zip(*b.to_pydict().values(), strict=True)))
    assert total == {"letters": 4, "lettersé": 2, "letters÷": 2}
