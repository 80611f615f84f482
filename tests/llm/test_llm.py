"""Every operator against brute force on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheaf.llm import automaton, bpe, decontaminate, html_main, jaccard_join, language_model, line_dedup, perfect_hash, quality_classifier, quality_rules, substring_dedup, toxicity
from sheaf.llm.words import hash_spans

WORD = re.compile("[^\x20\x09-\x0d]+")
low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def make():
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("ka", "Lo", "mü", "ne", "zz") for b in ("ri", "ta", "ñu", "xx", "", "o,")]
    text = lambda n: " ".join(rng.choice(vocabulary) + (str(rng.randrange(50)) if rng.random() < 0.6 else "") for _ in range(n))
    passage, line = text(60), "The licence of this text is the usual one, as everybody knows."
    rows = [(k, text(rng.randrange(0, 150))) for k in range(40)]
    rows += [(100 + k, text(30) + "\n" + line + "  \n" + text(20)) for k in range(8)]
    rows += [(200 + k, text(rng.randrange(20)) + " " + passage + " " + text(rng.randrange(20))) for k in range(5)]
    base = text(120)
    rows += [(300, base), (301, base), (302, base.upper())]
    for k in range(60):  # near copies, more than a short list holds
        words = base.split(" ")
        for _ in range(1 + k % 7):
            words[rng.randrange(120)] = f"new{rng.randrange(10**6)}"
        rows.append((400 + k, " ".join(words)))
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "one two"), (504, "One two"), (505, "word " * 3000), (506, "x" * 5000), (507, "a\n\na"), (508, "日本語 テキスト " * 30), (None, "null id " * 10), (300, base)]
    return rows


ROWS = make()
TEXTS = [(i, t or "") for i, t in ROWS]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, "en", "src", 7, 1, "x") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard long, path string").repartition(5)


def rows_of(frame, *columns):
    return collections.Counter(tuple(r) for r in frame.select(*columns).collect())


def test_quality_rules(documents):
    want = collections.Counter()
    for i, t in TEXTS:
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        inside = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
        first, late = set(), set()
        for k in range(len(w) - 4):
            g = tuple(w[k : k + 5])
            if g in first:
                late.update(range(k, k + 5))
            first.add(g)
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(inside), failed, sum(len(w[j]) for j in late)] += 1
    got = quality_rules.repetition(documents)
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "dup_5gram_chars") == want
    assert not got.filter("kept AND base_failed").count()


def test_line_dedup(documents):
    key = lambda x: low(x.strip(" \t\n\v\f\r"))
    found = collections.defaultdict(list)
    for i, t in TEXTS:
        for k in {key(x) for x in t.split("\n") if len(key(x)) >= 40}:
            found[k].append(-(2**63) if i is None else i)
    want = collections.Counter()
    for i, t in TEXTS:
        kept = [x for x in t.split("\n") if len(found[key(x)]) < 5 or max(found[key(x)]) == i]
        want[i, len(t.split("\n")), len(t.split("\n")) - len(kept), sha("\n".join(kept))] += 1
    index = line_dedup.build_index(documents)
    got = documents.select("doc_id", "text").mapInArrow(line_dedup._dedup(index, 40, 5, line_dedup._digest), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    assert rows_of(got, "*") == want
    assert line_dedup.dedup_lines(documents).columns == documents.columns


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64))
    index, slot = perfect_hash.build(keys)
    assert sorted(slot) == list(range(len(keys)))
    assert (perfect_hash.find(index, keys)[0] == slot).all()
    assert len(perfect_hash.build(keys[:0])[1]) == 0


@pytest.mark.parametrize("most", [500_000, 7])
def test_decontamination(spark, documents, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MAX_WINDOWS", most)
    plain = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t or ""))
    items = [(1, ROWS[3][1]), (2, " ".join(WORD.findall(ROWS[45][1])[5:25]).upper()), (3, "one TWO"), (4, ""), (5, None), (6, "not there at all"), (3, "one two"), (7, ROWS[3][1])]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = plain(t)
        for k in range(max(0, len(w) - 9) or bool(w)):
            windows[tuple(w[k : k + 10])].add(i)
    want = collections.Counter()
    for i, t in TEXTS:
        w, hit, named = plain(t), set(), set()
        for n in {len(g) for g in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    named |= windows[tuple(w[k : k + n])]
        want[i, len(w), len(hit), len(named), sha(",".join(sorted(map(str, named)))), bool(hit)] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(decontaminate.report(documents, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    clean = decontaminate.decontaminate(documents, bench)
    assert clean.columns == documents.columns and rows_of(clean, "doc_id") == collections.Counter({(k[0],): 0 for k in ()}) + sum((collections.Counter({(k[0],): v}) for k, v in want.items() if not k[5]), collections.Counter())
    odd = documents.withColumns({f"_{c}": F.lit(1) for c in ("found", "spans", "gaps", "words", "key", "n", "hashes")})
    for remove in ("documents", "spans"):
        assert decontaminate.decontaminate(odd, bench, remove).columns == odd.columns
    assert decontaminate.decontaminate(odd, bench).count() == clean.count() and decontaminate.report(documents.limit(0), bench).count() == 0
    spans = decontaminate.decontaminate(documents, bench, "spans")
    assert spans.count() == len(ROWS) and decontaminate.report(spans, bench).filter("contaminated AND doc_id = 3").count() == 0
    assert decontaminate.report(documents, bench.limit(0)).filter("contaminated").count() == 0


def test_language_model(documents):
    words = [(i, WORD.findall(low(t)) + ["</s>"]) for i, t in TEXTS]
    train = [w for i, w in words if not language_model.is_held_out(i)]
    uni, bi = collections.Counter(x for w in train for x in w), collections.Counter(p for w in train for p in zip(["<s>", *w], w))
    n, v, before = sum(uni.values()), len(uni), collections.Counter(b for _, b in bi)
    count = lambda c: np.array([sum(x == k for x in c) for k in (1, 2, 3, 4)] + [sum(x >= 3 for x in c)])
    n2, n1 = count(bi.values()), count(before.values())
    d2, d1 = language_model.discounts(n2), language_model.discounts(n1)
    rest = d1 @ [n1[0], n1[1], n1[4]] / len(bi)
    ctx = collections.defaultdict(list)
    for (a, _), c in bi.items():
        ctx[a].append(c)
    p1 = lambda w: max(before[w] - [0, *d1][min(before[w], 3)], 0) / len(bi) + rest / (v + 1)

    def p2(a, w):
        if a not in ctx:
            return p1(w)
        left = sum(d2[min(c, 3) - 1] for c in ctx[a])
        return (max(bi[a, w] - [0, *d2][min(bi[a, w], 3)], 0) + left * p1(w)) / sum(ctx[a])

    assert math.isclose(sum(p2("karita", w) for w in uni) + p2("karita", "unseen"), 1)
    got = collections.defaultdict(list)
    for r in language_model.score(documents, language_model.train(documents)).collect():
        got[r.doc_id].append(r)
    for i, w in words:
        base, score = sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p2(a, x)) for a, x in zip(["<s>", *w], w, strict=False))
        r = got[i].pop() if i is not None else got[None][0]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(uni[x] > 0 for x in w), n, i is not None and zlib.crc32(str(i).encode()) % 7 == 2)
        assert math.isclose(r.base_score, base, abs_tol=1e-6) and math.isclose(r.score, score, abs_tol=1e-6)


def test_language_model_of_order_three(spark, documents, tmp_path):
    words = [(i, WORD.findall(low(t)) + ["</s>"]) for i, t in TEXTS]
    train = [w for i, w in words if not language_model.is_held_out(i)]
    triples = lambda w: zip(["<s>", "<s>", *w], ["<s>", *w], w)
    tri = collections.Counter(p for w in train for p in triples(w))
    bi = collections.Counter(p[1:] for p in tri)
    uni = collections.Counter(p[1] for p in bi)
    v = len({x for w in train for x in w})
    count = lambda c: np.array([sum(x == k for x in c) for k in (1, 2, 3, 4)] + [sum(x >= 3 for x in c)])
    d3, d2, d1 = (language_model.discounts(count(c.values())) for c in (tri, bi, uni))
    n1 = count(uni.values())
    after2, after1 = collections.defaultdict(list), collections.defaultdict(list)
    for p, c in tri.items():
        after2[p[:2]].append(c)
    for p, c in bi.items():
        after1[p[0]].append(c)
    p1 = lambda w: max(uni[w] - [0, *d1][min(uni[w], 3)], 0) / len(bi) + d1 @ [n1[0], n1[1], n1[4]] / len(bi) / (v + 1)

    def mixed(c, d, after, lower):
        return (max(c - [0, *d][min(c, 3)], 0) + sum(d[min(x, 3) - 1] for x in after) * lower) / sum(after) if after else lower

    p2 = lambda a, w: mixed(bi[a, w], d2, after1.get(a), p1(w))
    p3 = lambda a, b, w: mixed(tri[a, b, w], d3, after2.get((a, b)), p2(b, w))
    assert math.isclose(sum(p3("<s>", "<s>", w) for w in [*uni, "unseen"]), 1)
    got = collections.defaultdict(list)
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    for r in language_model.op4_lm_scoring(spark, str(tmp_path)).collect():
        got[r.doc_id].append(r)
    for i, w in words:
        r = got[i].pop() if i is not None else got[None][0]
        assert math.isclose(r.score, sum(math.log10(p3(*p)) for p in triples(w)), abs_tol=1e-6)
    none = documents.limit(0)
    assert language_model.score(none, language_model.train(none, order=3)).count() == 0


def test_substring_dedup(documents):
    words = [(i, WORD.findall(t)) for i, t in TEXTS]
    seen = collections.Counter(tuple(w[k : k + 35]) for _, w in words for k in range(len(w) - 34))
    want = collections.Counter()
    for i, w in words:
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        want[i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))] += 1
    assert rows_of(substring_dedup.digest_removal(documents), "*") == want
    kept = substring_dedup.remove_repeats(documents)
    assert kept.columns == documents.columns and kept.count() == len(ROWS)


@pytest.mark.parametrize(("fan", "run"), [(1024, 2_000_000), (5, 100), (1, 7)])
def test_counts_of_hashes(spark, monkeypatch, tmp_path, fan, run):
    from sheaf.llm import counted

    monkeypatch.setattr(counted, "FAN", fan)
    monkeypatch.setattr(counted, "RUN", run)
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**64, 400, dtype=np.uint64)
    met = [rng.choice(values, 60) for _ in range(30)]
    frame = spark.createDataFrame([(k, " ".join(map(str, m.tolist()))) for k, m in enumerate(met)], "doc_id long, text string").repartition(4)
    read = lambda piece: [np.array(t.split(), np.uint64) for t in piece.column("text").to_pylist()]
    counts = counted.count_hashes(frame, read, f"file://{tmp_path}", 64)
    want = collections.Counter(np.concatenate(met).tolist())
    asked = np.sort(np.concatenate([values, rng.integers(0, 2**64, 50, dtype=np.uint64)]))
    assert counts.find(asked).tolist() == [max(1, want[int(x)]) for x in asked]


def test_automaton_gives_matching_statistics():
    rng = random.Random(2)
    passages = [[rng.choice("ab") for _ in range(rng.randrange(1, 30))] for _ in range(6)]
    m = automaton.Matcher(automaton.build(passages))
    inside = {tuple(p[a:b]) for p in passages for a in range(len(p)) for b in range(a + 1, len(p) + 1)}
    text = [rng.choice("abc") for _ in range(200)]
    for end, size in enumerate(m.statistics(text), 1):
        assert size == max((n for n in range(end + 1) if not n or tuple(text[end - n : end]) in inside))


def test_html_extraction(spark):
    page = "<html><head><title>no</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></ul></nav><div class='cookie-notice'>We use cookies.</div><article><h1>Big &amp; small</h1><p>One  two<br>three <b>fo</b>ur.<!-- c --><p>Five.<form><input>Join us now</form></article><aside>Other things</aside><section id='comments'><p>I liked it</p></section><footer>foot</footer>"
    frame = spark.createDataFrame([(1, "u", page, 0), (2, "u", None, 0), (3, None, "", 0), (None, "u", "plain", 0), (1, "u", page, 0)], "page_id long, url string, html string, text long")
    text = "Big & small\nOne two three four.\nFive."
    got = rows_of(html_main.extract_pages(frame), "page_id", "url", "text", "n_chars")
    assert got[1, "u", text, len(text)] == 2 and got[2, "u", "", 0] == 1 and got[3, None, "", 0] == 1 and sum(got.values()) == 5
    assert html_main.main_text("<p>" + "word " * 40 + "<div>a < b > c</div><script>x") .startswith("word word")
    assert html_main.extract_pages(frame.limit(0)).count() == 0


def test_html_extraction_keeps_whole_articles():
    words = "word " * 39 + "word"
    body = f"<h1>A title</h1><p>{words}</p><p>{words} again</p>"
    text = html_main.main_text
    want = f"A title\n{words}\n{words} again"
    assert text(f"<html><head><title>no</title><script>'<p>no'</script><body><article>{body}</article>") == want
    assert text(f"<head><meta charset=utf-8><title>no</title><article>{body}</article>") == want
    assert text(f"<head><title>no</title><style>no</style></head><article>{body}</article>") == want
    assert text(f"<head><title>no</head><article>{body}</article>") == want
    assert text(f"<article><svg class=x/>{body}<svg><text>no</text></svg></article>") == want
    assert text(f"<article><svg><path>{body}</article>") == want
    for wrapper in ("div class='has-sidebar'", "div class='with-header'", "div class=page-header-fixed", "form id=aspnetForm"):
        end = wrapper.split()[0]
        nav = "<nav><a href=x>Home</a></nav>"
        assert text(f"<{wrapper}>{nav}<article>{body}</article><div class=comments><p>I liked it</p></div></{end}>") == want
        assert text(f"<{wrapper}>{nav}<main>{body}</main></{end}>") == want
        assert words in text(f"<{wrapper}>{nav}<div>{body}</div></{end}>")
    comments = f"<section id=comments><article class=comment><p>{words} comment</p></article></section>"
    assert text(f"<article>{body}</article>{comments * 9}") == want


#: Pages that the tree wasn't grown from; +60 stands for 60 words of main text, -3 for three that aren't.
PAGES = [
    "<nav><ul><li><a>-1</a></li><li><a>-1</a></li></ul></nav><div class=ad>-9</div><article><h1>+14</h1><p><b>+80<br><p>+22</p><p>+3</p><p>+17</p><p>+1</p></article><footer>-13</footer>",
    "<body><div class='wrap has-sidebar'><header id=masthead><a>-3</a><nav><a>-1</a><a>-2</a></nav></header><div id=primary><main><article><header class=entry-header><h1>+6</h1></header><p>+55</p><h2>+3</h2><p>+31</p><ol><li>+5<li>+8</ol><p>+64</p></article><section class=comments-area><article><p>-3</p><p>-29</p></article></section></main></div><aside id=secondary><p>-18</p><a>-4</a></aside></div>",
    "<p><a>-1</a> | <a>-2</a> | <a>-1</a></p><h2>+7</h2><p>+47</p><p>+19</p><p>+82</p><p>+35</p><p><a>-2</a> <a>-3</a></p>",
    "<div><a>-1</a> <a>-1</a> <a>-1</a></div><h1>+5</h1><div>+66</div><div>+12</div><div>+104</div><div>+40</div><div>-4 <a>-2</a> <a>-2</a></div>",
    "<div class=topnav><ul><li><a>-1</a><li><a>-1</a></ul></div><div class=article-body><h1>+8</h1><p>+30<a>+2</a>+14</p><div class=advert>-16</div><p>+26</p><blockquote>+19</blockquote><p>+9</p></div><div class=related-posts><ul><li><a>-7</a><li><a>-6</a></ul></div><div id=disqus_thread><p>-25</p></div>",
    "<form id=aspnetForm><div id=nav><a>-1</a><a>-1</a></div><div id=content><h1>+4</h1><p>+75</p><p>+38</p><p>+6</p></div><div id=footer>-9</div></form>",
    "<dialog open><p>-21</p></dialog><main><h1>+3</h1><p>+12</p><p>+5</p><p>+88</p><section class=share-buttons><a>-1</a><a>-1</a></section></main><footer><p>-6</p><ul><li><a>-1</a><li><a>-2</a></ul></footer>",
    "<h1>+6</h1><p>+29</p><p>+51</p><h3>+2</h3><p>+16</p><p>+70</p><ul><li><a>-4</a><li><a>-6</a><li><a>-5</a></ul>",
    "<table><tr><td class=menu><a>-1</a><br><a>-2</a></td><td><h2>+4</h2><p>+45</p><p>+93</p><p>+21</p></td></tr></table><center><a>-1</a> <a>-1</a></center>",
    "<header><a>-2</a></header><article><h1>+10</h1><figure><figcaption>+7</figcaption></figure><p>+42</p><ul><li><a>-5</a><li><a>-8</a></ul><p>+37</p><p>+2</p></article><div class=newsletter-signup><p>-14</p><form><button>-2</button></form></div><footer>-20</footer>",
    "<div class=cookie-notice>-24</div><div role=main><h1>+5</h1><p>+18</p><table><tr><th>+1<th>+2<tr><td>+3<td>+1</table><p>+49</p></div><div role=navigation><a>-2</a><a>-2</a></div>",
    "<ul><li><a>-2</a><li><a>-3</a><li><a>-2</a></ul><p>-3</p><ul><li><a>-4</a><li><a>-2</a></ul>",
    "<main><article><h1>+2</h1><p>+4</p></article></main><footer class=site-footer><p>-30</p></footer>",
    "<section class=story><h1>+12</h1><p>+33</p><p>+58</p><aside><h4>-3</h4><p>-40</p></aside><p>+61</p><footer>-5</footer></section><section id=respond><p>-12</p></section>",
]


def test_html_blocks_of_other_pages():
    kept = left = missed = 0
    for page in PAGES:
        found = html_main.blocks(re.sub(r"([+-])(\d+)", lambda m: " ".join([{"+": "kept", "-": "left"}[m[1]]] * int(m[2])), page))
        said = html_main.tree().predict(html_main.features(found)) >= 0.5
        label = np.array([b.text.startswith("kept") for b in found])
        kept, left, missed = kept + (said & label).sum(), left + (said & ~label).sum(), missed + (~said & label).sum()
    assert 2 * kept / (2 * kept + left + missed) >= 0.95


def test_html_features_against_brute_force():
    page = "<h1>a b</h1><p>one <a>two</a> three</p><ul class=menu><li><a>x y</a><li>z</ul><article><p>" + "w " * 9 + "</article>"
    found = html_main.blocks(page)
    own = [(2, 0.0), (3, 1 / 3), (2, 1.0), (1, 0.0), (9, 0.0)]
    zones = [0, 0, -1, -1, 1]  # a neighbour in another zone counts as none
    at = lambda k, j: own[k + j] if 0 <= k + j < 5 and zones[k + j] == zones[k] else (0, 0.0)
    free = lambda k, j: at(k, j)[0] * (1 - at(k, j)[1])
    want = [[*at(k, 0), *at(k, -1), *at(k, 1), max(free(k, j) for j in (-2, -1, 1, 2)), int(k == 0), zones[k]] for k in range(5)]
    assert np.allclose(html_main.features(found), want) and html_main.features([]).shape == (0, 9)


def test_html_of_odd_markup():
    import time

    text = html_main.main_text
    words = "word " * 39 + "word"
    began = time.time()
    for odd in ("<a ", '<a ">" ', "<noscript>", "<svg>", "<!--", "<div class=ad>", "<p", "</b>", "<b>", "<form><table>", '<a href="', "<a b='>"):
        assert isinstance(text(odd * (200_000 // len(odd)) + f"<p>{words}</p>"), str)
    assert time.time() - began < 20
    assert text(f"<noscript><p>{words}</p>") == words and text(f"a < b <article><p>{words}</article>").endswith(words)
    assert text(f"<article><p title='a>b'>{words}</p><p title=\"it's\">{words}</p></article>") == f"{words}\n{words}"


def labelled(bad, seed, n=160):
    rng = random.Random(seed)
    clean = lambda: [rng.choice(["sun", "moon", "river", "stone", "green"]) + str(rng.randrange(99)) for _ in range(rng.randrange(5, 80))]
    texts, labels = [], []
    for k in range(n):
        w = clean()
        if k % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append(" ".join(w))
        labels.append(int(k % 4 == 0))
    return texts, labels


def test_toxicity_finds_unseen_misspellings():
    model = toxicity.fit(*labelled(["stupid", "stupidity", "idiot", "idiotic"], 1))
    score = lambda texts: toxicity.text_logits(toxicity.bags(pa.array(texts, pa.large_string())), *model)
    texts, labels = labelled(["stupids", "stupidd", "idiots", "idiott"], 2)
    assert ((score(texts) >= 0) == np.array(labels)).mean() > 0.95
    assert np.isfinite(score(["", " ", "x" * 100000])).all() and len(score([])) == 0


def test_classifiers_on_documents(spark, documents):
    value, bias = toxicity.fit([], [])
    assert toxicity.score_toxicity(documents, (value, bias)).filter("score < 0.01").count() == len(ROWS)
    assert toxicity.keep_clean(documents, (value, bias)).columns == documents.columns
    model = quality_classifier.fit(["good text here " * 5, "bad!! TEXT!! " * 5] * 10, [1, 0] * 10)
    got = quality_classifier.score_quality(documents, model)
    assert got.count() == len(ROWS) and got.filter("score BETWEEN 0 AND 1").count() == len(ROWS)
    assert quality_classifier.score_quality(documents.limit(0), model).count() == 0


def test_quality_classifier_held_out():
    rng = random.Random(3)
    text = lambda q: " ".join((rng.choice("abcdefgh") * 3 + str(rng.randrange(99))) if q else (rng.choice("ABCDEFGH") * 3 + "!!") for _ in range(40))
    labels = [k % 2 for k in range(80)]
    model = quality_classifier.fit([text(q) for q in labels], labels)
    assert ((quality_classifier.margins(pa.array([text(q) for q in labels], pa.large_string()), model) >= 0) == np.array(labels)).all()


def test_byte_bpe(documents, monkeypatch):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.codec(path).ranks, special_tokens={})
    want = collections.Counter()
    for i, t in TEXTS:
        ids = own.encode_ordinary(t)
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(t)] += 1
    assert rows_of(bpe.digest_tokens(documents), "*") == want
    odd = ["a  b", "a   b", "\n \n x", "it's  'll\n'd", " x ", "ab" * 700, "é" * 300, "<|endoftext|>", "\x00\x1f", "🎉🎉 z"]
    assert [bpe.codec(path).encode(t) for t in odd] == [own.encode_ordinary(t) for t in odd]
    assert [x[0] for x in bpe._many(odd, path, P.PATTERN)] == [" ".join(map(str, own.encode_ordinary(t))) for t in odd]
    rng = random.Random(4)
    long = ["".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (300, 5000, 100_000)]
    assert bpe.codec(path).encode_pieces([t.encode() for t in long]) == [tuple(own.encode_ordinary(t)) for t in long]
    monkeypatch.setattr(bpe, "FEW", 0)
    assert [bpe.codec(path).encode(t) for t in [*odd, long[0]]] == [own.encode_ordinary(t) for t in [*odd, long[0]]]
    both = bpe.decode_column(bpe.encode_column(documents))
    assert both.filter("coalesce(text, '') <> decoded").count() == 0


def test_ngram_jaccard(documents):
    sets = []
    for i, t in TEXTS:
        w = WORD.findall(low(t))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[find(k)].append(i)
    ids = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    want = collections.Counter((i, len(x), ids[find(k)]) for k, (i, x) in enumerate(sets))
    assert rows_of(jaccard_join.jaccard_components(documents), "doc_id", "n_shingles", "component_id") == want
    kept = jaccard_join.keep_one(documents)
    left = collections.Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert kept.columns == documents.columns and left[300] == 1 and not left[301] and left[500] == left[501] == left[502] == 1


def test_overlaps(monkeypatch):
    monkeypatch.setattr(jaccard_join, "HASHES", 40)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 7)
    rng = np.random.default_rng(3)
    sets = [[np.unique(rng.integers(0, 60, rng.integers(0, 30))).astype(np.uint64) for _ in range(n)] for n in (9, 13)]
    want = [[len(np.intersect1d(x, y)) for y in sets[1]] for x in sets[0]]
    assert (jaccard_join.overlaps(*sets) == np.array(want)).all()


def test_keep_one_of_each_group(spark):
    words = " ".join(f"w{k}" for k in range(60))
    near, other = words.replace("w30 ", "x "), " ".join(f"v{k}" for k in range(40))
    rows = [(5, words), (3, near), (3, near), (None, words), (9, words), (3, words), (None, other), (None, other + " end"), (None, other), (7, ""), (7, ""), (8, None), (1, "alone " + " ".join(f"u{k}" for k in range(9)))]
    frame = spark.createDataFrame([(*r, 1, 2, "c") for r in rows], "doc_id long, text string, _key long, fate long, part string").repartition(3)
    kept = jaccard_join.keep_one(frame)
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    assert kept.columns == frame.columns
    assert sum(v for (i, t), v in got.items() if t in (words, near)) == 1 and got[3, words] + got[3, near] == 1
    assert sum(v for (i, t), v in got.items() if (t or "").startswith("v0")) == 1 and got[7, ""] == 2 and got[8, None] == 1 and got[1, rows[-1][1]] == 1
    assert jaccard_join.keep_one(frame.limit(0)).count() == 0


@pytest.mark.parametrize(("members", "block"), [(2, 8), (64, 256), (1, 1)])
def test_long_lists_of_near_copies(spark, monkeypatch, members, block):
    """Pairs of blocks against brute force, with groups and lists cut into small ones."""
    monkeypatch.setattr(jaccard_join, "MEMBERS", members)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for k in range(120):
        w = list(base)
        for _ in range(rng.randrange(0, 8)):
            w[rng.randrange(90)] = f"e{rng.randrange(40)}"
        rows.append((k, " ".join(w[rng.randrange(3) : 90 - rng.randrange(6)])))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    root = list(range(120))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(120):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: find(k) for k in range(120)}


def test_empty_tables(spark, documents):
    none = documents.limit(0)
    assert quality_rules.repetition(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert jaccard_join.jaccard_components(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert language_model.score(none, language_model.train(none)).count() == 0
    assert bpe.digest_tokens(none).count() == 0


def test_hashes_depend_on_all_bytes():
    data = np.frombuffer(b"abcdefgh abcdefgi abcdefgh " + b"x" * 300 + b" " + b"x" * 299 + b"y", np.uint8)
    h = hash_spans(data, np.array([0, 9, 18, 27, 328]), np.array([8, 17, 26, 327, 628]))
    assert h[0] == h[2] != h[1] and h[3] != h[4]
