import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.operators import chunking as C


@given(st.text(alphabet="ab .\nก", max_size=300), st.integers(1, 40), st.integers(0, 39))
@settings(max_examples=200, deadline=None)
def test_char_chunks_cover_all_but_white_space(text, size, overlap):
    if overlap >= size:
        return
    spans = list(C.CharChunks(size, overlap).spans(text))
    seen = set()
    for (a, b), last in zip(spans, [(-1, -1), *spans], strict=False):
        assert 0 < b - a <= size and a >= last[0] and not text[a].isspace() and not text[b - 1].isspace()
        assert last[1] - a <= overlap
        seen.update(range(a, b))
    assert all(k in seen for k, c in enumerate(text) if not c.isspace())


def test_chunk_ends_at_a_sentence_then_at_white_space_then_hard():
    assert list(C.CharChunks(10, 0).spans("abcdef. ghi jkl")) == [(0, 7), (8, 15)]
    assert list(C.CharChunks(10, 0).spans("abcdefg hij kl mn")) == [(0, 7), (8, 17)]
    assert list(C.CharChunks(20, 0).spans("x" * 55)) == [(0, 20), (20, 40), (40, 55)]


@pytest.mark.parametrize("pair", [(0, 0), (10, -1), (10, 10), (5, 9)])
def test_invalid_sizes(pair):
    with pytest.raises(ValueError):
        C.CharChunks(*pair)
    with pytest.raises(ValueError):
        C.TokenChunks(*pair)


def test_page_chunk_ids(spark):
    pages = spark.createDataFrame([("My doc.pdf", 3, 1, "abc"), ("t.txt", None, 1, "x y"), ("u.txt", None, 1, "a"), ("u.txt", None, 2, "b"), ("v.txt", None, 1, "  ")], "document string, page int, source_unit int, text string")
    assert sorted(r.chunk_id for r in C.page_chunks(pages).collect()) == ["My_doc_p3_c01", "t_pna_c01", "u_pna_u01_c01", "u_pna_u02_c01"]


def test_sections_keep_headings_and_preamble():
    text = "before it.\n# One\n" + "word. " * 30 + "\n## Two\n" + "other. " * 30
    found = C.TokenChunks(20, 5, 1).chunks(text)
    heads = [(c[2], c[3]) for c in found if c[2]]
    assert heads == [("# One", 1), ("## Two", 2)] and found[0][4] == "before it."
    assert C.TokenChunks(20, 5, 1, legacy=True).chunks(text)[0][2] == "# One"


def test_heading_levels():
    cases = {"### a": 3, "Title\n=====": 1, "Title\n-----": 2, "1. a": 2, "● a": 3, "ก. x": 2, "บทที่ 1": 2, "plain": 3}
    assert {h: C.heading_level(h) for h in cases} == cases


def test_sentences_merge_short_ones():
    assert C.split_sentences("ab ฯ c. This is long enough! Yes") == ["ab ฯ c.", "This is long enough!", "Yes"]
    assert C.split_sentences("   ") == ["   "]


def test_token_windows_and_join():
    assert C.join_tokens(["ab", "cd", "กข", "ef", "1"]) == "ab cdกขef 1"
    assert [c[1] for c in C.TokenChunks(4, 1, 1, "tokens").chunks(" ".join("abcdefghij"))] == [4, 4, 4, 1]


def test_sql_table_functions(spark):
    C.register(spark)
    assert spark.sql("SELECT c.chunk FROM VALUES ('ab cd. ef') AS t(x), LATERAL char_chunks(x, 7, 0) c").count() == 2
