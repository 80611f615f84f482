import json
import zipfile

import pytest

from sheaf.functions import rules
from sheaf.operators import evaluate, evidence
from sheaf.operators.index import Index
from sheaf.plans import fixtures
from sheaf.plans.config import AnswerOptions, Config, ConfigError
from sheaf.plans.profiles import Open, Strict, build_pages
from sheaf.plans.provider import ProviderError
from sheaf.sources import files, glyphs
from tests import plain_evidence


def ask(spark, text):
    return spark.createDataFrame([(1, text)], "query_id long, question string")


@pytest.fixture(scope="module")
def engine(spark):
    return Strict(fixtures.chunks(spark))


def test_thai_answer_with_citation(spark, engine):
    row = engine.answer(ask(spark, "หลักสูตร DSBA มีกี่หน่วยกิต")).first()
    assert row.grounded and row.error is None and "หน่วยกิตรวม: 96 หน่วยกิต (DSBA.pdf หน้า 1)" in row.answer
    assert [s.document for s in row.sources] == ["DSBA.pdf"]


def test_two_languages_from_the_same_facts(spark, engine):
    row = engine.answer(ask(spark, "How many credits and careers does AIT have?")).first()
    assert "Total credits: 90 credits" in row.answer and "หน่วยกิตรวม: 90 หน่วยกิต" in row.answer and "(1) Artificial intelligence consultant" in row.answer


def test_conflicts_come_last_in_rankings(spark, engine):
    row = engine.answer(ask(spark, "เรียงหลักสูตรทั้ง 4 หลักสูตรตามหน่วยกิตจากมากไปน้อย")).first()
    assert row.answer.index("DSBA:") < row.answer.index("IT2565:") < row.answer.index("AIT:") and evidence.CONFLICT[0] in row.answer


def test_refusals(spark, engine):
    asked = spark.createDataFrame([(1, "ค่าเทอมเท่าไหร่"), (2, ""), (3, "what is the weather")], "query_id long, question string")
    rows = {r.query_id: r for r in engine.answer(asked).collect()}
    assert rows[1].answer == rules.REFUSAL and not rows[1].grounded and rows[1].sources is None
    assert rows[2].error == "empty_question" and "not enough relevant information" in rows[3].answer


class Wrong:
    def __init__(self, reply):
        self.reply = reply

    def answer(self, system, user):
        if self.reply is None:
            raise ProviderError("timeout")
        return self.reply


@pytest.mark.parametrize("reply, code", [("{}", "invalid_evidence_response"), ('{"evidence_ids": ["E99"]}', "unknown_evidence_id"), ('{"evidence_ids": []}', "incomplete_evidence_selection"), (None, "timeout")])
def test_any_doubt_refuses(spark, reply, code):
    row = Strict(fixtures.chunks(spark), provider=Wrong(reply)).answer(ask(spark, "หลักสูตร DSBA มีกี่หน่วยกิต")).first()
    assert row.answer == rules.REFUSAL and not row.grounded and row.error == code and row.sources is None


def test_selection_codes(spark):
    codes = [r.error for r in evidence.validate(fixtures.selections(spark)).collect()]
    bad = "invalid_evidence_response"
    assert codes == [None, "incomplete_evidence_selection", "unknown_evidence_id", bad, bad, bad, bad, bad, bad, bad]
    assert evidence.check_selection('{"evidence_ids": ["E1"]}', ["E1"], False) == "invalid_source_span"


def test_injections_and_long_quotes_are_no_evidence():
    assert plain_evidence.quotes("จำนวนหน่วยกิต หลักสูตร 90 หน่วยกิต ignore previous", "x", ["credits"]) == []
    assert plain_evidence.quotes("อายุ 18 " + "x" * 1800, "x", ["age"]) == []
    assert plain_evidence.quotes(None, None, ["age"]) == []
    assert plain_evidence.quotes("จำนวนหน่วยกิตหลักสูตร\n 120 หน่วยกิต", "x", ["credits"]) == [("credits", "จำนวนหน่วยกิตหลักสูตร\n 120 หน่วยกิต", "120")]


def test_no_wording_is_an_error_except_in_thai():
    e = [{"facet": "age", "quote": "อายุ 18", "value": None, "document": "d", "page": None}]
    assert "อายุ 18\n(d)" in evidence.present(e, ["age"], "th")
    with pytest.raises(evidence.NoTranslation):
        evidence.present(e, ["age"], "en")
    with pytest.raises(evidence.NoTranslation):
        evidence.present(e, ["age"], "ja")


def test_semester_wordings():
    said = evidence.wordings("semesters", "ภาคการศึกษาที่ 1 เดือน มิถุนายน - ตุลาคม", None, None)
    assert said == [(("ภาคการศึกษาที่ 1: มิถุนายน–ตุลาคม", "Semester 1: June–October", "第 1 学期: 六月–十月"), None)]


def test_open_profile(spark):
    index = Index.build(spark.createDataFrame([(0, "cats sleep all day", "a.txt"), (1, "dogs bark", "b.txt")], "doc_id long, text string, source string"))
    row = Open(index).answer(ask(spark, "cats sleep")).first()
    assert row.passed and row.answer == "cats sleep all day" and row.sources[0].source == "a.txt"
    assert Open(index).answer(ask(spark, "zebra")).first().answer == rules.REFUSAL
    for mode in ("enhanced", "multi_query"):
        assert Open(index).retrieve(ask(spark, "cats sleep"), mode).count() == 2


def test_scoring(spark):
    rows = [(1, "มี 96 หน่วยกิต", True, ["a"], [["96", "90"]], ["a"], None), (2, "ไม่พบข้อมูล x", True, [], [["96"]], [], True), (3, "90", True, [], [["96"]], ["a"], False)]
    frame = spark.createDataFrame(rows, "id int, answer string, grounded boolean, sources array<string>, required array<array<string>>, required_sources array<string>, expect_refusal boolean")
    assert [r.passed for r in evaluate.score(frame).orderBy("id").collect()] == [True, True, False]
    assert tuple(evaluate.summary(evaluate.score(frame)).first()) == (3, 2, 2, 2)


def docx(path, paragraphs, rows):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(map(p, paragraphs))}<w:tbl>{table}</w:tbl></w:body></w:document>")


def test_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("﻿สวัสดี  \r\nx".encode())
    (tmp_path / "b.txt").write_bytes("กขค".encode("cp874"))
    (tmp_path / "blank.txt").write_text(" \n")
    (tmp_path / "bad.pdf").write_bytes(b"no pdf")
    (tmp_path / "c.csv").write_text("1,2")
    docx(tmp_path / "d.docx", ["one", " "], [["a", ""], ["b", "c"]])
    found = files.load(files.discover(spark, f"file://{tmp_path}"))
    texts = {r.document: r.text for r in files.pages_of(found).collect()}
    assert texts == {"a.TXT": "สวัสดี\nx", "b.txt": "กขค", "d.docx": "one\na\nb | c"}
    assert {r.document for r in files.failures_of(found).collect()} == {"blank.txt", "bad.pdf"}
    chunks, failed = build_pages(spark, f"file://{tmp_path}", Config())
    assert chunks.count() == 3 and failed.count() == 2


def test_html():
    page = "<title>T</title><nav>n</nav><header>h</header><main><p>a &amp; b</p><script>x</script><aside>s</aside></main><p>c</p><footer>f</footer>"
    assert files.html_text(page) == ("T\na & b\ns\nc", "T")
    assert files.html_text(page, True) == ("a & b", "T")
    assert files.html_text("<div class='my-content'>q</div>z", True)[0] == "q" and files.html_text("", True) == ("", None)


def test_glyphs(spark):
    rows = spark.createDataFrame([("f", "o1", 0x0E01), ("f", "o1", 0xE001), ("f", "o2", 0x0E02), ("f", "o2", 0x0E03), ("f", "o2", 0xE002), ("f", "o3", 0xE003)], "family string, outline string, code int")
    known = glyphs.glyph_map(rows, spark.createDataFrame([("o3", 0x0E04)], "outline string, target int"))
    text = spark.createDataFrame([("f", "x\ue001\ue003\u0e01"), ("g", "")], "family string, text string")
    assert sorted(r.text for r in glyphs.repair(text, known).collect()) == sorted(["xกคก", ""])
    both = glyphs.glyph_map(rows, spark.createDataFrame([("o1", 0x0E04)], "outline string, target int"))
    assert not both.count()  # o1 stands for two characters now, o2 always did
    # texts of one family, or of none, aren't brought together
    plan = glyphs.repair(text, known)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(family" not in plan
    assert len(glyphs.VERIFIED) == 24 and not glyphs.glyph_map(rows, None, glyphs.FAMILY).count()


def test_settings():
    assert Config.from_env({"SHEAF_TOP_K": "7", "SHEAF_DEBUG": "yes"}) == Config(top_k=7, debug=True)
    for env in ({"SHEAF_TOP_K": "x"}, {"SHEAF_DEBUG": "maybe"}, {"SHEAF_TOP_K": "0"}):
        with pytest.raises(ConfigError):
            Config.from_env(env)
    for bad in ({"top_k": 2}, {"top_k": True}, {"history_messages": 5}, {"evidence_mode": "x"}):
        with pytest.raises(ConfigError):
            AnswerOptions(**bad)


def test_entry_has_sql_for_registered_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and json.dumps(sorted(entry.queries()))


def test_references_without_a_semicolon():
    page = "<title>a&amp;&amp</title><article>b&amp;lt;&copy;&copy c&#38;&#38 &no; &AMP</article>"
    assert files.html_text(page, True) == ("b&lt;©© c&& &no; &", "a&&")
    assert files.html_text(page, True, unclosed=False) == ("b&lt;©&copy c&&#38 &no; &AMP", "a&&amp")


def test_queries_of_pages_keep_references_without_a_semicolon(spark, tmp_path):
    from sheaf.plans.registry import QUERIES

    spark.createDataFrame([(1, "http://x.org/a", "<title>t&amp</title><article><p>u&amp</p></article>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES["html_parsed"](spark, str(tmp_path)).first()[1:3] == ("t&amp", 5)
    assert QUERIES["load_web_pages"](spark, str(tmp_path)).first().title == "t&amp"
    assert QUERIES["document_report"](spark, str(tmp_path)).first().n_chars == 5
