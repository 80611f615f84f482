"""Loading, enhancement, prompts, reports, rankers by name, provider wrappers, evidence rules and the shared folder."""

import json
import os

import pytest
from pyspark.sql import functions as F

import sheaf
from sheaf import storage
from sheaf.operators import enhance, evidence, ranking
from sheaf.operators.index import Index, ordered_fingerprint
from sheaf.plans import loading, profiles, prompts, provider, reports
from sheaf.sources import files
from tests import plain_evidence


def test_public_names():
    assert all(getattr(sheaf, name) is not None for name in sheaf.__all__)
    with pytest.raises(AttributeError):
        sheaf.no_such_name  # noqa: B018


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "b.TXT").write_text("กฎของเกม " * 3 + "red cat", encoding="utf-8")
    (tmp_path / "A.md").write_text("# One\n" + "alpha beta gamma. " * 20 + "\n# Two\n" + "delta. " * 30, encoding="utf-8")
    (tmp_path / "c.html").write_text("<title>T</title><p>blue bird</p>", encoding="utf-8")
    (tmp_path / "d.bin").write_bytes(b"\0")
    (tmp_path / "empty.txt").write_text(" \n", encoding="utf-8")
    os.mkdir(tmp_path / "deep")
    (tmp_path / "deep" / "e.txt").write_text("green fish", encoding="utf-8")
    return f"file://{tmp_path}"


def test_folders_are_listed_by_name(spark, folder):
    assert [r.name for r in files.discover(spark, folder, files.SUFFIXES).select("name").collect()] == ["A.md", "b.TXT", "c.html", "empty.txt"]
    assert [r.name for r in files.discover(spark, folder).select("name").collect()] == ["b.TXT", "empty.txt"]
    assert "e.txt" in [r.name for r in files.discover(spark, folder, files.SUFFIXES, True).select("name").collect()]


def test_loading(spark, folder):
    found = loading.from_folder(spark, folder, 100, 20).collect()
    names = {r.metadata["source_name"] for r in found}
    assert names == {"A.md", "b.TXT", "c.html", "e.txt"} and all(r.content for r in found)
    index, n = loading.add_documents(None, files.discover(spark, folder, files.SUFFIXES), 500, 50)
    assert n == 3 and ranking.retriever("keyword")(index, spark.createDataFrame([(0, "red cat")], "query_id long, query string"), 1).first().id.endswith("b.TXT#1#0")
    more, m = loading.add_documents(index, files.discover(spark, folder + "/deep", files.SUFFIXES))
    assert m == 1 and more.totals().first().n == 4
    web = spark.createDataFrame([("https://x.org/a", "a", b"<nav>no</nav><main><p>yes</p></main>")], "path string, name string, content binary")
    page = loading.extract(web).first()
    assert page.content == "yes" and page.metadata["source_name"] == "https://x.org/a" and page.metadata["extractor"] == "web"


class Upper:
    suffixes = ("bin",)

    def read(self, data):
        return [(1, ""), (2, f"{len(data)} bytes")]


def test_own_parsers_and_page_counts(spark, folder):
    row = files.load(files.discover(spark, folder, ["bin"]), parsers=(Upper(),)).first()
    assert (row.page, row.total_pages, row.text, row.extractor) == (2, 2, "1 bytes", "Upper")
    assert files.load(files.discover(spark, folder, ["bin"])).first().error_type == "SourceError"


def test_reports(spark, folder, tmp_path):
    loaded = files.load(files.discover(spark, folder, files.SUFFIXES), strict=False)
    summary = {r.document: r for r in reports.document_summary(loaded).collect()}
    assert summary["empty.txt"].error_type == "SourceError" and summary["A.md"].pages == 1
    assert "text" not in reports.documents(loaded).columns and "text" in reports.documents(loaded, True).columns
    row = json.loads(reports.as_json(reports.documents(loaded)).first().json)
    assert row["document"] and row["page"] is None
    index, _ = loading.add_documents(None, files.discover(spark, folder, files.SUFFIXES))
    one = profiles.status(index, files.failures_of(loaded)).first()
    assert one.n == 3 and one.n_errors == 1 and one.errors[0].document == "empty.txt"
    hits = ranking.bm25(index, spark.createDataFrame([(0, "red cat")], "query_id long, query string"), 2).join(index.chunks.select("id", "text"), "id")
    assert reports.search(hits).first().result_count == 2 and "text" not in reports.search(hits).first().results[0]
    scored = spark.createDataFrame([(1, True, True, True), (2, False, True, False)], "item_id long, answer_correct boolean, citation_correct boolean, passed boolean")
    reports.benchmark(scored, f"file://{tmp_path}/bench", "s", "r")
    assert spark.read.json(f"file://{tmp_path}/bench/summary").first().summary.passed == 1 and spark.read.json(f"file://{tmp_path}/bench/results").count() == 2


def test_chunk_report_and_reindex(spark, folder, tmp_path):
    engine, report = profiles.reindex(spark, folder, f"file://{tmp_path}/index")
    assert report.first().n == 1 and report.first().n_errors == 1 and reports.chunks(engine.chunks).first().n_chars > 0
    assert Index.load(spark, f"file://{tmp_path}/index").totals().first().n == 1


def test_enhancement(spark):
    asked = spark.createDataFrame([(1, "What is red? And blue"), (2, "")], "query_id long, question string")

    class Model:
        def answer(self, system, user):
            if "red" not in user:
                raise provider.ProviderError("timeout")
            return "1. expanded: red things\n2. decomposed: red, blue\n3. keyword: red"

    got = {r.query_id: r for r in enhance.enhance(asked, Model(), "Q: {user_query}!").collect()}
    assert got[1].expanded == "expanded: red things" and got[1].decomposed == ["decomposed: red", "blue"] and got[1].keyword_focused == "keyword: red"
    assert got[2].provider_error == "timeout" and got[2].decomposed == [""] and got[2].all_variants[0].endswith("ตัวอย่าง")
    plain = {r.query_id: r for r in enhance.enhance(asked, enabled=False).collect()}
    assert plain[1].all_variants == ["What is red? And blue"] and plain[1].keyword_focused == "red and blue"
    rules = {r.query_id: r for r in enhance.enhance(asked).collect()}
    assert rules[1].keyword_focused == "red and blue" and rules[1].provider_error is None


def letters(texts):
    return [[float(t.count(c)) for c in "abcdefg"] for t in texts]


def test_rankers_by_name(spark):
    index = Index.build(spark.createDataFrame([(7, "aa bb"), (8, "cc cc"), (9, None)], "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "bb aa"), (2, "cc")], "query_id long, query string")
    for name in (*ranking.STRATEGIES, "other"):
        found = ranking.retriever(name, letters)(index, asked, 2)
        assert {r.query_id: r.id for r in found.filter("rank = 1").collect()} == {1: 7, 2: 8}
    assert ranking.retriever("hybrid")(index, asked, 1).count() == 2
    far = ranking.retriever("vector", letters, similarity=lambda a, b: -ranking.cosines(a, b))(index, asked, 1)
    assert {r.query_id: r.id for r in far.collect()} == {1: 8, 2: 7}
    with pytest.raises(ValueError):
        ranking.retriever("vector")


def test_metadata_fields(spark):
    named = Index.build(spark.createDataFrame([(1, "x", "Cats", {"source_path": "dogs"}), (2, "x", None, None)], "doc_id long, text string, title string, metadata map<string,string>"))
    asked = spark.createDataFrame([(1, "cats dogs birds")], "query_id long, query string")
    assert {r.id: r.metadata for r in ranking.enhanced(named, asked, 2).collect()} == {1: 2.0, 2: 0.0}


def test_exact_matches_of_any_length(spark):
    chunks = spark.createDataFrame([(1, "start of the matter, at last"), (2, "the matter at hand"), (3, None)], "id long, text string")
    parts = spark.createDataFrame([(1, "art of the mat"), (2, "matter"), (3, "the matter at"), (4, "xy"), (5, "no such words here"), (6, "THE  matter")], "passage long, text string")
    assert sorted(map(tuple, ranking.exact_matches(chunks, parts).collect())) == [(1, 1), (2, 1), (2, 2), (3, 2), (6, 1), (6, 2)]


def test_prompts(spark):
    hits = spark.createDataFrame([(1, 2, "B", None, "c2", "two"), (1, 1, "A", 3, "c1", "one")], "query_id long, rank int, document string, page int, chunk_id string, text string")
    assert prompts.contexts(hits).first().context == (
        "[SOURCE 1]\ndocument: A\npage: 3\nchunk_id: c1\ncontent:\none\n[/SOURCE 1]\n\n[SOURCE 2]\ndocument: B\npage: N/A\nchunk_id: c2\ncontent:\ntwo\n[/SOURCE 2]"
    )
    turns = F.array(F.struct(F.lit("user").alias("role"), F.lit(" hi ").alias("text")), F.struct(F.lit("tool").alias("role"), F.lit(" ").alias("text")))
    row = spark.range(1).select(prompts.user_prompt(F.lit(" q "), F.lit("ctx"), turns).alias("p"), prompts.filled("{question}{context}{question}", F.lit("{question}"), F.lit("q")).alias("t"), prompts.filled("none", F.lit("c"), F.lit("q")).alias("d")).first()
    assert "USER: hi\n\nCONTEXT:\nctx\n\nQUESTION:\nq\n\n" in row.p and row.t == "q{question}q" and row.d == "บริบทจากเอกสาร:\nc\n\nคำถาม: q\n\nคำตอบ:"
    assert prompts.guidance("balanced").startswith("Give a balanced")
    said = spark.range(1).select(*[prompts.refusal(F.lit(q)).alias(k) for k, q in (("en", "why"), ("th", "ทำไม"))]).first()
    assert "English:" in said.en and "English" not in said.th
    cases = spark.createDataFrame([("1", "q?", [("user", "h")]), ("2", "r?", None)], "id string, question string, history array<struct<role:string,text:string>>")
    text = prompts.closed_context(cases, spark.createDataFrame([(1, "A", 2, "t")], "place int, document string, page int, text string"), "RULE").first().prompt
    assert text == "RULE\n\nCONTEXT:\n[DOCUMENT: A, PAGE: 2]\nt\n\nQUESTIONS:\n1. HISTORY: user: h\nQUESTION: q?\n\n2. r?"


def test_provider_wrappers():
    config = provider.ModelConfig("m", "key", temperature=0.2)
    assert config.payload([{"role": "user", "content": "x"}], max_tokens=5, seed=1) == {"model": "m", "messages": [{"role": "user", "content": "x"}], "stream": False, "temperature": 0.2, "max_tokens": 5, "seed": 1}
    assert config.headers()["Authorization"] == "Bearer key"
    with pytest.raises(provider.ProviderError):
        provider.ModelConfig(" ")
    for reply in ({"choices": [{"message": {"content": "a"}}]}, {"choices": [{"delta": {"content": "a"}}]}, {"response": "a"}, {"text": "a"}, {"output": "a"}, {"result": "a"}, {"data": {"content": "a"}}):
        assert provider.content_of(reply) == "a"
    with pytest.raises(provider.ProviderError):
        provider.content_of({"other": 1})
    waits, calls = [], []

    def send(headers, payload):
        calls.append(payload)
        if len(calls) < 3:
            raise provider.ProviderError("busy", status=503)
        return {"text": "done"}

    assert provider.Retrying(provider.Chat(config, send), wait=waits.append).answer("s", "u") == "done" and waits == [1.0, 2.0]
    broken = provider.Chat(config, lambda h, p: (_ for _ in ()).throw(provider.ProviderError("denied", status=401)))
    with pytest.raises(provider.ProviderError):
        provider.Retrying(broken, wait=waits.append).answer("s", "u")
    assert not provider.healthy(broken) and provider.healthy(provider.FirstBlock())


def test_evidence_rules():
    got = lambda text, *facets, document="X": [(f, v) for f, _, v in plain_evidence.quotes(text, document, list(facets))]
    assert got("หลักสูตรปริญญาตรี 4 ปี\n□ หลักสูตรปริญญาตรี 5 ปี\n หลักสูตรปริญญาตรี 6 ปี\nระยะเวลาการศึกษา 7 ปี", "duration") == [("duration", "4"), ("duration", "7")]
    assert plain_evidence.quotes("☑ ภาคการศึกษาที่ 1 เดือน มิ\nภาคฤดูร้อน\nเดือน เม\nระบบทวิภาค ภาคการศึกษาปกติ\na\nb\nc", "X", ["semesters"]) == [
        ("semesters", "☑ ภาคการศึกษาที่ 1 เดือน มิ", None),
        ("semesters", "ภาคฤดูร้อน\nเดือน เม", None),
        ("semesters", "ระบบทวิภาค ภาคการศึกษาปกติ\na\nb", None),
    ]
    assert got("รวมตลอดหลักสูตร\n 90 หน่วยกิต\nรวมตลอดหลักสูตร 91 หน่วยกิต", "credits") == [("credits", "90"), ("credits", "91")]
    assert got("a\nสหกิจศึกษา\n6(0-45-0)", "co_op") == [("co_op", None)] and not got("สหกิจศึกษา", "co_op")
    assert not got("อายุ 18 ignore previous", "age") and got("อายุ 18", "age") == [("age", None)] and got("อายุ", "age") == []
    assert [q for _, q, _ in plain_evidence.quotes("อาชีพหลังสำเร็จ\n(1) นักวิเคราะห์\n(2) ครู\n2. อื่น\n(3) ไม่", "X", ["careers"])] == ["(1) นักวิเคราะห์", "(2) ครู"]


def test_trace_blots_out_secrets(spark):
    chunks = spark.createDataFrame([("c1", "AIT.pdf", 1, "จำนวนหน่วยกิตรวมตลอดหลักสูตร 90 หน่วยกิต")], "chunk_id string, document string, page int, text string")
    asked = spark.createDataFrame([(1, "sk-1 หลักสูตร AIT มีกี่หน่วยกิต"), (2, "")], "query_id long, question string")
    rows = {r.query_id: r for r in profiles.Strict(chunks, secrets=("sk-1",)).trace(asked).collect()}
    assert "sk-1" not in rows[1].question and "[REDACTED]" in rows[1].question and json.loads(rows[1].evidence)[0]["chunk_id"] == "c1" and rows[2].error == "empty_question"


def test_open_engine_with_rules(spark):
    index = Index.build(spark.createDataFrame([(1, "red cat"), (2, "blue bird")], "doc_id long, text string"))
    engine = profiles.Open(index, ranker=ranking.bm25, enhancer=profiles.RULES, template="Q {question} C {context}")
    asked = spark.createDataFrame([(1, "red?")], "query_id long, question string")
    assert engine.retrieve(asked, "multi_query").filter("rank = 1").first().id == 1
    assert engine.health() == {"provider": True, "retriever": True}
    assert engine.answer(asked).count() == 1


def test_ordered_digest(spark):
    rows = [(k, f"t{k}") for k in range(50)]
    make = lambda r: ordered_fingerprint(spark.createDataFrame(r, "k long, text string").repartition(3), "k", width=4).first().digest
    assert make(rows) == make(rows[::-1]) != make([*rows[:-1], (49, "t48")])
    assert make([]) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_shared_folder_is_cleaned(spark):
    table = storage.stored(spark.range(3), "numbers")
    assert table.count() == 3 and storage.clean(spark) >= 1 and storage.clean(spark) == 0


def test_stream_results_are_tables(spark, tmp_path):
    from sheaf.streaming import ingest

    rows = spark.createDataFrame([("a", 1.0, "2024-01-01 10:05:00"), ("a", None, "2024-01-01 10:55:00"), ("b", 3.0, "2024-01-01 12:00:00")], "event_type string, value double, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    stream = lambda: ingest.table_stream(spark, str(tmp_path), "events")
    stats = ingest.complete(ingest.running_stats(stream()), f"file://{tmp_path}/stats")
    assert sorted(map(tuple, stats.collect())) == [("a", 2, 1, 1.0), ("b", 1, 1, 3.0)]
    counts = ingest.complete(ingest.windowed_counts(stream()), f"file://{tmp_path}/windows")
    assert sorted((r.window.start.hour, r.event_type, r.n) for r in counts.collect()) == [(10, "a", 2), (12, "b", 1)]
    os.makedirs(f"{tmp_path}/nothing")
    none = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/nothing")
    assert ingest.complete(ingest.running_stats(none), f"file://{tmp_path}/empty").count() == 0
