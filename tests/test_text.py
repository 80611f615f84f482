from pyspark.sql import functions as F

from sheaf.functions import text as T
from sheaf.operators import query as Q


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_strict_tokens_of_thai_and_latin(spark):
    row = one(spark, "The AIT กขค 2565", T.strict_tokens(T.normalize(F.col("t"))))
    assert row[0] == ["ait", "กขค", "กข", "ขค", "กขค", "2565"]


def test_open_tokens_drop_single_characters(spark):
    row = one(spark, "A cat กข 7", T.tokens(F.col("t")), T.cased_tokens(F.col("t")))
    assert row[0] == ["cat", "กข"] and row[1] == ["A", "cat", "กข", "7"]


def test_normalize_keeps_sara_am_and_folds_sharp_s():
    assert T.normalize_text(" คำ\n Straße ") == "คำ strasse"


def test_null_and_empty(spark):
    row = spark.createDataFrame([(None,)], "t string").select(T.tokens(F.col("t")), T.strict_tokens(T.normalize(F.col("t"))), T.ngrams(F.lit("a"), 2)).first()
    assert list(row) == [[], [], []]


def test_detect_language(spark):
    cases = {"かな": "ja", "한글": "ko", "汉字": "zh", "ไทย abc": "th", "abc": "en", "123": "th"}
    frame = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert all(r[0] == r[1] for r in frame.select(T.detect_language(F.col("t")), "want").collect())


def test_signals(spark):
    s = T.signals(F.col("t"))
    row = one(spark, 'Who is "Ann Lee" on 12/05/2023 at 10:30 with 3.5 or สองร้อย?', *[s[k] for k in ("phrases", "dates", "names", "thai_numbers", "question_type")])
    assert row[0] == ["Ann Lee"] and row[1] == ["12/05/2023", "10:30"] and "Ann Lee" in row[2] and row[3] == ["สองร้อย"] and row[4] == "name"


def test_smart_join_and_windows(spark):
    row = one(spark, "ab cd กข ef", T.smart_join(T.cased_tokens(F.col("t"))), T.token_windows(T.cased_tokens(F.col("t")), 3, 1))
    assert row[0] == "ab cdกขef" and row[1] == [["ab", "cd", "กข"], ["กข", "ef"]]


def test_clean_and_markers(spark):
    row = one(spark, " a  \r\nb\t \r\n", T.clean(F.col("t")), T.hide_source_markers(F.lit("x [SOURCE 1]  y [ source 2 ].")))
    assert row[0] == "a\nb" and row[1] == "x y."


def test_document_key():
    assert T.document_key("a/My  File-1.pdf") == "My_File_1" and T.document_key("...") == "document"


def test_routing_and_plan(spark):
    q = F.col("t")
    rows = {t: one(spark, t, Q.preferred_document(T.normalize(q)), Q.plan(q), Q.facets(Q.add_aliases(q))) for t in ("หลักสูตรนานาชาติ เทคโนโลยีสารสนเทศ", "เทคโนโลยีสารสนเทศ", "ทุกหลักสูตร AIT", "compare AIT and DSBA credits, choose", "ait", "waiting")}
    assert [rows[t][0] for t in rows] == ["IT_inter2565.pdf", "IT2565.pdf", None, "AIT.pdf", "AIT.pdf", None]
    plan = rows["compare AIT and DSBA credits, choose"][1]
    assert plan["comparison"] and plan["recommendation"] and plan["documents"] == ["AIT.pdf", "DSBA.pdf"]
    assert len(rows["ทุกหลักสูตร AIT"][1]["documents"]) == 4
    assert rows["compare AIT and DSBA credits, choose"][2] == ["credits"] and rows["ait"][2] == ["unknown"]


def test_facets_fail_closed(spark):
    cases = {"12345678 หน่วยกิต": ["unknown"], "ค่าเทอม หน่วยกิต": ["unknown"], "สหกิจกี่หน่วยกิต": ["co_op"], "อาชีพ และ what is love": ["careers", "unknown"]}
    for q, want in cases.items():
        assert one(spark, q, Q.facets(F.col("t")))[0] == want


def test_history_keeps_the_last_three_user_turns(spark):
    turns = [(1, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(9)] + [(1, 9, "system", "s"), (2, 0, "user", "x")]
    found = {(r.conv_id, r.turn): r for r in Q.with_history(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert found[1, 8].retrieval_query == "t2\nt4\nt6\nt8" and len(found[1, 8].history) == 6
    assert found[2, 0].retrieval_query == "x" and found[2, 0].history == []


def test_variants_and_guard(spark):
    row = one(spark, "Cats and dogs?", Q.variants(F.col("t")), Q.guard(F.col("t")), Q.guard(F.lit("  ")), Q.guard(F.lit("x" * 4001)))
    assert row[0] == ["Cats and dogs?", "Cats", "dogs", "cats and dogs"] and list(row[1:]) == [None, "empty_question", "question_too_long"]
