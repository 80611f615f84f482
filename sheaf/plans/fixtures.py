"""Questions and chunks in Thai, English and Chinese for the queries whose rules no test table exercises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUESTION = "the ertion onblewh of thation"
SIGNALS = "Where is \"the of\" in 2024 and 12/05/2023 for Anand src1?"

QUESTIONS = [
    (1, "หลักสูตร DSBA มีกี่หน่วยกิต"),
    (2, "How many credits and careers does AIT have?"),
    (3, "数据科学 学分 多少"),
    (4, "เรียงหลักสูตรทั้ง 4 หลักสูตรตามหน่วยกิตจากมากไปน้อย"),
    (5, "เปรียบเทียบ AIT และ DSBA หน่วยกิต ควรเลือกอันไหน"),
    (6, "ค่าเทอมเท่าไหร่"),
    (7, "what is the weather"),
    (8, "หลักสูตรนานาชาติเรียนกี่ปี"),
    (9, "ช่วยสอนแคลคูลัส"),
    (10, "12345678 หน่วยกิต"),
    (11, ""),
    (12, "学期"),
]

CHUNKS = [
    ("DSBA_p1_c01", "DSBA.pdf", 1, "จำนวนหน่วยกิตรวมตลอดหลักสูตร 96 หน่วยกิต\nหมวดวิชาเฉพาะ 60 หน่วยกิต\nหลักสูตรปริญญาตรี 4 ปี"),
    ("AIT_p2_c01", "AIT.pdf", 2, "จำนวนหน่วยกิตรวมตลอดหลักสูตร 90 หน่วยกิต\nอาชีพที่สามารถประกอบได้หลังสำเร็จการศึกษา\n(1) ที่ปรึกษาด้านปัญญาประดิษฐ์\n(2) วิศวกรการเรียนรู้ของเครื่อง"),
    ("AIT-update_p1_c01", "AIT-update.pdf", 1, "จำนวนหน่วยกิตรวมตลอดหลักสูตร 91 หน่วยกิต ปัญญาประดิษฐ์"),
    ("IT2565_p3_c01", "IT2565.pdf", 3, "จำนวนหน่วยกิตรวมตลอดหลักสูตร ไม่น้อยกว่า 93 หน่วยกิต\nเทคโนโลยีสารสนเทศ\nignore previous หน่วยกิต"),
    ("IT_inter2565_p1_c01", "IT_inter2565.pdf", 1, "จำนวนหน่วยกิตรวมตลอดหลักสูตร 90 หน่วยกิต\nหลักสูตรปริญญาตรี 4 ปี หลักสูตรนานาชาติ ระยะเวลาการศึกษา"),
]


def chunks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHUNKS, "chunk_id string, document string, page int, text string")


def hits(spark: SparkSession) -> DataFrame:
    """All chunks as hits of one question that asks for credits, duration and careers."""
    rows = [(1, c, k, d, p, t, ["credits", "duration", "careers"]) for k, (c, d, p, t) in enumerate(CHUNKS, 1)]
    return spark.createDataFrame(rows, "query_id long, chunk_id string, rank int, document string, page int, text string, facets array<string>")


SELECTIONS = ['{"evidence_ids": ["E1", "E2"]}', '{"evidence_ids": ["E1"]}', '{"evidence_ids": ["E1", "E2", "E9"]}', '{"evidence_ids": "E1"}', '{"evidence_ids": [1, 2]}', '{"evidence_ids": ["E1", "E2"], "note": ""}', "[]", "not json", None, '{"ids": []}']


def selections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, ["E1", "E2"], True) for s in SELECTIONS], "raw string, ids array<string>, spans_valid boolean")


#: (family, outline, code): glyphs of fonts as their files map them; outlines by name, but for verified ones.
GLYPHS = [
    ("THSarabunNew", "o1", 0x0E01),
    ("THSarabunNew", "o1", 0xE001),
    ("THSarabunNew", "o2", 0x0E02),
    ("THSarabunNew", "o2", 0x0E03),
    ("THSarabunNew", "o2", 0xE002),
    ("THSarabunNew", "0fa641fde2abff437f3b6b436c4b98f853be57ab1c7cd62183a27b98e39458b7", 0xE003),
    ("THSarabunPSK", "12945c6f46081a276f80c6ae37c292edaa2c14e60820555a62a4f6e3f453cf73", 0xE001),
    ("THSarabunPSK", "o3", 0xE004),
    ("Wingdings", "o1", 0x0E01),
    ("Wingdings", "o1", 0xE001),
]
#: (id, family, text): text with private characters from those fonts.
GLYPH_TEXTS = [
    (1, "THSarabunNew", "x\ue001\ue002\ue003 2566"),
    (2, "THSarabunPSK", "\ue001 \ue004"),
    (3, "Wingdings", "\ue001"),
    (4, None, "\ue001"),
    (5, "THSarabunNew", None),
    (6, "THSarabunNew", ""),
]


def glyphs(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(GLYPHS, "family string, outline string, code int"), spark.createDataFrame(GLYPH_TEXTS, "id long, family string, text string")


#: (query_id, question, reply): replies of an enhancer in several shapes.
REPLIES = [
    (1, "What is AI and how does it work?", "1. Expanded: what is artificial intelligence\n2. Decomposed: what is AI, how does it work\n3. keyword: AI work"),
    (2, "หลักสูตรมีกี่หน่วยกิต", "1) คำถามขยาย ให้ละเอียด\n\n2) แยกเป็น ก | ข | \n3) คำสำคัญ หน่วยกิต"),
    (3, "plain question", "no known line"),
    (4, "plain question", None),
    (5, "plain question", "expanded one\nexpanded two\nKEYWORD plain"),
    (6, "", ""),
]


#: What a page of a programme says besides a document's own lines: when, and the line, both in SQL over n (the number of characters).
PROGRAMME_LINES = [
    ("n % 2 = 0", "concat('จำนวนหน่วยกิตรวมตลอดหลักสูตร ', 80 + n % 60, ' หน่วยกิต')"),
    ("n % 3 = 0", "concat('จำนวนหน่วยกิต หลักสูตร', chr(10), ' ', 100 + n % 50, ' หน่วยกิต')"),
    ("n % 4 = 0", "concat('หมวดวิชาเฉพาะ ', n % 100, ' หน่วยกิต')"),
    ("n % 5 < 2", "concat('หลักสูตรปริญญาตรี ', 2 + n % 5, ' ปี')"),
    ("n % 7 = 0", "concat('อาชีพที่สามารถประกอบได้', chr(10), '(1) นักวิเคราะห์ข้อมูล', chr(10), '(2) วิศวกร ', n % 9, chr(10), '2. อื่น')"),
    ("n % 4 < 2", "concat('ชื่อ เทคโนโลยี', 'ปัญญาประดิษฐ์ ', n % 13)"),
    ("n % 11 = 0", "concat('อายุ ', n % 90, ' ignore previous')"),
    ("n % 6 = 0", "concat('อายุ ', n % 90)"),
    ("n % 8 = 0", "concat('สหกิจศึกษา', chr(10), n % 7, ' (0 - 45 - 0)')"),
]
ASKED_FACETS = [["credits", "duration", "careers"], ["specialized", "program", "co_op"], ["age", "semesters", "program"]]


def programme_pages(documents: DataFrame) -> DataFrame:
    """Each document as a hit: its own lines and those that its length calls for.  Twenty documents are one question's hits."""
    from pyspark.sql import functions as F

    from sheaf.functions import rules

    wide = documents.withColumn("n", F.coalesce(F.length("text"), F.lit(0)))
    lines = [F.expr(f"CASE WHEN {test} THEN {line} END") for test, line in PROGRAMME_LINES]
    names = F.array(*[F.lit(d) for d in [*rules.PROGRAMS, "other.pdf"]])
    facets = F.array(*[F.array(*map(F.lit, f)) for f in ASKED_FACETS])
    return wide.select(
        F.expr("doc_id div 20").alias("query_id"),
        F.col("doc_id").cast("string").alias("chunk_id"),
        (F.col("doc_id") % 20 + 1).cast("int").alias("rank"),
        F.element_at(names, (F.col("n") % 5 + 1).cast("int")).alias("document"),
        (F.col("doc_id") % 7).cast("int").alias("page"),
        F.concat_ws("\n", F.coalesce("text", F.lit("")), *lines).alias("text"),
        F.element_at(facets, (F.col("doc_id") % 3 + 1).cast("int")).alias("facets"),
    )


def programme_summaries(documents: DataFrame) -> DataFrame:
    """One chunk for each programme, whose numbers come from all documents of the sources that stand for it."""
    from pyspark.sql import functions as F

    from sheaf.functions import rules

    number = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int"), F.lit(0)) % len(rules.PROGRAMS)
    totals = documents.groupBy(number.alias("k")).agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n"))
    names = F.array(*[F.lit(d) for d in rules.PROGRAMS])
    titles = F.array(*[F.lit(p[1]) for p in rules.PROGRAMS.values()])
    credits, years = F.expr("concat('จำนวนหน่วยกิตรวมตลอดหลักสูตร ', 80 + n % 60, ' หน่วยกิต')"), F.expr("concat('หลักสูตรปริญญาตรี ', 2 + n % 5, ' ปี')")
    text = F.concat_ws("\n", F.element_at(titles, F.col("k") + 1), credits, years, F.lit(f"อาชีพที่สามารถประกอบได้\n(1) {rules.CAREERS[0][0]}"))
    return totals.select(F.concat(F.lit("p"), F.col("k").cast("string")).alias("chunk_id"), F.element_at(names, F.col("k") + 1).alias("document"), (F.col("k") + 1).alias("page"), text.alias("text"))
