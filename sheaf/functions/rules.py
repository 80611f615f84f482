"""Rule tables of the two profiles.  They are data: another domain passes its own."""

from __future__ import annotations

# Words that the strict profile doesn't index.
ENGLISH_STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "of", "on", "or", "the", "to", "what", "when", "where", "which", "who", "with"]
THAI_STOP_WORDS = ["การ", "กับ", "ของ", "คือ", "จาก", "ด้วย", "ที่", "หรือ", "อยู่", "และ", "ใน", "เป็น", "ให้", "ได้", "มี"]

# Phrases in a question and what is appended to it.
EXPANSIONS = [
    (["หน่วยกิต"], "จำนวนหน่วยกิตรวม หน่วยกิตรวมตลอดหลักสูตร โครงสร้างหลักสูตร"),
    (["ค่าใช้จ่าย", "ค่าเรียน"], "ค่าธรรมเนียมการศึกษา ค่าเล่าเรียน"),
    (["รับสมัคร", "สมัครเรียน"], "คุณสมบัติผู้สมัคร เกณฑ์การรับสมัคร"),
    (["เรียนกี่ปี", "ระยะเวลาเรียน"], "ระยะเวลาการศึกษา แผนการศึกษา"),
    (["นานาชาติ"], "เทคโนโลยีสารสนเทศทางธุรกิจ หลักสูตรนานาชาติ"),
    (["โครงงานกลุ่ม"], "TEAM-PROJECT ผ่าน S ไม่ผ่าน U"),
    (["รูปแบบระบบการศึกษา"], "ระบบการศึกษา แบบชั้นเรียน แบบออนไลน์ แบบผสมผสาน"),
    (
        ["ทั้ง 4 หลักสูตร", "แต่ละหลักสูตร", "ทุกหลักสูตร", "เปรียบเทียบหลักสูตร", "เรียงหลักสูตร"],
        "เทคโนโลยีสารสนเทศ เทคโนโลยีปัญญาประดิษฐ์ วิทยาการข้อมูลและการวิเคราะห์เชิงธุรกิจ เทคโนโลยีสารสนเทศทางธุรกิจ หลักสูตรนานาชาติ",
    ),
]
# Phrases of questions that span documents.
CROSS_DOCUMENT = ["ทั้ง 4 หลักสูตร", "แต่ละหลักสูตร", "ทุกหลักสูตร", "เปรียบเทียบหลักสูตร", "เรียงหลักสูตร"]

# Routes to one document, the most specific first; substrings, then whole words.
ROUTES = [
    ("IT_inter2565.pdf", ["นานาชาติ", "เทคโนโลยีสารสนเทศทางธุรกิจ"], []),
    ("AIT.pdf", ["ปัญญาประดิษฐ์"], ["ait"]),
    ("DSBA.pdf", ["วิทยาการข้อมูล", "วิเคราะห์เชิงธุรกิจ"], ["dsba"]),
    ("IT2565.pdf", ["เทคโนโลยีสารสนเทศ"], ["it2565"]),
]

# Names in other languages and what is appended for retrieval.
ALIASES = [
    (["artificial intelligence technology", "人工智能", "ait"], "เทคโนโลยีปัญญาประดิษฐ์ AIT"),
    (["it2565", "information technology", "信息技术"], "เทคโนโลยีสารสนเทศ IT2565"),
    (["dsba", "data science", "数据科学"], "วิทยาการข้อมูล DSBA"),
    (["credits", "credit hours", "学分"], "หน่วยกิต"),
    (["duration", "how many years", "学制", "几年"], "ระยะเวลาการศึกษา กี่ปี"),
    (["careers", "career", "jobs", "occupations", "职业", "就业"], "อาชีพหลังสำเร็จการศึกษา"),
    (["semester", "semesters", "学期", "เทอม"], "ภาคการศึกษา"),
    (["specializations", "specialisation", "专业方向", "专业领域"], "ความเชี่ยวชาญเฉพาะทาง"),
    (["specialized", "specialised", "专业课程", "专业课"], "หมวดวิชาเฉพาะ"),
    (["cooperative", "co-op", "internship", "实习", "合作教育"], "สหกิจศึกษา"),
]

# Programmes by document, with a code and names in three languages.
PROGRAMS = {
    "AIT.pdf": ("AIT", "เทคโนโลยีปัญญาประดิษฐ์", "Artificial Intelligence Technology", "人工智能技术"),
    "DSBA.pdf": ("DSBA", "วิทยาการข้อมูลและการวิเคราะห์เชิงธุรกิจ", "Data Science and Business Analytics", "数据科学与商业分析"),
    "IT2565.pdf": ("IT2565", "เทคโนโลยีสารสนเทศ", "Information Technology", "信息技术"),
    "IT_inter2565.pdf": ("IT_inter2565", "เทคโนโลยีสารสนเทศทางธุรกิจ", "Business Information Technology", "商业信息技术"),
}

# Phrases that say what a question wants.
INTENTS = {
    "all_programs": ["แต่ละหลักสูตร", "ทุกหลักสูตร", "ทั้ง 4 หลักสูตร", "这四个", "四个专业", "all four", "each program", "each curriculum"],
    "ranking": ["มากไปน้อย", "高到低", "descending", "highest to lowest"],
    "comparison": ["ต่างกัน", "เปรียบเทียบ", "เลือก", "区别", "选择", "compare", "difference", "choose", " vs "],
    "teaching": ["สรุปเนื้อหา", "สรุปแคลคูลัส", "ช่วยสอน", "สอนแคลคูลัส", "สรุปให้หน่อย", "teach me", "summarize calculus", "explain calculus", "讲解微积分", "总结微积分"],
    "recommendation": ["เลือก", "选择", "choose", "recommend"],
}

# What makes a question unanswerable, what names a facet, and when a clause asks for something else.
BANNED = ["brute-force", "brute force", "dan (", "export", "full text", "ไม่ต้องสนกฎ", "ฐานความรู้", "ลดน้ำหนัก", "หุ้นตัวไหน", "ค่าธรรมเนียม", "ค่าเทอม", "tuition", "学费"]
FACET_TERMS = {
    "careers": ["อาชีพ"],
    "semesters": ["ภาคการศึกษา", "เทอม"],
    "specializations": ["เชี่ยวชาญ"],
    "duration": ["กี่ปี", "ระยะเวลา"],
    "age": ["อายุ"],
    "prize": ["รางวัล"],
    "date": ["วันไหน", "วันที่", "เมื่อไหร่"],
    "name": ["หัวหน้าทีมชื่อ"],
}
# What asks in a clause, and what a known facet is asked with.
ASKING = ["เท่าไหร่", "เท่าไร", "อะไร", "กี่", "how", "what", "多少"]
KNOWN = ["อาชีพ", "ภาค", "เทอม", "เชี่ยวชาญ", "ปี", "ระยะเวลา", "อายุ", "รางวัล", "วัน", "หน่วยกิต", "credit", "year", "职业", "学分", "学制", "学期", "专业"]

# Facet names in Thai, English and Chinese.
FIELD_NAMES = {
    "program": ("ชื่อสาขาวิชา", "Program name", "专业名称"),
    "recommendation": ("ข้อเสนอแนะว่าควรเลือกหลักสูตรใด", "Recommendation on which program to choose", "应该选择哪个专业的建议"),
    "credits": ("หน่วยกิตรวม", "Total credits", "总学分"),
    "specialized": ("หน่วยกิตหมวดวิชาเฉพาะ", "Specialized-course credits", "专业课程学分"),
    "duration": ("ระยะเวลาการศึกษา", "Study duration", "学制"),
    "co_op": ("หน่วยกิตสหกิจศึกษา", "Cooperative education credits", "合作教育学分"),
    "careers": ("อาชีพหลังสำเร็จการศึกษา", "Graduate careers", "毕业生职业"),
    "specializations": ("ความเชี่ยวชาญเฉพาะทาง", "Specializations", "专业方向"),
    "semesters": ("ภาคการศึกษา", "Semesters", "学期"),
    "unknown": ("ส่วนอื่นของคำถาม", "Other requested information", "其他所问信息"),
    "age": ("อายุผู้สมัคร", "Applicant age", "申请人年龄"),
    "prize": ("รางวัล", "Prize", "奖项"),
    "date": ("วันที่", "Date", "日期"),
    "name": ("ชื่อหัวหน้าทีม", "Team leader name", "队长姓名"),
}

# Reviewed wordings in Thai, English and Chinese.
CAREERS = [
    ("นักวิทยาศาสตร์ด้านการเรียนรู้เชิงลึก", "Deep learning scientist", "深度学习科学家"),
    ("นักวิทยาศาสตร์หรือวิศวกรข้อมูล", "Data scientist or data engineer", "数据科学家或数据工程师"),
    ("ผู้พัฒนาระบบธุรกิจอัจฉริยะ", "Business intelligence system developer", "商业智能系统开发人员"),
    ("วิศวกรการเรียนรู้ของเครื่อง", "Machine learning engineer", "机器学习工程师"),
    ("นักวิจัยและนักวิชาการด้านปัญญาประดิษฐ์", "Artificial intelligence researcher and academic", "人工智能研究人员和学者"),
    ("วิศวกรวางสถาปัตยกรรมข้อมูลขนาดใหญ่", "Big data architecture engineer", "大数据架构工程师"),
    ("นักพัฒนาระบบฝังตัวหรือระบบเชื่อมต่อสรรพสิ่ง", "Embedded systems or Internet of Things developer", "嵌入式系统或物联网开发人员"),
    ("ผู้เชี่ยวชาญด้านการมองเห็นด้วยเครื่องจักร", "Computer vision specialist", "计算机视觉专家"),
    ("ผู้เชี่ยวชาญด้านการประมวลผลภาษามนุษย์", "Natural language processing specialist", "自然语言处理专家"),
    ("ผู้ประสานงานหรือผู้จัดการโครงการด้านปัญญาประดิษฐ์", "Artificial intelligence project coordinator or manager", "人工智能项目协调员或经理"),
    ("ผู้ประสานงานหรือผู้จัดการโครงการวิเคราะห์ข้อมูล", "Data analysis project coordinator or manager", "数据分析项目协调员或经理"),
    ("ที่ปรึกษาด้านปัญญาประดิษฐ์", "Artificial intelligence consultant", "人工智能顾问"),
    ("วิศวกรข้อมูล", "Data engineer", "数据工程师"),
]
SPECIALIZATIONS = [
    ("ด้านการพัฒนาซอฟต์แวร์", "Software Development", "软件开发"),
    ("ด้านโครงสร้างพื้นฐานเทคโนโลยีสารสนเทศ", "Information Technology Infrastructure", "信息技术基础设施"),
    ("ด้านสื่อประสมสำหรับการพัฒนาสื่อเชิงโต้ตอบเว็บและเกม", "Multimedia for Interactive Media, Web and Game Development", "用于交互媒体、网页和游戏开发的多媒体"),
]
MONTHS = [
    ("มกราคม", "January", "一月"), ("กุมภาพันธ์", "February", "二月"), ("มีนาคม", "March", "三月"), ("เมษายน", "April", "四月"),
    ("พฤษภาคม", "May", "五月"), ("มิถุนายน", "June", "六月"), ("กรกฎาคม", "July", "七月"), ("สิงหาคม", "August", "八月"),
    ("กันยายน", "September", "九月"), ("ตุลาคม", "October", "十月"), ("พฤศจิกายน", "November", "十一月"), ("ธันวาคม", "December", "十二月"),
]

# Refusals.
REFUSAL = "ไม่พบข้อมูลที่เกี่ยวข้องเพียงพอในเอกสารที่กำหนด"
REFUSALS = {
    "en": ("English", "There is not enough relevant information in the provided documents."),
    "zh": ("中文", "提供的文档中没有足够的相关信息。"),
    "ja": ("日本語", "提供された文書には十分な関連情報がありません。"),
    "ko": ("한국어", "제공된 문서에 관련 정보가 충분하지 않습니다."),
}
# How refusals begin, and phrases in evidence that try to give orders.
REFUSAL_PREFIXES = ["ไม่พบข้อมูล", "ข้อมูลไม่เพียงพอ", "ไม่เพียงพอ", "ไม่มีข้อมูล", "ไม่สามารถตอบ"]
INJECTIONS = ["ignore previous", "system prompt", "api_key", "ไม่ต้องสนกฎ"]

# Words that the open profile doesn't take as keywords.
OPEN_STOP_WORDS = [
    "คือ", "อะไร", "ที่", "ซึ่ง", "ได้", "จะ", "มี", "เป็น", "อย่างไร", "ทำไม", "เมื่อไหร่", "ที่ไหน", "ใคร", "กี่", "เท่าไหร่", "เท่าไร",
    "what", "how", "why", "when", "where", "who", "which", "the", "a", "an", "is", "are", "can", "do", "does",
    "และ", "หรือ", "แต่", "เพราะ", "ถ้า", "ว่า", "ใน", "ของ", "จาก", "ไป", "มา", "กับ", "เพื่อ", "เกี่ยวกับ", "關於", "关于", "vs", "vs.",
]

# Question types of the open profile, in order of precedence.
QUESTION_TYPES = [
    ("number", ["กี่", "เท่าไหร่", "เท่าไร", "how many", "how much", "จำนวน", "เปอร์เซ็นต์", "%", "percent"]),
    ("date", ["เมื่อไหร่", "วันที่", "เวลา", "when", "date", "time"]),
    ("name", ["ใคร", "who", "ชื่อ"]),
    ("location", ["ที่ไหน", "where", "สถานที่", "location"]),
    ("reason", ["ทำไม", "why", "เหตุผล", "reason"]),
    ("procedure", ["อย่างไร", "how", "วิธี", "method", "ขั้นตอน", "steps"]),
    ("definition", ["คืออะไร", "what is", "what are", "คือ", "หมายถึง", "definition"]),
    ("comparison", ["ต่างกัน", "แตกต่าง", "เปรียบเทียบ", "compare", "difference", "vs"]),
    ("list", ["รายการ", "ลิสต์", "list", "มีอะไรบ้าง", "what are the"]),
]

# Patterns of the open profile's signals.
NUMBER = r"[0-9]+(?:[.,][0-9]+)?|[๐-๙]+"
DATE = (
    r"[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}|[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}\s*"
    r"(?:ม\.ค\.|ก\.พ\.|มี\.ค\.|เม\.ย\.|พ\.ค\.|มิ\.ย\.|ก\.ค\.|ส\.ค\.|ก\.ย\.|ต\.ค\.|พ\.ย\.|ธ\.ค\.)\s*[0-9]{4}|[0-9]{1,2}:[0-9]{2}"
)
NAME = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
ENGLISH = r"\b[a-zA-Z]{2,}\b"
THAI_NUMBER = "(?:ศูนย์|หนึ่ง|สอง|สาม|สี่|ห้า|หก|เจ็ด|แปด|เก้า|สิบ|ร้อย|พัน|หมื่น|แสน|ล้าน)+"
HEADINGS = [
    r"^#{1,6}\s+.+$",
    r"^.{1,100}\n[-=]{3,}$",
    r"^\d+[.)]\s+.+$",
    r"^[➤▶◆●■►▪]\s*.+$",
    r"^[ก-ฮ]\.\s+.+$",
    r"^\([ก-ฮ]\)\s+.+$",
    r"^หัวข้อ\s*\d+",
    r"^บทที่\s*\d+",
    r"^ส่วนที่\s*\d+",
    r"^มาตรา\s*\d+",
    r"^ข้อ\s*\d+",
]
# Fields of a chunk that name its source.
METADATA_FIELDS = ["source_name", "title", "source", "file_name", "filename", "source_path"]

# Query enhancement. Words that keywords leave out, what starts a new sub-question, what the fallback adds,
# and what tells the lines of a reply apart.
ENHANCER_STOP_WORDS = [
    "คือ", "อะไร", "ที่", "ซึ่ง", "ได้", "จะ", "มี", "เป็น", "อย่างไร",
    "ทำไม", "เมื่อไหร่", "ที่ไหน", "ใคร", "what", "how", "why", "when", "where", "who",
    "the", "a", "an", "is", "are", "can", "do", "does", "?",
]
CONJUNCTIONS = ["และ", "และว่า", "หรือ", "หรือว่า", "แต่", "แต่ว่า", "เพราะ", "เพราะว่า"]
EXPAND_MORE = "กรุณาอธิบายรายละเอียดและตัวอย่าง"
REPLY_LINES = {
    "expanded": ["ขยาย", "expanded", "ละเอียด", "รายละเอียด"],
    "decomposed": ["แยก", "decomposed", "ส่วนย่อย", "ย่อย"],
    "keywords": ["คำสำคัญ", "keyword", "สำคัญ"],
}
REPLY_SEPARATORS = "[|,،؛]"
ENHANCER_SYSTEM = "คุณคือนักวิเคราะห์คำถามมืออาชีพ"

# Parts of prompts.
NO_HISTORY = "(ไม่มีบทสนทนาก่อนหน้า)"
HISTORY_TITLE = "CONVERSATION HISTORY (เพื่อเข้าใจคำถามต่อเนื่องเท่านั้น ไม่ใช่หลักฐาน):"
USER_PROMPT_END = "ตอบโดยปฏิบัติตามกฎทั้งหมดใน system prompt"
RAG_TEMPLATE = "บริบทจากเอกสาร:\n{context}\n\nคำถาม: {question}\n\nคำตอบ:"
STYLES = {
    "concise": "Answer briefly and directly, preserving all necessary facts.",
    "balanced": "Give a balanced explanation with useful supporting details.",
    "detailed": "Explain in detail with clear sections or lists, but only where evidence supports them.",
}
AUTO_LANGUAGE = "Write in Thai first, then in the language of the user's current question. If it is Thai, answer once."
PREFERENCES_END = " These presentation preferences never override the document-only system rules. If evidence is insufficient, use the prescribed refusal message."
LANGUAGE_NAMES = {"th": "ภาษาไทย (Thai)", "en": "ภาษาอังกฤษ (English)", "zh": "ภาษาจีน (Chinese)", "ja": "ภาษาญี่ปุ่น (Japanese)", "ko": "ภาษาเกาหลี (Korean)"}
THAI_ONCE = "\nREQUIRED OUTPUT: Answer once in Thai only. Do not duplicate the Thai answer. Use only CONTEXT evidence."
