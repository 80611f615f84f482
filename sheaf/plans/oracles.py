"""DuckDB SQL for the registered queries that SQL can express, over the same tables."""

from __future__ import annotations

import re

from sheaf.functions import rules
from sheaf.functions.text import OPEN_WORD, STRICT_WORD
from sheaf.operators import evidence
from sheaf.plans import fixtures
from sheaf.plans.registry import GLYPH_FAMILY, GLYPH_TEXT, HEADED, REPLY
from sheaf.sources import glyphs


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def array(values: list[str]) -> str:
    return "[" + ", ".join(map(lit, values)) + "]"


def any_of(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(t)})" for t in terms) + ")"


def tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '{OPEN_WORD}'), lambda t: length(t) > 1)"


def cased(text: str) -> str:
    return f"regexp_extract_all({text}, '{OPEN_WORD}')"


def normal(text: str) -> str:
    return f"trim(regexp_replace(replace(lower(nfc_normalize({text})), 'ß', 'ss'), '\\s+', ' ', 'g'))"


def strict_terms(text: str) -> str:
    """For text without Thai."""
    return f"list_filter(regexp_extract_all({normal(text)}, '{STRICT_WORD}'), lambda t: NOT list_contains({array(rules.ENGLISH_STOP_WORDS)}, t))"


def values(rows: list[tuple], names: str) -> str:
    """Rows of numbers, strings and nulls as a table."""
    cell = lambda v: "NULL" if v is None else lit(v) if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS t({names})"


def cte(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def base(asked: str, words: str = "", key: str = "documents", terms=tokens) -> list[str]:
    """d: tokens of documents; p: postings; s: totals; q: (query_id, query); qt: query terms."""
    return [
        f"d AS (SELECT doc_id AS id, text, source, {terms('text')} AS toks FROM documents)",
        "w AS (SELECT id, len(toks) AS dl, unnest(toks) AS term FROM d)",
        "p AS (SELECT term, id, count(*) AS tf, any_value(dl) AS dl FROM w GROUP BY ALL)",
        "f AS (SELECT term, count(*) AS df FROM p GROUP BY term)",
        "s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl, sum(len(toks)) AS n_tokens FROM d)",
        f"q AS ({asked})",
        f"qw AS (SELECT query_id, t[1] AS term, t[2] AS nth FROM (SELECT query_id, unnest(list_zip({terms('query')}, range(len({terms('query')})))) AS t FROM q))",
        "qt AS (SELECT query_id, term, count(*) AS qtf, min(nth) AS nth FROM qw GROUP BY ALL)",
    ]


ONE = f"SELECT 0::BIGINT AS query_id, {lit(fixtures.QUESTION)} AS query"
BATCH = "SELECT item_id AS query_id, text AS query FROM benchmark"
SHORT = f"SELECT item_id AS query_id, array_to_string(({tokens('text')})[3:5], ' ') AS query FROM benchmark"
IDF = "ln(1 + (n - df + 0.5) / (df + 0.5))"
SATURATED = "tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / {avg}))"


def bm25(asked: str, k: int) -> list[str]:
    return [
        *base(asked),
        f"b AS (SELECT query_id, id, round(sum({IDF} * {SATURATED.format(avg='avgdl')} * qtf), 6) AS score FROM qt JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL)",
        "a AS (SELECT q.query_id, d.id, coalesce(b.score, 0) AS score FROM q CROSS JOIN d LEFT JOIN b ON b.query_id = q.query_id AND b.id = d.id)",
        f"hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM a) WHERE rank <= {k})",
    ]


STRICT = lambda asked, k: [
    *base(asked, terms=strict_terms),
    f"i AS (SELECT query_id, term, qtf, nth, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf FROM qt LEFT JOIN f USING (term), s)",
    "t AS (SELECT query_id, sum(idf * qtf) AS whole FROM i GROUP BY query_id)",
    f"b AS (SELECT query_id, id, sum(idf * {SATURATED.format(avg='greatest(avgdl, 1)')} * least(qtf, 3)) AS bm25, sum(idf * qtf) AS matched, "
    "list(term ORDER BY nth) FILTER (WHERE length(term) > 1) AS terms FROM i JOIN p USING (term), s GROUP BY ALL)",
    f"m AS (SELECT query_id, id, bm25, terms, least(1.0, matched / whole) AS coverage, length({normal('query')}) >= 3 AND contains({normal('text')}, {normal('query')}) AS exact_match "
    "FROM b JOIN t USING (query_id) JOIN q USING (query_id) JOIN d USING (id))",
    "r AS (SELECT query_id, id, round(bm25 + 2 * coverage + CASE WHEN exact_match THEN 2 ELSE 0 END, 6) AS score, "
    "round(least(1.0, 0.6 * coverage + 0.3 * bm25 / (bm25 + 3) + CASE WHEN exact_match THEN 0.1 ELSE 0 END), 6) AS confidence, exact_match, coalesce(array_to_string(terms[1:20], ' '), '') AS matched_terms FROM m)",
    f"hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM r) WHERE rank <= {k})",
]

COSINE = "round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) + 0.0"
VECTORS = f"v AS (SELECT x.vec_id AS query_id, y.vec_id AS id, {COSINE} AS score FROM embeddings x, embeddings y WHERE {{test}})"
DOT_JOIN = "unnest(string_split(text, chr(10)))"


def _top(source: str, k: int, cols: str) -> str:
    return f"SELECT {cols}, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM {source}) WHERE rank <= {k}"


_SIGNAL = fixtures.SIGNALS
QUOTED = "\"[^\"]+\"|“[^”]+”|'[^']+'"


def signal(pattern: str) -> str:
    return f"regexp_extract_all(query, {lit(pattern)})"


ENHANCED = cte(
    *base(f"SELECT 0::BIGINT AS query_id, {lit(_SIGNAL)} AS query"),
    f"b AS (SELECT query_id, id, round(sum({IDF} * {SATURATED.format(avg='avgdl')} * qtf), 6) AS bm25 FROM qt JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL)",
    f"g AS (SELECT query_id, list_filter({tokens('query')}, lambda t: NOT list_contains({array(rules.OPEN_STOP_WORDS)}, t)) AS keywords, regexp_extract_all(query, '\"([^\"]+)\"', 1) AS phrases, "
    f"list_concat({signal(rules.NUMBER)}, {signal(rules.DATE)}) AS numbers, {signal(rules.ENGLISH)} AS english FROM q)",
    f"c AS (SELECT query_id, d.id, coalesce(list_sum(list_transform(phrases, lambda x: CASE WHEN contains(lower(text), lower(x)) THEN 2.0 * len(string_split(x, ' ')) ELSE 0 END)), 0)::DOUBLE AS phrase, "
    f"0.5 * len(list_intersect(list_distinct(keywords), list_distinct(toks))) AS keyword, 1.0 * len(list_intersect(list_distinct(keywords), list_distinct({tokens('source')}))) AS metadata, "
    "3.0 * len(list_filter(numbers, lambda x: contains(text, x))) AS number_date, 1.5 * len(list_filter(english, lambda x: contains(lower(text), lower(x)))) AS english FROM g, d)",
    "a AS (SELECT query_id, id, coalesce(bm25, 0) AS bm25, phrase::DOUBLE AS phrase, keyword::DOUBLE AS keyword, metadata::DOUBLE AS metadata, number_date::DOUBLE AS number_date, english::DOUBLE AS english, "
    "round(coalesce(bm25, 0) + phrase + keyword + metadata + number_date + english, 6)::DOUBLE AS score FROM c LEFT JOIN b USING (query_id, id))",
) + _top("a", 10, "id, score, bm25, phrase, keyword, metadata, number_date, english")

QUESTIONS = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {lit(t)})" for i, t in fixtures.QUESTIONS) + ") AS t(query_id, question))"
ALL_QUESTIONS = QUESTIONS[:-1] + " UNION ALL SELECT conv_id * 1000 + turn + 1000, text FROM conversations WHERE role = 'user')"
#: Whole words: \\b in RE2 knows ASCII only.
WHOLE = "(^|[^\\p{{L}}\\p{{N}}_]){}($|[^\\p{{L}}\\p{{N}}_])"


def appended(conditions: list[tuple[str, str]], first: str) -> str:
    return f"concat_ws(' ', {first}, " + ", ".join(f"CASE WHEN {c} THEN {lit(extra)} END" for c, extra in conditions) + ")"


def alias_test(names: list[str]) -> str:
    one = lambda a: f"regexp_matches(lower(question), '(^|[^a-z0-9]){a}($|[^a-z0-9])')" if a.isascii() else f"contains(lower(question), {lit(a)})"
    return "(" + " OR ".join(map(one, names)) + ")"


LOW_QUESTION = normal("question")
ROUTE = f"CASE WHEN {any_of(LOW_QUESTION, rules.CROSS_DOCUMENT)} THEN NULL " + " ".join(
    f"WHEN {any_of(LOW_QUESTION, terms)} {''.join(f' OR regexp_matches({LOW_QUESTION}, {lit(WHOLE.format(w))})' for w in words)} THEN {lit(d)}" for d, terms, words in rules.ROUTES
) + " END"
HISTORY = (
    "said AS (SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant'))",
    "h AS (SELECT *, coalesce(list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), []) AS history FROM said)",
)
CASES = (
    f"e AS (SELECT item_id, min(doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains({normal('d.text')}, {normal('b.text')}) AND length({normal('b.text')}) >= 3 GROUP BY item_id)",
    "c AS (SELECT b.item_id, e.doc_id IS NULL AS refused, item_id % 7 = 0 AS expected, "
    "CASE WHEN e.doc_id IS NOT NULL THEN contains(lower(regexp_replace(d.text, '\\s+', '', 'g')), lower(regexp_replace(b.text, '\\s+', '', 'g'))) ELSE false END AS held, "
    "CASE WHEN item_id % 2 = 0 OR d.source = 'src0' THEN 0 ELSE 1 END AS n_missing FROM benchmark b LEFT JOIN e USING (item_id) LEFT JOIN documents d ON d.doc_id = e.doc_id)",
    "r AS (SELECT item_id, refused, CASE WHEN expected THEN refused ELSE NOT refused AND held END AS answer_correct, expected OR n_missing = 0 AS citation_correct, n_missing::BIGINT AS n_missing FROM c)",
)
RX = "regexp_replace({}, {}, {}, 'gs')"
HTML = "html"
for _tag in ("script", "style", "nav", "footer", "header"):
    HTML = f"regexp_replace({HTML}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', chr(10), 'g')"
HTML = f"regexp_replace({HTML}, '(?s)<!--.*?-->', '', 'g')"
HTML = f"regexp_replace(regexp_replace({HTML}, '<[^>]*>', chr(10), 'g'), '[ \\t]+', ' ', 'g')"
HTML = f"regexp_replace(regexp_replace({HTML}, ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"

BLOCK = "'[เอกสารที่พบ]' || chr(10) || '[DOCUMENT] ' || source || chr(10) || '[CONTENT]' || chr(10) || text || chr(10) || '[/เอกสารที่พบ]'"
RANKED = [*bm25(BATCH, 10), "k AS (SELECT hits.*, text, source FROM hits JOIN d USING (id))"]
SENTENCE = "list_filter(list_transform(regexp_extract_all(text, '[^.!?。？！ฯ]*[.!?。？！ฯ]+|[^.!?。？！ฯ]+$'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '')"

#: Whole words of Latin letters: \\b in RE2 knows ASCII only.
ENGLISH = "list_filter(regexp_extract_all(query, '[\\p{L}\\p{N}_]+'), lambda t: regexp_full_match(t, '[a-zA-Z]{2,}'))"
ENHANCED_OF = lambda asked, meta: [
    *base(asked),
    f"b AS (SELECT query_id, id, round(sum({IDF} * {SATURATED.format(avg='avgdl')} * qtf), 6) AS bm25 FROM qt JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL)",
    f"g AS (SELECT query_id, list_filter({tokens('query')}, lambda t: NOT list_contains({array(rules.OPEN_STOP_WORDS)}, t)) AS keywords, "
    f"list_transform(regexp_extract_all(query, {lit(QUOTED)}), lambda x: substring(x, 2, length(x) - 2)) AS phrases, "
    f"list_concat({signal(rules.NUMBER)}, {signal(rules.DATE)}) AS numbers, {ENGLISH} AS english FROM q WHERE len({tokens('query')}) > 0)",
    f"c AS (SELECT query_id, d.id, coalesce(list_sum(list_transform(phrases, lambda x: CASE WHEN contains(lower(text), lower(x)) THEN 2.0 * len(list_filter(regexp_split_to_array(trim(x), '\\s+'), lambda w: w <> '')) ELSE 0 END)), 0)::DOUBLE AS phrase, "
    f"0.5 * len(list_intersect(list_distinct(keywords), list_distinct(toks))) AS keyword, 1.0 * len(list_intersect(list_distinct(keywords), list_distinct({tokens(meta)}))) AS metadata, "
    "3.0 * len(list_filter(numbers, lambda x: contains(text, x))) AS number_date, 1.5 * len(list_filter(english, lambda x: contains(lower(text), lower(x)))) AS english FROM g, d)",
    "a AS (SELECT query_id, id, coalesce(bm25, 0)::DOUBLE AS bm25, phrase::DOUBLE AS phrase, keyword::DOUBLE AS keyword, metadata::DOUBLE AS metadata, number_date::DOUBLE AS number_date, english::DOUBLE AS english, "
    "round(coalesce(bm25, 0) + phrase + keyword + metadata + number_date + english, 6)::DOUBLE AS score FROM c LEFT JOIN b USING (query_id, id))",
]

TRIM = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
ASKED = "q AS (SELECT conv_id * 1000 + turn AS query_id, text AS question FROM conversations WHERE role = 'user')"
KEYWORDS = f"array_to_string((list_filter(regexp_extract_all(lower(question), '[฀-๿]+|[a-zA-Z]+'), lambda t: NOT list_contains({array(rules.ENHANCER_STOP_WORDS)}, t) AND length(t) > 1))[1:10], ' ')"
_CUT = f"list_filter(list_transform(regexp_split_to_array(question, '\\?|\\s+(?:{'|'.join(rules.CONJUNCTIONS)})\\s+'), lambda x: {TRIM('x')}), lambda x: x <> '')"
SUB_QUESTIONS = f"CASE WHEN len({_CUT}) = 0 THEN [question] ELSE (list_transform({_CUT}, lambda x: x || '?'))[1:5] END"


def _reply(kind: str, *before: str) -> str:
    test = " AND ".join([any_of("lower(v)", rules.REPLY_LINES[kind]), *[f"NOT {any_of('lower(v)', rules.REPLY_LINES[k])}" for k in before]])
    return f"(list_filter(lines, lambda v: {test}))[-1]"


def _first_of(variants: str) -> str:
    """Of a list of variants those that aren't blank and that none before is like."""
    key = lambda x: f"lower({TRIM(x)})"
    return f"list_filter({variants}, lambda v, i: {key('v')} <> '' AND list_position(list_transform({variants}, lambda x: {key('x')}), {key('v')}) = i)"


#: From r (query_id, question, reply): what the lines of replies say.
PARSED = [
    f"ls AS (SELECT *, list_transform(list_filter(list_transform(string_split(coalesce(reply, ''), chr(10)), lambda v: {TRIM('v')}), lambda v: v <> ''), lambda v: regexp_replace(v, '^[0-9]+[.)]\\s*', '')) AS lines FROM r)",
    f"k AS (SELECT query_id, question, coalesce({_reply('expanded')}, question) AS expanded, {_reply('decomposed', 'expanded')} AS cut, coalesce({_reply('keywords', 'decomposed', 'expanded')}, {KEYWORDS}) AS keyword_focused FROM ls)",
    f"y AS (SELECT *, CASE WHEN cut IS NULL THEN [question] ELSE list_filter(list_transform(regexp_split_to_array(cut, {lit(rules.REPLY_SEPARATORS)}), lambda v: {TRIM('v')}), lambda v: v <> '') END AS decomposed FROM k)",
    "u AS (SELECT *, list_concat([question, expanded, keyword_focused], decomposed) AS every FROM y)",
    f"z AS (SELECT *, {_first_of('every')} AS variants FROM u)",
]
LANGUAGE = lambda x: (
    f"CASE WHEN regexp_matches({x}, '[぀-ヿ]') THEN 'ja' WHEN regexp_matches({x}, '[가-힯]') THEN 'ko' WHEN regexp_matches({x}, '[㐀-鿿]') THEN 'zh' WHEN regexp_matches({x}, '[฀-๿]') THEN 'th' WHEN regexp_matches({x}, '[A-Za-z]') THEN 'en' ELSE 'th' END"
)
OPEN_KEYWORDS = lambda x: f"list_filter({tokens(x)}, lambda t: NOT list_contains({array(rules.OPEN_STOP_WORDS)}, t))"
_CLAUSES = lambda x: (
    f"(list_filter(list_transform(regexp_split_to_array({x}, 'และ|หรือ|\\band\\b|\\bor\\b|[?？;；]'), lambda c: trim(c)), lambda c: length(c) > 1))[1:5]"
)


def variants_of(x: str) -> str:
    every = f"list_filter(list_concat([trim({x})], {_CLAUSES(x)}, [array_to_string(({OPEN_KEYWORDS(x)})[1:10], ' ')]), lambda v: v <> '')"
    return f"list_filter({every}, lambda v, i: list_position(list_transform({every}, lambda y: lower(y)), lower(v)) = i)"


NAMED = "CASE l " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in rules.LANGUAGE_NAMES.items()) + " END"
REFUSED = "CASE l " + " ".join(f"WHEN '{k}' THEN " + " || chr(10) || ".join(map(lit, ["ภาษาไทย:", rules.REFUSAL, "", f"{h}:", m])) for k, (h, m) in rules.REFUSALS.items()) + f" ELSE {lit(rules.REFUSAL)} END"
SOURCE_BLOCK = "'[SOURCE ' || rank || ']' || chr(10) || 'document: ' || source || chr(10) || 'page: ' || CASE WHEN id % 3 > 0 THEN (id % 3)::VARCHAR ELSE 'N/A' END || chr(10) || 'chunk_id: ' || id || chr(10) || 'content:' || chr(10) || text || chr(10) || '[/SOURCE ' || rank || ']'"
SELECTED = "json_extract(raw, '$.evidence_ids')"
OPEN = [
    *bm25(BATCH, 5),
    "g AS (SELECT query_id, score >= 1 AS passed, round(greatest(0, least(1, CASE WHEN score >= 1 THEN least(score / 3, 1) ELSE score END)), 6) AS confidence FROM hits WHERE rank = 1)",
    "k AS (SELECT hits.*, text, source FROM hits JOIN d USING (id) JOIN g USING (query_id) WHERE passed)",
    f"u AS (SELECT query_id, rank, text, sum(length({BLOCK})) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM k)",
    "x AS (SELECT query_id, text FROM u WHERE rank = 1 AND used <= 4000)",
    "n AS (SELECT query_id, count(DISTINCT source) AS n_sources FROM k GROUP BY query_id)",
]

FACTS = "f AS (SELECT lang, source, quality::VARCHAR AS value FROM documents JOIN labels USING (doc_id))"
_HAS = {k: any_of("lower(question)", v) for k, v in rules.INTENTS.items()}
_NAMED = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(question), '(^|[^a-z0-9_]){re.escape(p[0].lower())}($|[^a-z0-9_])') THEN {lit(d)} END" for d, p in rules.PROGRAMS.items()) + "], lambda d: d IS NOT NULL)"
_ALIASED = "lower(" + appended([(alias_test(n), e) for n, e in rules.ALIASES], "trim(question)") + ")"
_OTHER = f"len(list_filter(regexp_split_to_array(low, 'และ|พร้อมทั้ง|\\band\\b|[?？;；]'), lambda c: {any_of('c', rules.ASKING)} AND NOT {any_of('c', rules.KNOWN)})) > 0"
_FACETS = (
    "list_filter([" + ", ".join(f"CASE WHEN {any_of('low', terms)} THEN '{name}' END" for name, terms in rules.FACET_TERMS.items())
    + f", CASE WHEN contains(low, 'หน่วยกิต') THEN CASE WHEN contains(low, 'สหกิจ') THEN 'co_op' WHEN contains(low, 'หมวดวิชาเฉพาะ') THEN 'specialized' ELSE 'credits' END END, CASE WHEN {_OTHER} THEN 'unknown' END], lambda f: f IS NOT NULL)"
)
PLAN = cte(
    ALL_QUESTIONS,
    f"a AS (SELECT *, {_ALIASED} AS low, {_NAMED} AS named FROM q)",
    f"b AS (SELECT *, len(named) > 1 AND {_HAS['comparison']} AS comparison, {_FACETS} AS found FROM a)",
) + (
    f"SELECT query_id, array_to_string(CASE WHEN {_HAS['all_programs']} THEN {array(list(rules.PROGRAMS))} WHEN comparison THEN named ELSE [] END, ',') AS documents, {_HAS['ranking']} AS ranking, comparison, {_HAS['teaching']} AS teaching, "
    f"comparison AND {_HAS['recommendation']} AS recommendation, "
    f"CASE WHEN regexp_matches(low, '(^|[^0-9])[0-9]{{8}}($|[^0-9])') OR {any_of('low', rules.BANNED)} OR len(found) = 0 THEN 'unknown' ELSE array_to_string(found, ',') END AS facets FROM b"
)

_SENTENCE = r"[.!?…。！？\n]"
_LEAD = lambda x: f"(length({x}) - length(regexp_replace({x}, '^\\s+', '')))"
_PART = lambda a, b: f"substring(text, ({a}) + 1, ({b}) - ({a}))"


def chunked(size: int, overlap: int) -> str:
    """Chunks by a recursion over where each starts: ``p`` has a step's columns in the order in which they are found."""
    half = max(1, size // 2)
    cut = lambda at, span, pattern: f"nullif(({at}) - 1 + length(regexp_extract({span}, '(?s)^({pattern})', 1)), ({at}) - 1)"
    run = lambda at, span, pattern: f"nullif(({at}) - 1 + length(regexp_extract({span}, '(?s)^({pattern})\\S', 1)), ({at}) - 1)"
    step = f"""(SELECT doc_id, text, total, pos, stop, {_LEAD('inside')} + pos AS start_char, pos + length(regexp_replace(inside, '\\s+$', '')) AS end_char, floor_, found FROM (
      SELECT *, {_PART('pos', 'stop')} AS inside, CASE WHEN stop < total THEN coalesce({cut('floor_', _PART('floor_ - 1', 'stop - 1'), f'.*?{_SENTENCE}')}, {run('floor_', _PART('floor_ - 1', 'stop'), '.*?\\s')}) END AS found FROM (
        SELECT *, greatest(pos + 1, stop - {overlap}) AS floor_ FROM (
          SELECT *, CASE WHEN pos + {size} >= total THEN total ELSE coalesce({cut(f'pos + {half}', _PART(f'pos + {half} - 1', f'pos + {size}'), f'.*{_SENTENCE}')}, {run(f'pos + {half}', _PART(f'pos + {half} - 1', f'pos + {size} + 1'), '.*\\s')}, pos + {size}) END AS stop FROM c WHERE pos < total))))"""
    return (
        "WITH RECURSIVE c AS (SELECT doc_id, text, length(text) AS total, " + _LEAD("text") + " AS pos FROM documents WHERE text IS NOT NULL UNION ALL "
        f"SELECT doc_id, text, total, greatest(pos + 1, CASE WHEN found IS NULL THEN floor_ ELSE found + {_LEAD(_PART('found', 'stop'))} END) FROM {step} WHERE stop < total), "
        f"s AS (SELECT * FROM {step} WHERE start_char < end_char) "
        f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INT AS chunk_index, start_char::INT AS start_char, end_char::INT AS end_char, md5({_PART('start_char', 'end_char')}) AS digest FROM s"
    )


def decoded(x: str) -> str:
    """A text with the character references that the test pages hold; the ampersand comes last."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", chr(34)), ("&#x27;", "'"), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        x = f"replace({x}, {lit(name)}, {lit(char)})"
    return x


#: Fetched pages whose text lies in one article without anything to be dropped.
WEB = (
    "n AS (SELECT page_id, url, regexp_extract(html, '(?is)<title>([^<]*)</title>', 1) AS title, regexp_split_to_array(regexp_extract(html, '(?is)<article>(.*)</article>', 1), '<[^>]*>') AS nodes FROM pages)",
    f"w AS (SELECT page_id, url, nullif({TRIM(decoded('title'))}, '') AS title, array_to_string(list_filter(list_transform(nodes, lambda x: {TRIM(decoded('x'))}), lambda x: x <> ''), chr(10)) AS raw FROM n)",
    f"t AS (SELECT page_id, url, title, {TRIM("regexp_replace(regexp_replace(raw, '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]{2,}', ' ', 'g')")} AS text FROM w)",
)


def _re(pattern: str) -> str:
    """A pattern as a literal, with characters by number as RE2 has them."""
    return lit(re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern))


def _fold(text: str) -> str:
    return f"regexp_replace(lower({text}), {_re(evidence.PASSED_OVER)}, '', 'g')"


def _fold_term(term: str) -> str:
    return lit(re.sub(evidence.PASSED_OVER, "", term.lower()))


def _rule(rule: evidence.Rule) -> tuple[str, str]:
    """When a rule fits line i of lines, and what it quotes."""
    quote = f"array_to_string(lines[greatest(1, i + {rule.lines[0]}):i + {rule.lines[1] - 1}], chr(10))"
    tests = ["(" + " OR ".join("(" + " AND ".join(f"contains(fold, {_fold_term(t)})" for t in g) + ")" for g in rule.terms) + ")"]
    if rule.unless:
        tests.append(f"NOT regexp_matches(said, {_re(f'^(?:{rule.unless})')})")
    if rule.below:
        tests.append(f"coalesce(contains({_fold('nxt')}, {_fold_term(rule.below)}), false)")
    if rule.pattern:
        where = {"line": "said", "next": "coalesce(nxt, '')", "quote": quote}[rule.place]
        tests.append(f"regexp_matches({where}, {_re(f'^(?:{rule.pattern})' if rule.place == 'next' else rule.pattern)})")
    return " AND ".join(tests), quote


_LINE_QUOTES = "CASE facet " + " ".join(f"WHEN {lit(f)} THEN CASE " + " ".join("WHEN {} THEN {}".format(*_rule(r)) for r in own) + " END" for f, own in evidence.LINE_RULES.items()) + " END"
_HEADED = lambda facet: "list_transform(lines, lambda x: " + " OR ".join(f"contains({_fold('x')}, {_fold_term(h)})" for h in evidence.LISTS[facet]) + ")"
_PROGRAM = "CASE document " + " ".join(f"WHEN {lit(d)} THEN {lit(p[1])}" for d, p in rules.PROGRAMS.items()) + " END"
EVIDENCE_FOUND = cte(
    "d AS (SELECT doc_id, coalesce(text, '') AS own, length(coalesce(text, ''))::BIGINT AS n FROM documents)",
    f"p AS (SELECT doc_id, doc_id // 20 AS query_id, doc_id % 20 + 1 AS rank, {array([*rules.PROGRAMS, 'other.pdf'])}[n % 5 + 1] AS document, doc_id % 7 AS page, "
    + "concat_ws(chr(10), own, " + ", ".join(f"CASE WHEN {t} THEN {x} END" for t, x in fixtures.PROGRAMME_LINES) + ") AS text, "
    + "[" + ", ".join(map(array, fixtures.ASKED_FACETS)) + "][doc_id % 3 + 1] AS facets FROM d)",
    "r AS (SELECT *, string_split(text, chr(10)) AS raw FROM p)",
    "c AS MATERIALIZED (SELECT * EXCLUDE raw, CASE WHEN raw[len(raw)] = '' THEN raw[:len(raw) - 1] ELSE raw END AS lines FROM r)",
    "w AS (SELECT *, unnest(facets) AS facet, generate_subscripts(facets, 1) AS nth FROM c)",
    f"e AS (SELECT doc_id, nth, facet, lines, i, said, nxt, {_fold('said')} AS fold FROM (SELECT doc_id, nth, facet, lines, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS said, unnest(list_append(lines[2:], NULL)) AS nxt FROM w))",
    f"by_line AS (SELECT doc_id, nth, facet, i, {_LINE_QUOTES} AS quote FROM e)",
    *[
        f"{f}_top AS (SELECT doc_id, nth, facet, lines, list_position({_HEADED(f)}, true) AS top FROM w WHERE facet = {lit(f)})"
        for f in evidence.LISTS
    ],
    "tops AS (" + " UNION ALL ".join(f"SELECT * FROM {f}_top WHERE top > 0" for f in evidence.LISTS) + ")",
    f"sections AS (SELECT doc_id, nth, facet, string_split_regex(array_to_string(lines[top:], chr(10)), {_re(evidence.LIST_END)})[1] AS section FROM tops)",
    f"parts AS (SELECT *, string_split(regexp_replace(section, {_re(f'({evidence.ITEM})')}, chr(1) || '\\1', 'g'), chr(1)) AS parts FROM sections)",
    "items AS (SELECT doc_id, nth, facet, CASE WHEN len(parts) = 1 AND facet = 'careers' AND contains(section, ':') THEN [section] ELSE "
    + f"list_filter(list_transform(parts[2:], lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 5 AND NOT regexp_matches(x, {_re(evidence.CUT_OFF)})) END AS items FROM parts)",
    "by_list AS (SELECT doc_id, nth, facet, unnest(range(1, len(items) + 1)) AS i, unnest(items) AS quote FROM items)",
    f"by_name AS (SELECT doc_id, nth, facet, i, said AS quote FROM e JOIN c USING (doc_id) WHERE facet = 'program' AND contains(regexp_replace(said, '\\s+', '', 'g'), {_PROGRAM}))",
    "q AS (SELECT doc_id, nth, facet, quote, min(i) AS i FROM (SELECT * FROM by_line WHERE quote IS NOT NULL UNION ALL SELECT * FROM by_list UNION ALL SELECT * FROM by_name) GROUP BY ALL)",
    f"k AS (SELECT q.*, query_id, rank, document, page, row_number() OVER (PARTITION BY doc_id ORDER BY nth, i, quote) AS ord FROM q JOIN c USING (doc_id) WHERE contains(text, quote) AND length(quote) <= {evidence.MOST_QUOTE} "
    f"AND NOT contains(quote, {lit(rules.REFUSAL)}) AND NOT {any_of('lower(quote)', rules.INJECTIONS)})",
    "o AS (SELECT * FROM k QUALIFY facet <> 'program' OR row_number() OVER (PARTITION BY query_id, document, facet = 'program' ORDER BY page, rank, ord) = 1)",
) + (
    "SELECT query_id, 'E' || row_number() OVER (PARTITION BY query_id ORDER BY rank, ord) AS evidence_id, doc_id::VARCHAR AS chunk_id, facet, quote, "
    + "CASE facet " + " ".join(f"WHEN {lit(f)} THEN nullif(regexp_extract(quote, {_re(v)}, 1), '')" for f, v in evidence.VALUES.items()) + " END AS value FROM o"
)


_CODES = [p[0] for p in rules.PROGRAMS.values()]
_BULLET = {"credits": ("หน่วยกิต", "credits", "学分"), "duration": ("ปี", "years", "年")}


def _fact(code: str, facet: str, k: int) -> str:
    """The lines of one programme's fact in language k, as an expression over v."""
    at, name = _CODES.index(code), rules.FIELD_NAMES[facet][k]
    cited = f"({list(rules.PROGRAMS)[at]}{evidence.PAGE[k]}{at + 1})"
    if facet == "careers":
        return lit(f"{code}:\n(1) {rules.CAREERS[0][k]} {cited}")
    return f"{lit(f'{code}:{chr(10)}- {name}: ')} || (SELECT {facet} FROM v WHERE k = {at}) || {lit(f' {_BULLET[facet][k]} {cited}')}"


def _facts(k: int, *facts: tuple[str, list[str]]) -> str:
    """Facets in language k, each with its programmes."""
    return " || chr(10) || ".join(f"{lit(rules.FIELD_NAMES[f][k] + ':' + chr(10))} || " + " || chr(10) || ".join(_fact(c, f, k) for c in codes) for f, codes in facts)


def _twice(k: int, language: str, *facts: tuple[str, list[str]]) -> str:
    return f"{lit('ภาษาไทย:' + chr(10))} || {_facts(0, *facts)} || {lit(f'{chr(10) * 2}{rules.REFUSALS[language][0]}:{chr(10)}')} || {_facts(k, *facts)}"


_RANKED = "(SELECT string_agg(code || ':' || chr(10) || {} || credits || {} || page || ')', chr(10) ORDER BY credits DESC) FROM (SELECT v.*, {}[k + 1] AS code, {}[k + 1] || {} || (k + 1) AS page FROM v))".format(
    lit(f"- {rules.FIELD_NAMES['credits'][0]}: "), lit(" หน่วยกิต ("), array(_CODES), array(list(rules.PROGRAMS)), lit(evidence.PAGE[0])
)
#: (query_id, answer, sources): the answers that the questions of the fixtures must get from the programmes' numbers; the others are refused.
_ANSWERS = [
    (1, _facts(0, ("credits", ["DSBA"])), 1),
    (2, _twice(1, "en", ("careers", ["AIT"]), ("credits", ["AIT"])), 1),
    (3, _twice(2, "zh", ("credits", ["DSBA"])), 1),
    (4, f"{lit(rules.FIELD_NAMES['credits'][0] + ':' + chr(10) + evidence.ORDERED[0] + chr(10))} || {_RANKED}", 4),
    (5, f"{lit(evidence.FOUND[0] + chr(10))} || {_facts(0, ('credits', ['AIT', 'DSBA']))} || {lit(chr(10) + evidence.MISSING[0] + chr(10) + rules.FIELD_NAMES['recommendation'][0])}", 2),
    (6, lit(evidence.refusal("th")), 0),
    (7, lit(evidence.refusal("en")), 0),
    (8, _facts(0, ("duration", ["IT_inter2565"])), 1),
    (9, lit(evidence.refusal("th")), 0),
    (10, lit(evidence.refusal("th")), 0),
    (11, "NULL", 0),
    (12, lit(evidence.refusal("zh")), 0),
]
STRICT_ANSWER = (
    "WITH t AS (SELECT coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER), 0) % 4 AS k, coalesce(sum(length(text)), 0)::BIGINT AS n FROM documents GROUP BY 1),\n"
    "v AS (SELECT k, 80 + n % 60 AS credits, 2 + n % 5 AS duration FROM t)\n"
    + " UNION ALL ".join(f"SELECT {q}::BIGINT AS query_id, {a} AS answer, {n > 0} AS grounded, {lit('empty_question') if q == 11 else 'NULL'} AS error, {n}::BIGINT AS n_sources" for q, a, n in _ANSWERS)
)


_HEADED = HEADED.replace("'^[^.!?]*[.!?]', 0", "'^[^.!?]*[.!?]'")
_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_N = lambda x: f"len({cased(x)})"
#: From sections (r, sec, body), chunks made (r, sec, i, j, k, x): sentences packed one after the other, as (held, its tokens, what a sentence made whole).
PACKED = lambda size, overlap: [
    f"listed AS (SELECT r, sec, list_filter(list_transform(regexp_extract_all(body, '[^.!?]*[.!?]+|[^.!?]+$'), lambda x: {_STRIP('x')}), lambda x: x <> '') AS s FROM sections)",
    f"said AS MATERIALIZED (SELECT r, sec, i, x, {cased('x')} AS t FROM (SELECT r, sec, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS x FROM listed))",
    "pack AS (SELECT r, sec, 0::BIGINT AS i, '' AS held, 0::BIGINT AS n, []::VARCHAR[] AS made FROM sections UNION ALL "
    f"SELECT p.r, p.sec, s.i, CASE WHEN len(t) > {size} THEN '' WHEN held <> '' AND n + len(t) > {size} THEN array_to_string((" + cased("held") + f")[-{overlap}:], ' ') || ' ' || x WHEN held <> '' THEN trim(held || ' ' || x) ELSE x END, "
    f"CASE WHEN len(t) > {size} THEN 0 WHEN held <> '' AND n + len(t) > {size} THEN len(" + cased("array_to_string((" + cased("held") + f")[-{overlap}:], ' ') || ' ' || x") + ") ELSE n + len(t) END, "
    f"CASE WHEN len(t) > {size} THEN list_concat(CASE WHEN held <> '' THEN [held] ELSE []::VARCHAR[] END, list_transform(range(0, len(t), {size - overlap}), lambda k: array_to_string(t[k + 1:k + {size}], ' '))) "
    f"WHEN held <> '' AND n + len(t) > {size} THEN [held] ELSE []::VARCHAR[] END FROM pack p JOIN said s ON s.r = p.r AND s.sec = p.sec AND s.i = p.i + 1)",
    "ends AS (SELECT r, sec, max(i) AS i FROM pack GROUP BY ALL)",
    "made AS (SELECT r, sec, i, 0 AS j, unnest(made) AS x, unnest(range(1, len(made) + 1)) AS k FROM pack UNION ALL SELECT r, sec, i, 1, held, 0 FROM pack JOIN ends USING (r, sec, i) WHERE held <> '')",
]
SECTION_CHUNKS = cte(
    "RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents)",
    f"w AS (SELECT r, doc_id, source, text, {_HEADED} AS whole FROM d)",
    f"short AS (SELECT r, doc_id, {_STRIP('whole')} AS whole, {_N('whole')} AS n FROM w WHERE {_N('whole')} <= 100)",
    f"sections AS (SELECT r, doc_id, 1 AS sec, {_STRIP(lit('# ') + ' || source')} AS heading, 1 AS level, {_STRIP(lit('# ') + ' || source || chr(10) || text')} AS body FROM w WHERE {_N('whole')} > 100 "
    f"UNION ALL SELECT r, doc_id, 2, 'Summary' || chr(10) || '-----', 2, {_STRIP('whole[length(source) + length(text) + 6:]')} FROM w WHERE {_N('whole')} > 100)",
    *PACKED(100, 20),
    "numbered AS (SELECT r, sec, x, row_number() OVER (PARTITION BY r ORDER BY sec, i, j, k) - 1 AS nth, row_number() OVER (PARTITION BY r, sec ORDER BY i, j, k) AS in_sec FROM made)",
) + (
    "SELECT doc_id, 0 AS chunk_index, n::INTEGER AS chunk_tokens, NULL AS heading, NULL::INTEGER AS heading_level, md5(whole) AS digest FROM short UNION ALL "
    f"SELECT doc_id, nth::INTEGER, {_N('x')}::INTEGER, CASE WHEN in_sec = 1 THEN heading END, CASE WHEN in_sec = 1 THEN level END, md5({_STRIP('x')}) FROM numbered JOIN sections USING (r, sec) WHERE {_N('x')} >= 10"
)
#: Fetched pages as chunks: none of them has headings.
WEB_CHUNKS = (
    "WITH RECURSIVE "
    + ",\n".join(
        [
            *WEB,
            f"g AS (SELECT row_number() OVER () AS r, url, title, text, {_N('text')} AS n FROM t WHERE text <> '')",
            "sections AS (SELECT r, 1 AS sec, text AS body FROM g WHERE n > 500)",
            *PACKED(500, 50),
            f"sized AS (SELECT r, {_N('x')} AS n FROM made WHERE {_N('x')} >= 50 UNION ALL SELECT r, n FROM g WHERE n <= 500)",
        ]
    )
    + " SELECT url, title, 'web' AS extractor, count(*) AS n_chunks, sum(sized.n)::BIGINT AS n_tokens FROM sized JOIN g USING (r) GROUP BY url, title"
)


def _letters(text: str) -> str:
    return f"list_transform(string_split_regex('abcdefghijklmnopqrstuvwxyz', ''), lambda c: (length(lower({text})) - length(replace(lower({text}), c, '')))::DOUBLE)"


def _best(source: str, k: int) -> str:
    return f"(SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM {source}) WHERE rank <= {k})"


RETRIEVER_VECTORS = cte(
    *ENHANCED_OF(BATCH, "source"),
    f"ld AS MATERIALIZED (SELECT id, {_letters("coalesce(text, '')")} AS v FROM d)",
    f"lq AS MATERIALIZED (SELECT query_id, {_letters("coalesce(query, '')")} AS v FROM q)",
    "cs AS (SELECT query_id, id, CASE WHEN list_sum(ld.v) = 0 OR list_sum(lq.v) = 0 THEN 0.0 ELSE round(list_cosine_similarity(ld.v, lq.v), 6) + 0.0 END AS score FROM ld, lq)",
    f"hy AS (SELECT coalesce(e.query_id, v.query_id) AS query_id, coalesce(e.id, v.id) AS id, round(0.4 * coalesce(e.score, 0) + 0.6 * coalesce(v.score, 0), 6) AS score "
    f"FROM {_best('a', 10)} e FULL JOIN {_best('cs', 10)} v ON e.query_id = v.query_id AND e.id = v.id)",
) + f"SELECT *, 'vector' AS strategy FROM {_best('cs', 5)} UNION ALL SELECT *, 'hybrid' FROM {_best('hy', 5)} UNION ALL SELECT *, 'unheard of' FROM {_best('a', 5)}"


ORACLES: dict[str, str] = {
    "html_parsed": cte(*WEB) + "SELECT page_id, title, length(text)::INT AS n_chars, md5(text) AS digest FROM t",
    "document_report": cte(*WEB, "c AS (SELECT url AS document, regexp_replace(text, '[ \\t]+(\\n|$)', '\\1', 'g') AS text FROM t)")
    + "SELECT document, count(nullif(text, '')) AS pages, sum(length(text))::BIGINT AS n_chars, max(CASE WHEN text = '' THEN 'SourceError' END) AS error_type FROM c GROUP BY document",
    "char_chunks": chunked(1000, 150),
    "query_plan": PLAN,
    "tfidf_batch_topk": cte(*base(BATCH), "b AS (SELECT query_id, id, round(sum(tf / greatest(dl, 1) * ln(n / df) * qtf), 6) AS score FROM qt JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL)") + _top("b", 5, "query_id, id, score"),
    "hybrid_batch_topk": cte(
        *bm25(BATCH, 10),
        VECTORS.format(test="x.vec_id % 50 = 0"),
        "vt AS (SELECT * FROM (SELECT query_id // 50 AS query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM v) WHERE rank <= 10)",
        "u AS (SELECT coalesce(hits.query_id, vt.query_id) AS query_id, coalesce(hits.id, vt.id) AS id, coalesce(hits.score, 0) AS keyword_score, coalesce(vt.score, 0) AS vector_score FROM hits FULL JOIN vt ON hits.id = vt.id AND hits.query_id = vt.query_id)",
        "m AS (SELECT *, round(0.4 * keyword_score + 0.6 * vector_score, 6) AS score FROM u)",
    )
    + _top("m", 5, "query_id, id, keyword_score, vector_score, score"),
    "retriever_vectors_topk": RETRIEVER_VECTORS,
    "retriever_topk": cte(
        *bm25(ONE, 5),
        "t AS (SELECT query_id, id, round(sum(tf / greatest(dl, 1) * ln(n / df) * qtf), 6) AS score FROM qt JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL)",
    )
    + "SELECT id, score, rank, 'bm25' AS strategy FROM hits UNION ALL SELECT id, score, rank, 'keyword' FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM t) WHERE rank <= 5",
    "enhanced_batch_topk": cte(*ENHANCED_OF(BATCH, "source")) + _top("a", 5, "query_id, id, score, bm25, phrase, keyword, metadata, number_date, english"),
    "enhance_rules": cte(ASKED, f"r AS (SELECT *, '1. ' || question || {lit(' ' + rules.EXPAND_MORE)} || chr(10) || '2. ' || array_to_string({SUB_QUESTIONS}, ' | ') || chr(10) || '3. ' || {KEYWORDS} AS reply FROM q)", *PARSED)
    + "SELECT query_id, md5(expanded) AS expanded, len(decomposed)::INT AS n_decomposed, keyword_focused, md5(array_to_string(variants, '|')) AS variants FROM z",
    "enhance_reply": cte(f"r AS (SELECT query_id::BIGINT AS query_id, question, reply FROM {values(fixtures.REPLIES, 'query_id, question, reply')} UNION ALL SELECT conv_id * 1000 + turn + 1000, text, {REPLY} FROM conversations WHERE text IS NOT NULL)", *PARSED)
    + "SELECT query_id, expanded, array_to_string(decomposed, '|') AS decomposed, keyword_focused, coalesce(array_to_string(variants, '|'), '') AS variants FROM z",
    "sub_questions": cte(ASKED) + f"SELECT query_id, array_to_string({SUB_QUESTIONS}, '|') AS parts, {KEYWORDS} AS keywords FROM q",
    "user_prompts": cte(
        "said AS (SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant'))",
        "h AS (SELECT *, coalesce(list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), []) AS history FROM said)",
        f"x AS (SELECT *, CASE WHEN len(history) = 0 THEN {lit(rules.NO_HISTORY)} ELSE array_to_string(list_transform(list_filter(history, lambda t: {TRIM('t.text')} <> ''), lambda t: upper(t.role) || ': ' || {TRIM('t.text')}), chr(10)) END AS lines FROM h WHERE role = 'user')",
    )
    + f"SELECT conv_id, turn, md5({lit(rules.HISTORY_TITLE)} || chr(10) || lines || chr(10) || chr(10) || 'CONTEXT:' || chr(10) || chr(10) || chr(10) || 'QUESTION:' || chr(10) || {TRIM('text')} || chr(10) || chr(10) || {lit(rules.USER_PROMPT_END)}) AS digest FROM x",
    "answer_language": cte(ALL_QUESTIONS, f"x AS (SELECT *, {LANGUAGE('question')} AS l FROM q)")
    + f"SELECT query_id, {REFUSED} AS refusal, md5(CASE WHEN l = 'th' THEN {lit(rules.THAI_ONCE)} ELSE chr(10) || {lit("REQUIRED BILINGUAL OUTPUT: a complete Thai answer under 'ภาษาไทย', then the equivalent answer in ")} || {NAMED} || {lit('. Both keep the same facts, numbers and qualifications; use only CONTEXT evidence.')} END) AS instruction FROM x",
    "prompt_context": cte(*bm25(BATCH, 3), "k AS (SELECT hits.*, text, source FROM hits JOIN d USING (id))", f"c AS (SELECT query_id, string_agg({SOURCE_BLOCK}, chr(10) || chr(10) ORDER BY rank) AS context FROM k GROUP BY query_id)")
    + "SELECT query_id, md5(context) AS context, md5('บริบทจากเอกสาร:' || chr(10) || context || chr(10) || chr(10) || 'คำถาม: ?' || chr(10) || chr(10) || 'คำตอบ:') AS prompt FROM c",
    "search_report": cte(*bm25(BATCH, 3)) + "SELECT query_id, count(*) AS result_count, string_agg(id || ':' || source, ',' ORDER BY rank) AS results FROM hits JOIN d USING (id) GROUP BY query_id",
    "index_report": cte(*base(ONE), "h AS (SELECT sha256(doc_id::VARCHAR || chr(0) || coalesce(text, '') || chr(0)) AS x FROM documents)")
    + "SELECT n, n_tokens::BIGINT AS n_tokens, (SELECT count(DISTINCT doc_id) FROM documents) AS n_documents, 0::BIGINT AS n_errors, (SELECT sum(('0x' || substr(x, 1, 15))::UBIGINT)::HUGEINT::VARCHAR FROM h) AS digest_0 FROM s",
    "query_variants": f"SELECT conv_id, turn, len({variants_of('text')})::INT AS n, md5(array_to_string({variants_of('text')}, '|')) AS digest FROM conversations WHERE role = 'user'",
    "multi_query": cte(
        f"vs AS (SELECT item_id, {variants_of('text')} AS v FROM benchmark)",
        "vx AS (SELECT item_id, v, unnest(range(len(v))) AS variant FROM vs)",
        *bm25("SELECT item_id * 100 + variant AS query_id, v[variant + 1] AS query FROM vx", 5),
        "w0 AS (SELECT query_id // 100 AS query_id, query_id % 100 AS variant, hits.id, hits.score, rank, substring(text, 1, 200) AS start FROM hits JOIN d USING (id))",
        "w1 AS (SELECT * FROM w0 QUALIFY row_number() OVER (PARTITION BY query_id, start ORDER BY variant, rank) = 1)",
    )
    + "SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, variant, rank)::INT AS rank FROM w1) WHERE rank <= 5",
    "open_answer": cte(*OPEN)
    + f"SELECT g.query_id, md5(coalesce({TRIM('x.text')}, {lit(rules.REFUSAL)})) AS digest, passed, confidence, n_sources FROM g LEFT JOIN x USING (query_id) LEFT JOIN n USING (query_id)",
    "strict_answer": STRICT_ANSWER,
    "selection_validate": f"WITH r AS (SELECT * FROM {values([(t,) for t in fixtures.SELECTIONS], 'raw')}), "
    "j AS (SELECT raw, CASE WHEN json_valid(raw) THEN raw END AS doc FROM r), "
    "t AS (SELECT raw, CASE WHEN json_type(doc) = 'OBJECT' AND json_keys(doc) = ['evidence_ids'] AND json_type(doc, '$.evidence_ids') = 'ARRAY' THEN json_extract(doc, '$.evidence_ids[*]') END AS items FROM j), "
    "c AS (SELECT raw, items, list_transform(items, lambda x: json_extract_string(x, '$')) AS ids FROM t) "
    "SELECT raw, CASE WHEN items IS NULL OR len(list_filter(items, lambda x: json_type(x) <> 'VARCHAR')) > 0 THEN 'invalid_evidence_response' "
    "WHEN len(list_filter(ids, lambda x: NOT list_contains(['E1', 'E2'], x))) > 0 THEN 'unknown_evidence_id' "
    "WHEN NOT list_contains(ids, 'E1') OR NOT list_contains(ids, 'E2') THEN 'incomplete_evidence_selection' END AS error FROM c",
    "bm25_topk": cte(*bm25(ONE, 10)) + "SELECT id, score, rank FROM hits",
    "bm25_batch_topk": cte(*bm25(BATCH, 5)) + "SELECT query_id, id, score, rank FROM hits",
    "evidence_found": EVIDENCE_FOUND,
    "section_chunks": SECTION_CHUNKS,
    "load_web_pages": WEB_CHUNKS,
    "strict_answer": STRICT_ANSWER,
    "selection_validate": f"WITH v AS ({EVIDENCE_FOUND}) SELECT query_id, count(*) AS n_ids, CASE query_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'incomplete_evidence_selection' WHEN 2 THEN 'unknown_evidence_id' ELSE 'invalid_evidence_response' END AS error FROM v GROUP BY query_id",
    "bm25_stored_batch_topk": cte(*bm25(BATCH, 5)) + "SELECT query_id, id, score, rank FROM hits",
    "bm25_stored_keywords_topk": cte(*bm25(SHORT, 5)) + "SELECT query_id, id, score, rank FROM hits",
    "bm25_strict_stored_topk": cte(*STRICT(SHORT, 5)) + "SELECT query_id, id, score, confidence, exact_match, matched_terms, rank FROM hits",
    "bm25_strict_topk": cte(*STRICT(ONE, 10)) + "SELECT id, score, confidence, exact_match, matched_terms, rank FROM hits",
    "tfidf_topk": cte(*base(ONE), "b AS (SELECT query_id, id, round(sum(tf / greatest(dl, 1) * ln(n / df) * qtf), 6) AS score FROM qt JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL)") + _top("b", 10, "id, score"),
    "vector_topk": cte(VECTORS.format(test="x.vec_id = 0")) + _top("v", 10, "id, score"),
    "vector_index_exact_topk": cte(VECTORS.format(test="x.vec_id % 50 = 0")) + _top("v", 5, "query_id, id, score"),
    "vector_batch_topk": cte(VECTORS.format(test="x.vec_id % 50 = 0")) + _top("v", 5, "query_id, id, score"),
    "hybrid_topk": cte(
        *bm25(ONE, 20),
        VECTORS.format(test="x.vec_id = 0"),
        "vt AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM v) WHERE rank <= 20)",
        "u AS (SELECT 0 AS query_id, coalesce(hits.id, vt.id) AS id, coalesce(hits.score, 0) AS keyword_score, coalesce(vt.score, 0) AS vector_score FROM hits FULL JOIN vt ON hits.id = vt.id)",
        "m AS (SELECT *, round(0.4 * keyword_score + 0.6 * vector_score, 6) AS score FROM u)",
    )
    + _top("m", 10, "id, keyword_score, vector_score, score"),
    "enhanced_topk": ENHANCED,
    "exact_match": f"SELECT item_id AS passage, doc_id AS id FROM benchmark b JOIN documents d ON contains({normal('d.text')}, {normal('b.text')}) WHERE length({normal('b.text')}) >= 3",
    "token_counts": f"SELECT doc_id, len({tokens('text')})::BIGINT AS n_tokens, len({cased('text')})::BIGINT AS n_cased FROM documents",
    "term_df": cte(*base(ONE)) + "SELECT term, df FROM f",
    "term_tf": cte(*base(ONE)) + "SELECT term, sum(tf)::BIGINT AS tf, max(tf) AS max_tf FROM p GROUP BY term",
    "corpus_stats": cte(*base(ONE)) + "SELECT n, n_tokens::BIGINT AS n_tokens, round(avgdl, 6) AS avgdl FROM s",
    "index_roundtrip": cte(*base(ONE)) + "SELECT n, n_tokens::BIGINT AS n_tokens, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM p) AS n_postings, (SELECT count(*) FROM f) AS n_terms FROM s",
    "fingerprint": "WITH h AS (SELECT sha256(doc_id::VARCHAR || chr(0) || coalesce(text, '') || chr(0)) AS x FROM documents) SELECT count(*) AS n_chunks, "
    + ", ".join(f"sum(('0x' || substr(x, {1 + 15 * k}, 15))::UBIGINT)::HUGEINT::VARCHAR AS digest_{k}" for k in range(4))
    + " FROM h",
    "ordered_digest": cte(
        "l0 AS (SELECT doc_id AS k, sha256(doc_id::VARCHAR || chr(0) || coalesce(text, '') || chr(0)) AS d FROM documents)",
        *[f"l{n + 1} AS (SELECT k // 1024 AS k, sha256(string_agg(d, '' ORDER BY k, d)) AS d FROM l{n} GROUP BY k // 1024)" for n in range(4)],
    )
    + "SELECT sha256(coalesce(string_agg(d, '' ORDER BY k, d), '')) AS digest FROM l4",
    "char_ngrams": cte(*base(ONE), "c AS (SELECT term, count(*) AS c FROM w GROUP BY term)", "g AS (SELECT unnest(list_concat(list_transform(range(1, length(term)), lambda i: substring(term, i, 2)), list_transform(range(1, length(term) - 1), lambda i: substring(term, i, 3)))) AS gram, c FROM c)")
    + "SELECT gram, sum(c)::BIGINT AS n FROM g GROUP BY gram",
    "strict_terms": f"SELECT doc_id, len({strict_terms('text')})::BIGINT AS n_terms, md5(array_to_string({strict_terms('text')}, ' ')) AS digest FROM documents",
    "normalized_text": f"SELECT doc_id, md5({normal('text')}) AS digest FROM documents",
    "clean_text": "SELECT doc_id, md5(trim(regexp_replace(text, ' +(\\n|$)', '\\1', 'g'), ' ' || chr(10))) AS digest, md5(lower(regexp_replace(text, '\\s+', '', 'g'))) AS compact_digest FROM documents",
    "token_windows": f"WITH t AS (SELECT doc_id, {cased('text')} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), 80)) AS i FROM t) "
    "SELECT doc_id, (i // 80)::INT AS window, len(w[i + 1:i + 100])::BIGINT AS n, md5(array_to_string(w[i + 1:i + 100], ' ')) AS digest FROM s",
    "sentences": f"SELECT doc_id, len({SENTENCE})::BIGINT AS n, md5(array_to_string({SENTENCE}, '|')) AS digest FROM documents",
    "language_counts": cte(QUESTIONS, "e AS (SELECT text FROM documents UNION ALL SELECT question FROM q)")
    + "SELECT CASE WHEN regexp_matches(text, '[぀-ヿ]') THEN 'ja' WHEN regexp_matches(text, '[가-힯]') THEN 'ko' WHEN regexp_matches(text, '[㐀-鿿]') THEN 'zh' "
    "WHEN regexp_matches(text, '[฀-๿]') THEN 'th' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'th' END AS language, count(*) AS n FROM e GROUP BY 1",
    "html_text": f"SELECT page_id, md5({HTML}) AS digest, regexp_extract(html, '(?is)<title>([^<]*)</title>', 1) AS title FROM pages",
    "folded_text": "SELECT doc_id, md5(regexp_replace(lower(text), '[\\x{E000}-\\x{F8FF}\\x{0E30}-\\x{0E3A}\\x{0E40}-\\x{0E4E}\\s]', '', 'g')) AS digest FROM documents",
    "hidden_markers": "WITH m AS (SELECT conv_id, turn, regexp_replace('[SOURCE 1] ' || text || '  [ source 12 ]' || chr(10) || 'end  of it [SOURCE 3]', '(?i)[ \\t]*\\[\\s*SOURCE\\s+\\d+\\s*\\]', '', 'g') AS t FROM conversations) "
    "SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(t, '[ \\t]+(\\n)', '\\1', 'g'), ' {2,}', ' ', 'g'))) AS digest FROM m",
    "redacted_text": "SELECT doc_id, md5(replace(text, 'th', '[REDACTED]')) AS digest FROM documents",
    "document_keys": "WITH k AS (SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem FROM pages) "
    "SELECT page_id, CASE WHEN trim(regexp_replace(stem, '[^\\p{L}\\p{N}]+', '_', 'g'), '_') = '' THEN 'document' ELSE trim(regexp_replace(stem, '[^\\p{L}\\p{N}]+', '_', 'g'), '_') END AS document, "
    "CASE WHEN page_id % 3 > 0 THEN 'p' || page_id WHEN page_id % 2 + 1 > 1 THEN 'pna_u' || lpad((page_id % 5)::VARCHAR, 2, '0') ELSE 'pna' END AS page FROM k",
    "joined_tokens": f"SELECT doc_id, md5(array_to_string({cased("coalesce(text, '')")}, ' ')) AS digest FROM documents",
    "confidence_bands": cte(*bm25(BATCH, 1), "g AS (SELECT score >= 1 AS passed, round(greatest(0, least(1, CASE WHEN score >= 1 THEN least(score / 3, 1) ELSE score END)), 6) AS c FROM hits)")
    + "SELECT CASE WHEN c >= 0.7 THEN 'high' WHEN c >= 0.4 THEN 'medium' ELSE 'low' END AS band, passed, count(*) AS n FROM g GROUP BY 1, 2",
    "source_names": "SELECT coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN source WHEN doc_id % 3 = 0 THEN '' END, ''), nullif(CASE WHEN doc_id % 5 > 0 THEN lang END, ''), 'Unknown') AS source, count(*) AS n FROM documents GROUP BY 1",
    "glyph_repair": cte(
        f"g AS (SELECT * FROM {values(fixtures.GLYPHS, 'family, outline, code')} WHERE starts_with(family, {lit(glyphs.FAMILY)}))",
        f"v AS (SELECT * FROM {values(list(glyphs.VERIFIED.items()), 'outline, target')})",
        "x AS (SELECT family, outline, code AS target FROM g WHERE code BETWEEN 3585 AND 3662 UNION ALL SELECT family, outline, target FROM g JOIN v USING (outline) WHERE code BETWEEN 57344 AND 63743)",
        "o AS (SELECT family, outline, min(target) AS target FROM x GROUP BY ALL HAVING count(DISTINCT target) = 1)",
        "m AS (SELECT family, code, min(target) AS target FROM g JOIN o USING (family, outline) WHERE code BETWEEN 57344 AND 63743 GROUP BY ALL HAVING count(DISTINCT target) = 1)",
        "p AS (SELECT family, string_agg(chr(code), '' ORDER BY code) AS a, string_agg(chr(target), '' ORDER BY code) AS b FROM m GROUP BY family)",
        f"t AS (SELECT -id::BIGINT AS id, family, text FROM {values(fixtures.GLYPH_TEXTS, 'id, family, text')} UNION ALL SELECT doc_id, {GLYPH_FAMILY}, {GLYPH_TEXT} FROM documents)",
    )
    + "SELECT id, family, md5(coalesce(translate(text, a, b), text)) AS digest FROM t LEFT JOIN p USING (family)",
    "url_predicate": "SELECT regexp_extract(url, '^https?://([^/ ]+)', 1) AS host, count(*) AS n FROM pages WHERE regexp_matches(url, '^https?://[^/ ]+') GROUP BY 1",
    "question_types": "SELECT conv_id, turn, CASE " + " ".join(f"WHEN {any_of('lower(text)', terms)} THEN '{name}'" for name, terms in rules.QUESTION_TYPES) + " ELSE 'general' END AS kind FROM conversations WHERE role = 'user'",
    "query_signals": "SELECT conv_id, turn, "
    + ", ".join(
        f"array_to_string({x}, '|') AS {n}"
        for n, x in {
            "tokens": tokens("text"),
            "keywords": f"list_filter({tokens('text')}, lambda t: NOT list_contains({array(rules.OPEN_STOP_WORDS)}, t))",
            "phrases": f"list_transform(regexp_extract_all(text, {lit(QUOTED)}), lambda x: substring(x, 2, length(x) - 2))",
            "numbers": f"regexp_extract_all(text, {lit(rules.NUMBER)})",
            "dates": f"regexp_extract_all(text, {lit(rules.DATE)})",
            "english_terms": "list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: regexp_matches(x, '^[a-zA-Z]{2,}$'))",
            "thai_numbers": f"regexp_extract_all(text, {lit(rules.THAI_NUMBER)})",
        }.items()
    )
    + ", CASE "
    + " ".join(f"WHEN {any_of('lower(text)', terms)} THEN '{name}'" for name, terms in rules.QUESTION_TYPES)
    + " ELSE 'general' END AS question_type FROM conversations",
    "expand_query": cte(ALL_QUESTIONS) + f"SELECT query_id, {appended([(any_of(LOW_QUESTION, t), e) for t, e in rules.EXPANSIONS], 'question')} AS expanded FROM q",
    "alias_query_rules": cte(ALL_QUESTIONS) + f"SELECT query_id, {appended([(alias_test(n), e) for n, e in rules.ALIASES], 'trim(question)')} AS aliased FROM q",
    "alias_query": cte(ALL_QUESTIONS) + f"SELECT query_id, {appended([(alias_test(n), e) for n, e in rules.ALIASES], 'trim(question)')} AS aliased FROM q",
    "route_query": cte(ALL_QUESTIONS) + f"SELECT query_id, {ROUTE} AS document FROM q",
    "history_window": cte(*HISTORY) + "SELECT conv_id, turn, len(history)::BIGINT AS n_history, md5(array_to_string(list_transform(history, lambda x: x.role || ':' || x.text), '|')) AS digest FROM h WHERE role = 'user'",
    "retrieval_query": cte(*HISTORY, "o AS (SELECT *, list_transform(list_filter(history, lambda x: x.role = 'user' AND trim(x.text) <> ''), lambda x: x.text) AS own FROM h WHERE role = 'user')")
    + "SELECT conv_id, turn, md5(array_to_string(list_append(own[greatest(1, len(own) - 2):], text), chr(10))) AS digest FROM o",
    "gate_open": cte(*bm25(BATCH, 1)) + "SELECT query_id, score AS top_score, score >= 1 AS passed, round(greatest(0, least(1, CASE WHEN score >= 1 THEN least(score / 3, 1) ELSE score END)), 6) AS confidence FROM hits",
    "gate_strict": cte(*STRICT(BATCH, 5)) + "SELECT query_id, id, score, confidence, rank FROM hits WHERE confidence >= 0.55",
    "context_pack": cte(*RANKED, f"u AS (SELECT query_id, id, rank, sum(length({BLOCK})) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM k)") + "SELECT query_id, id, rank, used::BIGINT AS used FROM u WHERE used <= 4000",
    "source_dedupe": cte(*RANKED) + "SELECT query_id, id, source, rank FROM k QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1",
    "prefix_dedupe": cte(*RANKED) + "SELECT query_id, id, rank FROM k QUALIFY row_number() OVER (PARTITION BY query_id, substring(text, 1, 200) ORDER BY rank) = 1",
    "citations": cte(*RANKED) + "SELECT query_id, source AS document, id % 3 AS page, min(rank) AS first_rank, string_agg(id::VARCHAR, ',' ORDER BY rank) AS chunk_ids FROM k GROUP BY 1, 2, 3",
    "diverse_hits": cte(*RANKED, "t AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS turn FROM k)", "o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn > 1, rank)::INT AS place FROM t)") + "SELECT query_id, id, place FROM o WHERE place <= 5",
    "conflicts": cte(FACTS) + "SELECT lang, source, coalesce(string_agg(DISTINCT value, ',' ORDER BY value), '') AS values, count(DISTINCT value) > 1 AS conflict FROM f GROUP BY ALL",
    "fact_ranking": cte(FACTS, "b AS (SELECT lang, source, count(*)::BIGINT AS number FROM f GROUP BY ALL)") + "SELECT lang, source, number, row_number() OVER (PARTITION BY lang ORDER BY number DESC, source)::INT AS place FROM b",
    "context_bounds": cte(*RANKED, "c AS (SELECT query_id, sum(length(text))::BIGINT AS chars, count(*) AS rows FROM k GROUP BY 1)") + "SELECT *, chars <= 24000 AND rows <= 80 AS fits FROM c",
    "eval_score": cte(*CASES) + "SELECT item_id, refused, answer_correct, citation_correct, answer_correct AND citation_correct AS passed, n_missing FROM r",
    "eval_summary": cte(*CASES) + "SELECT count(*) AS cases, count_if(answer_correct AND citation_correct)::BIGINT AS passed, count_if(answer_correct)::BIGINT AS answers_correct, count_if(citation_correct)::BIGINT AS citations_correct FROM r",
    "pipeline_stats": "SELECT count(*) AS total_queries, count_if(event_type <> 'error')::BIGINT AS successful, count_if(event_type = 'error')::BIGINT AS failed, round(avg(value) FILTER (WHERE event_type <> 'error'), 6) AS avg_time FROM events",
    "label_precision": cte(*bm25(BATCH, 10)) + "SELECT rank, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM hits JOIN labels ON id = doc_id GROUP BY rank",
    "stream_index": cte(*base(ONE)) + "SELECT n, n_tokens::BIGINT AS n_tokens, (SELECT count(*) FROM f) AS n_terms, round(avgdl, 6) AS avgdl FROM s",
    "stream_index_updates": cte(
        "c AS (SELECT CASE WHEN lang = 'de' THEN coalesce(text, '') || ' amended text' ELSE text END AS text FROM documents WHERE source IS DISTINCT FROM 'src3')",
        f"d AS (SELECT row_number() OVER () AS r, {tokens('text')} AS toks FROM c WHERE text IS NOT NULL)",
        "w AS (SELECT r, unnest(list_distinct(toks)) AS term FROM d)",
    )
    + "SELECT term, count(*) AS df, count(*) AS df_compacted, (SELECT count(*) FROM d) AS n, (SELECT sum(len(toks))::BIGINT FROM d) AS n_tokens FROM w GROUP BY term",
    "stream_conversations": "WITH m AS (SELECT conv_id, turn, list(role || ':' || coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS h, "
    "count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS n FROM conversations WHERE role IN ('user', 'assistant')) "
    "SELECT conv_id, turn, coalesce(len(h), 0)::BIGINT AS n_sent, md5(coalesce(array_to_string(h, '|'), '')) AS digest, n::BIGINT AS n_stored FROM m",
    "stream_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_stats": "SELECT event_type, count(*) AS n, count(value) AS n_values, round(avg(value), 6) AS avg_value FROM events GROUP BY event_type",
}
