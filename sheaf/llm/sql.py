"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, lines, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT r, doc_id, i, lines[i] AS line, translate(regexp_replace(lines[i], '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{_UP}', '{_LOW}') AS key FROM l),
hot AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
j AS (SELECT k.r, k.doc_id, k.i, k.line, hot.key IS NOT NULL AND k.doc_id IS DISTINCT FROM hot.top AS gone FROM k LEFT JOIN hot ON k.key = hot.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY r
"""

OP3 = f"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_PLAIN}') AS w FROM benchmark),
c AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM c),
sizes AS (SELECT DISTINCT n FROM g),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_PLAIN}') AS w FROM documents),
s AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT DISTINCT s.r, s.i, s.n, g.item_id FROM s JOIN g ON g.n = s.n AND g.gram = array_to_string(s.w[s.i:s.i + s.n - 1], ' ')),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
named AS (SELECT DISTINCT r, item_id::VARCHAR AS name FROM hits WHERE item_id IS NOT NULL),
items AS (SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM named GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)
"""

#: Shares of characters inside repeats of an earlier window, by window length: the same bounds as in quality_rules.
_RULES = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: words with their places; a window is the string of a word and those after it
_U = f"""d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
u AS MATERIALIZED (SELECT r, unnest(regexp_extract_all(text, '{_WORD}')) AS x, generate_subscripts(regexp_extract_all(text, '{_WORD}'), 1) AS p FROM d)"""


def _windows(n: int) -> str:
    frame = f"OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
    return f"(SELECT r, p, g FROM (SELECT r, p, string_agg(x, ' ') {frame} AS g, count(*) {frame} AS c FROM u) WHERE c = {n})"


def _covered(flagged: str, n: int) -> str:
    return f"(SELECT DISTINCT r, unnest(range(p, p + {n})) AS p FROM {flagged})"


_SHARES = ",\n".join(
    f"c{n} AS (SELECT r, sum(length(x)) AS dup FROM {_covered(f'(SELECT r, p, row_number() OVER (PARTITION BY r, g ORDER BY p) AS k FROM {_windows(n)} QUALIFY k > 1)', n)} JOIN u USING (r, p) GROUP BY r)" for n in _RULES
)
OP1 = f"""
WITH {_U},
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
m AS (SELECT r, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS late, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars FROM l WHERE regexp_matches(line, '{_WORD}')),
n AS (SELECT r, count(*) AS n_lines, count_if(late) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE late), 0) AS dup_line_chars FROM m GROUP BY r),
w AS (SELECT r, count(*) AS n_words, sum(length(x)) AS word_chars FROM u GROUP BY r),
h AS (SELECT r, count(*) AS n_repeat_words FROM {_covered(f"(SELECT r, p, count(*) OVER (PARTITION BY r, g) AS k FROM {_windows(8)} QUALIFY k > 1)", 8)} GROUP BY r),
{_SHARES},
b AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars,
  {", ".join(f"coalesce(c{n}.dup, 0)::BIGINT AS dup_{n}gram_chars" for n in _RULES)}
  FROM d LEFT JOIN n USING (r) LEFT JOIN w USING (r) LEFT JOIN h USING (r) {" ".join(f"LEFT JOIN c{n} USING (r)" for n in _RULES)}),
s AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND 100 * n_dup_lines <= 30 * n_lines AND 100 * dup_line_chars <= 20 * word_chars AND {" AND ".join(f"100 * dup_{n}gram_chars <= {most} * word_chars" for n, most in _RULES.items())} AS kept FROM s
"""

OP5 = f"""
WITH {_U},
t AS (SELECT r, p, count(*) OVER (PARTITION BY g) AS k FROM {_windows(35)} QUALIFY k > 1),
c AS (SELECT r, p, true AS gone FROM {_covered("t", 35)}),
k AS (SELECT r, count(*) AS n_words, count_if(gone) AS n_removed, string_agg(x, ' ' ORDER BY p) FILTER (WHERE gone IS NULL) AS kept FROM u LEFT JOIN c USING (r, p) GROUP BY r)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{_UP}', '{_LOW}') AS text FROM documents),
u AS MATERIALIZED (SELECT r, unnest(regexp_extract_all(text, '{_WORD}')) AS x, generate_subscripts(regexp_extract_all(text, '{_WORD}'), 1) AS p FROM d),
s AS MATERIALIZED (SELECT DISTINCT r, g FROM {_windows(5)} UNION SELECT r, string_agg(x, ' ' ORDER BY p) FROM u GROUP BY r HAVING count(*) < 5),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * common >= 80 * (a.n + b.n - common)),
reach(r, o) AS (SELECT r, r FROM d UNION SELECT reach.r, e.y FROM reach JOIN e ON e.x = reach.o),
c AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.o GROUP BY reach.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (r) JOIN c USING (r)
"""

_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def _share(count: str, total: str) -> str:
    return f"(1 + (1000000000::HUGEINT * ({count} + 5)) // ({total} + 5 * v))"


OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '{_TERM}')) AS t FROM d),
k AS (SELECT lang, t FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, (SELECT count(*) FROM k WHERE k.lang = l.lang) AS v FROM (SELECT DISTINCT lang FROM d) l),
n AS (SELECT lang, source, t, count(*) AS c FROM w SEMI JOIN k USING (lang, t) GROUP BY ALL),
g AS MATERIALIZED (SELECT lang, source, v, coalesce((SELECT sum(c) FROM n WHERE n.lang = x.lang AND n.source = x.source), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) x JOIN v USING (lang)),
p AS MATERIALIZED (SELECT g.lang, g.source, k.t, coalesce(c, 0) AS c, {_share("coalesce(c, 0)", "total")} AS p FROM g JOIN k ON k.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.t = k.t),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
whole AS (SELECT lang, t, sum(c) AS c FROM n GROUP BY ALL),
q AS (SELECT whole.lang, t, {_share("c", "total")} AS q FROM whole JOIN (SELECT lang, any_value(v) AS v, sum(total) AS total FROM g GROUP BY lang) USING (lang)),
term AS (SELECT lang, source, t AS item, p - q AS value FROM p JOIN q USING (lang, t) WHERE c > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50
"""

_STEPS = []
for _x in range(16):
    for _ in range(4):
        _x = 0xEDB88320 ^ (_x >> 1) if _x & 1 else _x >> 1
    _STEPS.append(_x)
#: the crc32 of a string, half a byte a step, lower half first
_CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, length(x) // 2), lambda k: [('0x' || x[2 * k + 2])::BIGINT, ('0x' || x[2 * k + 1])::BIGINT]))),
  lambda c, b: xor({_STEPS}[(xor(c, b) & 15) + 1]::BIGINT, c >> 4)), 4294967295::BIGINT)"""
OP13 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, coalesce(doc_id::VARCHAR, '') AS id, translate(coalesce(text, ''), '{_UP}', '{_LOW}') AS text FROM documents),
u AS (SELECT r, id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM d),
c AS (SELECT r, w, count(*) AS k, hex(id || ':' || w) AS x FROM u WHERE length(w) >= 7 GROUP BY r, id, w),
h AS (SELECT w, k, {_CRC} AS h FROM c),
m AS (SELECT CASE WHEN h % 31 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, k FROM h),
v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM m WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
i AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
t AS MATERIALIZED (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM i),
short AS (SELECT DISTINCT word, n, rest FROM t),
near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n FROM t a JOIN t b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT s.word, v.word, v.n FROM short s JOIN v ON v.word = s.rest UNION ALL SELECT v.word, s.word, s.n FROM short s JOIN v ON v.word = s.rest),
best AS (SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 10 * v.n THEN other END AS form, CASE WHEN best.n >= 10 * v.n THEN best.n END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS here FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.here WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, here AS root FROM walk JOIN f ON f.word = walk.here WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
"""

_REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", chr(34)), ("&#39;", "''"), ("&#x27;", "''"), ("&nbsp;", " "))
_BLOCKS = "address|aside|blockquote|button|caption|center|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|legend|li|main|menu|nav|ol|p|pre|section|summary|table|tbody|td|tfoot|th|thead|tr|ul"
_DECODED = "x"
for _name, _char in _REFERENCES:
    _DECODED = f"replace({_DECODED}, '{_name}', '{_char}')"
_DECODED = f"regexp_replace({_DECODED}, '&amp;?', '&', 'g')"  # legal without its end, and where a title was cut
#: What the main text must be on pages that mark it as an article and have nothing else in it: not how the tree finds it.
OP6 = f"""
WITH a AS (SELECT row_number() OVER () AS r, page_id, url, regexp_extract(coalesce(html, ''), '(?is)<article[^>]*>(.*)</article>', 1) AS body FROM pages),
b AS (SELECT r, page_id, url, regexp_split_to_array(body, '(?i)</?(?:{_BLOCKS})(?:\\s[^>]*)?>') AS blocks FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(list_transform(list_transform(list_transform(blocks, lambda x: regexp_replace(regexp_replace(x, '(?i)<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g')), lambda x: {_DECODED}),
  lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c
"""

ORACLES: dict[str, str] = {"op6_html_extraction": OP6, "op1_quality_rules": OP1, "op2_line_dedup": OP2, "op3_decontamination": OP3, "op5_substring_dedup": OP5, "op10_ngram_jaccard": OP10, "op11_source_audit": OP11, "op13_spelling_variants": OP13}
