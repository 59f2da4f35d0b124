"""DuckDB SQL for the registered queries, where SQL can express them."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = r"[\x20\x09-\x0D]+"


def _lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


LINE_DEDUP = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM {{docs}}),
k AS (SELECT *, {_lower(f"regexp_replace(regexp_replace(line, '^{BLANKS}', ''), '{BLANKS}$', '')")} AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS dropped FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS kept FROM m GROUP BY doc_id
"""

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BENCHMARK_HITS = rf"""
WITH b AS (SELECT item_id, regexp_extract_all({_lower("text")}, '{WORDS}') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{WORDS}') AS w FROM {{docs}}),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
"""

COLLOCATIONS = rf"""
WITH p AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, {_lower("coalesce(text, '')")} AS text FROM documents),
s AS (SELECT d, lang, row_number() OVER () AS piece, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM (SELECT d, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS x FROM p)),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM s GROUP BY lang),
g AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM s, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size)),
f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT f.lang, f.phrase, f.size, f.a, k, l.a AS l, r.a AS r, (1000000::HUGEINT * f.a * f.a) // (l.a::HUGEINT * r.a) AS score
      FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1) f
      JOIN f l ON l.lang = f.lang AND l.phrase = array_to_string(string_split(f.phrase, ' ')[1:k], ' ') JOIN f r ON r.lang = f.lang AND r.phrase = array_to_string(string_split(f.phrase, ' ')[k + 1:], ' ')),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
x AS (SELECT lang, phrase, max(a) AS top FROM (SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase FROM b WHERE size = 3) GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank FROM b LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase WHERE top IS NULL OR 100 * top < 50 * a)
SELECT o.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN t ON o.lang = t.lang WHERE rank <= 2000"""

#: crc32, which DuckDB lacks, over the bytes of ASCII text: eight steps of the polynomial a byte.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: list_reduce(list_prepend(xor(h, b), range(0, 8)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"


def _paid(state: str, cost: str, edit: str) -> str:
    """A path as one string, cost first: its least is the cheapest, of equally cheap ones the ASCII-least."""
    return f"printf('%09d', substr({state}, 1, 9)::BIGINT + {cost}) || substr({state}, 10) || '{edit}'"


def _step() -> str:
    u = "least(v.pu, " + _paid("least(v.pe, v.ps, v.pa)", "3", "I") + ")"
    a = "least(v.pa, " + _paid("v.iu", "3", "I") + ")"
    keep = lambda state: _paid(f"v.{state}", "v.extra", "K")  # noqa: E731
    rerole = lambda state: _paid(f"v.{state}", "v.extra + 3", "R")  # noqa: E731
    drop = lambda state: _paid(f"v.{state}", "4", "D")  # noqa: E731
    live = lambda test, x: f"CASE WHEN NOT v.gone AND {test} THEN {x} END"  # noqa: E731
    before = "least(v.pe, v.ps, v.ia)"
    return f"""SELECT conv, n + 1 AS n, {drop('pe')} AS pe, least({drop('ps')}, {live("v.init = 's'", keep('pe'))}) AS ps,
   least({drop('iu')}, {live("v.init = 'u'", _paid(before, 'v.extra', 'K'))}, {live("v.init <> 'u'", _paid(before, 'v.extra + 3', 'R'))}) AS pu,
   least({drop('ia')}, {live("v.init = 'a'", keep('iu'))}, {live("v.init <> 'a'", rerole('iu'))}) AS pa
  FROM (SELECT *, {a} AS ia FROM (SELECT *, {u} AS iu FROM (SELECT v.*, f.gone, f.extra, f.init FROM v JOIN f ON f.conv = v.conv AND f.rn = v.n + 1) v) v) v"""


REPAIR = rf"""
WITH RECURSIVE k AS (SELECT *, {_CRC} % 20 AS d FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations)),
c AS (SELECT conv_id, row_number() OVER () AS conv FROM (SELECT DISTINCT conv_id FROM conversations)),
e AS (SELECT c.conv, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(0, CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
      FROM k JOIN c ON c.conv_id IS NOT DISTINCT FROM k.conv_id),
o AS (SELECT *, row_number() OVER w AS rn, regexp_extract(text, '([^ 	-])[ 	-]*$', 1) AS last, row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
        substr(role, 1, 1) AS init, lag(substr(role, 1, 1)) OVER w AS before FROM e WINDOW w AS (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text), copy)),
f AS (SELECT *, last = '' AS blank, last <> '' AND nth > 1 AS dup, last <> '' AND nth = 1 AND last NOT IN ('.', '!', '?') AS cut, last = '' OR nth > 1 AS gone, CASE WHEN last <> '' AND nth = 1 AND last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS extra FROM o),
v AS (SELECT conv, 0::BIGINT AS n, '000000000' AS pe, NULL::VARCHAR AS ps, NULL::VARCHAR AS pu, NULL::VARCHAR AS pa FROM c UNION ALL {_step()}),
w AS (SELECT conv, n, least(pe, {_paid('ps', '6', 'II')}, {_paid('pu', '3', 'I')}, pa) AS path FROM v QUALIFY row_number() OVER (PARTITION BY conv ORDER BY n DESC) = 1),
l AS (SELECT conv, letter, i, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv ORDER BY i) AS rn FROM (SELECT conv, unnest(string_split(substr(path, 10), '')) AS letter, generate_subscripts(string_split(substr(path, 10), ''), 1) AS i FROM w WHERE length(path) > 9)),
m AS (SELECT l.conv, l.i, letter, f.text, f.role, count(*) FILTER (letter <> 'D' AND NOT coalesce(letter = 'K' AND f.init = 's', false)) OVER (PARTITION BY l.conv ORDER BY i) AS said FROM l LEFT JOIN f ON f.conv = l.conv AND f.rn = l.rn AND letter <> 'I'),
r AS (SELECT conv, string_agg(CASE WHEN letter = 'K' THEN role WHEN said % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY i) AS repaired FROM m WHERE letter <> 'D' GROUP BY conv),
h AS (SELECT conv, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || init NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, substr(path, 1, 9)::BIGINT AS cost, substr(path, 10) AS audit,
  sha256(coalesce(repaired, '')) AS repaired_sha256 FROM c JOIN w ON w.conv = c.conv LEFT JOIN h ON h.conv = c.conv LEFT JOIN r ON r.conv = c.conv"""

ORACLES = {
    "op11_collocations": COLLOCATIONS,
    "op12_repair_conversations": REPAIR,
    "op1_line_dedup": f"SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM ({LINE_DEDUP.format(docs='documents')})",
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT page_id, strlen(html) AS payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS top FROM p),
b AS (SELECT h, array_to_string(list_transform(string_split(h, ''), lambda x: lpad(bin(strpos('0123456789abcdef', x) - 1), 4, '0')), '') AS bits FROM (SELECT DISTINCT h FROM p)),
d AS (SELECT h, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        list_sum(list_transform(range(1, 6), lambda j: CASE WHEN substr(bits, 5 * i + j, 1) = '1' THEN 2 ** (5 - j) ELSE 0 END))::INTEGER + 1, 1)), '') AS payload_digest FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to FROM w JOIN d ON w.h = d.h""",
    "op6_link_tool_calls": r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words FROM conversations),
calls AS (SELECT u.conv_id, u.turn, 'assistant' AS role, 'call' AS kind, 'c' || u.turn AS call_id, u.words, u.text,
                 CASE WHEN u.words < 60 THEN 'answer' ELSE 'explain' END AS name, coalesce(a.text, '') AS result, a.turn IS NULL AS unanswered,
                 u.turn >= 2 AND b.turn IS NULL AS dangling
          FROM c u LEFT JOIN c a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
                   LEFT JOIN c b ON b.conv_id = u.conv_id AND b.turn = u.turn - 2 AND b.role = 'user' WHERE u.role = 'user'),
r AS (SELECT conv_id, turn, role, kind, call_id, array_to_string(list_filter([
               CASE WHEN name = 'explain' THEN 'type:words' END, CASE WHEN name = 'explain' AND turn >= 2 THEN 'unexpected:after' END,
               CASE WHEN dangling THEN 'reference:c' || (turn - 2) END, CASE WHEN unanswered THEN 'no result' END], lambda x: x IS NOT NULL), ',') AS problems,
             CASE WHEN turn >= 2 THEN json_object('arguments', json_object('after', '$c' || (turn - 2), 'text', text, 'words', words), 'id', call_id, 'name', name, 'refs', ['c' || (turn - 2)], 'result', result, 'role', role)
                  ELSE json_object('arguments', json_object('text', text, 'words', words), 'id', call_id, 'name', name, 'refs', []::VARCHAR[], 'result', result, 'role', role) END AS json FROM calls
      UNION ALL
      SELECT a.conv_id, a.turn, 'tool', 'result', 'c' || (a.turn - 1), CASE WHEN u.turn IS NULL THEN 'orphan' ELSE '' END,
             json_object('content', a.text, 'id', 'c' || (a.turn - 1), 'role', 'tool')
      FROM c a LEFT JOIN c u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user' WHERE a.role = 'assistant'
      UNION ALL
      SELECT conv_id, turn, role, 'message', NULL, '', json_object('content', text, 'role', role) FROM c WHERE role NOT IN ('user', 'assistant'))
SELECT conv_id, turn, role, kind, call_id, problems, row_number() OVER (PARTITION BY conv_id ORDER BY turn, kind) AS seq, sha256(json::VARCHAR) AS json_sha256 FROM r""",
    "op7_decontaminate": BENCHMARK_HITS.format(docs="documents")
    + """SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""",
    "op9_exact_dedup": rf"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '{BLANKS}', '', 'g') AS norm FROM documents),
w AS (SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w""",
}
