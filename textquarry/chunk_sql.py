"""SQL twins of the chunkers and of what is read from pages, for the comparison with DuckDB."""

from __future__ import annotations

from .functions import chunking

#: White space as Python strips it.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


#: The same as a literal.
ENDS = "'" + chunking.SPACE + "'"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def _mark(m: str) -> str:
    return "(" + " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in m) + ")"


def packed(most: int, joint: str = "' '") -> str:
    """CTEs s and chunks(key, i, chunk) for pieces(key, i, piece), i from 1 in each key: the fold, a piece a round."""
    return f"""s AS (SELECT key, 0::BIGINT AS i, '' AS open, NULL::VARCHAR AS done FROM (SELECT DISTINCT key FROM pieces)
 UNION ALL SELECT s.key, s.i + 1, CASE WHEN length(open) + length(piece) + 1 > {most} THEN piece WHEN open = '' THEN trim(piece, {ENDS}) ELSE trim(open || {joint} || piece, {ENDS}) END,
  CASE WHEN length(open) + length(piece) + 1 > {most} AND open <> '' THEN open END FROM s JOIN pieces p ON p.key = s.key AND p.i = s.i + 1),
chunks AS (SELECT key, i, done AS chunk FROM s WHERE done IS NOT NULL UNION ALL SELECT key, i + 1, open FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY i DESC) AS n FROM s) WHERE n = 1 AND open <> '')"""


SENTENCES = r"string_split(regexp_replace({0}, '([.;])\s+', '\1' || chr(1), 'g'), chr(1))"
NUMBERED = "generate_subscripts({0}, 1) AS i, unnest({0}) AS piece"
SENTENCE_PACK = f"""WITH RECURSIVE p AS (SELECT doc_id AS key, {SENTENCES.format('text')} AS ps FROM documents WHERE text IS NOT NULL), pieces AS (SELECT key, {NUMBERED.format('ps')} FROM p), {packed(2000)}
SELECT key AS doc_id, row_number() OVER (PARTITION BY key ORDER BY i) - 1 AS chunk_index, chunk AS chunk_text FROM chunks"""
PARAGRAPH_PACK = rf"""WITH RECURSIVE p AS (SELECT doc_id AS key, list_filter(list_transform(string_split(regexp_replace(text, '\n\s*\n', chr(1), 'g'), chr(1)), lambda x: trim(x, {ENDS})), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT key, {NUMBERED.format('ps')} FROM p), {packed(3200, 'chr(10) || chr(10)')} SELECT key AS doc_id, row_number() OVER (PARTITION BY key ORDER BY i) - 1 AS chunk_index, chunk AS chunk_text FROM chunks"""
#: Markers that share their space aren't told apart here; tests hold those.
STRUCT_CHUNK = rf"""WITH RECURSIVE d AS (SELECT doc_id, text, list_transform(string_split(regexp_replace(text, '(\s\([a-zA-Z0-9]{{1,4}}\)\s)', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x, {ENDS})) AS segments FROM documents WHERE text <> ''),
k AS (SELECT *, list_filter(segments, lambda x: length(x) >= 100) AS kept FROM d), w AS (SELECT *, len(kept) <= 1 OR length(text) <= 2000 AS whole FROM k),
u AS (SELECT doc_id, CASE WHEN whole THEN 0 ELSE coalesce(list_sum(list_transform(list_filter(segments, lambda x: length(x) < 100), lambda x: length(x))), 0) END AS dropped, CASE WHEN whole THEN [text] ELSE kept END AS parts FROM w),
v AS (SELECT doc_id, generate_subscripts(parts, 1) AS part_no, unnest(parts) AS part FROM u), long AS (SELECT {{'d': doc_id, 'p': part_no}} AS key, {SENTENCES.format('part')} AS ps FROM v WHERE length(part) > 2000),
pieces AS (SELECT key, {NUMBERED.format('ps')} FROM long), {packed(2000)},
a AS (SELECT doc_id, part_no, 0::BIGINT AS i, part AS chunk FROM v WHERE length(part) <= 2000 UNION ALL SELECT key.d, key.p, i, chunk FROM chunks),
g AS (SELECT doc_id, sum(length(chunk)) AS gone FROM a WHERE length(chunk) < 100 GROUP BY doc_id)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part_no, i) - 1 AS chunk_index, chunk AS chunk_text, (dropped + coalesce(gone, 0))::BIGINT AS dropped_chars FROM a JOIN u USING (doc_id) LEFT JOIN g USING (doc_id) WHERE length(chunk) >= 100"""


def windows(preset: str) -> str:
    """Overlapping windows, each from the one before: the last place of each kind of mark is looked for in the reversed window."""
    size, overlap, marks, behind, back, used, most = chunking.PRESETS[preset]
    text = f"left(text, {used})" if used else "text"
    last = lambda m: f"CASE WHEN contains(seg, {_mark(m)}) THEN start + length(seg) - strpos(reverse(seg), reverse({_mark(m)})) - {len(m) - 1} ELSE -1 END"
    least = f"greatest(start + {behind}, {f'stop - {back}' if back else '0'})"
    ends = [f"CASE WHEN {last(m)} > {least} THEN {last(m)} + {len(m.rstrip()) or 1} END" for m in marks]
    # in order of kind, or the furthest mark; of two at one place the longer
    best = f"coalesce({', '.join(ends)})" if preset == "tokens" else f"greatest({', '.join(ends)})" if len(ends) > 1 else (ends or ["NULL"])[0]
    space = f", CASE WHEN {last(' ')} > start THEN {last(' ')} END" if preset == "decisions" else ""
    step = f"SELECT *, CASE WHEN stop < length(t) THEN coalesce({best}{space}, stop) ELSE stop END AS e FROM (SELECT *, substr(t, start + 1, stop - start) AS seg FROM (SELECT doc_id, t, start, n, least(start + {size}, length(t)) AS stop FROM {{0}}))"
    cut = _strip("substr(t, start + 1, e - start)")
    row = f"SELECT doc_id, {cut} AS chunk, e, start, n + ({cut} <> '')::INT AS n, e >= length(t) {f'OR n + ({cut} <> {chr(39) * 2})::INT >= {most}' if most else ''} AS done FROM ({{0}})"
    first = row.replace("{0}", step.replace("{0}", f"(SELECT doc_id, {text} AS t, 0::BIGINT AS start, 0 AS n FROM documents WHERE text <> '')"))
    later = row.replace("{0}", step.replace("{0}", f"(SELECT d.doc_id, {text} AS t, greatest(w.e - {overlap}, w.start + 1)::BIGINT AS start, w.n FROM w JOIN documents d ON d.doc_id = w.doc_id WHERE NOT w.done)"))
    return f"WITH RECURSIVE w AS ({first} UNION ALL {later}) SELECT doc_id, n - 1 AS chunk_index, chunk AS chunk_text FROM w WHERE chunk <> ''"


HTML_LINKS = r"""WITH h AS (SELECT page_id, generate_subscripts(hs, 1) AS place, unnest(hs) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href=["'']([^"''#]+)', 1) AS hs FROM pages)),
f AS (SELECT *, row_number() OVER (PARTITION BY href ORDER BY page_id, place) AS n FROM h WHERE regexp_matches(href, '^/[^/]+$')) SELECT 'https://x.example' || href AS url, page_id, substr(href, 2) AS word FROM f WHERE n = 1"""


def _decoded(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&nbsp;', chr(160)), '&amp;', '&')"


#: Pages whose text stands in one article, with entities for four signs; other pages' tag soup is held by tests.
HTML_MAIN = rf"""WITH a AS (SELECT page_id, html, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
p AS (SELECT page_id, html, list_filter(list_transform(string_split(regexp_replace(body, '<!--.*?-->|<[^>]+>', chr(1), 'gs'), chr(1)), lambda x: {_strip(_decoded("x"))}), lambda x: x <> '') AS lines FROM a)
SELECT page_id, {_strip(_decoded("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))} AS title, regexp_replace(array_to_string(lines, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g') AS main_text FROM p"""
