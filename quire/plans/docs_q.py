"""§ document structure over ``v_md`` / ``v_paragraphs`` / ``documents``."""

from pyspark.sql import functions as F

from quire.functions.text import WS
from quire.operators import docs
from quire.plans.common import finish
from quire.plans.registry import query
from quire.plans.sqlfrag import collapse, trim
from quire.sources.fixtures import derived, duck_with

HEAD = f"^(#{{1,6}}){WS}+(.+)$"
MD_LINES = duck_with("v_md") + f"""
, l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no,
               unnest(string_split(text, chr(10))) AS raw FROM v_md),
t AS (SELECT doc_id, line_no, {trim('raw')} AS t FROM l)
"""


@query("doc_headings", MD_LINES + f"""
, h AS (SELECT doc_id, line_no, t, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS ord
        FROM t WHERE regexp_matches(t, '{HEAD}'))
SELECT doc_id, ord, line_no, length(regexp_extract(t, '{HEAD}', 1)) AS level,
       regexp_extract(t, '{HEAD}', 2) AS text FROM h WHERE ord <= 50
""")
def doc_headings(spark, sf):
    return finish(docs.headings(derived(spark, sf, "v_md")))


@query("doc_code_blocks", MD_LINES + f"""
, f AS (SELECT doc_id, line_no, t, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k
        FROM t WHERE starts_with(t, '```')),
p AS (SELECT *, lead(line_no) OVER (PARTITION BY doc_id ORDER BY k) AS close_line FROM f)
SELECT doc_id, CAST((k + 1) / 2 AS BIGINT) AS block_no, line_no AS open_line,
       CASE WHEN {trim('substring(t, 4)')} = '' THEN 'text' ELSE {trim('substring(t, 4)')} END AS lang,
       close_line - line_no - 1 AS n_lines
FROM p WHERE k % 2 = 1 AND close_line IS NOT NULL
""")
def doc_code_blocks(spark, sf):
    return finish(docs.code_blocks(derived(spark, sf, "v_md")))


KW = r"\b[a-zA-Z]{3,}\b"
STOP = ", ".join(f"'{w}'" for w in docs.STOP_WORDS)


@query("doc_keywords", duck_with("v_md") + f"""
, s AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '(?s)```.*?```', '', 'g'), '{KW}') AS ws FROM v_md),
w AS (SELECT doc_id, lower(unnest(ws)) AS word, generate_subscripts(ws, 1) AS pos FROM s),
c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first_pos FROM w
      WHERE word NOT IN ({STOP}) GROUP BY doc_id, word HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS rank FROM c)
SELECT doc_id, rank, word, n FROM r WHERE rank <= 10
""")
def doc_keywords(spark, sf):
    return finish(docs.keywords(derived(spark, sf, "v_md")))


@query("doc_opening", MD_LINES + """
, f AS (SELECT doc_id, arg_min(t, line_no) AS first FROM t
        WHERE t <> '' AND NOT starts_with(t, '#') AND NOT starts_with(t, '```') AND NOT starts_with(t, '>')
        GROUP BY doc_id)
SELECT v.doc_id, CASE WHEN length(first) > 300 THEN substring(first, 1, 300) || '...' ELSE first END AS opening
FROM v_md v LEFT JOIN f ON v.doc_id = f.doc_id
""")
def doc_opening(spark, sf):
    return finish(docs.opening(derived(spark, sf, "v_md")))


@query("doc_stats", MD_LINES + f"""
, h AS (SELECT doc_id, count(*) AS nh FROM t WHERE regexp_matches(t, '{HEAD}') GROUP BY doc_id)
SELECT v.doc_id, len(string_split(v.text, chr(10))) AS n_lines, least(coalesce(nh, 0), 50) AS n_headings
FROM v_md v LEFT JOIN h ON v.doc_id = h.doc_id
""")
def doc_stats(spark, sf):
    return finish(docs.doc_stats(derived(spark, sf, "v_md")))


def clean_sql(x: str) -> str:
    lines = f"string_split(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), chr(10))"
    return (f"array_to_string(list_filter(list_transform({lines}, lambda l: {collapse(trim('l'))}), "
            f"lambda l: l <> ''), chr(10))")


def preview_sql(x: str, width: int) -> str:
    c = f"regexp_replace({trim(collapse(x))}, '[\\x{{00}}-\\x{{08}}\\x{{0B}}\\x{{0C}}\\x{{0E}}-\\x{{1F}}\\x{{7F}}]', '', 'g')"
    return (f"CASE WHEN {c} = '' THEN '(empty)' WHEN length({c}) > {width} "
            f"THEN substring({c}, 1, {width}) || '...' ELSE {c} END")


@query("page_chunks", duck_with("v_paged") + f"""
, c AS (SELECT doc_id, n_pages, {clean_sql('text')} AS t FROM v_paged),
p AS (SELECT doc_id, t, CAST(ceil(length(t) / n_pages) AS BIGINT) AS cpp, unnest(range(0, n_pages)) AS i FROM c),
q AS (SELECT doc_id, i + 1 AS page_no, {trim('substring(t, i * cpp + 1, cpp)')} AS content FROM p)
SELECT doc_id, page_no, length(content) AS chars, {preview_sql('content', 50)} AS preview
FROM q WHERE content <> ''
""")
def page_chunks(spark, sf):
    return finish(docs.page_chunks(derived(spark, sf, "v_paged")))


PARA_SPLIT = f"string_split_regex(text, '\\n{WS}*\\n')"
P_WS = WS[1:-1]


@query("paragraph_headings", duck_with("v_paragraphs") + f"""
, s AS (SELECT doc_id, list_filter(list_transform({PARA_SPLIT}, lambda p: {trim('p')}), lambda p: p <> '') AS ps
        FROM v_paragraphs),
p AS (SELECT doc_id, generate_subscripts(ps, 1) AS para_no, unnest(ps) AS p FROM s),
h AS (SELECT *, length(p) <= 100 AND (
        ends_with(p, ':') OR regexp_matches(p, '^[0-9]+\\.{WS}')
        OR (upper(p) = p AND length(p) > 3 AND regexp_matches(p, '[A-Z]'))
        OR regexp_matches(p, '(?i)^(chapter|section|part){WS}+[0-9]')
        OR regexp_matches(p, '^[A-Z][A-Z{P_WS}]{{5,}}$')) AS is_heading FROM p)
SELECT doc_id, para_no, is_heading,
       CASE WHEN NOT is_heading THEN NULL
            WHEN regexp_matches(p, '(?i)^chapter{WS}+[0-9]') OR regexp_matches(p, '(?i)^part{WS}') THEN 1
            WHEN regexp_matches(p, '(?i)^section{WS}+[0-9]') THEN 2
            WHEN regexp_matches(p, '^[0-9]+\\.[0-9]') THEN 3 ELSE 2 END AS level,
       p AS text
FROM h
""")
def paragraph_headings(spark, sf):
    return finish(docs.paragraph_headings(derived(spark, sf, "v_paragraphs")))


SLIDES = duck_with("v_slides") + f"""
, g AS (SELECT doc_id, slide_no,
          arg_min(text, seq) FILTER (WHERE field = 'title' AND coalesce(text, '') <> '') AS t,
          arg_min(text, seq) FILTER (WHERE field = 'content' AND coalesce(text, '') <> '') AS c,
          arg_min(text, seq) FILTER (WHERE field = 'text' AND coalesce(text, '') <> '') AS x,
          list(text ORDER BY seq) FILTER (WHERE field = 'element' AND text IS NOT NULL) AS els
        FROM v_slides GROUP BY doc_id, slide_no),
h AS (SELECT doc_id, slide_no,
        coalesce(CASE WHEN t IS NULL AND len(els) > 0 THEN els[1] ELSE t END, '') AS t1,
        coalesce(CASE WHEN coalesce(c, x) IS NULL AND len(els) > 0 THEN array_to_string(els, ' ') ELSE coalesce(c, x) END, '') AS c1
      FROM g),
k AS (SELECT doc_id, slide_no, {clean_sql('t1')} AS title, {clean_sql('c1')} AS content FROM h),
slides AS (SELECT doc_id, slide_no, CASE WHEN title = '' THEN 'Slide ' || CAST(slide_no AS VARCHAR) ELSE title END AS title,
       CASE WHEN content <> '' THEN content WHEN title <> '' THEN '' ELSE '(no text content)' END AS content
FROM k)
"""


@query("slide_assemble", SLIDES + "SELECT doc_id, slide_no, title, content FROM slides")
def slide_assemble(spark, sf):
    return finish(docs.slide_assemble(derived(spark, sf, "v_slides")))


BAR = "// ═══════════════════════════════════════"


@query("render_slides", SLIDES + f"""
, pv AS (SELECT doc_id, slide_no, title, {preview_sql('content', 500)} AS c FROM slides)
SELECT doc_id, '{BAR}' || chr(10) || '// SLIDE CONTENT' || chr(10) || '{BAR}' || chr(10)
       || string_agg(chr(10) || '// [Slide ' || CAST(slide_no AS VARCHAR) || '] ' || title || chr(10) || '// ' || c || chr(10), '' ORDER BY slide_no) AS text
FROM pv GROUP BY doc_id
""")
def render_slides(spark, sf):
    from quire.operators.render import render_slide_content
    return finish(render_slide_content(derived(spark, sf, "v_slides")))
