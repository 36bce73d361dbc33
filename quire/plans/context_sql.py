"""DuckDB text of every kind of file block, put together from the oracles of the structured keys.

Each oracle begins with the stand-in input it reads (``WITH <view> AS ...``); here that input is
replaced by the kept files of one route, so a block's text follows from rows that are checked on
their own.  Outer names used: ``fr`` (kept files with route and language).
"""

from __future__ import annotations

from quire.plans import code_q, config_q, docs_q, logs_q, summary_q, tabular_q, text_q
from quire.plans.registry import ORACLES
from quire.sources.fixtures import duck_with

BAR = "// ═══════════════════════════════════════"
MORE = (code_q, config_q, docs_q, logs_q, summary_q, tabular_q, text_q)  # their oracles are registered on import


def sep(title: str) -> str:
    return f"E'{BAR}\\n// {title}\\n{BAR}\\n'"


def over(sql: str, view: str, rows: str) -> str:
    """The oracle ``sql`` of ``view`` over other rows."""
    for start in ("WITH RECURSIVE ", "WITH "):
        old = start + duck_with(view)[5:]
        if sql.startswith(old):
            return f"({start}{view} AS ({rows})\n{sql[len(old):]})"
    raise ValueError(f"the oracle does not begin with {view}")


def lines_of(where: str) -> str:
    return ("SELECT path, coalesce(lang, 'text') AS language, CAST(generate_subscripts(ls, 1) AS INTEGER) AS line_no, unnest(ls) AS text "
            f"FROM (SELECT path, lang, string_split(content, chr(10)) AS ls FROM fr WHERE {where})")


def log_blocks() -> str:
    rows = lines_of("route = 'summary:log'")
    dist, pct, errors, samples = (over(ORACLES[k], "v_log_lines", rows) for k in ("log_level_distribution", "format_percent", "log_error_lines", "log_level_samples"))
    return f"""
SELECT f.path, '// File: ' || f.rel_path || E' (⚠️ Log summary)\\n// Total lines: ' || CAST(len(string_split(f.content, chr(10))) AS VARCHAR) || E'\\n\\n' || {sep('LOG LEVEL DISTRIBUTION')}
  || coalesce(d.t || E'\\n', E'// (no standard log levels detected)\\n') || E'\\n'
  || coalesce(E'{BAR}\\n// RECENT ERROR PATTERNS (first ' || CAST(e.n AS VARCHAR) || E')\\n{BAR}\\n' || e.t || E'\\n\\n', '')
  || {sep('SAMPLE LOG ENTRIES (up to 5 per level)')} || coalesce(s.t, '') AS text
FROM (SELECT * FROM fr WHERE route = 'summary:log') f
LEFT JOIN (SELECT a.path, string_agg('// ' || rpad(a.level, 8, ' ') || ': ' || lpad(CAST(a.n AS VARCHAR), 6, ' ') || ' (' || p.pct_text || '%)', chr(10) ORDER BY a.rank) AS t
           FROM {dist} a JOIN {pct} p ON p.path = a.path AND p.level = a.level GROUP BY a.path) d ON d.path = f.path
LEFT JOIN (SELECT path, count(*) AS n, string_agg('// ' || text, chr(10) ORDER BY rank) AS t FROM {errors} x GROUP BY path) e ON e.path = f.path
LEFT JOIN (SELECT path, string_agg(E'\\n// [' || level || E']\\n' || t || chr(10), '' ORDER BY list_position(['DEBUG', 'INFO', 'WARN', 'WARNING', 'ERROR', 'FATAL', 'CRITICAL', 'TRACE'], level)) AS t
           FROM (SELECT path, level, string_agg('// ' || text, chr(10) ORDER BY rank) AS t FROM {samples} x GROUP BY path, level) y GROUP BY path) s ON s.path = f.path
"""


def csv_blocks() -> str:
    rows = lines_of("route = 'summary:csv'")
    shape, head = (over(ORACLES[k], "v_csv_lines", rows) for k in ("table_shape", "table_head"))
    prof = over(tabular_q.PROFILE + "SELECT * FROM prof", "v_csv_lines", rows)
    return f"""
SELECT f.path, CASE WHEN s.is_empty THEN '// File: ' || f.rel_path || E' (⚠️ Empty CSV)\\n' ELSE '// File: ' || f.rel_path || E' (⚠️ CSV/TSV summary)\\n// Total rows: '
  || CAST(s.data_rows AS VARCHAR) || E'\\n// Delimiter: "' || CASE WHEN s.delimiter = chr(9) THEN '\\t' ELSE s.delimiter END || E'"\\n\\n{BAR}\\n// SCHEMA (' || CAST(s.columns AS VARCHAR)
  || E' columns)\\n{BAR}\\n' || coalesce(p.t || chr(10), '') || chr(10) || E'{BAR}\\n// SAMPLE DATA (first ' || CAST(least(3, s.data_rows) AS VARCHAR) || E' rows)\\n{BAR}\\n'
  || coalesce(h.t || chr(10), '') || CASE WHEN s.data_rows > 3 THEN '// ... (' || CAST(s.data_rows - 3 AS VARCHAR) || E' more rows)\\n' ELSE '' END END AS text
FROM (SELECT * FROM fr WHERE route = 'summary:csv') f JOIN {shape} s ON s.path = f.path
LEFT JOIN (SELECT path, string_agg('// ' || name || ': ' || inferred_type || CASE WHEN len(list_filter(samples, lambda v: v <> '')[1:2]) > 0
             THEN ' (examples: "' || array_to_string(list_filter(samples, lambda v: v <> '')[1:2], '", "') || '")' ELSE '' END, chr(10) ORDER BY ord) AS t FROM {prof} x GROUP BY path) p ON p.path = f.path
LEFT JOIN (SELECT path, string_agg('// ' || text, chr(10) ORDER BY row_no) AS t FROM {head} x GROUP BY path) h ON h.path = f.path
"""


def doc_blocks() -> str:
    rows = "SELECT path AS doc_id, content AS text FROM fr WHERE route = 'summary:doc'"
    heads, fences, words, opening, stats = (over(ORACLES[k], "v_md", rows) for k in ("doc_headings", "doc_code_blocks", "doc_keywords", "doc_opening", "doc_stats"))
    return f"""
SELECT f.path, '// File: ' || f.rel_path || E' (⚠️ Document outline)\\n\\n' || {sep('DOCUMENT STRUCTURE')} || '// Lines: ' || CAST(s.n_lines AS VARCHAR) || ' | Headings: '
  || CAST(s.n_headings AS VARCHAR) || E'\\n\\n' || coalesce(h.t || chr(10), E'// (no headings detected)\\n') || chr(10)
  || coalesce(E'{BAR}\\n// CODE BLOCKS (' || CAST(c.n AS VARCHAR) || E')\\n{BAR}\\n' || c.t || E'\\n\\n', '')
  || coalesce({sep('KEY TERMS')} || '// ' || k.t || chr(10), '') || coalesce(chr(10) || {sep('OPENING PARAGRAPH')} || '// ' || o.opening || chr(10), '') AS text
FROM (SELECT * FROM fr WHERE route = 'summary:doc') f JOIN {stats} s ON s.doc_id = f.path
LEFT JOIN (SELECT doc_id, string_agg(repeat('  ', level - 1) || '// ' || repeat('#', level) || ' ' || text, chr(10) ORDER BY ord) AS t FROM {heads} x GROUP BY doc_id) h ON h.doc_id = f.path
LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg('// ```' || lang || ' (' || CAST(n_lines AS VARCHAR) || ' lines)', chr(10) ORDER BY block_no) AS t FROM {fences} x GROUP BY doc_id) c ON c.doc_id = f.path
LEFT JOIN (SELECT doc_id, string_agg(word, ', ' ORDER BY rank) AS t FROM {words} x GROUP BY doc_id) k ON k.doc_id = f.path
LEFT JOIN {opening} o ON o.doc_id = f.path
"""


def json_blocks() -> str:
    made = over(ORACLES["render_json"], "v_json", "SELECT path, content FROM fr WHERE route = 'summary:config'")
    return f"SELECT f.path, '// File: ' || f.rel_path || substring(j.text, 10 + length(j.path)) AS text FROM {made} j JOIN fr f ON f.path = j.path"


def pdf_blocks() -> str:
    big = "SELECT path AS doc_id, content AS text FROM fr WHERE route = 'summary:pdf' AND size > 10000"
    paged = "SELECT path AS doc_id, content AS text, 1 + CAST(floor(length(content) / 1500) AS INT) AS n_pages FROM fr WHERE route = 'summary:pdf'"
    summary = over(ORACLES["summary_select"], "v_prose", big)
    keys = over(ORACLES["key_sentences"], "v_prose", big)
    chunks = ORACLES["page_chunks"]
    cut = docs_q.preview_sql("content", 50)
    assert cut in chunks
    short = over(chunks, "v_paged", paged)
    long = over(chunks.replace(cut, docs_q.preview_sql("content", 500)), "v_paged", paged)
    return f"""
SELECT f.path, '// File: ' || f.rel_path || E' (⚠️ PDF structure)\\n// Pages: ' || CAST(f.n_pages AS VARCHAR) || ' | Total text: ~' || CAST(length({docs_q.clean_sql('f.content')}) AS VARCHAR) || E' chars\\n'
  || CASE WHEN f.size > 10000 THEN E'// Compressed: Yes (exceeds 10000 bytes threshold)\\n' ELSE E'// Compressed: No\\n' END || E'\\n{BAR}\\n// PDF STRUCTURE\\n{BAR}\\n\\n'
  || CASE WHEN f.size > 10000 THEN E'{BAR}\\n// PAGE OUTLINE\\n{BAR}\\n' || coalesce(o.t, '') || E'\\n{BAR}\\n// KEY CONTENT SUMMARY\\n{BAR}\\n// [Document Summary]\\n// '
       || replace(coalesce(s.summary, ''), chr(10), E'\\n// ') || E'\\n\\n{BAR}\\n// KEY POINTS\\n{BAR}\\n' || coalesce(k.t, '')
     ELSE E'{BAR}\\n// PAGE CONTENT\\n{BAR}\\n' || coalesce(w.t, '') END AS text
FROM (SELECT *, 1 + CAST(floor(length(content) / 1500) AS INT) AS n_pages FROM fr WHERE route = 'summary:pdf') f
LEFT JOIN (SELECT doc_id, string_agg('// [Page ' || CAST(page_no AS VARCHAR) || '] ' || preview || chr(10), '' ORDER BY page_no) AS t FROM {short} x GROUP BY doc_id) o ON o.doc_id = f.path
LEFT JOIN (SELECT doc_id, string_agg(E'\\n// [Page ' || CAST(page_no AS VARCHAR) || E']\\n// ' || preview || chr(10), '' ORDER BY page_no) AS t FROM {long} x GROUP BY doc_id) w ON w.doc_id = f.path
LEFT JOIN {summary} s ON s.doc_id = f.path
LEFT JOIN (SELECT x.doc_id, string_agg('// [~Page ' || CAST(CAST(least(floor(CAST(x.position AS DOUBLE) / x.n_keys * p.n_pages) + 1, p.n_pages) AS BIGINT) AS VARCHAR) || '] '
             || {docs_q.preview_sql('x.text', 100)} || chr(10), '' ORDER BY x.rank) AS t
           FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_keys FROM {keys} y) x JOIN ({paged}) p ON p.doc_id = x.doc_id GROUP BY x.doc_id) k ON k.doc_id = f.path
"""


def overview(size: str) -> str:
    return f"'// File: ' || f.rel_path || ' (⚠️ Overview — ' || {size} || E', structure outline)\\n// Language: ' || coalesce(f.lang, 'text')"


def text_blocks(size: str, code: str) -> str:
    rows = f"(SELECT path AS doc_id, content AS text FROM fr WHERE route = 'summary:generic' AND NOT {code})"
    stats, shown = (f"({ORACLES[k].replace('FROM documents', 'FROM ' + rows + ' q')})" for k in ("text_stats", "text_preview"))
    return f"""
SELECT f.path, {overview(size)} || E'\\n// Total lines: ' || CAST(s.total_lines AS VARCHAR) || E'\\n\\n{BAR}\\n// TEXT ANALYSIS\\n{BAR}\\n// Total lines: ' || CAST(s.total_lines AS VARCHAR)
  || E'\\n// Non-empty lines: ' || CAST(s.nonblank_lines AS VARCHAR) || E'\\n// Average line length: ' || CAST(s.avg_len AS VARCHAR) || E' chars\\n\\n{BAR}\\n// PREVIEW (up to 300 chars)\\n{BAR}\\n'
  || coalesce(p.t || chr(10), '') AS text
FROM (SELECT * FROM fr WHERE route = 'summary:generic' AND NOT {code}) f JOIN {stats} s ON s.doc_id = f.path
LEFT JOIN (SELECT doc_id, string_agg('// ' || preview || CASE WHEN cut THEN '...' ELSE '' END, chr(10) ORDER BY ord) AS t FROM {shown} x GROUP BY doc_id) p ON p.doc_id = f.path
"""


def code_blocks(size: str, code: str) -> str:
    """Code overviews, and outlines where a file has a valid one."""
    where = f"(route = 'outline' OR route = 'summary:generic' AND {code})"
    found = over(ORACLES["code_structure"], "v_code_lines", lines_of(where))
    outline = over(ORACLES["render_outline"], "v_code_lines", lines_of("route = 'outline'"))
    part = lambda kind, title, none: (f"{sep(title)} || coalesce((SELECT t FROM sec WHERE sec.path = f.path AND sec.kind = '{kind}') || chr(10), E'// {none}\\n')")
    return f"""
SELECT f.path, CASE WHEN regexp_matches(o.text, '(?m)^//\\s+(TYPES|FUNCTIONS|IMPORTS|DEPENDENCIES)') AND length(trim(o.text)) >= 50 THEN {overview(size)} || E'\\n\\n' || o.text
  ELSE {overview(size)} || E'\\n// Total lines: ' || CAST(len(string_split(f.content, chr(10))) AS VARCHAR) || E'\\n\\n' || {part('type', 'TYPES/INTERFACES', '(no type definitions detected)')} || chr(10)
    || {part('function', 'FUNCTIONS/METHODS', '(no functions detected)')} || chr(10) || {part('import', 'IMPORTS/DEPENDENCIES', '(no imports detected)')} END AS text
FROM (SELECT * FROM fr WHERE {where}) f LEFT JOIN {outline} o ON o.path = f.path
""".replace("(SELECT t FROM sec", f"(SELECT t FROM (SELECT path, kind, string_agg('// ' || text, chr(10) ORDER BY ord) AS t FROM {found} x GROUP BY path, kind) sec")


def summary_blocks(size: str, code: str) -> str:
    """(path, text) of every kept file that is neither shown in full nor binary."""
    return "\nUNION ALL ".join((log_blocks(), csv_blocks(), doc_blocks(), json_blocks(), pdf_blocks(), text_blocks(size, code), code_blocks(size, code)))
