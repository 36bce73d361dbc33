"""§ delimited data and workbook profiling over ``v_csv_lines`` / ``v_sheet_cells``."""

from pyspark.sql import functions as F

from quire.functions.text import WS
from quire.operators import tabular as T
from quire.plans.common import finish
from quire.plans.registry import query
from quire.plans.sqlfrag import trim
from quire.sources.fixtures import derived, duck_with

NONBLANK = f"regexp_matches(text, '[^{WS[1:-1]}]')"
_D = {"\t": "chr(9)", ",": "','", ";": "';'", "|": "'|'"}


def _detect_sql(h: str) -> str:
    ds = list(T.DELIMITERS)
    n = {d: f"(length({h}) - length(replace({h}, {_D[d]}, '')))" for d in ds}
    whens = []
    for k, d in enumerate(ds):
        conds = [f"{n[d]} > 0"] + [f"{n[d]} > {n[e]}" for e in ds[:k]] + [f"{n[d]} >= {n[e]}" for e in ds[k + 1:]]
        whens.append(f"WHEN {' AND '.join(conds)} THEN {_D[d]}")
    return f"CASE {' '.join(whens)} ELSE ',' END"


def _parse_sql(line: str, d: str) -> str:
    marked = f"list_transform(string_split({line}, '\"'), lambda p, i: CASE WHEN i % 2 = 1 THEN replace(p, {d}, chr(1)) ELSE p END)"
    return f"list_transform(string_split(array_to_string({marked}, ''), chr(1)), lambda c: {trim('c')})"


def _infer_sql(vals: str) -> str:
    i, f = f"regexp_matches(v, '{T.INT_RE}')", f"regexp_matches(v, '{T.FLOAT_RE}')"
    from_s = (f"CASE WHEN {i} THEN 'integer' WHEN {f} THEN 'float' WHEN regexp_matches(v, '{T.BOOL_RE}') THEN 'boolean' "
              f"WHEN regexp_matches(v, '{T.DATE_RE}') THEN 'date' ELSE 'string' END")
    step = (f"CASE WHEN v = '' THEN t WHEN t = 'string' THEN {from_s} "
            f"WHEN t = 'integer' AND NOT {i} THEN (CASE WHEN {f} THEN 'float' ELSE 'string' END) "
            f"WHEN t = 'float' AND NOT {f} THEN 'string' ELSE t END")
    return f"list_reduce({vals}, lambda t, v: {step}, 'string')"


CSV = duck_with("v_csv_lines") + f"""
, nb AS (SELECT path, line_no, text, row_number() OVER (PARTITION BY path ORDER BY line_no) - 1 AS row_no
         FROM v_csv_lines WHERE {NONBLANK}),
dl AS (SELECT path, {_detect_sql('h')} AS delimiter FROM (SELECT path, arg_min(text, line_no) AS h FROM nb GROUP BY path)),
cs AS (SELECT nb.path, row_no, {_parse_sql('text', 'delimiter')} AS cs FROM nb JOIN dl ON nb.path = dl.path),
cells AS (SELECT path, row_no, CAST(generate_subscripts(cs, 1) - 1 AS BIGINT) AS ord, unnest(cs) AS value FROM cs)
"""
PROFILE = CSV + f"""
, head AS (SELECT path, ord, value AS name FROM cells WHERE row_no = 0),
g AS (SELECT path, ord, list(value ORDER BY row_no) AS vals FROM cells WHERE row_no BETWEEN 1 AND 100 GROUP BY path, ord),
prof AS (SELECT head.path, head.ord, name, coalesce({_infer_sql('vals')}, 'string') AS inferred_type,
                coalesce(vals[1:3], CAST([] AS VARCHAR[])) AS samples
         FROM head LEFT JOIN g ON head.path = g.path AND head.ord = g.ord)
"""


def _lines(spark, sf):
    return derived(spark, sf, "v_csv_lines")


@query("delimiter_detect", CSV + "SELECT path, delimiter FROM dl")
def delimiter_detect(spark, sf):
    return finish(T.delimiters(_lines(spark, sf)))


@query("delimited_parse", CSV + "SELECT path, row_no, ord, value FROM cells")
def delimited_parse(spark, sf):
    return finish(T.cells(_lines(spark, sf), limit=None))


@query("column_type_infer", PROFILE + "SELECT path, ord, name, inferred_type FROM prof")
def column_type_infer(spark, sf):
    return finish(T.column_profile(T.cells(_lines(spark, sf))).drop("samples"))


@query("column_samples", PROFILE + """
SELECT path, ord, array_to_string(list_filter(samples, lambda v: v <> '')[1:2], '", "') AS examples FROM prof
""")
def column_samples(spark, sf):
    p = T.column_profile(T.cells(_lines(spark, sf)))
    shown = F.slice(F.filter("samples", lambda v: v != ""), 1, T.SAMPLES_SHOWN)
    return finish(p.select("path", "ord", F.array_join(shown, '", "').alias("examples")))


@query("table_shape", CSV + f"""
, n AS (SELECT path, count(*) AS n, arg_min(text, line_no) AS h FROM nb GROUP BY path),
allp AS (SELECT DISTINCT path FROM v_csv_lines)
SELECT allp.path, greatest(coalesce(n.n, 0) - 1, 0) AS data_rows,
       CASE WHEN h IS NULL THEN 0 ELSE len({_parse_sql('h', 'dl.delimiter')}) END AS columns,
       dl.delimiter, n.n IS NULL AS is_empty
FROM allp LEFT JOIN n ON allp.path = n.path LEFT JOIN dl ON allp.path = dl.path
""")
def table_shape(spark, sf):
    return finish(T.table_shape(_lines(spark, sf)))


@query("table_head", CSV + """
, tot AS (SELECT path, count(*) - 1 AS data_rows FROM nb GROUP BY path)
SELECT nb.path, row_no, substring(text, 1, 200) AS text, greatest(data_rows - 3, 0) AS remaining
FROM nb JOIN tot ON nb.path = tot.path WHERE row_no BETWEEN 1 AND 3
""")
def table_head(spark, sf):
    return finish(T.table_head(_lines(spark, sf)))


WORKBOOK = duck_with("v_sheet_cells") + f"""
, v AS (SELECT path, sheet, row_no, ord, {trim("coalesce(CAST(value AS VARCHAR), '')")} AS value FROM v_sheet_cells),
ncols AS (SELECT path, sheet, max(ord) + 1 AS columns FROM v WHERE row_no = 0 GROUP BY path, sheet),
nrows AS (SELECT path, sheet, max(row_no) AS rows FROM v GROUP BY path, sheet),
head AS (SELECT path, sheet, ord, value AS name FROM v WHERE row_no = 0),
g AS (SELECT path, sheet, ord, list(value ORDER BY row_no) AS vals FROM v WHERE row_no BETWEEN 1 AND 100
      GROUP BY path, sheet, ord),
prof AS (SELECT h.path, h.sheet, h.ord,
       CASE WHEN name = '' THEN 'Column' || CAST(h.ord + 1 AS VARCHAR) ELSE name END AS name,
       coalesce({_infer_sql('vals')}, 'string') AS inferred_type,
       array_to_string(coalesce(list_filter(vals, lambda x: x <> '')[1:3], CAST([] AS VARCHAR[])), '", "') AS samples,
       rows, columns
FROM head h LEFT JOIN g ON h.path = g.path AND h.sheet = g.sheet AND h.ord = g.ord
JOIN ncols c ON h.path = c.path AND h.sheet = c.sheet JOIN nrows r ON h.path = r.path AND h.sheet = r.sheet)
"""


@query("workbook_profile", WORKBOOK + "SELECT path, sheet, ord, name, inferred_type, samples, rows, columns FROM prof")
def workbook_profile(spark, sf):
    p = T.workbook_profile(derived(spark, sf, "v_sheet_cells"))
    return finish(p.withColumn("samples", F.array_join("samples", '", "')))


BAR = "// ═══════════════════════════════════════"


@query("render_workbook", WORKBOOK + f"""
, l AS (SELECT *, list_filter(string_split(samples, '", "'), lambda x: x <> '')[1:2] AS ex FROM prof),
sh AS (SELECT path, sheet, max(rows) AS rows, max(columns) AS columns, string_agg('// ' || name || ': ' || inferred_type
         || CASE WHEN len(ex) > 0 THEN ' (examples: "' || array_to_string(ex, '", "') || '")' ELSE '' END || chr(10), '' ORDER BY ord) AS schema
       FROM l GROUP BY path, sheet),
b AS (SELECT path, sheet, '{BAR}' || chr(10) || '// SHEET: "' || sheet || '"' || chr(10) || '{BAR}' || chr(10) || '// Rows: ' || CAST(rows AS VARCHAR) || ' | Columns: '
             || CAST(columns AS VARCHAR) || chr(10) || chr(10) || '{BAR}' || chr(10) || '// SCHEMA (' || CAST(columns AS VARCHAR) || ' columns)' || chr(10) || '{BAR}' || chr(10)
             || schema || chr(10) || CASE WHEN rows > 0 THEN '{BAR}' || chr(10) || '// SAMPLE DATA (showing ' || CAST(least(3, rows) AS VARCHAR) || ' of ' || CAST(rows AS VARCHAR)
             || ' rows)' || chr(10) || '{BAR}' || chr(10) || '// [Row data omitted for brevity - see schema above]' || chr(10) ELSE '' END || chr(10) AS b FROM sh)
SELECT path, '// File: ' || path || ' (⚠️ Excel summary)' || chr(10) || '// Format: XLSX' || chr(10) || chr(10) || '{BAR}' || chr(10) || '// WORKBOOK: ' || CAST(count(*) AS VARCHAR)
       || CASE WHEN count(*) > 1 THEN ' sheets' ELSE ' sheet' END || chr(10) || '{BAR}' || chr(10) || chr(10) || string_agg(b, '' ORDER BY sheet) AS text FROM b GROUP BY path
""")
def render_workbook(spark, sf):
    from quire.operators.render import render_workbook_summary
    return render_workbook_summary(derived(spark, sf, "v_sheet_cells"))
