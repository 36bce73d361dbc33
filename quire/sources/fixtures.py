"""Derived stand-in inputs built from the given tables.

Each input is one SQL text in the subset Spark SQL and DuckDB share, so the Spark
job and its DuckDB oracle start from identical rows.  These builders only shape
rows into the schema an operator expects; they do none of the operator's work.
Placeholders ``{name}`` are the given tables (or other derived inputs);
``OCTETS(x)`` is the UTF-8 byte length, ``EACH(n)`` a row for each of 1 to n.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quire.sources.tables import TABLES, table


@dataclass(frozen=True)
class Derived:
    sql: str
    deps: tuple


NL = "chr(10)"

DERIVED: dict[str, Derived] = {}


def _d(name: str, deps: tuple, sql: str) -> None:
    DERIVED[name] = Derived(sql.strip(), deps)


_d("v_files", ("documents",), """
SELECT project, concat(project, '/', rel_path) AS path, rel_path, size, content, doc_id
FROM (
  SELECT source AS project, doc_id,
         concat(CASE WHEN doc_id % 13 = 0 THEN 'node_modules/pkg'
                     WHEN doc_id % 17 = 0 THEN 'build' ELSE lang END,
                CASE WHEN doc_id % 29 = 0 THEN '/.f' ELSE '/f' END, CAST(doc_id AS STRING),
                CASE doc_id % 12 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.log'
                     WHEN 3 THEN '.csv' WHEN 4 THEN '.json' WHEN 5 THEN '.ts' WHEN 6 THEN '.py'
                     WHEN 7 THEN '.php' WHEN 8 THEN '.png' WHEN 9 THEN '.pdf' WHEN 10 THEN '.GO'
                     ELSE '' END) AS rel_path,
         OCTETS(text) AS size, text AS content
  FROM {documents}) t
""")

# rules of three layers; those with {L} stand there for each language of the documents
_d("v_rules", ("documents",), """
SELECT t.layer AS layer, t.ord * 10 + d.k AS ord, replace(t.pattern, '{L}', d.lang) AS pattern
FROM (VALUES (1, 1, '*.log'), (1, 2, '!f14.log'), (2, 1, 'node_modules/**'), (2, 2, 'build/'), (3, 1, '/src1/en/f1*.md'), (3, 2, '**/f2?.txt'),
  (3, 3, '# comment'), (3, 4, ''), (3, 5, '{L}/f3*.csv'), (3, 6, '!{L}/f33*.csv'), (3, 7, concat('*.log', chr(13))), (3, 8, concat(chr(9), '# c')),
  (3, 9, concat(chr(92), '!note.txt')), (3, 10, '!f14.log'), (3, 11, 'de/'), (3, 12, '!de/f4*.txt')) AS t(layer, ord, pattern)
JOIN (SELECT lang, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END AS k FROM {documents} GROUP BY lang) d
  ON t.pattern LIKE '%{L}%' OR d.lang = 'en'
""")

_d("v_log_lines", ("events",), """
SELECT concat('u', CAST(CAST(floor(event_id / 1000) AS BIGINT) AS STRING), '.log') AS path,
       CAST(event_id % 1000 + 1 AS INT) AS line_no,
       CASE WHEN event_id % 20 = 0 THEN ''
            ELSE concat(CAST(event_id AS STRING), ' ',
                 CASE WHEN event_id % 9 = 0 THEN 'note '
                      WHEN event_id % 13 = 0 THEN concat('[', lv, '] ')
                      WHEN event_id % 19 = 0 THEN concat('x', lv, ' ')
                      WHEN event_id % 23 = 0 THEN concat('é', lv, ' ')
                      ELSE concat(lv, ' ') END,
                 CASE WHEN event_id % 11 = 0 THEN 'request timeout'
                      WHEN event_id % 7 = 0 THEN 'payment failed'
                      WHEN event_id % 29 = 0 THEN 'Worker CRASHED hard'
                      ELSE 'ok' END) END AS text
FROM (SELECT event_id,
             CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'info'
                  WHEN 'click' THEN 'Debug' WHEN 'view' THEN 'WARN' ELSE 'WARNING' END AS lv
      FROM {events}) e
""")

_d("v_md", ("documents",), """
SELECT doc_id, concat(
  '# Title ', CAST(doc_id AS STRING), chr(10),
  '> opening quote', chr(10), chr(10),
  '   ### Indented heading ', CAST(doc_id % 5 AS STRING), '  ', chr(10),
  text, chr(10), chr(10),
  '```sql', chr(10), 'SELECT ', CAST(doc_id AS STRING), ';', chr(10), '# inside fence', chr(10),
  '```', chr(10),
  '####### seven hashes', chr(10), '#nospace', chr(10),
  CASE WHEN doc_id % 3 = 0 THEN concat('  ``` ', chr(10), 'plain words here', chr(10), '```', chr(10))
       ELSE '' END,
  '## Section ', CAST(doc_id % 7 AS STRING), chr(10),
  'Closing words about section and section ', CAST(doc_id % 7 AS STRING), '.', chr(10),
  CASE WHEN doc_id % 10 = 0 THEN concat('```python', chr(10), 'print(1)', chr(10)) ELSE '' END
) AS text
FROM {documents}
""")

_d("v_paragraphs", ("documents",), """
SELECT doc_id, concat('CHAPTER ', CAST(doc_id % 9 + 1 AS STRING), chr(10), chr(10),
  'Summary:', chr(10), ' ', chr(10), '1. Scope', chr(10), chr(10),
  CASE WHEN doc_id % 4 = 0 THEN concat('Section ', CAST(doc_id % 5 AS STRING), chr(10), chr(10)) ELSE '' END,
  'PART TWO NOTES', chr(10), chr(10), text) AS text
FROM {documents}
""")


_DIALECT = {
    "spark": {"OCTETS": "octet_length({0})", "SHA256": "sha2({0}, 256)", "EACH": "explode(sequence(1, {0}))"},
    "duckdb": {"OCTETS": "strlen({0})", "SHA256": "sha256({0})", "EACH": "unnest(range(1, CAST({0} AS BIGINT) + 1))"},
}


def _macros(sql: str, dialect: str) -> str:
    """Expands ``NAME(args)`` macros (balanced parentheses) for the dialect."""
    out, i = [], 0
    pat = re.compile(r"\b(OCTETS|SHA256|EACH)\(")
    while True:
        m = pat.search(sql, i)
        if not m:
            out.append(sql[i:])
            return "".join(out)
        depth, j = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out.append(sql[i:m.start()])
        out.append(_DIALECT[dialect][m.group(1)].format(_macros(sql[m.end():j - 1], dialect)))
        i = j


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build a derived input as a Spark DataFrame (lazy)."""
    spec = DERIVED[name]
    args = {}
    for dep in spec.deps:
        args[dep] = table(spark, sf_dir, dep) if dep in TABLES else derived(spark, sf_dir, dep)
    sql = _macros(spec.sql, "spark")
    if not args:
        return spark.sql(sql)
    # only dependency names are placeholders; every other brace is literal text
    sql = sql.replace("{", "{{").replace("}", "}}")
    for dep in spec.deps:
        sql = sql.replace("{{" + dep + "}}", "{" + dep + "}")
    return spark.sql(sql, **args)


def _order(names) -> list:
    out: list = []

    def visit(n):
        if n in TABLES or n in out:
            return
        for d in DERIVED[n].deps:
            visit(d)
        out.append(n)
    for n in names:
        visit(n)
    return out


def duck_with(*names: str) -> str:
    """``WITH`` clause defining the derived inputs for a DuckDB oracle."""
    parts = []
    for n in _order(names):
        sql = _macros(DERIVED[n].sql, "duckdb")
        for dep in DERIVED[n].deps:
            sql = sql.replace("{" + dep + "}", dep)
        parts.append(f"{n} AS (\n{sql}\n)")
    return "WITH " + ",\n".join(parts) + "\n"

_d("v_paged", ("documents",), """
SELECT doc_id, text, 1 + CAST(floor(length(text) / 1500) AS INT) AS n_pages FROM {documents}
""")

_d("v_prose", ("documents",), """
SELECT doc_id, concat(
  CASE WHEN doc_id % 7 = 0 THEN replace(text, chr(10), concat(chr(13), chr(10)))
       WHEN doc_id % 11 = 0 THEN replace(text, chr(10), chr(13)) ELSE text END,
  CASE WHEN doc_id % 5 = 0 THEN concat(chr(10), '这是第一句话。这是第二句话！Mixed 中文 words；最后一句')
       ELSE '' END,
  CASE WHEN doc_id % 6 = 0 THEN concat(chr(10), '  ', chr(9), 'Trailing   spaced   line', '...!!')
       ELSE '' END) AS text
FROM {documents}
""")

_d("v_code_lines", ("part",), """
SELECT concat(p.lang, '/m', CAST(CAST(floor(p.p_partkey / 700) AS BIGINT) AS STRING), CASE p.lang WHEN 'python' THEN '.py' WHEN 'typescript' THEN '.ts' WHEN 'go' THEN '.go' WHEN 'rust' THEN '.rs' WHEN 'java' THEN '.java' WHEN 'cpp' THEN '.cpp' ELSE '.rb' END) AS path,
       p.lang AS language,
       CAST(CAST(floor(p.p_partkey / 7) AS BIGINT) % 100 * 14 + t.off + 1 AS INT) AS line_no,
       replace(replace(t.tmpl, '{K}', CAST(p.p_partkey AS STRING)), '{N}', p.p_name) AS text
FROM (SELECT p_partkey, p_name,
             CASE p_partkey % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'go'
                  WHEN 3 THEN 'rust' WHEN 4 THEN 'java' WHEN 5 THEN 'cpp' ELSE 'ruby' END AS lang
      FROM {part}) p
JOIN (VALUES
  ('python', 0, 'import os'),
  ('python', 1, 'from pkg.mod{K} import thing'),
  ('python', 2, '# helper for {N}'),
  ('python', 3, 'def func_{K}(x):'),
  ('python', 4, '    \"\"\"Docstring for {N}.\"\"\"'),
  ('python', 5, '    return svc.a(x) + svc.b(x)'),
  ('python', 6, ''),
  ('python', 7, 'class Item{K}:'),
  ('python', 8, '    def _hidden(self):'),
  ('python', 9, 'async def load_{K}(y):'),
  ('python', 10, '    '''''''),
  ('python', 11, 'class Sample{K} spans lines'),
  ('python', 12, '    '''''''),
  ('typescript', 0, 'import { a } from ''./mod{K}'';'),
  ('typescript', 1, '/** Service {N} */'),
  ('typescript', 2, 'export class Service{K} {'),
  ('typescript', 3, '  private secret{K}(): void {'),
  ('typescript', 4, '  public run{K}(x: number): string {'),
  ('typescript', 5, '    if (x) { return svc.b(x); }'),
  ('typescript', 6, '// comment line'),
  ('typescript', 7, 'export const arrow{K} = async (a) => a;'),
  ('typescript', 8, 'function _hidden{K}() {'),
  ('typescript', 9, 'export interface Shape{K} { }'),
  ('typescript', 10, '  Logger.info(JSON.parse(x));'),
  ('go', 0, 'import ('),
  ('go', 1, '// Handler{K} handles {N}'),
  ('go', 2, 'type Handler{K} struct {'),
  ('go', 3, 'func (h *Handler{K}) Serve() {'),
  ('go', 4, 'func helper{K}(x int) int {'),
  ('go', 5, '}'),
  ('rust', 0, 'use std::io;'),
  ('rust', 1, '/// Widget {N}'),
  ('rust', 2, 'pub struct Widget{K} {'),
  ('rust', 3, 'pub fn build_{K}() -> u32 {'),
  ('rust', 4, 'async fn fetch_{K}() {'),
  ('rust', 5, 'enum Mode{K} { A, B }'),
  ('java', 0, 'import java.util.List;'),
  ('java', 1, '/* Bean {N} */'),
  ('java', 2, 'public class Bean{K} {'),
  ('java', 3, 'public static int compute{K}(int x) {'),
  ('java', 4, 'private void hidden{K}() {'),
  ('java', 5, 'interface Api{K} {'),
  ('cpp', 0, '#include <vector>'),
  ('cpp', 1, '#include "local{K}.h"'),
  ('cpp', 2, '#define MAX{K} 10'),
  ('cpp', 3, 'class Engine{K} {'),
  ('cpp', 4, 'int run{K}(int a) {'),
  ('cpp', 5, 'static int *alloc{K}(int n);'),
  ('cpp', 6, 'struct Pt{K} {'),
  ('cpp', 7, ' * star comment {K}'),
  ('ruby', 0, 'require "json"'),
  ('ruby', 1, '# Model {N}'),
  ('ruby', 2, 'class Model{K}'),
  ('ruby', 3, 'def process_{K}(x)'),
  ('ruby', 4, 'module Tools{K}'),
  ('ruby', 5, 'import_like {K}')) AS t(lang, off, tmpl) ON t.lang = p.lang
""")

_d("v_csv_lines", ("part",), """
SELECT path, CAST(rn + 1 AS INT) AS line_no,
  CASE WHEN rn % 13 = 0 THEN '   '
       WHEN rn % 31 = 0 THEN concat(CAST(p_partkey AS STRING), d, 'short', d, CAST(p_size AS STRING))
       ELSE concat(CAST(p_partkey AS STRING), d, '"', p_name, ' ', d, ' x"', d,
                   CAST(p_size AS STRING), CASE WHEN rn % 5 = 0 THEN '.5' ELSE '' END, d,
                   CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'no' END, d,
                   '2024-01-', lpad(CAST(p_size % 28 + 1 AS STRING), 2, '0'), d,
                   CASE WHEN rn < 3 THEN concat('text', CAST(p_partkey AS STRING)) ELSE CAST(p_partkey AS STRING) END)
  END AS text
FROM (SELECT p_partkey, p_name, p_size, concat('t', CAST(f AS STRING), '.csv') AS path,
             CASE f % 4 WHEN 0 THEN ',' WHEN 1 THEN chr(9) WHEN 2 THEN ';' ELSE '|' END AS d, p_partkey % 200 + 1 AS rn
      FROM (SELECT *, CAST(floor(p_partkey / 200) AS BIGINT) AS f FROM {part}) q) p
UNION ALL
SELECT concat('t', CAST(k AS STRING), '.csv') AS path, 1 AS line_no,
  CASE k % 4 WHEN 0 THEN 'id,name,size,flag,day,mixed' WHEN 1 THEN concat('id', chr(9), 'name', chr(9), 'size', chr(9), 'flag', chr(9), 'day', chr(9), 'mixed')
       WHEN 2 THEN 'id;name;size;flag;day;mixed' ELSE 'id|name|size|flag|day|mixed' END AS text
FROM (SELECT DISTINCT CAST(floor(p_partkey / 200) AS BIGINT) AS k FROM {part}) h
""")

_d("v_sheet_cells", ("part",), """
SELECT path, sheet, CASE WHEN o.ord < 5 THEN row_no ELSE 0 END AS row_no, CAST(o.ord % 5 AS INT) AS ord,
       CASE o.ord WHEN 0 THEN CAST(p_partkey AS STRING) WHEN 1 THEN p_name
         WHEN 2 THEN concat(CAST(p_size AS STRING), CASE WHEN row_no % 5 = 0 THEN '.5' ELSE '' END)
         WHEN 3 THEN CASE WHEN row_no % 3 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN 'yes' ELSE 'no' END
         WHEN 4 THEN concat(' 2024-02-', lpad(CAST(p_size % 28 + 1 AS STRING), 2, '0'), ' ') ELSE o.head END AS value
FROM (SELECT p_partkey, p_name, p_size, concat('w', CAST(CAST(floor(p_partkey / 400) AS BIGINT) AS STRING), '.xlsx') AS path,
             concat('S', CAST(CAST(floor(p_partkey / 200) AS BIGINT) % 2 AS STRING)) AS sheet, CAST(p_partkey % 200 + 1 AS INT) AS row_no
      FROM {part}) b
JOIN (VALUES (0, ''), (1, ''), (2, ''), (3, ''), (4, ''), (5, 'id'), (6, 'name'), (7, 'size'), (8, 'flag'), (9, '')) AS o(ord, head)
  ON (o.ord < 4 OR o.ord = 4 AND b.row_no % 4 <> 0 OR o.ord > 4 AND b.row_no = 1)
""")

_d("v_json", ("customer",), """
SELECT concat('cfg/c', CAST(c_custkey AS STRING), '.json') AS path,
  CASE WHEN c_custkey % 37 = 1 THEN concat('[', CAST(c_custkey AS STRING), ', {"a": 2}, "', c_name, '", null, [5]]')
       WHEN c_custkey % 37 = 2 THEN concat('"', c_name, '"') WHEN c_custkey % 37 = 3 THEN '{}' ELSE
  concat('{"name": "', c_name, '", "api_token": "tok', CAST(c_custkey AS STRING), '", ',
         '"nested": {"Password": "p', CAST(c_custkey AS STRING), '", "n": ', CAST(c_nationkey AS STRING),
         ', "deep": {"x": 1}, "label": "', c_mktsegment, '"}, ',
         '"tags": [1, 2, 3, 4, 5], "items": [{"secret": "s"}, {"k": 1}], "nothing": null, ',
         '"active": ', CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END, ', ',
         '"long": "', repeat('ab', 75), '", "segment": "', c_mktsegment, '", "empty_list": [], "empty_obj": {}, ',
         '"it''s": {"a.b": {"c d": [[1, {"token": 2, "z": {"y": {"x": {"w": ', CAST(c_custkey AS STRING), '}}}}], "s", [], {}]}}, "name": "again"',
         CASE WHEN c_custkey % 25 = 0 THEN '' ELSE '}' END) END AS content
FROM {customer}
""")

_YAML_LINES = [
    "# customer {C}", 'name: "Customer {C}"', "api_key: k{C}", "nation: {N}", "active: true",
    "segment: '{S}'", "url: http://x.example/{C}", "parent:", "  child_{C}: 1", "hex: 0x1F",
    'name: "dup {C}"', "", "db_password = secret{C}", "{N}: numeric key",
]
_YAML_VALUES = ", ".join("({}, '{}')".format(off, tmpl.replace("'", "''")) for off, tmpl in enumerate(_YAML_LINES))
_d("v_yaml", ("customer",), f"""
SELECT concat('cfg/y', CAST(CAST(floor(c_custkey / 30) AS BIGINT) AS STRING), '.yaml') AS path,
       CAST(c_custkey % 30 * 14 + t.off + 1 AS INT) AS line_no,
       replace(replace(replace(t.tmpl, '{{C}}', CAST(c_custkey AS STRING)), '{{S}}', c_mktsegment),
               '{{N}}', CAST(c_nationkey AS STRING)) AS text
FROM {{customer}} CROSS JOIN (VALUES {_YAML_VALUES}) AS t(off, tmpl)
""")

_d("v_selections", ("v_files",), """
SELECT project, rel_path AS sel FROM {v_files} WHERE doc_id % 50 = 7
UNION ALL SELECT DISTINCT project, 'en' AS sel FROM {v_files} WHERE doc_id % 3 = 0
UNION ALL SELECT DISTINCT project, 'de/' AS sel FROM {v_files} WHERE doc_id % 5 = 1
UNION ALL SELECT project, rel_path AS sel FROM {v_files} WHERE doc_id % 97 = 3 AND rel_path LIKE 'en/%'
""")

_d("v_templates", ("documents",), """
SELECT t.name AS name, t.body AS body FROM (VALUES
  ('brief', concat('# $PROJECT_NAME', chr(10), 'Files: $FILE_COUNT ($OUTLINE_COUNT as outline), ~$TOKEN_COUNT of $TOKEN_LIMIT',
                   chr(10), '$FILE_LIST', chr(10), 'Unknown: $MISSING_VAR', chr(10), 'Scope: $SCOPE')),
  ('treeonly', concat('$DIR_TREE', chr(10), '---', chr(10), '$PROJECT_NAME at $TIMESTAMP'))
) AS t(name, body)
UNION ALL
SELECT concat('docs_', lang), concat('# $PROJECT_NAME (', lang, ', ', CAST(count(*) AS STRING), ' documents)', chr(10), '$FILE_LIST') FROM {documents} GROUP BY lang
""")

_d("v_media", ("part",), """
SELECT concat('media/m', CAST(p_partkey AS STRING),
              CASE p_partkey % 6 WHEN 0 THEN '.png' WHEN 1 THEN '.gif' WHEN 2 THEN '.bmp' WHEN 3 THEN '.wav'
                   WHEN 4 THEN '.webp' ELSE '.gz' END) AS path,
  unhex(concat(
    CASE WHEN p_partkey % 10 = 9 THEN '00000000' ELSE '' END,
    CASE p_partkey % 6
      WHEN 0 THEN concat('89504E470D0A1A0A0000000D49484452', lpad(hex(p_size * 10), 8, '0'), lpad(hex(p_size * 7), 8, '0'),
                         '08', CASE WHEN p_partkey % 4 = 0 THEN '06' ELSE '02' END, '000000')
      WHEN 1 THEN concat('474946383961', substring(lpad(hex(p_size * 4), 4, '0'), 3, 2), substring(lpad(hex(p_size * 4), 4, '0'), 1, 2),
                         substring(lpad(hex(p_size * 3), 4, '0'), 3, 2), substring(lpad(hex(p_size * 3), 4, '0'), 1, 2),
                         CASE WHEN p_partkey % 4 = 1 THEN 'F7' ELSE '00' END, '0000')
      WHEN 2 THEN concat('424D', '000000000000000036000000', '28000000',
                         substring(lpad(hex(p_size * 2), 4, '0'), 3, 2), substring(lpad(hex(p_size * 2), 4, '0'), 1, 2), '0000',
                         CASE WHEN p_partkey % 4 = 2 THEN 'F6FFFFFF' ELSE '20000000' END, '0100',
                         CASE WHEN p_partkey % 3 = 0 THEN '2000' ELSE '1800' END)
      WHEN 3 THEN concat('52494646', '24000000', '57415645', '666D7420', '10000000', '0100',
                         CASE WHEN p_partkey % 4 = 3 THEN '0200' ELSE '0100' END,
                         '44AC0000', '10B10200', '0400', '1000')
      WHEN 4 THEN concat('52494646', '24000000', '57454250',
                         CASE WHEN p_partkey % 4 = 0 THEN concat('5650384C', '0A000000', '2F', lpad(hex(p_size), 2, '0'), '400000')
                              ELSE concat('56503820', '0A000000', '000000000000', '9D012A', lpad(hex(p_size), 2, '0'), '00',
                                          lpad(hex(p_size), 2, '0'), '00') END)
      ELSE concat('1F8B', CASE WHEN p_partkey % 4 = 1 THEN '08' ELSE '03' END, '0000000000000003') END)) AS head
FROM {part}
""")

# whole files: a start of frame behind a JPEG segment, a ZIP end record, a font with and without a
# name table, an MPEG audio frame or an ID3 tag
_d("v_media_files", ("part",), """
SELECT concat('files/m', CAST(p_partkey AS STRING), CASE p_partkey % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.zip' WHEN 2 THEN '.ttf' ELSE '.mp3' END) AS path,
  unhex(CASE p_partkey % 4
    WHEN 0 THEN concat('FFD8FFE000104A46494600010100000100010000', CASE WHEN p_partkey % 8 = 0 THEN 'FFC0001108' ELSE 'FFC200110C' END,
                       lpad(hex(p_size * 3), 4, '0'), lpad(hex(p_size * 4 + 1), 4, '0'), '03', repeat('00', 12))
    WHEN 1 THEN concat('504B0304', repeat('00', 26), '504B050600000000', lpad(hex(p_size), 2, '0'), '00', lpad(hex(p_size), 2, '0'), '00', repeat('00', 10))
    WHEN 2 THEN CASE WHEN p_partkey % 8 = 2 THEN concat('000100000002', repeat('00', 6), '636D6170', repeat('00', 12), '6E616D65', repeat('00', 4), '0000002C', '00000018',
                            '000000010012', '00030001040900010006', '0000', '0046', '003', substring(lpad(CAST(p_size AS STRING), 2, '0'), 1, 1),
                            '003', substring(lpad(CAST(p_size AS STRING), 2, '0'), 2, 1))
                     ELSE concat('000100000001', repeat('00', 6), '636D6170', repeat('00', 12)) END
    ELSE CASE WHEN p_partkey % 8 = 3 THEN concat('0000FFFB', substring('0123456789ABCDE', p_size % 14 + 2, 1), CASE WHEN p_partkey % 3 = 0 THEN '4' ELSE '0' END,
                                                 CASE WHEN p_partkey % 5 = 0 THEN 'C4' ELSE '44' END, repeat('00', 12))
              ELSE concat('494433', repeat('00', 20)) END END) AS content
FROM {part}
""")

_d("v_calls", ("events",), """
SELECT concat('flow/u', CAST(user_id % 10 AS STRING), '.ts') AS path, concat('fn', CAST(user_id AS STRING)) AS fn,
       CAST(event_id + 1 AS BIGINT) AS seq,
       CASE event_type WHEN 'click' THEN (CASE WHEN event_id % 3 = 0 THEN 'svc.view' ELSE 'svc.click' END)
            WHEN 'view' THEN 'svc.view' WHEN 'error' THEN (CASE WHEN event_id % 2 = 0 THEN 'Logger.error' ELSE 'Logger.info' END)
            WHEN 'purchase' THEN (CASE WHEN event_id % 5 = 0 THEN 'JSON.stringify' ELSE 'db.buy' END)
            ELSE (CASE WHEN event_id % 4 = 0 THEN 'fs.writeFile' ELSE 'db.signup' END) END AS callee
FROM {events}
""")

_d("v_steps", ("events",), """
SELECT concat('flow/u', CAST(user_id % 10 AS STRING), '.ts') AS path, concat('fn', CAST(user_id AS STRING)) AS fn,
       CAST(event_id + 1 AS BIGINT) AS seq,
       CASE event_id % 6 WHEN 2 THEN 'if' WHEN 3 THEN 'return' WHEN 4 THEN 'for' WHEN 1 THEN 'while' ELSE 'call' END AS kind,
       CASE event_id % 6 WHEN 2 THEN concat('if (', event_type, ' > ', CAST(event_id % 97 AS STRING), ')')
            WHEN 3 THEN 'return'
            WHEN 4 THEN concat('for (const item of items', CAST(event_id % 13 AS STRING), ' and a long trailing description that keeps going past the label width limit)')
            WHEN 1 THEN concat('while (queue', CAST(event_id % 7 AS STRING), '.length)')
            ELSE concat('-> ', event_type) END AS label
FROM {events}
""")

_d("v_flow", ("events",), """
SELECT concat('flow/u', CAST(user_id % 10 AS STRING), '.ts') AS path, concat('fn', CAST(user_id AS STRING)) AS fn,
       CAST(event_id + 1 AS BIGINT) AS seq,
       CASE WHEN user_id % 3 = 0 THEN CASE WHEN event_id % 9 = 0 THEN '-> db.buy' WHEN event_id % 5 = 0 THEN '# decl' ELSE '~ misc' END
            WHEN event_id % 41 = 0 THEN '…(3 more)' WHEN event_id % 6 = 3 THEN '<- return' WHEN event_id % 6 = 2 THEN 'switch kind'
            WHEN event_id % 6 = 4 THEN '-> svc.view' WHEN event_id % 6 = 1 AND user_id % 3 = 1 THEN 'log: info' ELSE '~ misc' END AS line
FROM {events}
""")

# the same steps numbered in each user's order of time, as the sequence rewrites take them
IN_TIME = "CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq"
for _steps in ("v_calls", "v_steps", "v_flow"):
    _d(f"{_steps}_in_time", ("events",), DERIVED[_steps].sql.replace("CAST(event_id + 1 AS BIGINT) AS seq", IN_TIME))


def duck_in_time(name: str) -> str:
    """``WITH`` clause that defines ``name`` numbered in order of time."""
    return duck_with(f"{name}_in_time").replace(f"{name}_in_time", name)


_d("v_outline_lines", ("events",), """
SELECT concat('out/o', CAST(CAST(floor(event_id / 200) AS BIGINT) AS STRING), '.txt') AS path, CAST(event_id % 200 + 1 AS INT) AS line_no,
       CASE (event_id + user_id) % 11 WHEN 0 THEN concat('fn work', CAST(event_id AS STRING), '(x)') WHEN 1 THEN concat('dep: svc.', event_type, ', db.buy, fs.write', CAST(user_id % 7 AS STRING))
            WHEN 2 THEN 'flow:' WHEN 3 THEN concat('  -> svc.', event_type) WHEN 4 THEN concat('path: svc.view → fs.write', CAST(user_id % 5 AS STRING))
            WHEN 5 THEN 'ctl: 2br 1lp ' WHEN 6 THEN 'ctl: 2br 1lp if (x)' WHEN 7 THEN '  -> Logger.info' WHEN 8 THEN '  log: info, log: warn' WHEN 9 THEN '' ELSE 'dep: ' END AS text
FROM {events}
""")

_d("v_slides", ("conversations",), """
SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS slide_no, 0 AS seq, 'title' AS field, text
FROM {conversations} WHERE role = 'user' AND turn % 3 = 0
UNION ALL SELECT conv_id, CAST(turn + 1 AS INT), 1, 'text', text FROM {conversations} WHERE role = 'assistant'
UNION ALL SELECT conv_id, CAST(turn + 1 AS INT), 2, 'content', upper(text) FROM {conversations}
  WHERE role = 'assistant' AND conv_id % 4 = 0
UNION ALL SELECT conv_id, CAST(turn + 1 AS INT), CAST(10 + i AS INT), 'element', concat(CASE WHEN i % 3 = 0 THEN '  ' ELSE '' END, split_part(text, chr(10), CAST(i AS INT)))
  FROM (SELECT conv_id, turn, text, EACH(length(text) - length(replace(text, chr(10), '')) + 1) AS i FROM {conversations} WHERE role = 'user') u
UNION ALL SELECT conv_id, CAST(turn + 1 AS INT), 11, 'element', '' FROM {conversations} WHERE role = 'system'
""")

# (number, number of the parent, kind, beginning of the name, which parts have it); 8 to 19 nest
# ever deeper
_SYMBOLS = [(1, 0, "class", "Item", "TRUE"), (2, 1, "method", "run", "TRUE"), (3, 1, "method", "_hidden", "TRUE"), (4, 3, "function", "inner", "TRUE"),
            (5, 0, "function", "helper", "p_partkey % 5 <> 0"), (20, 0, "function", "#priv", "p_partkey % 5 = 0"), (6, 2, "method", "deep", "p_partkey % 3 = 0"),
            (7, 0, "namespace", "_ns", "p_partkey % 7 = 0"), *((n, n - 1 if n > 8 else 2, "function", f"level{n - 7}of", "p_partkey % 11 = 0") for n in range(8, 20))]
_d("v_symbols", ("part",), """
SELECT concat('sym/f', CAST(CAST(floor(p_partkey / 40) AS BIGINT) AS STRING), '.ts') AS path, p_partkey * 32 + t.off AS id,
       CASE WHEN t.up > 0 THEN p_partkey * 32 + t.up END AS parent_id, t.kind AS kind, concat(t.start, CAST(p_partkey AS STRING)) AS name,
       CAST(p_partkey * 32 + t.off AS INT) AS line_no
FROM {part} JOIN (VALUES """ + ", ".join(f"({n}, {up}, '{kind}', '{start}')" for n, up, kind, start, _ in _SYMBOLS) + """) AS t(off, up, kind, start)
  ON CASE t.off """ + " ".join(f"WHEN {n} THEN {when}" for n, _, _, _, when in _SYMBOLS) + """ END
""")

_d("v_outline_store", ("v_files",), """
SELECT SHA256(concat_ws(chr(1), path, content, 'standard')) AS key FROM {v_files} WHERE doc_id % 2 = 0
UNION ALL SELECT SHA256(concat_ws(chr(1), path, content, 'detailed')) FROM {v_files} WHERE doc_id % 3 = 0
""")
