"""§ code profile and regex outlines over ``v_code_lines`` (derived from ``part``)."""

from pyspark.sql import functions as F

from quire.operators import code as C
from quire.plans.common import finish
from quire.plans.registry import query
from quire.plans.sqlfrag import trim
from quire.sources.fixtures import derived, duck_with


def _q(p: str) -> str:
    return p.replace("'", "''")


def _any_sql(t: str, pats) -> str:
    parts = []
    for p, neg in pats:
        c = f"regexp_matches({t}, '{_q(p)}')"
        if neg:
            c = f"({c} AND NOT regexp_matches({t}, '{_q(neg)}'))"
        parts.append(c)
    return "(" + " OR ".join(parts) + ")"


def match_sql(kind: str, t: str = "t", lang: str = "language") -> str:
    whens = " ".join(f"WHEN '{name}' THEN {_any_sql(t, pats[kind])}" for name, pats in C.LANG_PATTERNS.items())
    return f"coalesce(CASE lower({lang}) {whens} ELSE {_any_sql(t, C.FALLBACK_PATTERNS[kind])} END, false)"


BASE = duck_with("v_code_lines") + f"""
, t AS (SELECT path, language, line_no, {trim('text')} AS t FROM v_code_lines)
"""
CUT = "CASE WHEN kind = 'function' THEN substring(t, 1, 120) ELSE substring(t, 1, 100) END"


def _lines(spark, sf):
    return derived(spark, sf, "v_code_lines")


@query("code_structure", BASE + f"""
, k AS (SELECT path, 'type' AS kind, line_no, t FROM t WHERE {match_sql('type')} AND NOT starts_with(t, '//')
        UNION ALL
        SELECT path, 'function', line_no, t FROM t
        WHERE {match_sql('function')} AND NOT starts_with(t, '//') AND NOT starts_with(t, '*')
        UNION ALL
        SELECT path, 'import', line_no, t FROM t WHERE {match_sql('import')}),
r AS (SELECT *, row_number() OVER (PARTITION BY path, kind ORDER BY line_no) AS ord FROM k)
SELECT path, kind, ord, line_no, CASE WHEN kind = 'import' THEN t ELSE {CUT} END AS text
FROM r WHERE (kind = 'type' AND ord <= 20) OR (kind = 'function' AND ord <= 30) OR kind = 'import'
""")
def code_structure(spark, sf):
    return finish(C.code_structure(_lines(spark, sf)))


SYMS = BASE + f"""
, nb AS (SELECT *, (starts_with(t, '//') OR starts_with(t, '*') OR starts_with(t, '/*')
                    OR (starts_with(t, '#') AND NOT starts_with(t, '#include'))) AS skip
         FROM t WHERE t <> ''),
k AS (SELECT path, 'import' AS kind, line_no, t FROM nb WHERE {match_sql('import')}
      UNION ALL SELECT path, 'type', line_no, t FROM nb WHERE NOT skip AND {match_sql('type')}
      UNION ALL SELECT path, 'function', line_no, t FROM nb WHERE NOT skip AND {match_sql('function')}),
sym AS (SELECT path, kind, line_no, {CUT} AS text FROM k)
"""
PRIV = (f"(contains({trim('text')}, 'private ') OR starts_with({trim('text')}, '#') "
        f"OR regexp_matches({trim('text')}, '{C.PRIVATE_RE}'))")


@query("outline_symbols", SYMS + "SELECT path, kind, line_no, text FROM sym")
def outline_symbols(spark, sf):
    return finish(C.outline_symbols(_lines(spark, sf)))


@query("outline_private_filter", SYMS + f"""
SELECT path, kind, line_no, text FROM sym WHERE kind = 'import' OR NOT {PRIV}
""")
def outline_private_filter(spark, sf):
    return finish(C.outline_private_filter(C.outline_symbols(_lines(spark, sf))))


@query("outline_caps", SYMS + f"""
, f AS (SELECT * FROM sym WHERE kind = 'import' OR NOT {PRIV}),
tot AS (SELECT path, kind, count(*) AS total FROM f GROUP BY path, kind),
r AS (SELECT *, row_number() OVER (PARTITION BY path, kind ORDER BY line_no) AS ord FROM f)
SELECT r.path, r.kind, ord, line_no, text, total, greatest(total - 50, 0) AS more
FROM r JOIN tot ON r.path = tot.path AND r.kind = tot.kind WHERE ord <= 50
""")
def outline_caps(spark, sf):
    shown, totals = C.outline_caps(C.outline_private_filter(C.outline_symbols(_lines(spark, sf))))
    return finish(shown.join(totals.select("path", "kind", "total", "more"), ["path", "kind"])
                  .select("path", "kind", "ord", "line_no", "text", "total", "more"))


@query("signature_extract", SYMS + """
, s AS (SELECT path, line_no, kind, regexp_replace(text, '^//\\s*', '') AS x FROM sym WHERE kind <> 'import')
SELECT path, line_no, kind,
       CASE WHEN regexp_matches(x, '^[^{]*?(?:\\s*\\{)?$')
            THEN """ + trim("regexp_extract(x, '^([^{]*?)(?:\\s*\\{)?$', 1)") + """
            ELSE substring(x, 1, 80) END AS signature
FROM s
""")
def signature_extract(spark, sf):
    s = C.outline_symbols(_lines(spark, sf)).where(F.col("kind") != "import")
    return finish(s.select("path", "line_no", "kind", C.signature(F.col("text")).alias("signature")))


def _comment_sql(t: str) -> str:
    tr = lambda x: trim(x)
    return (f"CASE WHEN starts_with({t}, '///') THEN {tr(f'regexp_replace({t}, ' + chr(39) + '^///\\s?' + chr(39) + ', ' + chr(39) + chr(39) + ')')} "
            f"WHEN starts_with({t}, '//') THEN {tr(f'regexp_replace({t}, ' + chr(39) + '^//\\s?' + chr(39) + ', ' + chr(39) + chr(39) + ')')} "
            f"WHEN starts_with({t}, '#') THEN {tr(f'regexp_replace({t}, ' + chr(39) + '^#\\s?' + chr(39) + ', ' + chr(39) + chr(39) + ')')} "
            f"WHEN ends_with({t}, '*/') THEN {tr(f'regexp_replace({t}, ' + chr(39) + '\\*/$' + chr(39) + ', ' + chr(39) + chr(39) + ')')} "
            f"WHEN starts_with({t}, '*') THEN {tr(f'regexp_replace({t}, ' + chr(39) + '^\\*\\s?' + chr(39) + ', ' + chr(39) + chr(39) + ')')} "
            f"WHEN starts_with({t}, '/*') THEN {tr(f'regexp_replace({t}, ' + chr(39) + '^/\\*+\\s?' + chr(39) + ', ' + chr(39) + chr(39) + ')')} END")


LEAD = SYMS + f"""
, lt AS (SELECT path, line_no, t, {_comment_sql('t')} AS c, t = '' AS blank FROM t),
lt2 AS (SELECT *, max(CASE WHEN NOT blank THEN line_no END) OVER (PARTITION BY path ORDER BY line_no
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_nonblank,
              coalesce(max(CASE WHEN c IS NULL THEN line_no END) OVER (PARTITION BY path ORDER BY line_no
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS block FROM lt),
ss AS (SELECT DISTINCT path, line_no AS s FROM sym WHERE kind <> 'import'),
above AS (SELECT ss.path, ss.s, a.last_nonblank, cm.block FROM ss
          JOIN lt2 a ON a.path = ss.path AND a.line_no = ss.s
          JOIN lt2 cm ON cm.path = ss.path AND cm.line_no = a.last_nonblank AND cm.c IS NOT NULL),
items AS (SELECT ab.path, ab.s, c2.line_no, c2.c FROM above ab
          JOIN lt2 c2 ON c2.path = ab.path AND c2.block = ab.block AND c2.c IS NOT NULL AND c2.c <> ''
                         AND c2.line_no <= ab.last_nonblank),
it2 AS (SELECT *, row_number() OVER (PARTITION BY path, s ORDER BY line_no DESC) AS k,
               sum(length(c) + 1) OVER (PARTITION BY path, s ORDER BY line_no DESC
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS len_before FROM items),
lead_doc AS (SELECT path, s AS line_no, substring(string_agg(c, ' ' ORDER BY line_no), 1, 160) AS doc FROM it2
             WHERE k = 1 OR len_before <= 160 GROUP BY path, s)
"""


@query("leading_doc", LEAD + "SELECT path, line_no, doc FROM lead_doc")
def leading_doc(spark, sf):
    lines = _lines(spark, sf)
    return finish(C.leading_docs(lines, C.outline_symbols(lines)))


@query("following_docstring", LEAD + f"""
, fs AS (SELECT t.path, t.line_no, t.t, ss.s IS NOT NULL AS is_sym FROM t LEFT JOIN ss ON ss.path = t.path AND ss.s = t.line_no),
fo AS (SELECT *, max(CASE WHEN is_sym THEN line_no END) OVER (PARTITION BY path ORDER BY line_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner FROM fs),
body AS (SELECT * FROM fo WHERE owner IS NOT NULL AND line_no > owner),
op0 AS (SELECT path, owner, min(line_no) AS q FROM body WHERE t <> '' GROUP BY path, owner),
op AS (SELECT op0.path, op0.owner, op0.q, b.t AS qt,
              CASE WHEN starts_with(b.t, '\"\"\"') THEN '\"\"\"' WHEN starts_with(b.t, '''''''') THEN '''''''' END AS quote
       FROM op0 JOIN body b ON b.path = op0.path AND b.owner = op0.owner AND b.line_no = op0.q),
op2 AS (SELECT *, substring(qt, 4) AS rest, ends_with(substring(qt, 4), quote) AS same FROM op WHERE quote IS NOT NULL),
later AS (SELECT b.path, o.owner, b.line_no, b.t, o.q, o.quote FROM t b
          JOIN op2 o ON o.path = b.path AND NOT o.same WHERE b.line_no > o.q),
cl AS (SELECT path, owner, min(line_no) AS close FROM later WHERE ends_with(t, quote) GROUP BY path, owner),
mid AS (SELECT l.path, l.owner, l.line_no,
               CASE WHEN l.line_no = cl.close THEN {trim('substring(l.t, 1, length(l.t) - 3)')} ELSE l.t END AS p
        FROM later l LEFT JOIN cl ON cl.path = l.path AND cl.owner = l.owner
        WHERE cl.close IS NULL OR l.line_no <= cl.close),
fst AS (SELECT path, owner, q AS line_no,
               {trim("CASE WHEN same THEN substring(rest, 1, length(rest) - 3) ELSE rest END")} AS p FROM op2),
parts AS (SELECT * FROM fst UNION ALL SELECT * FROM mid)
SELECT path, owner AS line_no, substring(string_agg(p, ' ' ORDER BY line_no), 1, 160) AS doc FROM parts p
WHERE p <> '' AND NOT EXISTS (SELECT 1 FROM lead_doc d WHERE d.path = p.path AND d.line_no = p.owner)
GROUP BY path, owner
""")
def following_docstring(spark, sf):
    lines = _lines(spark, sf)
    syms = C.outline_symbols(lines)
    fd = C.following_docstrings(lines, syms)
    return finish(fd.join(C.leading_docs(lines, syms).select("path", "line_no"), ["path", "line_no"], "left_anti"))


@query("outline_from_symbols", "WITH RECURSIVE " + duck_with("v_symbols")[5:] + f"""
, s AS (SELECT * FROM v_symbols),
r0 AS (SELECT *, CASE WHEN lower(kind) IN ('class', 'interface', 'struct', 'enum') THEN 'type'
                      WHEN lower(kind) IN ('function', 'method', 'constructor') THEN 'function'
                      WHEN lower(kind) IN ('namespace', 'module') THEN 'namespace' END AS class
       FROM s WHERE parent_id IS NULL),
tree AS (
  SELECT path, id, id AS root, class, (starts_with(name, '_') OR starts_with(name, '#')) AND class <> 'namespace' AS hidden,
         0 AS depth FROM r0 WHERE class IS NOT NULL
  UNION ALL
  SELECT s.path, s.id, t.root, t.class,
         t.hidden OR ((starts_with(s.name, '_') OR starts_with(s.name, '#')) AND t.class <> 'namespace'), t.depth + 1
  FROM s JOIN tree t ON s.path = t.path AND s.parent_id = t.id),
cnt AS (SELECT path, root, count_if(depth = 1) AS members, count(*) AS nested FROM tree WHERE NOT hidden AND depth > 0
        GROUP BY path, root),
vis AS (SELECT t.path, t.root, t.class, s.name, s.line_no,
               row_number() OVER (PARTITION BY t.path, t.class ORDER BY s.line_no, t.root) AS ord
        FROM tree t JOIN s ON s.path = t.path AND s.id = t.root WHERE NOT t.hidden AND t.depth = 0)
SELECT v.path, v.class, v.ord, v.name, v.line_no, coalesce(c.members, 0) AS members, coalesce(c.nested, 0) AS nested
FROM vis v LEFT JOIN cnt c ON c.path = v.path AND c.root = v.root WHERE v.ord <= 50
""")
def outline_from_symbols(spark, sf):
    return finish(C.outline_from_symbols(derived(spark, sf, "v_symbols")))


CANDS = SYMS + """
, c1 AS (SELECT path, 1 AS priority, 'semantic' AS source,
                '// FUNCTIONS' || chr(10) || string_agg(text, chr(10) ORDER BY line_no) AS text
         FROM sym WHERE kind = 'function' AND contains(text, 'async') GROUP BY path),
c2 AS (SELECT path, 2 AS priority, 'regex' AS source,
              '// TYPES' || chr(10) || string_agg(text, chr(10) ORDER BY line_no) AS text
       FROM sym WHERE kind = 'type' GROUP BY path),
c3 AS (SELECT DISTINCT path, 3 AS priority, 'summary' AS source, 'summary of ' || path AS text FROM t),
cands AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3),
cv AS (SELECT *, (regexp_matches(text, '(?m)^//\\s+(TYPES|FUNCTIONS|IMPORTS|DEPENDENCIES)')
                  OR regexp_matches(text, '(?m)──\\s*semantic|·\\s*v1\\.[0-9]|^\\s*fn\\s'))
                 AND length(""" + trim("text") + """) >= 50 AS valid FROM cands)
"""


def _candidates(spark, sf):
    sym = C.outline_symbols(_lines(spark, sf))
    def agg(df, header):
        return df.groupBy("path").agg(F.concat(F.lit(header + "\n"), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")).alias("text"))
    c1 = agg(sym.where((F.col("kind") == "function") & F.col("text").contains("async")), "// FUNCTIONS") \
        .select("path", F.lit(1).alias("priority"), F.lit("semantic").alias("source"), "text")
    c2 = agg(sym.where(F.col("kind") == "type"), "// TYPES") \
        .select("path", F.lit(2).alias("priority"), F.lit("regex").alias("source"), "text")
    c3 = _lines(spark, sf).select("path").distinct().select(
        "path", F.lit(3).alias("priority"), F.lit("summary").alias("source"),
        F.concat(F.lit("summary of "), F.col("path")).alias("text"))
    return c1.unionByName(c2).unionByName(c3)


@query("outline_choose", CANDS + """
, best AS (SELECT path, arg_min(source, priority) AS bs, arg_min(text, priority) AS bt FROM cv WHERE valid GROUP BY path),
lst AS (SELECT path, arg_max(source, priority) AS ls, arg_max(text, priority) AS lt FROM cv GROUP BY path)
SELECT lst.path, coalesce(bs, ls) AS source, coalesce(bt, lt) AS text FROM lst LEFT JOIN best ON lst.path = best.path
""")
def outline_choose(spark, sf):
    return finish(C.outline_choose(_candidates(spark, sf)))


@query("outline_incremental", duck_with("v_files", "v_outline_store") + """
SELECT path, sha256(concat_ws(chr(1), path, content, 'standard')) AS key FROM v_files
WHERE sha256(concat_ws(chr(1), path, content, 'standard')) NOT IN (SELECT key FROM v_outline_store)
""")
def outline_incremental(spark, sf):
    todo = C.outline_incremental(derived(spark, sf, "v_files"), derived(spark, sf, "v_outline_store"), "standard")
    return finish(todo.select("path", "key"))


BAR = "// ═══════════════════════════════════════"


@query("render_outline", LEAD + f"""
, f AS (SELECT * FROM sym WHERE kind = 'import' OR NOT {PRIV}),
tot AS (SELECT path, kind, count(*) AS total FROM f GROUP BY path, kind),
r AS (SELECT *, row_number() OVER (PARTITION BY path, kind ORDER BY line_no) AS ord FROM f),
sec AS (SELECT r.path, r.kind, '{BAR}' || chr(10) || '// ' || CASE r.kind WHEN 'type' THEN 'TYPES' WHEN 'function' THEN 'FUNCTIONS' ELSE 'IMPORTS/DEPENDENCIES' END
               || chr(10) || '{BAR}' || chr(10)
               || string_agg('// ' || text || CASE WHEN r.kind <> 'import' AND length(coalesce(d.doc, '')) > 0 THEN ' [doc: ' || d.doc || ']' ELSE '' END, chr(10) ORDER BY ord)
               || CASE WHEN max(total) > 50 THEN chr(10) || '// ... (' || CAST(max(total) - 50 AS VARCHAR) || ' more ' || r.kind || 's)' ELSE '' END AS s
        FROM r JOIN tot ON tot.path = r.path AND tot.kind = r.kind LEFT JOIN lead_doc d ON d.path = r.path AND d.line_no = r.line_no WHERE ord <= 50 GROUP BY r.path, r.kind),
p AS (SELECT path, max(s) FILTER (kind = 'type') AS a, max(s) FILTER (kind = 'function') AS b, max(s) FILTER (kind = 'import') AS c FROM sec GROUP BY path)
SELECT path, array_to_string(list_concat(list_concat(CASE WHEN a IS NULL THEN CAST([] AS VARCHAR[]) ELSE [a, ''] END,
                                                     CASE WHEN b IS NULL THEN CAST([] AS VARCHAR[]) ELSE [b, ''] END),
                                         CASE WHEN c IS NULL THEN CAST([] AS VARCHAR[]) ELSE [c] END), chr(10)) AS text FROM p
""")
def render_outline(spark, sf):
    from quire.operators.render import render_outline as outline
    return outline(_lines(spark, sf))
