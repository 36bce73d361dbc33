"""§ call and flow analytics over ``v_calls`` / ``v_steps`` (from ``events``) and code lines."""

from quire.operators import code as CO
from quire.operators import flow as FL
from quire.plans.code_q import SYMS
from quire.plans.common import finish
from quire.plans.registry import query
from quire.sources.fixtures import derived, duck_in_time, duck_with

GLOB = ", ".join(f"'{g}'" for g in FL.TRIVIAL_GLOBALS)
KW = ", ".join(f"'{k}'" for k in FL.KEYWORDS)
TRIV = f"split_part(callee, '.', 1) IN ({GLOB})"
PREFIX = "CASE " + " ".join(f"WHEN starts_with(callee, '{p}') THEN '{p}'" for p in FL.GROUP_PREFIXES) + " END"
SIDE = ("(contains(lower(callee), 'logger') OR contains(lower(callee), 'writefile') OR contains(lower(callee), 'clipboard')"
        " OR contains(lower(callee), 'showinformationmessage') OR contains(lower(callee), 'showwarningmessage')"
        " OR contains(lower(callee), 'showerrormessage') OR contains(lower(callee), 'vscode.')"
        " OR starts_with(lower(callee), 'fs.') OR contains(callee, 'executeCommand'))")


def _calls(spark, sf):
    return derived(spark, sf, "v_calls")


def _steps(spark, sf):
    return derived(spark, sf, "v_steps")


@query("call_sites", duck_with("v_code_lines") + f"""
, e AS (SELECT path, line_no, regexp_extract_all(text, '{FL.CALL_RE}', 1) AS cs FROM v_code_lines),
x AS (SELECT path, line_no, generate_subscripts(cs, 1) - 1 AS ord, unnest(cs) AS callee FROM e)
SELECT path, line_no, ord, callee FROM x WHERE callee NOT IN ({KW}) AND NOT {TRIV}
""")
def call_sites(spark, sf):
    return finish(FL.call_sites(derived(spark, sf, "v_code_lines")))


DEPS = duck_with("v_calls", "v_steps") + f"""
, d AS (SELECT DISTINCT path, fn, callee FROM v_calls WHERE NOT {TRIV}),
p AS (SELECT *, {PREFIX} AS prefix FROM d),
n AS (SELECT path, fn, prefix, count(*) AS n FROM p WHERE prefix IS NOT NULL GROUP BY path, fn, prefix),
dep0 AS (SELECT DISTINCT p.path, p.fn, CASE WHEN n.n >= 2 THEN p.prefix || '*' ELSE p.callee END AS dep
         FROM p LEFT JOIN n ON p.path = n.path AND p.fn = n.fn AND p.prefix = n.prefix),
depr AS (SELECT *, row_number() OVER (PARTITION BY path, fn ORDER BY lower(dep), dep) AS rank FROM dep0),
deps AS (SELECT path, fn, rank, dep FROM depr WHERE rank <= 28),
fp AS (SELECT path, fn, callee, min(seq) AS s FROM v_calls WHERE NOT {TRIV} GROUP BY path, fn, callee),
fpn AS (SELECT path, fn, count(*) AS n, count_if(NOT starts_with(callee, 'Logger.')) AS nl FROM fp GROUP BY path, fn),
paths AS (SELECT fp.path, fp.fn, string_agg(callee, ' → ' ORDER BY s) AS flow FROM fp JOIN fpn ON fp.path = fpn.path AND fp.fn = fpn.fn
          WHERE fpn.n >= 2 AND (fpn.nl = 0 OR NOT starts_with(callee, 'Logger.')) GROUP BY fp.path, fp.fn)
"""


@query("call_dependencies", DEPS + "SELECT * FROM deps")
def call_dependencies(spark, sf):
    return finish(FL.dependencies(_calls(spark, sf)))


@query("side_effect_calls", DEPS + f"""
, fx AS (SELECT path, fn, callee, min(seq) AS first_seq FROM v_calls
         WHERE {SIDE} AND callee <> 'Logger.debug' AND NOT {TRIV} GROUP BY path, fn, callee),
fx2 AS (SELECT * FROM fx WHERE NOT EXISTS (SELECT 1 FROM deps WHERE deps.path = fx.path AND deps.fn = fx.fn AND deps.dep = fx.callee)),
r AS (SELECT *, row_number() OVER (PARTITION BY path, fn ORDER BY first_seq) AS rank FROM fx2)
SELECT path, fn, rank, callee FROM r WHERE rank <= 15
""")
def side_effect_calls(spark, sf):
    c = _calls(spark, sf)
    return finish(FL.side_effects(c, FL.dependencies(c)))


def _samples(kinds):
    ks = ", ".join(f"'{k}'" for k in kinds)
    return (f"coalesce(array_to_string(list_transform((list(label ORDER BY seq) FILTER (WHERE kind IN ({ks})))[1:4], "
            f"lambda l: substring(l, 1, 82)), ' | '), '')")


@query("control_counts", duck_with("v_steps") + f"""
SELECT path, fn, count_if(kind IN ('if', 'switch', 'try')) AS branches, count_if(kind IN ('for', 'while', 'do')) AS loops,
       {_samples(FL.BRANCH_KINDS)} AS branch_samples, {_samples(FL.LOOP_KINDS)} AS loop_samples
FROM v_steps GROUP BY path, fn
""")
def control_counts(spark, sf):
    return finish(FL.control_counts(_steps(spark, sf)))


@query("flow_run_length", duck_in_time("v_calls") + """
, i AS (SELECT *, row_number() OVER (PARTITION BY path, fn ORDER BY seq)
                 - row_number() OVER (PARTITION BY path, fn, callee ORDER BY seq) AS isl FROM v_calls),
g AS (SELECT path, fn, callee, isl, min(seq) AS first_seq, count(*) AS n FROM i GROUP BY path, fn, callee, isl)
SELECT path, fn, first_seq, CASE WHEN n > 1 THEN callee || '×' || CAST(n AS VARCHAR) ELSE callee END AS step FROM g
""")
def flow_run_length(spark, sf):
    return finish(FL.run_length(derived(spark, sf, "v_calls_in_time")))


@query("flow_early_returns", duck_in_time("v_steps") + """
, s AS (SELECT *, lead(kind) OVER (PARTITION BY path, fn ORDER BY seq) AS nk,
               lag(kind) OVER (PARTITION BY path, fn ORDER BY seq) AS pk FROM v_steps),
b AS (SELECT path, fn, seq, CASE WHEN kind = 'if' AND nk = 'return' THEN 'guard: ' || label || ' → return' ELSE label END AS step
      FROM s WHERE NOT (kind = 'return' AND coalesce(pk, '') = 'if') AND (kind <> 'if' OR coalesce(nk, '') = 'return')),
t AS (SELECT path, fn, count_if(kind IN ('if', 'switch', 'try')) AS b, count(*) AS n FROM v_steps GROUP BY path, fn)
SELECT * FROM b UNION ALL SELECT path, fn, 0, 'branches: ' || CAST(b AS VARCHAR) FROM t WHERE b >= 4 AND n >= 5
""")
def flow_early_returns(spark, sf):
    return finish(FL.early_returns(derived(spark, sf, "v_steps_in_time")))


@query("flow_log_merge", duck_in_time("v_calls") + """
, c0 AS (SELECT *, starts_with(callee, 'Logger.') AS is_log FROM v_calls),
c AS (SELECT *, coalesce(lag(is_log) OVER (PARTITION BY path, fn ORDER BY seq), false) AS prev_log FROM c0),
c2 AS (SELECT *, sum(CASE WHEN is_log AND prev_log THEN 0 ELSE 1 END)
                 OVER (PARTITION BY path, fn ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM c),
m AS (SELECT path, fn, isl, regexp_extract(callee, '[^.]*$', 0) AS meth, min(seq) AS ms FROM c2 WHERE is_log
      GROUP BY path, fn, isl, regexp_extract(callee, '[^.]*$', 0)),
l AS (SELECT path, fn, min(ms) AS first_seq, 'log: ' || string_agg(meth, ', ' ORDER BY ms) AS step FROM m GROUP BY path, fn, isl)
SELECT * FROM l UNION ALL SELECT path, fn, seq, callee FROM c2 WHERE NOT is_log
""")
def flow_log_merge(spark, sf):
    return finish(FL.log_merge(derived(spark, sf, "v_calls_in_time")))


FLOW = DEPS.replace("WITH ", duck_with("v_flow") + ", ", 1) + """
, told AS (SELECT path, fn, count_if(NOT (line IN ('# decl', '~ misc', '= expr') OR starts_with(line, '… seq(') OR starts_with(line, 'stmt:Break'))) AS strong,
                  bool_or(starts_with(line, '…(')) AS cut FROM v_flow GROUP BY path, fn),
shown_paths AS (SELECT p.* FROM paths p LEFT JOIN told t ON t.path = p.path AND t.fn = p.fn WHERE t.path IS NULL OR t.strong < 2 OR t.cut)
"""


def _flow(spark, sf):
    return derived(spark, sf, "v_flow")


@query("flow_path", FLOW + "SELECT path, fn, flow FROM shown_paths")
def flow_path(spark, sf):
    return finish(FL.flow_path(_calls(spark, sf), _flow(spark, sf)))


@query("flow_collapse", duck_in_time("v_flow") + """
, l AS (SELECT *, row_number() OVER (PARTITION BY path, fn ORDER BY seq) - row_number() OVER (PARTITION BY path, fn, line ORDER BY seq) AS isl FROM v_flow),
n AS (SELECT *, count(*) OVER (PARTITION BY path, fn, line, isl) AS n, min(seq) OVER (PARTITION BY path, fn, line, isl) AS first FROM l)
SELECT path, fn, seq, CASE WHEN line = '~ misc' AND n >= 3 THEN '~misc×' || CAST(n AS VARCHAR) || ' (path/dep)' ELSE line END AS line
FROM n WHERE seq = first OR (line = '~ misc' AND n < 3)
""")
def flow_collapse(spark, sf):
    return finish(FL.collapse_flow(derived(spark, sf, "v_flow_in_time")))


@query("dependency_prune", FLOW + """
, text AS (SELECT path, fn, flow AS t FROM shown_paths UNION ALL SELECT path, fn, line FROM v_flow)
SELECT d.* FROM deps d WHERE NOT EXISTS (SELECT 1 FROM text s WHERE s.path = d.path AND s.fn = d.fn
  AND (contains(s.t, d.dep) OR (starts_with(s.t, 'log:') AND starts_with(d.dep, 'Logger.'))))
""")
def dependency_prune(spark, sf):
    c = _calls(spark, sf)
    return finish(FL.dependency_prune(FL.dependencies(c), FL.flow_path(c, _flow(spark, sf)), _flow(spark, sf)))


@query("outline_quality", SYMS + """
, o AS (SELECT path, count(*) AS lines, count_if(kind = 'function') AS functions, count_if(kind = 'type') AS types,
               count_if(kind = 'import') AS imports, sum(length(text) + 4) AS chars FROM sym GROUP BY path),
s AS (SELECT path, sum(length(text) + 1) AS source_chars FROM v_code_lines GROUP BY path),
r AS (SELECT o.path, sum(lines) AS lines, sum(functions) AS functions, sum(types) AS types, sum(imports) AS imports,
             sum(chars) AS chars, sum(source_chars) AS source_chars
      FROM o JOIN s ON o.path = s.path GROUP BY ROLLUP (o.path))
SELECT *, CAST(ceil(chars / CAST(3.5 AS DOUBLE)) AS BIGINT) AS est_tokens, round(CAST(chars AS DOUBLE) / source_chars, 6) AS ratio FROM r
""")
def outline_quality(spark, sf):
    lines = derived(spark, sf, "v_code_lines")
    return finish(FL.outline_quality(CO.outline_symbols(lines), lines))


@query("outline_metrics", duck_with("v_outline_lines") + r"""
, l AS (SELECT *, ltrim(text) AS lt FROM v_outline_lines),
b AS (SELECT path, count(*) AS line_count, count_if(starts_with(text, 'fn ')) AS fn_count,
             coalesce(max(CASE WHEN starts_with(text, 'dep:') THEN length(text) END), 0) AS max_dep_len, count_if(starts_with(text, 'path:')) AS path_count,
             count_if(starts_with(text, 'flow:')) AS flow_header_count, sum(len(regexp_extract_all(text, '-> Logger\.|log:'))) AS logger_flow_count,
             count_if(regexp_matches(text, '^ctl:\s+\d+br\s+\d+lp\s*$')) AS bare_ctl_count, sum(length(text) + 1) - 1 AS chars FROM l GROUP BY path),
d AS (SELECT path, line_no, unnest(string_split_regex(regexp_replace(text, '^dep:\s*', ''), ',\s*')) AS dep FROM l WHERE starts_with(text, 'dep:')),
s AS (SELECT path, text FROM l WHERE starts_with(lt, '->') OR starts_with(lt, 'flow:') OR starts_with(lt, 'path:')),
o AS (SELECT path, count(*) AS n FROM d WHERE dep <> '' AND EXISTS (SELECT 1 FROM s WHERE s.path = d.path AND contains(s.text, d.dep)) GROUP BY path)
SELECT b.path, line_count, fn_count, max_dep_len, path_count > 0 AS has_path, path_count, flow_header_count, CAST(logger_flow_count AS BIGINT) AS logger_flow_count,
       coalesce(o.n, 0) AS dep_overlap, bare_ctl_count, CAST(ceil(chars / CAST(3.5 AS DOUBLE)) AS BIGINT) AS est_tokens
FROM b LEFT JOIN o ON o.path = b.path
""".replace("\\\\", "\\"))
def outline_metrics(spark, sf):
    return finish(FL.outline_metrics(derived(spark, sf, "v_outline_lines")))
