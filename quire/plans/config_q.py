"""§ configuration structure and redaction over ``v_json`` / ``v_yaml`` (from ``customer``)."""

from quire.config import SENSITIVE_KEY_PATTERNS
from quire.operators import configs as K
from quire.plans.common import finish
from quire.plans.registry import query
from quire.plans.sqlfrag import trim
from quire.sources.fixtures import derived, duck_with


def sens(k: str) -> str:
    return "(" + " OR ".join(f"contains(lower({k}), '{p}')" for p in SENSITIVE_KEY_PATTERNS) + ")"


def kind(c: str, p: str) -> str:
    t = f"json_type({c}, {p})"
    return (f"CASE {t} WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' "
            f"WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END")


def text(c: str, p: str, k: str) -> str:
    s = f"json_extract_string({c}, {p})"
    n = f"json_array_length({c}, {p})"
    return (f"CASE {k} WHEN 'string' THEN (CASE WHEN length({s}) > 100 THEN '\"' || substring({s}, 1, 100) || '...\"' "
            f"ELSE '\"' || {s} || '\"' END) WHEN 'null' THEN 'null' "
            f"WHEN 'array' THEN (CASE WHEN {n} = 0 THEN '[]' ELSE 'array[' || CAST({n} AS VARCHAR) || ']' END) "
            f"WHEN 'object' THEN (CASE WHEN len(json_keys({c}, {p})) = 0 THEN '{{}}' ELSE '' END) ELSE {s} END")


@query("json_skeleton", "WITH RECURSIVE " + duck_with("v_json")[5:] + f"""
, ok AS (SELECT path, json(content) AS v FROM v_json WHERE json_valid(content)),
node AS (
  SELECT path, 0 AS depth, '' AS key_path, CAST(NULL AS VARCHAR) AS key, v, CAST(0 AS UBIGINT) AS first_id, CAST(1 AS BIGINT) AS last, false AS red FROM ok
  UNION ALL
  SELECT n.path, n.depth + 1, CASE WHEN n.key_path = '' THEN e.key ELSE n.key_path || '.' || e.key END, e.key, e.value,
         min(e.id) OVER (PARTITION BY n.path, n.key_path, e.key), row_number() OVER (PARTITION BY n.path, n.key_path, e.key ORDER BY e.id DESC),
         {sens('e.key')}
  FROM node n, json_each(n.v) e WHERE json_type(n.v) = 'OBJECT' AND NOT n.red AND n.last = 1),
live AS (SELECT *, CASE WHEN red THEN 'redacted' ELSE {kind('v', "'$'")} END AS kind,
                substring(key_path, 1, greatest(0, length(key_path) - length(key) - 1)) AS up FROM node WHERE last = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY path, depth, up ORDER BY first_id) AS ord FROM live),
rows_ AS (SELECT path, depth, ord, key_path, kind, CASE WHEN kind = 'redacted' THEN '[REDACTED]' ELSE {text('v', "'$'", 'kind')} END AS text FROM placed
          WHERE depth > 0 OR kind <> 'object' OR len(json_keys(v)) = 0),
item AS (SELECT path, depth + 1 AS depth, key_path, json_extract(v, '$[' || CAST(i AS VARCHAR) || ']') AS v, i
         FROM (SELECT *, unnest(range(0, CAST(least(3, json_array_length(v)) AS BIGINT))) AS i FROM placed WHERE kind = 'array') a),
itemk AS (SELECT *, {kind('v', "'$'")} AS kind FROM item)
SELECT path, depth, ord, key_path, kind, text FROM rows_
UNION ALL
SELECT path, depth, i + 1, key_path || '[' || CAST(i AS VARCHAR) || ']', kind,
       CASE WHEN kind IN ('object', 'array') THEN '' ELSE {text('v', "'$'", 'kind')} END FROM itemk
""")
def json_skeleton(spark, sf):
    return finish(K.json_skeleton(derived(spark, sf, "v_json")))


def _value(v: str, k: str) -> str:
    """The text of a scalar, array or object where a value stands on its key's line."""
    return f"CASE WHEN {k} = 'object' THEN '[object Object]' ELSE {text(v, chr(39) + '$' + chr(39), k)} END"


KV, BAR = kind("v", "'$'"), "// ═══════════════════════════════════════"
BAD = "(SELECT path, string_split(substring(content, 1, 500), chr(10)) AS ls FROM v_json WHERE NOT json_valid(content))"


def _render_json_sql() -> str:
    return "WITH RECURSIVE " + duck_with("v_json")[5:] + f"""
, node AS (
  SELECT path, 0 AS depth, CAST(NULL AS VARCHAR) AS key, json(content) AS v, CAST([] AS UBIGINT[]) AS seq, CAST(1 AS BIGINT) AS last, false AS red
  FROM v_json WHERE json_valid(content)
  UNION ALL
  SELECT n.path, n.depth + 1, e.key, e.value, list_append(n.seq, CAST(min(e.id) OVER (PARTITION BY n.path, n.seq, e.key) AS UBIGINT)),
         row_number() OVER (PARTITION BY n.path, n.seq, e.key ORDER BY e.id DESC), {sens('e.key')}
  FROM node n, json_each(n.v) e WHERE json_type(n.v) = 'OBJECT' AND NOT n.red AND n.last = 1),
live AS (SELECT *, {KV} AS kind, CASE WHEN json_type(v) = 'ARRAY' THEN json_array_length(v) WHEN json_type(v) = 'OBJECT' THEN len(json_keys(v)) END AS n
         FROM node WHERE last = 1),
item AS (SELECT path, depth, seq, i, json_extract(v, '$[' || CAST(i AS VARCHAR) || ']') AS v FROM
         (SELECT *, unnest(range(0, CAST(least(3, n) AS BIGINT))) AS i FROM live WHERE kind = 'array' AND NOT red) a),
itemk AS (SELECT *, {KV} AS kind FROM item),
line AS (
  SELECT path, seq, greatest(depth, 1) AS d, CASE WHEN red THEN key || ': [REDACTED]' WHEN kind IN ('object', 'array') THEN key || ':'
         ELSE key || ': ' || {text('v', "'$'", 'kind')} END AS l FROM live WHERE depth > 0
  UNION ALL SELECT path, seq, 1, CASE WHEN kind = 'object' THEN '{{}}' WHEN kind = 'null' THEN '(null)' ELSE {text('v', "'$'", 'kind')} END
  FROM live WHERE depth = 0 AND (kind <> 'object' OR n = 0)
  UNION ALL SELECT path, list_append(seq, CAST(0 AS UBIGINT)), depth + 1, CASE WHEN kind = 'object' THEN '{{}}' WHEN n = 0 THEN '[]' ELSE 'array[' || CAST(n AS VARCHAR) || ']' END
  FROM live WHERE depth > 0 AND NOT red AND (kind = 'array' OR (kind = 'object' AND n = 0))
  UNION ALL SELECT path, list_append(seq, CAST(i + 1 AS UBIGINT)), depth + 1, '[' || CAST(i AS VARCHAR) || ']: ' || CASE WHEN kind = 'array' THEN array_to_string(
      list_transform(json_extract(v, '$[*]'), lambda x: CASE json_type(x) WHEN 'OBJECT' THEN '[object Object]' WHEN 'NULL' THEN '' WHEN 'ARRAY' THEN CAST(x AS VARCHAR)
                     ELSE json_extract_string(x, '$') END), ',') ELSE {_value('v', 'kind')} END FROM itemk
  UNION ALL SELECT path, list_append(seq, CAST(1073741824 AS UBIGINT)), depth + 1, '... (' || CAST(n - 3 AS VARCHAR) || ' more items)' FROM live WHERE kind = 'array' AND NOT red AND n > 3),
padded AS (SELECT *, 2 * (d - 1) + 2 * greatest(0, coalesce(lag(d) OVER (PARTITION BY path ORDER BY seq), 0) - d) AS pad FROM line),
body AS (SELECT path, string_agg(repeat(' ', pad) || l, chr(10) ORDER BY seq) AS body, arg_max(d, seq) AS last FROM padded GROUP BY path),
prev AS (SELECT path, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS t FROM {BAD} b),
bad AS (SELECT path, string_agg({redact_sql('t')}, chr(10) ORDER BY line_no) AS t FROM prev GROUP BY path)
SELECT path, '// File: ' || path || ' (⚠️ Config structure)' || chr(10) || chr(10) || '{BAR}' || chr(10) || '// CONFIGURATION STRUCTURE' || chr(10) || '{BAR}' || chr(10) || chr(10)
       || body || chr(10) || repeat(' ', 2 * (last - 1)) AS text FROM body
UNION ALL
SELECT path, '// File: ' || path || ' (⚠️ Config structure)' || chr(10) || chr(10) || '// Parse error: invalid JSON' || chr(10) || '// Showing preview:' || chr(10) || chr(10) || t FROM bad
"""


def redact_sql(t: str) -> str:
    sep = (f"(CASE WHEN instr({t}, ':') = 0 THEN instr({t}, '=') WHEN instr({t}, '=') = 0 THEN instr({t}, ':') "
           f"ELSE least(instr({t}, ':'), instr({t}, '=')) END)")
    key = f"regexp_replace(substring({t}, 1, greatest({sep} - 1, 0)), '[\"''\\s{{}}]', '', 'g')"
    return f"CASE WHEN {sep} > 1 AND {sens(key)} THEN substring({t}, 1, {sep}) || ' [REDACTED]' ELSE {t} END"


@query("json_parse_fallback", duck_with("v_json") + f"""
, bad AS (SELECT path, string_split(substring(content, 1, 500), chr(10)) AS ls FROM v_json WHERE NOT json_valid(content)),
l AS (SELECT path, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS text FROM bad)
SELECT path, line_no, {redact_sql('text')} AS text FROM l
""")
def json_parse_fallback(spark, sf):
    return finish(K.json_parse_fallback(derived(spark, sf, "v_json")))


YAML = duck_with("v_yaml") + f"""
, t AS (SELECT path, line_no, {trim('text')} AS t FROM v_yaml),
kv AS (SELECT path, line_no, {trim("substring(t, 1, instr(t, ':') - 1)")} AS key,
              {trim("substring(t, instr(t, ':') + 1)")} AS value
       FROM t WHERE t <> '' AND NOT starts_with(t, '#') AND instr(t, ':') > 1),
g AS (SELECT path, key, min(line_no) AS first_line, arg_max(value, line_no) AS value FROM kv GROUP BY path, key),
y AS (SELECT path, key, first_line, value,
             CASE WHEN value IN ('true', 'false') THEN 'boolean' WHEN value = '' THEN 'nested'
                  WHEN regexp_matches(value, '{K.JS_NUMBER_RE}') THEN 'number' ELSE 'string' END AS kind,
             CASE WHEN regexp_matches(key, '^(0|[1-9][0-9]{{0,8}})$') THEN CAST(key AS BIGINT) END AS idx FROM g),
ys AS (SELECT path, key, kind, first_line,
              CASE WHEN kind = 'nested' THEN '(nested value)'
                   WHEN kind = 'string' THEN regexp_replace(value, '^["'']|["'']$', '', 'g') ELSE value END AS value,
              row_number() OVER (PARTITION BY path ORDER BY idx IS NULL, idx, first_line) AS ord FROM y)
"""


def _yaml(spark, sf):
    return K.order_keys(K.yaml_flat_keys(derived(spark, sf, "v_yaml")))


@query("yaml_flat_keys", YAML + "SELECT path, ord, key, kind, value, first_line FROM ys")
def yaml_flat_keys(spark, sf):
    return finish(_yaml(spark, sf).select("path", "ord", "key", "kind", "value", "first_line"))


@query("sensitive_key_redact", YAML + f"""
SELECT path, ord, key, CASE WHEN {sens('key')} THEN '[REDACTED]' ELSE value END AS shown FROM ys
""")
def sensitive_key_redact(spark, sf):
    return finish(_yaml(spark, sf).select("path", "ord", "key", "shown"))


@query("config_line_redact", duck_with("v_yaml") + f"SELECT path, line_no, {redact_sql('text')} AS text FROM v_yaml")
def config_line_redact(spark, sf):
    return finish(K.redact_lines(derived(spark, sf, "v_yaml")))


@query("render_json", _render_json_sql())
def render_json(spark, sf):
    from quire.operators.render import render_json_summary
    return render_json_summary(derived(spark, sf, "v_json"))
