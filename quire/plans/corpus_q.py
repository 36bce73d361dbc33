"""§ scope, ignore rules, classification and routing over ``v_files`` (from ``documents``)."""

from pyspark.sql import functions as F

from quire.config import Config
from quire.operators import corpus as C
from quire.plans.common import finish
from quire.plans.registry import query
from quire.sources.fixtures import derived, duck_with

CFG = Config(max_file_size=10000)


def _files(spark, sf):
    return derived(spark, sf, "v_files")


def case_map(key: str, m: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items())
    return f"(CASE {key} {whens} ELSE {default} END)"


BASE = "regexp_extract(rel_path, '[^/]*$', 0)"
EXT = f"regexp_extract({BASE}, '^.+(\\.[^.]*)$', 1)"


@query("path_parts", duck_with("v_files") + f"""
SELECT path, rel_path, {BASE} AS name, {EXT} AS ext, regexp_extract(rel_path, '^(.*)/[^/]*$', 1) AS dir FROM v_files
""")
def path_parts(spark, sf):
    return finish(C.path_parts(_files(spark, sf)))


def _lang_map():
    m = {}
    for lang, (aliases, exts) in C.LANGUAGES.items():
        for e in exts:
            m[e.lower()] = lang
        for a in aliases:
            m[a] = lang
    return m


LANG_SQL = case_map(
    "(CASE WHEN instr(path, '.') > 0 THEN lower(regexp_extract(path, '(\\.[^.]*)$', 1)) "
    "ELSE lower(regexp_extract(path, '[^/]*$', 0)) END)", _lang_map())


@query("language_detect", duck_with("v_files") + f"SELECT path, {LANG_SQL} AS language FROM v_files")
def language_detect(spark, sf):
    return finish(_files(spark, sf).select("path", C.language_of(F.col("path")).alias("language")))


@query("code_file_flag", duck_with("v_files") + f"""
SELECT path, lower({EXT}) IN ({', '.join(repr(e) for e in C.CODE_EXTENSIONS)}) AS is_code FROM v_files
""")
def code_file_flag(spark, sf):
    return finish(_files(spark, sf).select("path", C.is_code_file(F.col("path")).alias("is_code")))


def _binary_sql() -> str:
    conds = []
    for raw in CFG.binary_file_patterns:
        p = raw.replace("\\", "/").lower()
        c = f"(lower({EXT}) = '{p}' OR '*' || lower({EXT}) = '{p}'"
        if "*" not in p:
            c += f" OR lower({BASE}) = '{p}' OR lower(rel_path) = '{p}'"
        else:
            rx = C._glob_regex(p)
            c += f" OR regexp_matches(lower({BASE}), '{rx}') OR regexp_matches(lower(rel_path), '{rx}')"
        conds.append(c + ")")
    docs = ", ".join(repr(e) for e in C.DOCUMENT_EXTENSIONS)
    return (f"(CASE WHEN lower({EXT}) IN ({docs}) THEN false WHEN {' OR '.join(conds)} THEN true "
            f"WHEN lower({EXT}) = '' THEN coalesce(instr(substring(content, 1, 1024), chr(0)) > 0, false) ELSE false END)")


@query("binary_detect", duck_with("v_files") + f"SELECT path, {_binary_sql()} AS is_binary FROM v_files")
def binary_detect(spark, sf):
    f = _files(spark, sf)
    return finish(f.select("path", C.is_binary(F.col("path"), F.col("rel_path"), F.encode("content", "UTF-8"),
                                               CFG).alias("is_binary")))


@query("media_type_lookup", duck_with("v_files") + f"""
SELECT path, coalesce({case_map(f'lower({EXT})', {k: v[0] for k, v in C.MEDIA_TYPES.items()})}, 'binary') AS type,
       upper(substring(lower({EXT}), 2)) AS format,
       {case_map(f'lower({EXT})', {k: v[1] for k, v in C.MEDIA_TYPES.items()})} AS mime
FROM v_files WHERE {_binary_sql()}
""")
def media_type_lookup(spark, sf):
    f = C.classify(_files(spark, sf), CFG).where("is_binary")
    t, fmt, mime = C.media_type(F.col("path"))
    return finish(f.select("path", t.alias("type"), fmt.alias("format"), mime.alias("mime")))


SYM = ", ".join(repr(x) for x in C.SYMBOL_LANGUAGES)
ROUTE = duck_with("v_files") + f"""
, c AS (SELECT project, path, size, lower({EXT}) AS ext, {LANG_SQL} AS language, {_binary_sql()} AS is_binary FROM v_files),
r AS (SELECT *, size > {CFG.max_file_size} AND NOT is_binary AS is_truncated FROM c),
routed AS (SELECT project, path, size, CASE WHEN is_binary THEN 'binary'
       WHEN is_truncated AND lower(coalesce(language, '')) IN ({SYM}) THEN 'outline'
       WHEN is_truncated OR ext IN ({', '.join(repr(k) for k in C.SUMMARY_KINDS)})
            THEN 'summary:' || coalesce({case_map('ext', C.SUMMARY_KINDS)}, 'generic')
       ELSE 'full' END AS route FROM r)
"""


@query("route_files", ROUTE + "SELECT path, route FROM routed")
def route_files(spark, sf):
    return finish(C.classify(_files(spark, sf), CFG).select("path", "route"))


@query("route_stats", ROUTE + """
SELECT project, route, count(*) AS files, sum(size) AS bytes FROM routed GROUP BY ROLLUP (project, route)
HAVING project IS NOT NULL
""")
def route_stats(spark, sf):
    return finish(C.route_stats(C.classify(_files(spark, sf), CFG)))


@query("doc_compress_flag", duck_with("v_files") + f"""
SELECT path, lower({EXT}) IN ('.pdf', '.docx', '.pptx') AND size > {CFG.max_file_size} AS compress FROM v_files
""")
def doc_compress_flag(spark, sf):
    f = _files(spark, sf)
    return finish(f.select("path", C.doc_compress_flag(f, CFG).alias("compress")))


@query("selected_scope", duck_with("v_files", "v_selections") + """
, s AS (SELECT DISTINCT project, regexp_replace(sel, '/+$', '') AS sel FROM v_selections)
SELECT f.project, f.path FROM v_files f
WHERE EXISTS (SELECT 1 FROM s WHERE s.project = f.project AND (f.rel_path = s.sel OR starts_with(f.rel_path, s.sel || '/')))
""")
def selected_scope(spark, sf):
    f = _files(spark, sf)
    return finish(C.selected_scope(f, derived(spark, sf, "v_selections")).select("project", "path"))


@query("common_parent", duck_with("v_selections") + """
, p AS (SELECT project, string_split(regexp_replace(sel, '/+$', ''), '/') AS parts FROM v_selections),
g AS (SELECT project, count(*) AS n, min(parts) AS lo, max(parts) AS hi FROM p GROUP BY project),
k AS (SELECT project, n, lo, coalesce((SELECT max(i) FROM range(1, least(len(lo), len(hi)) + 1) t(i)
        WHERE lo[1:i] = hi[1:i]), 0) AS common FROM g)
SELECT project, CASE WHEN n = 1 THEN regexp_extract(array_to_string(lo, '/'), '^(.*)/[^/]*$', 1)
                     ELSE array_to_string(lo[1:common], '/') END AS parent FROM k
""")
def common_parent(spark, sf):
    return finish(C.common_parent(derived(spark, sf, "v_selections")))


# the rules of v_rules written out by hand, the last one first
IGNORED_SQL = """CASE WHEN regexp_matches(p, '(?i)^de/f4[^/]*[.]txt$') THEN false
  WHEN is_dir AND regexp_matches(p, '(?i)(^|/)de$') THEN true
  WHEN regexp_matches(p, '(?i)(^|/)f14[.]log$') THEN false
  WHEN regexp_matches(p, '(?i)(^|/)!note[.]txt$') THEN true
  WHEN regexp_matches(p, '(?i)(^|/)[^/]*[.]log$') THEN true
  WHEN regexp_matches(p, '(?i)^(en|de|fr|es)/f33[^/]*[.]csv$') THEN false
  WHEN regexp_matches(p, '(?i)^(en|de|fr|es)/f3[^/]*[.]csv$') THEN true
  WHEN regexp_matches(p, '(?i)^(.*/)?f2[^/][.]txt$') THEN true
  WHEN regexp_matches(p, '(?i)^src1/en/f1[^/]*[.]md$') THEN true
  WHEN is_dir AND regexp_matches(p, '(?i)(^|/)build$') THEN true
  WHEN regexp_matches(p, '(?i)^node_modules/.*$') THEN true END"""


@query("ignore_filter", duck_with("v_files") + f"""
, parts AS (SELECT path, string_split(rel_path, '/') AS parts FROM v_files),
c AS (SELECT path, parts, unnest(range(1, len(parts) + 1)) AS k FROM parts),
d AS (SELECT path, array_to_string(parts[1:k], '/') AS p, k < len(parts) AS is_dir FROM c)
SELECT path, bool_or(coalesce({IGNORED_SQL}, false)) AS ignored FROM d GROUP BY path
""")
def ignore_filter(spark, sf):
    return finish(C.ignore_filter(_files(spark, sf), C.ordered_rules(derived(spark, sf, "v_rules"))).select("path", "ignored"))


@query("ignore_rule_merge", duck_with("v_rules") + """
SELECT DISTINCT t AS pattern FROM (SELECT trim(pattern, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM v_rules) r WHERE t <> '' AND NOT starts_with(t, '#')
""")
def ignore_rule_merge(spark, sf):
    r = derived(spark, sf, "v_rules")
    return finish(C.merge_rules(r.where("layer = 1"), r.where("layer = 2"), r.where("layer = 3")))


@query("path_sort", duck_with("v_files") + """
SELECT project, rel_path, row_number() OVER (PARTITION BY project ORDER BY icu_sort_key(rel_path, 'und'), rel_path) AS rank
FROM v_files
""")
def path_sort(spark, sf):
    return finish(C.path_sort(_files(spark, sf)).select("project", "rel_path", "rank"))
