"""§ tree, file blocks, assembly, token budget and templates over ``v_files``."""

from pyspark.sql import functions as F

from quire.functions.text import format_tokens, rank_within
from quire.operators import corpus as C
from quire.operators import context as X
from quire.operators import render as R
from quire.operators import tree as T
from quire.plans.common import finish
from quire.plans.corpus_q import CFG, EXT, LANG_SQL, SYM, _binary_sql, case_map
from quire.plans.context_sql import summary_blocks
from quire.plans.registry import ORACLES, query
from quire.plans.sqlfrag import utf16_len
from quire.session import written
from quire.sources.fixtures import derived, duck_with


def kept_files(spark, sf):
    """The files that the ignore rules leave."""
    return X.kept_files(derived(spark, sf, "v_files"), C.clean_rules(C.rules_of(derived(spark, sf, "v_rules"))))


def ranks(files):
    """(project, rel_path, path, rank) of files: only the paths are ranked."""
    return rank_within(files.select("project", "rel_path", "path"), "project", [F.col("rel_path")])


TREE = duck_with("v_files") + """
, f AS (SELECT project, rel_path, row_number() OVER (PARTITION BY project ORDER BY rel_path) AS rank FROM v_files),
pre AS (SELECT project, rank, parts, unnest(range(1, len(parts) + 1)) AS k
        FROM (SELECT project, rank, string_split(rel_path, '/') AS parts FROM f)),
p2 AS (SELECT project, rank, array_to_string(parts[1:k], '/') AS node,
              CASE WHEN k > 1 THEN array_to_string(parts[1:k - 1], '/') ELSE '' END AS parent,
              parts[k] AS name, k - 1 AS depth, k < len(parts) AS is_dir FROM pre),
nodes AS (SELECT project, node, parent, name, depth, min(rank) AS first_rank, arg_min(is_dir, rank) AS is_dir
          FROM p2 GROUP BY project, node, parent, name, depth),
lastr AS (SELECT project, parent, max(first_rank) AS lr FROM nodes GROUP BY project, parent),
n2 AS (SELECT n.*, n.first_rank = l.lr AS is_last FROM nodes n JOIN lastr l ON n.project = l.project AND n.parent = l.parent),
anc AS (SELECT project, node, depth, unnest(range(1, depth + 2)) AS k FROM n2),
a2 AS (SELECT a.project, a.node, a.depth AS nd, i.depth AS ad, i.is_last AS al, i.first_rank AS ar
       FROM anc a JOIN n2 i ON i.project = a.project AND i.node = array_to_string(string_split(a.node, '/')[1:a.k], '/')),
ch AS (SELECT project, node, list(ar ORDER BY ad) AS ord_key,
              string_agg(CASE WHEN ad < nd THEN (CASE WHEN al THEN '  ' ELSE '│ ' END) ELSE '' END, '' ORDER BY ad) AS prefix
       FROM a2 GROUP BY project, node),
tree AS (SELECT n2.project, n2.node, n2.depth,
                coalesce(prefix, '') || CASE WHEN n2.depth > 0 THEN (CASE WHEN is_last THEN '└─' ELSE '├─' END) ELSE '' END
                || CASE WHEN is_dir THEN '📁 ' ELSE '📄 ' END || name AS line,
                row_number() OVER (PARTITION BY n2.project ORDER BY ord_key) AS ord
         FROM n2 JOIN ch ON n2.project = ch.project AND n2.node = ch.node)
"""


def _tree(rank):
    return rank_within(T.dir_tree(rank), "project", [F.col("ord_key")], name="ord")


@query("dir_tree", TREE + "SELECT project, node, depth, line, ord FROM tree")
def dir_tree(spark, sf):
    files = derived(spark, sf, "v_files").select("project", "rel_path", "path")
    return finish(_tree(rank_within(files, "project", [F.col("rel_path")])).select("project", "node", "depth", "line", "ord"))


SIZE_SQL = """CASE
  WHEN {s} >= 1048576 THEN CAST(CAST(floor(({s} * 20 + 1048576) / 2097152) AS BIGINT) // 10 AS VARCHAR) || '.'
       || CAST(CAST(floor(({s} * 20 + 1048576) / 2097152) AS BIGINT) % 10 AS VARCHAR) || 'MB'
  WHEN {s} >= 1024 THEN CAST(CAST(floor(({s} * 20 + 1024) / 2048) AS BIGINT) // 10 AS VARCHAR) || '.'
       || CAST(CAST(floor(({s} * 20 + 1024) / 2048) AS BIGINT) % 10 AS VARCHAR) || 'KB'
  ELSE CAST({s} AS VARCHAR) || 'B' END"""


def _routed(spark, sf):
    """The kept files, written by route."""
    return X.by_route(kept_files(spark, sf), CFG)


def _blocks(routed, rank):
    """A block of every kept file, with its rank."""
    return X.routed_blocks(routed, CFG).join(rank.select("path", "rank"), "path")


PLAIN = f"""
, cl AS (SELECT project, path, rel_path, size, content, row_number() OVER (PARTITION BY project ORDER BY rel_path) AS rank,
                lower({EXT}) AS ext, {LANG_SQL} AS language,
                regexp_extract(rel_path, '[^/]*$', 0) AS name FROM v_files),
r0 AS (SELECT cl.*, {_binary_sql()} AS is_binary FROM cl),
r AS (SELECT r0.*, size > 10000 AND NOT is_binary AS is_truncated,
             coalesce({case_map('ext', {k: v[0] for k, v in C.MEDIA_TYPES.items()})}, 'binary') AS mtype,
             {case_map('ext', {k: v[1] for k, v in C.MEDIA_TYPES.items()})} AS mime FROM r0),
plain AS (SELECT project, path, rank, CASE WHEN is_binary THEN
      '// ' || mtype || ' file: ' || name || chr(10) || '// Type: ' || mtype
      || CASE WHEN ext <> '' THEN ' (' || upper(substring(ext, 2)) || ')' ELSE '' END
      || CASE WHEN mime IS NOT NULL THEN chr(10) || '// Details: MIME: ' || mime ELSE '' END || chr(10)
    ELSE '// File: ' || rel_path || ' (' || {SIZE_SQL.format(s='size')} || ')' || chr(10) || '```' || coalesce(language, 'text')
         || chr(10) || content || chr(10) || '```' || chr(10) END AS block
  FROM r WHERE is_binary OR (NOT is_truncated AND ext NOT IN ('.log', '.csv', '.tsv', '.json', '.yaml', '.yml', '.xml',
                                                             '.md', '.txt', '.pdf', '.docx', '.xlsx', '.xls', '.pptx')))
"""


@query("render_file_block", TREE + PLAIN + "SELECT project, path, block FROM plain")
def render_file_block(spark, sf):
    f = C.classify(derived(spark, sf, "v_files"), CFG)
    t, fmt, mime = C.media_type(F.col("path"))
    details = F.filter(F.array(F.when(mime.isNotNull(), F.concat(F.lit("MIME: "), mime))), lambda x: x.isNotNull())
    block = F.when(F.col("is_binary"), R.binary_block(C.basename(F.col("rel_path")), t, fmt, details)).otherwise(
        R.file_block(F.col("rel_path"), F.col("size"), F.col("language"), F.col("content"), F.col("is_truncated"), CFG))
    return finish(f.where(F.col("route").isin("full", "binary")).select("project", "path", block.alias("block")))


# the kept files: neither they nor one of their folders is ignored
KEPT = duck_with("v_files").replace("v_files AS", "v_all AS", 1) + f"""
, ig AS (SELECT * FROM ({ORACLES['ignore_filter']}) x),
v_files AS (SELECT v_all.* FROM v_all JOIN ig ON ig.path = v_all.path WHERE NOT ig.ignored)
"""
IS_CODE = f"lower({EXT}) IN ({', '.join(repr(e) for e in C.CODE_EXTENSIONS)})"
BLOCKS = KEPT + TREE[len(duck_with("v_files")):] + PLAIN + f"""
, rt AS (SELECT * FROM ({ORACLES['route_files']}) x),
fr AS (SELECT f.*, rt.route, {LANG_SQL.replace('path', 'f.path')} AS lang FROM v_files f JOIN rt ON rt.path = f.path),
others AS ({summary_blocks(SIZE_SQL.format(s='f.size'), IS_CODE)}),
blocks AS (SELECT project, path, rank, block FROM plain UNION ALL SELECT cl.project, cl.path, cl.rank, o.text FROM others o JOIN cl ON cl.path = o.path)
"""


ASSEMBLE = BLOCKS + """
, nl AS (SELECT project, max(ord) AS n FROM tree GROUP BY project),
fb AS (SELECT project, min(rank) AS fr FROM blocks GROUP BY project),
doc AS (SELECT t.project, 1 AS a, t.ord AS b, CASE WHEN t.ord = 1 THEN '# Project Structure' || chr(10) ELSE '' END || line
               || CASE WHEN t.ord = nl.n THEN chr(10) || chr(10) || '# File Contents' || chr(10) ELSE chr(10) END AS text
        FROM tree t JOIN nl ON t.project = nl.project
        UNION ALL
        SELECT b.project, 2 AS a, rank AS b, CASE WHEN rank = fb.fr THEN '' ELSE chr(10) || chr(10) END || block AS text
        FROM blocks b JOIN fb ON b.project = fb.project)
"""


def _doc(routed, rank=None, tree=None):
    rank = ranks(routed) if rank is None else rank
    tree = (tree if tree is not None else _tree(rank)).select("project", "ord", "line")
    return R.assemble(tree, _blocks(routed, rank).select("project", "rank", "block"))


@query("context_assemble", ASSEMBLE + "SELECT project, a, b, text FROM doc")
def context_assemble(spark, sf):
    d = _doc(_routed(spark, sf))
    return finish(d.select("project", F.col("seq.a").alias("a"), F.col("seq.b").alias("b"), "text"))


@query("token_budget", ASSEMBLE + f"""
, t AS (SELECT project, sum({utf16_len('text')}) AS chars FROM doc GROUP BY project),
n AS (SELECT project, count(*) AS file_count FROM v_files GROUP BY project)
SELECT t.project, chars, CAST(ceil(chars / CAST(3.75 AS DOUBLE)) AS BIGINT) AS tokens,
       ceil(chars / CAST(3.75 AS DOUBLE)) > 128000 AS exceeded, file_count
FROM t JOIN n ON t.project = n.project
""")
def token_budget(spark, sf):
    routed = _routed(spark, sf)
    return finish(R.token_budget(_doc(routed), routed))


@query("template_catalog", duck_with("v_templates") + f"""
SELECT 'default' AS name, {R.DEFAULT_TEMPLATE!r} AS body UNION ALL SELECT name, body FROM v_templates WHERE name <> 'default'
""".replace("\\n", "' || chr(10) || '"))
def template_catalog(spark, sf):
    return finish(R.template_catalog(derived(spark, sf, "v_templates")))


def fixed1_sql(t: str, d: int) -> str:
    """JavaScript ``(t/d).toFixed(1)`` for integer t >= d in exact integer math:
    a decimal tie is decided by whether the double nearest t/d lies above it."""
    h = d // 10
    e = f"CAST(floor(log2(CAST({t} AS DOUBLE) / {d})) AS INTEGER)"
    r = f"((CAST({t} AS HUGEINT) * (CAST(1 AS HUGEINT) << (52 - {e}))) % {d})"
    up = (f"(CASE WHEN ({t} % {h}) * 2 > {h} THEN 1 WHEN ({t} % {h}) * 2 < {h} THEN 0 "
          f"WHEN {r} = 0 OR {r} * 2 > {d} THEN 1 ELSE 0 END)")
    tenths = f"(CAST(floor({t} / {h}) AS BIGINT) + {up})"
    return f"(CAST({tenths} // 10 AS VARCHAR) || '.' || CAST({tenths} % 10 AS VARCHAR))"


def tokens_fmt_sql(t: str) -> str:
    return (f"CASE WHEN {t} >= 1000000 THEN {fixed1_sql(t, 1000000)} || 'M' "
            f"WHEN {t} >= 1000 THEN {fixed1_sql(t, 1000)} || 'K' ELSE CAST({t} AS VARCHAR) END")


STAMP = "2024-01-01T00:00:00.000Z"


def _render_inputs(spark, sf):
    routed = _routed(spark, sf)
    rank = ranks(routed)
    files = written(routed.select("project", "path", "rel_path", "route").join(rank.select("path", "rank"), "path"))
    tree = written(_tree(rank))
    doc = written(_doc(routed, rank, tree))  # its lengths and its rows
    budget = R.token_budget(doc, routed)
    outl = files.groupBy("project").agg(F.count_if(F.col("route") == "outline").alias("n_outline"))
    choice = F.element_at(F.array(F.lit("default"), F.lit("brief"), F.lit("missing"), F.lit("treeonly")),
                          (F.regexp_extract("project", "([0-9]+)$", 1).cast("int") % 4 + 1))
    stats = budget.join(outl, "project").select(
        "project", choice.alias("template"), F.col("project").alias("PROJECT_NAME"),
        format_tokens(F.col("tokens")).alias("TOKEN_COUNT"), format_tokens(F.lit(128000)).alias("TOKEN_LIMIT"),
        F.col("file_count").cast("string").alias("FILE_COUNT"), F.col("n_outline").cast("string").alias("OUTLINE_COUNT"),
        F.lit(STAMP).alias("TIMESTAMP"), F.lit("").alias("SELECTED_FILES"), F.lit("workspace").alias("SCOPE"),
        F.lit("/workspace").alias("WORKSPACE_PATH"))
    catalog = R.template_catalog(derived(spark, sf, "v_templates"))
    stats = R.choose_template(stats, catalog)
    n_lines = tree.groupBy("project").agg(F.max("ord").alias("n"))
    tree_rows = tree.join(n_lines, "project").select(
        "project", F.struct(F.col("ord").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("seq"),
        F.concat("line", F.when(F.col("ord") < F.col("n"), F.lit("\n")).otherwise(F.lit(""))).alias("text"))
    nf = files.groupBy("project").agg(F.max("rank").alias("n"))
    list_rows = files.join(nf, "project").select(
        "project", F.struct(F.col("rank").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("seq"),
        F.concat("rel_path", F.when(F.col("rank") < F.col("n"), F.lit("\n")).otherwise(F.lit(""))).alias("text"))
    content_rows = doc.where(F.col("seq.a") == 2).select(
        "project", F.struct(F.col("seq.b").alias("a"), F.lit(0).cast("long").alias("b")).alias("seq"), "text")
    segs = R.template_segments(catalog)
    return segs, stats, {"DIR_TREE": tree_rows, "FILE_LIST": list_rows, "FILE_CONTENTS": content_rows}


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


SMALL = [v for v in R.TEMPLATE_VARS if v not in R.BIG_VARS]


def _apply_sql(x: str, after: str) -> str:
    order = list(R.TEMPLATE_VARS)
    for v in order[order.index(after) + 1:]:
        if v in R.BIG_VARS:
            continue
        x = f"replace({x}, '${v}', coalesce(s.{v}, ''))"
    return x


@query("template_render", ASSEMBLE + duck_with("v_templates").replace("WITH ", ", ", 1) + f"""
, cat AS (SELECT 'default' AS name, {_lit(R.DEFAULT_TEMPLATE)} AS body
          UNION ALL SELECT name, body FROM v_templates WHERE name <> 'default'),
seg0 AS (SELECT name, string_split(regexp_replace(body, '(\\$DIR_TREE|\\$FILE_LIST|\\$FILE_CONTENTS)', chr(0) || '\\1' || chr(0), 'g'), chr(0)) AS ps FROM cat),
seg AS (SELECT name, generate_subscripts(ps, 1) - 1 AS seg_no, unnest(ps) AS text FROM seg0),
segk AS (SELECT name, seg_no, CASE WHEN text IN ('$DIR_TREE', '$FILE_LIST', '$FILE_CONTENTS') THEN substring(text, 2) ELSE 'lit' END AS kind, text FROM seg),
bud AS (SELECT t.project, CAST(ceil(chars / CAST(3.75 AS DOUBLE)) AS BIGINT) AS tokens, n.file_count
        FROM (SELECT project, sum({utf16_len('text')}) AS chars FROM doc GROUP BY project) t
        JOIN (SELECT project, count(*) AS file_count FROM v_files GROUP BY project) n ON t.project = n.project),
ch0 AS (SELECT project, (['default', 'brief', 'missing', 'treeonly'])[CAST(regexp_extract(project, '([0-9]+)$', 1) AS INTEGER) % 4 + 1] AS t0 FROM bud),
s AS (SELECT b.project, CASE WHEN c.name IS NULL THEN 'default' ELSE ch0.t0 END AS template, b.project AS PROJECT_NAME,
             {tokens_fmt_sql('b.tokens')} AS TOKEN_COUNT, '128.0K' AS TOKEN_LIMIT, CAST(b.file_count AS VARCHAR) AS FILE_COUNT,
             CAST(oc.n AS VARCHAR) AS OUTLINE_COUNT, '{STAMP}' AS TIMESTAMP, '' AS SELECTED_FILES, 'workspace' AS SCOPE, '/workspace' AS WORKSPACE_PATH
      FROM bud b JOIN ch0 ON b.project = ch0.project
      JOIN (SELECT project, count_if(is_truncated AND lower(coalesce(language, '')) IN ({SYM})) AS n FROM r GROUP BY project) oc
        ON oc.project = b.project
      LEFT JOIN (SELECT DISTINCT name FROM cat) c ON c.name = ch0.t0),
nt AS (SELECT project, max(ord) AS n FROM tree GROUP BY project),
fl AS (SELECT project, rel_path, row_number() OVER (PARTITION BY project ORDER BY rel_path) AS rk,
              count(*) OVER (PARTITION BY project) AS n FROM v_files),
streams AS (
  SELECT t.project, 'DIR_TREE' AS kind, t.ord AS a, 0 AS b, line || CASE WHEN t.ord < nt.n THEN chr(10) ELSE '' END AS text
  FROM tree t JOIN nt ON t.project = nt.project
  UNION ALL SELECT project, 'FILE_LIST', rk, 0, rel_path || CASE WHEN rk < n THEN chr(10) ELSE '' END FROM fl
  UNION ALL SELECT project, 'FILE_CONTENTS', b, 0, text FROM doc WHERE a = 2)
SELECT s.project, k.seg_no AS a, 0 AS b, 0 AS c,
       {_apply_sql("replace(k.text, '$PROJECT_NAME', coalesce(s.PROJECT_NAME, ''))", 'PROJECT_NAME')} AS text
FROM s JOIN segk k ON k.name = s.template AND k.kind = 'lit'
UNION ALL
SELECT s.project, k.seg_no, x.a, x.b,
       CASE x.kind WHEN 'DIR_TREE' THEN {_apply_sql('x.text', 'DIR_TREE')} WHEN 'FILE_LIST' THEN {_apply_sql('x.text', 'FILE_LIST')}
            ELSE {_apply_sql('x.text', 'FILE_CONTENTS')} END AS text
FROM streams x JOIN s ON x.project = s.project JOIN segk k ON k.name = s.template AND k.kind = x.kind
""")
def template_render(spark, sf):
    segs, stats, streams = _render_inputs(spark, sf)
    r = R.render_template_rows(segs, stats, streams)
    return finish(r.select("project", F.col("seq.a").alias("a"), F.col("seq.b").alias("b"), F.col("seq.c").alias("c"),
                           "text"))
