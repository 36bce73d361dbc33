"""§ text summarisation over ``v_prose`` (derived from ``documents``)."""

from pyspark.sql import functions as F

from quire.operators import summarize as S
from quire.plans.common import finish
from quire.plans.docs_q import clean_sql
from quire.plans.registry import query
from quire.plans.sqlfrag import trim
from quire.sources.fixtures import derived, duck_with

D = S.DELIMS
SENT_RE = f"[^{D}\n]+[{D}]?\n?"


def split_sql(t: str) -> str:
    runs = f"list_filter(list_transform(regexp_extract_all({t}, '{SENT_RE}'), lambda s: {trim('s')}), lambda s: s <> '')"
    tail = (f"{trim(f'''CASE WHEN regexp_matches({t}, '[^{D}\n]') THEN regexp_replace(regexp_extract({t}, '[{D}\n]*$', 0), '^[{D}]?\n?', '') ELSE {t} END''')}")
    return (f"CASE WHEN {t} IS NULL OR {t} = '' THEN CAST([] AS VARCHAR[]) "
            f"WHEN {tail} <> '' THEN list_append({runs}, {tail}) ELSE {runs} END")


def tokens_sql(t: str) -> str:
    words = f"list_filter(string_split_regex(lower({t}), '[^{S.TOKEN_CLASS}]+'), lambda w: w <> '')"
    chars = (f"list_filter(flatten(list_transform(list_filter({words}, lambda w: regexp_matches(w, '{S.CJK_RE}')), "
             f"lambda w: string_split(w, ''))), lambda c: c <> '')")
    return f"list_distinct(list_concat({words}, {chars}))"


def sentences_cte(name: str, src: str) -> str:
    return f"""
, {name}_ss AS (SELECT doc_id, {split_sql(clean_sql('text'))} AS ss FROM {src}),
{name} AS (SELECT doc_id, CAST(generate_subscripts(ss, 1) - 1 AS BIGINT) AS pos, unnest(ss) AS text FROM {name}_ss)
"""


def graph_ctes(p: str, nodes: str, idx: str) -> str:
    """CTEs {p}_edges(doc_id,i,j,sim) and {p}_rank(doc_id, idx, s, iter) — TextRank
    as a recursive CTE with per-document stop."""
    one = "CAST(1 AS DOUBLE)"
    d = f"CAST({S.DAMPING} AS DOUBLE)"
    return f"""
, {p}_tok AS (SELECT doc_id, {idx} AS idx, len(tk) AS nt, unnest(tk) AS token
              FROM (SELECT doc_id, {idx}, {tokens_sql('text')} AS tk FROM {nodes})),
{p}_half AS (SELECT a.doc_id, a.idx AS i, b.idx AS j,
                   CAST(count(*) AS DOUBLE) / (a.nt + b.nt - count(*)) AS sim
             FROM {p}_tok a JOIN {p}_tok b ON a.doc_id = b.doc_id AND a.token = b.token AND a.idx < b.idx
             GROUP BY a.doc_id, a.idx, b.idx, a.nt, b.nt),
{p}_edges AS (SELECT doc_id, i, j, sim FROM {p}_half UNION ALL SELECT doc_id, j, i, sim FROM {p}_half),
{p}_rs AS (SELECT doc_id, j AS src, sum(sim) AS rowsum FROM {p}_edges GROUP BY doc_id, j),
{p}_we AS (SELECT e.doc_id, e.j AS src, e.i AS dst, e.sim / r.rowsum AS w
           FROM {p}_edges e JOIN {p}_rs r ON e.doc_id = r.doc_id AND e.j = r.src),
{p}_it AS (
  SELECT doc_id, {idx} AS idx, {one} AS s, 0 AS iter, false AS done FROM {nodes}
  UNION ALL
  SELECT doc_id, idx, s, iter, done FROM (
    SELECT x.doc_id, x.idx, x.new AS s, x.iter,
           (max(abs(x.new - x.old)) OVER (PARTITION BY x.doc_id) < {S.TOLERANCE}) OR x.iter >= {S.ITERATIONS} AS done
    FROM (SELECT n.doc_id, n.idx, n.s AS old, n.iter + 1 AS iter,
                 ({one} - {d}) + {d} * coalesce(c.acc, 0) AS new
          FROM {p}_it n LEFT JOIN (
              SELECT we.doc_id, we.dst, sum(we.w * q.s) AS acc
              FROM {p}_we we JOIN {p}_it q ON q.doc_id = we.doc_id AND q.idx = we.src AND NOT q.done
              GROUP BY we.doc_id, we.dst) c ON c.doc_id = n.doc_id AND c.dst = n.idx
          WHERE NOT n.done) x) y
),
{p}_rank AS (SELECT doc_id, idx, s, iter FROM {p}_it WHERE done)
"""


SENT = duck_with("v_prose") + sentences_cte("sent", "v_prose")


def _docs(spark, sf):
    return derived(spark, sf, "v_prose")


@query("clean_text", duck_with("v_prose") + f"SELECT doc_id, {clean_sql('text')} AS clean FROM v_prose")
def clean_text(spark, sf):
    return finish(_docs(spark, sf).select("doc_id", S.clean_text(F.col("text")).alias("clean")))


@query("sentence_split", SENT + "SELECT doc_id, pos, text FROM sent")
def sentence_split(spark, sf):
    return finish(S.sentences(_docs(spark, sf)))


@query("sentence_tokens", SENT + f"""
, t AS (SELECT doc_id, pos, {tokens_sql('text')} AS tk FROM sent)
SELECT doc_id, pos, len(tk) AS n_tokens, unnest(tk) AS token FROM t
""")
def sentence_tokens(spark, sf):
    t = S.sentence_tokens(S.sentences(_docs(spark, sf)))
    return finish(t.withColumnRenamed("idx", "pos"))


@query("sentence_similarity", SENT.replace("WITH ", "WITH RECURSIVE ", 1) + graph_ctes("g", "sent", "pos")
       + "SELECT doc_id, i, j, sim FROM g_edges")
def sentence_similarity(spark, sf):
    return finish(S.similarity_edges(_docs(spark, sf)))


@query("textrank", SENT.replace("WITH ", "WITH RECURSIVE ", 1) + graph_ctes("g", "sent", "pos")
       + "SELECT doc_id, idx AS pos, round(s, 6) AS score, iter AS iterations FROM g_rank")
def textrank(spark, sf):
    r = S.textrank(_docs(spark, sf))
    return finish(r.select("doc_id", "pos", F.round("score", 6).alias("score"), "iterations"))


def _fold_sql(lst: str, max_len: int, min_n: int) -> str:
    take = f"(NOT acc.stop AND (acc.cur + x.len <= {max_len} OR acc.n < {min_n}))"
    cur = f"(acc.cur + CASE WHEN {take} THEN x.len ELSE 0 END)"
    n = f"(acc.n + CASE WHEN {take} THEN 1 ELSE 0 END)"
    return (f"list_reduce({lst}, lambda acc, x: struct_pack(cur := {cur}, n := {n}, "
            f"stop := acc.stop OR ({cur} >= {max_len} AND {n} >= {min_n}), "
            f"picked := CASE WHEN {take} THEN list_append(acc.picked, x.pos) ELSE acc.picked END), "
            f"struct_pack(cur := CAST(0 AS BIGINT), n := CAST(0 AS BIGINT), stop := false, "
            f"picked := CAST([] AS BIGINT[])))")


@query("summary_select", duck_with("v_prose").replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, c AS (SELECT doc_id, {clean_sql('text')} AS clean FROM v_prose),
s AS (SELECT doc_id, clean, {split_sql('clean')} AS ss FROM c),
short AS (SELECT doc_id, clean AS summary FROM s WHERE length(clean) <= 600 OR len(ss) <= 3),
ln AS (SELECT doc_id, CAST(generate_subscripts(ss, 1) - 1 AS BIGINT) AS pos, unnest(ss) AS text
       FROM s WHERE NOT (length(clean) <= 600 OR len(ss) <= 3))
{graph_ctes('g', 'ln', 'pos')}
, o AS (SELECT r.doc_id, list(struct_pack(pos := r.idx, len := CAST(length(n.text) AS BIGINT))
                              ORDER BY round(r.s, 9) DESC, r.idx) AS lst
        FROM g_rank r JOIN ln n ON r.doc_id = n.doc_id AND r.idx = n.pos GROUP BY r.doc_id),
f AS (SELECT doc_id, unnest({_fold_sql('lst', 600, 3)}.picked) AS pos FROM o)
SELECT doc_id, summary FROM short
UNION ALL
SELECT f.doc_id, string_agg(ln.text, chr(10) ORDER BY ln.pos) AS summary
FROM f JOIN ln ON f.doc_id = ln.doc_id AND f.pos = ln.pos GROUP BY f.doc_id
""")
def summary_select(spark, sf):
    return finish(S.summary_select(_docs(spark, sf), max_length=600, min_sentences=3))


KEY_SQL = duck_with("v_prose").replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, s AS (SELECT doc_id, ss, list_filter(ss, lambda x: length(x) >= 20) AS valid
        FROM (SELECT doc_id, {split_sql(clean_sql('text'))} AS ss FROM v_prose)),
few AS (SELECT doc_id, CAST(generate_subscripts(valid, 1) - 1 AS BIGINT) AS position, CAST(1 AS DOUBLE) AS score,
               unnest(valid) AS text FROM s WHERE len(valid) <= 5),
kn AS (SELECT doc_id, vidx, text, CAST(list_position(ss, text) - 1 AS BIGINT) AS position
       FROM (SELECT doc_id, ss, CAST(generate_subscripts(valid, 1) - 1 AS BIGINT) AS vidx, unnest(valid) AS text
             FROM s WHERE len(valid) > 5))
{graph_ctes('k', 'kn', 'vidx')}
, top AS (SELECT kn.doc_id, kn.position, r.s AS score, kn.text, kn.vidx,
                 row_number() OVER (PARTITION BY kn.doc_id ORDER BY round(r.s, 9) DESC, kn.vidx) AS r
          FROM kn JOIN k_rank r ON kn.doc_id = r.doc_id AND kn.vidx = r.idx),
allk AS (SELECT doc_id, position, score, text, position AS vidx FROM few
         UNION ALL SELECT doc_id, position, score, text, vidx FROM top WHERE r <= 5),
ks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY position, score DESC, vidx) AS rank,
              position, score, text FROM allk)
"""


@query("key_sentences", KEY_SQL + "SELECT doc_id, rank, position, round(score, 6) AS score, text FROM ks")
def key_sentences(spark, sf):
    k = S.key_sentences(_docs(spark, sf), k=5, min_length=20)
    return finish(k.withColumn("score", F.round("score", 6)))


@query("key_point_pages", KEY_SQL.replace("WITH RECURSIVE ", "WITH RECURSIVE v_paged AS (SELECT doc_id, 1 + CAST(floor(length(text) / 1500) AS INT) AS n_pages FROM documents),\n", 1) + """
, nk AS (SELECT doc_id, count(*) AS n_keys FROM ks GROUP BY doc_id)
SELECT ks.doc_id, ks.rank,
       CAST(least(floor(CAST(ks.position AS DOUBLE) / nk.n_keys * p.n_pages) + 1, p.n_pages) AS BIGINT) AS page
FROM ks JOIN nk ON ks.doc_id = nk.doc_id JOIN v_paged p ON ks.doc_id = p.doc_id
""")
def key_point_pages(spark, sf):
    keys = S.key_sentences(_docs(spark, sf), k=5, min_length=20)
    return finish(S.key_point_pages(keys, derived(spark, sf, "v_paged")))


def _section_sql() -> str:
    """Sections of ``v_md`` (a heading line begins one), each summarised as a text of its own."""
    title = trim("lines[1]")
    return duck_with("v_md").replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, c AS (SELECT doc_id, {clean_sql('text')} AS clean FROM v_md),
cut AS (SELECT doc_id, string_split(regexp_replace(clean, chr(10) || '(#{{1,6}} )', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM c),
sec AS (SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS section_no, unnest(parts) AS body FROM cut),
ll AS (SELECT doc_id, section_no, string_split(body, chr(10)) AS lines FROM sec WHERE {trim('body')} <> ''),
bd AS (SELECT doc_id, section_no, CASE WHEN {title} = '' THEN 'Untitled Section' ELSE {title} END AS title, array_to_string(lines[2:], chr(10)) AS clean FROM ll),
b AS (SELECT row_number() OVER (ORDER BY doc_id, section_no) AS sid, * FROM bd WHERE length(clean) >= 50),
s AS (SELECT sid AS doc_id, clean, {split_sql('clean')} AS ss FROM b),
short AS (SELECT doc_id, clean AS summary FROM s WHERE length(clean) <= 300 OR len(ss) <= 2),
ln AS (SELECT doc_id, CAST(generate_subscripts(ss, 1) - 1 AS BIGINT) AS pos, unnest(ss) AS text FROM s WHERE NOT (length(clean) <= 300 OR len(ss) <= 2))
{graph_ctes('g', 'ln', 'pos')}
, o AS (SELECT r.doc_id, list(struct_pack(pos := r.idx, len := CAST(length(n.text) AS BIGINT)) ORDER BY round(r.s, 9) DESC, r.idx) AS lst
        FROM g_rank r JOIN ln n ON r.doc_id = n.doc_id AND r.idx = n.pos GROUP BY r.doc_id),
f AS (SELECT doc_id, unnest({_fold_sql('lst', 300, 2)}.picked) AS pos FROM o),
summ AS (SELECT doc_id, summary FROM short UNION ALL SELECT f.doc_id, string_agg(ln.text, chr(10) ORDER BY ln.pos)
         FROM f JOIN ln ON f.doc_id = ln.doc_id AND f.pos = ln.pos GROUP BY f.doc_id),
v AS (SELECT doc_id, ss, list_filter(ss, lambda x: length(x) >= 10) AS valid FROM s),
few AS (SELECT doc_id, CAST(generate_subscripts(valid, 1) - 1 AS BIGINT) AS position, CAST(1 AS DOUBLE) AS score, unnest(valid) AS text FROM v WHERE len(valid) <= 3),
kn AS (SELECT doc_id, vidx, text, CAST(list_position(ss, text) - 1 AS BIGINT) AS position
       FROM (SELECT doc_id, ss, CAST(generate_subscripts(valid, 1) - 1 AS BIGINT) AS vidx, unnest(valid) AS text FROM v WHERE len(valid) > 3))
{graph_ctes('k', 'kn', 'vidx')}
, top AS (SELECT kn.doc_id, kn.position, r.s AS score, kn.text, kn.vidx, row_number() OVER (PARTITION BY kn.doc_id ORDER BY round(r.s, 9) DESC, kn.vidx) AS r
          FROM kn JOIN k_rank r ON kn.doc_id = r.doc_id AND kn.vidx = r.idx),
points AS (SELECT doc_id, position, score, text, position AS vidx FROM few UNION ALL SELECT doc_id, position, score, text, vidx FROM top WHERE r <= 3),
told AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY position, score DESC, vidx) AS key_points FROM points GROUP BY doc_id)
SELECT b.doc_id, b.section_no, b.title, summ.summary, coalesce(told.key_points, '') AS key_points
FROM b JOIN summ ON summ.doc_id = b.sid LEFT JOIN told ON told.doc_id = b.sid
"""


@query("section_summaries", _section_sql())
def section_summaries(spark, sf):
    r = S.section_summaries(derived(spark, sf, "v_md"))
    return finish(r.withColumn("key_points", F.array_join("key_points", "\n")))
