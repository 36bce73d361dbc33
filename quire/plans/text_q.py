"""§ generic text profile, token estimate and size formatting."""

from pyspark.sql import functions as F

from quire.functions.text import WS, format_size
from quire.operators import textprofile as TP
from quire.plans.common import finish
from quire.plans.registry import query
from quire.plans.sqlfrag import utf16_len
from quire.sources.fixtures import derived, duck_with
from quire.sources.tables import table

NB = f"list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^{WS[1:-1]}]'))"


@query("text_stats", f"""
WITH s AS (SELECT doc_id, len(string_split(text, chr(10))) AS total_lines, {NB} AS nb FROM documents)
SELECT doc_id, total_lines, len(nb) AS nonblank_lines,
       CAST(floor(CAST(coalesce(list_sum(list_transform(nb, lambda l: {utf16_len('l')})), 0) AS DOUBLE)
                  / greatest(len(nb), 1) + 0.5) AS BIGINT) AS avg_len
FROM s
""")
def text_stats(spark, sf):
    return finish(TP.text_stats(table(spark, sf, "documents")))


@query("text_preview", f"""
WITH s AS (SELECT doc_id, {NB} AS nb FROM documents),
f AS (SELECT doc_id, list_reduce(nb, lambda acc, l: CASE WHEN acc.left_ > 0 THEN struct_pack(
          left_ := acc.left_ - length(substring(l, 1, acc.left_)),
          out := list_append(acc.out, struct_pack(preview := substring(l, 1, acc.left_), cut := length(l) > acc.left_)))
        ELSE acc END,
        struct_pack(left_ := CAST(300 AS BIGINT),
                    out := CAST([] AS STRUCT(preview VARCHAR, cut BOOLEAN)[]))).out AS out FROM s)
SELECT doc_id, CAST(generate_subscripts(out, 1) AS BIGINT) AS ord, unnest(out).preview AS preview,
       unnest(out).cut AS cut FROM f
""")
def text_preview(spark, sf):
    return finish(TP.text_preview(table(spark, sf, "documents")))


@query("token_estimate", duck_with("v_files") + f"""
SELECT path, CASE WHEN coalesce(length(content), 0) = 0 THEN CAST(0 AS BIGINT)
                  ELSE CAST(ceil({utf16_len('content')} / CAST(3.75 AS DOUBLE)) AS BIGINT) END AS tokens
FROM v_files
""")
def token_estimate(spark, sf):
    f = derived(spark, sf, "v_files")
    return finish(f.select("path", TP.token_estimate(F.col("content")).alias("tokens")))


@query("format_size", duck_with("v_files") + """
SELECT path, size, CASE
  WHEN size >= 1048576 THEN CAST(CAST(floor((size * 20 + 1048576) / 2097152) AS BIGINT) // 10 AS VARCHAR) || '.'
       || CAST(CAST(floor((size * 20 + 1048576) / 2097152) AS BIGINT) % 10 AS VARCHAR) || 'MB'
  WHEN size >= 1024 THEN CAST(CAST(floor((size * 20 + 1024) / 2048) AS BIGINT) // 10 AS VARCHAR) || '.'
       || CAST(CAST(floor((size * 20 + 1024) / 2048) AS BIGINT) % 10 AS VARCHAR) || 'KB'
  ELSE CAST(size AS VARCHAR) || 'B' END AS size_text
FROM v_files
""")
def format_size_q(spark, sf):
    f = derived(spark, sf, "v_files")
    return finish(f.select("path", "size", format_size("size").alias("size_text")))


def _tok_sql():
    from quire.plans.render_q import tokens_fmt_sql
    return tokens_fmt_sql("tokens")


@query("format_tokens", duck_with("v_files") + """
, t AS (SELECT path, CASE WHEN coalesce(length(content), 0) = 0 THEN CAST(0 AS BIGINT)
                  ELSE CAST(ceil((length(content) + length(regexp_replace(content, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))
                                 / CAST(3.75 AS DOUBLE)) AS BIGINT) END * 37 AS tokens FROM v_files)
SELECT path, tokens, TOKFMT AS tokens_text FROM t
""".replace("TOKFMT", _tok_sql()))
def format_tokens_q(spark, sf):
    from quire.functions.text import format_tokens
    f = derived(spark, sf, "v_files")
    t = f.select("path", (TP.token_estimate(F.col("content")) * 37).alias("tokens"))
    return finish(t.select("path", "tokens", format_tokens(F.col("tokens")).alias("tokens_text")))
