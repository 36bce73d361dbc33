"""§ log analytics over ``v_log_lines`` (derived from ``events``)."""

from pyspark.sql import functions as F

from quire.operators import logs
from quire.plans.registry import query
from quire.plans.sqlfrag import trim
from quire.sources.fixtures import derived, duck_with

W = duck_with("v_log_lines")
TT = trim("text")
LEVEL = r"(?i)\b(DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL|TRACE)\b"


def _lines(spark, sf):
    return derived(spark, sf, "v_log_lines")


@query("log_level", W + f"""
SELECT path, line_no, upper(regexp_extract(text, '{LEVEL}', 1)) AS level
FROM v_log_lines WHERE regexp_matches(text, '{LEVEL}')
""")
def log_level(spark, sf):
    return logs.with_level(_lines(spark, sf)).where(F.col("level").isNotNull()) \
        .select("path", "line_no", "level")


@query("log_level_distribution", W + f"""
, lv AS (SELECT path, line_no, upper(regexp_extract(text, '{LEVEL}', 1)) AS level FROM v_log_lines),
per AS (SELECT path, level, count(*) AS n, min(line_no) AS first_line FROM lv WHERE level <> ''
        GROUP BY path, level),
tot AS (SELECT path, count(*) AS total_lines FROM v_log_lines GROUP BY path)
SELECT per.path, level, n, first_line, total_lines,
       round(CAST(n AS DOUBLE) * 100 / total_lines, 4) AS pct,
       row_number() OVER (PARTITION BY per.path ORDER BY n DESC, first_line) AS rank
FROM per JOIN tot ON per.path = tot.path
""")
def log_level_distribution(spark, sf):
    d = logs.level_distribution(_lines(spark, sf))
    return d.select("path", "level", "n", "first_line", "total_lines",
                    F.round("pct", 4).alias("pct"), F.col("rank").cast("long").alias("rank"))


@query("log_error_lines", W + f"""
, m AS (SELECT path, line_no, text,
          row_number() OVER (PARTITION BY path ORDER BY line_no) AS rank
        FROM v_log_lines WHERE regexp_matches(text, '(?i)(error|exception|failed|timeout|crash|fatal)'))
SELECT path, rank, line_no, substring({TT}, 1, 150) AS text FROM m WHERE rank <= 10
""")
def log_error_lines(spark, sf):
    return logs.error_lines(_lines(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@query("log_level_samples", W + f"""
, lv AS (SELECT path, line_no, text, upper(regexp_extract(text, '{LEVEL}', 1)) AS level FROM v_log_lines),
r AS (SELECT *, row_number() OVER (PARTITION BY path, level ORDER BY line_no) AS rank
      FROM lv WHERE level <> '')
SELECT path, level, rank, line_no, {TT} AS text FROM r WHERE rank <= 5
""")
def log_level_samples(spark, sf):
    return logs.level_samples(_lines(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@query("format_percent", W + f"""
, lv AS (SELECT path, upper(regexp_extract(text, '{LEVEL}', 1)) AS level FROM v_log_lines),
per AS (SELECT path, level, count(*) AS n FROM lv WHERE level <> '' GROUP BY path, level),
tot AS (SELECT path, count(*) AS total_lines FROM v_log_lines GROUP BY path),
p AS (SELECT per.path, level, n, total_lines, CAST(n AS DOUBLE) / CAST(total_lines AS DOUBLE) * 100 AS x FROM per JOIN tot ON per.path = tot.path)
SELECT path, level, n, total_lines,
       CASE WHEN x * 4 = floor(x * 4) AND CAST(x * 4 AS BIGINT) % 2 = 1 THEN printf('%.1f', x + 0.01) ELSE printf('%.1f', x) END AS pct_text FROM p
""")
def format_percent_q(spark, sf):
    from quire.functions.text import format_percent
    d = logs.level_distribution(_lines(spark, sf))
    return d.select("path", "level", "n", "total_lines", format_percent("n", "total_lines").alias("pct_text"))
