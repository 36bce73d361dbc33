"""Column-expression helpers shared by the operators.

Everything here returns a ``Column`` built from built-in functions, so it stays
inside whole-stage codegen.  Regex classes are written in the syntax both Java
and RE2 accept (``\\x{..}``) so the same class text appears in the oracle SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import ensure_checkpoint_dir

# --- fixed values -------------------------------------------------------------
# JavaScript's \s and String.prototype.trim() set.
WS = r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
JS_WS = "".join(map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
# ASCII word character (JavaScript \w, RE2 \w).
WORD = "[A-Za-z0-9_]"
# -----------------------------------------------------------------------------

__all__ = [
    "WS", "JS_WS", "WORD", "js_trim", "collapse_ws", "is_ascii", "is_blank", "utf16_len", "explode_lines",
    "format_size", "format_tokens", "format_fixed1", "truncate", "lit_array", "explode_rows", "format_percent", "rank_within", "number_within",
]


def js_trim(c) -> Column:
    """``String.prototype.trim`` (Spark's trim only strips spaces)."""
    return F.btrim(c, F.lit(JS_WS))  # looks at the ends only


def collapse_ws(c) -> Column:
    return F.regexp_replace(c, f"{WS}+", " ")


def is_ascii(c) -> Column:
    """Whether every character takes one byte; counted, without a regex."""
    return F.octet_length(c) == F.length(c)


def is_blank(c) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(f"[^\\t\\n\\x{{0B}}\\f\\r \\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]")


def utf16_len(c) -> Column:
    """Length in UTF-16 code units (JavaScript ``length``)."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def truncate(c, n: int) -> Column:
    return F.substring(c, 1, n)


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def explode_lines(df: DataFrame, content: str = "content", keep: tuple = ()) -> DataFrame:
    """One row per line: ``split(content, '\\n', -1)`` keeps the trailing empty
    line, as ``content.split('\\n')`` does.  ``line_no`` is 1-based."""
    cols = [c for c in df.columns if c != content] if not keep else list(keep)
    return df.select(*cols, F.posexplode(F.split(F.col(content), "\n", -1)).alias("line_no", "text")) \
        .withColumn("line_no", (F.col("line_no") + 1).cast("int"))


def format_size(bytes_col) -> Column:
    """``B``/``KB``/``MB`` with JavaScript ``toFixed(1)``: the quotient by a power of
    two is exact, so round-half-up on integers reproduces it bit for bit."""
    b = F.col(bytes_col) if isinstance(bytes_col, str) else bytes_col
    b = b.cast("long")
    kb10 = F.floor((b * 20 + 1024) / 2048).cast("long")
    mb10 = F.floor((b * 20 + 1048576) / 2097152).cast("long")
    fmt = lambda t, unit: F.concat((t / 10).cast("long").cast("string"), F.lit("."),
                                   (t % 10).cast("string"), F.lit(unit))
    return (F.when(b >= 1048576, fmt(mb10, "MB"))
            .when(b >= 1024, fmt(kb10, "KB"))
            .otherwise(F.concat(b.cast("string"), F.lit("B"))))


def format_fixed1(c) -> Column:
    """JavaScript ``toFixed(1)`` of a double from 0 below 2^53: the exact binary
    value decides, ties go up.  The fraction times 2^58 is a whole number for
    every value that does not round to 0.0 anyway, so integers decide."""
    x = c.cast("double")
    whole = F.floor(x).cast("long")
    part = ((x - whole) * F.lit(float(1 << 58))).cast("long")
    tenths = whole * 10 + F.shiftright(part * 10 + F.lit(1 << 57), 58)
    return F.concat((tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"))


def format_tokens(count_col) -> Column:
    c = F.col(count_col) if isinstance(count_col, str) else count_col
    return (F.when(c >= 1000000, F.concat(format_fixed1(c / F.lit(1000000.0)), F.lit("M")))
            .when(c >= 1000, F.concat(format_fixed1(c / F.lit(1000.0)), F.lit("K")))
            .otherwise(c.cast("long").cast("string")))


def explode_rows(df: DataFrame, arr: Column, keep, pos: str = "pos", val: str = "val") -> DataFrame:
    """``posexplode`` without the inferred ``size(arr) > 0`` filter.

    Catalyst infers that filter for an inner generator and pushes it below the
    projections, which re-evaluates the whole (often regex-heavy) array
    expression a second time.  The outer generator has no such filter; empty
    arrays yield one null row, dropped here."""
    return (df.select(*keep, F.posexplode_outer(arr).alias(pos, val))
            .where(F.col(pos).isNotNull())
            .withColumn(pos, F.col(pos).cast("int")))


def format_percent(n, total) -> Column:
    """``((n / total) * 100).toFixed(1)``: the same two double operations as the
    reference, then the exact ``toFixed`` of the result."""
    a = F.col(n) if isinstance(n, str) else n
    b = F.col(total) if isinstance(total, str) else total
    return format_fixed1((a.cast("double") / b.cast("double")) * F.lit(100.0))


def rank_within(df: DataFrame, group, order: list, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``row_number() over (partition by group order by order)`` without putting a
    whole group in one task, for keys of any type: the rows are range-partitioned
    on (group, order), sorted and numbered in place, and written to the shared
    checkpoint folder, so every later read sees the same layout whatever executor
    is lost.  A row's rank is its place in its range less the place where its
    group begins there, plus the group's rows in earlier ranges (one small row
    for each range and group).  Pass the keys only and join the rank back when
    rows are wide.  Runs the job that writes the layout."""
    g = [group] if isinstance(group, str) else list(group)
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = (df.repartitionByRange(n, *[F.col(c) for c in g], *order).sortWithinPartitions(*[F.col(c) for c in g], *order)
            .withColumn("_row", F.monotonically_increasing_id()))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rank-{uuid.uuid4().hex}"
    laid.write.parquet(path)
    laid = spark.read.schema(laid.schema).parquet(path).withColumn("_part", F.shiftright("_row", 33))
    begin = laid.groupBy("_part", *g).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    earlier = F.sum("_n").over(Window.partitionBy(*g).orderBy("_part")) - F.col("_n")
    begin = begin.select("_part", *g, "_first", earlier.alias("_earlier"))
    return (laid.join(begin, ["_part", *g])
            .withColumn(name, (F.col("_row") - F.col("_first") + F.col("_earlier") + 1).cast("int"))
            .drop("_part", "_row", "_n", "_first", "_earlier"))


#: Numbers of a bucket in which ``number_within`` ranks at once.
NUMBER_SPAN = 1 << 16


def number_within(df: DataFrame, group, number: str, name: str = "rank") -> DataFrame:
    """``row_number() over (partition by group order by number)`` for an integer
    ``number`` (a line or a step): ranked inside spans of ``NUMBER_SPAN`` numbers
    and shifted by the rows of the group's earlier spans, so one huge file or
    function is many small windows.  Lazy, and the same whatever is recomputed."""
    g = [group] if isinstance(group, str) else list(group)
    spans = df.withColumn("_span", F.floor(F.col(number) / F.lit(NUMBER_SPAN)).cast("long"))
    sizes = spans.groupBy(*g, "_span").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*g).orderBy("_span")) - F.col("_n")
    sizes = sizes.select(*g, "_span", earlier.alias("_earlier"))
    local = spans.withColumn("_local", F.row_number().over(Window.partitionBy(*g, "_span").orderBy(number)))
    return (local.join(sizes, [*g, "_span"]).withColumn(name, (F.col("_local") + F.col("_earlier")).cast("int"))
            .drop("_span", "_local", "_earlier"))
