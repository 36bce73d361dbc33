"""Rendering: file blocks, assembly as ordered rows, token budget, templates.

A project's document is never built as one string in one task: it is an
ordered set of rows ``(project, seq, text)`` whose plain concatenation is the
document; the writer sorts by ``(project, seq)`` and streams rows out.
Totals (tokens, counts) are aggregates over lengths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.config import CHARS_PER_TOKEN, DEFAULT, WARNING_EMOJI, Config
from quire.functions.text import collapse_ws, format_size, js_trim, utf16_len
from quire.session import written

# --- fixed values -------------------------------------------------------------
TEMPLATE_VARS = ("PROJECT_NAME", "DIR_TREE", "FILE_LIST", "FILE_CONTENTS", "TOKEN_COUNT", "TOKEN_LIMIT",
                 "FILE_COUNT", "OUTLINE_COUNT", "TIMESTAMP", "SELECTED_FILES", "SCOPE", "WORKSPACE_PATH")
BIG_VARS = ("DIR_TREE", "FILE_LIST", "FILE_CONTENTS")
DEFAULT_TEMPLATE = """> 📊 **Context Statistics**
> - Total Tokens: ~$TOKEN_COUNT / $TOKEN_LIMIT
> - Files Included: $FILE_COUNT ($OUTLINE_COUNT as outline)
> - Generated at: $TIMESTAMP

# Project Structure

```
$DIR_TREE
```

# File Contents

$FILE_CONTENTS"""
BODY_HEAD = "# Project Structure\n"
BODY_MID = "\n\n# File Contents\n"
# -----------------------------------------------------------------------------


def file_block(rel_path: Column, size: Column, language: Column, content: Column, truncated: Column,
               config: Config = DEFAULT) -> Column:
    """Header line plus fenced body (three back-ticks close the fence)."""
    cfg = config.clamped()
    head = F.when(truncated, F.concat(F.lit(f"// File: "), rel_path, F.lit(f" ({WARNING_EMOJI} "), format_size(size),
                                      F.lit(", exceeds "), format_size(F.lit(cfg.max_file_size)), F.lit(" threshold)\n"))) \
        .otherwise(F.concat(F.lit("// File: "), rel_path, F.lit(" ("), format_size(size), F.lit(")\n")))
    lang = F.coalesce(language, F.lit("text")) if cfg.auto_detect_language else F.lit("text")
    return F.concat(head, F.lit("```"), lang, F.lit("\n"), F.coalesce(content, F.lit("")), F.lit("\n```\n"))


def binary_block(name: Column, type_: Column, fmt: Column, details: Column) -> Column:
    """``// {type} file: name`` / ``// Type: t (FMT)`` / optional details line."""
    head = F.concat(F.lit("// "), type_, F.lit(" file: "), name, F.lit("\n// Type: "), type_,
                    F.when(F.coalesce(fmt, F.lit("")) != "", F.concat(F.lit(" ("), fmt, F.lit(")"))).otherwise(F.lit("")))
    return F.concat(head, F.when(F.size(details) > 0, F.concat(F.lit("\n// Details: "), F.array_join(details, ", ")))
                    .otherwise(F.lit("")), F.lit("\n"))


def assemble(tree_lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(project, seq, text): ``# Project Structure`` + tree lines + ``# File
    Contents`` + blocks separated by blank lines.  ``tree_lines(project, ord,
    line)`` and ``blocks(project, rank, block)`` are already ordered by their
    keys; concatenating ``text`` by ``seq`` gives the document."""
    n_lines = tree_lines.groupBy("project").agg(F.max("ord").alias("n_lines"))
    tl = tree_lines.join(n_lines, "project").select(
        "project", F.struct(F.lit(1).cast("long").alias("a"), F.col("ord").cast("long").alias("b")).alias("seq"),
        F.concat(F.when(F.col("ord") == 1, F.lit(BODY_HEAD)).otherwise(F.lit("")), F.col("line"),
                 F.when(F.col("ord") == F.col("n_lines"), F.lit(BODY_MID)).otherwise(F.lit("\n"))).alias("text"))
    first = blocks.groupBy("project").agg(F.min("rank").alias("first_rank"))
    bl = blocks.join(first, "project").select(
        "project", F.struct(F.lit(2).cast("long").alias("a"), F.col("rank").cast("long").alias("b")).alias("seq"),
        F.concat(F.when(F.col("rank") == F.col("first_rank"), F.lit("")).otherwise(F.lit("\n\n")), F.col("block"))
        .alias("text"))
    return tl.unionByName(bl)


def token_budget(doc_rows: DataFrame, files: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(project, chars, tokens, exceeded, file_count): one ``ceil`` over the
    whole body's UTF-16 length (lengths are summed first)."""
    cfg = config.clamped()
    t = doc_rows.groupBy("project").agg(F.sum(utf16_len(F.col("text"))).alias("chars"))
    n = files.groupBy("project").agg(F.count(F.lit(1)).alias("file_count"))
    return (t.join(n, "project")
            .withColumn("tokens", F.ceil(F.col("chars") / F.lit(CHARS_PER_TOKEN)).cast("long"))
            .withColumn("exceeded", F.col("tokens") > cfg.max_tokens))


def template_segments(templates: DataFrame) -> DataFrame:
    """(name, seg_no, kind, text): a template cut at the large variables.
    ``kind`` is ``lit`` for literal text or the variable name."""
    pat = "(" + "|".join(f"\\${v}" for v in BIG_VARS) + ")"
    # mark the large variables, split on the marker, keep the variable names
    marked = F.regexp_replace("body", pat, "\u0000$1\u0000")
    parts = F.split(marked, "\u0000", -1)
    seg = templates.select("name", F.posexplode(parts).alias("seg_no", "text"))
    kind = F.when(F.col("text").isin(*[f"${v}" for v in BIG_VARS]), F.substring("text", 2, 64)).otherwise("lit")
    return seg.select("name", "seg_no", kind.alias("kind"), "text")


def apply_small_vars(text: Column, values: dict, after: str | None = None) -> Column:
    """Literal, sequential replacement of the small variables (those after
    ``after`` in the replacement order when given); null values become ''."""
    order = list(TEMPLATE_VARS)
    start = order.index(after) + 1 if after else 0
    out = text
    for v in order[start:]:
        if v in BIG_VARS or v not in values:
            continue
        out = F.replace(out, F.lit(f"${v}"), F.coalesce(values[v], F.lit("")))
    return out


def template_catalog(templates: DataFrame) -> DataFrame:
    """(name, body): the built-in ``default`` plus every supplied template; a
    supplied ``default`` does not replace the built-in name listing."""
    spark = templates.sparkSession
    builtin = spark.createDataFrame([("default", DEFAULT_TEMPLATE)], "name string, body string")
    custom = templates.where(F.col("name") != "default")
    return builtin.unionByName(custom.select("name", "body"))


def choose_template(stats: DataFrame, catalog: DataFrame) -> DataFrame:
    """Resolves ``stats.template``: an unknown name falls back to ``default``."""
    names = catalog.select(F.col("name").alias("template"), F.lit(True).alias("_known"))
    return (stats.join(names, "template", "left")   # AQE broadcasts it when the catalog is small
            .withColumn("template", F.when(F.col("_known"), F.col("template")).otherwise(F.lit("default")))
            .drop("_known"))


def render_template_rows(segments: DataFrame, stats: DataFrame, streams: dict) -> DataFrame:
    """(project, seq, text) rendering each project's chosen template.

    ``stats`` has one row per project: ``template`` and the small variables as
    columns; ``streams`` maps large variables to ``(project, seq, text)`` rows.
    Replacement is literal and sequential in the fixed variable order: the
    project name is replaced before any large variable is inserted, and every
    later variable also applies inside inserted rows."""
    small = [v for v in TEMPLATE_VARS if v not in BIG_VARS]
    vals = {v: F.col(v) for v in small}
    seg = segments.withColumnRenamed("name", "template")
    lit = stats.join(seg.where(F.col("kind") == "lit"), "template").select(
        "project", F.struct(F.col("seg_no").cast("long").alias("a"), F.lit(0).cast("long").alias("b"),
                            F.lit(0).cast("long").alias("c")).alias("seq"),
        apply_small_vars(F.replace("text", F.lit("$PROJECT_NAME"), F.coalesce(F.col("PROJECT_NAME"), F.lit(""))),
                         vals, after="PROJECT_NAME").alias("text"))
    outs = [lit]
    for v in BIG_VARS:
        rows = streams.get(v)
        if rows is None:
            continue
        places = seg.where(F.col("kind") == v).select("template", "seg_no")
        ins = rows.join(stats, "project").join(places, "template").select(
            "project", F.struct(F.col("seg_no").cast("long").alias("a"), F.col("seq.a").cast("long").alias("b"),
                                F.col("seq.b").cast("long").alias("c")).alias("seq"),
            apply_small_vars(F.col("text"), vals, after=v).alias("text"))
        outs.append(ins)
    return reduce(DataFrame.unionByName, outs)


from quire.config import SECTION_SEPARATOR as SEP  # noqa: E402


def _sep_block(title: str) -> str:
    return f"{SEP}\n// {title}\n{SEP}\n"


def render_log_summary(lines: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(path, text): the log summary block per file from the structured log
    outputs (distribution, first error lines, samples per level).  Each list is
    capped upstream, so the per-file aggregation is bounded."""
    from quire.functions.text import format_fixed1
    from quire.operators import logs as L
    cfg = config.clamped()
    n = cfg.log_sample_lines
    tot = lines.groupBy("path").agg(F.count(F.lit(1)).alias("total"))
    dist = L.level_distribution(lines).withColumn("pct_text", format_fixed1((F.col("n") / F.col("total_lines")) * 100.0))
    dist_line = F.concat(F.lit("// "), F.rpad("level", 8, " "), F.lit(": "), F.lpad(F.col("n").cast("string"), 6, " "),
                         F.lit(" ("), F.col("pct_text"), F.lit("%)"))
    d = dist.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", dist_line.alias("l")))),
                                                          lambda s: s["l"]), "\n").alias("dist"))
    errs = L.error_lines(lines).groupBy("path").agg(
        F.count(F.lit(1)).alias("n_err"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))),
                                 lambda s: F.concat(F.lit("// "), s["text"])), "\n").alias("errs"))
    order = F.array_position(F.array(*[F.lit(x) for x in L.LOG_LEVELS]), F.col("level"))
    samp = L.level_samples(lines, cfg).withColumn("lo", order).groupBy("path", "level", "lo").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))),
                                 lambda s: F.concat(F.lit("// "), s["text"])), "\n").alias("s"))
    samp = samp.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", "level", "s"))),
                                                             lambda x: F.concat(F.lit("\n// ["), x["level"], F.lit("]\n"), x["s"], F.lit("\n"))), "")
                                    .alias("samples"))
    j = tot.join(d, "path", "left").join(errs, "path", "left").join(samp, "path", "left")
    text = F.concat(
        F.lit("// File: "), F.col("path"), F.lit(f" ({WARNING_EMOJI} Log summary)\n// Total lines: "),
        F.col("total").cast("string"), F.lit("\n\n"), F.lit(_sep_block("LOG LEVEL DISTRIBUTION")),
        F.coalesce(F.concat(F.col("dist"), F.lit("\n")), F.lit("// (no standard log levels detected)\n")), F.lit("\n"),
        F.coalesce(F.concat(F.lit(f"{SEP}\n// RECENT ERROR PATTERNS (first "), F.col("n_err").cast("string"),
                            F.lit(f")\n{SEP}\n"), F.col("errs"), F.lit("\n\n")), F.lit("")),
        F.lit(_sep_block(f"SAMPLE LOG ENTRIES (up to {n} per level)")), F.coalesce(F.col("samples"), F.lit("")))
    return j.select("path", text.alias("text"))


def render_doc_summary(docs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(doc_id, text): the document outline block from headings, code blocks,
    keywords and the opening line."""
    from quire.operators import docs as D
    h = D.headings(docs).select("doc_id", "ord", F.concat(
        F.expr("repeat('  ', level - 1)"), F.lit("// "), F.expr("repeat('#', level)"), F.lit(" "), F.col("text")).alias("l"))
    h = h.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nh"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "l"))), lambda s: s["l"]), "\n").alias("heads"))
    cb = D.code_blocks(docs).select("doc_id", "block_no", F.concat(F.lit("// ```"), F.col("lang"), F.lit(" ("),
                                                                  F.col("n_lines").cast("string"), F.lit(" lines)")).alias("l"))
    cb = cb.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nb"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("block_no", "l"))), lambda s: s["l"]), "\n").alias("blocks"))
    kw = D.keywords(docs).groupBy("doc_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]), ", ").alias("kw"))
    op = D.opening(docs, config)
    st = D.doc_stats(docs)
    j = st.join(h, "doc_id", "left").join(cb, "doc_id", "left").join(kw, "doc_id", "left").join(op, "doc_id", "left")
    text = F.concat(
        F.lit(f"// File: "), F.col("doc_id").cast("string"), F.lit(f" ({WARNING_EMOJI} Document outline)\n\n"),
        F.lit(_sep_block("DOCUMENT STRUCTURE")), F.lit("// Lines: "), F.col("n_lines").cast("string"),
        F.lit(" | Headings: "), F.col("n_headings").cast("string"), F.lit("\n\n"),
        F.coalesce(F.concat(F.col("heads"), F.lit("\n")), F.lit("// (no headings detected)\n")), F.lit("\n"),
        F.coalesce(F.concat(F.lit(f"{SEP}\n// CODE BLOCKS ("), F.col("nb").cast("string"),
                            F.lit(f")\n{SEP}\n"), F.col("blocks"), F.lit("\n\n")), F.lit("")),
        F.coalesce(F.concat(F.lit(_sep_block("KEY TERMS")), F.lit("// "), F.col("kw"), F.lit("\n")), F.lit("")),
        F.coalesce(F.concat(F.lit("\n" + _sep_block("OPENING PARAGRAPH")), F.lit("// "), F.col("opening"), F.lit("\n")),
                   F.lit("")))
    return j.select("doc_id", text.alias("text"))


def render_csv_summary(lines: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(path, text): the delimited-file summary block (shape, schema with types
    and up to two non-blank examples, first rows and the remaining count)."""
    from quire.operators import tabular as TB
    cfg = config.clamped()
    shape = TB.table_shape(lines)
    prof = TB.column_profile(TB.cells(lines))
    ex = F.slice(F.filter("samples", lambda v: v != ""), 1, TB.SAMPLES_SHOWN)
    col_line = F.concat(F.lit("// "), F.col("name"), F.lit(": "), F.col("inferred_type"),
                        F.when(F.size(ex) > 0, F.concat(F.lit(' (examples: "'), F.array_join(ex, '", "'), F.lit('")')))
                        .otherwise(F.lit("")))
    schema = prof.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", col_line.alias("l")))),
                                                               lambda s: s["l"]), "\n").alias("schema"))
    head = TB.table_head(lines, cfg)
    rows = head.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "text"))),
                                                             lambda s: F.concat(F.lit("// "), s["text"])), "\n").alias("rows"))
    j = shape.join(schema, "path", "left").join(rows, "path", "left")
    shown = F.least(F.lit(cfg.csv_sample_rows), F.col("data_rows"))
    delim = F.when(F.col("delimiter") == "\t", F.lit("\\t")).otherwise(F.col("delimiter"))
    body = F.concat(
        F.lit("// File: "), F.col("path"), F.lit(f" ({WARNING_EMOJI} CSV/TSV summary)\n// Total rows: "),
        F.col("data_rows").cast("string"), F.lit('\n// Delimiter: "'), delim, F.lit('"\n\n'),
        F.lit(f"{SEP}\n// SCHEMA ("), F.col("columns").cast("string"), F.lit(f" columns)\n{SEP}\n"),
        F.coalesce(F.concat(F.col("schema"), F.lit("\n")), F.lit("")), F.lit("\n"),
        F.lit(f"{SEP}\n// SAMPLE DATA (first "), shown.cast("string"), F.lit(f" rows)\n{SEP}\n"),
        F.coalesce(F.concat(F.col("rows"), F.lit("\n")), F.lit("")),
        F.when(F.col("data_rows") > shown, F.concat(F.lit("// ... ("), (F.col("data_rows") - shown).cast("string"),
                                                    F.lit(" more rows)\n"))).otherwise(F.lit("")))
    empty = F.concat(F.lit("// File: "), F.col("path"), F.lit(f" ({WARNING_EMOJI} Empty CSV)\n"))
    return j.select("path", F.when(F.col("is_empty"), empty).otherwise(body).alias("text"))


def render_text_summary(files: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(path, text): the generic overview block for non-code text files from
    ``files(path, rel_path, size, language, content)``: line statistics and the
    budgeted preview."""
    from quire.operators import textprofile as TP
    cfg = config.clamped()
    docs = files.select(F.col("path").alias("doc_id"), F.col("content").alias("text"))
    st = TP.text_stats(docs)
    pv = TP.text_preview(docs, cfg).groupBy("doc_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "preview", "cut"))),
        lambda s: F.concat(F.lit("// "), s["preview"], F.when(s["cut"], F.lit("...")).otherwise(F.lit("")))), "\n").alias("pv"))
    j = files.select("path", "rel_path", "size", "language").join(st.withColumnRenamed("doc_id", "path"), "path") \
        .join(pv.withColumnRenamed("doc_id", "path"), "path", "left")
    text = F.concat(
        F.lit("// File: "), F.col("rel_path"), F.lit(f" ({WARNING_EMOJI} Overview — "), format_size(F.col("size")),
        F.lit(", structure outline)\n// Language: "), F.coalesce(F.col("language"), F.lit("text")),
        F.lit("\n// Total lines: "), F.col("total_lines").cast("string"), F.lit("\n\n"),
        F.lit(f"{SEP}\n// TEXT ANALYSIS\n{SEP}\n// Total lines: "), F.col("total_lines").cast("string"),
        F.lit("\n// Non-empty lines: "), F.col("nonblank_lines").cast("string"),
        F.lit("\n// Average line length: "), F.col("avg_len").cast("string"), F.lit(" chars\n\n"),
        F.lit(f"{SEP}\n// PREVIEW (up to {cfg.text_preview_length} chars)\n{SEP}\n"),
        F.coalesce(F.concat(F.col("pv"), F.lit("\n")), F.lit("")))
    return j.select("path", text.alias("text"))


def js_number_text(v: Column) -> Column:
    """``String(Number(v))`` for the numeric YAML values: hex/octal/binary
    literals converted, integral values without a fraction, others as doubles."""
    t = F.lower(v)
    as_int = (F.when(t.startswith("0x"), F.conv(F.substring(t, 3, 64), 16, 10))
              .when(t.startswith("0o"), F.conv(F.substring(t, 3, 64), 8, 10))
              .when(t.startswith("0b"), F.conv(F.substring(t, 3, 64), 2, 10)))
    d = v.try_cast("double")
    integral = (d == F.floor(d)) & (F.abs(d) < 1e15)
    return (F.when(as_int.isNotNull(), as_int)
            .when(v.rlike(r"^[+-]?Infinity$"), F.regexp_replace(v, r"^\+", ""))
            .when(integral, d.cast("long").cast("string"))
            .otherwise(d.cast("string")))


def render_yaml_summary(keys: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(path, text): the configuration structure block for line-wise configs from
    ``yaml_flat_keys`` + ``order_keys`` rows (redacted keys, quoted strings cut
    at 100, numbers in JavaScript form)."""
    from quire.operators.configs import REDACTED, STRING_WIDTH, is_sensitive
    v = F.col("value")
    shown = (F.when(is_sensitive(F.col("key"), config), F.lit(REDACTED))
             .when(F.col("kind") == "number", js_number_text(v))
             .when(F.col("kind") == "boolean", v)
             .when(F.length(v) > STRING_WIDTH, F.concat(F.lit('"'), F.substring(v, 1, STRING_WIDTH), F.lit('..."')))
             .otherwise(F.concat(F.lit('"'), v, F.lit('"'))))
    lines = keys.select("path", "ord", F.concat(F.col("key"), F.lit(": "), shown).alias("l"))
    g = lines.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "l"))),
                                                           lambda s: s["l"]), "\n").alias("body"))
    return g.select("path", F.concat(F.lit("// File: "), F.col("path"), F.lit(f" ({WARNING_EMOJI} Config structure)\n\n"),
                                     F.lit(f"{SEP}\n// CONFIGURATION STRUCTURE\n{SEP}\n\n"), F.col("body"),
                                     F.lit("\n")).alias("text"))


def render_code_summary(files: DataFrame) -> DataFrame:
    """(path, text): the code overview block (types, functions, imports by
    language pattern) for ``files(path, rel_path, size, language, content)``."""
    from quire.functions.text import explode_lines
    from quire.operators import code as CO
    lines = explode_lines(files.select("path", "language", "content"), "content")
    n = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"))
    st = CO.code_structure(lines.withColumn("language", F.coalesce("language", F.lit("text"))))
    sec = st.groupBy("path", "kind").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: F.concat(F.lit("// "), s["text"])), "\n").alias("l"))
    piv = sec.groupBy("path").pivot("kind", ["type", "function", "import"]).agg(F.first("l"))
    j = files.select("path", "rel_path", "size", "language").join(n, "path").join(piv, "path", "left")

    def block(title, col, empty):
        return F.concat(F.lit(f"{SEP}\n// {title}\n{SEP}\n"),
                        F.coalesce(F.concat(F.col(col), F.lit("\n")), F.lit(f"// {empty}\n")))
    text = F.concat(
        F.lit("// File: "), F.col("rel_path"), F.lit(f" ({WARNING_EMOJI} Overview — "), format_size(F.col("size")),
        F.lit(", structure outline)\n// Language: "), F.coalesce(F.col("language"), F.lit("text")),
        F.lit("\n// Total lines: "), F.col("n_lines").cast("string"), F.lit("\n\n"),
        block("TYPES/INTERFACES", "type", "(no type definitions detected)"), F.lit("\n"),
        block("FUNCTIONS/METHODS", "function", "(no functions detected)"), F.lit("\n"),
        block("IMPORTS/DEPENDENCIES", "import", "(no imports detected)"))
    return j.select("path", text.alias("text"))


def render_word_summary(docs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(doc_id, text): the word-document block from ``docs(doc_id, name, size,
    text)``: every paragraph (heading prefix, 500-char preview) for files within
    the size threshold; above it the heading outline, a summary of
    ``min(2 * preview, length)`` characters and five key points."""
    from quire.operators import docs as D
    from quire.operators import summarize as S
    cfg = config.clamped()
    big = (F.col("size") > cfg.max_file_size) & F.lit(cfg.enable_large_file_degradation)
    clean = S.clean_text(F.col("text"))
    # what is joined has the length of the text, not the text; large documents are cleaned once
    d = docs.select("doc_id", "name", "size", F.length(clean).alias("chars"), big.alias("big"))
    bigdocs = written(docs.where(big).select("doc_id", clean.alias("text")))
    paras = D.paragraph_headings(docs.select("doc_id", "text"))
    prev = F.when(F.length("text") > 500, F.concat(F.substring("text", 1, 500), F.lit("..."))).otherwise(F.col("text"))
    pl = paras.select("doc_id", "para_no", "is_heading", F.concat(
        F.lit("// "), F.when(F.col("is_heading"), F.concat(F.expr("repeat('#', level)"), F.lit(" "))).otherwise(F.lit("")),
        prev).alias("l"))
    full = pl.groupBy("doc_id").agg(F.count(F.lit(1)).alias("np"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("para_no", "l"))), lambda s: s["l"]), "\n").alias("body"))
    outline = paras.where("is_heading").select("doc_id", "para_no", F.concat(
        F.lit("// "), F.expr("repeat('  ', level - 1)"), F.col("text")).alias("l")) \
        .groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_no", "l"))),
                                                        lambda s: s["l"]), "\n").alias("outline"))
    summ = S.summary_select(bigdocs, max_length=2 * cfg.text_preview_length, min_sentences=3)
    keys = S.key_sentences(bigdocs, k=5, min_length=20).select(
        "doc_id", "rank", F.when(F.length("text") > 100, F.concat(F.substring("text", 1, 100), F.lit("...")))
        .otherwise(F.col("text")).alias("t"))
    kp = keys.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))),
                                                             lambda s: F.concat(F.lit("// "), s["t"])), "\n").alias("kp"))
    j = (d.join(full, "doc_id", "left").join(outline, "doc_id", "left")
         .join(summ, "doc_id", "left").join(kp, "doc_id", "left"))
    head = F.concat(F.lit("// File: "), F.col("name"), F.lit(f" ({WARNING_EMOJI} Word document structure)\n// Total text: ~"),
                    F.col("chars").cast("string"), F.lit(" chars\n"),
                    F.when(F.col("big"), F.lit(f"// Compressed: Yes (exceeds {cfg.max_file_size} bytes threshold)\n"))
                    .otherwise(F.lit("// Compressed: No\n")),
                    F.lit(f"\n{SEP}\n// DOCUMENT STRUCTURE\n{SEP}\n\n"))
    small_body = F.concat(F.lit(f"{SEP}\n// PARAGRAPH CONTENT\n{SEP}\n// Total paragraphs: "),
                          F.coalesce(F.col("np"), F.lit(0)).cast("string"), F.lit("\n\n"),
                          F.coalesce(F.concat(F.col("body"), F.lit("\n")), F.lit("")))
    big_body = F.concat(F.lit(f"{SEP}\n// DOCUMENT OUTLINE\n{SEP}\n"),
                        F.coalesce(F.concat(F.col("outline"), F.lit("\n")), F.lit("// (no clear headings detected)\n")),
                        F.lit(f"\n{SEP}\n// KEY CONTENT SUMMARY\n{SEP}\n// [Document Summary]\n// "),
                        F.replace(F.coalesce(F.col("summary"), F.lit("")), F.lit("\n"), F.lit("\n// ")),
                        F.lit(f"\n\n{SEP}\n// KEY POINTS\n{SEP}\n"),
                        F.coalesce(F.concat(F.col("kp"), F.lit("\n")), F.lit("")))
    return j.select("doc_id", F.concat(head, F.when(F.col("big"), big_body).otherwise(small_body)).alias("text"))


def render_pdf_summary(docs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(doc_id, text): the PDF block from ``docs(doc_id, name, size, text,
    n_pages)``: page previews (500 chars) within the size threshold; above it a
    50-char page outline, a summary and five key points with estimated pages."""
    from quire.operators import docs as D
    from quire.operators import summarize as S
    cfg = config.clamped()
    big = (F.col("size") > cfg.max_file_size) & F.lit(cfg.enable_large_file_degradation)
    clean = S.clean_text(F.col("text"))
    # as in the word block: lengths are joined, large documents are cleaned once
    d = docs.select("doc_id", "name", "size", "n_pages", F.length(clean).alias("chars"), big.alias("big"))
    bigdocs = written(docs.where(big).select("doc_id", clean.alias("text")))

    def pages(width, fmt):
        p = D.page_chunks(docs.select("doc_id", "text", "n_pages"), width=width)
        return p.groupBy("doc_id").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("page_no", "preview"))), fmt), "").alias("pages"))
    full = pages(500, lambda s: F.concat(F.lit("\n// [Page "), s["page_no"].cast("string"), F.lit("]\n// "),
                                         s["preview"], F.lit("\n"))).withColumnRenamed("pages", "full")
    outl = pages(50, lambda s: F.concat(F.lit("// [Page "), s["page_no"].cast("string"), F.lit("] "),
                                        s["preview"], F.lit("\n"))).withColumnRenamed("pages", "outl")
    summ = S.summary_select(bigdocs, max_length=2 * cfg.text_preview_length, min_sentences=3)
    keys = written(S.key_sentences(bigdocs, k=5, min_length=20))  # read twice
    kp = S.key_point_pages(keys, docs.select("doc_id", "n_pages")).join(keys.select("doc_id", "rank", "text"),
                                                                        ["doc_id", "rank"])
    kp = kp.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "page", "text"))),
                                                           lambda s: F.concat(F.lit("// [~Page "), s["page"].cast("string"),
                                                                              F.lit("] "), D.preview(s["text"], 100),
                                                                              F.lit("\n"))), "").alias("kp"))
    j = d.join(full, "doc_id", "left").join(outl, "doc_id", "left").join(summ, "doc_id", "left").join(kp, "doc_id", "left")
    head = F.concat(F.lit("// File: "), F.col("name"), F.lit(f" ({WARNING_EMOJI} PDF structure)\n// Pages: "),
                    F.col("n_pages").cast("string"), F.lit(" | Total text: ~"), F.col("chars").cast("string"),
                    F.lit(" chars\n"),
                    F.when(F.col("big"), F.lit(f"// Compressed: Yes (exceeds {cfg.max_file_size} bytes threshold)\n"))
                    .otherwise(F.lit("// Compressed: No\n")),
                    F.lit(f"\n{SEP}\n// PDF STRUCTURE\n{SEP}\n\n"))
    small_body = F.concat(F.lit(f"{SEP}\n// PAGE CONTENT\n{SEP}\n"), F.coalesce(F.col("full"), F.lit("")))
    big_body = F.concat(F.lit(f"{SEP}\n// PAGE OUTLINE\n{SEP}\n"), F.coalesce(F.col("outl"), F.lit("")),
                        F.lit(f"\n{SEP}\n// KEY CONTENT SUMMARY\n{SEP}\n// [Document Summary]\n// "),
                        F.replace(F.coalesce(F.col("summary"), F.lit("")), F.lit("\n"), F.lit("\n// ")),
                        F.lit(f"\n\n{SEP}\n// KEY POINTS\n{SEP}\n"), F.coalesce(F.col("kp"), F.lit("")))
    return j.select("doc_id", F.concat(head, F.when(F.col("big"), big_body).otherwise(small_body)).alias("text"))


def render_json_summary(files: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(path, text): the configuration structure block of ``files(path, content)`` that
    parse as JSON: nested values indented below their key, the first three items of
    an array and how many more there are.  A key that follows a nested value starts
    behind the spaces that the value's last, empty line leaves, as in the reference.
    Text that does not parse gives the redacted preview."""
    from quire.operators import configs as K
    rows = K.json_rows(files, config)
    more = 1 << 30
    nested = F.col("kind").isin("object", "array")
    label = F.when(F.col("key").isNotNull(), F.concat("key", F.lit(":"))).otherwise(
        F.concat(F.lit("["), (F.col("ord") - 1).cast("string"), F.lit("]:")))
    item = F.col("key").isNull() & (F.col("depth") > 0)
    value = F.when(item & (F.col("kind") == "object"), "[object Object]").when(item & (F.col("kind") == "array"), F.col("joined")).when(F.col("depth") == 0, F.when(F.col("kind") == "null", "(null)").otherwise(F.col("text"))) \
        .otherwise(F.col("text"))
    own = F.when(F.col("depth") == 0, F.when(F.col("kind") == "object", F.lit("{}")).otherwise(value)).when(nested & ~item, label) \
        .otherwise(F.concat(label, F.lit(" "), value))
    line = rows.select("path", "seq", F.greatest("depth", F.lit(1)).alias("d"), own.alias("l"))
    below = rows.where(nested & F.col("key").isNotNull() & ((F.col("kind") == "array") | (F.col("n") == 0)))
    line = line.unionByName(below.select("path", F.concat("seq", F.array(F.lit(0))).alias("seq"), (F.col("depth") + 1).alias("d"),
                                         F.when(F.col("n") == 0, F.when(F.col("kind") == "array", "[]").otherwise("{}")).otherwise(F.col("text")).alias("l")))
    rest = rows.where((F.col("kind") == "array") & ~item & (F.col("n") > K.ARRAY_ITEMS))
    line = line.unionByName(rest.select("path", F.concat("seq", F.array(F.lit(more))).alias("seq"), (F.col("depth") + 1).alias("d"),
                                        F.concat(F.lit("... ("), (F.col("n") - K.ARRAY_ITEMS).cast("string"), F.lit(" more items)")).alias("l")))
    before = F.lag("d").over(Window.partitionBy("path").orderBy("seq"))
    line = line.withColumn("pad", 2 * (F.col("d") - 1) + 2 * F.greatest(F.lit(0), F.coalesce(before, F.lit(0)) - F.col("d")))
    body = line.groupBy("path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "pad", "l"))), lambda s: F.concat(F.repeat(F.lit(" "), s["pad"]), s["l"])), "\n").alias("body"),
        F.max_by("d", "seq").alias("last"))
    good = body.select("path", F.concat(F.lit(_sep_block("CONFIGURATION STRUCTURE") + "\n"), "body", F.lit("\n"), F.repeat(F.lit(" "), 2 * (F.col("last") - 1))).alias("text"))
    bad = K.json_parse_fallback(files, config).groupBy("path").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), "\n").alias("t"))
    bad = bad.select("path", F.concat(F.lit("// Parse error: invalid JSON\n// Showing preview:\n\n"), "t").alias("text"))
    return good.unionByName(bad).select("path", F.concat(F.lit("// File: "), F.col("path"), F.lit(f" ({WARNING_EMOJI} Config structure)\n\n"), F.col("text")).alias("text"))


# --- fixed values: titles of the outline's sections and their "more" words ---
OUTLINE_TITLES = {"type": ("TYPES", "types"), "function": ("FUNCTIONS", "functions"), "import": ("IMPORTS/DEPENDENCIES", "imports")}
# -----------------------------------------------------------------------------


def render_outline(lines: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(path, text): the outline of ``lines(path, language, line_no, text)``: types,
    functions and imports by language pattern without private ones, each with the
    comment above it (types and functions), the first ``outline_max_items`` of each
    and how many more there are."""
    from quire.operators import code as CO
    # the language patterns are long: planned once, not with everything that reads the symbols
    shown, totals = CO.outline_caps(written(CO.outline_private_filter(CO.outline_symbols(lines), config)), config)
    text = F.concat(F.lit("// "), F.col("text"))
    if config.outline_extract_comments:
        docs = written(CO.leading_docs(lines, shown).select("path", "line_no", F.col("doc").alias("_doc")))
        shown = shown.join(docs, ["path", "line_no"], "left")
        text = F.concat(text, F.when((F.col("kind") != "import") & (F.coalesce(F.length("_doc"), F.lit(0)) > 0),
                                     F.concat(F.lit(" [doc: "), F.col("_doc"), F.lit("]"))).otherwise(F.lit("")))
    listed = shown.groupBy("path", "kind").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", text.alias("t")))), lambda s: s["t"]), "\n").alias("body"))
    listed = listed.join(totals.select("path", "kind", "more"), ["path", "kind"])
    section = None
    for kind, (title, noun) in OUTLINE_TITLES.items():
        whole = F.concat(F.lit(_sep_block(title)), F.col("body"), F.when(F.col("more") > 0, F.concat(
            F.lit("\n// ... ("), F.col("more").cast("string"), F.lit(f" more {noun})"))).otherwise(F.lit("")))
        section = F.when(F.col("kind") == kind, whole) if section is None else section.when(F.col("kind") == kind, whole)
    piv = listed.select("path", "kind", section.alias("s")).groupBy("path").pivot("kind", list(OUTLINE_TITLES)).agg(F.first("s"))
    parts = F.concat(*(F.when(F.col(k).isNotNull(), F.array(F.col(k), F.lit("")) if k != "import" else F.array(F.col(k))).otherwise(F.array().cast("array<string>"))
                       for k in OUTLINE_TITLES))
    return piv.select("path", F.array_join(parts, "\n").alias("text"))


def render_workbook_summary(sheet_cells: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(path, text): the workbook block of ``sheet_cells(path, sheet, row_no, ord, value)``: for each
    sheet (by name) its size, and each column's type with up to two non-blank examples."""
    from quire.operators import tabular as TB
    n = config.clamped().csv_sample_rows
    prof = TB.workbook_profile(sheet_cells)
    ex = F.slice(F.filter("samples", lambda v: v != ""), 1, TB.SAMPLES_SHOWN)
    line = F.concat(F.lit("// "), "name", F.lit(": "), "inferred_type", F.when(
        F.size(ex) > 0, F.concat(F.lit(' (examples: "'), F.array_join(ex, '", "'), F.lit('")'))).otherwise(F.lit("")), F.lit("\n"))
    sheets = prof.groupBy("path", "sheet").agg(F.max("rows").alias("rows"), F.max("columns").alias("columns"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda s: s["l"]), "").alias("schema"))
    shown = F.least(F.lit(n), F.col("rows")).cast("string")
    rows, columns = F.col("rows").cast("string"), F.col("columns").cast("string")
    data = F.when(F.col("rows") > 0, F.concat(F.lit(f"{SEP}\n// SAMPLE DATA (showing "), shown, F.lit(" of "), rows, F.lit(
        f" rows)\n{SEP}\n// [Row data omitted for brevity - see schema above]\n"))).otherwise(F.lit(""))
    body = F.concat(F.lit(f'{SEP}\n// SHEET: "'), "sheet", F.lit(f'"\n{SEP}\n// Rows: '), rows, F.lit(" | Columns: "), columns, F.lit("\n\n"),
                    F.when(F.col("columns") == 0, F.lit("// (empty sheet)\n\n")).otherwise(F.concat(
                        F.lit(f"{SEP}\n// SCHEMA ("), columns, F.lit(f" columns)\n{SEP}\n"), "schema", F.lit("\n"), data, F.lit("\n"))))
    book = sheets.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("sheet", body.alias("b")))), lambda s: s["b"]), "").alias("all"))
    form = F.upper(F.substring_index("path", ".", -1))
    return book.select("path", F.concat(
        F.lit("// File: "), "path", F.lit(f" ({WARNING_EMOJI} Excel summary)\n// Format: "), form, F.lit(f"\n\n{SEP}\n// WORKBOOK: "), F.col("n").cast("string"),
        F.when(F.col("n") > 1, F.lit(" sheets")).otherwise(F.lit(" sheet")), F.lit(f"\n{SEP}\n\n"), "all").alias("text"))


def render_slide_content(elements: DataFrame) -> DataFrame:
    """(doc_id, text): title and content preview (500 characters) of each slide of a deck, in order."""
    from quire.operators import docs as D
    s = D.slide_assemble(elements)
    clean = s.select("doc_id", "slide_no", "title", F.regexp_replace(js_trim(collapse_ws("content")), D.CONTROL_RE, "").alias("c"))
    shown = clean.select("doc_id", "slide_no", "title", D.shortened(F.col("c"), 500).alias("c"))
    block = F.concat(F.lit("\n// [Slide "), F.col("slide_no").cast("string"), F.lit("] "), "title", F.lit("\n// "), "c", F.lit("\n"))
    g = shown.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slide_no", block.alias("b")))), lambda x: x["b"]), "").alias("all"))
    return g.select("doc_id", F.concat(F.lit(_sep_block("SLIDE CONTENT")), "all").alias("text"))
