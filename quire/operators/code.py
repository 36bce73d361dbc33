"""Code profile and regex outlines over ``code_lines(path, language, line_no, text)``.

Every per-language pattern set is folded into one ``CASE language`` expression
of literal regexes (each pattern compiles once per task), so matching stays a
projection; per-kind caps are ``row_number <= cap`` windows (partial
``WindowGroupLimit`` before the shuffle) and totals are grouped counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.config import DEFAULT, Config
from quire.session import cut_lineage
from quire.functions.text import js_trim, number_within

# --- fixed values: per-language line patterns ----------------------------------
# Each entry is (pattern, excluded_prefix): a line matches when it matches the
# pattern and does not match the excluded prefix (a negative look-ahead in the
# original spelling, split so the same text runs on RE2).
_NOT_KEYWORD = r"^(?:if|for|while|switch|catch|return)\b"
LANG_PATTERNS = {
    "typescript": {
        "type": [(r"^(?:export\s+)?(?:interface|type|class|enum)\s+\w+", None)],
        "function": [
            (r"^(?:export\s+)?(?:async\s+)?function\s+\w+", None),
            (r"^(?:export\s+)?(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?(?:\([^)]*\)|\w+)\s*=>", None),
            (r"^(?:(?:public|private|protected|static|async|override|readonly)\s+)*(?:get\s+|set\s+)?[A-Za-z_$][\w$]*\s*\([^)]*\)\s*(?::[^{]+)?\s*\{", _NOT_KEYWORD),
        ],
        "import": [(r"""^import\s+.*from\s+['"`].+['"`]""", None), (r"""^require\s*\(['"`].+['"`]\)""", None)],
    },
    "javascript": {
        "type": [(r"^(?:export\s+)?(?:class|interface)\s+\w+", None)],
        "function": [
            (r"^(?:export\s+)?(?:async\s+)?function\s+\w+", None),
            (r"^(?:export\s+)?(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?(?:\([^)]*\)|\w+)\s*=>", None),
            (r"^(?:(?:static|async)\s+)*(?:get\s+|set\s+)?[A-Za-z_$][\w$]*\s*\([^)]*\)\s*(?::[^{]+)?\s*\{", _NOT_KEYWORD),
        ],
        "import": [(r"""^import\s+.*from\s+['"`].+['"`]""", None), (r"""^require\s*\(['"`].+['"`]\)""", None)],
    },
    "python": {
        "type": [(r"^class\s+\w+", None)],
        "function": [(r"^(?:async\s+)?def\s+\w+\s*\(", None)],
        "import": [(r"^import\s+\w+", None), (r"^from\s+.+\s+import", None)],
    },
    "go": {
        "type": [(r"^type\s+\w+\s+(?:struct|interface)", None)],
        "function": [(r"^func\s+\(?\w*\)?\s*\w+", None)],
        "import": [(r"^import\s+\(?\)?", None)],
    },
    "rust": {
        "type": [(r"^(?:pub\s+)?(?:struct|enum|trait)\s+\w+", None)],
        "function": [(r"^(?:pub\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+\w+", None)],
        "import": [(r"^use\s+.+;", None)],
    },
    "java": {
        "type": [(r"^(?:public\s+)?(?:class|interface|enum)\s+\w+", None)],
        "function": [(r"^(?:public\s+)?(?:static\s+)?\w+\s+\w+\s*\([^)]*\)", None)],
        "import": [(r"^import\s+.+;", None)],
    },
    "cpp": {
        "type": [(r"^(?:class|struct)\s+\w+", None)],
        "function": [(r"\w+\s*\([^)]*\)\s*\{", None), (r"^\w+(?:\s*\*)+\s+\w+\s*\([^)]*\)\s*;", None)],
        # the quoted include takes no trailing '>' (a defect in the original list)
        "import": [(r"^#include\s+<.+>", None), (r'^#include\s+".+"', None)],
    },
}
FALLBACK_PATTERNS = {
    "type": [(r"^(?:class|interface|struct|type|enum)\s+\w+", None)],
    "function": [(r"^(?:function|def|func|fn)\s+\w+", None)],
    "import": [(r"^(?:import|use|from)\s+", None)],
}
STRUCTURE_CAPS = {"type": 20, "function": 30, "import": None}
OUTLINE_WIDTH = {"import": 100, "type": 100, "function": 120}
PRIVATE_RE = r"^\s*(def|function|async\s+function|let|const|var)\s+_"
SIGNATURE_FALLBACK = 80
# -----------------------------------------------------------------------------

KINDS = ("type", "function", "import")


def _any(t: Column, pats) -> Column:
    conds = [(t.rlike(p) & ~t.rlike(neg)) if neg else t.rlike(p) for p, neg in pats]
    return reduce(lambda a, b: a | b, conds)


def matches(kind: str, t: Column, language: Column) -> Column:
    """Boolean: trimmed line ``t`` is a ``kind`` line for its language."""
    lang = F.lower(language)
    expr = None
    for name, pats in LANG_PATTERNS.items():
        cond = _any(t, pats[kind])
        expr = F.when(lang == name, cond) if expr is None else expr.when(lang == name, cond)
    return F.coalesce(expr.otherwise(_any(t, FALLBACK_PATTERNS[kind])), F.lit(False))


def code_structure(lines: DataFrame) -> DataFrame:
    """(path, kind, ord, line_no, text): type / function / import lines of code
    files by language pattern, trimmed; types skip ``//`` lines, functions skip
    ``//`` and ``*`` lines; first 20 types, 30 functions, every import."""
    t = lines.select("path", "language", "line_no", js_trim("text").alias("t"))
    rows = []
    for kind in KINDS:
        cond = matches(kind, F.col("t"), F.col("language"))
        if kind == "type":
            cond = cond & ~F.col("t").startswith("//")
        elif kind == "function":
            cond = cond & ~F.col("t").startswith("//") & ~F.col("t").startswith("*")
        rows.append(t.where(cond).select("path", F.lit(kind).alias("kind"), "line_no", "t"))
    out = []
    for kind, df in zip(KINDS, rows):
        cap = STRUCTURE_CAPS[kind]
        if cap is None:
            # every import is listed: range-partitioned numbering
            r = number_within(df, "path", "line_no", name="ord")
        else:
            # first-N: partial WindowGroupLimit before the shuffle
            w = Window.partitionBy("path").orderBy("line_no")
            r = df.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= cap)
        width = OUTLINE_WIDTH["function"] if kind == "function" else OUTLINE_WIDTH["type"]
        text = F.col("t") if kind == "import" else F.substring("t", 1, width)
        out.append(r.select("path", "kind", "ord", "line_no", text.alias("text")))
    return reduce(DataFrame.unionByName, out)


def outline_symbols(lines: DataFrame) -> DataFrame:
    """(path, kind, line_no, text): per non-blank trimmed line, imports are checked
    first; then comment lines and ``#`` lines other than ``#include`` are skipped;
    then the line may be a type and/or a function.  Cut to 100/100/120."""
    t = lines.select("path", "language", "line_no", js_trim("text").alias("t")).where(F.col("t") != "")
    t_ = F.col("t")
    skip = (t_.startswith("//") | t_.startswith("*") | t_.startswith("/*")
            | (t_.startswith("#") & ~t_.startswith("#include")))
    flags = t.select("path", "line_no", "t",
                     matches("import", t_, F.col("language")).alias("is_import"),
                     (~skip & matches("type", t_, F.col("language"))).alias("is_type"),
                     (~skip & matches("function", t_, F.col("language"))).alias("is_function"))
    long = flags.select("path", "line_no", "t", F.expr(
        "stack(3, 'import', is_import, 'type', is_type, 'function', is_function) AS (kind, hit)"))
    return (long.where("hit")
            .select("path", "kind", "line_no",
                    F.expr("substring(t, 1, CASE WHEN kind = 'function' THEN 120 ELSE 100 END)").alias("text")))


def is_private_line(t: Column) -> Column:
    tt = js_trim(t)
    return tt.contains("private ") | tt.startswith("#") | tt.rlike(PRIVATE_RE)


def outline_private_filter(symbols: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Drops private type/function lines unless private members are included."""
    if config.outline_include_private:
        return symbols
    return symbols.where((F.col("kind") == "import") | ~is_private_line(F.col("text")))


def outline_caps(symbols: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(shown rows, per-kind totals): first ``outline_max_items`` of each kind and
    ``(path, kind, total, shown, more)``."""
    cap = config.clamped().outline_max_items
    w = Window.partitionBy("path", "kind").orderBy("line_no")
    shown = symbols.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= cap)
    totals = (symbols.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("total"))
              .withColumn("shown", F.least(F.col("total"), F.lit(cap)))
              .withColumn("more", F.greatest(F.col("total") - cap, F.lit(0))))
    return shown, totals


def signature(line: Column) -> Column:
    """Leading ``//`` removed; text before an opening brace (trimmed), or the
    first 80 characters when the line has a brace that is not trailing."""
    s = F.regexp_replace(line, r"^//\s*", "")
    ok = s.rlike(r"^[^{]*?(?:\s*\{)?$")
    return F.when(ok, js_trim(F.regexp_extract(s, r"^([^{]*?)(?:\s*\{)?$", 1))).otherwise(
        F.substring(s, 1, SIGNATURE_FALLBACK))


DOC_WIDTH = 160


def comment_text(t: Column) -> Column:
    """Cleaned text of a comment line (trimmed input), or null for a non-comment."""
    return (F.when(t.startswith("///"), js_trim(F.regexp_replace(t, r"^///\s?", "")))
            .when(t.startswith("//"), js_trim(F.regexp_replace(t, r"^//\s?", "")))
            .when(t.startswith("#"), js_trim(F.regexp_replace(t, r"^#\s?", "")))
            .when(t.endswith("*/"), js_trim(F.regexp_replace(t, r"\*/$", "")))
            .when(t.startswith("*"), js_trim(F.regexp_replace(t, r"^\*\s?", "")))
            .when(t.startswith("/*"), js_trim(F.regexp_replace(t, r"^/\*+\s?", ""))))


def leading_docs(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, line_no, doc): the comment block directly above each type/function
    line (blank lines allowed only between the block and the symbol), nearest
    comments first until the joined text passes 160 characters, cut to 160.

    Comment blocks are islands (rank among all lines minus rank among comment
    lines); the line above a symbol is found by an equi-join on the rank among
    non-blank lines.  All ranks are range-partitioned, so a huge file is not one
    task, and nothing is a range join."""
    t = lines.select("path", "line_no", js_trim("text").alias("t"))
    t = t.withColumn("c", comment_text(F.col("t")))
    allr = number_within(t, "path", "line_no", name="r_all")
    com = number_within(allr.where(F.col("c").isNotNull()), "path", "line_no", name="r_c") \
        .select("path", "line_no", "c", (F.col("r_all") - F.col("r_c")).alias("isl"))
    nb = number_within(t.where(F.col("t") != ""), "path", "line_no", name="r_nb") \
        .select("path", "line_no", "r_nb")
    sym = symbols.where(F.col("kind") != "import").select("path", F.col("line_no").alias("s")).distinct()
    prev = (sym.join(nb.select("path", F.col("line_no").alias("s"), "r_nb"), ["path", "s"])
            .join(nb.select("path", (F.col("r_nb") + 1).alias("r_nb"), F.col("line_no").alias("p")), ["path", "r_nb"]))
    above = prev.join(com.select("path", F.col("line_no").alias("p"), "isl"), ["path", "p"])
    items = (com.where(F.col("c") != "").join(above.select("path", "s", "p", "isl"), ["path", "isl"])
             .where(F.col("line_no") <= F.col("p")))
    w = Window.partitionBy("path", "s").orderBy(F.col("line_no").desc())
    # a comment adds two characters at least, so so many reach the width: cut before the shuffle by the window's own limit
    items = items.withColumn("k", F.row_number().over(w)).where(F.col("k") <= DOC_WIDTH // 2 + 2)
    items = items.withColumn(
        "len_before", F.sum(F.length("c") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)) - 1)
    kept = items.where((F.col("k") == 1) | (F.col("len_before") <= DOC_WIDTH))
    return kept.groupBy("path", "s").agg(
        F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "c"))), lambda x: x["c"]), " "),
                    1, DOC_WIDTH).alias("doc")).withColumnRenamed("s", "line_no")


def following_docstrings(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, line_no, doc): a triple-quoted string starting on the first
    non-blank line after a type/function line, up to its closing quote (also past
    lines that look like symbols), trimmed parts joined by spaces, cut to 160.
    The line after a symbol and the lines of a string are found by equi-joins on
    the rank among the file's non-blank lines, the closing line by its rank among
    the lines that end with the quote."""
    t = lines.select("path", "line_no", js_trim("text").alias("t"))
    full = number_within(t.where(F.col("t") != ""), "path", "line_no", name="r_nb").select("path", "line_no", "t", "r_nb")
    sym = symbols.where(F.col("kind") != "import").select("path", F.col("line_no").alias("owner")).distinct()
    own = sym.join(full.select("path", F.col("line_no").alias("owner"), (F.col("r_nb") + 1).alias("r_nb")), ["path", "owner"])
    opener = own.join(full.select("path", "r_nb", F.col("line_no").alias("q"), F.col("t").alias("qt")), ["path", "r_nb"]).withColumnRenamed("r_nb", "r_q")
    quote = F.when(F.col("qt").startswith('"""'), F.lit('"""')).when(F.col("qt").startswith("'''"), F.lit("'''"))
    opener = opener.withColumn("quote", quote).where(F.col("quote").isNotNull())
    opener = opener.withColumn("rest", F.expr("substring(qt, 4)"))
    opener = opener.withColumn("same", F.col("rest").endswith(F.col("quote")))
    # the closing line is the first later line that ends with the quote, whatever lies between: its
    # rank among such lines is one more than the number of them up to the opening line
    open_ = opener.where(~F.col("same")).select("path", "owner", "q", "r_q", "quote")
    ends = reduce(DataFrame.unionByName, [t.where(F.col("t").endswith(q)).select("path", F.lit(q).alias("quote"), "line_no") for q in ('"""', "'''")])
    ends = number_within(ends, ["path", "quote"], "line_no", name="k")
    marks = (ends.select("path", "quote", (F.col("line_no") * 2).alias("at"), F.lit(0).alias("is_open"), *(F.lit(None).cast("int").alias(c) for c in ("owner", "q", "r_q")))
             .unionByName(open_.select("path", "quote", (F.col("q") * 2 + 1).alias("at"), F.lit(1).alias("is_open"), *(F.col(c).cast("int") for c in ("owner", "q", "r_q")))))
    marks = number_within(marks, ["path", "quote"], "at", name="r_all")
    opens = number_within(marks.where("is_open = 1"), ["path", "quote"], "at", name="r_open").withColumn("k", F.col("r_all") - F.col("r_open") + 1)
    close = opens.join(ends.select("path", "quote", "k", F.col("line_no").alias("close")), ["path", "quote", "k"], "left")
    # a part adds two characters at least, so 160 non-blank lines are enough
    inside = close.select("path", "owner", "close", F.explode(F.sequence(F.col("r_q") + 1, F.col("r_q") + DOC_WIDTH)).alias("r_nb")).join(full, ["path", "r_nb"])
    parts_mid = (inside.where(F.col("close").isNull() | (F.col("line_no") <= F.col("close")))
                 .select("path", "owner", "line_no",
                         F.when(F.col("line_no") == F.col("close"),
                                js_trim(F.expr("substring(t, 1, length(t) - 3)"))).otherwise(F.col("t")).alias("p")))
    first = opener.select("path", "owner", F.col("q").alias("line_no"),
                          js_trim(F.when(F.col("same"), F.expr("substring(rest, 1, length(rest) - 3)"))
                                  .otherwise(F.col("rest"))).alias("p"))
    parts = first.unionByName(parts_mid).where(F.col("p") != "")
    return parts.groupBy("path", "owner").agg(
        F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "p"))), lambda x: x["p"]), " "),
                    1, DOC_WIDTH).alias("doc")).withColumnRenamed("owner", "line_no")


TYPE_KINDS = ("class", "interface", "struct", "enum")
FUNCTION_KINDS = ("function", "method", "constructor")
NAMESPACE_KINDS = ("namespace", "module")
VALID_HEADER_RE = r"(?m)^//\s+(TYPES|FUNCTIONS|IMPORTS|DEPENDENCIES)"
VALID_COMPACT_RE = r"(?m)──\s*semantic|·\s*v1\.[0-9]|^\s*fn\s"


def symbol_class(kind: Column) -> Column:
    k = F.lower(kind)
    return (F.when(k.isin(*TYPE_KINDS), "type").when(k.isin(*FUNCTION_KINDS), "function")
            .when(k.isin(*NAMESPACE_KINDS), "namespace"))


def outline_from_symbols(symbols: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(path, class, ord, name, line_no, members, nested) for top-level symbols
    of ``symbols(path, id, parent_id, kind, name, line_no)``: grouped by kind
    class, private types/functions dropped together with everything below a
    private node, first ``outline_max_items`` per class, visible direct
    children and visible descendants counted.  Nesting is walked level by level
    at any depth: each level is one equi-join with the symbols, checkpointed, until
    a level is empty."""
    cap = config.clamped().outline_max_items
    priv = (F.col("name").startswith("_") | F.col("name").startswith("#")) & F.lit(not config.outline_include_private)
    s = symbols.select("path", "id", "parent_id", "kind", "name", "line_no")
    roots = s.where(F.col("parent_id").isNull()).withColumn("class", symbol_class(F.col("kind"))) \
        .where(F.col("class").isNotNull())
    level = cut_lineage(roots.select("path", "id", F.col("id").alias("root"), "class",
                                     (priv & (F.col("class") != "namespace")).alias("hidden"), F.lit(0).alias("depth")))
    tree = level
    while not level.isEmpty():
        above = level.select("path", F.col("id").alias("parent_id"), "root", "class", F.col("hidden").alias("above_hidden"), "depth")
        level = cut_lineage(s.join(above, ["path", "parent_id"]).select(
            "path", "id", "root", "class", (F.col("above_hidden") | (priv & (F.col("class") != "namespace"))).alias("hidden"),
            (F.col("depth") + 1).alias("depth")))
        tree = tree.unionByName(level)
    counts = tree.where(~F.col("hidden") & (F.col("depth") > 0)).groupBy("path", "root").agg(
        F.count_if(F.col("depth") == 1).alias("members"), F.count(F.lit(1)).alias("nested"))
    vis = tree.where(~F.col("hidden") & (F.col("depth") == 0)).select("path", F.col("id").alias("root"), "class") \
        .join(s.select("path", F.col("id").alias("root"), "name", "line_no"), ["path", "root"])
    w = Window.partitionBy("path", "class").orderBy("line_no", "root")
    out = vis.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= cap)
    return (out.join(counts, ["path", "root"], "left")
            .select("path", "class", "ord", "name", "line_no",
                    F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("nested", F.lit(0)).alias("nested")))


def is_valid_outline(text: Column) -> Column:
    """A recognised section header or compact marker, and 50+ trimmed characters."""
    t = js_trim(F.coalesce(text, F.lit("")))
    return (text.rlike(VALID_HEADER_RE) | text.rlike(VALID_COMPACT_RE)) & (F.length(t) >= 50)


def outline_choose(candidates: DataFrame) -> DataFrame:
    """(path, source, text): the first valid candidate by ``priority``, else the
    last-resort candidate (highest priority number) of ``candidates(path,
    priority, source, text)``."""
    c = candidates.withColumn("valid", is_valid_outline(F.col("text")))
    best = c.where("valid").groupBy("path").agg(F.min_by(F.struct("source", "text"), "priority").alias("b"))
    last = c.groupBy("path").agg(F.max_by(F.struct("source", "text"), "priority").alias("l"))
    return (last.join(best, "path", "left")
            .select("path", F.coalesce(F.col("b.source"), F.col("l.source")).alias("source"),
                    F.coalesce(F.col("b.text"), F.col("l.text")).alias("text")))


def content_key(path: Column, content: Column, options: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", path, content, options), 256)


def outline_incremental(files: DataFrame, store: DataFrame, options: str) -> DataFrame:
    """Files whose (path, content, options) key is not yet in ``store(key)``:
    only these need outline work; the caller appends their results."""
    k = files.withColumn("key", content_key(F.col("path"), F.col("content"), F.lit(options)))
    return k.join(store.select("key").distinct(), "key", "left_anti")
