"""Call and flow analytics over ordered event tables.

``calls(path, fn, seq, callee)`` and ``steps(path, fn, seq, kind, label)``.
Sequence rewrites (run-length, guard folding, logger merging) are window
operators over ``(path, fn)`` ordered by ``seq``; sets and caps are distinct +
``row_number`` with partial top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import explode_rows, js_trim, number_within

# --- fixed values -------------------------------------------------------------
TRIVIAL_GLOBALS = ("Object", "Array", "String", "Number", "Boolean", "Math", "JSON", "Date", "RegExp", "Error",
                   "Promise", "Map", "Set", "WeakMap", "WeakSet", "Symbol", "BigInt", "parseInt", "parseFloat",
                   "isNaN", "isFinite", "encodeURI", "decodeURI", "encodeURIComponent", "decodeURIComponent")
GROUP_PREFIXES = ("Logger.", "vscode.window.", "vscode.workspace.fs.", "vscode.workspace.", "vscode.commands.",
                  "vscode.env.clipboard.")
DEPENDENCY_LIMIT = 28
SIDE_EFFECT_LIMIT = 15
CONTROL_SAMPLES = 4
LABEL_WIDTH = 82
BRANCH_KINDS = ("if", "switch", "try")
LOOP_KINDS = ("for", "while", "do")
FILLER, FILLER_RUN = "~ misc", 3
WEAK_LINES = ("# decl", "~ misc", "= expr")
CALL_RE = r"([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\("
KEYWORDS = ("if", "for", "while", "switch", "catch", "return", "function", "typeof", "new")
# -----------------------------------------------------------------------------


def is_trivial(name: Column) -> Column:
    return F.element_at(F.split(name, r"\.", -1), 1).isin(*TRIVIAL_GLOBALS)


def is_side_effect(name: Column) -> Column:
    lo = F.lower(name)
    return (lo.contains("logger") | lo.contains("writefile") | lo.contains("clipboard")
            | lo.contains("showinformationmessage") | lo.contains("showwarningmessage")
            | lo.contains("showerrormessage") | lo.contains("vscode.") | lo.startswith("fs.")
            | name.contains("executeCommand"))


def call_sites(code_lines: DataFrame) -> DataFrame:
    """(path, line_no, ord, callee): call names in line order, keywords and
    trivial globals removed."""
    names = F.regexp_extract_all(F.col("text"), F.lit(CALL_RE), 1)
    e = explode_rows(code_lines.select("path", "line_no", "text"), names, ["path", "line_no"], "ord", "callee")
    return e.where(~F.col("callee").isin(*KEYWORDS) & ~is_trivial(F.col("callee")))


def _prefix(name: Column) -> Column:
    expr = None
    for p in GROUP_PREFIXES:
        expr = F.when(name.startswith(p), F.lit(p)) if expr is None else expr.when(name.startswith(p), F.lit(p))
    return expr


def dependencies(calls: DataFrame, limit: int = DEPENDENCY_LIMIT) -> DataFrame:
    """(path, fn, rank, dep): distinct non-trivial callees; members of a listed
    prefix with at least two distinct members collapse to ``prefix*``; sorted
    in locale order; first ``limit``."""
    d = calls.where(~is_trivial(F.col("callee"))).select("path", "fn", "callee").distinct() \
        .withColumn("prefix", _prefix(F.col("callee")))
    n = d.where(F.col("prefix").isNotNull()).groupBy("path", "fn", "prefix").agg(F.count(F.lit(1)).alias("n"))
    dep = (d.join(n, ["path", "fn", "prefix"], "left")
           .select("path", "fn", F.when(F.col("n") >= 2, F.concat("prefix", F.lit("*"))).otherwise(F.col("callee"))
                   .alias("dep")).distinct())
    w = Window.partitionBy("path", "fn").orderBy(F.collate("dep", "UNICODE"), "dep")
    return dep.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit) \
        .select("path", "fn", "rank", "dep")


def side_effects(calls: DataFrame, deps: DataFrame, limit: int = SIDE_EFFECT_LIMIT) -> DataFrame:
    """(path, fn, rank, callee): side-effect callees in first-call order, minus
    ``Logger.debug`` and names the dependency list already shows; first ``limit``."""
    fx = (calls.where(is_side_effect(F.col("callee")) & (F.col("callee") != "Logger.debug") & ~is_trivial(F.col("callee")))
          .groupBy("path", "fn", "callee").agg(F.min("seq").alias("first_seq")))
    fx = fx.join(deps.select("path", "fn", F.col("dep").alias("callee")), ["path", "fn", "callee"], "left_anti")
    w = Window.partitionBy("path", "fn").orderBy("first_seq")
    return fx.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit) \
        .select("path", "fn", "rank", "callee")


def control_counts(steps: DataFrame) -> DataFrame:
    """(path, fn, branches, loops, branch_samples, loop_samples): counts and the
    first four labels of each (cut to 82, joined by ' | ').  Samples are picked
    with ``row_number() <= 4`` (partial top-k), so only four rows per class are
    ever collected."""
    cls = F.when(F.col("kind").isin(*BRANCH_KINDS), "b").when(F.col("kind").isin(*LOOP_KINDS), "l")
    counts = steps.groupBy("path", "fn").agg(
        F.count_if(F.col("kind").isin(*BRANCH_KINDS)).alias("branches"),
        F.count_if(F.col("kind").isin(*LOOP_KINDS)).alias("loops"))
    c = steps.withColumn("cls", cls).where(F.col("cls").isNotNull())
    w = Window.partitionBy("path", "fn", "cls").orderBy("seq")
    first = c.withColumn("k", F.row_number().over(w)).where(F.col("k") <= CONTROL_SAMPLES)
    s = first.groupBy("path", "fn", "cls").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("k", F.substring("label", 1, LABEL_WIDTH).alias("l")))),
        lambda x: x["l"]), " | ").alias("samples"))
    b = s.where(F.col("cls") == "b").select("path", "fn", F.col("samples").alias("branch_samples"))
    lp = s.where(F.col("cls") == "l").select("path", "fn", F.col("samples").alias("loop_samples"))
    return (counts.join(b, ["path", "fn"], "left").join(lp, ["path", "fn"], "left")
            .select("path", "fn", "branches", "loops",
                    F.coalesce("branch_samples", F.lit("")).alias("branch_samples"),
                    F.coalesce("loop_samples", F.lit("")).alias("loop_samples")))


def run_length(calls: DataFrame) -> DataFrame:
    """(path, fn, first_seq, step): consecutive equal callees merged to
    ``name×n`` (gaps and islands: seq rank minus per-callee rank)."""
    # both numberings are range-partitioned, so one very long function is not one task
    r = number_within(calls, ["path", "fn"], "seq", name="r_all")
    isl = number_within(r, ["path", "fn", "callee"], "seq", name="r_one") \
        .withColumn("isl", F.col("r_all") - F.col("r_one"))
    g = isl.groupBy("path", "fn", "callee", "isl").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"))
    return g.select("path", "fn", "first_seq", F.when(F.col("n") > 1, F.concat("callee", F.lit("×"), F.col("n").cast("string")))
                    .otherwise(F.col("callee")).alias("step"))


def collapse_flow(flow: DataFrame) -> DataFrame:
    """(path, fn, seq, line) of ``flow(path, fn, seq, line)`` with runs of filler steps cut short: three or
    more in a row become one line with their number, fewer stay; any other line that
    repeats the line before it goes.  Runs are islands (rank among all lines minus
    rank among equal ones)."""
    r = number_within(flow, ["path", "fn"], "seq", name="r_all")
    r = number_within(r, ["path", "fn", "line"], "seq", name="r_one").withColumn("isl", F.col("r_all") - F.col("r_one"))
    runs = r.groupBy("path", "fn", "line", "isl").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    filler = F.col("line") == FILLER
    one = runs.where(~filler | (F.col("n") >= FILLER_RUN)).select("path", "fn", F.col("first").alias("seq"), F.when(
        filler, F.concat(F.lit("~misc×"), F.col("n").cast("string"), F.lit(" (path/dep)"))).otherwise(F.col("line")).alias("line"))
    short = runs.where(filler & (F.col("n") < FILLER_RUN)).select("path", "fn", "line", "isl")
    return one.unionByName(r.join(short, ["path", "fn", "line", "isl"], "left_semi").select("path", "fn", "seq", "line"))


def is_weak_line(line: Column) -> Column:
    """A flow line that says nothing about the function."""
    return line.isin(*WEAK_LINES) | line.startswith("… seq(") | line.startswith("stmt:Break")


def early_returns(steps: DataFrame) -> DataFrame:
    """(path, fn, seq, step): a condition directly followed by a return becomes
    one guard step; other bare conditions are dropped; functions with at least
    four branches and five steps get a leading summary step (seq 0).

    Neighbours come from a dense per-function rank (range-partitioned) and an
    equi-join on rank ± 1, so one very long function is not one task."""
    r = number_within(steps, ["path", "fn"], "seq", name="r")
    nb = r.select("path", "fn", "r", "kind")
    s = (r.join(nb.select("path", "fn", (F.col("r") - 1).alias("r"), F.col("kind").alias("next_kind")),
                ["path", "fn", "r"], "left")
         .join(nb.select("path", "fn", (F.col("r") + 1).alias("r"), F.col("kind").alias("prev_kind")),
               ["path", "fn", "r"], "left"))
    guard = (F.col("kind") == "if") & F.coalesce(F.col("next_kind") == "return", F.lit(False))
    consumed = (F.col("kind") == "return") & F.coalesce(F.col("prev_kind") == "if", F.lit(False))
    body = s.where(~consumed & ((F.col("kind") != "if") | guard)).select(
        "path", "fn", "seq", F.when(guard, F.concat(F.lit("guard: "), F.col("label"), F.lit(" → return")))
        .otherwise(F.col("label")).alias("step"))
    tot = steps.groupBy("path", "fn").agg(F.count_if(F.col("kind").isin(*BRANCH_KINDS)).alias("b"),
                                          F.count(F.lit(1)).alias("n"))
    head = tot.where((F.col("b") >= 4) & (F.col("n") >= 5)).select(
        "path", "fn", F.lit(0).alias("seq"), F.concat(F.lit("branches: "), F.col("b").cast("string")).alias("step"))
    return body.unionByName(head)


def log_merge(calls: DataFrame) -> DataFrame:
    """(path, fn, first_seq, step): consecutive ``Logger.*`` calls become one
    ``log: m1, m2`` step listing the methods in order (first appearance).
    Runs are islands: rank among all calls minus rank among logger calls
    (both range-partitioned)."""
    c = calls.withColumn("is_log", F.col("callee").startswith("Logger."))
    c = number_within(c, ["path", "fn"], "seq", name="r_all")
    c = number_within(c, ["path", "fn", "is_log"], "seq", name="r_kind")
    c = c.withColumn("isl", F.col("r_all") - F.col("r_kind"))
    # distinct methods per run first (partial aggregation): the list that is
    # collected is bounded by the number of distinct logger methods, not the run
    meth = c.where("is_log").groupBy("path", "fn", "isl", F.substring_index("callee", ".", -1).alias("m")) \
        .agg(F.min("seq").alias("s"))
    logs = meth.groupBy("path", "fn", "isl").agg(
        F.min("s").alias("first_seq"), F.array_sort(F.collect_list(F.struct("s", "m"))).alias("ms"))
    logs = logs.select("path", "fn", "first_seq", F.concat(F.lit("log: "), F.array_join(
        F.transform("ms", lambda x: x["m"]), ", ")).alias("step"))
    other = c.where(~F.col("is_log")).select("path", "fn", F.col("seq").alias("first_seq"), F.col("callee").alias("step"))
    return logs.unionByName(other)


def flow_path(calls: DataFrame, flow: DataFrame | None = None) -> DataFrame:
    """(path, fn, flow): distinct callees in first-call order joined by ' → ',
    loggers dropped unless nothing else remains; only when two or more.  With the
    functions' ``flow(path, fn, seq, line)`` a path is given only where that is weak (fewer
    than two lines that say something) or was cut."""
    if flow is not None:
        told = flow.groupBy("path", "fn").agg(F.count_if(~is_weak_line(F.col("line"))).alias("strong"), F.max(F.col("line").startswith("…(")).alias("cut"))
        calls = calls.join(told.where((F.col("strong") >= 2) & ~F.col("cut")), ["path", "fn"], "left_anti")
    first = calls.where(~is_trivial(F.col("callee"))).groupBy("path", "fn", "callee").agg(F.min("seq").alias("s"))
    g = first.groupBy("path", "fn").agg(F.array_sort(F.collect_list(F.struct("s", "callee"))).alias("tags"))
    names = F.transform("tags", lambda t: t["callee"])
    non_log = F.filter(names, lambda n: ~n.startswith("Logger."))
    chosen = F.when(F.size(non_log) > 0, non_log).otherwise(names)
    return g.where(F.size("tags") >= 2).select("path", "fn", F.array_join(chosen, " → ").alias("flow"))


def dependency_prune(deps: DataFrame, paths: DataFrame, flow: DataFrame) -> DataFrame:
    """Dependencies that neither the function's path nor a line of its flow mentions;
    loggers go where the flow has a log line."""
    text = paths.select("path", "fn", F.col("flow").alias("_text")).unionByName(flow.select("path", "fn", F.col("line").alias("_text")))
    logged = F.col("_text").startswith("log:") & F.col("dep").startswith("Logger.")
    same = (F.col("d.path") == F.col("t.path")) & (F.col("d.fn") == F.col("t.fn"))
    return deps.alias("d").join(text.alias("t"), same & (F.col("_text").contains(F.col("dep")) | logged), "left_anti")


def outline_quality(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, lines, functions, types, imports, chars, est_tokens, source_chars,
    ratio) with a total row (path null): outline size against the source."""
    o = symbols.groupBy("path").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("kind") == "function").alias("functions"),
        F.count_if(F.col("kind") == "type").alias("types"), F.count_if(F.col("kind") == "import").alias("imports"),
        F.sum(F.length("text") + 4).alias("chars"))
    s = sources.groupBy("path").agg(F.sum(F.length("text") + 1).alias("source_chars"))
    j = o.join(s, "path")
    r = j.rollup("path").agg(*[F.sum(c).alias(c) for c in ("lines", "functions", "types", "imports", "chars", "source_chars")])
    return r.select("*", F.ceil(F.col("chars") / F.lit(3.5)).cast("long").alias("est_tokens"),
                    F.round(F.col("chars") / F.col("source_chars"), 6).alias("ratio"))


def outline_metrics(lines: DataFrame) -> DataFrame:
    """(path, line_count, fn_count, max_dep_len, has_path, path_count, flow_header_count,
    logger_flow_count, dep_overlap, bare_ctl_count, est_tokens) of outlines ``lines(path, line_no,
    text)``.  A dependency overlaps when a flow or path line mentions it."""
    t = F.col("text")
    told = t.startswith("path:") | js_trim(t).startswith("->") | js_trim(t).startswith("flow:") | js_trim(t).startswith("path:")
    base = lines.groupBy("path").agg(
        F.count(F.lit(1)).alias("line_count"), F.count_if(t.startswith("fn ")).alias("fn_count"),
        F.coalesce(F.max(F.when(t.startswith("dep:"), F.length(t))), F.lit(0)).alias("max_dep_len"),
        F.count_if(t.startswith("path:")).alias("path_count"), F.count_if(t.startswith("flow:")).alias("flow_header_count"),
        F.sum(F.size(F.regexp_extract_all(t, F.lit(r"(-> Logger\.|log:)"), 1))).alias("logger_flow_count"),
        F.count_if(t.rlike(r"^ctl:\s+\d+br\s+\d+lp\s*$")).alias("bare_ctl_count"), (F.sum(F.length(t) + 1) - 1).alias("chars"))
    deps = explode_rows(lines.where(t.startswith("dep:")), F.split(F.regexp_replace("text", r"^dep:\s*", ""), r",\s*", -1), ["path", "line_no"], "k", "dep")
    deps = deps.where(F.col("dep") != "")
    shown = lines.where(told).select("path", F.col("text").alias("_told"))
    hit = (deps.alias("d").join(shown.alias("s"), (F.col("d.path") == F.col("s.path")) & F.col("_told").contains(F.col("dep")), "left_semi")
           .groupBy("path").agg(F.count(F.lit(1)).alias("dep_overlap")))
    return base.join(hit, "path", "left").select(
        "path", "line_count", "fn_count", "max_dep_len", (F.col("path_count") > 0).alias("has_path"), "path_count", "flow_header_count", "logger_flow_count",
        F.coalesce("dep_overlap", F.lit(0)).alias("dep_overlap"), "bare_ctl_count", F.ceil(F.col("chars") / F.lit(3.5)).cast("long").alias("est_tokens"))
