"""Corpus scope, classification and routing over ``files(project, path, rel_path, size, content)``.

Dimension lookups (language, media type) are literal ``map`` lookups inside the
projection — no join, no exchange.  Ignore rules are small configuration: they
are compiled once on the driver (size-checked) into one literal ``CASE`` of
regexes, evaluated per path prefix inside the row, so matching never joins
paths against rules.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import DEFAULT, Config
from quire.functions.text import JS_WS, js_trim, rank_within

# --- fixed values -------------------------------------------------------------
LANGUAGES = {  # language id -> (aliases, extensions)
    "javascript": (["js", "javascript"], [".js", ".jsx", ".mjs", ".cjs"]),
    "typescript": (["ts", "typescript"], [".ts", ".tsx"]),
    "python": (["py", "python"], [".py", ".pyw", ".pyi"]),
    "go": (["go", "golang"], [".go"]),
    "rust": (["rs", "rust"], [".rs"]),
    "java": (["java"], [".java"]),
    "c": (["c"], [".c", ".h"]),
    "cpp": (["cpp", "c++", "cxx"], [".cpp", ".hpp", ".cc", ".hh", ".cxx", ".hxx"]),
    "csharp": (["cs", "csharp"], [".cs"]),
    "php": (["php"], [".php", ".phtml"]),
    "ruby": (["rb", "ruby"], [".rb"]),
    "swift": (["swift"], [".swift"]),
    "kotlin": (["kt", "kotlin"], [".kt", ".kts"]),
    "scala": (["scala"], [".scala"]),
    "html": (["html"], [".html", ".htm"]),
    "css": (["css"], [".css"]),
    "scss": (["scss", "sass"], [".scss", ".sass"]),
    "json": (["json"], [".json", ".jsonc"]),
    "yaml": (["yaml", "yml"], [".yaml", ".yml"]),
    "xml": (["xml"], [".xml"]),
    "markdown": (["md", "markdown"], [".md", ".markdown"]),
    "shell": (["sh", "bash", "shell"], [".sh", ".bash", ".zsh"]),
    "sql": (["sql"], [".sql"]),
    "dockerfile": (["dockerfile", "docker"], [".dockerfile", "Dockerfile"]),
}
CODE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java", ".kt", ".scala",
                   ".c", ".cpp", ".h", ".hpp", ".cs", ".php", ".rb", ".swift", ".sh", ".bash", ".sql")
DOCUMENT_EXTENSIONS = (".pdf", ".docx", ".doc", ".pptx", ".ppt", ".xlsx", ".xls")
MEDIA_TYPES = {
    ".png": ("image", "image/png"), ".jpg": ("image", "image/jpeg"), ".jpeg": ("image", "image/jpeg"),
    ".gif": ("image", "image/gif"), ".webp": ("image", "image/webp"), ".bmp": ("image", "image/bmp"),
    ".ico": ("image", "image/x-icon"), ".svg": ("image", "image/svg+xml"),
    ".mp3": ("audio", "audio/mpeg"), ".wav": ("audio", "audio/wav"), ".ogg": ("audio", "audio/ogg"),
    ".flac": ("audio", "audio/flac"), ".aac": ("audio", "audio/aac"),
    ".mp4": ("video", "video/mp4"), ".avi": ("video", "video/x-msvideo"), ".mov": ("video", "video/quicktime"),
    ".mkv": ("video", "video/x-matroska"), ".webm": ("video", "video/webm"),
    ".zip": ("archive", "application/zip"), ".tar": ("archive", "application/x-tar"),
    ".gz": ("archive", "application/gzip"), ".rar": ("archive", "application/x-rar-compressed"),
    ".7z": ("archive", "application/x-7z-compressed"),
    ".ttf": ("font", "font/ttf"), ".otf": ("font", "font/otf"), ".woff": ("font", "font/woff"),
    ".woff2": ("font", "font/woff2"), ".eot": ("font", "application/vnd.ms-fontobject"),
}
SUMMARY_KINDS = {".log": "log", ".csv": "csv", ".tsv": "csv", ".json": "config", ".yaml": "config",
                 ".yml": "config", ".xml": "config", ".md": "doc", ".txt": "doc", ".pdf": "pdf",
                 ".docx": "word", ".xlsx": "excel", ".xls": "excel", ".pptx": "pptx"}
SYMBOL_LANGUAGES = ("typescript", "typescriptreact", "javascript", "javascriptreact", "python", "go",
                    "rust", "java", "c", "cpp", "csharp")
COMPRESSIBLE_DOCS = (".pdf", ".docx", ".pptx")
LITERAL_RULES = 200  # rules of a list that become one expression; more are joined
# -----------------------------------------------------------------------------


def _lit_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def extname(path: Column) -> Column:
    """Node ``path.extname``: from the last dot of the base name; none for a
    leading-dot name without another dot."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def path_parts(files: DataFrame) -> DataFrame:
    """(path, rel_path, name, ext, dir): separators normalised to ``/``."""
    rel = F.regexp_replace("rel_path", r"\\", "/")
    return files.select("path", rel.alias("rel_path"), basename(rel).alias("name"), extname(rel).alias("ext"),
                        F.regexp_extract(rel, r"^(.*)/[^/]*$", 1).alias("dir"))


def language_of(path: Column) -> Column:
    """Extension (or, with no dot, the base name) -> language id, case-insensitive."""
    m = {}
    for lang, (aliases, exts) in LANGUAGES.items():
        for e in exts:
            m[e.lower()] = lang
        for a in aliases:
            m[a] = lang
    name = basename(path)
    key = F.when(F.instr(path, ".") > 0, F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1))).otherwise(F.lower(name))
    return F.element_at(_lit_map(m), key)


def is_code_file(path: Column) -> Column:
    return F.lower(extname(path)).isin(*CODE_EXTENSIONS)


def _glob_regex(pattern: str) -> str:
    out = []
    for ch in pattern:
        if ch == "*":
            out.append(".*")
        elif ch in ".+?^${}()|[]\\":
            out.append("\\" + ch)
        else:
            out.append(ch)
    return "^" + "".join(out) + "$"


def is_binary(path: Column, rel_path: Column, head: Column | None = None, config: Config = DEFAULT) -> Column:
    """Document formats are never binary; then the configured patterns (exact
    extension, ``*.ext``, exact name or relative path, ``*`` globs on the name
    or the relative path); an extensionless file is binary when its first
    1 KiB holds a NUL byte (``head``: those bytes, binary)."""
    ext = F.lower(extname(path))
    name = F.lower(basename(path))
    rel = F.lower(F.regexp_replace(rel_path, r"\\", "/"))
    exact, globs = set(), []
    for raw in config.binary_file_patterns:
        p = raw.replace("\\", "/").lower()
        if not p:
            continue
        if "*" not in p:
            exact.add(p)
        else:
            globs.append(_glob_regex(p))
    pats = sorted({raw.replace("\\", "/").lower() for raw in config.binary_file_patterns if raw})
    # one membership test and one combined regex per field keep the generated code small
    by_pattern = ext.isin(*pats) | F.concat(F.lit("*"), ext).isin(*pats)
    if exact:
        by_pattern = by_pattern | name.isin(*sorted(exact)) | rel.isin(*sorted(exact))
    if globs:
        rx = "|".join(f"(?:{g})" for g in globs)
        by_pattern = by_pattern | name.rlike(rx) | rel.rlike(rx)
    nul = F.lit(False) if head is None else (
        F.instr(F.decode(F.substring(head, 1, 1024), "ISO-8859-1"), F.lit("\u0000")) > 0)
    return (F.when(ext.isin(*DOCUMENT_EXTENSIONS), False).when(by_pattern, True)
            .when(ext == "", F.coalesce(nul, F.lit(False))).otherwise(False))


def media_type(path: Column) -> tuple[Column, Column, Column]:
    """(type, format, mime) for a binary file by extension; unknown -> ``binary``."""
    ext = F.lower(extname(path))
    t = F.coalesce(F.element_at(_lit_map({k: v[0] for k, v in MEDIA_TYPES.items()}), ext), F.lit("binary"))
    mime = F.element_at(_lit_map({k: v[1] for k, v in MEDIA_TYPES.items()}), ext)
    return t, F.upper(F.substring(ext, 2, 1 << 20)), mime


def classify(files: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds name, ext, language, is_binary, is_truncated, route."""
    cfg = config.clamped()
    f = files.withColumn("ext", F.lower(extname(F.col("path")))) \
        .withColumn("language", language_of(F.col("path"))) \
        .withColumn("is_binary", is_binary(F.col("path"), F.col("rel_path"),
                                           F.encode("content", "UTF-8") if "content" in files.columns else None, cfg)) \
        .withColumn("is_truncated", (F.col("size") > cfg.max_file_size) & F.lit(cfg.enable_large_file_degradation)
                    & ~F.col("is_binary"))
    kind = F.coalesce(F.element_at(_lit_map(SUMMARY_KINDS), F.col("ext")), F.lit("generic"))
    route = (F.when(F.col("is_binary"), "binary")
             .when(F.col("is_truncated") & F.lower(F.coalesce("language", F.lit(""))).isin(*SYMBOL_LANGUAGES), "outline")
             .when(F.col("is_truncated") | F.col("ext").isin(*SUMMARY_KINDS.keys()), F.concat(F.lit("summary:"), kind))
             .otherwise("full"))
    return f.withColumn("route", route)


def route_stats(routed: DataFrame) -> DataFrame:
    """(project, route, files, bytes) with a per-project total row (route null)."""
    return routed.rollup("project", "route").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")) \
        .where(F.col("project").isNotNull())


def doc_compress_flag(files: DataFrame, config: Config = DEFAULT) -> Column:
    cfg = config.clamped()
    return (F.lower(extname(F.col("path"))).isin(*COMPRESSIBLE_DOCS)
            & (F.col("size") > cfg.max_file_size) & F.lit(cfg.enable_large_file_degradation))


# --- scope --------------------------------------------------------------------

def selected_scope(files: DataFrame, selections: DataFrame) -> DataFrame:
    """Files equal to a selected path or under a selected directory; each file
    once.  ``selections(project, sel)`` is joined on project and every ancestor
    prefix of the path, so the match is an equi-join (no range or cross join)."""
    parts = F.split("rel_path", "/", -1)
    pref = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    cand = files.select("project", "rel_path", F.explode(pref).alias("sel"))
    hit = cand.join(selections.select("project", F.regexp_replace("sel", "/+$", "").alias("sel")).distinct(),
                    ["project", "sel"], "left_semi").select("project", "rel_path").distinct()
    return files.join(hit, ["project", "rel_path"], "left_semi")


def common_parent(selections: DataFrame) -> DataFrame:
    """(project, parent): deepest directory shared by all selected paths; one
    path -> its directory; nothing shared -> the root (empty string).
    The common prefix of all part arrays is the common prefix of the smallest
    and the largest of them."""
    parts = F.split(F.regexp_replace("sel", "/+$", ""), "/", -1)
    g = selections.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.min(parts).alias("lo"),
                                          F.max(parts).alias("hi"))
    common = F.aggregate(F.sequence(F.lit(1), F.least(F.size("lo"), F.size("hi"))),
                         F.struct(F.lit(0).alias("k"), F.lit(True).alias("ok")),
                         lambda acc, i: F.struct(
                             F.when(acc["ok"] & (F.element_at("lo", i) == F.element_at("hi", i)), i)
                             .otherwise(acc["k"]).alias("k"),
                             (acc["ok"] & (F.element_at("lo", i) == F.element_at("hi", i))).alias("ok")))["k"]
    single = F.regexp_extract(F.array_join("lo", "/"), r"^(.*)/[^/]*$", 1)
    return g.select("project", F.when(F.col("n") == 1, single)
                    .otherwise(F.array_join(F.slice("lo", 1, common), "/")).alias("parent"))


# --- ignore rules -------------------------------------------------------------

def clean_rules(lines: list[str | None]) -> list[str]:
    """Blank, missing and comment lines dropped, trimmed (gitignore file syntax)."""
    out = []
    for raw in lines:
        t = (raw or "").strip(JS_WS)
        if t and not t.startswith("#"):
            out.append(t)
    return out


def compile_rule(pattern: str) -> tuple[bool, bool, str] | None:
    """gitignore pattern -> (negated, dir_only, regex over the relative path)."""
    p = pattern.strip(JS_WS)
    if not p or p.startswith("#"):
        return None
    neg = p.startswith("!")
    if neg:
        p = p[1:]
    if p.startswith(("\\!", "\\#")):  # an escaped first character is itself
        p = p[1:]
    dir_only = p.endswith("/")
    p = p.rstrip("/")
    if not p:
        return None
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = [], 0
    while i < len(p):
        if p.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out.append("/.*")
            i += 3
        elif p.startswith("**", i):
            out.append(".*")
            i += 2
        elif p[i] == "*":
            out.append("[^/]*")
            i += 1
        elif p[i] == "?":
            out.append("[^/]")
            i += 1
        elif p[i] == "[":
            j = p.find("]", i + 1)
            if j < 0:
                out.append("\\[")
                i += 1
            else:
                body = p[i + 1:j].replace("\\", "\\\\")
                if body.startswith("!"):
                    body = "^" + body[1:]
                out.append("[" + body + "]")
                i = j + 1
        else:
            out.append(re.escape(p[i]) if p[i] in ".+^${}()|\\" else p[i])
            i += 1
    body = "".join(out)
    rx = ("(?i)^" if anchored else "(?i)(?:^|/)") + body + "$"
    return neg, dir_only, rx


def rule_decision(rules: list[tuple[bool, bool, str]], cand: Column, is_dir: Column) -> Column:
    """Last matching rule wins: true = ignored, false = re-included, null = no rule."""
    expr = F.lit(None).cast("boolean")
    for neg, dir_only, rx in rules:   # later rules are applied last, so they win
        m = cand.rlike(rx)
        if dir_only:
            m = m & is_dir
        expr = F.when(m, F.lit(not neg)).otherwise(expr)
    return expr


def ignore_filter(files: DataFrame, rules: list[str] | DataFrame) -> DataFrame:
    """Adds ``ignored``: a path is ignored when one of its ancestor directories
    is ignored or its own last matching rule ignores it.  Rules that are a table
    (ord, pattern), of any size, are joined to the paths (``ignore_rules``); a short list is one expression in the row."""
    if isinstance(rules, DataFrame) or len(rules) > LITERAL_RULES:
        from quire.operators.ignore_rules import ignore_by_table
        if not isinstance(rules, DataFrame):
            rules = files.sparkSession.createDataFrame(list(enumerate(rules)), "ord long, pattern string")
        return ignore_by_table(files, rules)
    compiled = [c for c in (compile_rule(r) for r in rules) if c]
    parts = F.split(F.regexp_replace("rel_path", r"\\", "/"), "/", -1)
    n = F.size(parts)
    prefixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(
        F.array_join(F.slice(parts, 1, k), "/").alias("p"), (k < n).alias("d")))
    ignored = F.exists(prefixes, lambda s: F.coalesce(rule_decision(compiled, s["p"], s["d"]), F.lit(False)))
    return files.withColumn("ignored", ignored)


def rules_of(df: DataFrame) -> list[str]:
    """The patterns of ``rules(layer, ord, pattern)`` in their order, as a list on the driver: for a short configuration; a
    large table goes to ``ignore_filter`` as it is."""
    return [r[0] for r in df.orderBy("layer", "ord").select("pattern").collect()]


def ordered_rules(df: DataFrame) -> DataFrame:
    """(ord, pattern) of ``rules(layer, ord, pattern)``: the layers one after the other."""
    return df.select((F.col("layer").cast("long") * F.lit(1 << 40) + F.col("ord").cast("long")).alias("ord"), "pattern")


def merge_rules(*layers: DataFrame) -> DataFrame:
    """(pattern): blank and comment lines dropped, trimmed, union of the layers,
    de-duplicated, sorted."""
    u = reduce(DataFrame.unionByName, [l.select(js_trim("pattern").alias("pattern")) for l in layers])
    return u.where((F.col("pattern") != "") & ~F.col("pattern").startswith("#")).distinct()


def path_sort(files: DataFrame) -> DataFrame:
    """Adds ``rank``: locale-aware path order (ICU root collation) within the
    project, numbered by range partitions so a huge project is not one task."""
    return rank_within(files, "project", [F.collate("rel_path", "UNICODE"), F.col("rel_path")])
