"""Ignore rules as a table: any number of rules against any number of paths, without comparing each with each.

A rule can only match a path that holds something the rule says literally.  Each rule is filed under one such
handle, the most telling it has:

========= ==================================== ============================================
kind      rule                                 paths it is looked up by
========= ==================================== ============================================
segment   has a whole literal segment          each of their segments
ending    last segment is ``*`` and an ending  what follows the last dot of the name
run       last segment has three literal       each run of three characters of the name
          characters in a row
character last segment has a literal character each character of the name
any       wildcards alone                      all
========= ==================================== ============================================

Paths and the folders above them are joined to rules on (kind, handle); the rule's pattern then decides, and of
all rules that match, the last one.  A path is ignored when it or a folder above it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import js_trim
from quire.operators.corpus import compile_rule

_GLOB = re.compile(r"[*?\[\]\\]")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)  # patterns ignore the case of A to Z

RULES = "ord long, negated boolean, dir_only boolean, regex string, kind string, handle string"


def handle_of(pattern: str) -> tuple[str, str]:
    """The kind and handle of a pattern (without ``!``): every path it matches has it."""
    segments = [s for s in pattern.translate(_FOLD).strip("/").split("/") if s]
    last = segments[-1] if segments else ""
    stars_inside = any("**" in s and s != "**" for s in segments)  # then a segment's border need not be one of the path
    literal = [s for s in segments if not _GLOB.search(s)]
    if literal and not stars_inside and "[" not in pattern and "\\" not in pattern:
        return "segment", max(literal, key=len)
    if stars_inside or last == "**" or "[" in pattern or "\\" in pattern:
        return "any", ""
    if last.startswith("*.") and not _GLOB.search(last[1:]):
        return "ending", last.rsplit(".", 1)[1]
    runs = sorted(_GLOB.split(last), key=len, reverse=True)
    if len(runs[0]) >= 3:
        return "run", runs[0][:3]
    return ("character", runs[0][0]) if runs[0] else ("any", "")


def rule_table(rules: DataFrame) -> DataFrame:
    """(ord, negated, dir_only, regex, kind, handle) of ``rules(ord, pattern)``: lines of ignore files in their order; blank lines and
    comments say nothing.  Of rules with one pattern only the last can decide, so only it stays."""
    def compiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for number, pattern in zip(batch["ord"], batch["pattern"]):
                rule = compile_rule(pattern)
                if rule:
                    plain = pattern.strip()
                    plain = plain[1:] if plain.startswith(("!", "\\!", "\\#")) else plain
                    rows.append((number, *rule, *handle_of(plain)))
            yield pd.DataFrame(rows, columns=["ord", "negated", "dir_only", "regex", "kind", "handle"])

    lines = rules.select(F.col("ord").cast("long").alias("ord"), js_trim("pattern").alias("pattern")).where("pattern != '' AND NOT startswith(pattern, '#')")
    table = lines.mapInPandas(compiled, RULES)
    return table.groupBy("regex", "dir_only", "kind", "handle").agg(F.max("ord").alias("ord"), F.max_by("negated", "ord").alias("negated"))


def _handles(path: Column) -> Column:
    """array<struct(kind, handle)> under which rules for a path are filed."""
    folded = F.translate(path, _UPPER, _LOWER)
    segments = F.split(folded, "/", -1)
    name = F.element_at(segments, -1)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 2, F.lit(1))), lambda i: F.substring(name, i, F.lit(3)))
    found = {"segment": segments, "ending": F.filter(F.array(F.regexp_extract(name, r"\.([^.]*)$", 1)), lambda e: name.contains(".")),
             "run": F.filter(runs, lambda r: F.length(r) == 3), "character": F.filter(F.split(name, "", -1), lambda c: c != ""), "any": F.array(F.lit(""))}

    def filed(kind: str):
        return lambda h: F.struct(F.lit(kind).alias("kind"), h.alias("handle"))

    return F.concat(*[F.transform(F.array_distinct(values), filed(kind)) for kind, values in found.items()])


def ignored_paths(paths: DataFrame, table: DataFrame) -> DataFrame:
    """(rel_path) of those of ``paths(rel_path)`` that rules hide, each once.  A folder is looked up once, whatever lies in it."""
    parts = F.split(F.regexp_replace("rel_path", r"\\", "/"), "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("at"), (k < F.size(parts)).alias("is_dir")))
    lying = paths.select("rel_path").distinct().select("rel_path", F.explode(above).alias("x")).select("rel_path", "x.at", "x.is_dir")
    places = lying.select("at", "is_dir").distinct()
    filed = places.select("at", "is_dir", F.explode(_handles(F.col("at"))).alias("h")).select("at", "is_dir", "h.kind", "h.handle")
    matched = filed.join(table, ["kind", "handle"]).where((~F.col("dir_only") | F.col("is_dir")) & F.expr("rlike(at, regex)"))
    hidden = matched.groupBy("at", "is_dir").agg(F.max_by("negated", "ord").alias("negated")).where("NOT negated").select("at", "is_dir")
    return lying.join(hidden, ["at", "is_dir"], "left_semi").select("rel_path").distinct()


def ignore_by_table(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files`` with ``ignored``, by ``rules(ord, pattern)``.  A null path is not ignored."""
    hidden = ignored_paths(files.where("rel_path IS NOT NULL"), rule_table(rules)).withColumn("ignored", F.lit(True))
    return files.join(hidden, "rel_path", "left").withColumn("ignored", F.coalesce("ignored", F.lit(False))).select(*files.columns, "ignored")
