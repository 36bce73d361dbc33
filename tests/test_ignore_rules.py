"""Rules as a table decide as rules in the row do, however many there are."""

import random
import re

import pytest

from quire.operators import corpus as C
from quire.operators.ignore_rules import handle_of, ignore_by_table

EXPECTED = {  # written by hand, for the rules below
    "src/a.spec.ts": True, "src/nested/deep.spec.ts": True, "lib/a.spec.ts": False, "coverage/lcov.info": True, "coverage/nested/report.html": True, "coverage": False,
    "test.js": True, "a/b/test.js": True, "a/b/test.jsx": False, "debug.log": True, "important.log": False, "logs/important.log": False, "out/x/y.txt": True, "my/out/z": True, "outer/z": False,
    "Build/X.TXT": True, "build/x.txt": True, "x.c": True, "xy.c": False, "f1.tmp": True, "fa.tmp": False, "node_modules/m/index.js": True, "deep/node_modules/m": True, "~a": True, "a~b": False,
    "docs/readme.md": False, "docs/private/readme.md": True, "docs/private/keep.md": True, "a.bak2": True, "k.swp": True, "!odd": True, "#odd": True, "plain": False}
RULES = ["# comment", "", "src/**/*.spec.ts", "coverage/**", "**/test.js", "*.log", "!important.log", "out/", "/build/*.txt", "?.c", "f[0-9].tmp", "node_modules", "~*", "docs/private/", "!docs/private/keep.md",
         "*.bak?", "*.sw*", "\\!odd", "\\#odd", "   "]


def decide(spark, rules, paths):
    table = spark.createDataFrame(list(enumerate(rules)), "ord long, pattern string").repartition(3)
    files = spark.createDataFrame([(p,) for p in paths], "rel_path string").repartition(3)
    return {r.rel_path: r.ignored for r in ignore_by_table(files, table).collect()}


def test_expected_rows(spark):
    assert decide(spark, RULES, EXPECTED) == EXPECTED
    files = spark.createDataFrame([(p,) for p in EXPECTED], "rel_path string")
    assert {r.rel_path: r.ignored for r in C.ignore_filter(files, C.clean_rules(RULES)).collect()} == EXPECTED


def test_a_path_that_a_rule_matches_has_its_handle():
    """For random rules and paths: never a match without the handle (or the join would miss it)."""
    rng = random.Random(3)
    pieces = ["a", "b.c", "*", "**", "?", "x*y", "*.ts", "[ab]", "foo", "Foo", "a**b", ".env", "*~", "longname", "l?ngname", "*.tar.gz", "**x"]
    names = ["a", "b.c", "xzy", "foo", "FOO", "q.ts", "ab", "aqb", ".env", "t~", "longname", "lingname", "z.tar.gz", "b", "yx", ""]
    seen = 0
    for _ in range(12_000):
        pattern = rng.choice(["", "", "/", "!"]) + "/".join(rng.choices(pieces, k=rng.randint(1, 3))) + rng.choice(["", "", "/"])
        rule = C.compile_rule(pattern)
        if rule is None:
            continue
        kind, handle = handle_of(pattern.lstrip("!"))
        path = "/".join(rng.choices(names, k=rng.randint(1, 4)))
        if re.search(rule[2], path):
            seen += 1
            folded, name = path.lower().split("/"), path.lower().split("/")[-1]
            has = {"segment": folded, "ending": name.rsplit(".", 1)[1:], "run": [name[i:i + 3] for i in range(len(name) - 2)], "character": list(name), "any": [""]}[kind]
            assert handle in has, (pattern, path, kind, handle)
    assert seen > 500


def test_null_and_repeated_paths_and_no_rules(spark):
    files = spark.createDataFrame([("a.log", 1), ("a.log", 2), (None, 3), ("", 4)], "rel_path string, ignored_before int")
    rules = spark.createDataFrame([(1, "*.log"), (2, None)], "ord long, pattern string")
    assert sorted((r.ignored_before, r.ignored) for r in ignore_by_table(files, rules).collect()) == [(1, True), (2, True), (3, False), (4, False)]
    assert not any(r.ignored for r in ignore_by_table(files, rules.where("false")).collect())
    assert ignore_by_table(files.where("false"), rules).collect() == []


def test_a_hundred_thousand_rules(spark):
    rules = spark.range(100_000).selectExpr("id AS ord", """CASE pmod(id, 5) WHEN 0 THEN concat('dir', id, '/') WHEN 1 THEN concat('*.ext', id) WHEN 2 THEN concat('src/**/gen', id, '*.js')
        WHEN 3 THEN concat('name', id, '.txt') ELSE concat('!name', id - 1, '.txt') END AS pattern""")
    paths = spark.range(20_000).selectExpr("""CASE pmod(id, 4) WHEN 0 THEN concat('p/dir', id * 5, '/f') WHEN 1 THEN concat('q/f.ext', id * 5 + 1) WHEN 2 THEN concat('src/m/gen', id * 5 + 2, 'x.js')
        ELSE concat('name', id * 5 + 3, '.txt') END AS rel_path""")
    got = ignore_by_table(paths, rules).groupBy("ignored").count().collect()
    assert {r.ignored: r["count"] for r in got} == {True: 15_000, False: 5_000}


@pytest.mark.parametrize("n", [C.LITERAL_RULES, C.LITERAL_RULES + 1])
def test_lists_of_any_length(spark, n):
    files = spark.createDataFrame([("f3.x",), ("g",), ("keep",)], "rel_path string")
    rules = [f"f{i}.*" for i in range(n - 1)] + ["!f3.*"]
    assert not any(r.ignored for r in C.ignore_filter(files, rules).collect())
    assert {r.rel_path for r in C.ignore_filter(files, rules[:-1] + ["g"]).collect() if r.ignored} == {"f3.x", "g"}
