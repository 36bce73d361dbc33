"""Scan, ranks, JSON, symbols, docstrings and the whole context."""

import json
import os

from pyspark.sql import functions as F

from quire.config import Config
from quire.functions.text import format_fixed1, number_within, rank_within
from quire.operators import code as C
from quire.operators import configs as K
from quire.operators import context as X
from quire.operators import corpus as CO
from quire.operators import docs as D
from quire.operators import render as R
from quire.sources import files as FS

SF = "/root/testdata/sf0.001"


def test_scan_keeps_hidden_names_and_counts_what_it_skips(spark, tmp_path):
    root = tmp_path / "c+d (x)"
    for name in ("__init__.py", ".env", "_config.yml", "a/b/.f1.md", "a/__tests__/t.py", "node_modules/x/y.js", ".contextignore", "build/out.bin"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x\xff\n")
    rows = {(r.kind, r.rel_path): r for r in FS.corpus_scan(spark, str(root)).collect()}
    assert {p for k, p in rows if k == "file"} == {"__init__.py", ".env", "_config.yml", "a/b/.f1.md", "a/__tests__/t.py", "node_modules/x/y.js", "build/out.bin"}
    assert {p for k, p in rows if k == "dir"} == {"a", "a/b", "a/__tests__", "node_modules", "node_modules/x", "build"}
    assert rows["file", "__init__.py"].depth == 1 and rows["file", "a/b/.f1.md"].depth == 3 and rows["file", ".env"].size == 3
    pruned = {(r.kind, r.rel_path) for r in FS.corpus_scan(spark, str(root), rules=["node_modules", "build/", "*.md"]).collect()}
    assert {p for k, p in pruned if k == "skipped"} == {"node_modules", "build", "a/b/.f1.md"} and not any(p.startswith("node_modules/") for _, p in pruned)


def test_text_of_files_and_of_those_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok \xff\x00")
    scanned = FS.corpus_scan(spark, str(tmp_path)).unionByName(
        spark.createDataFrame([(str(tmp_path / "gone"), "gone", "gone", "file", 5, None, 1)], FS.SCAN_SCHEMA))
    got = {r.rel_path: r for r in FS.text_decode(scanned, str(tmp_path)).collect()}
    assert got["a.txt"].text == "ok \ufffd\x00" and got["a.txt"].size == 5 and got["a.txt"].error is None
    assert got["gone"].text.startswith("// Error reading file: ") and got["gone"].size == 0
    ends = {r.rel_path: r for r in FS.head_tail(scanned.where("rel_path = 'a.txt'"), str(tmp_path), 2).collect()}
    assert (bytes(ends["a.txt"].head), bytes(ends["a.txt"].tail)) == (b"ok", b"\xff\x00")


def test_ranks_agree_with_a_window(spark):
    df = spark.range(0, 3000, numPartitions=6).selectExpr("id % 3 = 0 AS g", "(id * 7919) % 3001 AS n", "concat('p', id % 50, '/', id) AS p")
    want = {(r.g, r.n): i + 1 for g in (True, False) for i, r in enumerate(sorted((r for r in df.collect() if r.g is g), key=lambda r: r.n))}
    import quire.functions.text as T
    span, T.NUMBER_SPAN = T.NUMBER_SPAN, 100
    try:
        assert {(r.g, r.n): r["rank"] for r in number_within(df, "g", "n").collect()} == want
    finally:
        T.NUMBER_SPAN = span
    assert {(r.g, r.n): r["rank"] for r in rank_within(df, "g", [F.col("n")]).collect()} == want
    by_path = sorted((r["rank"], r.p) for r in rank_within(df.where("g"), "g", [F.col("p")]).collect())
    assert [p for _, p in by_path] == sorted(p for _, p in by_path) and [n for n, _ in by_path] == list(range(1, 1001))


def test_to_fixed(spark):
    values = [0.0, 0.04, 0.05, 0.15, 0.25, 0.35, 1.45, 2.5, 6.25, 12.75, 33.333333333333336, 99.95, 99.949999, 100.0, 123456.05]
    want = ["0.0", "0.0", "0.1", "0.1", "0.3", "0.3", "1.4", "2.5", "6.3", "12.8", "33.3", "100.0", "99.9", "100.0", "123456.1"]
    got = [r.t for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").orderBy("i").select(format_fixed1(F.col("x")).alias("t")).collect()]
    assert got == want


def test_json_at_any_depth(spark):
    deep = {"a": {"b": {"it's": {"x.y": {"token": 1, "e": [1, [2, {"q": 1}], {"s": 2}, 4]}}}}, "l": [], "o": {}, "z": None}
    files = spark.createDataFrame([("f", json.dumps(deep)), ("arr", "[1,2,3,4]"), ("txt", '"s"'), ("dup", '{"k": 1, "j": 2, "k": {"m": 3}}')], "path string, content string")
    rows = {(r.path, r.key_path): (r.depth, r.kind, r.text) for r in K.json_skeleton(files).collect()}
    assert rows["f", "a.b.it's.x.y.token"] == (5, "redacted", "[REDACTED]") and rows["f", "a.b.it's.x.y.e"] == (5, "array", "array[4]")
    assert rows["f", "a.b.it's.x.y.e[0]"] == (6, "number", "1") and ("f", "a.b.it's.x.y.e[3]") not in rows
    assert rows["arr", ""] == (0, "array", "array[4]") and rows["arr", "[2]"] == (1, "number", "3") and rows["txt", ""] == (0, "string", '"s"')
    assert rows["dup", "k.m"] == (2, "number", "3") and [k for p, k in rows if p == "dup"].count("k") == 1
    text = {r.path: r.text for r in R.render_json_summary(files).collect()}
    body = text["f"].split("═\n\n", 1)[1]
    assert body == ("a:\n  b:\n    it's:\n      x.y:\n        token: [REDACTED]\n        e:\n          array[4]\n          [0]: 1\n          [1]: 2,[object Object]\n"
                    "          [2]: [object Object]\n          ... (1 more items)\n          l:\n  []\n  o:\n  {}\n  z: null\n")


def test_symbols_below_eight_levels(spark):
    chain = [("f", i, i - 1 if i else None, "class" if not i else "method", f"n{i}", i) for i in range(14)]
    row = C.outline_from_symbols(spark.createDataFrame(chain, "path string, id long, parent_id long, kind string, name string, line_no int")).collect()
    assert len(row) == 1 and (row[0].members, row[0].nested) == (1, 13)


def test_docstring_past_a_symbol_like_line(spark):
    lines = ["def f(x):", "", '    """Doc start', "class Example", "  end doc\"\"\"", "    return x", "def g():", "    '''one line'''"]
    df = spark.createDataFrame([("p", "python", i + 1, t) for i, t in enumerate(lines)], "path string, language string, line_no int, text string")
    got = {r.line_no: r.doc for r in C.following_docstrings(df, C.outline_symbols(df)).collect()}
    assert got[1] == "Doc start class Example end doc" and got[7] == "one line"


def test_many_fences(spark):
    docs = spark.createDataFrame([(1, "```py\na\n```\n" * 400 + "```open")], "doc_id long, text string")
    rows = D.code_blocks(docs).collect()
    assert len(rows) == 400 and all(r.lang == "py" and r.n_lines == 1 for r in rows) and [r.open_line for r in rows][:3] == [1, 4, 7]


def test_rules_of_a_crlf_file_and_escapes(spark):
    assert CO.clean_rules(["*.log\r", "\t# c", "", " \u00a0"]) == ["*.log"]
    merged = CO.merge_rules(spark.createDataFrame([("*.log\r",), ("*.log",), ("\t# c",)], "pattern string"))
    assert [r.pattern for r in merged.collect()] == ["*.log"]
    files = spark.createDataFrame([("!x",), ("#y",), ("z",)], "rel_path string")
    assert {r.rel_path for r in CO.ignore_filter(files, ["\\!x", "\\#y"]).where("ignored").collect()} == {"!x", "#y"}


def test_zero_settings_mean_the_default():
    c = Config(max_file_size=0, max_tokens=0, text_preview_length=0, outline_max_items=0, log_sample_lines=0).clamped()
    assert (c.max_file_size, c.max_tokens, c.text_preview_length, c.outline_max_items, c.log_sample_lines) == (51200, 128000, 300, 50, 0)


def test_whole_context_has_a_block_for_every_kept_file(spark):
    from quire.plans.corpus_q import CFG
    from quire.sources.fixtures import derived
    files = derived(spark, SF, "v_files")
    rules = CO.clean_rules(CO.rules_of(derived(spark, SF, "v_rules")))
    kept = X.kept_files(files, rules)
    blocks = X.file_blocks(kept, CFG).collect()
    assert sorted(b.path for b in blocks) == sorted(r.path for r in kept.collect()) and 0 < len(blocks) < files.count()
    names = {r.path: r.rel_path for r in files.collect()}
    for b in blocks:
        first = b.block.split("\n", 1)[0]
        assert os.path.basename(names[b.path]) in first and first.startswith("// ")
    secret = [b.block for b in blocks if "api_token" in b.block]
    assert not any("tok1" in b for b in secret)
    doc = X.whole_context(files, rules, CFG)
    assert doc.where("seq.a = 2").count() == len(blocks)


def test_level_counts_stay_below_the_lines(spark):
    from quire.operators import logs as L
    from quire.sources.fixtures import derived
    for r in L.level_distribution(derived(spark, SF, "v_log_lines")).groupBy("path", "total_lines").agg(F.sum("n").alias("n")).collect():
        assert 0 < r.n <= r.total_lines


def test_no_sensitive_value_is_shown(spark):
    from quire.sources.fixtures import derived
    config = derived(spark, SF, "v_json")
    for r in R.render_json_summary(config).collect():
        assert "tok" not in r.text.replace("api_token", "").replace("token:", "") or "Parse error" in r.text
    for r in K.redact_lines(derived(spark, SF, "v_yaml")).collect():
        assert "secret" not in r.text


def test_filler_runs_and_weak_flows(spark):
    from quire.operators import flow as FL
    lines = ["~ misc", "~ misc", "-> a", "-> a", "~ misc", "~ misc", "~ misc", "<- return", "~ misc"]
    flow = spark.createDataFrame([("p", "f", i, t) for i, t in enumerate(lines)], "path string, fn string, seq int, line string")
    got = [r.line for r in FL.collapse_flow(flow).orderBy("seq").collect()]
    assert got == ["~ misc", "~ misc", "-> a", "~misc×3 (path/dep)", "<- return", "~ misc"]
    calls = spark.createDataFrame([("p", "f", 1, "a"), ("p", "f", 2, "b.c"), ("p", "g", 1, "a"), ("p", "g", 2, "Logger.x"), ("p", "g", 3, "d")], "path string, fn string, seq int, callee string")
    strong = flow.unionByName(spark.createDataFrame([("p", "g", 1, "~ misc"), ("p", "g", 2, "-> d")], flow.schema))
    assert [(r.fn, r.flow) for r in FL.flow_path(calls, strong).collect()] == [("g", "a → d")]
    deps = FL.dependencies(calls)
    kept = {(r.fn, r.dep) for r in FL.dependency_prune(deps, FL.flow_path(calls, strong), strong).collect()}
    assert kept == {("f", "b.c"), ("g", "Logger.x")}


def test_outline_text(spark):
    lines = ["import os", "# Holds things", "class A:", "    def _hidden(self):", "def run(x):"]
    df = spark.createDataFrame([("p", "python", i + 1, t) for i, t in enumerate(lines)], "path string, language string, line_no int, text string")
    bar = "// ═══════════════════════════════════════"
    assert R.render_outline(df).first().text == (f"{bar}\n// TYPES\n{bar}\n// class A: [doc: Holds things]\n\n{bar}\n// FUNCTIONS\n{bar}\n// def run(x):\n\n"
                                                f"{bar}\n// IMPORTS/DEPENDENCIES\n{bar}\n// import os")
    many = spark.createDataFrame([("p", "python", i + 1, f"class C{i}:") for i in range(53)], df.schema)
    assert R.render_outline(many).first().text.rstrip().endswith("// class C49:\n// ... (3 more types)")


def test_each_file_takes_one_route(spark):
    from quire.plans.corpus_q import CFG
    from quire.sources.fixtures import derived
    files = derived(spark, SF, "v_files")
    routed = CO.classify(files, CFG)
    assert routed.count() == files.count() and routed.where("route IS NULL").count() == 0
