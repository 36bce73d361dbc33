"""Goldens for scope, ignore rules, tree, formatting, tokens, templates, media, outlines."""

from pyspark.sql import functions as F

from quire.config import DEFAULT
from quire.functions.text import format_size, format_tokens
from quire.operators import code as C
from quire.operators import corpus as K
from quire.operators import media as M
from quire.operators import render as R
from quire.operators import textprofile as TP
from quire.operators import tree as T


def _files(spark, paths):
    return spark.createDataFrame([("p", p, p) for p in paths], "project string, path string, rel_path string")


def test_ignore_rules(spark):
    f = _files(spark, ["debug.log", "important.log", "src/nested/deep.spec.ts", "lib/utils.spec.ts", ".env",
                       "node_modules/a/index.js", "build/out.js", "keep/build.txt"])
    rules = K.clean_rules(["# comment", "", "*.log", "!important.log", "src/**/*.spec.ts"] + list(DEFAULT.ignore_patterns))
    got = {r.rel_path: r.ignored for r in K.ignore_filter(f, rules).collect()}
    assert got["debug.log"] and not got["important.log"]
    assert got["src/nested/deep.spec.ts"] and not got["lib/utils.spec.ts"]
    assert not got[".env"]
    assert got["node_modules/a/index.js"] and got["build/out.js"] and not got["keep/build.txt"]


def test_ignore_under_ignored_directory(spark):
    f = _files(spark, ["secrets/a.txt", "secrets/keep.txt"])
    got = {r.rel_path: r.ignored for r in K.ignore_filter(f, ["secrets/", "!secrets/keep.txt"]).collect()}
    assert got == {"secrets/a.txt": True, "secrets/keep.txt": True}


def _tree(spark, paths, depth=100):
    f = spark.createDataFrame([("p", p, i + 1) for i, p in enumerate(paths)], "project string, rel_path string, rank int")
    rows = T.dir_tree(f, max_depth=depth, show_emoji=False).orderBy("ord_key").collect()
    return [r["line"] for r in rows]


def test_dir_tree(spark):
    assert _tree(spark, ["src/a.ts", "src/b.ts", "src/c.ts"]) == ["src", "  ├─a.ts", "  ├─b.ts", "  └─c.ts"]
    assert _tree(spark, ["src/a.ts", "src/b.ts"], depth=1) == ["src"]
    assert _tree(spark, ["src/a.ts"], depth=0) == []
    lines = _tree(spark, ["src/a.ts", "src/utils/helpers.ts", "package.json"])
    assert lines == ["src", "│ ├─a.ts", "│ └─utils", "│   └─helpers.ts", "package.json"]


def test_format_size_and_tokens(spark):
    df = spark.createDataFrame([(b,) for b in (1023, 1024, 1536, 1048575, 1572864)], "b long")
    assert [r[0] for r in df.select(format_size("b")).collect()] == ["1023B", "1.0KB", "1.5KB", "1024.0KB", "1.5MB"]
    t = spark.createDataFrame([(n,) for n in (999, 1500, 1500000, 1250, 1450)], "n long")
    assert [r[0] for r in t.select(format_tokens("n")).collect()] == ["999", "1.5K", "1.5M", "1.3K", "1.4K"]


def test_token_estimate(spark):
    df = spark.createDataFrame([("Hello, world!",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(TP.token_estimate(F.col("x"))).collect()] == [4, 0, 0]


def test_template_replacement(spark):
    segs = R.template_segments(spark.createDataFrame([("t", "A $PROJECT_NAME $SCOPE $MISSING_VAR $SELECTED_FILES.")],
                                                     "name string, body string"))
    stats = spark.createDataFrame([("p", "t", "proj", None)], "project string, template string, PROJECT_NAME string, SCOPE string")
    for v in R.TEMPLATE_VARS:
        if v not in stats.columns and v not in R.BIG_VARS:
            stats = stats.withColumn(v, F.lit(None).cast("string"))
    out = R.render_template_rows(segs, stats, {}).orderBy("seq").collect()
    assert "".join(r["text"] for r in out) == "A proj  $MISSING_VAR ."


def _bytes(h):
    return bytearray.fromhex(h)


def test_media_headers(spark):
    png = "89504E470D0A1A0A0000000D49484452" + "00000064" + "00000064" + "08" + "06" + "000000"
    gif = "474946383961" + "4001" + "F000" + "00" + "0000"
    rows = [("a.png", _bytes(png)), ("b.gif", _bytes(gif)), ("c.png", bytearray()), ("d.png", _bytes("00112233"))]
    df = spark.createDataFrame(rows, "path string, head binary")
    got = {r.path: r for r in M.media_headers(df).collect()}
    assert (got["a.png"].width, got["a.png"].height, got["a.png"].bit_depth, got["a.png"].has_alpha) == (100, 100, 8, True)
    assert (got["b.gif"].width, got["b.gif"].height) == (320, 240)
    assert got["c.png"].width is None and got["d.png"].width is None


def test_outline_caps(spark):
    from quire.config import Config
    rows = ([("f.ts", "type", i, f"class T{i}") for i in range(30)] + [("f.ts", "function", 100 + i, f"f{i}()") for i in range(50)]
            + [("f.ts", "import", 200 + i, f"import m{i}") for i in range(20)])
    sym = spark.createDataFrame(rows, "path string, kind string, line_no int, text string")
    shown, totals = C.outline_caps(sym, Config(outline_max_items=10))
    more = {r.kind: r.more for r in totals.collect()}
    assert more == {"type": 20, "function": 40, "import": 10}
    assert shown.count() == 30


def test_selected_scope_dedup(spark):
    f = _files(spark, ["en/a.md", "en/b.md", "de/c.md", "enx/d.md"])
    sel = spark.createDataFrame([("p", "en"), ("p", "en/a.md")], "project string, sel string")
    got = sorted(r.rel_path for r in K.selected_scope(f, sel).collect())
    assert got == ["en/a.md", "en/b.md"]


def test_media_scan_headers(spark):
    ttf = bytearray.fromhex("00010000" + "0005" + "0080" + "0002" + "0010") + bytearray(20)
    jpg = bytearray.fromhex("FFD8FFE0" + "0010" + "4A464946" + "00" * 10 + "FFC0" + "0011" + "08" + "00F0" + "0140" + "03") + bytearray(16)
    z = bytearray(b"junk") + bytearray.fromhex("504B0506" + "0000" + "0000" + "0700" + "0700") + bytearray(12)
    df = spark.createDataFrame([("a.ttf", ttf, ttf), ("b.jpg", jpg, jpg), ("c.zip", z, z)], "path string, head binary, tail binary")
    got = {r.path: r for r in M.media_scan_headers(df).collect()}
    assert got["a.ttf"].tables == 5
    assert (got["b.jpg"].width, got["b.jpg"].height, got["b.jpg"].bit_depth) == (320, 240, 8)
    assert got["c.zip"].entries == 7


def test_bpe_fallback_matches_estimate(spark):
    from quire.functions.tokens import token_count_bpe
    df = spark.createDataFrame([("Hello, world!",), ("",)], "x string")
    got = [r[0] for r in df.select(token_count_bpe(F.col("x"))).collect()]
    assert got == [4, 0]


def test_format_percent(spark):
    from quire.functions.text import format_percent
    df = spark.createDataFrame([(1, 400), (29, 2000), (1, 3)], "n long, t long")
    # 0.25 is exact (tie goes up); 29/2000*100 is 1.4500000000000002 in doubles, so up
    assert [r[0] for r in df.select(format_percent("n", "t")).collect()] == ["0.3", "1.5", "33.3"]


def test_render_csv_and_log_summary(spark):
    rows = [("t.csv", 1, "id,name,score"), ("t.csv", 2, '1,"a, b",2.5'), ("t.csv", 3, ""), ("t.csv", 4, "2,c,3.5"),
            ("t.csv", 5, "3,d,x"), ("t.csv", 6, "4,e,1.0"), ("e.csv", 1, "  ")]
    lines = spark.createDataFrame(rows, "path string, line_no int, text string")
    got = {r.path: r.text for r in R.render_csv_summary(lines).collect()}
    assert got["e.csv"].endswith("(⚠️ Empty CSV)\n")
    t = got["t.csv"]
    assert "// Total rows: 4\n" in t and '// Delimiter: ","' in t
    assert '// name: string (examples: "a, b", "c")' in t
    # 2.5, 3.5 float; x drops to string; string is also the start state, so 1.0 makes it float again
    assert "// score: float" in t
    assert "// ... (1 more rows)" in t
    logs = spark.createDataFrame([("a.log", 1, "INFO start"), ("a.log", 2, "ERROR boom"), ("a.log", 3, "")],
                                 "path string, line_no int, text string")
    lt = R.render_log_summary(logs).first().text
    assert "// Total lines: 3" in lt and "// INFO    :      1 (33.3%)" in lt
    assert "// RECENT ERROR PATTERNS (first 1)" in lt and "// [ERROR]\n// ERROR boom" in lt


def test_rank_within_matches_window(spark):
    from pyspark.sql import Window
    from quire.functions.text import rank_within
    df = spark.range(0, 5000).select(F.when(F.col("id") % 10 == 0, "small").otherwise("hot").alias("g"),
                                     ((F.col("id") * 7919) % 5003).alias("k"))
    a = rank_within(df, "g", [F.col("k")], partitions=12)
    b = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    assert a.exceptAll(b).count() == 0 and a.count() == 5000


def test_render_text_summary(spark):
    f = spark.createDataFrame([("p/a.txt", "a.txt", 2048, None, "first line\n\n  second  \n")],
                              "path string, rel_path string, size long, language string, content string")
    t = R.render_text_summary(f).first().text
    assert t.startswith("// File: a.txt (⚠️ Overview — 2.0KB, structure outline)\n// Language: text\n// Total lines: 4")
    assert "// Non-empty lines: 2\n// Average line length: 10 chars" in t
    assert t.endswith("// first line\n//   second  \n")


def test_render_yaml_summary(spark):
    from quire.operators import configs as K
    lines = spark.createDataFrame([("c.yaml", 1, "name: 'x'"), ("c.yaml", 2, "port: 007"), ("c.yaml", 3, "hex: 0x1F"),
                                   ("c.yaml", 4, "api_key: k1"), ("c.yaml", 5, "parent:"), ("c.yaml", 6, "ratio: 1.50"),
                                   ("c.yaml", 7, "on: true")], "path string, line_no int, text string")
    t = R.render_yaml_summary(K.order_keys(K.yaml_flat_keys(lines))).first().text
    body = t.split("\n\n", 2)[2]
    assert body == ('name: "x"\nport: 7\nhex: 31\napi_key: [REDACTED]\nparent: "(nested value)"\nratio: 1.5\non: true\n')


def test_driver_decides_between_exact_counts_and_the_estimate(spark, monkeypatch, tmp_path):
    import base64

    import pytest
    from pyspark.sql import functions as F

    from quire.functions import tokens
    df = spark.createDataFrame([("abcd",), ("",), (None,)], "x string")
    ranks = tmp_path / "bytes.tiktoken"  # single bytes alone: a token for each
    ranks.write_bytes(b"".join(base64.b64encode(bytes([i])) + f" {i}\n".encode() for i in range(256)))
    monkeypatch.setenv("QUIRE_BPE_RANKS", str(ranks))
    exact = df.select(tokens.token_count_bpe(F.col("x")))
    monkeypatch.delenv("QUIRE_BPE_RANKS")
    assert [r[0] for r in exact.collect()] == [4, 0, 0]
    with pytest.raises(RuntimeError, match="cannot load"):
        monkeypatch.setattr(tokens, "_encoder", lambda path: None)
        list(tokens._counter("gone")(iter([])))
    assert [r[0] for r in df.select(tokens.token_count_bpe(F.col("x"))).collect()] == [2, 0, 0]
