"""Goldens for comment/docstring attachment, signatures and configuration redaction."""

from pyspark.sql import functions as F

from quire.operators import code as C
from quire.operators import configs as K


def _lines(spark, path, language, text):
    rows = [(path, language, i + 1, t) for i, t in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "path string, language string, line_no int, text string")


def test_leading_comment_block(spark):
    src = "\n".join(["// unrelated", "", "/**", " * Adds two numbers.", " */", "", "function add(a, b) {",
                     "  return a + b;", "}", "// not attached", "const x = 1;", "function bare() {"])
    lines = _lines(spark, "a.ts", "typescript", src)
    docs = {r.line_no: r.doc for r in C.leading_docs(lines, C.outline_symbols(lines)).collect()}
    assert docs[7] == "Adds two numbers."
    assert 12 not in docs            # the line above is code, not a comment


def test_leading_comment_budget(spark):
    body = ["# " + ("w" * 70) + str(i) for i in range(5)]
    lines = _lines(spark, "b.py", "python", "\n".join(body + ["def f():", "    pass"]))
    doc = C.leading_docs(lines, C.outline_symbols(lines)).first().doc
    # nearest comments are kept until the joined text passes 160 characters, then cut to 160
    assert len(doc) == 160 and doc.startswith("w" * 70 + "2")


def test_following_docstring(spark):
    src = "\n".join(["def f(x):", "", '    """Return x.', "", "    Twice.", '    """', "    return x",
                     "def g():", "    '''one line'''", "def h():", "    return 1"])
    lines = _lines(spark, "c.py", "python", src)
    docs = {r.line_no: r.doc for r in C.following_docstrings(lines, C.outline_symbols(lines)).collect()}
    assert docs == {1: "Return x. Twice.", 8: "one line"}


def test_signature(spark):
    df = spark.createDataFrame([("// export function a(b) {",), ("class A extends B {",), ("x = {a: 1}",)], "l string")
    assert [r[0] for r in df.select(C.signature(F.col("l"))).collect()] == ["export function a(b)", "class A extends B",
                                                                           "x = {a: 1}"]


def test_line_redaction(spark):
    rows = [("f", 1, "password: hunter2"), ("f", 2, '"apiKey" = "abc"'), ("f", 3, "user: bob"), ("f", 4, ":token x")]
    out = {r.line_no: r.text for r in K.redact_lines(spark.createDataFrame(rows, "path string, line_no int, text string")).collect()}
    assert out == {1: "password: [REDACTED]", 2: '"apiKey" = [REDACTED]', 3: "user: bob", 4: ":token x"}


def test_json_skeleton_redacts_subtree(spark):
    files = spark.createDataFrame([("a.json", '{"b": 1, "secretStuff": {"x": 1}, "n": {"Password": "p", "k": "v"},'
                                              ' "l": [1, {"a": 2}, "s", 4]}')], "path string, content string")
    rows = {r.key_path: (r.kind, r.text) for r in K.json_skeleton(files).collect()}
    assert rows["secretStuff"] == ("redacted", "[REDACTED]") and "secretStuff.x" not in rows
    assert rows["n.Password"] == ("redacted", "[REDACTED]") and rows["n.k"] == ("string", '"v"')
    assert rows["l"] == ("array", "array[4]") and rows["l[1]"][0] == "object" and "l[3]" not in rows


def test_render_code_summary(spark):
    from quire.operators import render as R
    src = "import os\nclass A:\n    pass\ndef f(x):\n    return x\n"
    f = spark.createDataFrame([("p/a.py", "a.py", 60, "python", src)],
                              "path string, rel_path string, size long, language string, content string")
    t = R.render_code_summary(f).first().text
    assert "// Language: python\n// Total lines: 6\n" in t
    assert "// TYPES/INTERFACES\n" in t and "// class A:\n" in t
    assert "// def f(x):\n" in t and "// import os\n" in t


def test_render_word_summary(spark):
    from quire.config import Config
    from quire.operators import render as R
    text = "CHAPTER 1\n\nSummary:\n\nPlain body text that is long enough to be a paragraph of its own here."
    small = spark.createDataFrame([(1, "a.docx", 100, text)], "doc_id long, name string, size long, text string")
    t = R.render_word_summary(small, Config(max_file_size=1000)).first().text
    assert "// Compressed: No\n" in t and "// Total paragraphs: 3\n" in t
    assert "// # CHAPTER 1\n// ## Summary:\n// Plain body" in t
    big = spark.createDataFrame([(2, "b.docx", 5000, text + " More words follow. " * 40)],
                                "doc_id long, name string, size long, text string")
    b = R.render_word_summary(big, Config(max_file_size=1000)).first().text
    assert "// Compressed: Yes (exceeds 1000 bytes threshold)" in b
    assert "// CHAPTER 1\n//   Summary:" in b and "// [Document Summary]\n// " in b and "// KEY POINTS" in b


def test_render_pdf_summary(spark):
    from quire.config import Config
    from quire.operators import render as R
    body = "First sentence of the report is here. " * 30
    df = spark.createDataFrame([(1, "a.pdf", 100, body, 3), (2, "b.pdf", 5000, body + "Other words and notes. " * 30, 4)],
                               "doc_id long, name string, size long, text string, n_pages int")
    got = {r.doc_id: r.text for r in R.render_pdf_summary(df, Config(max_file_size=1000)).collect()}
    assert "// Pages: 3 | Total text: ~" in got[1] and "// Compressed: No" in got[1]
    assert "\n// [Page 1]\n// First sentence" in got[1] and "[Page 3]" in got[1]
    assert "// [Page 1] First sentence of the report is here. First senten..." in got[2]
    assert "// KEY POINTS" in got[2] and "// [~Page " in got[2]
