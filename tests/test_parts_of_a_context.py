"""Contexts and summaries are made part by part: no plan of all kinds at once, and every kind is there."""

import pytest
from pyspark.sql import functions as F

from quire.operators import context as X
from quire.operators import corpus as C
from quire.operators import summarize as S
from quire.plans import registry
from quire.plans.corpus_q import CFG


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Tables of a few rows."""
    at = tmp_path_factory.mktemp("tables")
    long = "\n".join(f"Sentence number {i} tells of thing {i % 7} and thing {i % 5}." for i in range(300))
    made = {
        "documents": spark.createDataFrame([(i, long if i % 2 else f"short {i}.\nsecond line", "en", f"src{i % 2}") for i in range(24)],
                                           "doc_id long, text string, lang string, source string"),
        "events": spark.range(40).selectExpr("id AS event_id", "id % 3 AS user_id", "'error' AS event_type", "timestamp_seconds(id) AS ts"),
        "part": spark.range(30).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "CAST(id AS INT) AS p_size"),
        "customer": spark.range(40).selectExpr("id AS c_custkey", "concat('c', id) AS c_name", "CAST(id % 5 AS INT) AS c_nationkey", "'BUILDING' AS c_mktsegment"),
        "conversations": spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}\nof {c}") for c in range(3) for t in range(4)],
                                               "conv_id long, turn int, role string, text string"),
    }
    for name, df in made.items():
        df.write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_a_context_is_not_one_plan(spark):
    files = spark.createDataFrame([("p", f"p/{n}", n, 20, "a, b\n1, 2\n") for n in ("a.log", "b.csv", "c.md", "d.json", "e.yaml", "f.pdf", "g.docx", "h.py")],
                                  "project string, path string, rel_path string, size long, content string")
    blocks = X.file_blocks(files, CFG)
    assert _exchanges(blocks) < 10
    assert sorted(r.path for r in blocks.collect()) == sorted(r.path for r in files.collect())


def test_a_missing_rule_says_nothing():
    assert C.clean_rules([None, "*.log", "", "# c"]) == ["*.log"]


def test_every_kind_is_summarised(spark, tables):
    registry.load_all()
    df = registry.QUERIES["render_summary"](spark, tables)
    assert _exchanges(df) == 0  # each kind was a job of its own
    got = {(r.kind, r.form): r.n for r in df.groupBy("kind", F.regexp_extract("path", r"\.?([a-z]+)[^.a-z]*$", 1).alias("form")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {k for k, _ in got} == {"log", "doc", "csv", "generic", "config", "code", "excel", "pptx", "word", "pdf"}
    assert got["config", "json"] == 40 and got["config", "yaml"] == 2 and got["excel", "xlsx"] == 1 and got["pptx", "pptx"] == 3
    texts = {r.path: r.text for r in df.where("kind IN ('excel', 'pptx', 'config')").collect()}
    assert "// SHEET: \"S0\"" in texts["w0.xlsx"] and "// SLIDE CONTENT" in texts["pptx/0"] and "// CONFIGURATION STRUCTURE" in texts["cfg/c5.json"]


def test_runs_of_delimiters_are_no_sentences(spark):
    docs = spark.createDataFrame([(1, "ab!! " * 60)], "doc_id long, text string")
    assert S.maybe_large(docs, "text", 100) is None  # 120 delimiters end 60 sentences
    assert S.maybe_large(docs, "text", 50) is not None
    odd = ["a.b.c", "!!a", ".. a .. b ..\n\n", "a\r\n\r\nb\rc", "。。a。b！", "x" * 9, "a. . .b"]
    many = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for r in S.with_sentences(many, "text", "ss").select("doc_id", F.size("ss").alias("n")).where("n > 1").collect():
        assert S.maybe_large(many.where(F.col("doc_id") == r.doc_id), "text", r.n - 1) is not None
