import inspect

import corpus_pipeline as P
from test_ngramjoin import brute

from quire.llm import packing, pii, toxicity

SF = "/root/testdata/sf0.01"


def test_stages_in_order():
    assert [name for name, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in P.STAGES)


def test_each_stage_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert name == "packing" or (out.columns == docs.columns and out.dtypes == docs.dtypes)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    first = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in first.collect()}

    model = toxicity.learn(first, spark.read.parquet(f"{SF}/labels.parquet"))
    mild = {r.doc_id for r in toxicity.score(first, model).where(f"score < {toxicity.THRESHOLD}").collect()}
    assert {r.doc_id for r in kept["toxicity"]} == mild and len(mild) > 800

    roots = brute(sorted((r.doc_id, r.text) for r in kept["toxicity"]), 5, 80)
    assert sorted(r.doc_id for r in kept["near_duplicates"]) == sorted(i for i, (n, root) in roots.items() if root == i)

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in kept["near_duplicates"] if any(i in r.text for i in items)}
    assert leaks and {r.doc_id for r in kept["decontamination"]} == {r.doc_id for r in kept["near_duplicates"]} - leaks

    assert {r.doc_id for r in kept["personal_data"]} == {r.doc_id for r in kept["decontamination"]}
    for r in kept["personal_data"]:
        before = pii.base_spans(text[r.doc_id])
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text) and (before or r.text == text[r.doc_id])

    assert {r.doc_id for r in kept["packing"]} == {r.doc_id for r in kept["personal_data"]}
    places = {}
    for r in kept["packing"]:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY


def test_run_gives_the_packing(spark):
    rows = P.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 0


def test_awkward_rows(spark, awkward, empty):
    for docs, most in ((awkward, awkward.count()), (empty, 0)):
        for name, stage in P.STAGES:
            out = stage(spark, docs, SF)
            if name != "packing":
                assert out.columns == docs.columns
                docs = out
        assert out.select("doc_id").distinct().count() == (docs.select("doc_id").distinct().count() if most else 0)
