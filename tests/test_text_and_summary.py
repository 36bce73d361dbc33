"""Goldens restated from the reference's summariser tests, plus invariants."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import sentence_graph as G
from quire.operators import summarize as S


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_clean_text(spark):
    assert _one(spark, S.clean_text, "  Line 1  \n  Line 2  \n   Line 3   ") == "Line 1\nLine 2\nLine 3"
    assert _one(spark, S.clean_text, "Line 1\r\nLine 2\rLine 3") == "Line 1\nLine 2\nLine 3"
    assert _one(spark, S.clean_text, "   \n\t\n ") == ""


def test_sentence_split(spark):
    assert len(_one(spark, S.split_sentences, "Hello world. This is a test. Another sentence.")) == 3
    assert len(_one(spark, S.split_sentences, "这是第一句话。这是第二句话。这是第三句话。")) == 3
    # delimiter runs inside the text are skipped; a trailing run is its own sentence
    assert _one(spark, S.split_sentences, "Wait... what?!") == ["Wait.", "what?", "!"]
    assert _one(spark, S.split_sentences, "") == []


def _sim(spark, a, b):
    docs = spark.createDataFrame([(1, [a, b])], "doc_id long, ss array<string>")
    rows = G.similarity(docs.select("doc_id", S.token_hashes(F.col("ss")).alias("tokens"))).collect()
    return rows[0]["sim"] if rows else 0.0


def test_similarity(spark):
    assert _sim(spark, "The cat sat", "the cat sat") == 1.0
    assert _sim(spark, "cat dog fish", "tree rock mountain") == 0.0
    s = _sim(spark, "The quick brown fox", "The quick brown dog")
    assert 0.5 < s < 1 and abs(s - 0.6) < 1e-12
    assert _sim(spark, "", "anything") == 0.0


README = ("TextRank ranks sentences by how similar they are to other sentences in the text. "
          "Similar sentences vote for each other and the votes are weighted by similarity. "
          "The algorithm repeats the voting until the scores settle down or a round limit is reached. "
          "Short sentences are ignored. Long sentences about ranking sentences score well. "
          "The summary keeps the best sentences in their original order. "
          "Scores start at one for every sentence in the document.")


def test_key_sentences(spark):
    docs = spark.createDataFrame([(1, README)], "doc_id long, text string")
    rows = S.key_sentences(docs, k=3, min_length=20).orderBy("rank").collect()
    assert len(rows) == 3
    pos = [r["position"] for r in rows]
    assert pos == sorted(pos)
    assert all(r["score"] > 0 for r in rows)
    assert all(len(r["text"]) >= 20 for r in rows)


def test_summary_bounds(spark):
    docs = spark.createDataFrame([(1, README * 3)], "doc_id long, text string")
    out = S.summary_select(docs, max_length=500, min_sentences=3).first()["summary"]
    assert 300 <= len(out) <= 600
    cleaned = _one(spark, S.clean_text, README * 3)
    assert all(line in cleaned for line in out.split("\n"))


def _varied(spark):
    """Documents of none to many sentences, with equal ones, one without tokens, and a word in every sentence."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(1, README), (2, "One sentence only."), (3, "A b c. A b d. X y z."), (4, ""), (5, None), (6, "... --- !!!"), (7, "Same words here. " * 9)]
    for d in range(8, 20):
        rows.append((d, " ".join("the " + " ".join(rng.choices(words, k=rng.randrange(1, 14))) + rng.choice([".", "!", "\n", "?"]) for _ in range(rng.randrange(2, 60)))))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def _plain_rank(sentences):
    """TextRank by the definition, in plain loops."""
    sets = [set(s) for s in sentences]
    n = len(sets)
    sim = [[len(a & b) / len(a | b) if i != j and a & b else 0.0 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    weight, score, rounds = [sum(r) for r in sim], [1.0] * n, 0
    for rounds in range(1, 51):
        new = [0.15 + 0.85 * sum(sim[i][j] / weight[j] * score[j] for j in range(n) if weight[j]) for i in range(n)]
        change, score = max(abs(a - b) for a, b in zip(new, score)), new
        if change < 1e-4:
            break
    return score, rounds


def test_textrank_by_definition_in_rows_and_in_tiles(spark):
    docs = _varied(spark)
    tokens = S.with_sentences(docs, "text", "ss").select("doc_id", S.token_hashes(F.col("ss")).alias("t")).collect()
    want = {}
    for r in tokens:
        if r.t:
            scores, rounds = _plain_rank(r.t)
            want |= {(r.doc_id, i): (pytest.approx(x, abs=1e-9), rounds) for i, x in enumerate(scores)}
    assert want[2, 0][0] == 1 - 0.85 and len(want) > 200
    for in_row, block in ((2048, 1024), (0, 7), (20, 8)):
        got = {(r.doc_id, r.pos): (r.score, r.iterations) for r in S.textrank(docs, in_row=in_row, block=block).collect()}
        assert got == want


def test_similarity_by_definition_whatever_the_tiles(spark, monkeypatch):
    docs = _varied(spark)
    tokens = S.with_sentences(docs, "text", "ss").select("doc_id", S.token_hashes(F.col("ss")).alias("t")).collect()
    want = {(r.doc_id, i, j): pytest.approx(len(set(a) & set(b)) / len(set(a) | set(b))) for r in tokens for i, a in enumerate(r.t or [])
            for j, b in enumerate(r.t) if i != j and set(a) & set(b)}
    for in_row, block in ((2048, 1024), (10, 7)):
        assert {(r.doc_id, r.i, r.j): r.sim for r in S.similarity_edges(docs, in_row=in_row, block=block).collect()} == want
    # postings and products of the same block agree
    block = G.Block(np.array([3, 2, 0, 3]), np.array([1, 2, 3, 2, 3, 1, 3, 9]))
    whole = G.shared_tokens(block, block)
    monkeypatch.setattr(G, "SMALL_PRODUCT", 0)
    monkeypatch.setattr(G, "PAIRS_AT_ONCE", 2)
    assert (G.shared_tokens(block, block) == whole).all() and whole.tolist() == [[3, 2, 0, 2], [2, 2, 0, 1], [0, 0, 0, 0], [2, 1, 0, 3]]


def test_summaries_keys_and_sections_of_large_documents(spark):
    docs = _varied(spark)
    headed = docs.select("doc_id", F.concat(F.lit("# One\n"), F.coalesce("text", F.lit("")), F.lit("\n## Two\n"), F.coalesce("text", F.lit("")), F.lit(" And an end of some length that is unlike the rest.")).alias("text"))
    def keys(**k):
        return S.key_sentences(docs, k=4, min_length=12, **k).withColumn("score", F.round("score", 9))

    for make in (lambda **k: S.summary_select(docs, max_length=200, **k), keys,
                 lambda **k: S.section_summaries(headed, **k)):
        rows = sorted(map(str, make().collect()))
        assert rows and rows == sorted(map(str, make(in_row=5, block=8).collect()))


def _greedy(order, max_length, least):
    cur, picked = 0, []
    for pos, length in order:
        if cur + length <= max_length or len(picked) < least:
            cur, picked = cur + length, [*picked, pos]
        if cur >= max_length and len(picked) >= least:
            break
    return picked


def test_a_summary_of_a_million_sentences_gathers_few(spark):
    ranked = spark.range(1_000_000, numPartitions=4).selectExpr("1L AS doc_id", "cast(id AS int) AS pos", "cast(pmod(xxhash64(id), 900) + 1 AS int) AS len",
                                                              "round(pmod(xxhash64(id, 'x'), 100000) / 100000.0, 9) AS score")
    kept = S.choosable(ranked, ["doc_id"], 600, 3).collect()
    assert len(kept) < 8000
    every = ranked.toPandas().sort_values(["score", "pos"], ascending=[False, True])
    few = sorted(((r.pos, r.len, r.score) for r in kept), key=lambda r: (-r[2], r[0]))
    assert _greedy([r[:2] for r in few], 600, 3) == _greedy(zip(every.pos.tolist(), every.len.tolist()), 600, 3)
    long = ranked.withColumn("len", F.lit(10_000))
    assert len(S.choosable(long, ["doc_id"], 600, 3).collect()) == 3
