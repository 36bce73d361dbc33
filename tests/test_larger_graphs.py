"""Graphs past one square are ranked in their row, in tiles; possibly large documents alone are split twice."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import sentence_graph as G
from quire.operators import summarize as S


def _block(n, vocabulary, seed=5):
    rng = np.random.default_rng(seed)
    tokens = [np.unique(rng.integers(0, vocabulary, k)) for k in rng.integers(0, 9, n)]
    return G.Block(np.array([len(t) for t in tokens]), np.concatenate(tokens).astype(np.int64))


@pytest.mark.parametrize("vocabulary", [12, 4000])  # nearly all pairs similar, hardly any
def test_tiles_rank_as_the_square_does(monkeypatch, vocabulary):
    block = _block(300, vocabulary)
    monkeypatch.setattr(G, "DENSE", 1 << 20)
    score, rounds = G.rank_block(block, 0.85, 50, 1e-4)
    monkeypatch.setattr(G, "DENSE", 10)
    monkeypatch.setattr(G, "BLOCK", 64)
    for doubles in (0, 1 << 20):
        monkeypatch.setattr(G, "DOUBLES", doubles)
        tiled, tiled_rounds = G.rank_block(block, 0.85, 50, 1e-4)
        assert rounds == tiled_rounds and np.allclose(score, tiled, atol=1e-12)


def test_a_few_thousand_sentences_need_no_rounds_of_jobs(spark, monkeypatch):
    rng = random.Random(2)
    text = " ".join(f"{' '.join(rng.choice('abcdefghij') * 2 for _ in range(rng.randint(1, 4)))} number{rng.randint(1, 900)}." for _ in range(2500))
    docs = spark.createDataFrame([(1, text), (2, "One line here. Another line there.")], "doc_id long, text string")
    monkeypatch.setattr(G, "rank_large", lambda *a, **k: pytest.fail("rounds of jobs"))
    rows = S.textrank(docs).where("doc_id = 1").orderBy("pos").collect()
    ss = S.with_sentences(docs, "text", "ss").where("doc_id = 1").select(S.token_hashes(F.col("ss")).alias("t")).first()["t"]
    block = G.Block(np.array([len(t) for t in ss]), np.array([x for t in ss for x in t], np.int64))
    monkeypatch.setattr(G, "DENSE", 1 << 20)
    assert len(rows) == len(ss) == 2500 and np.allclose([r.score for r in rows], G.rank_block(block, 0.85, 50, 1e-4)[0], atol=1e-9)
    sim = G.jaccard(G.shared_tokens(block, block), block.sizes, block.sizes)
    pairs = S.similarity_edges(docs).where("doc_id = 1")
    assert pairs.count() == np.count_nonzero(sim) - np.count_nonzero(sim.diagonal())
    assert all(abs(r.sim - sim[r.i, r.j]) < 1e-12 for r in pairs.where("(i * 31 + j) % 997 = 0").collect())
    assert S.summary_select(docs).count() == 2 and S.key_sentences(docs).where("doc_id = 1").count() == 5


def test_pairs_of_a_document_in_tiles(spark, monkeypatch):
    text = " ".join(f"w{i % 7} x{i % 5} y{i}." for i in range(90))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    want = {(r.i, r.j): r.sim for r in S.similarity_edges(docs).collect()}
    got = {(r.i, r.j): r.sim for r in S.similarity_edges(docs, in_row=20, block=16).collect()}
    assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-12 for k in want) and (3, 10) in want and (10, 3) in want


def test_words_and_spaces_of_any_script(spark):
    """The short ways for plain ASCII give what the general ones give."""
    texts = ["a  b\tc \x0b d.\r\n\r\n e!! f?", "Ünï x　y。z！", "\x01odd\x02 one. two", "plain one. plain two", "  ", "", "!!..", "İK kelvin K", "end...!!\n", "词 词语 a1。"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = S.with_sentences(docs, "text", "ss").select("doc_id", "ss", F.transform("ss", S.token_set).alias("t"),
                                                       S.split_sentences(S.clean_text(F.col("text"))).alias("want")).orderBy("doc_id").collect()
    assert all(r.ss == r.want for r in rows)
    assert rows[0].ss == ["a b c d.", "e!", "f?"] and rows[0].t == [["a", "b", "c", "d"], ["e"], ["f"]]
    assert sorted(rows[9].t[0]) == sorted(["词", "词语", "a1", "语"])
