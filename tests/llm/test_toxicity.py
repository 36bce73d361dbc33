import random

import numpy as np
from pyspark.sql import functions as F

from quire.llm import toxicity
from quire.llm.common import Memo


def by_pairs(machine, ids):
    """The definition: bias, weights, and the product of each pair."""
    v = machine.table[:, 1:]
    w = machine.table[:, 0] + 0.5 * (v * v).sum(axis=1)
    z = machine.bias + sum(w[i] for i in ids) + sum(v[i] @ v[j] for a, i in enumerate(ids) for j in ids[a + 1:])
    return 1 / (1 + np.exp(-z))


def corpus(rng, n, rule):
    words = [f"w{i}" for i in range(60)]
    texts, labels = [], []
    for _ in range(n):
        ws = rng.sample(words, 8) + [x for x in ("insult", "group") if rng.random() < 0.5]
        rng.shuffle(ws)
        texts.append(" ".join(ws))
        labels.append(int(rule(ws)))
    return texts, np.array(labels)


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    machine = toxicity.FactorizationMachine(-0.3, np.arange(20, dtype=np.uint32), rng.normal(0, 0.4, (20, 1 + toxicity.FACTORS)))
    for ids in ([], [3], [1, 5, 9, 19]):
        assert abs(machine.scores([np.array(ids, int)])[0] - by_pairs(machine, ids)) < 1e-12


def test_learns_a_pair_that_weights_alone_miss():
    """Toxic only if both or neither of two terms stand there: no additive weights can say that."""
    rng = random.Random(3)
    texts, labels = corpus(rng, 3000, lambda ws: ("insult" in ws) == ("group" in ws))
    memo = Memo(toxicity._terms_of_word)
    hashed = [toxicity.terms(t.encode(), memo) for t in texts]
    machine = toxicity.train(hashed[:2400], labels[:2400], prior=0.5, epochs=40)  # neither term tells the classes apart on its own
    own = machine.memo()
    scores = machine.scores([toxicity.terms(t.encode(), own) for t in texts[2400:]])
    assert ((scores >= 0.5) == labels[2400:]).mean() > 0.9


def test_pairs_of_chance_do_not_enter():
    rng = random.Random(4)
    texts, labels = corpus(rng, 3000, lambda ws: rng.random() < 0.3)
    memo = Memo(toxicity._terms_of_word)
    assert len(toxicity.paired_terms([toxicity.terms(t.encode(), memo) for t in texts], labels)) == 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    rows = [(r.score, r.toxic) for r in found.collect()]
    hit = [s for s, y in rows if y]
    clean = [s for s, y in rows if not y]
    assert len(hit) > 50 and np.mean([s >= toxicity.THRESHOLD for s in clean]) < 0.03
    assert np.mean([np.mean([h > c for c in clean]) for h in hit]) > 0.9  # area under the curve


def test_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (7, 0, None), (None, 1, 1), (5, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    machine = toxicity.learn(awkward, labels)
    rows = toxicity.score(awkward, machine).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    assert toxicity.score(empty, toxicity.learn(empty, labels.where("false"))).count() == 0
    assert toxicity.without_toxic(awkward, machine, threshold=1.1).exceptAll(awkward).count() == 0
    assert toxicity.without_toxic(awkward, machine, threshold=0.0).count() == 0


def test_held_out_labels_are_not_used(spark, awkward):
    ids = [i for i in range(1, 9)]
    import zlib
    held = [i for i in ids if zlib.crc32(str(i).encode()) % 4 == 2]
    frames = [spark.createDataFrame([(i, 1, v if i in held else i % 2) for i in ids], "doc_id long, quality int, toxic int") for v in (0, 1)]
    a, b = (toxicity.learn(awkward, f) for f in frames)
    assert a.bias == b.bias and np.array_equal(a.table, b.table)
