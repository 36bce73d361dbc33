import math
from collections import Counter, defaultdict

from quire.llm import lm


class Brute:
    """The model by dictionaries."""

    def __init__(self, texts):
        uni, bi = Counter(), Counter()
        for t in texts:
            w = self.tokens(t)
            uni.update(w)
            bi.update(zip(["<s>", *w[:-1]], w))
        self.uni, self.bi, self.n, self.v, self.k = uni, bi, sum(uni.values()), len(uni), len(bi)
        self.cont = Counter(b for _, b in bi)
        self.total, self.seen = Counter(), defaultdict(lambda: [0, 0, 0])
        for (a, _), c in bi.items():
            self.total[a] += c
            self.seen[a][min(c, 3) - 1] += 1
        self.d = lm.discounts([sum(c == i for c in bi.values()) for i in (1, 2, 3, 4)])
        self.e = lm.discounts([sum(c == i for c in self.cont.values()) for i in (1, 2, 3, 4)])
        self.rest = sum(self.e[min(c, 3) - 1] for c in self.cont.values()) / self.k

    @staticmethod
    def tokens(text):
        return [*(text or "").encode().lower().split(), "</s>"]

    def p(self, a, b):
        low = (max(self.cont[b] - self.e[min(self.cont[b], 3) - 1], 0) / self.k if self.cont[b] else 0) + self.rest / (self.v + 1)
        if not self.total[a]:
            return low
        c = self.bi[a, b]
        weight = sum(x * y for x, y in zip(self.d, self.seen[a])) / self.total[a]
        return (max(c - self.d[min(c, 3) - 1], 0) / self.total[a] if c else 0) + weight * low


def test_against_dictionaries(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    brute = Brute([r.text for r in docs.where("doc_id % 3 > 0").collect()])
    got = {r.doc_id: r for r in lm.score(docs, lm.train(docs.where("doc_id % 3 > 0"))).collect()}
    for r in docs.collect():
        w, g = brute.tokens(r.text), got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w), sum(brute.uni[x] > 0 for x in w), brute.n)
        assert math.isclose(g.base_score, sum(math.log10((brute.uni[x] + 1) / (brute.n + brute.v + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(g.score, sum(math.log10(brute.p(a, b)) for a, b in zip(["<s>", *w[:-1]], w)), rel_tol=1e-9)


def test_hot_first_words_are_dealt_and_score_the_same(spark):
    texts = [(i, " ".join(f"the w{(i * j) % 97}" for j in range(30)) + f" end{i}") for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = lm.train(docs)
    hot = lm._mapped(model.folder, "hot", "first")
    assert lm.xxhash.xxh64_intdigest(b"the") in hot.tolist()
    brute = Brute([t for _, t in texts])
    for r in lm.score(docs, model).collect():
        w = brute.tokens(texts[r.doc_id][1])
        assert math.isclose(r.score, sum(math.log10(brute.p(a, b)) for a, b in zip(["<s>", *w[:-1]], w)), rel_tol=1e-9)


def test_probabilities_sum_to_one(spark):
    brute = Brute([r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()])
    for a in ["<s>", *list(brute.uni)[:20]]:
        assert math.isclose(sum(brute.p(a, b) for b in brute.uni) + brute.p(a, "unknown"), 1, rel_tol=1e-9)


def test_better_than_unigrams_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lm.score(docs.where("doc_id % 7 = 2"), lm.train(docs.where("doc_id % 7 != 2"))).collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_awkward_rows(awkward, empty):
    model = lm.train(awkward)
    rows = lm.score(awkward, model).collect()
    assert len(rows) == awkward.count() and all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert all((r.n_tokens, r.n_known) == (1, 1) for r in rows if r.doc_id in (2, 3, 4))
    nothing = lm.train(empty)
    assert nothing.tokens == 0 and lm.score(empty, nothing).count() == 0
    assert all(r.score == 0 for r in lm.score(awkward, nothing).collect())  # one unknown word, probability 1
