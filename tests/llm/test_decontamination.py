import random

import numpy as np

from quire.llm import decontamination as D


def edit(p, t):
    """The smallest edit distance of p to a part of t, by the table."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def noisy(rng, text, rate):
    out = []
    for c in text:
        z = rng.random()
        if z < rate / 3:
            continue
        if z < rate:
            out.append(rng.choice("abcdefgh"))
        if z >= 2 * rate / 3:
            out.append(c)
    return "".join(out)


def test_distance():
    rng = random.Random(1)
    for _ in range(600):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(0, n))) for n in (12, 20))
        assert D.best_distance(p, t) == edit(p, t)
    p, t = ("".join(rng.choice("abcd ") for _ in range(n)) for n in (150, 260))
    assert D.best_distance(p, t) == edit(p, t)


def test_symbols_of_words():
    words = [b"the", b"(a)", b"--", b"x", "\u00e9t\u00e9".encode(), b"it's", b'"to"', b"ab,"]
    packed, starts = D.word_symbols(b" ".join(words))
    assert starts.tolist() == [sum(len(w) + 1 for w in words[:k]) for k in range(len(words))]
    for p, word in zip(packed.tolist(), words):
        plain = word.strip(D._STRIPPED) or word
        assert p == int.from_bytes(plain[:2], "big") | int.from_bytes(plain[-2:], "big") << 16 | plain[0] << 32


def test_walks_fall_into_step_again():
    """The embeddings of sequences one edit apart differ in few places."""
    rng, same, walks = random.Random(2), [], D.Walks(D.SAMPLED)
    for _ in range(60):
        words = np.array([int(D.word_symbols(bytes(rng.choices(range(97, 123), k=5)))[0][0]) for _ in range(30)] + [0] * walks.steps, np.int64)
        keys = walks.keys(words, np.arange(20), 0)
        assert (keys == walks.keys(words.copy(), np.arange(20), 0)).all()
        other = np.delete(words, 3)
        assert (walks.keys(other, np.arange(3, 19), 0) == walks.keys(words, np.arange(4, 20), 0)).all()
        same.append((walks.keys(other, np.arange(3), 0) == walks.keys(words, np.arange(3), 0)).mean())
    assert np.mean(same) > 0.1


def items(rng, n):
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    return words, [(i, " ".join(rng.choice(words) for _ in range(rng.randint(12, 50)))) for i in range(n)]


def test_recall_of_exact_and_edited_passages(spark):
    rng = random.Random(3)
    words, benchmark = items(rng, 80)
    docs = []
    for i, (_, text) in enumerate(benchmark):
        before, after = (" ".join(rng.choice(words) for _ in range(rng.randint(0, 200))) for _ in range(2))
        docs += [(10 * i + k, f"{before}{glue}{noisy(rng, text, rate)}{glue}{after}") for k, (rate, glue) in enumerate([(0, " "), (0, "\n\t "), (0.03, " "), (0.06, " ")])]
        docs.append((10 * i + 9, f"{before} {after}"))
    found = D.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(benchmark, "item_id long, text string")).collect()
    hit = {r.doc_id: r for r in found}
    assert all(r.item_id == r.doc_id // 10 and r.similarity >= 0.8 for r in found)
    assert all(10 * i + k in hit and hit[10 * i + k].distance == 0 for i in range(80) for k in (0, 1))
    assert sum(10 * i + 2 in hit for i in range(80)) >= 78 and sum(10 * i + 3 in hit for i in range(80)) >= 70
    assert not any(10 * i + 9 in hit for i in range(80))


def test_edits_all_over_against_brute_force():
    """Characters changed evenly or at random, down to the least similarity and for short items: what the
    distance to the whole text admits is found, with its distance, and nothing else."""
    rng = random.Random(11)
    words, _ = items(rng, 0)
    benchmark, docs = [], []
    for n in (2, 4, 6, 8, 11, 16, 20, 30, 40, 60):
        for gap in (5, 6, 8, 10, 14, 20, 0):
            text = " ".join(rng.choice(words) for _ in range(n))
            benchmark.append((len(benchmark), text.encode()))
            if gap:
                at = set(range(rng.randrange(gap), len(text), gap))
            else:
                at = set(rng.sample(range(len(text)), len(text) // 6))
            edited = "".join(rng.choice(["", "é", "q" + c, "z"]) if i in at else c for i, c in enumerate(text))
            docs.append(" ".join([*(rng.choice(words) for _ in range(rng.randint(0, 40))), edited, *(rng.choice(words) for _ in range(rng.randint(0, 40)))]))
    want = {}
    for row, doc in enumerate(docs):
        for item, (_, text) in enumerate(benchmark):
            pattern = text.decode()
            d = D.best_distance(pattern, " ".join(doc.split()))
            if d <= 0.2 * len(pattern) + 1e-9:
                want[row, item] = d
    got = {(row, item): d for row, item, _, d in D._matches(D.ItemIndex(benchmark, thorough=True), [d.encode() for d in docs])}
    assert sum(a == b for a, b in want) >= 60 and got == want
    walked = {(row, item): d for row, item, _, d in D._matches(D.ItemIndex(benchmark), [d.encode() for d in docs])}
    assert walked.items() <= want.items() and len(walked) >= 0.9 * len(want)


def test_recall_by_similarity_of_items_found_by_walks():
    """Random edits of items of 12 to 60 words; the shares are those the README states, less a margin."""
    rng = random.Random(12)
    words, _ = items(rng, 0)
    for n, least in ((12, (0.6, 0.85, 0.95, 1.0)), (25, (0.85, 0.95, 1.0, 1.0)), (50, (0.95, 1.0, 1.0, 1.0))):
        benchmark = [(i, " ".join(rng.choice(words) for _ in range(n)).encode()) for i in range(100)]
        index = D.ItemIndex(benchmark)
        for similarity, share in zip((0.8, 0.85, 0.9, 0.95), least):
            docs = []
            for _, text in benchmark:
                pattern = text.decode()
                at = set(rng.sample(range(len(pattern)), int((1 - similarity) * len(pattern))))
                edited = "".join(rng.choice(["", "é", "q" + c, "z"]) if i in at else c for i, c in enumerate(pattern))
                docs.append(f"{' '.join(rng.choice(words) for _ in range(30))} {edited} {' '.join(rng.choice(words) for _ in range(30))}".encode())
            got = {(row, item) for row, item, _, _ in D._matches(index, docs)}
            assert sum((i, i) in got for i in range(100)) >= 100 * share and all(a == b for a, b in got)


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "so we say The Quick brown\nfox, always"), (2, "the quick fox"), (3, "alone")], "doc_id long, text string")
    benchmark = spark.createDataFrame([("a", "the quick brown fox"), ("b", "Alone"), ("c", ""), ("d", None)], "item_id string, text string")
    assert sorted((r.doc_id, r.item_id, r.distance) for r in D.find_items(docs, benchmark).collect()) == [(1, "a", 0), (3, "b", 0)]


def test_passes_over_many_items(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEMS_OF_PASS", 7)
    rng = random.Random(4)
    _, benchmark = items(rng, 40)
    docs = spark.createDataFrame(benchmark, "doc_id long, text string")
    found = D.find_items(docs, spark.createDataFrame(benchmark, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(i, i) for i in range(40)]


def test_given_documents(spark):
    docs, benchmark = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    rows = benchmark.collect()
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in rows if i.text in d.text}
    got = {(r.doc_id, r.item_id): r.distance for r in D.find_items(docs, benchmark).collect()}
    assert want and want <= set(got) and all(got[x] == 0 for x in want)
    kept = {r.doc_id for r in D.without_items(docs, benchmark).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in got}


def test_awkward_rows(spark, awkward, empty):
    benchmark = spark.createDataFrame([(1, "cat sat on the mat and looked at the dog in the yard"), (2, None), (3, "")], "item_id int, text string")
    assert sorted(r.doc_id for r in D.find_items(awkward, benchmark).collect()) == [1, 6]
    kept = D.without_items(awkward, benchmark)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 2
    assert D.find_items(empty, benchmark).count() == 0 and D.find_items(awkward, benchmark.where("false")).count() == 0
    assert list(D._matches(D.ItemIndex([]), [b"a b c"])) == []


def test_the_query_finds_what_walks_miss(spark, tmp_path):
    """Every fifth character changed: walks alone miss some of these passages, the query none."""
    rng = random.Random(21)
    words, _ = items(rng, 0)
    benchmark = [(i, " ".join(rng.choice(words) for _ in range(12))) for i in range(40)]
    docs = [(i, "".join("é" if k % 5 == 4 else c for k, c in enumerate(text))) for i, text in benchmark]
    want = {(i, i) for i, text in benchmark if D.best_distance(text, " ".join(docs[i][1].split())) <= D.allowed_edits(len(text), D.SIMILARITY)}
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    walked = {(row, item) for row, item, _, _ in D._matches(D.ItemIndex([(i, t.encode()) for i, t in benchmark]), [t.encode() for _, t in docs])}
    got = {(r.doc_id, r.item_id) for r in D.op9_benchmark_decontamination(spark, str(tmp_path)).collect()}
    assert len(want) >= 30 and not want <= walked and want <= got
