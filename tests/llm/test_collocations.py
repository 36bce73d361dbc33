"""Collocations against a plain count, whatever the sample proposes."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quire.llm import collocations as C
from quire.llm.collocations import Known, collocations, joined, op12_collocations, phrase_counts, phrase_key, words_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, most=3):
    """rows of (lang, text): occurrences of every phrase in each language, and all words."""
    counts = {}
    for lang, text in rows:
        seen = counts.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            seen[()] += len(words)
            for n in range(1, most + 1):
                seen.update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    return counts


def plain(rows, least=10, top=2000, most=3, covered=50):
    out = []
    for lang, f in plain_counts(rows, most).items():
        candidates = {p for p, a in f.items() if len(p) >= 2 and a >= least}
        kept = [p for p in candidates if not any(len(q) > len(p) and 100 * f[q] >= covered * f[p] and any(q[i:i + len(p)] == p for i in range(len(q))) for q in candidates)]
        scored = []
        for p in kept:
            score, k = min((1_000_000 * f[p] * f[p] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((score, f[p], " ".join(p), f[p[:k]], f[p[k:]]))
        scored.sort(key=lambda s: (-s[0], -s[1], s[2].encode()))
        out += [(lang, i + 1, p, a, left, right, f[()], score) for i, (score, a, p, left, right) in enumerate(scored[:top])]
    return sorted(out)


def corpus(seed=1, docs=300):
    """Words of falling frequency, set phrases, pieces, several languages and runs of one word."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 3) for i in range(400)]
    phrases = [["New", "York", "city"], ["ad", "hoc"], ["é", "ü\x00x", "ß"], ["rare", "pair"]]
    rows = []
    for _ in range(docs):
        words = []
        for _ in range(rng.randrange(0, 120)):
            words += rng.choice(phrases) if rng.random() < 0.06 else rng.choices(vocabulary, weights)
            if rng.random() < 0.15:
                words[-1] += rng.choice([".", ",", "\n", "\r\n", ";", "!?", "\x0b"])
        rows.append((rng.choice(["en", "en", "de", None, "und"]), rng.choice([" ", "  ", "\t", " \t"]).join(words)))
    return rows + [("en", "ha " * 40), ("en", None), ("fr", ""), ("fr", " . "), ("xx", "one two " * 12)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")


def test_hashes_of_phrases():
    words = [b"a", b"bc", b"\xc3\xa9"]
    hashes = np.array([C._word_hash(w) for w in words], np.uint64)
    levels = C.Levels("en", hashes, 3)
    assert [int(k[0]) for k in levels.keys] == [phrase_key("en", words[:n]) for n in (1, 2, 3)]
    assert phrase_key("en", words) != phrase_key("de", words) and joined(hashes, hashes).dtype == np.uint64
    assert words_of("A\tB.c  d\x0bE".encode()) == [b"a", b"b", b".", b"c", b"d", b".", b"e", b"."]
    assert words_of(None) == words_of(b"") == [b"."]


def test_a_bit_table_forgets_none(spark):
    keys = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5000)
    known = Known.of(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert known.has(keys.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 1 << 63, 100_000).view(np.uint64)
    assert known.has(others).mean() < 0.05
    assert not Known.of(spark.createDataFrame([], "key long")).has(others).any()


@pytest.mark.parametrize(("sample", "in_sample", "bits", "chunk"), [(8, 2, 1 << 28, 1 << 20), (1, 2, 1 << 28, 500), (10**9, 2, 1 << 28, 1 << 20), (2, 40, 1 << 28, 2000), (8, 2, 1 << 16, 1 << 20)])
def test_equals_a_plain_count_whatever_is_proposed(spark, monkeypatch, sample, in_sample, bits, chunk):
    """All documents as the sample, none, a hard threshold (nearly all phrases fail the border) and a bit table
    that takes many phrases for proposed ones."""
    for name, value in (("SAMPLE", sample), ("LEAST_IN_SAMPLE", in_sample), ("MOST_BITS", bits), ("CHUNK_WORDS", chunk), ("LEAST_RANGES", 16)):
        monkeypatch.setattr(C, name, value)
    rows = corpus()
    counts = phrase_counts(frame(spark, rows).repartition(3)).collect()
    want = {(lang, " ".join(p)): n for lang, f in plain_counts(rows).items() for p, n in f.items() if n >= 10 or (not p and n)}
    assert {(r.lang, r.phrase): r.n for r in counts if r.n} == want
    assert len(counts) == len({(r.lang, r.phrase) for r in counts})


def test_collocations_equal_a_plain_ranking(spark, monkeypatch):
    monkeypatch.setattr(C, "LEAST_RANGES", 16)
    rows = corpus(2)
    got = collocations(phrase_counts(frame(spark, rows))).collect()
    assert sorted(tuple(r) for r in got) == plain(rows)
    phrases = {(r.lang, r.phrase) for r in got}
    assert ("en", "new york city") in phrases and ("en", "new york") not in phrases
    top = sorted(tuple(r) for r in collocations(phrase_counts(frame(spark, rows)), top=3).collect())
    assert top == [r for r in plain(rows) if r[1] <= 3]


def test_phrases_of_four_words(spark, monkeypatch):
    monkeypatch.setattr(C, "LEAST_RANGES", 16)
    rows = corpus(3, 120) + [("en", "to be or not " * 15)]
    assert sorted(tuple(r) for r in collocations(phrase_counts(frame(spark, rows), most=4)).collect()) == plain(rows, most=4)


def test_products_beyond_64_bits(spark):
    n = 4_000_000_000_000
    counts = spark.createDataFrame([("en", "a", 1, n), ("en", "b", 1, n + 7), ("en", "a b", 2, n - 1), ("en", "", 0, 9 * n)], "lang string, phrase string, words int, n long")
    assert [tuple(r) for r in collocations(counts).collect()] == [("en", 1, "a b", n - 1, n, n + 7, 9 * n, 1_000_000 * (n - 1) ** 2 // (n * (n + 7)))]


def test_awkward_and_empty_tables(spark, awkward, empty, monkeypatch):
    monkeypatch.setattr(C, "LEAST_RANGES", 16)
    rows = [(r.lang, r.text) for r in awkward.collect()]
    assert sorted(tuple(r) for r in collocations(phrase_counts(awkward)).collect()) == plain(rows)
    assert collocations(phrase_counts(empty)).collect() == []


def test_query_equals_plain_on_the_given_table(spark):
    import pyarrow.parquet as pq
    sf = "/root/testdata/sf0.001"
    rows = [(r["lang"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    assert sorted(tuple(r) for r in op12_collocations(spark, sf).collect()) == plain(rows)
