import itertools
import math
import random
import zlib
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from quire.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def counts_of(lengths):
    out = defaultdict(int)
    for n in lengths:
        out[n] += 1
    return dict(out)


def fewest(lengths, capacity):
    """The smallest number of sequences, by trying all placements."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for r in dict.fromkeys(rooms):
            if r >= lengths[i]:
                rest = list(rooms)
                rest.remove(r)
                place(i + 1, [*rest, r - lengths[i]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0]


def used(patterns):
    return counts_of(itertools.chain.from_iterable(p * t for p, t in patterns))


def test_reduction_keeps_the_optimum():
    rng = random.Random(8)
    for _ in range(400):
        capacity = rng.choice([10, 20, 30])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        fixed, left = packing.reduce_by_dominance(counts_of(lengths), capacity)
        rest = [n for n, c in left.items() for _ in range(c)]
        assert sum(t for _, t in fixed) + fewest(rest, capacity) == fewest(lengths, capacity), (capacity, lengths, fixed, left)


def test_plan_is_whole_and_near_the_optimum():
    rng = random.Random(5)
    worse = 0
    for _ in range(200):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(0, 10))]
        patterns = packing.plan(counts_of(lengths), 30)
        assert used(patterns) == counts_of(lengths) and all(sum(p) <= 30 for p, _ in patterns)
        worse += sum(t for _, t in patterns) > fewest(lengths, 30)
    assert worse <= 4


def test_large_counts():
    rng = random.Random(6)
    counts = {n: rng.randint(0, 10**9) for n in rng.sample(range(1, 1025), 900)}
    patterns = packing.plan(counts, 1024)
    assert used_counts(patterns) == {n: c for n, c in counts.items() if c}
    assert sum(t for _, t in patterns) <= 1.02 * math.ceil(sum(n * c for n, c in counts.items()) / 1024)


def used_counts(patterns):
    out = defaultdict(int)
    for p, t in patterns:
        for n in p:
            out[n] += t
    return dict(out)


def check(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    return len(by)


def test_given_documents_against_the_library(spark):
    tokenizer = Tokenizer.from_file(PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.packed_documents(docs).collect()
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    want = {}
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, packing.END]
        first = len(ids) % 1024 or min(len(ids), 1024)
        ends = [first, *range(first + 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip([0, *ends], ends)):
            want[r.doc_id, k] = (a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b])))
    assert got == want
    assert check(rows) <= 1.02 * math.ceil(sum(r.length for r in rows) / 1024) + 1


def test_special_strings_and_signs():
    tokenizer = Tokenizer.from_file(PATH)
    for text in ("a <|endoftext|> b", "  two  spaces\n\n\tand tabs ", "é漢字\U0001f600", "don't 12345", "\x00\x7f", "x" * 3000):
        assert list(packing.token_ids(text, PATH)) == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_awkward_rows(spark, awkward, empty):
    rows = packing.packed_documents(awkward).collect()
    check(rows)
    assert sorted(r.length for r in rows if r.doc_id in (2, 3)) == [1, 1]
    assert sum(r.doc_id == 5 for r in rows) == 2
    pieces = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 7)
    assert len(pieces) > 50 and all(n == 1024 for _, _, n in pieces[1:])
    assert packing.packed_documents(empty).count() == 0


def test_many_equal_lengths_are_ranked_across_buckets(spark):
    items = spark.range(0, 5000, numPartitions=7).selectExpr("id", "CAST(CASE WHEN id % 3 = 0 THEN 700 ELSE 300 END AS LONG) AS length")
    rows = packing.pack(items).collect()
    assert len(rows) == 5000 and check(rows) == fewest_of_two(5000)


def fewest_of_two(n):
    large = len(range(0, n, 3))
    return large + math.ceil(max(0, n - large - large) / 3)
