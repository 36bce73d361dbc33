"""Vector codes: equal to plain k-means on integers; the bounds never change a result."""

import hashlib
import math

import numpy as np
import pytest

from quire.llm import veccodes
from quire.llm.veccodes import Bounds, assign, fitted_kept, learn_codes, op11_vector_codes


def plain(rows, entries=16, rounds=6, parts=8):
    """rows of (id, vector, label): codes, errors and codebooks by comparing everything."""
    kept = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    ints = np.array([[math.floor(4096 * v) for v in r[1]] for r in kept], np.int64).reshape(len(kept), parts, -1)
    first = {}
    for (i, _, _), x in sorted(zip(kept, ints.tolist()), key=lambda p: (p[0][0] is None, p[0][0], p[0][1])):
        if i is not None:
            first.setdefault(i, x)
    books = np.array([first[i] for i in sorted(first)[:entries]], np.int64).transpose(1, 0, 2).copy()

    def codes():
        squared = ((ints[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return squared.argmin(axis=2), squared.min(axis=2).sum(axis=1)  # argmin: the first of ties

    for _ in range(rounds):
        code, _ = codes()
        for p in range(parts):
            for k in range(books.shape[1]):
                mine = ints[code[:, p] == k, p]
                if len(mine):
                    books[p, k] = np.floor_divide(mine.sum(axis=0), len(mine))
    code, error = codes()
    return [(r[0], "".join(f"{k:02x}" for k in c), int(e), r[2]) for r, c, e in zip(kept, code, error)], books


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def key(r):
    return (r[0] is None, r[0] or 0, r[1], r[2])


def vectors(n, width=16, seed=1, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * 0.1
    if clusters:
        x += rng.normal(size=(clusters, width))[rng.integers(0, clusters, n)]
    x = x.astype(np.float32)
    x[n // 2:n // 2 + 5] = x[0]  # ties and copies
    return [(i * 3, [float(v) for v in x[i]], None if i % 11 == 0 else i % 4) for i in range(n)]


@pytest.mark.parametrize("clusters", [0, 5, 40])
def test_equals_plain_rounds(spark, clusters):
    rows = vectors(700, clusters=clusters, seed=clusters)
    rows += [(1, None, 0), (2, [float("nan")] + [0.0] * 15, 0), (4, [float("inf")] * 16, 1), (5, [None] + [0.0] * 15, 1), (None, [0.5] * 16, 9), (9, [-0.25] * 16, 9),
             (9, [-0.25] * 16, 9), (7, [0.0] * 16, None)]
    want, books = plain(rows)
    codes = learn_codes(frame(spark, rows).repartition(5))
    got = [(r["id"], bytes(r["code"]).hex(), r["error"], r["label"]) for r in codes.rows.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert (codes.books == books).all()
    assert codes.sha256() == hashlib.sha256(",".join(str(int(v)) for v in books.reshape(-1)).encode()).hexdigest()


def test_bounds_save_comparisons_and_hold():
    """Over many rounds of small moves: the assigned entry is the nearest, bounds are bounds, few are compared."""
    rng = np.random.default_rng(3)
    book = rng.integers(-4096, 4096, (16, 8))
    x = book[rng.integers(0, 16, 3000)] + rng.integers(-900, 900, (3000, 8))
    bounds, compared, kept = None, [], 4
    moved = None
    for _ in range(8):
        bounds, tested = assign(x, book, moved, bounds, kept)
        squared = ((x[:, None, :] - book) ** 2).sum(axis=2)
        assert (bounds.near[:, 0] == squared.argmin(axis=1)).all()
        distance = np.sqrt(squared)
        assert (bounds.upper >= distance.min(axis=1)).all()
        for z in range(kept):
            behind = distance.copy()
            np.put_along_axis(behind, bounds.near[:, :z + 1].astype(int), np.inf, axis=1)
            assert (bounds.lower[:, z] <= behind.min(axis=1)).all()
        compared.append(int(tested.sum()))
        new = book + rng.integers(-20, 20, book.shape)
        moved = np.sqrt(((new - book) ** 2).sum(axis=1)) * (1 + 1e-12)
        book = new
    assert compared[0] == 3000 * 16 and max(compared[1:]) < compared[0] // 4


def test_ties_go_to_the_lower_index():
    book = np.array([[5, 0], [-5, 0], [0, 5], [0, 5]])
    x = np.array([[0, 0], [0, 9]])
    bounds, _ = Bounds.compared(x, book, 3)
    assert bounds.near[:, 0].tolist() == [0, 2]
    book = np.array([[6, 0], [-5, 0], [5, 0], [0, 5]])  # now 1, 2 and 3 are at the same distance of the first
    bounds, _ = assign(x, book, np.array([1.0, 0.0, 7.1, 0.0]), bounds, 3)
    assert bounds.near[:, 0].tolist() == [1, 3]


def test_kept_entries_follow_the_need():
    assert fitted_kept({1: 1000}, 4, 16) == 2
    assert fitted_kept({1: 100, 4: 900}, 4, 16) == 4
    assert fitted_kept({}, 4, 16) == 4
    assert fitted_kept({1: 5}, 1, 1) == 1


def test_few_ids_one_vector_empty_and_awkward_tables(spark):
    rows = [(3, [0.5] * 8, 1), (3, [0.25] * 8, 1), (None, [9.0] * 8, None), (4, [0.1] * 7, 1), (6, [], 1)]
    want, books = plain([r for r in rows if len(r[1]) == 8])
    codes = learn_codes(frame(spark, rows))
    assert sorted([(r["id"], bytes(r["code"]).hex(), r["error"], r["label"]) for r in codes.rows.collect()], key=key) == sorted(want, key=key)
    assert (codes.books == books).all()
    clash = frame(spark, vectors(60)).selectExpr("*", "1 AS error", "'x' AS code", "2 AS id")
    assert learn_codes(clash).rows.count() == 60
    none = learn_codes(frame(spark, rows).where("false"))
    assert none.rows.collect() == [] and none.books.size == 0 and none.sha256() == hashlib.sha256(b"").hexdigest()
    with pytest.raises(Exception, match="long"):
        learn_codes(frame(spark, [(1, [1e9] * 8, 1)]))
    with pytest.raises(ValueError):
        learn_codes(frame(spark, [(1, [1.0] * 9, 1)]))


def test_query_equals_plain_on_the_given_table(spark):
    import pyarrow.parquet as pq
    sf = "/root/testdata/sf0.001"
    table = pq.read_table(f"{sf}/embeddings.parquet").to_pylist()
    want, books = plain([(r["vec_id"], r["embedding"], r["label"]) for r in table])
    by_label = {}
    for _, _, error, label in want:
        by_label[label] = by_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(int(v)) for v in books.reshape(-1)).encode()).hexdigest()
    got = [tuple(r) for r in op11_vector_codes(spark, sf).collect()]
    assert sorted(got) == sorted((i, c, e, by_label[label], digest) for i, c, e, label in want)
    assert veccodes.ROUNDS == 6
