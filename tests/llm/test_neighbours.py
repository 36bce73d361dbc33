import numpy as np
from pyspark.sql import functions as F

from quire.llm import neighbours


def exact(ids, x, queries, k):
    out = {}
    for q in queries:
        s = x @ x[list(ids).index(q)]
        order = sorted((-round(float(v), 12), i) for v, i in zip(s, ids) if i != q)[:k]
        out[q] = [i for _, i in order]
    return out


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = neighbours.hilbert_keys(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        walk = grid[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_recall_on_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()
    want = exact(ids, x, [i for i in ids if i % 20 == 0], 20)
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(found) == set(want) and all(sorted(f) == list(range(1, 21)) for f in found.values())
    assert sum(len({i for i, _ in found[q].values()} & set(w)) for q, w in want.items()) / (20 * len(want)) >= 0.9
    place = {i: n for n, i in enumerate(ids)}
    for q, f in found.items():
        scores = [f[r][1] for r in range(1, 21)]
        assert scores == sorted(scores, reverse=True)
        assert all(abs(s - x[place[q]] @ x[place[i]]) < 1e-12 for i, s in f.values())


def test_unequal_lengths(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 12)) * rng.uniform(0.2, 3, (600, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 10 == 0, k=5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact(range(600), x, range(0, 600, 10), 5)
    assert sum(len(got[q] & set(w)) for q, w in want.items()) / (5 * len(want)) >= 0.9


def test_copies_ties_and_unusable_vectors(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.6, 0.8, 0.0]
    rows = [(i, a, "x") for i in range(50)] + [(100, b, "x"), (101, c, "x"), (101, c, "x"), (200, None, "x"), (201, [], "x"), (202, [0.0, 0.0, 0.0], "x"),
            (203, [1.0, None, 0.0], "x"), (204, [float("nan"), 1.0, 0.0], "x"), (205, [float("inf"), 1.0, 0.0], "x"), (206, [1.0, 0.0], "x"), (None, a, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id").isin(3, 40, 100, 200, 206)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[3] == [0, 1, 2, *range(4, 21)] and got[40] == list(range(20))  # ties to the smaller id, the own row left out
    assert got[100] == [101, *range(19)] and set(got) == {3, 40, 100}


def test_few_or_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [0.0, -1.0])], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.lit(True)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 2), (3, 2, 1)]
    assert neighbours.nearest(df.where("false"), F.lit(True)).count() == 0
    assert neighbours.nearest(df, F.lit(False)).count() == 0


def test_salted_groups_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 6)))], "vec_id long, embedding array<double>")
    one = sorted(map(tuple, neighbours.nearest(df, F.col("vec_id") % 3 == 0, k=4).collect()))
    monkeypatch.setattr(neighbours, "GROUP_QUERIES", 4)
    assert sorted(map(tuple, neighbours.nearest(df, F.col("vec_id") % 3 == 0, k=4).collect())) == one
