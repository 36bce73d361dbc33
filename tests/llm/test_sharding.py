from collections import Counter

from pyspark.sql import functions as F

from quire.llm.sharding import communication_matrix, hypergeometric, shuffle_into_shards


def test_shards_are_even_and_slots_gapless(spark):
    df = spark.range(0, 10_007, numPartitions=7).withColumnRenamed("id", "doc_id")
    rows = shuffle_into_shards(df, 8).collect()
    assert sorted(r.doc_id for r in rows) == list(range(10_007))
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))


def test_shuffle_is_mixed(spark):
    df = spark.range(0, 8000, numPartitions=5).withColumnRenamed("id", "doc_id")
    rows = shuffle_into_shards(df, 4).collect()
    for s in range(4):  # every shard draws from all over, and slots don't follow the ids
        ids = [r.doc_id for r in sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)]
        assert abs(sum(ids) / len(ids) - 4000) < 250
        rising = sum(a < b for a, b in zip(ids, ids[1:])) / len(ids)
        assert 0.45 < rising < 0.55


def test_seed_decides(spark):
    df = spark.range(0, 500, numPartitions=3)
    one, two, other = (sorted(map(tuple, shuffle_into_shards(df, 3, seed).collect())) for seed in (1, 1, 2))
    assert one == two and one != other


def test_matrix_has_exact_margins(spark):
    counts = spark.createDataFrame([(0, 100), (1, 0), (2, 37), (5, 400)], "part long, rows long")
    got = {r.part: r.taken for r in communication_matrix(counts, 3, 4).collect()}
    assert {p: sum(t) for p, t in got.items()} == {0: 100, 2: 37, 5: 400}
    assert [sum(t[s] for t in got.values()) for s in range(3)] == [179, 179, 179]


def test_hypergeometric_draws(spark):
    df = spark.range(20_000).select(hypergeometric(F.lit(30).cast("long"), F.lit(70).cast("long"), F.lit(20).cast("long"), F.rand(3)).alias("x"))
    mean, var, low, high = df.agg(F.avg("x"), F.var_samp("x"), F.min("x"), F.max("x")).first()
    assert abs(mean - 6) < 0.05 and abs(var - 20 * 0.3 * 0.7 * 80 / 99) < 0.15 and low >= 0 and high <= 20


def test_awkward_rows(awkward, empty):
    rows = shuffle_into_shards(awkward, 4).collect()
    assert len(rows) == awkward.count() and sorted(Counter(r.shard for r in rows).values()) == [2, 3, 3, 3]
    assert shuffle_into_shards(empty, 4).count() == 0
    assert shuffle_into_shards(awkward, 100).agg(F.max("slot")).first()[0] == 0
