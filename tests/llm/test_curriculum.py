"""Mixing: targets, taken words and positions against a plain walk, and its awkward tables."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quire.llm import curriculum
from quire.llm.curriculum import mixed, training_order, turning_schedules


def plain_targets(sizes: dict, weights: dict, total: float, most: int) -> dict:
    """Share by weight; who is above his cap is capped and the rest shared anew, until none is above."""
    out, free = {}, {s for s in sizes if weights[s] > 0}
    while free:
        level = (total - sum(out.values())) / sum(weights[s] for s in free)
        above = {s for s in free if weights[s] * level >= most * sizes[s]}
        if not above:
            out |= {s: weights[s] * level for s in free}
            break
        out |= {s: float(most * sizes[s]) for s in above}
        free -= above
    return {s: out.get(s, 0.0) for s in sizes}


def plain(rows, weights, schedules, share, most, steps=200_000):
    """Taken words by a walk over copies in the order of hashes; positions by small steps of progress."""
    words = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    sizes = {}
    for _, s, n in words:
        sizes[s] = sizes.get(s, 0) + n
    target = plain_targets(sizes, weights, share * sum(sizes.values()), most)
    out = []
    for source in sizes:
        mine = sorted((r for r in words if r[1] == source), key=lambda r: hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:16])
        taken, left = [[] for _ in mine], int(target[source])
        for _ in range(most):
            for k, (_, _, n) in enumerate(mine):
                taken[k].append(min(left, n))
                left -= min(left, n)
        out += [(i, n, sizes[source], pytest.approx(target[source]), sum(c)) for (i, _, n), c in zip(mine, taken)]
    return out


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range((i * 37) % 90)), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(1, 400)]
    rows += [(400, None, "s1"), (401, "", "s2"), (402, "x " * 3000, None), (403, "y", "tiny"), (404, "", "void")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def keyed(row):
    return (row[0] is None, row[0] or 0, row[1])


@pytest.mark.parametrize("bucket_rows", [512, 4])
def test_equals_a_plain_walk(texts, monkeypatch, bucket_rows):
    monkeypatch.setattr(curriculum, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(curriculum, "SPAN_BUCKETS", 8)
    rows, docs = texts
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    want = sorted(plain(rows, weights, None, 1.5, 2), key=keyed)
    got = sorted([tuple(r)[:5] for r in mixed(docs, turning_schedules(docs)).collect()], key=keyed)
    assert got == want
    assert sum(r[4] for r in got) == pytest.approx(1.5 * sum(r[1] for r in got), rel=0.001)
    assert all(r[4] <= 2 * r[1] for r in got)


def test_positions_follow_the_schedules(spark):
    """One source only rises, one only falls: at a tenth of the training, the words up to there are those
    that both demands' integrals ask for."""
    docs = spark.createDataFrame([(i, "a b c d e f g h i j", "up" if i % 2 else "down") for i in range(2000)], "doc_id long, text string, source string")
    schedules = spark.createDataFrame([("up", [0.0, 1.0, 2.0]), ("down", [2.0, 1.0, 0.0])], "source string, weights array<double>")
    order = training_order(mixed(docs, schedules, (0.0, 0.25, 1.0), share=1.0)).join(docs.select("doc_id", "source"), "doc_id").toPandas().sort_values("position")
    integral = {"up": 0.125 + 1.125, "down": 0.375 + 0.375}
    total = 20_000
    aimed = {s: total * integral[s] / 2.0 for s in integral}  # neither is above twice its size
    assert {s: order[order.source == s].words.sum() for s in integral} == {s: int(x) for s, x in aimed.items()}
    for t in (0.1, 0.25, 0.5, 0.9):
        asked = {"up": (2 * t * t if t <= 0.25 else 0.125 + (t - 0.25) * (1 + 1 + (t - 0.25) / 0.75) / 2) / integral["up"] * aimed["up"],
                 "down": (2 * t - 2 * t * t if t <= 0.25 else 0.375 + (t - 0.25) * (1 + 1 - (t - 0.25) / 0.75) / 2) / integral["down"] * aimed["down"]}
        early = order[order.position < sum(asked.values())]
        for s in asked:
            assert abs(early[early.source == s].words.sum() - asked[s]) <= 20
    assert order.position.between(0, total).all()
    # positions keep step with the words in front of them
    assert (order.words.cumsum() - order.position).abs().max() <= 40


def test_caps_and_missing_schedules(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "c d e f", "y"), (3, "g", "z")], "doc_id long, text string, source string")
    schedules = spark.createDataFrame([("x", [5.0, 5.0]), ("y", [-1.0, None]), ("w", [1.0, 1.0])], "source string, weights array<double>")
    got = {r.doc_id: (r.target, r.taken, [c.words for c in r.copies]) for r in mixed(docs, schedules).collect()}
    assert got == {1: (4.0, 4, [2, 2]), 2: (0.0, 0, []), 3: (0.0, 0, [])}
    with pytest.raises(ValueError):
        mixed(docs, schedules, (0.0, 0.5))


def test_awkward_and_empty_tables(awkward, empty):
    got = mixed(awkward, turning_schedules(awkward)).collect()
    assert len(got) == awkward.count()
    assert all((r.size == 0) == (r.taken == 0 and not r.copies) or r.size > 0 for r in got)
    assert sorted(r.size for r in got if r.doc_id == 5) == [1, 1]
    assert mixed(empty, turning_schedules(empty)).collect() == []
    assert training_order(mixed(empty, turning_schedules(empty))).collect() == []


def test_reruns_agree_and_the_query_is_sorted(spark):
    sf = "/root/testdata/sf0.001"
    one, two = (curriculum.op13_curriculum_mix(spark, sf).collect() for _ in range(2))
    assert one == two
    first = [r.first_position for r in one if r.first_position is not None]
    assert first == sorted(first) and len(one) == spark.read.parquet(f"{sf}/documents.parquet").select(F.count("*")).first()[0]
