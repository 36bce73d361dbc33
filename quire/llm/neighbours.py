"""Approximate nearest neighbours by shifted space-filling curves.

Every curve projects the vectors to a few random orthogonal directions, scales them by the data's
mean and spread, shifts them by a random vector and orders them along a Hilbert curve.  The
order of each curve is cut into blocks of equal size; a query looks at its own block and the two
beside it, so neighbours that one curve parts are met on another.  Each block keeps the best of
its rows for each query; the curves' results merge and are scored again exactly.

For inner products of vectors of unequal length, candidates get one more component that
brings all to the same length and queries a zero there: then the nearest is the largest product.
Rows with the same vector enter the curves once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import read_table, store

#: Curves, projected directions and bits of each, blocks of a curve.
CURVES, DIRECTIONS, BITS, BLOCKS = 12, 8, 4, 20
#: A block holds at least so many rows for each neighbour asked for (with few rows, there are fewer blocks).
ROWS_OF_BLOCK = 4
#: Queries that one group of a block holds at most, on average; beyond, groups are salted.
GROUP_QUERIES = 8192
#: Rows that are scored at once.
CHUNK = 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of grid cells (rows of ``bits``-bit coordinates), by Skilling's
    transposition."""
    x = cells.T.astype(np.uint64).copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        low = np.uint64(q - 1)
        for i in range(n):
            high = (x[i] & np.uint64(q)) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & (F.size(x) > 0) & ~bad & F.exists(x, lambda v: v != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _moments(reps: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray, float]:
    """Count, mean, covariance and largest squared length of the vectors, summed in two steps."""
    schema = "n long, first binary, second binary, longest double"

    def rows(n, first, second, longest):
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([first.tobytes()], pa.binary()),
                                           pa.array([second.tobytes()], pa.binary()), pa.array([longest], pa.float64())],
                                          names=["n", "first", "second", "longest"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second, longest = 0, np.zeros(width), np.zeros((width, width)), 0.0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                n, first, second = n + len(x), first + x.sum(axis=0), second + x.T @ x
                longest = max(longest, float((x * x).sum(axis=1).max()))
        yield rows(n, first, second, longest)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second, longest = 0, np.zeros(width), np.zeros((width, width)), 0.0
        for batch in batches:
            for k, a, b, top in zip(*(c.to_pylist() for c in batch.columns)):
                n, longest = n + k, max(longest, top)
                first, second = first + np.frombuffer(a), second + np.frombuffer(b).reshape(width, width)
        yield rows(n, first, second, longest)

    n, first, second, longest = 0, np.zeros(width), np.zeros((width, width)), 0.0
    for r in reps.select("vector").mapInArrow(measure, schema).repartition(16).mapInArrow(add, schema).collect():
        n, longest = n + r[0], max(longest, r[3])
        first, second = first + np.frombuffer(bytes(r[1])), second + np.frombuffer(bytes(r[2])).reshape(width, width)
    mean = first / max(n, 1)
    return n, mean, second / max(n, 1) - np.outer(mean, mean), longest


class Curves:
    """The random directions and shifts of all curves, scaled by the data's moments."""

    def __init__(self, width: int, mean: np.ndarray, covariance: np.ndarray, longest: float, even: bool, seed: int):
        rng = np.random.default_rng(seed)
        self.longest, self.even, self.parts = longest, even, []
        full = width + (not even)
        for _ in range(CURVES):
            turn = np.linalg.qr(rng.normal(size=(full, full)))[0][:, :min(DIRECTIONS, full)]
            flat = turn[:width]
            spread = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", flat, covariance, flat), 1e-18))
            self.parts.append((turn, mean @ flat, spread, rng.uniform(0, 0.5, turn.shape[1])))

    def keys(self, x: np.ndarray, query: bool) -> Iterator[np.ndarray]:
        if not self.even:
            last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0))
            x = np.column_stack([x, last])
        for turn, middle, spread, shift in self.parts:
            y = (x @ turn - middle) / spread
            u = 1 / (1 + np.exp(-np.clip(1.702 * y, -30, 30)))  # nearly the normal distribution function
            cells = ((u * 0.999 + shift) / 1.5 * (1 << BITS)).astype(np.int64)
            yield hilbert_keys(cells, BITS)


def _keyed(rows: DataFrame, curves: Curves, query: bool) -> DataFrame:
    """A row for each curve: its number, the key, then low bits of a hash against ties."""
    shared = rows.sparkSession.sparkContext.broadcast(curves)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rep = np.asarray(batch.column(0), np.int64)
            tie = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(34)
            for curve, key in enumerate(shared.value.keys(_matrix(batch.column(1)), query)):
                place = ((key << np.uint64(30)) | tie).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(rep), curve, np.int32)), pa.array(place)], names=["rep", "curve", "place"])

    return rows.select("rep", "vector").mapInArrow(order, "rep long, curve int, place long")


def _best_of_blocks(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` (curve, block, salt, side 0 for queries or 1, rep, vector) to (query, rep, score): in each
    group the k best rows of each query; candidates stream past the group's queries."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, queries, best = None, [], None

        def finish():
            if best is None:
                return None
            ids = np.concatenate([q for q, _ in queries])
            parts = [(np.full(len(r), i), r, s) for i, (r, s) in zip(ids, best) if len(r)]
            if not parts:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[j] for p in parts])) for j in range(3)], names=["query", "rep", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            heads = np.column_stack([np.asarray(batch.column(i), np.int64) for i in range(4)])
            cuts = np.flatnonzero((heads[1:] != heads[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(heads)]):
                if tuple(heads[a][:3]) != group:
                    if (out := finish()) is not None:
                        yield out
                    group, queries, best = tuple(heads[a][:3]), [], None
                for at in range(a, b, CHUNK):
                    part = batch.slice(at, min(CHUNK, b - at))
                    rep, x = np.asarray(part.column(4), np.int64), _matrix(part.column(5))
                    if heads[a][3] == 0:
                        queries.append((rep, x))
                        continue
                    if not queries:
                        continue
                    if best is None:
                        ask = np.concatenate([x for _, x in queries])
                        best = [(np.empty(0, np.int64), np.empty(0))] * len(ask)
                    scores = ask @ x.T
                    edge = np.partition(scores, -k, axis=1)[:, -k] if len(rep) > k else np.full(len(ask), -np.inf)
                    for i, (r, s) in enumerate(best):
                        low = edge[i] if len(r) < k else max(edge[i], s[-1])
                        new = np.flatnonzero(scores[i] >= low)
                        if len(new):
                            r, s = np.concatenate([r, rep[new]]), np.concatenate([s, scores[i][new]])
                            order = np.lexsort((r, -s))[:k]
                            best[i] = r[order], s[order]
        if (out := finish()) is not None:
            yield out

    return (rows.repartition("curve", "block", "salt").sortWithinPartitions("curve", "block", "salt", "side")
            .select("curve", "block", "salt", "side", "rep", "vector").mapInArrow(scan, "query long, rep long, score double"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 3) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds the ``k`` rows found with the
    largest inner product (in double precision, on the original vectors), the query's own row left out;
    ties go to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those
    whose number of components is not the most frequent one (ties: the smaller number).  Rows with a
    null id take no part.  Repeated rows count as rows with the same vector; of a repeated id one row
    counts.  Fewer than ``k`` candidates give fewer rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    out_schema = "query_id long, rank int, vec_id long, score double"
    rows = (vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"),
                    F.coalesce(is_query, F.lit(False)).alias("asks")))
    width = rows.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        return spark.createDataFrame([], out_schema)
    width = int(width[0])
    rows = (rows.where(F.size("vector") == width).withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector")))
    # the k + 1 smallest ids of each vector suffice as candidates; Spark limits groups before the shuffle
    number = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    copies = store(rows.select("h1", "h2", "id").distinct().withColumn("number", number).where(F.col("number") <= k + 1)
                   .groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")), "near-copies")
    asking = store(rows.where("asks").select("h1", "h2", "id").distinct().join(copies.select("h1", "h2", "rep"), ["h1", "h2"]).select("id", "rep"), "near-queries")
    reps = store(rows.join(copies.select("rep"), F.col("id") == F.col("rep"), "left_semi").select(F.col("id").alias("rep"), "vector").dropDuplicates(["rep"]), "near-vectors")
    query_reps = asking.select("rep").distinct()

    number_of_reps, mean, covariance, longest = _moments(reps, width)
    blocks = min(BLOCKS, number_of_reps // (ROWS_OF_BLOCK * (k + 1)))
    blocks = blocks if blocks >= 3 else 1
    # one length for all (but for rounding): no further component is needed
    shortest = reps.agg(F.min(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    curves = Curves(width, mean, covariance, longest, (longest - shortest) <= 1e-5 * longest, seed)
    asked = reps.join(query_reps, "rep", "left_semi")
    keyed = store(_keyed(reps, curves, False), "near-keys")
    block = F.lit(0)
    if blocks > 1:
        cuts = {r[0]: list(r[1]) for r in keyed.groupBy("curve").agg(
            F.percentile_approx("place", [i / blocks for i in range(1, blocks)], 10_000)).collect()}  # a few numbers for each curve
        ends = F.element_at(F.array(*[F.array(*[F.lit(int(c)).cast("long") for c in cuts[i]]) for i in range(CURVES)]), F.col("curve") + 1)
        block = F.aggregate(ends, F.lit(0), lambda s, e: s + F.when(F.col("place") > e, 1).otherwise(0))
    salts = max(1, math.ceil(min(3, blocks) * query_reps.count() / blocks / GROUP_QUERIES))
    candidates = keyed.withColumn("block", block).select("curve", "block", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(1).alias("side"), "rep")
    middle = F.greatest(F.lit(1), F.least(F.lit(blocks - 2), F.col("block")))
    looked_at = F.array(middle - 1, middle, middle + 1) if blocks > 1 else F.array(F.lit(0))
    queries = (_keyed(asked, curves, True).withColumn("block", block)
               .select("curve", F.explode(looked_at).alias("block"), F.pmod(F.xxhash64("rep"), F.lit(salts)).cast("int").alias("salt"),
                       F.lit(0).alias("side"), "rep"))
    best = _best_of_blocks(candidates.union(queries).join(reps, "rep"), k + 1)
    own = query_reps.select(F.col("rep").alias("query"), "rep", F.lit(float("inf")).alias("score"))
    merged = best.union(own).groupBy("query", "rep").agg(F.max("score").alias("score"))
    top = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))
    pairs = merged.withColumn("n", top).where(F.col("n") <= k + 2).select("query", "rep")
    scored = (pairs.join(reps.select(F.col("rep").alias("query"), F.col("vector").alias("a")), "query")
              .join(reps.select("rep", F.col("vector").alias("b")), "rep")
              .select("query", "rep", F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("score")))
    found = (scored.join(copies.select("rep", "ids"), "rep").select("query", F.explode("ids").alias("vec_id"), "score")
             .join(asking.select(F.col("id").alias("query_id"), F.col("rep").alias("query")), "query").where("vec_id != query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each vector whose id is divisible by 20, among all others."""
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
