"""Vector codes: a codebook for each part of the vectors, learnt with adaptive bounds.

Vectors become integers and are cut into equal parts; each part position has a codebook, improved by
rounds of assigning every part to its nearest entry and moving each entry to its parts' mean.  All
of that is integer arithmetic, so the result is the same in any order of rows.

After Drake and Hamerly, every part keeps from round to round its ``b`` closest entries, nearest first,
an upper bound of its distance to the first, a lower bound for each of the others that also holds for
all entries behind it, and one outer bound for the entries it does not keep.  When the entries have
moved, the bounds give way by the way moved.  If the upper bound is below the bound of place z, the nearest entry
is one of the first z: for z = 1 nothing is computed, else the first z are compared by integers.  Only where the
upper bound passes the outer bound are all entries compared.  After each round ``b`` is fitted to what was needed:
fewer kept entries make a round cheaper, more kept entries avoid full comparisons.

Bounds are 32-bit numbers rounded outward; they only decide what need not be looked at.  Ties and
near-ties always fall to the integer comparison.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from quire.llm.common import read_table, store

#: A component becomes floor(SCALE * x).  Parts of a vector, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Kept entries in the first round, as a share of the entries, and the least number kept.
FIRST_KEPT, LEAST_KEPT = 4, 2
#: Vectors that a worker compares at once.
CHUNK = 4096

STATE = "id {id}, label {label}, ints binary, near binary, bounds binary, code binary, error long, tested binary"


def integers(vector: pa.Array) -> np.ndarray:
    """Rows of floor(SCALE * x)."""
    x = np.asarray(vector.flatten().cast(pa.float64()), np.float64).reshape(len(vector), -1)
    whole = np.floor(x * SCALE)
    if whole.size and np.abs(whole).max() >= math.isqrt((1 << 61) // whole.shape[1]):
        raise ValueError(f"components reach {np.abs(x).max()}: squared distances would not fit a long")
    return whole.astype(np.int64)


def _down(x: np.ndarray) -> np.ndarray:
    """32-bit numbers not above ``x``, whose own rounding error is far below the margin."""
    return np.nextafter((x * (1 - 1e-9)).astype(np.float32), np.float32(-np.inf))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + 1e-9)).astype(np.float32), np.float32(np.inf))


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``x`` to its row of ``entries``: integers."""
    apart = entries - x[:, None, :]
    return np.einsum("nkw,nkw->nk", apart, apart)


class Bounds:
    """What a part keeps between rounds: ``near`` (n, b) entries, ``upper`` (n,) for the first of them, ``lower`` (n, b):
    at place z - 1 the bound for the entry at place z and all behind it; the last is the outer bound."""

    def __init__(self, near: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.near, self.upper, self.lower = near, upper, lower

    @classmethod
    def compared(cls, x: np.ndarray, book: np.ndarray, kept: int) -> tuple[Bounds, np.ndarray]:
        """By comparing all entries of the part's codebook; also the squared distance to the nearest."""
        squared = np.empty((len(x), len(book)), np.int64)
        for k, entry in enumerate(book):
            apart = x - entry
            squared[:, k] = np.einsum("nw,nw->n", apart, apart)
        order = np.argsort(squared, axis=1, kind="stable")  # ties to the lower index
        ordered = np.take_along_axis(squared, order, 1)
        distance = np.sqrt(ordered.astype(np.float64))
        lower = np.full((len(x), kept), np.inf)
        seen = distance[:, 1:kept + 1]
        lower[:, :seen.shape[1]] = seen
        near = np.zeros((len(x), kept), np.uint8)
        near[:, :min(kept, len(book))] = order[:, :kept]
        return cls(near, _up(distance[:, 0]), _down(lower)), ordered[:, 0]

    def give_way(self, moved: np.ndarray, furthest: float) -> None:
        """The entries have moved by so much (rounded up)."""
        self.upper = _up(self.upper.astype(np.float64) + moved[self.near[:, 0]])
        lower = self.lower.astype(np.float64)
        lower[:, :-1] -= moved[self.near[:, 1:]]
        lower[:, -1] -= furthest
        self.lower = _down(lower)
        self.order()

    def order(self) -> None:
        """A bound holds for all entries behind its place."""
        self.lower = np.minimum.accumulate(self.lower[:, ::-1], axis=1)[:, ::-1]

    def needed(self) -> np.ndarray:
        """The smallest z such that the nearest is surely one of the first z; kept + 1: perhaps none."""
        certain = self.upper[:, None] < self.lower
        return np.where(certain.any(axis=1), certain.argmax(axis=1) + 1, self.lower.shape[1] + 1)

    def shrink(self, kept: int) -> None:
        self.order()
        self.near, self.lower = self.near[:, :kept], self.lower[:, :kept]


def assign(x: np.ndarray, book: np.ndarray, moved: np.ndarray | None, bounds: Bounds | None, kept: int) -> tuple[Bounds, np.ndarray]:
    """The nearest entry of every part (the first kept one) after the entries moved, and how many were compared."""
    if bounds is None:
        bounds, _ = Bounds.compared(x, book, kept)
        return bounds, np.full(len(x), len(book))
    bounds.give_way(moved, float(moved.max(initial=0)))
    bounds.lower = bounds.lower.copy()
    z = bounds.needed()
    tested = np.where(z > bounds.lower.shape[1], len(book), np.where(z == 1, 0, z))
    for n in np.unique(z[z > 1]):
        rows = np.flatnonzero(z == n)
        if n > bounds.lower.shape[1]:
            fresh, _ = Bounds.compared(x[rows], book, bounds.lower.shape[1])
            bounds.near[rows], bounds.upper[rows], bounds.lower[rows] = fresh.near, fresh.upper, fresh.lower
            continue
        near = bounds.near[rows, :n].astype(np.int64)
        squared = _distances(x[rows], book[near])
        order = np.lexsort((near, squared), axis=1)  # by distance, ties to the lower index
        distance = np.sqrt(np.take_along_axis(squared, order, 1).astype(np.float64))
        bounds.near[rows, :n] = np.take_along_axis(near, order, 1)
        bounds.upper[rows] = _up(distance[:, 0])
        bounds.lower[rows, :n - 1] = _down(distance[:, 1:])
    bounds.shrink(kept)
    return bounds, tested


def fitted_kept(histogram: dict[int, int], kept: int, entries: int) -> int:
    """The number of kept entries that would have made the round cheapest: each costs one bound, a part that
    needs more than are kept compares all entries.  It never grows, as bounds that were dropped are gone."""
    total = sum(histogram.values())

    def cost(b: int) -> float:
        return b * total + sum(n * (z if z <= b else entries) for z, n in histogram.items())

    return min(range(min(LEAST_KEPT, kept), kept + 1), key=cost) if total else kept


def usable(docs: DataFrame, vector_col: str) -> DataFrame:
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return docs.where(F.col(vector_col).isNotNull()).where(~bad)


def _sums(state: DataFrame, width: int, entries: int) -> np.ndarray:
    """Count and componentwise sum of the parts of each entry: (PARTS, entries, 1 + width)."""
    cells = PARTS * entries

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((cells, 1 + width), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32).reshape(-1, width)
                code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).astype(np.int64).reshape(-1, PARTS)
                cell = (code + np.arange(PARTS) * entries).reshape(-1)
                order = np.argsort(cell, kind="stable")
                begins = np.flatnonzero(np.diff(cell[order], prepend=-1))
                total[cell[order[begins]], 1:] += np.add.reduceat(x.astype(np.int64)[order], begins, axis=0)
                total[:, 0] += np.bincount(cell, minlength=cells)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.reshape(-1)[at], pa.int64())], names=["at", "n"])

    out = np.zeros(cells * (1 + width), np.int64)
    for at, n in state.select("ints", "code").mapInArrow(add, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        out[at] = n
    return out.reshape(PARTS, entries, 1 + width)


def _assigned(state: DataFrame, schema: str, books: np.ndarray, moved: np.ndarray | None, had: int, kept: int, last: bool) -> DataFrame:
    """One round over all vectors: the state with new bounds and codes, in the last round also errors."""
    width = books.shape[2]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                n = part.num_rows
                x = np.frombuffer(b"".join(part.column(2).to_pylist()), np.int32).reshape(n, PARTS, width).astype(np.int64)
                if had:
                    near = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(n, PARTS, had)
                    bounds = np.frombuffer(b"".join(part.column(4).to_pylist()), np.float32).reshape(n, PARTS, 1 + had)
                code, error = np.empty((n, PARTS), np.uint8), np.zeros(n, np.int64)
                new_near, new_bounds = np.empty((n, PARTS, kept), np.uint8), np.empty((n, PARTS, 1 + kept), np.float32)
                tested = np.empty((n, PARTS), np.uint8)
                for p in range(PARTS):
                    old = Bounds(near[:, p].copy(), bounds[:, p, 0].copy(), bounds[:, p, 1:].copy()) if had else None
                    now, tested[:, p] = assign(x[:, p], books[p], None if moved is None else moved[p], old, kept)
                    code[:, p], new_near[:, p] = now.near[:, 0], now.near
                    new_bounds[:, p, 0], new_bounds[:, p, 1:] = now.upper, now.lower
                    if last:
                        apart = x[:, p] - books[p][code[:, p]]
                        error += np.einsum("nw,nw->n", apart, apart)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), *(pa.array([r.tobytes() for r in rows], pa.binary()) for rows in (new_near, new_bounds, code)),
                     pa.array(error, pa.int64()), pa.array([r.tobytes() for r in tested], pa.binary())],
                    names=["id", "label", "ints", "near", "bounds", "code", "error", "tested"])

    return state.mapInArrow(step, schema)


def _histogram(state: DataFrame) -> dict[int, int]:
    """How many parts compared how many entries (0: the bounds alone decided)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8), minlength=256)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["z", "n"])

    return {r[0]: r[1] for r in state.select("tested").mapInArrow(count, "z long, n long").groupBy("z").agg(F.sum("n")).collect()}


class Codes:
    """The coded vectors (``rows``: id, label, code, error), the final codebooks (PARTS, entries, width) and, for each
    round, the kept entries and how many parts compared how many."""

    def __init__(self, rows: DataFrame, books: np.ndarray, rounds: list[tuple[int, dict[int, int]]]):
        self.rows, self.books, self.rounds = rows, books, rounds

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def learn_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codebooks over all vectors and every vector's code.

    Vectors that are null or hold null or non-finite components take no part; nor do those whose width is not the
    most frequent one (ties: the smaller).  The width must divide into ``PARTS`` parts.  The first codebooks come from the smallest ids
    (null ids last; of rows with one id, the smallest vector; fewer ids give fewer entries).  Repeated rows are rows of their own.
    No vectors give no rows and empty codebooks.  Components so large that the sum of squared distances over
    a vector need not fit a long (46,000 for 64 components) raise an error.  Only the three named columns are read.

    A round's state is cached, the one before is released once it is no longer needed, and a lost part is computed anew from the written integers;
    what a round brings to the driver are the sums of the codebooks' entries.
    """
    spark = vectors.sparkSession
    kinds = dict(vectors.dtypes)
    if not 1 <= entries <= 255:
        raise ValueError("a code is one byte a part: 1 to 255 entries")
    schema = STATE.format(id=kinds[id_col], label=kinds[label_col])
    rows = usable(vectors, vector_col).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    most = rows.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width = most["w"] if most else 0
    if width % PARTS:
        raise ValueError(f"vectors of {width} components have no {PARTS} equal parts")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(2)).astype(np.int32) if width else np.empty((batch.num_rows, 0), np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "label", "ints"])

    rows = rows.where(F.size("vector") == width)
    ints = store(rows.mapInArrow(whole, schema.split(", near")[0]), "code-integers")
    ids = [r[0] for r in rows.where("id IS NOT NULL").select("id").distinct().orderBy("id").limit(entries).collect()]
    firsts = rows.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("vector").alias("vector")).orderBy("id").collect()
    part = width // PARTS
    books = np.array([np.floor(np.array(r["vector"], np.float64) * SCALE) for r in firsts], np.float64).astype(np.int64).reshape(len(firsts), PARTS, part).transpose(1, 0, 2)
    if not len(firsts):  # no vectors, or none with an id
        books = np.zeros((PARTS, 1, part), np.int64)
    books = np.ascontiguousarray(books)
    count = books.shape[1]
    had, kept, moved, log, states = 0, max(1, min(count, max(LEAST_KEPT, count // FIRST_KEPT))), None, [], []
    state = ints.select("*", *[F.lit(None).cast("binary").alias(c) for c in ("near", "bounds", "code")], F.lit(None).cast("long").alias("error"), F.lit(None).cast("binary").alias("tested"))
    for number in range(rounds + 1):
        state = _assigned(state, schema, books, moved, had, kept, number == rounds)
        if number == rounds:
            break
        states.append(state.persist(StorageLevel.MEMORY_AND_DISK))
        sums = _sums(state, part, count)
        if len(states) > 1:
            states.pop(0).unpersist()
        used = sums[:, :, 0] > 0
        new = np.where(used[:, :, None], sums[:, :, 1:] // np.maximum(sums[:, :, :1], 1), books)
        moved = np.sqrt(((new - books).astype(np.float64) ** 2).sum(axis=2)) * (1 + 1e-12)
        books, had = new, kept
        log.append((kept, _histogram(state)))
        if number:  # the first round compares all
            seen = {max(z, 1): 0 for z in log[-1][1]}
            for z, n in log[-1][1].items():
                seen[max(z, 1)] += n
            kept = fitted_kept(seen, kept, count)
    done = store(state.select("id", "label", "code", "error", "tested"), "codes")
    log.append((kept, _histogram(done)))
    for old in states:
        old.unpersist()
    return Codes(done.drop("tested"), books if len(firsts) else np.zeros((PARTS, 0, part), np.int64), log)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector's code and error, the error of its label, and the codebooks' digest."""
    codes = learn_codes(read_table(spark, sf_dir, "embeddings"))
    rows = codes.rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null")))
    labels = rows.groupBy("key").agg(F.sum("error").alias("label_error"))
    return rows.join(labels, "key").select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.sha256()).alias("codebooks_sha256"))
