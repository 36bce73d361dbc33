"""Packing token pieces into sequences: dominance reduction, then best fit.

Only the number of pieces of each length matters for the packing, and there are at most as many
lengths as a sequence has tokens.  Spark counts the lengths; the plan is made on those counts:

1. Martello and Toth's reduction, from the longest piece down: a small set that holds the piece
   and dominates every other set holding it (no packing gets worse when the set shares a
   sequence) is fixed for good.  A piece alone, if nothing fits with it; a partner that fills the
   sequence or is at least as long as any two that would fit; else the best two that fill it.
2. Best fit in descending order packs what remains.

The plan is a table of patterns (lengths of one sequence, how many sequences).  Spark ranks the
pieces of each length and gives the piece of rank r the r-th place that the plan has for it.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import read_table, store

CAPACITY, END = 1024, 2
#: Pieces of a bucket inside which one length is ranked.
RANK_ROWS = 1 << 18
#: Places of the plan (a few numbers each) that are broadcast at most; the plan grows with the
#: number of lengths, not with the input.
MOST_PLACES = 200_000

Pattern = tuple[int, ...]


# --- the plan on counts ------------------------------------------------------------------------

def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fixed patterns with their numbers, and the counts that remain.

    For a piece of length j with room r beside it, k the longest partner that fits:

    * nothing fits: {j};
    * j + k fills the sequence, or no two pieces fit in r: {j, k};
    * two fit but no three: {j, k} if k is as long as the best two together, or {j, k, p} if p,
      the longest that fits beside both, is no shorter than the shorter one of any two that fit.

    Taking pieces away keeps each condition true, so a rule applies as often as its set is there.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    fixed: list[tuple[Pattern, int]] = []

    def longest(room: int, without: Counter) -> int:
        i = bisect_left(lengths, room + 1) - 1
        while i >= 0 and left[lengths[i]] <= without[lengths[i]]:
            i -= 1
        return lengths[i] if i >= 0 else 0

    def shortest(k: int, without: Counter) -> list[int]:
        out: list[int] = []
        for n in lengths:
            out += [n] * min(k - len(out), left[n] - without[n])
            if len(out) == k:
                break
        return out

    def two_that_fit(room: int, without: Counter) -> Iterator[tuple[int, int]]:
        """For each p the longest q >= p beside it."""
        for p in lengths:
            if 2 * p > room:
                break
            if left[p] > without[p]:
                q = longest(room - p, without + Counter([p]))
                if q >= p:
                    yield p, q

    def dominating(j: int) -> Pattern | None:
        own, room = Counter([j]), capacity - j
        k = longest(room, own)
        if not k:
            return (j,)
        few = shortest(3, own)
        if j + k == capacity or len(few) < 2 or few[0] + few[1] > room:
            return (j, k)
        if len(few) == 3 and sum(few) <= room:
            return None
        both = list(two_that_fit(room, own))
        if k >= max(p + q for p, q in both):
            return (j, k)
        p = longest(room - k, own + Counter([k]))
        return (j, k, p) if p and p >= max(x for x, _ in both) else None

    for j in sorted(left, reverse=True):
        while j in left and (pattern := dominating(j)):
            need = Counter(pattern)
            times = min(left[n] // c for n, c in need.items())
            fixed.append((pattern, times))
            for n, c in need.items():
                left[n] -= c * times
                if not left[n]:
                    del left[n]
                    lengths.remove(n)
    return fixed, left


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit in descending order, on counts: sequences with the same pieces are one entry."""
    open_: dict[int, dict[Pattern, int]] = defaultdict(dict)  # room left -> pattern -> sequences
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if room not in open_:
            rooms.insert(bisect_left(rooms, room), room)
        open_[room][pattern] = open_[room].get(pattern, 0) + times

    for n in sorted(counts, reverse=True):
        todo = counts[n]
        while todo:
            i = bisect_left(rooms, n)
            if i == len(rooms):
                each = capacity // n
                whole, rest = divmod(todo, each)
                if whole:
                    put(capacity - each * n, (n,) * each, whole)
                if rest:
                    put(capacity - rest * n, (n,) * rest, 1)
                break
            room = rooms[i]
            pattern, times = next(iter(open_[room].items()))
            each = room // n
            whole = min(times, todo // each)
            used, placed = (whole, each) if whole else (1, todo)
            if times == used:
                del open_[room][pattern]
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:
                open_[room][pattern] = times - used
            put(room - placed * n, pattern + (n,) * placed, used)
            todo -= used * placed
    return [(pattern, times) for x in open_.values() for pattern, times in x.items()]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns (lengths in one sequence) and the number of sequences of each."""
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit_decreasing(left, capacity)


# --- tokens ------------------------------------------------------------------------------------

@lru_cache(maxsize=2)
def _encoder(path: str):
    """The byte-level BPE of a tokenizer file, run by tiktoken (same ids, five times the speed)."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in data["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str, path: str) -> np.ndarray:
    """The ids of a text as the tokenizer file gives them, without special tokens added."""
    return np.array(_encoder(path).encode(text, allowed_special="all"), dtype="<u4")


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           end: int = END) -> DataFrame:
    """(id, piece, start, length, ids_crc32): a document is its ids and then ``end``; only longer ones
    are cut, into pieces of ``capacity``, of which the first may be shorter.  A null text counts as
    empty and gives one piece of ``end`` alone."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], [[], [], [], []]
            for i, text in enumerate(batch.column(1)):
                ids = np.append(token_ids(text.as_py() or "", tokenizer_path), np.array([end], "<u4"))
                first = len(ids) % capacity or min(capacity, len(ids))
                ends = [first, *range(first + capacity, len(ids) + 1, capacity)]
                for number, (a, b) in enumerate(zip([0, *ends], ends)):
                    rows.append(i)
                    for column, value in zip(out, (number, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()),
                 *(pa.array(x, pa.int64()) for x in out[1:])], names=["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        cut, f"id {kind}, piece int, start long, length long, ids_crc32 long")


# --- places ------------------------------------------------------------------------------------

def _places(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): in ``ranks`` sequences from the first one
    on, the pieces of that length from the first rank on stand at the offset."""
    given: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            out.append((n, given[n], times, sequence, offset))
            given[n] += times
            offset += n
        sequence += times
    return out


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (with a long ``length`` from 1 to ``capacity``) with sequence_id and offset: sequences
    without gaps, as few as dominance and best fit find.  Equal rows are placed one by one; an empty
    table gives an empty result; columns named sequence_id or offset are replaced."""
    items = items.drop("sequence_id", "offset")
    numbered = store(items.withColumn("_q_row", F.monotonically_increasing_id()), "pack-items")
    counts = {r[0]: r[1] for r in numbered.groupBy("length").count().collect()}  # one row for each length
    spark = items.sparkSession
    places = _places(plan(counts, capacity))
    table = spark.createDataFrame(
        pa.table({name: pa.array([int(p[i]) for p in places], pa.int64()) for i, name in enumerate(("length", "_q_first", "_q_times", "_q_sequence", "_q_offset"))}))
    # the rank of each piece among those of its length: inside buckets, after the earlier buckets
    most = max(counts.values(), default=1)
    buckets = max(1, -(-most // RANK_ROWS), min(64, -(-most // 64)))
    dealt = numbered.withColumn("_q_bucket", F.pmod(F.xxhash64("_q_row"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "_q_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "_q_bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("_q_bucket")) - F.col("n")).alias("_q_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_q_bucket").orderBy("_q_row"))
    ranked = (dealt.withColumn("_q_rank", rank).join(before, ["length", "_q_bucket"])
              .withColumn("_q_rank", F.col("_q_before") + F.col("_q_rank") - 1))
    # the places of a length are intervals of ranks: find each rank's interval among the starts
    starts = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("_q_first", "_q_sequence", "_q_offset"))).alias("_q_places"))
    joined = ranked.join(F.broadcast(starts) if len(places) <= MOST_PLACES else starts, "length")
    place = F.element_at("_q_places", F.size(F.filter("_q_places", lambda p: p["_q_first"] <= F.col("_q_rank"))))
    return (joined.withColumn("_q_place", place)
            .select(*items.columns, (F.col("_q_place._q_sequence") + F.col("_q_rank") - F.col("_q_place._q_first")).alias("sequence_id"),
                    F.col("_q_place._q_offset").alias("offset")))


def packed_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of ``docs``."""
    import public_tokenizers
    packed = pack(pieces(docs, public_tokenizers.path(tokenizer)))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 1024 tokens of the byte-level BPE."""
    return packed_documents(read_table(spark, sf_dir, "documents"))
