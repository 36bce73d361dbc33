"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays.

* Tasks turn texts into word hashes and count the pairs (word, next word) of what they read before
  anything is shuffled; the counts, a block of sorted arrays for each hash range of the first word,
  meet by that range.  A first word so frequent that its range would be much larger than the others
  is dealt by its next words as well; which words these are, a bounded sample of texts tells (it
  steers the layout alone, no count).
* Each range is written to the shared folder as sorted arrays: first words, where their next words
  begin, their totals and how many of them were seen once or twice; next words and counts.
* What each range holds of a next word (its count, its different first words) meets by that word's
  hash range and is written as sorted arrays too: the vocabulary.
* Scoring maps the arrays into memory (nothing is loaded or broadcast) and finds a batch's pairs by
  vectorised binary search.

A pair's probability interpolates its discounted count with the continuation probability of the
word, and that with the uniform distribution over the vocabulary and one unknown word; the three
discounts of either level come from the numbers of pairs (words) seen once to four times.
"""

from __future__ import annotations

import json
import os
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Memo, read_table, remainder_of, shared_folder

#: Hashes of the start and the end of a text.  Words cannot hold white space, so these are no words.
START, END = xxhash.xxh64_intdigest(b" <s>"), xxhash.xxh64_intdigest(b" </s>")
#: Texts that tell which words are hot.
HOT_SAMPLE = 2000
#: Pairs that a task counts before it passes them on, and tokens that are scored at once.
TASK_PAIRS, SCORE_TOKENS = 2_500_000, 500_000


def _local(folder: str) -> str:
    """The mounted path of the shared folder: memory maps need one."""
    parts = urlparse(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"the model is mapped into memory, so {folder} must be a mounted folder (file:)")
    return unquote(parts.path)


def _hashes(text: bytes | None, memo: Memo) -> np.ndarray:
    """START, the words' hashes, END."""
    words = (text or b"").lower().split()
    out = np.empty(len(words) + 2, np.uint64)
    out[0], out[-1] = START, END
    out[1:-1] = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    return out


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int32)


def _parts_of(a: np.ndarray, b: np.ndarray, ranges: int, hot: np.ndarray) -> np.ndarray:
    """The part of each pair: its first word's range, or for a hot first word one of as many more."""
    part = _range_of(a, ranges)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, a), len(hot) - 1)
        dealt = np.flatnonzero(hot[at] == a)
        part[dealt] = ranges + _range_of((a[dealt] ^ b[dealt]) * np.uint64(0x9E3779B97F4A7C15), ranges)
    return part


def _hot_words(texts: DataFrame, ranges: int) -> np.ndarray:
    """Hashes, ascending, of the words that are more than a part in 2 * ranges of the first words in
    ``HOT_SAMPLE`` texts: fewer than 2 * ranges."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(xxhash.xxh64_intdigest)
        for batch in batches:
            found = [_hashes(t.as_py(), memo)[:-1] for t in batch.column(0)]
            words, n = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
            often = n > n.sum() / (8 * ranges)
            yield pa.RecordBatch.from_arrays([pa.array([None, *words[often].view(np.int64).tolist()], pa.int64()),  # null: all words
                                              pa.array([int(n.sum()), *n[often].tolist()], pa.int64())], names=["word", "n"])

    rows = texts.limit(HOT_SAMPLE).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n")).collect()
    of = {r[0]: r[1] for r in rows}
    size = of.pop(None, 0)
    return np.sort(np.array([w for w, n in of.items() if n > size / (2 * ranges)], np.int64).view(np.uint64))


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs, ascending, their numbers, and each pair's place among them."""
    words, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    key = at[:len(a)] * np.int64(len(words)) + at[len(a):]
    key, place, n = np.unique(key, return_inverse=True, return_counts=True)
    first, following = np.divmod(key, len(words))
    return words[first], words[following], n, place


def _count_pairs(texts: DataFrame, ranges: int, hot: np.ndarray) -> DataFrame:
    """(part, a, b, c): first words, next words and numbers of the pairs in what a task has read since it
    last passed on, as arrays."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(xxhash.xxh64_intdigest, 300_000)
        firsts, nexts, held = [], [], 0

        def flush():
            nonlocal firsts, nexts, held
            a, b = np.concatenate(firsts), np.concatenate(nexts)
            firsts, nexts, held = [], [], 0
            a, b, n, _ = _distinct_pairs(a, b)
            part, n = _parts_of(a, b, ranges, hot), n.astype(np.int32)
            own = part < ranges  # ascending, as a is
            yield from _blocks(part[own], a[own], b[own], n[own])
            dealt = np.flatnonzero(~own)
            dealt = dealt[np.argsort(part[dealt], kind="stable")]
            yield from _blocks(part[dealt], a[dealt], b[dealt], n[dealt])

        for batch in batches:
            for text in batch.column(0):
                h = _hashes(text.as_py(), memo)
                firsts.append(h[:-1])
                nexts.append(h[1:])
                held += len(h) - 1
                if held >= TASK_PAIRS:
                    yield from flush()
        if held:
            yield from flush()

    return texts.mapInArrow(count, "part int, a binary, b binary, c binary")


def _blocks(part: np.ndarray, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each value of the ascending ``part``: the arrays' slices, as bytes."""
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)] if len(part) else []
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield pa.RecordBatch.from_arrays([pa.array([int(part[a])], pa.int32()), *(pa.array([x[a:b].tobytes()], pa.binary()) for x in arrays)],
                                             names=["part", "a", "b", "c"])


def _groups(batches: Iterator[pa.RecordBatch], *kinds: type) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The parts of a task, each with its blocks' arrays put together."""
    held: dict[int, list[tuple]] = defaultdict(list)
    for batch in batches:
        for part, *arrays in zip(*(c.to_pylist() for c in batch.columns)):
            held[part].append(arrays)
    while held:
        part, found = held.popitem()
        yield part, [np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*found), kinds)]


def _save(folder: str, name: str, arrays: dict[str, np.ndarray], facts: dict) -> None:
    """Write the arrays and then the facts; each file appears whole, so a repeated task does no harm."""
    for kind, x in arrays.items():
        there = f"{folder}/{name}.{kind}.npy"
        here = f"{there}.{os.getpid()}-{os.urandom(4).hex()}"
        with open(here, "wb") as f:
            np.save(f, x)
        os.replace(here, there)
    there = f"{folder}/{name}.json"
    here = f"{there}.{os.getpid()}-{os.urandom(4).hex()}"
    with open(here, "w", encoding="utf-8") as f:
        json.dump(facts, f)
    os.replace(here, there)


def _seen_times(n: np.ndarray) -> list[int]:
    return [int((n == i).sum()) for i in (1, 2, 3, 4)]


def _write_pairs(pairs: DataFrame, folder: str, ranges: int) -> DataFrame:
    """Writes each range of first words; passes on (part, a, b, c): its next words, their
    counts and numbers of first words."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (a, b, n) in _groups(batches, np.uint64, np.uint64, np.int32):
            n = n.astype(np.int64)
            order = np.lexsort((b, a))
            a, b, n = a[order], b[order], n[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            a, b, n = a[new], b[new], np.add.reduceat(n, new)
            begin = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            total = np.add.reduceat(n, begin)
            once, twice = (np.add.reduceat((n == i).astype(np.int64), begin) for i in (1, 2))
            _save(folder, f"pairs-{part:06d}", {
                "first": a[begin], "begin": np.append(begin, len(a)).astype(np.int64),
                "facts": np.column_stack([total, once, twice]).astype(np.int64),
                "next": (b >> np.uint64(32)).astype(np.uint32),
                "n": np.minimum(n, 0xFFFFFFFF).astype(np.uint32)}, {"seen": _seen_times(n)})
            order = np.argsort(b, kind="stable")
            b, n = b[order], n[order]
            new = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            words, firsts, n = b[new], np.diff(np.append(new, len(b))), np.add.reduceat(n, new)
            yield from _blocks(_range_of(words, ranges), words, n, firsts.astype(np.int64))

    return pairs.mapInArrow(write, "part int, a binary, b binary, c binary")


def _write_words(words: DataFrame, folder: str) -> DataFrame:
    """Writes each range of the vocabulary; one row of sums for each."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (w, n, firsts) in _groups(batches, np.uint64, np.int64, np.int64):
            order = np.argsort(w, kind="stable")
            w, n, firsts = w[order], n[order], firsts[order]
            new = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            n, firsts = np.add.reduceat(n, new), np.add.reduceat(firsts, new)
            _save(folder, f"words-{part:06d}", {"word": w[new], "n": n.astype(np.int64), "firsts": firsts.astype(np.int64)}, {})
            facts = [int(n.sum()), len(new), int(firsts.sum()), *_seen_times(firsts), part]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in facts], names=["n", "words", "firsts", "n1", "n2", "n3", "n4", "part"])

    return words.mapInArrow(write, "n long, words long, firsts long, n1 long, n2 long, n3 long, n4 long, part long")


def discounts(seen: list[int]) -> list[float]:
    """Chen and Goodman's three discounts from the numbers of things seen 1, 2, 3 and 4 times; 0.75 of
    a count where these don't give one between 0 and the count."""
    n = [float(x) for x in seen]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.0
    out = []
    for i in (1, 2, 3):
        d = i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] and n[i] else -1.0
        out.append(d if 0 < d < i else 0.75)
    return out


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the corpus-wide numbers."""

    folder: str
    ranges: int
    tokens: int        # N
    words: int         # V
    pairs: int         # different pairs
    discounts: tuple   # of pairs seen 1, 2, 3 or more times
    lower: tuple       # of words after 1, 2, 3 or more different first words
    rest: float        # what the lower level leaves for the uniform distribution


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Counts all texts of ``docs`` (null as empty) and writes the model to the shared folder."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "lm")
    path = _local(folder)
    os.makedirs(path, exist_ok=True)
    texts = docs.select(F.col(text_col).cast("binary").alias("text"))
    # two ranges for each partition of the input, so a range's size doesn't grow with the input
    ranges = 2 * max(spark.sparkContext.defaultParallelism, texts.rdd.getNumPartitions())
    hot = _hot_words(texts, ranges)
    pairs = _count_pairs(texts, ranges, hot).repartition(2 * ranges, "part")
    words = _write_pairs(pairs, path, ranges).repartition(ranges, "part")
    sums = _write_words(words, path).collect()  # one row for each range
    seen = np.zeros(4, np.int64)
    whole: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(4, np.int64))  # the facts of hot words, from all their parts
    for part in range(2 * ranges):
        if os.path.exists(facts := f"{path}/pairs-{part:06d}.json"):
            with open(facts, encoding="utf-8") as f:
                seen += np.array(json.load(f)["seen"])
            if part >= ranges:
                first, begin, numbers = (np.load(f"{path}/pairs-{part:06d}.{kind}.npy") for kind in ("first", "begin", "facts"))
                for word, row in zip(first.tolist(), np.column_stack([numbers, np.diff(begin)])):
                    whole[word] += row
    _save(path, "hot", {"first": hot, "facts": np.array([whole[w] for w in hot.tolist()], np.int64).reshape(-1, 4)}, {})
    tokens, size, firsts, *times = (sum(r[i] for r in sums) for i in range(7))
    lower = discounts(times)
    left = lower[0] * times[0] + lower[1] * times[1] + lower[2] * (size - times[0] - times[1])
    return Model(path, ranges, tokens, size, firsts, tuple(discounts(list(seen))), tuple(lower), left / firsts if firsts else 1.0)


@lru_cache(maxsize=512)
def _mapped(folder: str, name: str, kind: str) -> np.ndarray | None:
    there = f"{folder}/{name}.{kind}.npy"
    return np.load(there, mmap_mode="r").view(np.ndarray) if os.path.exists(there) else None


def _take_off(n: np.ndarray, d: tuple) -> np.ndarray:
    """Counts less their discount; 0 stays."""
    return np.maximum(n - np.array([0.0, *d])[np.minimum(n, 3).astype(np.int64)], 0.0)


class Scorer:
    """Looks up words and pairs in the mapped arrays."""

    def __init__(self, model: Model):
        self.model = model

    def _by_range(self, h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The ranges and the (ascending) places of their hashes; ``h`` is ascending."""
        part = _range_of(h, self.model.ranges)
        cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(h)]):
            if b > a:
                yield int(part[a]), slice(a, b)

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and number of different first words of ascending hashes."""
        n, firsts = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        for part, cut in self._by_range(h):
            known = _mapped(self.model.folder, f"words-{part:06d}", "word")
            if known is None:
                continue
            at = np.minimum(np.searchsorted(known, h[cut]), len(known) - 1)
            hit = known[at] == h[cut]
            n[cut] = np.where(hit, _mapped(self.model.folder, f"words-{part:06d}", "n")[at], 0)
            firsts[cut] = np.where(hit, _mapped(self.model.folder, f"words-{part:06d}", "firsts")[at], 0)
        return n, firsts

    def _find(self, part: int, first: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs in one part: the places of those whose first word is known there, their counts, and
        (total, once, twice, different) of the first word in this part."""
        name = f"pairs-{part:06d}"
        known = _mapped(self.model.folder, name, "first")
        if known is None:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 4), np.int64)
        at = np.minimum(np.searchsorted(known, first), len(known) - 1)
        place = np.flatnonzero(known[at] == first)
        at, begin = at[place], _mapped(self.model.folder, name, "begin")
        low, high = begin[at].copy(), begin[at + 1]
        facts = np.column_stack([_mapped(self.model.folder, name, "facts")[at], high - low])
        nexts, want, end, order = _mapped(self.model.folder, name, "next"), short[place], high.copy(), np.arange(len(low))
        while len(order):  # binary search of all at once
            middle = (low[order] + end[order]) >> 1
            up = nexts[middle] < want[order]
            low[order[up]] = middle[up] + 1
            end[order[~up]] = middle[~up]
            order = order[low[order] < end[order]]
        n = np.zeros(len(place), np.int64)
        inside = np.flatnonzero(low < high)
        same = inside[nexts[low[inside]] == want[inside]]
        n[same] = _mapped(self.model.folder, name, "n")[low[same]]
        return place, n, facts

    def pairs(self, first: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each pair, and (total, once, twice, different) of its first word; ``first`` is ascending."""
        n, facts = np.zeros(len(first), np.int64), np.zeros((len(first), 4), np.int64)
        short = (following >> np.uint64(32)).astype(np.uint32)
        hot, hot_facts = (_mapped(self.model.folder, "hot", kind) for kind in ("first", "facts"))
        part = _parts_of(first, following, self.model.ranges, hot)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(part[order[1:]] != part[order[:-1]]) + 1
        for rows in np.split(order, cuts):
            place, counts, found = self._find(int(part[rows[0]]), first[rows], short[rows])
            n[rows[place]], facts[rows[place]] = counts, found
        dealt = np.flatnonzero(part >= self.model.ranges)
        facts[dealt] = hot_facts[np.searchsorted(hot, first[dealt])] if len(dealt) else 0
        return n, facts

    def score(self, texts: list[np.ndarray]) -> list[tuple[int, int, float, float]]:
        """(tokens, known tokens, base score, model score) of each text (START, words, END)."""
        m = self.model
        first, following = np.concatenate([t[:-1] for t in texts]), np.concatenate([t[1:] for t in texts])
        words, word_at = np.unique(following, return_inverse=True)
        n, firsts = self.words(words)
        base = np.log10((n + 1) / (m.tokens + m.words + 1))
        lower = _take_off(firsts, m.lower) / max(m.pairs, 1) + m.rest / (m.words + 1)
        a, b, _, place = _distinct_pairs(first, following)
        lower_of = np.empty(len(a))
        lower_of[place] = lower[word_at]
        count, facts = self.pairs(a, b)
        total = np.maximum(facts[:, 0], 1)
        left = m.discounts[0] * facts[:, 1] + m.discounts[1] * facts[:, 2] + m.discounts[2] * (facts[:, 3] - facts[:, 1] - facts[:, 2])
        weight = np.where(facts[:, 0] > 0, left / total, 1.0)
        each = np.log10(_take_off(count, m.discounts) / total + weight * lower_of)[place]
        begin = np.cumsum([0, *(len(t) - 1 for t in texts[:-1])])
        return list(zip([len(t) - 1 for t in texts], np.add.reduceat((n > 0)[word_at].astype(np.int64), begin).tolist(),
                        np.add.reduceat(base[word_at], begin).tolist(), np.add.reduceat(each, begin).tolist()))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with n_tokens, n_known, train_tokens, base_score (add-one unigram) and score (the
    model's log10 probability) of every whole text.

    A null or empty text is its end alone.  Repeated rows are scored each; an empty table gives an
    empty result; without training text all words are unknown and equally likely.
    """
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, scorer = Memo(xxhash.xxh64_intdigest, 300_000), Scorer(model)
        for batch in batches:
            last = batch.num_columns - 1
            out, held, size = [], [], 0
            for text in batch.column(last):
                held.append(_hashes(text.as_py(), memo))
                size += len(held[-1])
                if size >= SCORE_TOKENS:
                    out += scorer.score(held)
                    held, size = [], 0
            if held:
                out += scorer.score(held)
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:last], pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                 pa.array([model.tokens] * len(out), pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.float64())],
                names=[*batch.schema.names[:last], "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return docs.select(*keep, F.col(text_col).cast("binary").alias("_q_text")).mapInArrow(
        rate, f"{schema}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole document under a model of those that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.where(remainder_of(F.col("doc_id"), 7) != 2))
    return score(docs, model).select("doc_id", (remainder_of(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known",
                                     "train_tokens", "base_score", "score")
