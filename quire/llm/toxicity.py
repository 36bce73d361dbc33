"""Toxicity by a factorization machine over hashed terms.

The score of a text is sigmoid(b + sum of w_i + sum over pairs of <v_i, v_j>) over the distinct
hashed terms that it holds: the pairs let two terms together (an insult and the mention of a
group) count for more than the sum of both.  It is learnt with AdaGrad on a bounded sample of
labelled texts, over the terms whose share differs between the classes by three standard
errors of the log odds; scoring reads every whole text in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Memo, read_table, remainder_of

#: Numbers that describe a term in pairs.
FACTORS = 8
#: A term enters from so many sampled texts, and from so many standard errors between the classes.
LEAST_TEXTS, LEAST_ERRORS = 5, 3.0
#: Terms that are tried in pairs (those in most texts), and the standard errors from which a pair's two terms enter: many, as copies among the
#: sampled texts count as independent ones (7 let 15 chance terms in on check_s and cost 4 of 5,099 held-out documents, 9 none).
PAIRED_TERMS, PAIR_ERRORS = 1024, 10.0
#: The bound of the training sample: labelled texts of each class, those of the smallest hash.
SAMPLE_OF_CLASS = 4000
#: Score from which a text counts as toxic.
THRESHOLD = 0.3
#: Documents that are scored at once, so that a batch of long texts stays small.
CHUNK = 256

_STRIPPED = b".,;:!?\"'()[]{}|*_-"


def _terms_of_word(word: bytes) -> tuple[int, ...]:
    """32-bit hashes of the word and of its beginnings of four and five bytes, which stand for its
    other forms."""
    word = word.strip(_STRIPPED)
    if not word:
        return ()
    return (xxhash.xxh32_intdigest(word), *(xxhash.xxh32_intdigest(word[:n], seed=n) for n in (4, 5) if len(word) >= n))


def terms(text: bytes | None, memo: Memo) -> np.ndarray:
    """The distinct terms of a whole text, as ``memo`` has them for each word; none for a null or
    empty text."""
    words = set((text or b"").lower().split())
    return np.unique(np.fromiter(chain.from_iterable(map(memo.__getitem__, words)), np.uint32))


@dataclass
class FactorizationMachine:
    """``known``: the hashes of the terms, ascending; ``table``: for each of them w - |v|^2 / 2 and
    then v, so one sum over a text's terms scores it."""

    bias: float
    known: np.ndarray
    table: np.ndarray

    def memo(self) -> Memo:
        """Word to the places of its known terms."""
        place = {int(h): i for i, h in enumerate(self.known)}
        return Memo(lambda word: tuple(place[h] for h in _terms_of_word(word) if h in place))

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for i, ids in enumerate(texts):
            if len(ids):
                s = self.table[ids].sum(axis=0, dtype=np.float64)
                out[i] += s[0] + 0.5 * (s[1:] ** 2).sum()
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def telling_terms(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The hashes, ascending, of the terms whose odds differ between the classes by
    ``LEAST_ERRORS`` standard errors of their logarithm."""
    every, count = np.unique(np.concatenate(texts), return_counts=True)
    inside, n = np.unique(np.concatenate([t for t, y in zip(texts, labels) if y]), return_counts=True)
    hit = np.zeros(len(every))
    hit[np.searchsorted(every, inside)] = n
    miss, ones, zeros = count - hit, labels.sum(), len(labels) - labels.sum()
    p, q = (hit + 0.5) / (ones + 1), (miss + 0.5) / (zeros + 1)
    errors = np.abs(np.log(p / (1 - p)) - np.log(q / (1 - q))) / np.sqrt(1 / (hit + 0.5) + 1 / (miss + 0.5))
    return every[(count >= LEAST_TEXTS) & (errors >= LEAST_ERRORS)]


def paired_terms(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The hashes, ascending, of terms that tell the classes apart in pairs, neutral alone or not: of the
    ``PAIRED_TERMS`` terms in most texts, those of a pair whose effect on the log odds, beyond the sum of both terms' own, is
    ``PAIR_ERRORS`` standard errors or more (there are half a million pairs to err in)."""
    every, count = np.unique(np.concatenate(texts), return_counts=True)
    often = np.sort(every[np.lexsort((every, -count))[:PAIRED_TERMS]])
    beyond = total = None
    for label in (0, 1):
        mine = [t for t, y in zip(texts, labels) if y == label]
        held = np.zeros((len(mine), len(often)), np.float32)
        for i, t in enumerate(mine):
            held[i, np.flatnonzero(np.isin(often, t, assume_unique=True))] = 1
        both, one = held.T @ held, held.sum(axis=0)
        cells = [(1, both), (-1, one[:, None] - both), (-1, one[None, :] - both), (1, len(mine) - one[:, None] - one[None, :] + both)]
        effect = sum(sign * np.log(c + 0.5) for sign, c in cells) * (2 * label - 1)
        error = sum(1 / (c + 0.5) for _, c in cells)
        beyond, total = (effect, error) if beyond is None else (beyond + effect, total + error)
    strong = np.abs(beyond) >= PAIR_ERRORS * np.sqrt(total)
    np.fill_diagonal(strong, False)
    return often[strong.any(axis=0)]


def train(texts: list[np.ndarray], labels: np.ndarray, prior: float, epochs: int = 20, batch: int = 64, rate: float = 0.3,
          penalty: float = 1e-4, seed: int = 5) -> FactorizationMachine:
    """AdaGrad on the log loss over the terms of ``texts`` that tell alone or in pairs (hashes); ``prior`` is the share of
    class 1 among all labels, to which the bias of the sample is shifted."""
    labels = np.asarray(labels, np.float64)
    positive = float(labels.mean()) if len(labels) else 0.0
    known = np.union1d(telling_terms(texts, labels), paired_terms(texts, labels)) if 0 < positive < 1 else np.empty(0, np.uint32)
    if not len(known):
        bias = np.log(prior / (1 - prior)) if 0 < prior < 1 else 8.0 * (1 if prior else -1)
        return FactorizationMachine(float(bias), np.zeros(1, np.uint32), np.zeros((1, 1 + FACTORS)))
    texts = [np.searchsorted(known, t[np.isin(t, known)]) for t in texts]
    rng, size = np.random.default_rng(seed), len(known)
    w, v = np.zeros(size), rng.normal(0, 1e-2, (size, FACTORS))
    gw, gv, gb, b = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6, np.log(positive / (1 - positive))
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            part = order[at:at + batch]
            ids = np.concatenate([texts[i] for i in part])
            row = np.repeat(np.arange(len(part)), [len(texts[i]) for i in part])
            x = v[ids]
            total = np.stack([np.bincount(row, x[:, f], len(part)) for f in range(FACTORS)], axis=1)
            z = b + np.bincount(row, w[ids] - 0.5 * (x * x).sum(axis=1), len(part)) + 0.5 * (total * total).sum(axis=1)
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]
            e = error[row] / len(part)
            used, place = np.unique(ids, return_inverse=True)
            dw = np.bincount(place, e, len(used)) + penalty * w[used]
            gw[used] += dw * dw
            w[used] -= rate * dw / np.sqrt(gw[used])
            dx = e[:, None] * (total[row] - x)
            for f in range(FACTORS):
                dv = np.bincount(place, dx[:, f], len(used)) + penalty * v[used, f]
                gv[used, f] += dv * dv
                v[used, f] -= 0.1 * rate * dv / np.sqrt(gv[used, f])
            db = error.mean()
            gb += db * db
            b -= rate * db / np.sqrt(gb)
    shift = np.log(prior / (1 - prior)) - np.log(positive / (1 - positive)) if 0 < prior < 1 else 0.0
    return FactorizationMachine(float(b + shift), known, np.column_stack([w - 0.5 * (v * v).sum(axis=1), v]))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> FactorizationMachine:
    """Learns from the labelled ids that are not held out (crc32 of the id modulo 4 is not 2): of each
    class the ``SAMPLE_OF_CLASS`` ids with the smallest hash.  Null ids and labels are no examples;
    of an id labelled twice the larger label holds; with one class only, the score is constant."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
             .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (remainder_of(F.col("id"), 4) != 2))
             .groupBy("id").agg(F.max("label").alias("label")))
    counts = dict(known.groupBy("label").count().collect())
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    picked = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_OF_CLASS)
        picked = part if picked is None else picked.union(part)
    # at most 2 * SAMPLE_OF_CLASS ids, so the broadcast has a bound
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(picked), "id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(_terms_of_word)
        for batch in batches:
            rows = [terms(t.as_py(), memo).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["id", "label", "terms"])

    kind = dict(docs.dtypes)[id_col]
    # sampled ids may stand in many repeated rows: one of each id is enough
    rows = (texts.select("id", "label", "text").mapInArrow(hashed, f"id {kind}, label int, terms binary")
            .groupBy("id").agg(F.first("label"), F.min("terms")).collect())
    rows.sort(key=lambda r: str(r[0]))
    return train([np.frombuffer(bytes(r[2]), np.uint32) for r in rows], np.array([r[1] for r in rows]), prior)


def score(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``score`` (0 to 1) of every row; null and empty texts get the
    score of no terms.  Only the text enters the score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.known, model.table))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = FactorizationMachine(*shared.value)
        memo = machine.memo()
        last = None
        for batch in batches:
            last = last or batch.num_columns - 1
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                found = machine.scores([terms(t.as_py(), memo) for t in part.column(last)])
                yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(found, pa.float64())], names=[*part.schema.names[:last], "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return docs.select(*keep, F.col(text_col).cast("binary").alias("_q_text")).mapInArrow(rate, f"{schema}, score double")


def without_toxic(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score lies below the threshold, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.known, model.table))
    at = docs.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = FactorizationMachine(*shared.value)
        memo = machine.memo()
        for batch in batches:
            for begin in range(0, batch.num_rows, CHUNK):
                part = batch.slice(begin, CHUNK)
                texts = part.column(at).cast(pa.binary())
                yield part.filter(pa.array(machine.scores([terms(t.as_py(), memo) for t in texts]) < threshold))

    return docs.mapInArrow(judge, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learnt from the labels that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = learn(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", (remainder_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
