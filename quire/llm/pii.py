"""Personal data by weak supervision.

1. Candidate spans: what the base patterns match, and looser look-alikes (an address spelt with
   "at" and "dot", a phone number without "+", a number of groups that misses the card check, an
   address of eight hexadecimal groups).
2. Labelers vote for, against or not at all on each candidate: the strict pattern, the structure
   (checksums, ranges, digit counts), a gazetteer (endings of host names, card prefixes, ...), the
   words before it, and what it touches.
3. Expectation maximisation estimates, for each kind, how often the labelers vote which way on true
   and on false candidates, from the numbers of all vote patterns of the corpus.
4. A logistic regression on the candidates' own features (shape, neighbours, context words) learns
   the posteriors on a bounded sample and decides about candidates the base patterns miss.

What the base patterns match always counts; the classifier only adds spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import read_table, store

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "structure", "gazetteer", "context", "border")
#: Candidates that the classifier is fitted on at most: those of the smallest hash.
SAMPLE = 20_000
#: An added span needs this probability.
CERTAIN = 0.9
FEATURES = 512

# --- base patterns: the leftmost matches that don't overlap, without ways to backtrack far ---------

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

# --- looser candidates -----------------------------------------------------------------------------

_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[({] ?(?:at|AT|@) ?[\])}] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({] ?(?:dot|DOT|\.) ?[\])}]) ?[A-Za-z0-9-]{1,63}){1,6}")
_PLAIN_PHONE = re.compile(r"(?<![0-9+A-Za-z])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")
_HEX_ADDRESS = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")

# --- what the gazetteer and the context labelers know ----------------------------------------------

_ENDINGS = frozenset("com org net edu gov mil info biz io eu de fr es uk us ca au jp cn in it nl ch at be se no pl br ru".split())
_CARD_STARTS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|36|38|30[0-5]|35|6011|65|62")
_FOR = {"email": frozenset("mail email e-mail contact write address reach send".split()),
        "ip": frozenset("ip address host server from at client addr login".split()),
        "card": frozenset("card visa mastercard amex credit debit payment pay number".split()),
        "phone": frozenset("phone tel telephone call mobile fax cell contact number".split())}
_AGAINST = frozenset("version ver build order id isbn issn sha md5 hash key token password release section serial part".split())
_WORD = re.compile(r"[^\W\d_][\w-]*")


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(divmod(2 * int(d), 10)[0] + 2 * int(d) % 10 for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then kind as listed."""
    found, last = [], 0
    if "@" in text:
        for m in _AT.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, 0, m.end()))
                last = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() < 40 else ""
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(start, end, KINDS[k]) for start, k, end in sorted(found)]


def other_candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Look-alikes that touch none of the base spans."""
    found = [(m.start(), m.end(), "ip") for m in _HEX_ADDRESS.finditer(text)] if text.count(":") >= 7 else []
    if any(c in text for c in "[({"):
        found += [(m.start(), m.end(), "email") for m in _SPELT.finditer(text)]
    found += [(m.start(), m.end(), "phone") for m in _PLAIN_PHONE.finditer(text)]
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 38 and 13 <= len(_NOT_DIGIT.sub("", m[0])) <= 19:
            found.append((m.start(), m.end(), "card"))
    if not found or not base:
        return found
    ends, far = [], 0  # the furthest end of the base spans up to each
    for _, end, _ in base:
        far = max(far, end)
        ends.append(far)
    starts = [s[0] for s in base]
    return [c for c in found if not (i := bisect_left(starts, c[1])) or ends[i - 1] <= c[0]]


def votes(text: str, start: int, end: int, kind: str, strict: bool) -> tuple[int, ...]:
    """1 for, -1 against, 0 no opinion, of each labeler."""
    span, digits = text[start:end], _NOT_DIGIT.sub("", text[start:end])
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 40):start])][-3:]
    if kind == "email":
        structure = 1 if re.search(r"[A-Za-z]", span) and ".." not in span else -1
        ending = re.findall(r"[A-Za-z0-9-]+", span)[-1].lower()
        gazetteer = 1 if ending in _ENDINGS else 0 if ending.isalpha() else -1
    elif kind == "ip":
        parts = span.split(".")
        structure = 1 if ":" in span or all(p == p.lstrip("0") or p == "0" for p in parts) else -1
        gazetteer = -1 if parts[0] in ("0", "255") or span == "1.2.3.4" else 0 if ":" in span else 1
    elif kind == "card":
        structure = 1 if _luhn(digits) else -1
        gazetteer = 1 if _CARD_STARTS.match(digits) else -1
    else:
        structure = 1 if 10 <= len(digits) <= 15 and len(set(digits)) > 2 else -1
        gazetteer = -1 if digits.startswith("000") else 1 if span.startswith("+") else 0
    context = -1 if _AGAINST & set(before) else 1 if _FOR[kind] & set(before) else 0
    left, right = text[start - 1:start], text[end:end + 1]
    border = -1 if left.isalnum() or right.isalnum() or set(left + right) & set("=_#") else 1
    return (1 if strict else -1, structure, gazetteer, context, border)


def features(text: str, start: int, end: int, kind: str) -> list[int]:
    """Hashed features of the span itself: its shape, the characters beside it, the words before it."""
    span = text[start:end]
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[A-Za-z]+", "a", span))
    names = [f"kind {kind}", f"shape {kind} {shape[:24]}", f"digits {kind} {min(20, sum(c.isdigit() for c in span))}",
             f"left {kind} {text[start - 1:start] if start else ''}", f"right {kind} {text[end:end + 1]}"]
    names += [f"word {kind} {w.lower()}" for w in _WORD.findall(text[max(0, start - 40):start])[-2:]]
    return sorted({xxhash.xxh32_intdigest(n.encode("utf-8", "replace")) % FEATURES for n in names})


# --- the label model and the classifier ------------------------------------------------------------

def reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = 100) -> tuple[float, np.ndarray]:
    """Expectation maximisation over the numbers of vote patterns: the share of true candidates, and
    for (false, true), each labeler and vote (-1, 0, 1) its probability.  Starts from the majority."""
    keys = list(patterns)
    x, n = np.array(keys), np.array([patterns[k] for k in keys], float)
    p = 1 / (1 + np.exp(-x.sum(axis=1)))
    share, table = 0.5, np.full((2, x.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        share = float((n * p).sum() / n.sum())
        for y, weight in ((0, n * (1 - p)), (1, n * p)):
            for j in range(x.shape[1]):
                c = np.array([weight[x[:, j] == v].sum() for v in (-1, 0, 1)]) + 0.1
                table[y, j] = c / c.sum()
        new = _posterior(x, share, table)
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return share, table


def _posterior(x: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    logs = [np.log(max(s, 1e-12)) + sum(np.log(table[y, j, x[:, j] + 1]) for j in range(x.shape[1])) for y, s in ((0, 1 - share), (1, share))]
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))


def fit(rows: list[list[int]], targets: np.ndarray, steps: int = 300, rate: float = 1.0, penalty: float = 1e-3) -> np.ndarray:
    """Logistic regression on soft targets; the last weight is the intercept."""
    x = np.zeros((len(rows), FEATURES + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1
    x[:, -1] = 1
    w, speed = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-6)
    for _ in range(steps):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - targets) / len(rows) + penalty * w
        speed += g * g
        w -= rate * g / np.sqrt(speed) * 0.1
    return w


@dataclass
class SpanClassifier:
    weights: np.ndarray

    def probability(self, found: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[found].sum() + self.weights[-1], -30, 30))))


_CANDIDATE = "struct<start:long,end:long,kind:string,strict:boolean,votes:array<int>,features:array<int>>"


def candidates(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row and all candidate spans of its whole text."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("strict", pa.bool_()),
                               ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, rows = batch.num_columns - 1, []
            for value in batch.column(last):
                text = value.as_py() or ""
                strict = base_spans(text)
                spans = [(*s, True) for s in strict] + [(*s, False) for s in other_candidates(text, strict)]
                rows.append([{"start": a, "end": b, "kind": k, "strict": sure, "votes": votes(text, a, b, k, sure), "features": features(text, a, b, k)}
                             for a, b, k, sure in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(rows, kind)], names=[*batch.schema.names[:last], "candidates"])

    schema = "".join(f"`{c}` {t}, " for c, t in docs.select(*keep).dtypes)
    return docs.select(*keep, F.col(text_col).alias("_q_text")).mapInArrow(find, f"{schema}candidates array<{_CANDIDATE}>")


def learn(found: DataFrame) -> SpanClassifier:
    """The span classifier, from all candidates' votes (their numbers) and a bounded sample of features."""
    spans = found.select(F.explode("candidates").alias("c")).select("c.*")
    # at most 4 kinds and 3 votes of each of 5 labelers: 972 rows
    counts = spans.groupBy("kind", "votes").count().collect()
    models = {}
    for kind in KINDS:
        patterns = {tuple(r[1]): r[2] for r in counts if r[0] == kind}
        if patterns:
            models[kind] = reliabilities(patterns)
    sample = (spans.select("kind", "votes", "features", "start", "end").orderBy(F.xxhash64("kind", "votes", "features", "start", "end"), "start", "end", "kind")
              .limit(SAMPLE).collect())
    if not sample:
        return SpanClassifier(np.append(np.zeros(FEATURES), -8.0))
    targets = np.array([_posterior(np.array([r[1]]), *models[r[0]])[0] for r in sample])
    return SpanClassifier(fit([r[2] for r in sample], targets))


def decide(found: DataFrame, model: SpanClassifier) -> DataFrame:
    """Adds ``spans`` (start, end, kind, base; by start, then kind as listed) to each row: the base spans, and the
    candidates of which the classifier is certain."""
    shared = found.sparkSession.sparkContext.broadcast(model)
    last = found.columns.index("candidates")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(last):
                spans = value.as_py()
                kept = [(c["start"], KINDS.index(c["kind"]), c["end"], True) for c in spans if c["strict"]]
                for c in spans:
                    if not c["strict"] and shared.value.probability(c["features"]) >= CERTAIN:
                        kept.append((c["start"], KINDS.index(c["kind"]), c["end"], False))
                rows.append([{"start": a, "end": b, "kind": KINDS[k], "base": sure} for a, k, b, sure in sorted(kept)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, "spans"])

    schema = ", ".join(f"`{c}` {t}" for c, t in found.dtypes)
    return found.mapInArrow(choose, f"{schema}, spans array<struct<start:long,end:long,kind:string,base:boolean>>")


def find_personal_data(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row and ``spans`` (start, end, kind, base) of its whole text, in code points.

    Null and empty texts have no spans; repeated rows are each reported; an empty table gives an empty
    result.  Columns named candidates or spans cannot be kept.
    """
    found = store(candidates(docs, text_col, keep), "pii-candidates")
    return decide(found, learn(found)).drop("candidates")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: str, spans: list[dict]) -> str:
    """The text with each span (of overlapping ones their union) as the upper-case kind of its first in angle brackets."""
    out, at = [], 0
    for i, s in enumerate(spans):
        if s["start"] >= at:
            out += [text[at:s["start"]], f"<{s['kind'].upper()}>"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, model: SpanClassifier, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data of the text column replaced by its kind; null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value in batch.column(at):
                text = value.as_py()
                if text:
                    base = base_spans(text)
                    added = [c for c in other_candidates(text, base) if shared.value.probability(features(text, *c)) >= CERTAIN]
                    kept = [{"start": a, "end": b, "kind": k} for a, b, k in base + added]
                    text = redact(text, sorted(kept, key=lambda s: (s["start"], KINDS.index(s["kind"]))))
                texts.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(clean, docs.schema)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document: the numbers of base spans, their digest, and all spans."""
    found = find_personal_data(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(number(k) for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
