"""Phrase collocations by Toivonen's sampled mining.

A sample of the documents proposes phrases that may be frequent.  Their negative border are the phrases
that are not proposed themselves but whose parts all are: no frequent phrase outside of both can be missed
without one of the border turning out frequent.  One pass over all documents counts proposals and border
exactly.  Where phrases of the border are frequent, phrases made of them may be as well; further passes
count those, until a pass finds nothing that could be extended.

Whether a phrase was proposed, or found frequent, is asked of a bit table of bounded size that knows every such
phrase and takes a few others for one.  Who is taken for one wrongly is only counted more exactly than needed:
the answer is the same in every task, so every occurrence of a phrase is treated alike and no count is lost.

Proposed phrases are counted by their words.  The border, which is large and rarely frequent, is counted by
64-bit hashes first: a hash that occurs too rarely proves that its phrases do; the rest are counted by their
words in the next pass.  No hash decides a result.

Counts leave a task as blocks of sorted arrays, one for each language and range of hashes, and are added up
range by range, so neither a language nor a word that makes up a third of the rows meets in one task.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import MASK64, Memo, read_table, store

#: Words of a phrase, occurrences of a candidate, phrases reported of each language.
MOST_WORDS, LEAST, TOP = 3, 10, 2000
#: A candidate goes when a longer one around it has at least so many hundredths of its occurrences.
COVERED = 50
#: The sample is one of so many documents; a phrase is proposed from so many occurrences in it on.
SAMPLE, LEAST_IN_SAMPLE = 8, 2
#: Words that a task counts at once.
CHUNK_WORDS = 1 << 20
#: Ranges of hashes at least, and words of the table for each range beyond.
LEAST_RANGES, WORDS_OF_RANGE = 256, 1 << 19
#: Bits of a bit table for each phrase, and at most (then more phrases are taken for proposed ones).
BITS_OF_PHRASE, MOST_BITS = 16, 1 << 28

_NO_LANGUAGE = "und"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_END = b"."
_JOIN, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BLOCKS = "lang string, range int, keys binary, counts binary, names binary, name_counts binary"
_FOUND = "lang string, phrase string, words int, key long, n long"


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text (A to Z lower-cased), with ``_END`` between and after its pieces."""
    out = (text or b"").translate(_LOWER).replace(_END, b" . ").split()
    out.append(_END)
    return out


def _word_hash(word: bytes) -> int:
    return 0 if word == _END else xxhash.xxh64_intdigest(word) | 1


def joined(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase, given that of all but its last word and that word's."""
    x = (key ^ (key >> np.uint64(29))) * np.uint64(_JOIN) + word
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(31))


def phrase_key(lang: str, words: list[bytes]) -> int:
    """The same hash for one phrase."""
    key = xxhash.xxh64_intdigest(lang.encode())
    for word in words:
        x = ((key ^ (key >> 29)) * _JOIN + _word_hash(word)) & MASK64
        x = ((x ^ (x >> 32)) * _MIX) & MASK64
        key = x ^ (x >> 31)
    return key


class Known:
    """A bit table of hashes: all that were put in are known, and a few others."""

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    @classmethod
    def of(cls, keys: DataFrame) -> Known:
        """From a column ``key``; two bits a hash, set inside Spark, at most MOST_BITS / 64 numbers come to the driver."""
        bits = max(16, min(math.ceil(math.log2(MOST_BITS)), math.ceil(math.log2(max(1, keys.count()) * BITS_OF_PHRASE))))
        places = F.array(F.shiftrightunsigned("key", 64 - bits), F.col("key").bitwiseAND((1 << bits) - 1))
        numbers = (keys.select(F.explode(places).alias("place")).groupBy(F.shiftright("place", 6).alias("at"))
                   .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("set")).toArrow())
        table = np.zeros((1 << bits) >> 6, np.int64)
        table[numbers["at"].to_numpy()] = numbers["set"].to_numpy()
        return cls(bits, table.view(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        def bit(place: np.ndarray) -> np.ndarray:
            return (self.table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1)

        found = bit(keys >> np.uint64(64 - self.bits)).view(bool)
        at = np.flatnonzero(found)
        found[at] = bit(keys[at] & np.uint64((1 << self.bits) - 1)).view(bool)
        return found


class Levels:
    """The phrases of 1, 2, ... words that begin at each place of a run of words."""

    def __init__(self, lang: str, hashes: np.ndarray, most: int):
        self.places, self.keys = [np.flatnonzero(hashes)], []
        seed = np.full(len(self.places[0]), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
        self.keys.append(joined(seed, hashes[self.places[0]]))
        for n in range(1, most):
            # a phrase goes on where the next place has a phrase of the same length
            follows = np.flatnonzero(np.diff(self.places[-1]) == 1)
            self.places.append(self.places[-1][follows])
            self.keys.append(joined(self.keys[-1][follows], hashes[self.places[-1] + n]))

    def of_known_parts(self, known: Known) -> list[np.ndarray]:
        """For each length, which phrases consist of known ones (single words always do)."""
        out = [np.ones(len(self.keys[0]), bool)]
        for n in range(1, len(self.keys)):
            part = known.has(self.keys[n - 1])
            follows = np.flatnonzero(np.diff(self.places[n - 1]) == 1)
            out.append(part[follows] & part[follows + 1])
        return out


def _counted(levels: Levels, filters: list[Known]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: which phrases this pass counts by hash and which by their words.  ``filters`` are what
    was proposed and then what each earlier pass knew as frequent; none: everything is counted by hash."""
    if not filters:
        for n, keys in enumerate(levels.keys):
            yield n, np.ones(len(keys), bool), np.zeros(len(keys), bool)
        return
    parts = [levels.of_known_parts(f) for f in filters]
    for n, keys in enumerate(levels.keys):
        now = parts[-1][n].copy()
        for earlier in parts[:-1]:
            now &= ~earlier[n]
        if len(filters) == 1:  # the proposals and their border
            proposed = now.copy()
            at = np.flatnonzero(now)
            proposed[at] = filters[0].has(keys[at])
            yield n, now & ~proposed, proposed
            continue
        if len(filters) == 2:  # what failed in the border gets its words
            failed = np.flatnonzero(parts[0][n])
            failed = failed[filters[1].has(keys[failed])]
            now[failed[~filters[0].has(keys[failed])]] = True
        yield n, np.zeros(len(keys), bool), now


def _blocks(lang: str, words: list[bytes], memo: Memo, filters: list[Known], most: int, ranges: int) -> Iterator[tuple]:
    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    levels = Levels(lang, hashes, most)
    found = []
    for n, by_hash, by_words in _counted(levels, filters):
        keys, counts = np.unique(levels.keys[n][by_hash], return_counts=True)
        names, first, name_counts = np.unique(levels.keys[n][by_words], return_index=True, return_counts=True)
        places = levels.places[n][by_words][first].tolist()
        phrases = [words[a] for a in places] if n == 0 else [b" ".join(words[a:a + n + 1]) for a in places]
        borders = np.arange(ranges + 1, dtype=np.uint64) << np.uint64(64 - ranges.bit_length() + 1) if ranges > 1 else np.zeros(2, np.uint64)
        cuts, name_cuts = np.searchsorted(keys, borders).tolist(), np.searchsorted(names, borders).tolist()
        cuts[-1], name_cuts[-1] = len(keys), len(names)
        found.append((keys, counts.astype(np.uint32), phrases, name_counts.astype(np.uint32), cuts, name_cuts))
    if len(filters) == 1:  # all words of the language, as the phrase of none
        yield lang, 0, b"", b"", b"", np.uint32(len(levels.keys[0])).tobytes()
    for r in range(ranges):
        keys = b"".join(k[c[r]:c[r + 1]].tobytes() for k, _, _, _, c, _ in found if c[r] < c[r + 1])
        names = [p for _, _, ps, _, _, c in found for p in ps[c[r]:c[r + 1]]]
        if keys or names:
            yield (lang, r, keys, b"".join(k[c[r]:c[r + 1]].tobytes() for _, k, _, _, c, _ in found), b"\n".join(names),
                   b"".join(k[c[r]:c[r + 1]].tobytes() for _, _, _, k, _, c in found))


def _merged(least: int):
    """Adds up the blocks of one language and range: what occurs ``least`` times, and the number of all words."""
    def merge(table: pa.Table) -> pa.Table:
        lang = table["lang"][0].as_py()
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint64)
        counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint32)
        out = []
        if len(keys):
            order = np.argsort(keys)
            keys = keys[order]
            begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sums = np.add.reduceat(counts[order].astype(np.int64), begins)
            often = np.flatnonzero(sums >= least)
            out = [(None, None, k, n) for k, n in zip(keys[begins[often]].view(np.int64).tolist(), sums[often].tolist())]
        names: dict[bytes, int] = defaultdict(int)
        for blob, numbers in zip(table["names"].to_pylist(), table["name_counts"].to_pylist()):
            if numbers:
                for name, n in zip(blob.split(b"\n"), np.frombuffer(numbers, np.uint32).tolist()):
                    names[name] += n
        for name, n in names.items():
            if n >= least or not name:
                words = name.split(b" ") if name else []
                key = phrase_key(lang, words)
                out.append((name.decode("utf-8", "replace"), len(words), key - (key >> 63 << 64), n))
        return pa.table([pa.array([lang] * len(out), pa.string()), pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()),
                         pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.int64())], names=["lang", "phrase", "words", "key", "n"])

    return merge


def _pass(texts: DataFrame, filters: list[Known], least: int, most: int, ranges: int, label: str) -> DataFrame:
    """One pass over ``texts`` (lang, text): the frequent ones of what it counts, written."""
    shared = texts.sparkSession.sparkContext.broadcast([(f.bits, f.table) for f in filters])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, memo = [Known(*f) for f in shared.value], Memo(_word_hash)
        waiting: dict[str, list[bytes]] = defaultdict(list)
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, words in waiting.items():
                rows = list(_blocks(lang, words, memo, known, most, ranges))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
                                                  *(pa.array([r[i] for r in rows], pa.binary()) for i in range(2, 6))],
                                                 names=["lang", "range", "keys", "counts", "names", "name_counts"])
            waiting.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                words = words_of(text.as_py())
                size += len(words)
                waiting[lang.as_py()] += words
                if size >= CHUNK_WORDS:
                    yield from flush()
                    size = 0
        yield from flush()

    return store(texts.mapInArrow(count, _BLOCKS).groupBy("range", "lang").applyInArrow(_merged(least), _FOUND), label)


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", least: int = LEAST, most: int = MOST_WORDS) -> DataFrame:
    """(lang, phrase, words, n): every phrase of up to ``most`` words with at least ``least`` occurrences in its language, counted
    exactly over all documents, and for each language the empty phrase with the number of all its words.

    Texts are lower-cased (A to Z), cut into pieces at ``.,;:!?`` and line ends, and those into words at spaces and tabs;
    occurrences may overlap and never cross pieces.  A null language is ``und``, null and empty texts have no words, repeated rows
    count each; an empty table gives an empty result.  A very long text is counted together with others of its batch, whole.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(_NO_LANGUAGE))
    texts = docs.select(lang.alias("lang"), F.col(text_col).cast("binary").alias("text"))
    sample = docs.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(SAMPLE)) == 0)
    words = docs.agg(F.sum(F.length(text_col).cast("long") / 4)).first()[0] or 0  # about: only the number of ranges follows from it
    ranges = 1 << (max(LEAST_RANGES, int(words) // WORDS_OF_RANGE) - 1).bit_length()
    sampled = sample.select(lang.alias("lang"), F.col(text_col).cast("binary").alias("text"))
    proposed = _pass(sampled, [], LEAST_IN_SAMPLE, most, ranges, "phrases-proposed")
    filters = [Known.of(proposed.select("key"))]
    found = _pass(texts, filters, least, most, ranges, "phrases-1")
    named, frequent = found.where("phrase IS NOT NULL"), found.where("phrase IS NULL OR phrase != ''").select("key")
    open_ = found.where("phrase IS NULL").limit(1).count()  # a failure in the border
    while open_:
        filters.append(Known.of(frequent))
        found = _pass(texts, filters, least, most, ranges, f"phrases-{len(filters)}")
        named = named.unionByName(found)
        fresh = found.where(F.col("words") < most).join(frequent, "key", "left_anti")
        open_ = fresh.limit(1).count()
        frequent = frequent.union(found.join(frequent, "key", "left_anti").select("key"))
    return named.select("lang", "phrase", "words", "n")


def collocations(counts: DataFrame, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language by score, from ``phrase_counts``.

    A phrase of two words or more occurs ``a`` times; cut into a first part (``l`` times) and a rest (``r`` times), it scores
    floor(1,000,000 a a / (l r)); the lowest-scoring cut counts, ties the earliest.  Phrases inside a longer one with at
    least ``covered`` hundredths of their occurrences are dropped.  Order: score, a, both falling, then the phrase's bytes.
    Products are decimals of 38 digits: exact up to 10 ** 16 occurrences.
    """
    exact, parts = "decimal(38,0)", F.split("phrase", " ")
    phrases = counts.where("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice(parts, i, n), " "))))
    around = (phrases.where("words >= 3").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around")))
    kept = phrases.join(around, ["lang", "phrase"], "left").where(F.coalesce(F.col("around") * 100 < F.col("a") * covered, F.lit(True)))
    cuts = kept.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice(parts, F.lit(1), F.col("cut")), " ").alias("left"),
                       F.array_join(F.slice(parts, F.col("cut") + 1, F.col("words") - F.col("cut")), " ").alias("right"))
    cuts = (cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
            .join(counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"]))
    million = F.lit(1_000_000).cast(exact) * F.col("a").cast(exact) * F.col("a").cast(exact)
    cuts = cuts.withColumn("x", million).withColumn("y", F.col("l").cast(exact) * F.col("r").cast(exact)).withColumn("score", F.expr("x div y").cast("long"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = best.select("lang", "phrase", "a", "best.l", "best.r", "best.score").withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(counts.where("words = 0").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of two or three words of each language."""
    return collocations(phrase_counts(read_table(spark, sf_dir, "documents")))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed),
words AS (SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM places),
occurring AS (
  SELECT lang, 1 AS words, a AS phrase FROM words
  UNION ALL SELECT lang, 2, a || ' ' || b FROM words WHERE b IS NOT NULL
  UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c FROM words WHERE c IS NOT NULL),
counts AS (SELECT lang, words, phrase, count(*) AS n FROM occurring GROUP BY lang, words, phrase HAVING count(*) >= 10),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
longer AS (SELECT lang, string_split(phrase, ' ') AS p, n FROM counts WHERE words = 3),
around AS (
  SELECT lang, phrase, max(n) AS m FROM (
    SELECT lang, p[1] || ' ' || p[2] AS phrase, n FROM longer UNION ALL SELECT lang, p[2] || ' ' || p[3], n FROM longer) GROUP BY lang, phrase),
kept AS (
  SELECT c.lang, c.words, c.phrase, c.n AS a, string_split(c.phrase, ' ') AS p FROM counts c LEFT JOIN around o ON o.lang = c.lang AND o.phrase = c.phrase
  WHERE c.words >= 2 AND coalesce(100 * o.m < 50 * c.n, true)),
cuts AS (
  SELECT lang, phrase, a, 1 AS k, p[1] AS first_part, CASE WHEN words = 2 THEN p[2] ELSE p[2] || ' ' || p[3] END AS rest FROM kept
  UNION ALL SELECT lang, phrase, a, 2, p[1] || ' ' || p[2], p[3] FROM kept WHERE words = 3),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.n AS l, y.n AS r,
         CAST((1000000::HUGEINT * c.a::HUGEINT * c.a::HUGEINT) // (x.n::HUGEINT * y.n::HUGEINT) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.first_part JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE place = 1)
SELECT r.lang, CAST(r.rank AS INTEGER) AS rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
