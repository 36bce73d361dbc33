"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight at each of a few knots of the training progress (0 to 1), linear in
between.  The integral of that schedule is the source's share of the words to be trained on; a source
gives at most ``most`` times its own words, and what it cannot give is shared anew among the others by
their weights.  At every moment a source is asked for words in proportion to its schedule, so the words
asked of it up to a moment grow from nothing to its target: its cumulative demand.

The documents of a source stand in a fixed random order, pass after pass.  The word in the middle of each
copy of a document is looked up in the inverted cumulative demand, which gives the moment at which it is
due, and the words of all sources up to that moment give its position in the training order.  Sorting by
ranges of positions lays the order out.

All of it is columns and aggregates.  Running sums inside a source are taken over buckets of the random
order at two levels, so a source of a third of all rows is many small windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import rank_within
from quire.llm.common import read_table, store

#: Words to train on, for each word there is; copies of a document at most.
SHARE, MOST = 1.5, 2
#: Rows of a bucket of the random order, on average over all sources, and buckets of a span.
BUCKET_ROWS, SPAN_BUCKETS = 512, 1024
#: Knots that a schedule may have.
MOST_KNOTS = 64

WORD = r"[^\x20\x09-\x0D]+"
_EXACT = "decimal(38,6)"


def _integrals(knots: tuple[float, ...]) -> list[Column]:
    """The schedule's integral from the first knot to each knot."""
    out = [F.lit(0.0)]
    for k in range(len(knots) - 1):
        out.append(out[-1] + (F.col("weights")[k] + F.col("weights")[k + 1]) / 2 * (knots[k + 1] - knots[k]))
    return out


def _moment(done: Column, knots: tuple[float, ...]) -> Column:
    """The progress at which the schedule's integral reaches ``done``."""
    integrals, found = _integrals(knots), F.lit(knots[0])
    for k in range(len(knots) - 1):
        low, high, span = F.col("weights")[k], F.col("weights")[k + 1], knots[k + 1] - knots[k]
        rest = done - integrals[k]
        root = F.sqrt(F.greatest(low * low + (high - low) / span * 2 * rest, F.lit(0.0)))
        found = F.when(rest > 0, F.least(F.lit(knots[k]) + rest * 2 / (low + root), F.lit(knots[k + 1]))).otherwise(found)
    return found


def _position(moment: Column, knots: tuple[float, ...], words: list[float], rates: list[float]) -> Column:
    """The words of all sources up to a moment, from their sum and rate at each knot."""
    found = F.lit(0.0)
    for k in range(len(knots) - 1):
        span, since = knots[k + 1] - knots[k], moment - knots[k]
        found = F.when(moment >= knots[k], F.lit(words[k]) + since * rates[k] + since * since * ((rates[k + 1] - rates[k]) / (2 * span))).otherwise(found)
    return found


def targets(sources: DataFrame, total: float, most: int = MOST) -> DataFrame:
    """``sources`` (with ``source_size`` and ``weight``) and the words each gives (``target``): by weight,
    at most ``most`` times its size, the excess shared anew until none is above.

    One number, the words for a weight of one, rises until no further source is capped; each step is one
    aggregate over the sources.  Sources without weight or words give none; sums are exact decimals, so
    reruns agree.  Where the others cannot give what is missing, the targets add up to less than ``total``.
    """
    level, capped, cap = 0.0, -1, F.col("source_size") * most
    while True:
        full = (F.col("weight") * level >= cap) & (F.col("weight") > 0) if capped >= 0 else F.lit(False)
        row = sources.agg(F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, cap)).alias("caps"),
                          F.sum(F.when(~full, F.col("weight")).cast("decimal(38,12)")).alias("free")).first()
        if row["n"] == capped or not row["free"]:
            break
        capped, level = row["n"], (total - float(row["caps"] or 0)) / float(row["free"])
    if not row["free"]:  # all that have a weight are full
        level = float("inf")
    return sources.withColumn("target", F.when(F.col("weight") > 0, F.least(cap.cast("double"), F.col("weight") * level)).otherwise(0.0))


def _running(rows: DataFrame, buckets: int) -> DataFrame:
    """For each source and bucket, the words of the source's earlier buckets (``before``)."""
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("n")).withColumn("span", F.floor(F.col("bucket") / SPAN_BUCKETS))
    spans = sums.groupBy("src", "span").agg(F.sum("n").alias("m"))
    spans = spans.select("src", "span", (F.sum("m").over(Window.partitionBy("src").orderBy("span")) - F.col("m")).alias("earlier"))
    inside = F.sum("n").over(Window.partitionBy("src", "span").orderBy("bucket")) - F.col("n")
    return sums.withColumn("inside", inside).join(spans, ["src", "span"]).select("src", "bucket", (F.col("inside") + F.col("earlier")).alias("before"))


def mixed(docs: DataFrame, schedules: DataFrame, knots: tuple[float, ...] = (0.0, 1.0), share: float = SHARE, most: int = MOST,
          id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: (id, size, source_size, target, taken, copies), with ``copies`` an array of
    (words, position): what each of its up to ``most`` copies gives and where it stands in training.

    ``schedules`` holds (source, weights): for every source, null too, its weight at each knot (null and
    negative: 0), one row a source; a source without a row gives nothing.  ``knots`` rise from 0 to 1, at most ``MOST_KNOTS``.  A size counts the words of
    the whole text (null and empty: 0, taken 0, no copies).  The documents of a source are taken in the
    order of a hash of their id; the last one is cut at the target, so a source's taken words are its
    target rounded down.  Repeated rows are rows of their own; rows with one id and size are ordered among each other
    at will, which gives the same result.  An empty table gives an empty result.  Only the named columns are read.
    """
    if not (2 <= len(knots) <= MOST_KNOTS and knots[0] == 0 and knots[-1] == 1 and all(a < b for a, b in zip(knots, knots[1:]))):
        raise ValueError(f"knots must rise from 0 to 1, at most {MOST_KNOTS}")
    order = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 16)
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    rows = store(docs.select(F.col(id_col).alias("id"), key.alias("src"), order.alias("place"),
                             F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    count, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    bits = min(31, max(0, count // BUCKET_ROWS).bit_length())
    rows = rows.withColumn("bucket", F.shiftright(F.conv(F.substring("place", 1, 8), 16, 10).cast("long"), 32 - bits))

    weights = schedules.select(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("src"),
                               F.col("weights").cast("array<double>").alias("weights"))
    none = F.array_repeat(F.lit(0.0), len(knots))
    weights = weights.withColumn("weights", F.transform("weights", lambda w: F.greatest(F.coalesce(w, F.lit(0.0)), F.lit(0.0))))
    sources = rows.groupBy("src").agg(F.sum("size").alias("source_size")).join(weights, "src", "left").withColumn("weights", F.coalesce("weights", none))
    sources = store(targets(sources.withColumn("weight", _integrals(knots)[-1]), share * (total or 0), most), "mix-targets")
    asked = F.when(F.col("weight") > 0, F.col("target") / F.col("weight")).otherwise(0.0)
    sums = sources.agg(*[F.sum((asked * x).cast(_EXACT)) for x in _integrals(knots)], *[F.sum((asked * F.col("weights")[k]).cast(_EXACT)) for k in range(len(knots))]).first()
    words, rates = [float(x or 0) for x in sums[:len(knots)]], [float(x or 0) for x in sums[len(knots):]]

    inside = F.sum("size").over(Window.partitionBy("src", "bucket").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = rows.withColumn("inside", inside).join(_running(rows, bits).join(sources, "src"), ["src", "bucket"])
    placed = placed.withColumn("begin", F.col("before") + F.col("inside")).withColumn("asked", F.floor("target"))

    def copy(n: int) -> Column:
        start = F.col("begin") + F.col("source_size") * n
        given = F.greatest(F.least(F.col("asked") - start, F.col("size")), F.lit(0)).cast("long")
        middle = (start + given / 2) / F.col("asked") * F.col("weight")
        position = F.when(given > 0, F.floor(_position(_moment(middle, knots), knots, words, rates)).cast("long"))
        return F.struct(given.alias("words"), position.alias("position"))

    copies = F.filter(F.array(*[copy(n) for n in range(most)]), lambda c: c["words"] > 0)
    placed = placed.withColumn("copies", copies)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), "copies")


def training_order(mix: DataFrame) -> DataFrame:
    """The copies that ``mixed`` placed, one row each with ``words`` and ``position`` instead of ``copies``,
    sorted by ranges of positions: part after part, this is the order of training."""
    rest = [c for c in mix.columns if c != "copies"]
    return mix.select(*rest, F.explode("copies").alias("copy")).select(*rest, "copy.words", "copy.position").orderBy("position", *rest[:1])


def turning_schedules(docs: DataFrame) -> DataFrame:
    """(source, weights): the sources by code point, null last, weigh 3, 1, 2, repeating, on the
    average; every other one rises from half of that to one and a half times, the others fall."""
    names = docs.select("source").distinct()
    ranked = rank_within(names, [], [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(F.lit(2.0), F.lit(3.0), F.lit(1.0)), F.col("rank") % 3 + 1)
    return ranked.select("source", F.when(F.col("rank") % 2 == 1, F.array(weight * 0.5, weight * 1.5)).otherwise(F.array(weight * 1.5, weight * 0.5)).alias("weights"))


def op13_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it, sorted by the position of its first copy."""
    docs = read_table(spark, sf_dir, "documents")
    first = F.array_min(F.transform("copies", lambda c: c["position"]))
    return (mixed(docs, turning_schedules(docs)).withColumn("first_position", first).drop("copies")
            .orderBy(F.col("first_position").asc_nulls_last(), "doc_id"))


OP13_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS place,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r
  FROM sized GROUP BY source),
weighed AS (SELECT *, [2.0, 3.0, 1.0][CAST(r % 3 AS INTEGER) + 1]::DOUBLE AS w FROM sources),
filling AS (
  SELECT *, coalesce(sum(2 * source_size) OVER o, 0) AS full_before, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS free
  FROM weighed WINDOW o AS (ORDER BY 2 * source_size / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(size) FROM sized)::DOUBLE - full_before::DOUBLE) / free::DOUBLE AS level FROM filling),
level AS (SELECT max(level) FILTER (WHERE w * level <= 2 * source_size) AS level FROM levels),
aimed AS (SELECT l.* EXCLUDE (level), least((2 * source_size)::DOUBLE, w * coalesce(level.level, 'inf'::DOUBLE)) AS target
          FROM levels l, level),
ramps AS (SELECT *, CASE WHEN r % 2 = 1 THEN w * 0.5::DOUBLE ELSE w * 1.5::DOUBLE END AS low, CASE WHEN r % 2 = 1 THEN w * 1.5::DOUBLE ELSE w * 0.5::DOUBLE END AS high FROM aimed),
rates AS (SELECT sum(CAST(target / w * low AS DECIMAL(38,6)))::DOUBLE AS a, sum(CAST(target / w * high AS DECIMAL(38,6)))::DOUBLE AS b FROM ramps),
placed AS (
  SELECT d.*, s.source_size, s.target, s.w, s.low, s.high, CAST(floor(s.target) AS BIGINT) AS asked,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS begin_at
  FROM sized d JOIN ramps s ON d.source IS NOT DISTINCT FROM s.source),
given AS (
  SELECT *, greatest(least(asked - begin_at, size), 0) AS first_words, greatest(least(asked - begin_at - source_size, size), 0) AS second_words FROM placed),
middles AS (SELECT *, CASE WHEN first_words > 0 THEN (begin_at + first_words::DOUBLE / 2) / asked * w END AS done FROM given),
moments AS (
  SELECT *, least(0.0::DOUBLE + done * 2 / (low + sqrt(greatest(low * low + (high - low) / 1.0::DOUBLE * 2 * done, 0.0::DOUBLE))), 1.0::DOUBLE) AS moment FROM middles)
SELECT doc_id, size, source_size, target, CAST(first_words + second_words AS BIGINT) AS taken,
       CASE WHEN first_words > 0 THEN CAST(floor(moment * a + moment * moment * ((b - a) / 2)) AS BIGINT) END AS first_position
FROM moments, rates
"""
