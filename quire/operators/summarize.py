"""Sentence graph summarisation (TextRank) as Spark jobs.

Pipeline: ``clean_text -> sentences -> tokens -> edges -> textrank -> select``.

* Sentences and tokens are produced inside the document row (array functions),
  so they need no shuffle.
* A document of at most ``in_row`` sentences is ranked inside its row (see ``sentence_graph``), and
  summary and key sentences are chosen there as well: no shuffle, no join.
* Larger documents are ranked by rounds over tiles; of their sentences only those go on that a summary can
  choose, whatever their number.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import WS, collapse_ws, explode_rows, is_ascii, js_trim
from quire.operators import sentence_graph as G
from quire.operators.sentence_graph import DAMPING, ITERATIONS, TOLERANCE  # noqa: F401

# --- fixed values -------------------------------------------------------------
DELIMS = "。！？.!?;；"
TOKEN_ASCII = "a-zA-Z0-9"
TOKEN_CLASS = TOKEN_ASCII + r"\x{4e00}-\x{9fa5}"
CJK_RE = r"[\x{4e00}-\x{9fa5}]"
# -----------------------------------------------------------------------------

SENTENCE_RE = f"[^{DELIMS}\n]+[{DELIMS}]?\n?"
# Java's regex engine is several times slower on classes holding non-ASCII
# members; the four full-width delimiters are mapped to control characters
# U+0001..U+0004 (char-for-char) for matching and mapped back afterwards, unless
# the text already holds such characters.
WIDE = "。！？；"
WIDE_AS = "\x01\x02\x03\x04"
FAST_DELIMS = ".!?;\x01\x02\x03\x04"
FAST_SENTENCE_RE = f"[^{FAST_DELIMS}\n]+[{FAST_DELIMS}]?\n?"
ASCII_SENTENCE_RE = "[^.!?;\n]+[.!?;]?\n?"
TAIL_RUN_RE = f"[{DELIMS}\n]*\\z"


def clean_text(c: Column) -> Column:
    """CRLF/CR -> LF; each line trimmed and whitespace-collapsed; blank lines dropped."""
    lines = F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n", -1)
    # each step binds its lines, so a test costs no second trim
    return F.array_join(F.transform(F.filter(F.transform(lines, js_trim), lambda l: l != ""), _collapsed), "\n")


def _collapsed(line: Column) -> Column:
    """``collapse_ws`` of a line; one of ASCII with single spaces alone stays as it is, found without a regex."""
    spaced = reduce(or_, (line.contains(w) for w in ("  ", "\t", "\x0b", "\x0c", "\r")))
    return F.when(is_ascii(line) & ~spaced, line).otherwise(collapse_ws(line))


def split_sentences(c: Column) -> Column:
    """array<string>: runs of non-delimiters plus one optional delimiter and
    newline, trimmed, blanks dropped; text left after the last run (a trailing
    run of extra delimiters) is one more sentence."""
    runs = F.filter(F.transform(F.regexp_extract_all(c, F.lit(SENTENCE_RE), 0), js_trim),
                    lambda s: s != "")
    has_body = c.rlike(f"[^{DELIMS}\n]")
    tail = F.when(has_body, F.regexp_replace(F.regexp_extract(c, TAIL_RUN_RE, 0),
                                             f"^[{DELIMS}]?\n?", "")).otherwise(c)
    tail = js_trim(tail)
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(
        F.when(tail != "", F.concat(runs, F.array(tail))).otherwise(runs))


def token_set(c: Column) -> Column:
    """array<string>: lower-cased words over [a-z0-9 CJK]; words holding CJK also
    contribute every character; distinct."""
    plain = F.regexp_extract_all(F.lower(c), F.lit(f"[{TOKEN_ASCII}]+"), 0)
    words = F.filter(F.split(F.lower(c), f"[^{TOKEN_CLASS}]+", -1), lambda w: w != "")
    chars = F.filter(F.flatten(F.transform(F.filter(words, lambda w: w.rlike(CJK_RE)),
                                           lambda w: F.split(w, "", -1))), lambda ch: ch != "")
    # the per-word CJK test only runs for text that holds CJK at all
    return F.array_distinct(F.when(is_ascii(c), plain).when(c.rlike(CJK_RE), F.concat(words, chars)).otherwise(words))


def with_sentences(df: DataFrame, text: str = "text", out: str = "ss", clean: bool = True) -> DataFrame:
    """Adds ``out`` = array of sentences of ``text`` (cleaned first).

    Written as stacked projections over named columns: each expensive piece
    (cleaning, the regex runs, the tail) is computed once and referenced by name,
    and Catalyst keeps projects apart when collapsing would duplicate them."""
    keep = [c for c in df.columns if c != out]
    d = df.withColumn("_c", clean_text(F.col(text)) if clean else F.col(text))
    c = F.col("_c")
    # cleaned text holds no whitespace but single spaces and newlines
    trim = (lambda x: F.btrim(x, F.lit(" \n"))) if clean else js_trim
    # (0: no full-width delimiter, 1: mapped, 2: matched as it stands); the first holds for most texts and copies nothing
    d = d.withColumn("_way", F.when(is_ascii(c) | ~reduce(or_, (c.contains(w) for w in WIDE)), 0).when(~c.rlike("[\\x{01}-\\x{04}]"), 1).otherwise(2))
    way = F.col("_way")
    cf = F.translate(c, WIDE, WIDE_AS)
    runs = (F.when(way == 0, F.regexp_extract_all(c, F.lit(ASCII_SENTENCE_RE), 0))
            .when(way == 1, F.transform(F.regexp_extract_all(cf, F.lit(FAST_SENTENCE_RE), 0), lambda s: F.translate(s, WIDE_AS, WIDE)))
            .otherwise(F.regexp_extract_all(c, F.lit(SENTENCE_RE), 0)))
    # the run of delimiters at the end is what the text loses when trimmed by them
    end = F.substring(c, F.length(F.rtrim(c, F.lit(DELIMS + "\n"))) + 1, F.length(c))
    d = d.select(*keep, "_c", F.filter(F.transform(runs, trim), lambda s: s != "").alias("_runs"),
                 trim(F.when(F.btrim(c, F.lit(DELIMS + "\n")) != "", F.regexp_replace(end, f"^[{DELIMS}]?\n?", "")).otherwise(c)).alias("_tail"))
    ss = (F.when(F.col("_c").isNull() | (F.col("_c") == ""), F.array().cast("array<string>"))
          .when(F.col("_tail") != "", F.concat(F.col("_runs"), F.array(F.col("_tail"))))
          .otherwise(F.col("_runs")))
    return d.select(*keep, ss.alias(out))


def sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pos, text) from ``docs(doc_id, text)``, pos 0-based."""
    ss = with_sentences(docs.select("doc_id", text), text, "ss")
    return explode_rows(ss, F.col("ss"), ["doc_id"], "pos", "text")


def sentence_tokens(nodes: DataFrame, idx: str = "pos") -> DataFrame:
    """(doc_id, idx, n_tokens, token) — one row per distinct token of a node."""
    t = nodes.select("doc_id", F.col(idx).alias("idx"), token_set(F.col("text")).alias("toks"))
    t = t.select("doc_id", "idx", F.size("toks").alias("n_tokens"), "toks")
    return explode_rows(t, F.col("toks"), ["doc_id", "idx", "n_tokens"], "_k", "token").drop("_k")


def token_hashes(ss: Column) -> Column:
    """array<array<long>>: the token set of each sentence, as hashes."""
    return F.transform(ss, lambda s: F.transform(token_set(s), lambda t: F.xxhash64(t)))


def maybe_large(docs: DataFrame, text: str, in_row: int) -> DataFrame | None:
    """The documents that may have more than ``in_row`` sentences: a sentence is a run of other characters, ended by a
    delimiter or a line.  One scan that counts characters, and in long texts the ends of runs (``!!`` ends one, not two); None
    where there are none, so that nothing of the distributed path is planned.  Only these are split a second time."""
    ends = F.length(text) - F.length(F.translate(F.col(text), DELIMS + "\r\n", ""))
    runs = F.regexp_count(text, F.lit(f"[^{DELIMS}\r\n][{DELIMS}\r\n]"))
    some = docs.where((F.length(text) + 2 > in_row) & (ends + 2 > in_row) & (runs + 2 > in_row))  # most texts are too short anyway
    return None if some.isEmpty() else some


def _ranked_large(rows: DataFrame, ids: list[str], ss: str, block: int) -> DataFrame:
    """(ids, idx, score, iterations) by the distributed path, for the rows of large documents."""
    return G.rank_large(rows.select(*ids, token_hashes(F.col(ss)).alias("tokens")), "tokens", tuple(ids), block)


def similarity_edges(docs: DataFrame, text: str = "text", in_row: int = G.IN_ROW, block: int = G.BLOCK) -> DataFrame:
    """(doc_id, i, j, sim), both directions, of the sentences of ``docs(doc_id, text)`` with sim > 0."""
    def tokens(some: DataFrame) -> DataFrame:
        return with_sentences(some.select("doc_id", text), text, "ss").select("doc_id", token_hashes(F.col("ss")).alias("tokens"))

    many = maybe_large(docs, text, in_row)
    return G.similarity(tokens(docs), in_row=in_row, block=block, large=None if many is None else tokens(many), both=True)


def textrank(docs: DataFrame, text: str = "text", in_row: int = G.IN_ROW, block: int = G.BLOCK) -> DataFrame:
    """(doc_id, pos, score, iterations) of every sentence of ``docs(doc_id, text)``."""
    ss = with_sentences(docs.select("doc_id", text), text, "ss")
    small = F.when(F.size("ss") <= in_row, token_hashes(F.col("ss")))
    ranked = ss.select("doc_id", G.rank_in_row(small).alias("r")).select("doc_id", "r.scores", "r.iterations")
    out = explode_rows(ranked, F.col("scores"), ["doc_id", "iterations"], "pos", "score").select("doc_id", "pos", "score", "iterations")
    many = maybe_large(docs, text, in_row)
    if many is not None:
        large = with_sentences(many.select("doc_id", text), text, "ss").where(F.size("ss") > in_row)
        large = _ranked_large(large, ["doc_id"], "ss", block)
        out = out.unionByName(large.select("doc_id", F.col("idx").cast("int").alias("pos"), "score", "iterations"))
    return out


def _fold(order: Column, max_length: int, min_sentences: int) -> Column:
    """array<int>: the positions that a walk over ``order`` (structs with pos and len, best first) takes."""
    init = F.struct(F.lit(0).cast("long").alias("cur"), F.lit(0).alias("n"), F.lit(False).alias("stop"),
                    F.array().cast("array<int>").alias("picked"))

    def step(acc, x):
        take = (~acc["stop"]) & (((acc["cur"] + x["len"]) <= max_length) | (acc["n"] < min_sentences))
        cur = F.when(take, acc["cur"] + x["len"]).otherwise(acc["cur"])
        n = F.when(take, acc["n"] + 1).otherwise(acc["n"])
        return F.struct(cur.alias("cur"), n.alias("n"),
                        (acc["stop"] | ((cur >= max_length) & (n >= min_sentences))).alias("stop"),
                        F.when(take, F.concat(acc["picked"], F.array(x["pos"]))).otherwise(acc["picked"]).alias("picked"))

    return F.aggregate(order, init, step)["picked"]


def choosable(ranked: DataFrame, ids: list[str], max_length: int, min_sentences: int) -> DataFrame:
    """The rows of ``ranked(ids, pos, len, score)`` that a summary can choose.

    Sentences of one length are met best first, and once one of them does not fit, none of that length does:
    at most ``max_length / length`` fit and ``min_sentences`` are taken although they do not.  Longer ones than
    ``max_length`` never fit.  So a document of any size leaves about max_length * (ln(max_length) + min_sentences)
    rows, cut before the shuffle by the window's own limit, length by length."""
    of_length = F.least("len", F.lit(max_length + 1))
    place = F.row_number().over(Window.partitionBy(*ids, "of_length").orderBy(F.desc("score"), "pos"))
    limit = F.floor(F.lit(max_length) / F.col("of_length")) + min_sentences
    # one limit for all lengths lets the planner cut early; the exact one follows
    return (ranked.withColumn("of_length", of_length).withColumn("place", place).where(F.col("place") <= max_length + min_sentences)
            .where(F.col("place") <= limit).drop("of_length", "place"))


def _summary_in_row(rows: DataFrame, max_length: int, min_sentences: int, in_row: int) -> DataFrame:
    """Adds ``summary`` to rows with ``clean`` and ``ss``; null for more than ``in_row`` sentences."""
    keep = rows.columns
    short = (F.length("clean") <= max_length) | (F.size("ss") <= min_sentences)
    rows = rows.withColumn("_short", short)
    rows = rows.withColumn("_r", G.rank_in_row(F.when(~F.col("_short") & (F.size("ss") <= in_row), token_hashes(F.col("ss")))))
    order = F.array_sort(F.transform(F.col("_r.scores"), lambda s, i: F.struct(
        (-F.round(s, 9)).alias("neg"), i.alias("pos"), F.length(F.get(F.col("ss"), i)).alias("len"))))
    rows = rows.withColumn("_order", order)
    rows = rows.withColumn("_picked", F.array_sort(_fold(F.col("_order"), max_length, min_sentences)))
    chosen = F.array_join(F.transform("_picked", lambda p: F.get(F.col("ss"), p)), "\n")
    return rows.select(*keep, F.when(F.col("_short"), F.col("clean")).otherwise(chosen).alias("summary"))


def _summary_large(rows: DataFrame, ids: list[str], max_length: int, min_sentences: int, block: int) -> DataFrame:
    """(ids, summary) of rows of any number of sentences, of which only choosable ones are gathered."""
    nodes = explode_rows(rows, F.col("ss"), ids, "pos", "text")
    scores = _ranked_large(rows, ids, "ss", block).select(*ids, F.col("idx").cast("int").alias("pos"), F.round("score", 9).alias("score"))
    ranked = nodes.select(*ids, "pos", F.length("text").alias("len")).join(scores, [*ids, "pos"])
    order = (choosable(ranked, ids, max_length, min_sentences).groupBy(*ids)
             .agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "pos", "len"))).alias("order")))
    picked = explode_rows(order, _fold(F.col("order"), max_length, min_sentences), ids, "_k", "pos").drop("_k")
    return (nodes.join(picked, [*ids, "pos"]).groupBy(*ids).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "\n").alias("summary")))


def summary_select(docs: DataFrame, max_length: int = 600, min_sentences: int = 3, in_row: int = G.IN_ROW, block: int = G.BLOCK) -> DataFrame:
    """(doc_id, summary): the cleaned text when it is short or has at most
    ``min_sentences`` sentences; otherwise sentences taken greedily by score
    (a sentence is taken if it fits or fewer than ``min_sentences`` are taken;
    a misfit is skipped, the walk stops once full), restored to text order and
    joined by newlines."""
    def split(some: DataFrame) -> DataFrame:
        return with_sentences(some.select("doc_id", clean_text(F.col("text")).alias("clean")), "clean", "ss", clean=False)

    out = _summary_in_row(split(docs), max_length, min_sentences, in_row)
    many = maybe_large(docs, "text", in_row)
    if many is None:
        return out.select("doc_id", "summary")
    large = split(many).where((F.size("ss") > in_row) & (F.length("clean") > max_length) & (F.size("ss") > min_sentences))
    return out.where("summary IS NOT NULL OR clean IS NULL").select("doc_id", "summary").unionByName(_summary_large(large, ["doc_id"], max_length, min_sentences, block))


def _keys_in_row(rows: DataFrame, k: int, min_length: int, in_row: int) -> DataFrame:
    """Adds ``keys``, an array of (position, score, text) in position order, to rows with ``ss``; null for more
    than ``in_row`` sentences."""
    keep = rows.columns
    valid = F.filter("ss", lambda s: F.length(s) >= min_length)
    rows = rows.withColumn("_valid", valid)
    many = (F.size("_valid") > k) & (F.size("ss") <= in_row)
    rows = rows.withColumn("_r", G.rank_in_row(F.when(many, token_hashes(F.col("_valid")))))
    best = F.slice(F.array_sort(F.transform(F.col("_r.scores"), lambda s, i: F.struct(
        (-F.round(s, 9)).alias("order"), i.alias("vidx"), s.alias("score")))), 1, k)
    rows = rows.withColumn("_best", best)
    found = F.array_sort(F.transform("_best", lambda b: F.struct(
        (F.array_position(F.col("ss"), F.get(F.col("_valid"), b["vidx"])) - 1).cast("int").alias("position"), (-b["score"]).alias("neg"), b["vidx"].alias("vidx"),
        F.get(F.col("_valid"), b["vidx"]).alias("text"))))
    few = F.transform("_valid", lambda s, i: F.struct(i.alias("position"), F.lit(1.0).alias("score"), s.alias("text")))
    keys = F.when(F.size("_valid") <= k, few).otherwise(F.transform(found, lambda x: F.struct(x["position"], (-x["neg"]).alias("score"), x["text"])))
    return rows.select(*keep, keys.alias("keys"))


def _keys_large(rows: DataFrame, ids: list[str], k: int, min_length: int, block: int) -> DataFrame:
    """(ids, rank, position, score, text) of rows of any number of sentences."""
    rows = rows.select(*ids, F.col("ss"), F.filter("ss", lambda s: F.length(s) >= min_length).alias("valid")).where(F.size("valid") > k)
    scores = _ranked_large(rows, ids, "valid", block).select(*ids, F.col("idx").cast("int").alias("vidx"), "score")
    best = Window.partitionBy(*ids).orderBy(F.round("score", 9).desc(), "vidx")
    top = scores.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
    nodes = explode_rows(rows, F.col("valid"), ids, "vidx", "text")
    top = nodes.join(top, [*ids, "vidx"])
    first = (explode_rows(rows, F.col("ss"), ids, "pos", "text").join(top.select(*ids, "text").distinct(), [*ids, "text"], "left_semi")
             .groupBy(*ids, "text").agg(F.min("pos").cast("int").alias("position")))
    rank = F.row_number().over(Window.partitionBy(*ids).orderBy("position", F.col("score").desc(), "vidx"))
    return top.join(first, [*ids, "text"]).withColumn("rank", rank).select(*ids, "rank", "position", "score", "text")


def key_sentences(docs: DataFrame, k: int = 5, min_length: int = 20, in_row: int = G.IN_ROW, block: int = G.BLOCK) -> DataFrame:
    """(doc_id, rank, position, score, text): sentences of at least ``min_length``
    chars; when there are at most ``k`` they are all returned with score 1 and
    their index among them; otherwise the ``k`` best by TextRank over those
    sentences, positioned at the first equal sentence, in position order."""
    rows = with_sentences(docs.select("doc_id", "text"), "text", "ss")
    keyed = _keys_in_row(rows, k, min_length, in_row)
    out = (explode_rows(keyed, F.col("keys"), ["doc_id"], "pos", "key")
           .select("doc_id", (F.col("pos") + 1).alias("rank"), "key.position", "key.score", "key.text"))
    many = maybe_large(docs, "text", in_row)
    if many is not None:
        large = with_sentences(many.select("doc_id", "text"), "text", "ss").where(F.size("ss") > in_row)
        out = out.unionByName(_keys_large(large, ["doc_id"], k, min_length, block))
    return out


def key_point_pages(keys: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, rank, page): ``min(floor(position / n_keys * n_pages) + 1, n_pages)``."""
    n_keys = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return (keys.withColumn("n_keys", n_keys).join(pages.select("doc_id", "n_pages"), "doc_id")
            .select("doc_id", "rank",
                    F.least(F.floor(F.col("position") / F.col("n_keys") * F.col("n_pages")) + 1,
                            F.col("n_pages")).cast("int").alias("page")))


def section_summaries(docs: DataFrame, delimiter: str = r"\n(?=#{1,6} )", max_length: int = 300,
                      in_row: int = G.IN_ROW, block: int = G.BLOCK) -> DataFrame:
    """(doc_id, section_no, title, summary, key_points): cleaned text split by
    ``delimiter``; first line is the title (``Untitled Section`` when blank);
    sections whose body is under 50 characters are skipped; body summarised
    with at least two sentences, plus three key points of 10+ characters.
    Summary and key points are made in the section's row (no shuffle)."""
    def split(some: DataFrame) -> DataFrame:
        secs = some.select("doc_id", F.split(clean_text(F.col("text")), delimiter, -1).alias("ss"))
        secs = explode_rows(secs, F.col("ss"), ["doc_id"], "section_no", "sec")
        secs = secs.where(js_trim("sec") != "")
        lines = F.split("sec", "\n", -1)
        secs = secs.select("doc_id", "section_no",
                           F.when(js_trim(F.element_at(lines, 1)) == "", F.lit("Untitled Section"))
                           .otherwise(js_trim(F.element_at(lines, 1))).alias("title"),
                           F.array_join(F.slice(lines, 2, 1 << 30), "\n").alias("clean"))
        return with_sentences(secs.where(F.length("clean") >= 50), "clean", "ss", clean=False)

    def told(rows: DataFrame) -> DataFrame:
        return _summary_in_row(_keys_in_row(rows, 3, 10, in_row), max_length, 2, in_row)

    done, points, ids, large = told(split(docs)), F.transform("keys", lambda x: x["text"]), ["doc_id", "section_no"], F.size("ss") > in_row
    many = maybe_large(docs, "text", in_row)
    if many is None:
        return done.select(*ids, "title", "summary", points.alias("key_points"))
    rows = split(many).where(large)
    found = told(rows)
    summaries = _summary_large(found.where(F.col("summary").isNull()), ids, max_length, 2, block).withColumnRenamed("summary", "chosen")
    ranked = _keys_large(rows, ids, 3, 10, block).groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("best"))
    found = found.join(summaries, ids, "left").join(ranked, ids, "left")
    none = F.array().cast("array<string>")
    found = found.select(*ids, "title", F.coalesce("summary", "chosen").alias("summary"), F.coalesce(F.transform("best", lambda x: x["text"]), points, none).alias("key_points"))
    return done.where(~large).select(*ids, "title", "summary", points.alias("key_points")).unionByName(found)
