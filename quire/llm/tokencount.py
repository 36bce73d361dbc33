"""Word-piece token counts by a linear longest-match automaton.

A vocabulary trie gets failure links with the number of pieces that following a link pops
(computed once, breadth first).  A word is then read once, character by character: the count
of its greedy longest-match pieces comes out without building a piece and without going back.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Memo, read_table

#: What starts a piece inside a word, as in the word-piece vocabularies in use.
CONTINUED = "##"


class LongestMatch:
    """The automaton.  State 0 is the start of a word, state 1 the start of a continued piece."""

    def __init__(self, vocabulary: Iterable[str], continued: str = CONTINUED):
        step: dict[tuple[int, str], int] = {}
        final, parents = [False, False], [(0, ""), (0, "")]
        for piece in vocabulary:
            at, rest = (1, piece[len(continued):]) if piece.startswith(continued) and len(piece) > len(continued) else (0, piece)
            if not rest:
                continue
            for c in rest:
                to = step.get((at, c))
                if to is None:
                    to = step[at, c] = len(final)
                    final.append(False)
                    parents.append((at, c))
                at = to
            final[at] = True
        # link: where to go on after popping pops pieces; -1: no match
        link, pops = [-1] * len(final), [0] * len(final)
        children: dict[int, list[int]] = {}
        for at, (up, _) in enumerate(parents):
            if at > 1:
                children.setdefault(up, []).append(at)
        todo = deque(children.get(0, []) + children.get(1, []))
        while todo:
            at = todo.popleft()
            todo.extend(children.get(at, []))
            if final[at]:
                link[at], pops[at] = 1, 1
                continue
            up, c = parents[at]
            to, popped = link[up], pops[up]
            while to >= 0 and (to, c) not in step:
                popped += pops[to]
                to = link[to]
            if to >= 0:
                link[at], pops[at] = step[to, c], popped
        self.step, self.link, self.pops = step, link, pops

    def count(self, word: str) -> int:
        """Pieces of the word; 0 if greedy matching cannot cover it."""
        step, link, pops = self.step, self.link, self.pops
        at, n = 0, 0
        for c in word:
            to = step.get((at, c))
            while to is None:
                n += pops[at]
                at = link[at]
                if at < 0:
                    return 0
                to = step.get((at, c))
            at = to
        while at != 1:  # what is left must fall back to the start of a continued piece
            n += pops[at]
            at = link[at]
            if at < 0:
                return 0
        return n


def word_pieces_of_byte_bpe(path: str) -> list[str]:
    """The vocabulary of a byte-level BPE file as word pieces: what begins with a space begins
    a word, the rest continues one; fragments of characters are left out."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    pieces = []
    for token in vocabulary:
        if any(c not in byte_of for c in token):
            continue
        try:
            text = bytes(byte_of[c] for c in token).decode("utf-8")
        except UnicodeDecodeError:
            continue
        piece = text[1:] if text.startswith(" ") else CONTINUED + text
        if text.strip() and not any(c.isspace() for c in text.strip() + piece):
            pieces.append(piece)
    return pieces


@lru_cache(maxsize=2)
def _automaton(path: str) -> LongestMatch:
    return LongestMatch(word_pieces_of_byte_bpe(path))


#: Words: runs of letters, digits and marks, or one other sign.
WORD = re.compile(r"\w+|[^\w\s]")


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens, n_unknown): words of the whole text, their greedy longest-match
    pieces, and the words that no pieces cover (one token each).

    A null or empty text has zeros; repeated rows are counted each; an empty table gives an
    empty result; other columns are not read.  Work is linear in the text, whatever a word's
    length; one bounded memory of words per worker spares repeats.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Memo(_automaton(vocabulary_path).count)
        for batch in batches:
            out = [[], [], []]
            for text in batch.column(1):
                words = WORD.findall(text.as_py() or "")
                counts = [pieces[w] for w in words]
                unknown = counts.count(0)
                for column, value in zip(out, (len(words), sum(counts) + unknown, unknown)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out)],
                                             names=["id", "n_words", "n_tokens", "n_unknown"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(count, f"id {kind}, n_words long, n_tokens long, n_unknown long")
            .withColumnRenamed("id", id_col))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece counts of every whole document."""
    import public_tokenizers
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
