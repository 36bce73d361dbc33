"""Benchmark decontamination by CGK embeddings and bit sampling.

The random walk of Chakraborty, Goldenberg and Koucky reads a string with a pointer that, at each
step, either stays or moves on, as a random function of the step and the symbol says.  Strings
at a small edit distance get embeddings at a small Hamming distance: after an edit the two walks
fall into step again.  A walk begins at every word of the texts and of the items.  It moves by a word's
first letter and samples the beginnings or endings of words, which mostly outlive an edit of the word.

Several walks (repeats) each sample some steps; the sampled symbols make one key per window.  A key says as much
as its symbols are rare among the items; only keys that say enough for the number of all keys are indexed, and with
more keys more steps are sampled, so the chance hits of a window stay as few.  The Hamming distance grows with the square of the
edits, so a walk reads only a few words; an item has a window at each of its words.

A hit places the item on the text.  Of all hits at once, the 64 bytes of the item around the hit are searched in the text there
(Myers' search, one machine word each); where they lie nearby, the item's whole length of text is verified
exactly.

Items of fewer than ``LEAST_WORDS`` words have too few windows for that.  They, and with ``thorough`` all items beside the walks, are found by
their characters, without loss: an item is cut into spans, of which one at least has no more than its
share of the edits, and a span into pieces of ``q`` characters.  An edit spoils one piece, so the
others stand in the text, shifted against each other by no more than the span's edits; where
so many pieces do, the span's segments are searched.  Its cost grows with the number of such items.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quire.llm.common import read_table

#: Walks, sampled steps of a walk at least, and steps of a walk besides.
WALKS, SAMPLED, BETWEEN = 8, 4, 2
#: Bits that a key says at least, beyond the logarithm of the number of a walk's keys; bits that a sampled step says, about.
SAYS_BEYOND, SAYS = 3.2, 5.5
#: Words of an item from which walks are relied on.
LEAST_WORDS = 12
#: An item is found when 1 - distance / length reaches this.
SIMILARITY = 0.8
#: Items, and bytes of items, that one pass over the documents looks for (their keys are broadcast).
ITEMS_OF_PASS, BYTES_OF_PASS = 20_000, 8 << 20
#: Hits of one item this near to each other in bytes are one; share of edits at which a segment counts as nearby.
BAND_BITS, NEARBY = 4, 0.32
BAND = 1 << BAND_BITS
#: Hits that are searched at once.
HITS_AT_ONCE = 1 << 17
#: Bands of shifts that are searched together, and segments.
BANDS, SEARCHED_AT_ONCE = 2, 8192
#: Windows of bands of which the pieces are told apart at once.
WINDOWS_AT_ONCE = 1 << 16
#: Places for spans and bands that a block of text has at most, as far as it can be cut.
CELLS = 1 << 20
#: Pieces that are looked at at once, and classes of characters.
PIECES_AT_ONCE, CLASSES = 1 << 22, 64
#: Words that are walked over at once.
CHUNK_WORDS = 1 << 15

#: Characters of a segment (the bits of a word) and of a span at most.
SEGMENT, SPAN = 64, 256
#: Characters of a span from which its pieces have so many characters.
PIECE_SIZES = ((40, 4), (20, 3), (5, 2))

_STRIPPED = b".,;:!?\"'()[]{}|*_-"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 20
#: Added to shifts, so that none is negative.
_FAR = 1 << 30


_PLAIN = np.array([c not in _STRIPPED + b" " for c in range(256)])


def word_symbols(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of words with single spaces between them: beginning and ending (two bytes each) and first byte, packed (never 0), without
    punctuation around the word, and the byte at which each word starts."""
    buffer = np.frombuffer(text, np.uint8)
    spaces = np.flatnonzero(buffer == 32)
    starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(buffer)]])
    plain = _PLAIN[buffer]
    places, count = np.flatnonzero(plain), np.cumsum(plain, dtype=np.int32)
    before, upto = count[starts] - plain[starts], count[ends - 1]
    any_plain = upto > before
    places = np.append(places, 0)  # words of punctuation alone stay as they are
    first, last = np.where(any_plain, places[before], starts), np.where(any_plain, places[upto - 1], ends - 1)
    a, z, two = buffer[first].astype(np.int64), buffer[last].astype(np.int64), last > first
    beginning = np.where(two, a << 8 | buffer[np.minimum(first + 1, last)], a)
    ending = np.where(two, buffer[np.maximum(last - 1, first)].astype(np.int64) << 8 | z, z)
    return beginning | ending << 16 | a << 32, starts


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


class Walks:
    """The random walks: for each walk and step, where to move on and what to sample."""

    def __init__(self, sampled: int):
        rng = np.random.default_rng(20170619)
        self.steps = sampled + BETWEEN
        self.moves = rng.integers(0, 2, (WALKS, self.steps, 256)).astype(np.int64)
        self.endings = rng.integers(0, 2, (WALKS, self.steps)).astype(bool)
        self.samples = [set(rng.choice(self.steps, sampled, replace=False).tolist()) for _ in range(WALKS)]
        self.last = [max(s) for s in self.samples]

    def keys(self, symbols: np.ndarray, starts: np.ndarray, walk: int, says: np.ndarray | None = None):
        """The key of the window at each start under one walk; with ``says`` (bits of beginnings, then of endings) also what
        each key says.  ``symbols`` ends with zeros, as many as steps."""
        sides, first = (symbols & 0xFFFF, (symbols >> 16) & 0xFFFF), (symbols >> 32).astype(np.uint8)
        here, at, key = np.arange(len(symbols)), starts, np.full(len(starts), (walk + 1) * 0x632BE59B, np.uint64)
        bits, last = np.zeros(len(starts)), np.full(len(starts), -1)
        for step in range(self.steps):
            if step in self.samples[walk]:
                side = int(self.endings[walk, step])
                seen = np.take(sides[side], at)
                key ^= seen.view(np.uint64)
                key *= _MIX
                key ^= key >> np.uint64(29)
                if says is not None:
                    bits += np.where(at != last, says[side][seen], 0.0)
                    last = at
            if step < self.last[walk]:
                at = np.take(here + np.take(self.moves[walk, step], first), at)
        return key if says is None else (key, bits)


def allowed_edits(length: int, similarity: float) -> int:
    return int((1 - similarity) * length + 1e-9)


def _characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _classes(characters: np.ndarray) -> np.ndarray:
    return ((characters.astype(np.uint64) * _MIX) >> np.uint64(58)).astype(np.int64) if len(characters) else np.empty(0, np.int64)


def _piece_buckets(characters: np.ndarray, q: int) -> np.ndarray:
    """A number below 2 ** _TABLE_BITS for the ``q`` (at most four) characters from each place on."""
    last, low = max(0, len(characters) - q + 1), characters & np.uint32(255)
    h = low[:last].copy()
    for i in range(1, q):
        h |= low[i:i + last] << np.uint32(8 * i)
    return ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - _TABLE_BITS)).astype(np.int64)


class PieceIndex:
    """The items' pieces by their bucket, for each piece size.  Two contents in one bucket only add candidates.

    Pieces are counted by span: of a near copy some span has no more than its share of the edits, so as many of its pieces
    stand as there are more than edits, at shifts no further apart than the edits.  A segment of such a span has no more
    than its share either, which is searched."""

    def __init__(self, patterns: list[str], similarity: float):
        self.lengths = np.array([len(p) for p in patterns], np.int64)
        self.edits = np.array([allowed_edits(len(p), similarity) for p in patterns], np.int64)
        item_of, least, begins, sizes, share, segments = [], [], [], [], [], []
        found: dict[int, list[tuple[np.ndarray, int, np.ndarray]]] = defaultdict(list)
        for number, pattern in enumerate(patterns):
            characters = _characters(pattern)
            for a, b in _cuts(0, len(pattern), SPAN):
                edits = allowed_edits(b - a, similarity)
                q = next((q for least_size, q in PIECE_SIZES if b - a >= least_size), b - a)
                while q > 1 and (b - a) // q <= edits:
                    q -= 1
                places = np.arange(a, b - q + 1, q)
                found[q].append((_piece_buckets(characters, q)[places], len(item_of), places - a))
                # with the pieces that lie in the segment, and how many of them stand at least
                parts = [(x, y, -(-(x - a) // q), min((y - a) // q, len(places))) for x, y in _cuts(a, b, SEGMENT)]
                segments.append([(x, y - x, share_of, p, max(p, e), max(0, e - p - share_of), characters[x:y])
                                 for x, y, p, e in parts for share_of in [allowed_edits(y - x, similarity)]])
                item_of.append(number)
                least.append(max(1, len(places) - edits))
                begins.append(a)
                sizes.append(b - a)
                share.append(edits)
        self.item_of, self.least, self.begins, self.sizes, self.share = (np.array(x, np.int64) for x in (item_of, least, begins, sizes, share))
        self.windows = self.share // BAND + 2  # bands that so many shifts touch
        self.count = np.array([len(x) for x in segments], np.int64)
        self.first = np.cumsum(self.count) - self.count
        flat = [x for of_span in segments for x in of_span]
        self.seg_begins, self.seg_sizes, self.seg_share, self.seg_first, self.seg_end, self.seg_least = (
            np.array([x[k] for x in flat], np.int64) for k in range(6))
        # bit i: character i of the segment is of this class; characters that share one only add candidates
        self.masks = np.zeros((len(flat), CLASSES), np.uint64)
        for n, (_, size, *_, characters) in enumerate(flat):
            np.bitwise_or.at(self.masks[n], _classes(characters), np.uint64(1) << np.arange(size, dtype=np.uint64))
        # a block of text has a place for each span and band; shifts begin before it by the largest span
        spans = max(1, len(item_of))
        self.before = -(-int(self.sizes.max(initial=0)) // BAND) * BAND
        self.overlap = int((self.sizes + self.share).max(initial=0)) + 8
        self.block = max(1024, min(1 << 15, CELLS // spans * BAND - self.before - self.overlap))
        self.bands = (self.block + self.overlap + self.before) // BAND + 1 + int(self.windows.max(initial=0))
        self.tables = {}
        for q, parts in found.items():
            buckets = np.concatenate([b for b, _, _ in parts])
            base = np.concatenate([n * self.bands * BAND + self.before - x for _, n, x in parts])
            number = np.concatenate([x // q for _, _, x in parts]).astype(np.int32)  # of the piece in its span
            order = np.argsort(buckets, kind="stable")
            count = np.bincount(buckets, minlength=1 << _TABLE_BITS).astype(np.int32)
            self.tables[q] = (count, (np.cumsum(count) - count).astype(np.int32), base[order], number[order])

    def candidates(self, characters: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, begin, end): parts of the text, outside which no near copy of the item lies."""
        classes = _classes(characters)
        buckets = {q: _piece_buckets(characters, q) for q in self.tables}
        held = []
        for begin in range(0, len(characters), self.block):
            cells, pieces = np.zeros(len(self.item_of) * self.bands, np.int32), []
            for q, (count, start, base, number) in self.tables.items():
                here = buckets[q][begin:begin + self.block + self.overlap]
                n = count[here]
                known = np.flatnonzero(n)
                for at in np.split(known, np.flatnonzero(np.diff(np.cumsum(n[known], dtype=np.int64) // PIECES_AT_ONCE)) + 1):
                    m = n[at]
                    which = np.arange(int(m.sum())) + np.repeat(start[here[at]] - (np.cumsum(m) - m), m)
                    cell = (base[which] + np.repeat(at, m)) >> BAND_BITS
                    cells += np.bincount(cell, minlength=len(cells)).astype(np.int32)
                    pieces.append((cell.astype(np.int32), number[which]))
            if not pieces:
                continue
            cells, many = cells.reshape(-1, self.bands), np.zeros((len(self.item_of), self.bands), bool)
            for window in np.unique(self.windows).tolist():
                spans = np.flatnonzero(self.windows == window)
                of_spans, last = cells[spans], self.bands - window + 1
                near = of_spans[:, :last].copy()
                for k in range(1, window):
                    near += of_spans[:, k:k + last]
                many[spans, :last] = near >= self.least[spans][:, None]
            segment, span, band = self._of_distinct(many, pieces)
            # bands that lie together are searched together
            good, some = np.unique(segment * self.bands + band // BANDS, return_index=True)
            shift = begin + good % self.bands * BANDS * BAND - self.before
            held.append(np.stack([segment[some], span[some], shift]))
            if sum(x.shape[1] for x in held) >= SEARCHED_AT_ONCE:
                yield from self._found(classes, np.concatenate(held, axis=1))
                held = []
        if held:
            yield from self._found(classes, np.concatenate(held, axis=1))

    def _found(self, classes: np.ndarray, held: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """The candidates among (segment, span, shift)."""
        width = (BANDS - 1 + int(self.windows.max())) * BAND
        for k in range(0, held.shape[1], SEARCHED_AT_ONCE):
            segment, span, shift = held[:, k:k + SEARCHED_AT_ONCE]
            shift = shift - self.begins[span]
            hit = np.flatnonzero(self._lies(classes, segment, shift + self.seg_begins[segment], width))
            item, shift = self.item_of[span[hit]], shift[hit]
            yield from zip(item.tolist(), (shift - self.edits[item]).tolist(), (shift + width + self.lengths[item] + self.edits[item]).tolist())

    def _of_distinct(self, many: np.ndarray, pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
        """(segment, span, band) of those of ``many`` where pieces enough of the span and of the segment are different ones."""
        flat = np.flatnonzero(many)
        if not len(flat):
            return flat, flat, flat
        span, band = flat // self.bands, flat % self.bands
        ids, near = np.full(many.size + 1, -1, np.int32), np.zeros(many.size + int(self.windows.max()), bool)
        ids[flat] = np.arange(len(flat))
        for k in range(int(self.windows.max())):  # the bands of these windows
            near[flat[k < self.windows[span]] + k] = True
        cell, number = (np.concatenate(x) for x in zip(*((c[kept], n[kept]) for c, n in pieces for kept in [near[c]])))
        width, found = int(number.max(initial=0)) + 1, []
        for first in range(0, len(flat), WINDOWS_AT_ONCE):
            seen = np.zeros((min(WINDOWS_AT_ONCE, len(flat) - first), width), bool)
            for k in range(int(self.windows.max())):
                at = ids[np.maximum(cell - k, -1)] - first
                kept = np.flatnonzero((at >= 0) & (at < len(seen)))
                kept = kept[k < self.windows[span[at[kept] + first]]]
                seen[at[kept], number[kept]] = True
            kept = np.flatnonzero(seen.sum(axis=1) >= self.least[span[first:first + len(seen)]])
            upto = np.pad(np.cumsum(seen[kept], axis=1), ((0, 0), (1, 0)))
            row = np.repeat(np.arange(len(kept)), n := self.count[span[first + kept]])
            segment = np.arange(len(row)) + np.repeat(self.first[span[first + kept]] - (np.cumsum(n) - n), n)
            times = upto[row, np.minimum(self.seg_end[segment], width)] - upto[row, np.minimum(self.seg_first[segment], width)]
            good = np.flatnonzero(times >= self.seg_least[segment])
            at = first + kept[row[good]]
            found.append((segment[good], span[at], band[at]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _lies(self, classes: np.ndarray, segment: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """Whether each segment lies in the text from there on (Myers' search of all at once)."""
        one, size, edits = np.uint64(1), self.seg_sizes[segment], self.seg_share[segment]
        top = one << (size - 1).astype(np.uint64)
        full = top | (top - one)
        plus, minus, score, best = full.copy(), np.zeros(len(segment), np.uint64), size.copy(), size.copy()
        masks, row, last = self.masks.reshape(-1), segment * CLASSES, (size - 1).astype(np.uint64)
        length = int((size + edits).max()) + width
        low = int(at.min())
        classes = np.pad(classes[max(0, low):max(0, int(at.max()) + length)], (max(0, -low), 0))
        at = at - low
        classes = np.pad(classes, (0, max(0, int(at.max()) + length - len(classes))))
        for step in range(length):
            eq = masks[row + classes[at + step]]
            x = (((eq & plus) + plus) ^ plus) | eq | minus
            up, down = minus | (full & ~(x | plus)), plus & x
            score += ((up >> last) & one).view(np.int64) - ((down >> last) & one).view(np.int64)
            up, down, xv = (up << one) & full, (down << one) & full, eq | minus
            plus, minus = down | (full & ~(xv | up)), up & xv
            np.minimum(best, score, out=best)
        return best <= edits


def _cuts(a: int, b: int, size: int) -> list[tuple[int, int]]:
    """Runs of nearly equal length, of at most ``size``."""
    ends = np.linspace(a, b, -(-(b - a) // size) + 1).astype(int).tolist()
    return list(zip(ends, ends[1:]))


class ItemIndex:
    """The items, the keys of their windows for each walk (sorted, with the item and the window's place), and the pieces of those
    that walks are not relied on for."""

    def __init__(self, items: list[tuple[object, bytes]], similarity: float = SIMILARITY, thorough: bool = False):
        self.items = []
        walked, pieced = [], []
        for item_id, text in items:
            words = _words(text)
            if words:
                if len(words) >= LEAST_WORDS:
                    walked.append(len(self.items))
                if thorough or len(words) < LEAST_WORDS:  # beside the walks, what they may miss
                    pieced.append(len(self.items))
                self.items.append((item_id, b" ".join(words).decode("utf-8", "replace"), len(words)))
        self.walked, self.pieced = bool(walked), np.array(pieced, np.int64)
        self.pieces = PieceIndex([self.items[n][1] for n in pieced], similarity)
        self.edits = [allowed_edits(len(pattern), similarity) for _, pattern, _ in self.items]
        symbols = {n: word_symbols(self.items[n][1].encode())[0] for n in walked}
        together = np.concatenate([np.empty(0, np.int64), *symbols.values()])
        says = []
        for part in (together & 0xFFFF, (together >> 16) & 0xFFFF):
            times = np.bincount(part, minlength=1 << 16)
            says.append(np.log2(max(1, len(part)) / np.maximum(times, 0.3)))
            says[-1][0] = 0.0  # behind the end
        enough = np.log2(max(1, len(together))) + SAYS_BEYOND
        self.walks = Walks(max(SAMPLED, int(np.ceil((enough + 6) / SAYS))))
        found: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(WALKS)]
        segments, first_segment = [], {}
        for n, of_item in symbols.items():
            padded, starts = np.concatenate([of_item, np.zeros(self.walks.steps, np.int64)]), np.arange(len(of_item))
            for walk in range(WALKS):
                keys, bits = self.walks.keys(padded, starts, walk, np.array(says))
                kept = np.flatnonzero(bits >= enough)
                found[walk].append((keys[kept], np.full(len(kept), n, np.int32), kept.astype(np.int32)))
            pattern = self.items[n][1].encode()
            cuts = np.linspace(0, len(pattern), -(-len(pattern) // SEGMENT) + 1).astype(int)
            first_segment[n] = len(segments)
            segments += [(pattern[a:b], a) for a, b in zip(cuts, cuts[1:])]
            found_at = word_symbols(pattern)[1]
            self.items[n] += (found_at, np.searchsorted(cuts, found_at, "right") - 1 + first_segment[n])
        self.begins = np.array([a for _, a in segments], np.int64)
        self.sizes = np.array([len(t) for t, _ in segments], np.int64)
        self.masks = np.zeros((len(segments), CLASSES), np.uint64)  # bit i: byte i of the segment is of this class
        for n, (t, _) in enumerate(segments):
            np.bitwise_or.at(self.masks[n], np.frombuffer(t, np.uint8) & np.uint8(CLASSES - 1), np.uint64(1) << np.arange(len(t), dtype=np.uint64))
        self.tables = []
        for parts in found:
            keys, numbers, places = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32))
            order = np.argsort(keys, kind="stable")
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[(keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
            keys, numbers, places = keys[order], numbers[order], places[order]
            byte_of = np.array([self.items[n][3][p] for n, p in zip(numbers, places)], np.int64)
            segment_of = np.array([self.items[n][4][p] for n, p in zip(numbers, places)], np.int64)
            self.tables.append((keys, numbers, byte_of, segment_of, table))

    def hits(self, symbols: np.ndarray, starts: np.ndarray, byte_at: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, byte of ``text`` at which it would begin): hits whose segment lies nearby.  ``byte_at`` has the byte of each start."""
        found = []
        for walk, (keys, numbers, byte_of, segment_of, table) in enumerate(self.tables):
            if not len(keys):
                continue
            got = self.walks.keys(symbols, starts, walk)
            maybe = np.flatnonzero(table[(got >> np.uint64(64 - _TABLE_BITS)).view(np.int64)])
            low, high = np.searchsorted(keys, got[maybe], "left"), np.searchsorted(keys, got[maybe], "right")
            n = high - low
            which = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
            shift = np.repeat(byte_at[maybe], n) - byte_of[which]
            found.append(np.stack([(segment_of[which] << 36) + (shift + _FAR) // BAND, numbers[which]]))
        if not found:
            return
        cells, first = np.unique(np.concatenate([f[0] for f in found]), return_index=True)
        item = np.concatenate([f[1] for f in found])[first]
        segment, shift = cells >> 36, (cells & ((1 << 36) - 1)) * BAND - _FAR
        for a in range(0, len(cells), HITS_AT_ONCE):
            some = slice(a, a + HITS_AT_ONCE)
            near = a + self._nearby(text, segment[some], shift[some])
            yield from zip(item[near].tolist(), shift[near].tolist())

    def _nearby(self, text: np.ndarray, segment: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Which segments lie in the text at these shifts, or up to a band on, with few edits (Myers' search of all at once)."""
        one, size = np.uint64(1), self.sizes[segment]
        slack = (size * NEARBY).astype(np.int64) // 2
        top = one << (size - 1).astype(np.uint64)
        full = top | (top - one)
        at = shift + self.begins[segment] - slack
        length = int((BAND + size + 2 * slack).max(initial=0))
        before = max(0, -int(at.min(initial=0)))
        classes = np.pad(text & np.uint8(CLASSES - 1), (before, max(0, int(at.max(initial=0)) + length - len(text))))
        at = at + before
        plus, minus, score, best = full.copy(), np.zeros(len(segment), np.uint64), size.copy(), size.copy()
        masks, row, last = self.masks.reshape(-1), segment * CLASSES, (size - 1).astype(np.uint64)
        for step in range(length):
            eq = masks[row + classes[at + step]]
            x = (((eq & plus) + plus) ^ plus) | eq | minus
            up, down = minus | (full & ~(x | plus)), plus & x
            score += ((up >> last) & one).view(np.int64) - ((down >> last) & one).view(np.int64)
            up, down, xv = (up << one) & full, (down << one) & full, eq | minus
            plus, minus = down | (full & ~(xv | up)), up & xv
            np.minimum(best, score, out=best)
        return np.flatnonzero(best <= size * NEARBY)


def best_distance(pattern: str, text: str) -> int:
    """The smallest edit distance of ``pattern`` to any part of ``text`` (Myers, one bit a character)."""
    m = len(pattern)
    if not m:
        return 0
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        x = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(x | plus)), plus & x
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        xv = eq | minus
        plus, minus = down | (full & ~(xv | up)), up & xv
        if score < best:
            best = score
    return best


def _matches(index: ItemIndex, texts: list[bytes | None]) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, word at which it was found, distance): the best place of each item in each text."""
    def search(rows: list[tuple[int, list[bytes]]]) -> Iterator[tuple[int, int, int, int]]:
        gap = index.walks.steps
        counts = np.array([len(words) for _, words in rows])
        word_ends = np.cumsum([0, *counts])
        text = b" ".join(b" ".join(words) for _, words in rows)
        packed, byte_at = word_symbols(text)
        starts = np.arange(len(packed)) + np.repeat(np.arange(len(rows)) * gap, counts)  # a window does not leave its row
        symbols = np.zeros(len(packed) + gap * len(rows), np.int64)
        symbols[starts] = packed
        byte_at = np.append(byte_at, len(text) + 1)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        todo = defaultdict(list)
        for item, begin in index.hits(symbols, starts, byte_at[:-1], np.frombuffer(text, np.uint8)) if index.walked else ():
            middle = int(np.searchsorted(byte_at, begin + len(index.items[item][1]) // 2, "right")) - 1
            row = min(max(0, int(np.searchsorted(word_ends, middle, "right")) - 1), len(rows) - 1)
            todo[row, item].append(begin)
        for (row, item), begins in sorted(todo.items()):
            pattern = index.items[item][1]
            size, slack = len(pattern.encode()), 4 * index.edits[item] + 2 * BAND
            done = -1
            for begin in sorted(begins):
                if begin <= done or best.get((row, item), (1, 0))[0] == 0:
                    continue
                done = begin + slack // 4  # hits so near are searched with this one
                first = max(int(word_ends[row]), int(np.searchsorted(byte_at, begin - slack, "right")) - 1)
                last = min(int(word_ends[row + 1]), int(np.searchsorted(byte_at, begin + size + slack + slack // 4, "left")))
                part = text[byte_at[first]:byte_at[last] - 1].decode("utf-8", "replace")
                d = best_distance(pattern, part)
                if d <= index.edits[item]:
                    at = first + part.count(" ", 0, part.find(pattern)) if d == 0 else max(first, int(np.searchsorted(byte_at, begin, "right")) - 1)
                    found = d, at - int(word_ends[row])
                    best[row, item] = min(best.get((row, item), found), found)
        for row, item, begin, end, text in spots(rows):
            allowed, pattern = index.edits[item], index.items[item][1]
            if (row, item) in best and best[row, item][0] == 0:
                continue
            d = best_distance(pattern, text[begin:end])
            if d <= allowed and d < best.get((row, item), (d + 1, 0))[0]:
                first = begin + (text.find(pattern, begin, end) - begin if d == 0 else allowed)
                best[row, item] = d, text.count(" ", 0, first)
        for (row, item), (d, at) in best.items():
            yield rows[row][0], item, at, d

    def spots(rows: list[tuple[int, list[bytes]]]) -> Iterator[tuple[int, int, int, int, str]]:
        """(row, item, begin, end, the row's text): the parts that pieces point at; parts that overlap as one."""
        if not len(index.pieced):
            return
        texts = [b" ".join(words).decode("utf-8", "replace") for _, words in rows]
        ends = np.cumsum([0, *(len(t) + 4 for t in texts)])
        characters = _characters("\0\0\0\0".join(texts))
        parts = defaultdict(list)
        for number, begin, end in index.pieces.candidates(characters):
            item = int(index.pieced[number])
            begin = max(0, begin)
            for row in range(int(np.searchsorted(ends, begin, "right")) - 1, min(len(rows), int(np.searchsorted(ends, end, "left")))):
                parts[row, item].append((max(0, begin - int(ends[row])), min(len(texts[row]), end - int(ends[row]))))
        for (row, item), found in sorted(parts.items()):
            found.sort()
            begin, end = found[0]
            for a, b in found[1:]:
                if a > end:
                    yield row, item, begin, end, texts[row]
                    begin, end = a, b
                end = max(end, b)
            yield row, item, begin, end, texts[row]

    rows, size = [], 0
    for i, text in enumerate(texts):
        words = _words(text)
        if not words:
            continue
        rows.append((i, words))
        size += len(words)
        if size >= CHUNK_WORDS:
            yield from search(rows)
            rows, size = [], 0
    if rows:
        yield from search(rows)


def _passes(spark: SparkSession, benchmark: DataFrame, item_col: str, item_text: str, similarity: float, thorough: bool) -> Iterator:
    """Broadcast indexes of the items, about ``ITEMS_OF_PASS`` or ``BYTES_OF_PASS`` in each."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).cast("binary").alias("text")).where("text IS NOT NULL").distinct()
    count, size = items.agg(F.count("text"), F.sum(F.octet_length("text"))).first()
    passes = max(1, -(-count // ITEMS_OF_PASS), -(-(size or 0) // BYTES_OF_PASS))
    for number in range(passes):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == number).orderBy("item", "text").collect()
        yield spark.sparkContext.broadcast(ItemIndex([(r[0], bytes(r[1])) for r in part], similarity, thorough))


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text: str = "text", similarity: float = SIMILARITY, thorough: bool = False) -> DataFrame:
    """(id, item_id, start_word, distance, similarity): each document and benchmark item of which it holds
    a passage with an edit similarity of ``similarity`` or more (A to Z lower-cased, runs of white space
    as one space), with the best passage.

    What is reported is exact; what is found are nearly all such passages (README: measured recall), with ``thorough`` all, at
    a cost that grows with the items.  Texts of any length are searched whole.  A clashing name is no matter: only the
    named columns are read; ``id_col`` must not be ``item_id``, ``start_word``, ``distance`` or ``similarity``.
    Null and empty texts and items match nothing; repeated rows are reported each; an empty table on
    either side gives an empty result.  Items are taken in passes of about ``ITEMS_OF_PASS``, so what
    is broadcast has a bound; every pass reads all documents.
    """
    kinds, item_kind = dict(docs.dtypes), dict(benchmark.dtypes)[item_col]
    schema = f"`{id_col}` {kinds[id_col]}, item_id {item_kind}, start_word long, distance long, similarity double"
    arrow = to_arrow_schema(benchmark.select(item_col).schema).field(0).type
    out = None
    for index in _passes(docs.sparkSession, benchmark, item_col, item_text, similarity, thorough):
        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            known = index.value
            for batch in batches:
                found = list(_matches(known, (t.as_py() for t in batch.column(1))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([known.items[f[1]][0] for f in found], arrow),
                     pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64()),
                     pa.array([1 - f[3] / len(known.items[f[1]][1]) for f in found], pa.float64())],
                    names=[id_col, "item_id", "start_word", "distance", "similarity"])

        rows = docs.select(id_col, F.col(text_col).cast("binary").alias("_q_text")).mapInArrow(search, schema)
        out = rows if out is None else out.union(rows)
    return out


def without_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  similarity: float = SIMILARITY, thorough: bool = False) -> DataFrame:
    """The rows of ``docs`` that hold no passage of a benchmark item, unchanged."""
    at = docs.columns.index(text_col)
    for index in _passes(docs.sparkSession, benchmark, item_col, item_text, similarity, thorough):
        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                texts = batch.column(at).cast(pa.binary())
                keep[[f[0] for f in _matches(index.value, (t.as_py() for t in texts))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, exactly or nearly: by walks, and by pieces what they miss."""
    return find_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), thorough=True)
