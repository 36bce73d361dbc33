"""The pieces of benchmark items: nothing at the threshold is left out, and few places are searched."""

import random

from quire.llm import decontamination as D


def _edited(rng, text, edits):
    chars = list(text)
    for at in sorted(rng.sample(range(len(chars)), edits), reverse=True):
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("abcdefgh")
        elif kind == 1:
            del chars[at]
        else:
            chars.insert(at, rng.choice("abcdefgh"))
    return "".join(chars)


def _prose(rng, n):
    words = ["the", "and", "of", "tion", "ing", "here", "there", "nation", "ending", "river", "stone", "quiet", "lamp", "over"]
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "er", "ly"]) for _ in range(n))


def test_every_copy_at_the_threshold_is_among_the_candidates():
    rng = random.Random(3)
    patterns = ["abcde", "short one here", *(_prose(rng, n) for n in (6, 9, 14, 40, 90, 200))]
    index = D.PieceIndex(patterns, D.SIMILARITY)
    assert index.sizes.max() <= D.SPAN and (index.seg_sizes <= D.SEGMENT).all()
    text, placed = _prose(rng, 300) + " é猫 ", []
    for number in [*range(len(patterns))] * 12:  # long enough for copies across the ends of blocks
        copy = _edited(rng, patterns[number], D.allowed_edits(len(patterns[number]), D.SIMILARITY))
        placed.append((number, len(text), len(text) + len(copy)))
        text += copy + " " + _prose(rng, rng.randrange(5, 120)) + " "
    assert len(text) > 2 * 32_768
    found = list(index.candidates(D._characters(text)))
    for number, begin, end in placed:
        assert any(n == number and a <= begin and b >= end for n, a, b in found), (number, begin)


def test_few_places_are_searched(monkeypatch):
    rng = random.Random(5)
    patterns = [_prose(rng, 40) for _ in range(40)]
    index, searched = D.PieceIndex(patterns, D.SIMILARITY), []
    lies = D.PieceIndex._lies
    monkeypatch.setattr(D.PieceIndex, "_lies", lambda self, classes, segment, *rest: (searched.append(len(segment)), lies(self, classes, segment, *rest))[1])
    letters = [rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(100_000)]
    text = "".join(letters) + " " + patterns[7] + " " + " the and of" * 500
    found = list(index.candidates(D._characters(text)))
    assert any(n == 7 for n, _, _ in found) and 0 < sum(searched) < len(text) // 10
