"""Exact byte-pair token counts, or the length estimate.

The driver decides once which of the two a column holds: exact counts where it can load a
supplied rank file (``QUIRE_BPE_RANKS``) or tiktoken's own cache, else ``ceil(utf16_length / 3.75)``
for every row.  The encoder is loaded once per Python worker (iterator pandas UDF); a worker
that cannot load what the driver could raises an error.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.config import CHARS_PER_TOKEN

ENCODING = "cl100k_base"
_PAT = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""
_SPECIAL = {"<|endoftext|>": 100257, "<|fim_prefix|>": 100258, "<|fim_middle|>": 100259,
            "<|fim_suffix|>": 100260, "<|endofprompt|>": 100276}


def _encoder(path: str | None):
    try:
        import tiktoken
    except ImportError:
        return None
    try:
        if path and os.path.exists(path):
            from tiktoken.load import load_tiktoken_bpe
            return tiktoken.Encoding(name=ENCODING, pat_str=_PAT, mergeable_ranks=load_tiktoken_bpe(path),
                                     special_tokens=_SPECIAL)
        return tiktoken.get_encoding(ENCODING)
    except Exception:  # noqa: BLE001 - offline or missing ranks: fall back
        return None


def _estimate(t) -> int:
    if not t:
        return 0
    units = len(t.encode("utf-16-le")) // 2
    return math.ceil(units / CHARS_PER_TOKEN)


def _estimate_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(_estimate).astype("int64")


def _counter(path: str | None):
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoder(path)
        if enc is None:
            raise RuntimeError(f"the driver counts by {path or ENCODING}, which this worker cannot load")
        for s in batches:
            yield s.map(lambda t: len(enc.encode(t, disallowed_special=())) if t else 0).astype("int64")

    return count


def token_count_bpe(c: Column) -> Column:
    path = os.environ.get("QUIRE_BPE_RANKS")
    batches = _estimate_batches if _encoder(path) is None else _counter(path)
    return F.pandas_udf(batches, "long")(c)
