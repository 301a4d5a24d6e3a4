"""Words, n-grams and token-id arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duelframe.defaults import END_OF_TEXT, PADDING

# Reserved tokens and their ids; vocabulary words follow them.
EOS_TEXT = END_OF_TEXT
UNK_TEXT = "<unk>"
PAD_TEXT = PADDING
EOS_ID = 0
UNK_ID = 1
PAD_ID = 2
FIRST_WORD_ID = 3

# A word, and a word or the end-of-text mark.
WORD = "[a-z0-9]+"
WORD_OR_EOS = r"<\|endoftext\|>|[a-z0-9]+"


def words(text: Column, pattern: str = WORD) -> Column:
    """Lower-case words of a text, in order; empty for a text without any."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def normalised(text: Column) -> Column:
    """What decoding an encoded text gives when every word is known."""
    return F.array_join(words(text, WORD_OR_EOS), " ")


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of a word array, words joined by a blank."""
    if n < 1:
        raise ValueError("n must be at least 1")
    if n == 1:
        return tokens
    starts = F.when(
        F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def cut(ids: Column, size: Column | int) -> Column:
    """The first ``size`` ids."""
    return F.slice(ids, F.lit(1), F.lit(size) if isinstance(size, int) else size)


def _padding(ids: Column, length: int, value: int) -> Column:
    missing = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    return F.array_repeat(F.lit(value), missing)


def truncate_pad(
    ids: Column, length: int, pad_id: int = EOS_ID, side: str = "right"
) -> Column:
    """Exactly ``length`` ids: cut at the end, padded on ``side``."""
    kept = cut(ids, length)
    pad = _padding(ids, length, pad_id)
    return F.concat(pad, kept) if _is_left(side) else F.concat(kept, pad)


def attention_mask(ids: Column, length: int | None = None, side: str = "right") -> Column:
    """1 per id, 0 per pad; ``ids`` are the ids before padding."""
    if length is None:
        return F.array_repeat(F.lit(1), F.size(ids))
    ones = F.array_repeat(F.lit(1), F.least(F.size(ids), F.lit(length)))
    zeros = _padding(ids, length, 0)
    return F.concat(zeros, ones) if _is_left(side) else F.concat(ones, zeros)


def _is_left(side: str) -> bool:
    if side not in ("left", "right"):
        raise ValueError(f"side must be left or right, not {side!r}")
    return side == "left"
