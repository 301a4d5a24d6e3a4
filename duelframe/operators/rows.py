"""Filters on token counts, operators that multiply rows, and their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.defaults import CANDIDATES, MAX_TOKENS


def within(tokens: Column, limit: int = MAX_TOKENS) -> Column:
    """At most ``limit`` tokens; works on words as on ids, which are as many."""
    return F.size(tokens) <= limit


def pair_length_filter(
    df: DataFrame, one: str, other: str, limit: int = MAX_TOKENS
) -> DataFrame:
    """Rows whose two arrays both have at most ``limit`` items."""
    return df.where(within(F.col(one), limit) & within(F.col(other), limit))


def prompt_length_filter(
    df: DataFrame, lengths: str = "lengths", limit: int = MAX_TOKENS
) -> DataFrame:
    return df.where(F.col(lengths) <= limit)


def to_kto(df: DataFrame, prompt: Column, chosen: Column, rejected: Column, *keep: str) -> DataFrame:
    """Two rows per comparison: the chosen answer as true, then the rejected as false."""
    answers = F.array(
        F.struct(chosen.alias("completion"), F.lit(True).alias("label")),
        F.struct(rejected.alias("completion"), F.lit(False).alias("label")),
    )
    return df.select(
        *keep, prompt.alias("prompt"), F.posexplode(answers).alias("ord", "answer")
    ).select(*keep, "ord", "prompt", "answer.completion", "answer.label")


def repeat_queries(df: DataFrame, n: int = CANDIDATES) -> DataFrame:
    """``n`` copies of every row, numbered from 0 in ``cand``."""
    if n < 1:
        raise ValueError("at least one copy is needed")
    return df.withColumn("cand", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def assemble_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """One table of the given splits, named in ``split``."""
    return reduce(
        DataFrame.unionByName,
        [rows.withColumn("split", F.lit(name)) for name, rows in splits.items()],
    )
