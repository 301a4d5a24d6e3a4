"""Expressions over reward scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_text(query: Column, response: Column) -> Column:
    """The text a reward model sees; NULL when either part is."""
    return F.concat(query, response)


def activate(raw: Column, activation: str = "sigmoid") -> Column:
    """Turn a raw model output into a score."""
    if activation == "none":
        return raw.cast("double")
    if activation == "sigmoid":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-raw.cast("double")))
    raise ValueError(f"unknown activation {activation!r}")


def as_score(value: Column) -> Column:
    """Scores are doubles; text that is no number raises under ANSI mode."""
    return value.cast("double")
