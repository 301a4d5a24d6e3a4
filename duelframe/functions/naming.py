"""Run names that carry a noise level: 0.05 becomes ``005``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def level_text(level: Column) -> Column:
    """A level in plain decimals with at least one digit after the point."""
    plain = level.cast("decimal(10,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", ".0")


def run_key(level: Column, run: Column | None = None) -> Column:
    """The level's digits, appended to the run name where one is given."""
    digits = F.replace(level_text(level), F.lit("."), F.lit(""))
    return digits if run is None else F.concat_ws("_", run, digits)
