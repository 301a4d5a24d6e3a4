"""The first rows by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.defaults import VALIDATION_ROWS
from duelframe.keys import Key, key_names, key_value


def head_end(df: DataFrame, n: int, key: Key, strict: bool = True) -> Column:
    """The key of the n-th row, as a scalar; ``strict`` raises when there is none.

    Every task keeps its first n + 1 keys only, so that many keys per task move at
    most. A null key, or an n-th key that the next row has too, is an error.
    """
    names = key_names(key)
    # nulls come first
    first = df.select(*names).orderBy(*names).limit(n + 1)
    missing = F.bool_or(reduce(Column.__or__, [F.col(name).isNull() for name in names]))
    keys = F.sort_array(F.collect_list(key_value(key)))
    end = F.when(F.size(keys) <= n, F.array_max(keys)).otherwise(F.get(keys, F.lit(n - 1)))
    repeated = (F.size(keys) > n) & (F.get(keys, F.lit(n)) == F.get(keys, F.lit(n - 1)))
    end = F.when(
        F.coalesce(missing, F.lit(False)), F.raise_error(F.lit(f"null in key {names}"))
    ).when(
        F.coalesce(repeated, F.lit(False)), F.raise_error(F.lit("the head would end in a repeated key"))
    ).otherwise(end)
    if strict:
        end = F.when(
            F.count("*") < n, F.raise_error(F.lit(f"fewer than {n} rows for the head"))
        ).otherwise(end)
    return first.agg(end).scalar()


def validation_head(
    df: DataFrame, key: Key, n: int = VALIDATION_ROWS, strict: bool = True
) -> DataFrame:
    """The first ``n`` rows in key order, all of them where fewer and not strict."""
    return df.where(key_value(key) <= head_end(df, n, key, strict))
