"""Row identity: key columns, their seeded hash, and integers drawn from it.

Spark rows have no stable position, so whatever is seeded or positional works on
a unique, non-null key. Results depend on the key and the seed only, never on
partitioning or row order.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Key = str | Sequence[str]


def key_names(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def key_value(key: Key) -> Column:
    """The key as one orderable value."""
    names = key_names(key)
    return F.col(names[0]) if len(names) == 1 else F.struct(*names)


def key_hash(key: Key, seed: int) -> Column:
    """md5 of ``seed:key``; a null key is an error."""
    parts: list[Column] = [F.lit(str(seed))]
    for name in key_names(key):
        parts += [F.lit(":"), F.col(name).cast("string")]
    return F.coalesce(
        F.md5(F.concat(*parts)),
        F.raise_error(F.lit(f"null in key {key_names(key)}")),
    )


_RUN = 1 << 16  # equal rows that are numbered at a time
_ROWS = 1 << 19  # rows that a task writes out, about


def with_key(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Add a key to rows that have none: a hash of the content, and a number among equal rows.

    The same rows get the same keys, in whatever order they come. Equal rows are
    counted before the shuffle and written out again from their count, so they
    never meet in one group. The rows are counted once at the call: by their number
    the runs are dealt to tasks, as few counts may stand for very many rows.
    """
    if key in df.columns:
        raise ValueError(f"there is a column {key!r} already")
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    content = F.md5(F.to_json(F.struct(*columns)))
    counted = df.groupBy(*columns, content.alias(key)).agg(F.count("*").alias("_n"))
    runs = counted.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {_RUN}"))))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, ceil(df.count() / _ROWS))
    runs = runs.repartition(tasks, key, "_run")
    first = F.col("_run") * _RUN
    last = F.least(first + _RUN, F.col("_n")) - 1
    numbered = runs.withColumn("_nth", F.explode(F.sequence(first, last)))
    return numbered.select(F.concat_ws("-", key, "_nth").alias(key), *columns)


def hashed_int(key: Key, seed: int, low: int, high: int) -> Column:
    """One integer in [low, high) per key, from the first 32 bits of the hash."""
    if high <= low:
        raise ValueError(f"empty range [{low}, {high})")
    word = F.conv(F.substring(key_hash(key, seed), 1, 8), 16, 10).cast("bigint")
    return (F.lit(low) + F.pmod(word, F.lit(high - low))).cast("int")
