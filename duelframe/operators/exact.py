"""Exact-size seeded samples without moving the rows.

Rows are ordered by the md5 of ``seed:key`` and the first k are taken. The k-th
row of that order, the cutoff, is found in two small steps:

1. rows are counted per hash prefix (at most 16^PREFIX groups, combined on the
   map side); a running sum over these counts names the prefix in which the
   k-th row lies and its rank there;
2. only that prefix is ranked, one 65,536th of the rows.

The cutoff is one value, read by the main pass as a scalar subquery. The pass
itself compares each row's (hash, key) to it: no shuffle, join or sort of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.defaults import SAMPLING_SEED
from duelframe.keys import Key, key_hash, key_names, key_value

PREFIX = 4


def check_level(level: float) -> float:
    if math.isnan(level) or not 0.0 <= level <= 1.0:
        raise ValueError(f"noise level {level} is outside [0, 1]")
    return float(level)


def place(key: Key, seed: int) -> Column:
    """A row's place in the seeded order."""
    return F.struct(key_hash(key, seed).alias("h"), key_value(key).alias("k"))


def share_of(level: float):
    """k as a share of the row count, floored in double precision."""
    return lambda total: F.floor(F.lit(check_level(level)) * total.cast("double"))


def cutoffs(df: DataFrame, sizes: dict[float, object], key: Key, seed: int) -> DataFrame:
    """``(tag, cutoff)``: the k-th place for each tag; none where k is 0 or too large.

    ``sizes`` maps a tag to a function from the row count to k. Its length is a
    parameter of the caller, so every table below but ``hashed`` is small.
    """
    hashed = df.select(place(key, seed).alias("place")).withColumn(
        "prefix", F.substring("place.h", 1, PREFIX)
    )
    counts = hashed.groupBy("prefix").agg(F.count("*").alias("n"))
    running = counts.select(
        "prefix",
        "n",
        F.sum("n").over(Window.orderBy("prefix")).alias("upto"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    wanted = F.array(
        *[
            F.struct(F.lit(float(tag)).alias("tag"), size(F.col("total")).cast("bigint").alias("k"))
            for tag, size in sizes.items()
        ]
    )
    edges = (
        running.select("prefix", "n", "upto", F.inline(wanted))
        .where((F.col("upto") - F.col("n") < F.col("k")) & (F.col("k") <= F.col("upto")))
        .select("tag", "prefix", (F.col("k") - F.col("upto") + F.col("n")).alias("rank"))
    )
    by_prefix = edges.groupBy("prefix").agg(
        F.collect_list(F.struct("tag", "rank")).alias("wanted")
    )
    near = by_prefix.agg(F.map_from_entries(F.collect_list(F.struct("prefix", "wanted")))).scalar()
    found = F.try_element_at(near, F.col("prefix"))
    places = (
        hashed.where(found.isNotNull())
        .select("place", "prefix", F.inline(found))
        .groupBy("tag", "prefix", "rank", "place")
        .agg(F.count("*").alias("m"))
    )
    # a repeated key counts as often as it occurs, but no cut goes through it
    upto = F.sum("m").over(Window.partitionBy("tag", "prefix").orderBy("place"))
    whole = F.when(
        F.col("upto") > F.col("rank"),
        F.raise_error(F.lit(f"key {key_names(key)} is not unique")),
    ).otherwise(F.col("place"))
    return (
        places.withColumn("upto", upto)
        .where((F.col("upto") - F.col("m") < F.col("rank")) & (F.col("rank") <= F.col("upto")))
        .select("tag", whole.alias("cutoff"))
    )


def sample_exact(df: DataFrame, n: int | float, key: Key, seed: int = SAMPLING_SEED) -> DataFrame:
    """Exactly ``n`` rows without replacement; more than there are is an error.

    A fraction is the share of the rows that is taken, rounded down.
    """
    if isinstance(n, float):
        found = cutoffs(df, {0.0: share_of(n)}, key, seed)
        return df.where(place(key, seed) <= found.agg(F.max("cutoff")).scalar())
    if n < 0:
        raise ValueError("n must not be negative")
    if n == 0:
        return df.limit(0)
    found = cutoffs(df, {0.0: lambda total: F.lit(n)}, key, seed)
    cutoff = found.agg(
        F.coalesce(
            F.max("cutoff"), F.raise_error(F.lit(f"sample of {n} rows from a smaller table"))
        )
    ).scalar()
    return df.where(place(key, seed) <= cutoff)
