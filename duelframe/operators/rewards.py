"""Best-of-n, reward means and per-step reward statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_of_n(
    df: DataFrame,
    by: Sequence[str] = ("run", "row_id"),
    cand: str = "cand",
    score: str = "score",
    keep: Sequence[str] = ("response",),
) -> DataFrame:
    """Per group the candidate with the highest score; the lowest ``cand`` on a tie.

    NaN counts as the highest score. Groups are combined on the map side, so a
    large group reaches its final task as one row per map task.
    """
    order = F.struct(F.col(score).alias("s"), (-F.col(cand)).alias("c"))
    best = F.max(F.struct(order.alias("o"), *keep)).alias("best")
    return (
        df.groupBy(*by)
        .agg(best)
        .select(
            *by,
            (-F.col("best.o.c")).alias(cand),
            F.col("best.o.s").alias(score),
            *[F.col(f"best.{name}") for name in keep],
        )
    )


def token_argmax(
    df: DataFrame,
    by: Sequence[str] = ("row_id", "pos"),
    token: str = "token_id",
    logit: str = "logit",
) -> DataFrame:
    """Per position the token with the highest logit; the lowest id on a tie."""
    return best_of_n(df, by, cand=token, score=logit, keep=())


def mean_reward(df: DataFrame, by: Sequence[str] = ("run",), score: str = "score") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(score).alias("mean_reward"), F.count(score).alias("n"))


def stats(reward: str = "reward") -> list[Column]:
    """Mean, sample deviation (NULL for one reward) and count."""
    return [
        F.avg(reward).alias("reward_mean"),
        F.stddev_samp(reward).alias("reward_std"),
        F.count(reward).alias("n"),
    ]


def reward_stats(
    df: DataFrame, by: Sequence[str | Column] = ("run", "step"), reward: str = "reward"
) -> DataFrame:
    return df.groupBy(*by).agg(*stats(reward))


def reward_dist(
    df: DataFrame,
    low: float,
    high: float,
    buckets: int,
    by: Sequence[str] = ("run", "step"),
    reward: str = "reward",
) -> DataFrame:
    """Histogram of the rewards; bucket 0 lies below ``low``, ``buckets + 1`` from ``high``."""
    bucket = F.width_bucket(F.col(reward), F.lit(low), F.lit(high), F.lit(buckets))
    return df.groupBy(*by, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def reward_values(
    df: DataFrame, by: Sequence[str] = ("run", "step"), reward: str = "reward"
) -> DataFrame:
    """The exact distribution: every reward value with its count."""
    return df.groupBy(*by, reward).agg(F.count("*").alias("n"))


SKETCH_SIZE = 200  # values that a sketch keeps about; ranks are then off by 1.7 % of the rewards
RANK_ERROR = 0.017  # at this size, at 99 % confidence


def reward_sketches(
    df: DataFrame, by: Sequence[str] = ("run", "step"), reward: str = "reward", size: int = SKETCH_SIZE
) -> DataFrame:
    """A quantile sketch (KLL) per group: ``by, sketch``. Null and NaN rewards are not in it.

    Sketches are of bounded size and merge: those of steps give that of a run.
    """
    known = df.where(F.col(reward).isNotNull() & ~F.isnan(reward))
    return known.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(reward).cast("double"), size).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ("run",), size: int = SKETCH_SIZE) -> DataFrame:
    """The sketches of larger groups, from those of their parts: ``by, sketch``."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", size).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, shares: Sequence[float], by: Sequence[str] = ("run",)) -> DataFrame:
    """``(by, share, n, value)``: a reward that about this share of the group's does not exceed."""
    asked = F.array(*[F.lit(float(s)) for s in shares])
    values = F.kll_sketch_get_quantile_double("sketch", asked)
    rows = sketches.select(*by, F.kll_sketch_get_n_double("sketch").alias("n"), F.inline(F.arrays_zip(asked, values)))
    return rows.toDF(*by, "n", "share", "value").select(*by, "share", "n", "value")
