"""Table forms of preference objectives."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _negative_log_sigmoid(x: Column) -> Column:
    """-ln(sigmoid(x)) without overflow."""
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))


def rloo_advantage(
    df: DataFrame, by: Sequence[str] = ("run", "row_id"), reward: str = "reward"
) -> DataFrame:
    """Reward minus the mean reward of the prompt's other samples; NULL for a lone one.

    Group sums are combined on the map side and joined back to the rows, one row
    per group; adaptive execution splits the rows of a group of any size.
    """
    names = [f"_by{i}" for i in range(len(by))]
    sums = df.groupBy(*[F.col(c).alias(name) for c, name in zip(by, names)]).agg(
        F.sum(reward).alias("_sum"), F.count(reward).alias("_n")
    )
    # NULL is a key as well
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{n}")) for c, n in zip(by, names)]
    joined = df.alias("r").join(sums.alias("s"), reduce(Column.__and__, same), "left")
    own = F.col(f"r.{reward}")
    return joined.select(
        *[F.col(f"r.{c}") for c in df.columns],
        (own - F.try_divide(F.col("s._sum") - own, F.col("s._n") - 1)).alias("advantage"),
    )


def pairwise_accuracy(
    df: DataFrame,
    chosen: str = "score_chosen",
    rejected: str = "score_rejected",
    by: Sequence[str] = (),
) -> DataFrame:
    """Share of pairs ranked right, and the mean Bradley-Terry loss."""
    margin = F.col(chosen).cast("double") - F.col(rejected).cast("double")
    return df.groupBy(*by).agg(
        F.avg((margin > 0).cast("double")).alias("accuracy"),
        F.avg(_negative_log_sigmoid(margin)).alias("loss"),
        F.count("*").alias("n"),
    )


def dpo_margin(
    df: DataFrame,
    beta: float = 0.1,
    policy_chosen: str = "lp_chosen",
    policy_rejected: str = "lp_rejected",
    ref_chosen: str = "ref_chosen",
    ref_rejected: str = "ref_rejected",
) -> DataFrame:
    """Implicit reward margin of a pair from four log-probabilities, its loss, its sign."""
    gain = (F.col(policy_chosen) - F.col(ref_chosen)) - (
        F.col(policy_rejected) - F.col(ref_rejected)
    )
    return (
        df.withColumn("margin", F.lit(float(beta)) * gain)
        .withColumn("loss", _negative_log_sigmoid(F.col("margin")))
        .withColumn("correct", F.col("margin") > 0)
    )
