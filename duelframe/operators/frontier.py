"""Reward against divergence: which runs no other run beats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_summary(rewards: DataFrame, divergences: DataFrame, run: str = "run") -> DataFrame:
    """Mean reward and KL of each run, one row per run."""
    return rewards.select(run, "mean_reward").join(divergences.select(run, "kl"), run)


def frontier(summary: DataFrame, run: str = "run") -> DataFrame:
    """The runs with more reward than every run of no higher KL.

    ``summary`` has one row per run (already aggregated), hence the single window.
    """
    before = Window.orderBy("kl", F.desc("mean_reward"), run).rowsBetween(
        Window.unboundedPreceding, -1
    )
    best = F.max("mean_reward").over(before)
    return (
        summary.withColumn("_best", best)
        .where(F.col("_best").isNull() | (F.col("mean_reward") > F.col("_best")))
        .drop("_best")
    )


def sweep_report(runs: DataFrame, run: str = "run", score: str = "score") -> DataFrame:
    """Mean score per method and noise level, per method, and of all: ``(method, level, subtotal, mean, n)``.

    ``run`` is a method, an underscore and the level's digits. ``subtotal`` is 0 for
    a method at a level, 1 for all levels of a method and 3 for all, so that a level
    that is missing from a name is told apart from a subtotal.
    """
    parts = lambda nth: F.nullif(F.regexp_extract(run, r"^(.*?)(?:_(\d+))?$", nth), F.lit(""))
    level = F.concat(F.substring(parts(2), 1, 1), F.lit("."), F.substring(parts(2), 2, 20)).cast("double")
    named = runs.select(parts(1).alias("method"), level.alias("level"), F.col(score).alias("_score"))
    return named.rollup("method", "level").agg(
        F.grouping_id().cast("int").alias("subtotal"), F.avg("_score").alias("mean"), F.count("_score").alias("n")
    )
