"""Evaluation jobs: best-of-n scores, reports, the frontier of runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.defaults import CANDIDATES, RESPONSE_LENGTHS, SAMPLED_PROMPTS, SAMPLING_SEED
from duelframe.functions.scores import activate, full_text
from duelframe.keys import Key, hashed_int, key_names
from duelframe.operators.alignment import kl_divergence, pair_runs
from duelframe.operators.exact import sample_exact
from duelframe.operators.frontier import frontier, run_summary
from duelframe.operators.rewards import best_of_n, mean_reward
from duelframe.operators.rows import repeat_queries
from duelframe.operators.scoring import Scorer, score_responses


def candidate_requests(
    prompts: DataFrame,
    n_samples: int | float = SAMPLED_PROMPTS,
    n_best_of: int = CANDIDATES,
    key: Key = "row_id",
    seed: int = SAMPLING_SEED,
    response_lengths: tuple[int, int] = RESPONSE_LENGTHS,
) -> DataFrame:
    """The prompts to answer: an exact sample, each ``n_best_of`` times.

    ``n_samples`` is a number of prompts, or as a fraction their share.
    ``response_length`` is drawn once per prompt and shared by its copies.
    """
    length = hashed_int(key, seed, *response_lengths)
    sample = sample_exact(prompts, n_samples, key, seed).withColumn("response_length", length)
    return repeat_queries(sample, n_best_of)


def evaluate_candidates(
    candidates: DataFrame,
    scorer_factory: Callable[[], Scorer] | None = None,
    activation: str = "sigmoid",
    with_query: bool = False,
    batch_size: int = 16,
    key: Key = "row_id",
) -> DataFrame:
    """The best candidate of every query, ``(run, key, query, response, score)``.

    Scores come from ``raw`` or, with a factory, from the scorer on the response
    (``with_query``: on query and response together).
    """
    if scorer_factory is None:
        scored = candidates.withColumn("score", activate(F.col("raw"), activation))
    else:
        text = full_text(F.col("query"), F.col("response")) if with_query else F.col("response")
        scored = score_responses(
            candidates.withColumn("_text", text),
            scorer_factory,
            "_text",
            "score",
            batch_size,
            activation,
        )
    names = key_names(key)
    return best_of_n(scored, ["run", *names], keep=("query", "response")).select(
        "run", *names, "query", "response", "score"
    )


def evaluation_report(best: DataFrame, reference: DataFrame, key: Key = "row_id") -> DataFrame:
    """Per run: mean reference and best-of-n reward, their difference, rows compared.

    Each run is paired with the whole reference; with ``run`` in the key, with its own rows there.
    """
    pairs = pair_runs(best, reference, key, run=None if "run" in key_names(key) else "run")
    return pairs.groupBy("run").agg(
        F.avg("score_ref").alias("mean_ref"),
        F.avg("score_best").alias("mean_best"),
        F.avg("uplift").alias("mean_uplift"),
        F.count("*").alias("n"),
    )


def frontier_of_runs(
    scores: DataFrame,
    reference: DataFrame,
    key: Key = "row_id",
    unmatched: str = "error",
) -> DataFrame:
    """Mean reward and KL of every run, reduced to the runs on the frontier."""
    summary = run_summary(
        mean_reward(scores), kl_divergence(scores, reference, key, unmatched=unmatched)
    )
    return frontier(summary)
