"""Operators: functions from DataFrames and parameters to a DataFrame."""

from duelframe.operators.alignment import align_scores, kl_divergence, pair_runs
from duelframe.operators.exact import sample_exact
from duelframe.operators.frontier import frontier, run_summary, sweep_report
from duelframe.operators.heads import validation_head
from duelframe.operators.noise import Noise, add_noise, flip_labels, noise_sweep
from duelframe.operators.objectives import dpo_margin, pairwise_accuracy, rloo_advantage
from duelframe.operators.positions import with_positions
from duelframe.operators.rewards import (
    best_of_n,
    mean_reward,
    merge_sketches,
    reward_dist,
    reward_sketches,
    reward_stats,
    reward_values,
    sketch_quantiles,
    token_argmax,
)
from duelframe.operators.rouge import bootstrap, rouge, rouge_bootstrap, rouge_l, rouge_l_sum, rouge_n
from duelframe.operators.rows import (
    assemble_splits,
    pair_length_filter,
    prompt_length_filter,
    repeat_queries,
    to_kto,
)
from duelframe.operators.scoring import LinearReward, fit_linear_reward, score_responses
from duelframe.operators.vocabulary import Vocabulary, build_vocab, decode, encode

__all__ = [
    "LinearReward",
    "Noise",
    "Vocabulary",
    "add_noise",
    "align_scores",
    "assemble_splits",
    "best_of_n",
    "bootstrap",
    "build_vocab",
    "decode",
    "dpo_margin",
    "encode",
    "fit_linear_reward",
    "flip_labels",
    "frontier",
    "kl_divergence",
    "mean_reward",
    "merge_sketches",
    "noise_sweep",
    "pair_length_filter",
    "pair_runs",
    "pairwise_accuracy",
    "prompt_length_filter",
    "repeat_queries",
    "reward_dist",
    "reward_sketches",
    "reward_stats",
    "reward_values",
    "rloo_advantage",
    "rouge",
    "rouge_bootstrap",
    "rouge_l",
    "rouge_l_sum",
    "rouge_n",
    "run_summary",
    "sample_exact",
    "score_responses",
    "sketch_quantiles",
    "sweep_report",
    "to_kto",
    "token_argmax",
    "validation_head",
    "with_positions",
]
