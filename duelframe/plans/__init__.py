"""Whole jobs put together from operators."""

from duelframe.plans.evaluate import evaluation_report, evaluate_candidates, frontier_of_runs
from duelframe.plans.prepare import TASKS, prepare, register_task
from duelframe.plans.sweep import noise_vs_accuracy

__all__ = [
    "TASKS",
    "evaluate_candidates",
    "evaluation_report",
    "frontier_of_runs",
    "noise_vs_accuracy",
    "prepare",
    "register_task",
]
