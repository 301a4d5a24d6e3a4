"""Readers and writers."""

from duelframe.sources.readers import (
    read_comparisons,
    read_game_log,
    read_prompt_label,
    read_scores,
    spread,
    stream_game_log,
)
from duelframe.sources.writers import (
    append_game_log,
    snapshot,
    write_best_of,
    write_scores,
)

__all__ = [
    "append_game_log",
    "read_comparisons",
    "read_game_log",
    "read_prompt_label",
    "read_scores",
    "snapshot",
    "spread",
    "stream_game_log",
    "write_best_of",
    "write_scores",
]
