"""Structured Streaming jobs."""

from duelframe.streaming.rewards import append_closed, current, keep_latest, stream_reward_stats, upsert

__all__ = ["append_closed", "current", "keep_latest", "stream_reward_stats", "upsert"]
