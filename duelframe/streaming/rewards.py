"""Reward statistics kept up to date while the game log grows."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from duelframe.operators.rewards import reward_stats


def stream_reward_stats(
    log: DataFrame,
    window: str = "1 day",
    late: str = "1 hour",
    by: tuple[str, ...] = ("run",),
    ts: str = "ts",
    reward: str = "reward",
) -> DataFrame:
    """Mean, deviation and count per run and tumbling window; works on a batch too.

    The state is three numbers per run and open window. ``window_start`` is in
    seconds since the epoch, whatever the session's time zone.
    """
    rows = log.withWatermark(ts, late) if log.isStreaming else log
    grouped = reward_stats(rows, (F.window(ts, window).alias("window"), *by), reward)
    return grouped.select(
        F.unix_timestamp("window.start").alias("window_start"),
        *by,
        "reward_mean",
        "reward_std",
        "n",
    )


def keep_latest(stats: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and leave the whole current result as a table at ``path``.

    Windows still open are in it. Complete mode keeps every window's state; a log
    without end is better served by ``append_closed``.
    """

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return (
        stats.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(replace)
        .start()
    )


def append_closed(stats: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and append the windows that the watermark has passed.

    State is dropped with them; rows later than the watermark are not counted.
    """
    return (
        stats.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def upsert(stats: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and write the windows that it has changed as a version below ``path``.

    A batch's changes are one folder, which a batch that runs again replaces. Late
    rows within the watermark correct a window by a later version of it; a version
    that has been written is never changed. ``current`` reads the result.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(posixpath.join(path, f"version={number}"))

    return (
        stats.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def current(spark: SparkSession, path: str, version: int | None = None, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """The newest row of every window that ``upsert`` has written, or that of a version.

    Versions are combined before the shuffle, so a window that changed often is one
    row for each task.
    """
    rows = spark.read.parquet(path)
    if version is not None:
        rows = rows.where(F.col("version") <= version)
    keys = ["window_start", *by]
    values = [c for c in rows.columns if c not in (*keys, "version")]
    newest = F.max_by(F.struct(*values), "version").alias("newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, "newest.*")
