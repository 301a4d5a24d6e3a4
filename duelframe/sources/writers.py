"""Writers. All overwrite or append through Spark's committers; none deletes first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from duelframe import schemas

# The writing side of the reader's CSV options.
CSV_OUT = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def snapshot(df: DataFrame, path: str, kind: str) -> None:
    """Save raw rows below ``type=<kind>/split=...``, replacing those partitions only."""
    (
        df.withColumn("type", F.lit(kind))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("type", "split")
        .parquet(path)
    )


def _write(df: DataFrame, path: str, fmt: str) -> None:
    if fmt == "csv":
        df.write.mode("overwrite").options(**CSV_OUT).csv(path)
    elif fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_scores(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    _write(df.select(*schemas.SCORES.fieldNames()), path, fmt)


def write_best_of(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    _write(df.select(*schemas.BEST_OF.fieldNames()), path, fmt)


def append_game_log(
    df: DataFrame,
    path: str,
    checkpoint: str | None = None,
    columns: tuple[str, ...] = tuple(schemas.GAME_LOG.fieldNames()),
    batch: str | None = None,
) -> StreamingQuery | None:
    """Add ``columns`` of a step's rows to the log, partitioned by ``run``, which is among them.

    ``batch`` names what is added, such as a step: a batch that is written again, after
    a failure or by a retry, replaces what it wrote before and is in the log once.
    A log has batches of names or none. A streaming frame needs a checkpoint folder, which
    tells its batches apart; its query is returned.
    """
    rows = df.select(*columns)
    if not df.isStreaming and batch is not None:
        if not batch:
            raise ValueError("the name of a batch is empty")
        (
            rows.withColumn("batch", F.lit(batch))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch", "run")
            .parquet(path)
        )
        return None
    if not df.isStreaming:
        rows.write.mode("append").partitionBy("run").parquet(path)
        return None
    if checkpoint is None:
        raise ValueError("a streaming game log needs a checkpoint folder")
    return (
        rows.writeStream.format("parquet")
        .partitionBy("run")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start(path)
    )
