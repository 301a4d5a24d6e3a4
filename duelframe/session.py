"""Places for intermediate tables, taken from the session."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A local session that names none uses a folder below its warehouse.
    """
    named = spark.conf.get(_CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(
        _CHECKPOINT_DIR
    )
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_DIR} to a folder shared by the cluster")
    return posixpath.join(spark.conf.get("spark.sql.warehouse.dir"), "duelframe-tables")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier call has returned."""
    return posixpath.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def kept(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """The same rows, written to and read from the shared folder: evaluated once, whoever reads them."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
