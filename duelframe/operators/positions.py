"""Row positions of files, for tables that are paired by place and have no row number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelframe.session import kept


def with_positions(df: DataFrame, position: str = "position") -> DataFrame:
    """Add each row's place among all rows of the files, from 0; files in the order of their names.

    ``df`` is a plain scan of files. Tasks number the rows of each split as they
    read them, and the rows are written with these numbers. What precedes a split is
    a running sum over the sizes of the splits, of which there are as many as a scan
    has tasks at most; rows are neither sorted nor shuffled.
    """
    if position in df.columns:
        raise ValueError(f"there is a column {position!r} already")
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("id"),
    )
    rows = kept(df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns], place.alias("_place")), "positions")
    splits = rows.groupBy(F.col("_place.file").alias("_file"), F.col("_place.split").alias("_split")).agg(
        F.min("_place.id").alias("_first"), F.count("*").alias("_size")
    )
    before = Window.orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("_at", F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first"))
    same = (F.col("_place.file") == F.col("_file")) & (F.col("_place.split") == F.col("_split"))
    placed = rows.join(starts.drop("_size", "_first"), same)
    return placed.select(*df.columns, (F.col("_at") + F.col("_place.id")).alias(position))
