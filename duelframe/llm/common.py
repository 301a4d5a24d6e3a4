"""Expressions and helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.session import fresh_path

# What separates words: blank, tab, and the line and page breaks up to \r.
BLANKS = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole(text: str | Column) -> Column:
    """The text; a null text is empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def indexes(n: Column) -> Column:
    """0 to n - 1, for any n."""
    none = F.array().cast("array<int>")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none)


def cut(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to and read from the cluster's shared folder.

    Later jobs start from the files, so a lost executor costs no recomputation.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has returned, once nothing is read from them any more."""
    for table in tables:
        remove(table.sparkSession, _PATHS.pop(table))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the cluster's shared folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def column(name: str) -> Column:
    """A column by its exact name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def arrow_type(df: DataFrame, name: str) -> pa.DataType:
    """The type of a column in Arrow batches."""
    return df.select(column(name)).limit(0).toArrow().schema.field(name).type
