"""Readers with declared schemas: nothing is inferred, so nothing is read twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from duelframe import schemas
from duelframe.functions.scores import as_score
from duelframe.session import kept

# Text tables as other tools write them, quotes doubled and
# newlines inside quotes.
CSV = {
    "header": True,
    "multiLine": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "mode": "FAILFAST",
}


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan over the cores when it has fewer splits than there are cores.

    For text work on a few small files. A large scan has its own parallelism and
    is left alone. Call it on a plain scan: splits are counted by planning it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)


def _read(spark: SparkSession, path: str, schema: StructType, fmt: str) -> DataFrame:
    if fmt not in ("parquet", "json", "orc"):
        raise ValueError(f"unknown format {fmt!r}")
    return spark.read.schema(schema).format(fmt).load(path)


def read_comparisons(
    spark: SparkSession, path: str, fmt: str = "parquet", split: str | None = None
) -> DataFrame:
    """Comparison rows; ``split`` is a partition column, so one split reads its files only."""
    df = _read(spark, path, schemas.COMPARISONS, fmt)
    return df if split is None else df.where(F.col("split") == split)


def read_prompt_label(
    spark: SparkSession, path: str, split: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    df = _read(spark, path, schemas.PROMPT_LABEL, fmt)
    return df if split is None else df.where(F.col("split") == split)


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, record)``: the records of CSV files, newlines inside quotes included; no headers.

    Files are read in splits. Whether a line begins inside quotes depends on the
    number of quotes before it in its file, odd or even: a split says how many
    it has, and a running sum over the splits says how each begins. So a line is read
    under the state that holds there. Lines that are records of their own, most of
    them, stay where they are; the others are gathered by the place of their first.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        *place, F.monotonically_increasing_id().alias("at"), "value", (quotes % 2).cast("int").alias("odd")
    )
    lines = kept(lines, "csv-lines")
    inside = Window.partitionBy("file", "split").orderBy("at")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    sofar = lines.withColumn("sofar", F.coalesce(F.sum("odd").over(earlier), F.lit(0)))
    splits = lines.groupBy("file", "split").agg(F.sum("odd").alias("sum"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    states = splits.select(
        "file",
        "split",
        F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("state"),
        F.min("first").over(Window.partitionBy("file")).alias("header"),
    )
    within = ((F.col("state") + F.col("sofar")) % 2 == 1).alias("within")
    told = sofar.join(states, ["file", "split"]).select("file", "split", "at", "value", "odd", "header", within)
    alone = told.where("not within and odd = 0").select("file", "at", "header", F.col("value").alias("record"))
    # a record of several lines opens with an odd line outside quotes; the last opening before a line is its own
    parts = kept(told.where("within or odd = 1"), "csv-parts")
    opening = F.when(~F.col("within"), F.col("at"))
    lasts = parts.groupBy("file", "split").agg(F.max(opening).alias("last"))
    carried = lasts.select("file", "split", F.last("last", ignorenulls=True).over(before).alias("carried"))
    own = F.last(opening, ignorenulls=True).over(inside).alias("own")
    owned = parts.select("*", own).join(carried, ["file", "split"])
    owned = owned.groupBy("file", "header", F.coalesce("own", "carried").alias("at")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("at").alias("i"), "value"))).alias("lines")
    )
    joined = owned.select("file", "at", "header", F.array_join(F.col("lines.value"), "\n").alias("record"))
    whole = alone.unionByName(joined).where("at <> header")
    return whole.select("file", F.regexp_replace("record", "\r$", "").alias("record")).where("record <> ''")


def _read_csv(spark: SparkSession, path: str, schema: StructType, splits: bool) -> DataFrame:
    """Columns as text."""
    if not splits:
        return spark.read.schema(schema).options(**CSV).csv(path)
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in CSV.items() if k not in ("header", "multiLine")}
    records = quoted_records(spark, path)
    return records.select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), options).alias("r")).select("r.*")


def read_scores(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: StructType = schemas.SCORES,
    splits: bool = False,
) -> DataFrame:
    """A score table. CSV is for exchange: a file is one task, or with ``splits`` many.

    The CSV's first column is the row number. Its scores are cast from text, so
    that a bad one raises instead of turning into NULL. With ``splits``, lines are
    written once beside the files, to be put together to records.
    """
    if fmt != "csv":
        return _read(spark, path, schema, fmt)
    as_text = StructType([StructField(f.name, StringType()) for f in schema])
    found = spark.read.options(**CSV).csv(path).columns
    # the row number's column has no name in files of other tools
    if found[1:] != schema.names[1:] or found[0] not in (schema.names[0], "_c0"):
        raise ValueError(f"columns {found} instead of {schema.names}")
    text = _read_csv(spark, path, as_text, splits)
    return text.select(
        *[
            as_score(F.col(f.name)).alias(f.name)
            if f.dataType.typeName() == "double"
            else F.col(f.name).cast(f.dataType)
            for f in schema
        ]
    )


def read_game_log(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    df = spark.read.schema(schemas.GAME_LOG).parquet(path).select(*schemas.GAME_LOG.names)
    return df if run is None else df.where(F.col("run") == run)


def stream_game_log(spark: SparkSession, path: str) -> DataFrame:
    """The game log as a stream of the files that arrive."""
    return spark.readStream.schema(schemas.GAME_LOG).parquet(path)
