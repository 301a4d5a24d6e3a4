"""Declared schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

COMPARISONS = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("info", T.StructType([T.StructField("post", T.StringType())])),
        T.StructField(
            "summaries",
            T.ArrayType(T.StructType([T.StructField("text", T.StringType())])),
        ),
        T.StructField("choice", T.IntegerType()),
        T.StructField("split", T.StringType()),
    ]
)

PROMPT_LABEL = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("split", T.StringType()),
    ]
)

SCORES = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("query", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)

BEST_OF = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("query", T.StringType()),
        T.StructField("response_ref", T.StringType()),
        T.StructField("score_ref", T.DoubleType()),
        T.StructField("response_best", T.StringType()),
        T.StructField("score_best", T.DoubleType()),
    ]
)

GAME_LOG = T.StructType(
    [
        T.StructField("step", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("query", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("ref_response", T.StringType()),
        T.StructField("ref_reward", T.DoubleType()),
        T.StructField("reward", T.DoubleType()),
        T.StructField("run", T.StringType()),
    ]
)
