"""The engine's inputs, derived from the given tables, in Spark and in SQL.

Each SQL constant is a list of common table expressions with the same rows as
the Spark function beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.functions.scores import activate
from duelframe.keys import hashed_int
from duelframe.operators.vocabulary import Vocabulary, build_vocab
from duelframe.sources import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed_sql(key: str, seed: int, low: int, high: int) -> str:
    word = f"CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT)"
    return f"CAST({low} + {word} % {high - low} AS INTEGER)"


# --- comparisons: a document's thirds are a post and two answers -------------------

LABEL_SEED, SPLIT_SEED = 7, 11


def comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; the quality label says which answer was preferred.

    Where a document has no label, a bit of its hash stands in for one.
    """
    third = F.floor(F.length("text") / 3).cast("int")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    held = hashed_int("doc_id", SPLIT_SEED, 0, 5) == 0
    return (
        spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("row_id"),
            F.struct(F.substring("text", F.lit(1), third).alias("post")).alias("info"),
            F.array(
                F.struct(F.substring("text", third + 1, third).alias("text")),
                F.struct(F.substring("text", third * 2 + 1, F.length("text")).alias("text")),
            ).alias("summaries"),
            F.coalesce("quality", hashed_int("doc_id", LABEL_SEED, 0, 2)).alias("choice"),
            F.when(held, "validation").otherwise("train").alias("split"),
        )
    )


COMPARISONS_SQL = f"""
comparisons AS (
  SELECT doc_id AS row_id, substring(text, 1, third) AS post,
         [substring(text, third + 1, third), substring(text, 2 * third + 1)] AS answers,
         coalesce(quality, {hashed_sql("doc_id", LABEL_SEED, 0, 2)}) AS choice,
         CASE WHEN {hashed_sql("doc_id", SPLIT_SEED, 0, 5)} = 0
              THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT *, length(text) // 3 AS third FROM documents) LEFT JOIN labels USING (doc_id)
)"""


# Validation rows that the queries keep, or all where there are fewer; and a head that
# every one of the given tables has, for the queries that insist on it.
HEAD, STRICT_HEAD = 2000, 20
# The share of the prompts that evaluations answer.
SHARE = 0.1


def noised_sql(level: float, head: int = HEAD) -> str:
    """Comparisons with the validation head kept and training labels flipped."""
    return f"""{COMPARISONS_SQL},
headed AS (
  SELECT * EXCLUDE (nth) FROM (
    SELECT *, row_number() OVER (PARTITION BY split ORDER BY row_id) AS nth FROM comparisons)
  WHERE split = 'train' OR nth <= {head}
),
train_size AS (SELECT count(*) AS c FROM comparisons WHERE split = 'train'),
noised AS (
  SELECT row_id, split, post, answers,
         split = 'train' AND nth <= floor(CAST({level} AS DOUBLE) * c) AS noise_flipped,
         CASE WHEN split = 'train' AND nth <= floor(CAST({level} AS DOUBLE) * c)
              THEN 1 - choice ELSE choice END AS choice
  FROM (SELECT *, row_number() OVER (PARTITION BY split
               ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id) AS nth FROM headed),
       train_size
),
picked AS (
  SELECT *, answers[choice + 1] AS chosen, answers[2 - choice] AS rejected FROM noised
)"""


# --- verdicts: labels keyed by four columns, one per order line --------------------

VERDICT_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        *VERDICT_KEY,
        (F.col("l_quantity") > 25).cast("int").alias("choice"),
        F.when(F.col("l_linestatus") == "O", "train").otherwise("validation").alias("split"),
    )


_VERDICT_COLUMNS = ", ".join(VERDICT_KEY)
_VERDICT_TEXT = " || ':' || ".join(["'42'"] + [f"CAST({k} AS VARCHAR)" for k in VERDICT_KEY])

VERDICTS_SQL = f"""
verdicts AS (
  SELECT {_VERDICT_COLUMNS}, CAST(l_quantity > 25 AS INTEGER) AS choice,
         CASE WHEN l_linestatus = 'O' THEN 'train' ELSE 'validation' END AS split
  FROM lineitem
),
verdict_order AS (
  SELECT *, row_number() OVER (PARTITION BY split
           ORDER BY md5({_VERDICT_TEXT}), {_VERDICT_COLUMNS}) AS nth
  FROM verdicts
),
train_size AS (SELECT count(*) AS c FROM verdicts WHERE split = 'train')"""


# --- dialogue pairs: a user turn and the assistant turn after it -------------------


def dialogue_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    answered = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("label")
    )
    return asked.join(answered, ["conv_id", "turn"])


PAIRS_SQL = """
pairs AS (
  SELECT a.conv_id, a.turn, a.text AS prompt, b.text AS label
  FROM conversations a JOIN conversations b
    ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant'
)"""


def prompt_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue pairs as language-model rows, conversations split by hash."""
    held = hashed_int("conv_id", SPLIT_SEED, 0, 5) == 0
    return dialogue_pairs(spark, sf_dir).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
        F.when(held, "valid").otherwise("train").alias("split"),
        "prompt",
        "label",
    )


PROMPT_LABEL_SQL = f"""{PAIRS_SQL},
prompt_label AS (
  SELECT conv_id * 1000 + turn AS row_id,
         CASE WHEN {hashed_sql("conv_id", SPLIT_SEED, 0, 5)} = 0
              THEN 'valid' ELSE 'train' END AS split, prompt, label
  FROM pairs
)"""


# --- candidates: the lines of an order are answers to it ---------------------------


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cand`` orders a query's lines; line, part and supplier make it unique."""
    rows = table(spark, sf_dir, "lineitem")
    cand = (
        F.col("l_linenumber").cast("bigint") * 1000000000000000000
        + F.col("l_partkey") * 100000000
        + F.col("l_suppkey")
    )
    return rows.select(
        F.col("l_linestatus").alias("run"),
        F.col("l_orderkey").alias("row_id"),
        cand.alias("cand"),
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("query"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("response"),
        ((F.col("l_extendedprice") - 50000) / 20000).alias("raw"),
        F.col("l_quantity").alias("reward"),
    )


CANDIDATES_SQL = """
candidates AS (
  SELECT l_linestatus AS run, l_orderkey AS row_id,
         CAST(l_linenumber AS BIGINT) * 1000000000000000000
           + l_partkey * 100000000 + l_suppkey AS cand,
         'order ' || CAST(l_orderkey AS VARCHAR) AS query,
         'part ' || CAST(l_partkey AS VARCHAR) AS response,
         (l_extendedprice - 50000) / 20000 AS raw,
         1 / (1 + exp(-(l_extendedprice - 50000) / 20000)) AS score,
         l_quantity AS reward
  FROM lineitem
),
best AS (
  SELECT * EXCLUDE (nth) FROM (
    SELECT *, row_number() OVER (PARTITION BY run, row_id ORDER BY score DESC, cand) AS nth
    FROM candidates)
  WHERE nth = 1
),
first_answers AS (
  SELECT * EXCLUDE (nth) FROM (
    SELECT *, row_number() OVER (PARTITION BY run, row_id ORDER BY cand) AS nth
    FROM candidates)
  WHERE nth = 1
)"""


def scored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).withColumn("score", activate(F.col("raw")))


# --- events as reward log and as scores per user -----------------------------------


def game_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_game_log(table(spark, sf_dir, "events"))


def as_game_log(events: DataFrame) -> DataFrame:
    """Sixteen events to a step; the time is read as UTC in any session."""
    in_session_zone = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts"))
    return events.select(
        F.floor(F.col("event_id") / 16).alias("step"),
        in_session_zone.cast("timestamp").alias("ts"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("query"),
        F.col("event_type").alias("response"),
        F.col("props").alias("ref_response"),
        (F.col("value") / 2).alias("ref_reward"),
        F.col("value").alias("reward"),
        F.col("event_type").alias("run"),
    )


GAME_LOG_SQL = """
game_log AS (
  SELECT event_id // 16 AS step, ts, 'user ' || CAST(user_id AS VARCHAR) AS query,
         event_type AS response, props AS ref_response, value / 2 AS ref_reward,
         value AS reward, event_type AS run
  FROM events
)"""


def user_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score per event type and user."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("run"), F.col("user_id").alias("row_id"))
        .agg(F.avg("value").alias("score"))
    )


USER_SCORES_SQL = """
user_scores AS (
  SELECT event_type AS run, user_id AS row_id, avg(value) AS score FROM events GROUP BY ALL
)"""


def noise_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score per method, level and user; the weekday stands for the noise level."""
    from duelframe.functions.naming import run_key

    level = (F.dayofweek("ts") - 1) / 20
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            run_key(level, F.col("event_type")).alias("run"), F.col("user_id").alias("row_id")
        )
        .agg(F.avg("value").alias("score"))
    )


NOISE_RUNS_SQL = """
noise_runs AS (
  SELECT event_type || '_0' || CASE dayofweek(ts) WHEN 0 THEN '0' WHEN 2 THEN '1'
           WHEN 4 THEN '2' WHEN 6 THEN '3'
           ELSE lpad(CAST(dayofweek(ts) * 5 AS VARCHAR), 2, '0') END AS run,
         user_id AS row_id, avg(value) AS score
  FROM events GROUP BY ALL
)"""


# --- vocabulary of all documents ----------------------------------------------------


def vocabulary(spark: SparkSession, sf_dir: str, size: int | None = None) -> Vocabulary:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return build_vocab(documents, "text", size=size)


TOKENS = r"<\|endoftext\|>|[a-z0-9]+"

VOCAB_SQL = rf"""
vocab AS (
  SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 2 AS INTEGER) AS token_id, n
  FROM (SELECT token, count(*) AS n
        FROM (SELECT unnest(regexp_extract_all(lower(text), '{TOKENS}')) AS token FROM documents)
        WHERE token <> '<|endoftext|>'
        GROUP BY token)
),
all_tokens AS (
  SELECT token, token_id FROM vocab
  UNION ALL SELECT '<|endoftext|>', 0 UNION ALL SELECT '<unk>', 1 UNION ALL SELECT '[PAD]', 2
)"""


def encode_sql(name: str, source: str, key: str, text: str, ids: str) -> str:
    """``name(key, ids)``: the token ids of a text column."""
    return rf"""
{name} AS (
  SELECT {key}, coalesce(ids, []) AS {ids}
  FROM (SELECT {key} FROM {source}) LEFT JOIN (
    SELECT {key}, list(coalesce(token_id, 1) ORDER BY nth) AS ids
    FROM (SELECT {key}, unnest(t) AS token, generate_subscripts(t, 1) AS nth
          FROM (SELECT {key}, regexp_extract_all(lower({text}), '{TOKENS}') AS t FROM {source}))
    LEFT JOIN all_tokens USING (token) GROUP BY {key}) USING ({key})
)"""


def decode_sql(name: str, source: str, key: str, ids: str, text: str) -> str:
    """``name(key, text)``: the words of an id array joined by blanks."""
    return f"""
{name} AS (
  SELECT {key}, coalesce(words, '') AS {text}
  FROM (SELECT {key} FROM {source}) LEFT JOIN (
    SELECT {key}, string_agg(token, ' ' ORDER BY nth) AS words
    FROM (SELECT {key}, unnest({ids}) AS token_id, generate_subscripts({ids}, 1) AS nth
          FROM {source})
    JOIN all_tokens USING (token_id) GROUP BY {key}) USING ({key})
)"""
