"""Scores for texts: a plug-in scorer, or a linear reward model fitted on pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.functions.scores import activate
from duelframe.functions.tokens import words

Scorer = Callable[[list[str]], list[float]]

# So many characters of the pairs are a task's; their vectors take about four times as much.
CHARACTERS = 1 << 24


def score_responses(
    df: DataFrame,
    scorer_factory: Callable[[], Scorer],
    text: str = "text",
    score: str = "score",
    batch_size: int = 16,
    activation: str = "none",
) -> DataFrame:
    """Score texts with user code that takes a batch of texts.

    ``scorer_factory`` runs once per task and loads the model; its scorer gets
    at most ``batch_size`` texts at a time, from Arrow batches.
    """

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = scorer_factory()
        for texts in batches:
            values: list[float] = []
            for at in range(0, len(texts), batch_size):
                values += scorer(texts.iloc[at : at + batch_size].tolist())
            yield pd.Series(values, dtype="float64")

    return df.withColumn(score, activate(scored(F.col(text)), activation))


@dataclass(frozen=True)
class LinearReward:
    """A Bradley-Terry model with a linear reward over hashed word counts.

    The logistic regression sees (one side, other side) side by side. It was
    trained on every pair both ways round, so its weights for the second side
    are those of the first with the sign turned, and a text's reward is the
    margin of the text against an empty one.
    """

    model: LogisticRegressionModel
    buckets: int

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> LinearReward:
        model = LogisticRegressionModel.load(path)
        return cls(model, model.numFeatures // 2)

    def score(self, df: DataFrame, text: str, score: str = "score") -> DataFrame:
        """Add the raw reward of a text column."""
        hashed = _hashed(df, words(F.col(text)), "_first", self.buckets)
        empty = F.array().cast("array<string>")
        return self.margin(
            _side_by_side(_hashed(hashed, empty, "_second", self.buckets)), score
        )

    def margin(self, pairs: DataFrame, margin: str) -> DataFrame:
        """Add reward(first) - reward(second) to rows with a ``_pair`` vector."""
        shown = self.model.setFeaturesCol("_pair").transform(pairs)
        return shown.withColumn(margin, vector_to_array("rawPrediction")[1]).drop(
            "_pair", "rawPrediction", "probability", "prediction"
        )


def _hashed(df: DataFrame, tokens: Column, out: str, buckets: int) -> DataFrame:
    hashing = HashingTF(numFeatures=buckets, inputCol="_tokens", outputCol=out)
    return hashing.transform(df.withColumn("_tokens", tokens)).drop("_tokens")


def _side_by_side(df: DataFrame) -> DataFrame:
    pair = VectorAssembler(inputCols=["_first", "_second"], outputCol="_pair")
    return pair.transform(df).drop("_first", "_second")


def both_ways(
    df: DataFrame, one: Column, other: Column, buckets: int, *keep: str
) -> DataFrame:
    """Every pair of texts twice, as ``_pair`` vectors: ``_way`` 0 has ``one`` first.

    Each text is cut into words and hashed once. The pairs are dealt to as many
    tasks as their texts' length asks for, which is added up first: an optimiser
    reads a task's vectors as a whole.
    """
    given = df.select(*keep, one.alias("_a"), other.alias("_b"))
    length = [F.coalesce(F.length(c), F.lit(0)).cast("long") for c in ("_a", "_b")]
    total = given.agg(F.sum(length[0] + length[1])).first()[0] or 0
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, ceil(total / CHARACTERS))
    texts = given.repartition(tasks).withColumns({c: words(F.col(c)) for c in ("_a", "_b")})
    hashed = _hashed(texts, F.col("_a"), "_one", buckets)
    hashed = _hashed(hashed, F.col("_b"), "_other", buckets)
    ways = F.posexplode(
        F.array(
            F.struct(F.col("_one").alias("first"), F.col("_other").alias("second")),
            F.struct(F.col("_other").alias("first"), F.col("_one").alias("second")),
        )
    ).alias("_way", "_sides")
    turned = hashed.select(*keep, ways).select(
        *keep,
        "_way",
        F.col("_sides.first").alias("_first"),
        F.col("_sides.second").alias("_second"),
    )
    return _side_by_side(turned)


def fit_on_features(
    pairs: DataFrame, first_won: str, reg: float = 0.01, max_iter: int = 30
) -> LinearReward:
    """Fit on ``_pair`` vectors and whether the first side won.

    ``pairs`` should hold every pair both ways round (see ``fit_linear_reward``).
    """
    fitted = LogisticRegression(
        featuresCol="_pair",
        labelCol=first_won,
        fitIntercept=False,
        standardization=False,
        regParam=reg,
        maxIter=max_iter,
        tol=1e-9,
    ).fit(pairs)
    return LinearReward(fitted, fitted.numFeatures // 2)


def fit_linear_reward(
    df: DataFrame,
    chosen: str = "chosen",
    rejected: str = "rejected",
    buckets: int = 1 << 12,
    reg: float = 0.01,
    max_iter: int = 30,
) -> LinearReward:
    """Fit the linear reward on text pairs, on MLlib's distributed optimiser."""
    ways = both_ways(df, F.col(chosen), F.col(rejected), buckets)
    pairs = ways.select("_pair", (F.col("_way") == 0).cast("double").alias("won"))
    # the optimiser reads them several times; a lost executor's part is computed again
    pairs.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return fit_on_features(pairs, "won", reg, max_iter)
    finally:
        pairs.unpersist()


def weights(spark: SparkSession, reward: LinearReward) -> DataFrame:
    """The reward's weight per hash bucket, ``(bucket, weight)``; as many as buckets."""
    values = reward.model.coefficients.toArray()[: reward.buckets]
    return spark.createDataFrame(
        pd.DataFrame({"bucket": range(len(values)), "weight": values}),
        "bucket int, weight double",
    )
