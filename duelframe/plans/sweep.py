"""How much label noise costs: one reward model per noise level."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.defaults import NOISE_LEVELS, NOISE_SEED
from duelframe.operators.noise import noise_marks
from duelframe.operators.objectives import pairwise_accuracy
from duelframe.operators.scoring import both_ways, fit_on_features


def noise_vs_accuracy(
    df: DataFrame,
    levels: Sequence[float] = NOISE_LEVELS,
    seed: int = NOISE_SEED,
    key: str = "row_id",
    buckets: int = 1 << 12,
    reg: float = 0.01,
    max_iter: int = 30,
) -> DataFrame:
    """Accuracy of the reward model on the unflipped validation split, per level.

    The texts are hashed once, both ways round; a flip only exchanges which of
    the two ways won, so a row carries one label per level. The features are kept on executors (memory, then disk) for
    the optimiser's passes and are computed again where an executor is lost.
    """
    texts = F.col("summaries.text")
    features = both_ways(df, texts[0], texts[1], buckets, key, "split", "choice")
    marked = noise_marks(features, levels, key, seed, counted=df.select(key, "split"))
    right = F.col("_way") == F.col("choice")
    kept = marked.select(
        "split",
        "_pair",
        right.alias("_right"),
        F.transform("flipped_at", lambda flipped: (flipped != right).cast("double")).alias("_won"),
    ).persist(StorageLevel.MEMORY_AND_DISK)
    train = kept.where("split = 'train'")
    held = kept.where("split <> 'train' AND _right").select("_pair")

    def measured(at: int, level: float) -> tuple:
        won = train.select("_pair", F.col("_won")[at].alias("_won"))
        reward = fit_on_features(won, "_won", reg, max_iter)
        margins = reward.margin(held, "score_chosen").withColumn("score_rejected", F.lit(0.0))
        return (float(level), *pairwise_accuracy(margins).first())

    # the levels' jobs overlap, so that one fills the cores another leaves idle
    try:
        with ThreadPoolExecutor(max(1, len(levels))) as pool:
            rows = list(pool.map(measured, range(len(levels)), levels))
    finally:
        kept.unpersist()
    return df.sparkSession.createDataFrame(
        rows, "noise_level double, accuracy double, loss double, n bigint"
    )
