"""Seeded label noise of an exact share."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.defaults import NOISE_KIND, NOISE_LEVELS, NOISE_SEED
from duelframe.keys import Key
from duelframe.operators.exact import check_level, cutoffs, place, share_of


@dataclass(frozen=True)
class Noise:
    """What is done to the labels of the training split."""

    level: float = 0.0
    seed: int = NOISE_SEED
    kind: str = NOISE_KIND


def _trained(split: str | None, train: str) -> Column:
    return F.lit(True) if split is None else F.col(split) == train


def _rows(df: DataFrame, split: str | None, train: str) -> DataFrame:
    return df if split is None else df.where(F.col(split) == train)


def flip_labels(
    df: DataFrame,
    level: float,
    key: Key = "row_id",
    seed: int = NOISE_SEED,
    label: str = "choice",
    split: str | None = "split",
    train: str = "train",
    counted: DataFrame | None = None,
) -> DataFrame:
    """Flip the 0/1 label of exactly ``floor(level * n)`` training rows.

    ``noise_flipped`` tells which. Other splits stay as they are; ``split=None``
    treats every row as training. The sets of rising levels are nested, and the
    same call twice gives back the input labels. ``counted`` gives the rows that
    n and the shares refer to where they are not those of ``df`` one to one.
    """
    if check_level(level) == 0.0:
        return df.withColumn("noise_flipped", F.lit(False))
    rows = _rows(df if counted is None else counted, split, train)
    found = cutoffs(rows, {level: share_of(level)}, key, seed)
    cutoff = found.agg(F.max("cutoff")).scalar()
    chosen = _trained(split, train) & (place(key, seed) <= cutoff)
    return df.withColumn("noise_flipped", F.coalesce(chosen, F.lit(False))).withColumn(
        label, _flipped(label, df)
    )


def _flipped(label: str, df: DataFrame) -> Column:
    turned = (F.lit(1) - F.col(label)).cast(df.schema[label].dataType)
    return F.when(F.col("noise_flipped"), turned).otherwise(F.col(label))


def _cutoff_of_level(
    counted: DataFrame, levels: Sequence[float], key: Key, seed: int
) -> Column:
    """The cutoffs of all levels in one scalar, a map by level."""
    sizes = {check_level(level): share_of(level) for level in levels}
    if not sizes:
        raise ValueError("no noise level given")
    found = cutoffs(counted, sizes, key, seed)
    return found.agg(F.map_from_entries(F.collect_list(F.struct("tag", "cutoff")))).scalar()


def noise_sweep(
    df: DataFrame,
    levels: Sequence[float] = NOISE_LEVELS,
    key: Key = "row_id",
    seed: int = NOISE_SEED,
    label: str = "choice",
    split: str | None = "split",
    train: str = "train",
) -> DataFrame:
    """One noised copy of the rows per level, told apart by ``noise_level``.

    All cutoffs come from one count of the hashes; the copies are made and
    flipped in one pass over the rows.
    """
    by_level = _cutoff_of_level(_rows(df, split, train), levels, key, seed)
    copies = df.withColumn("_place", place(key, seed)).withColumn(
        "noise_level", F.explode(F.array(*[F.lit(float(level)) for level in levels]))
    )
    cutoff = F.try_element_at(by_level, F.col("noise_level"))
    chosen = _trained(split, train) & (F.col("_place") <= cutoff)
    return (
        copies.withColumn("noise_flipped", F.coalesce(chosen, F.lit(False)))
        .withColumn(label, _flipped(label, df))
        .drop("_place")
    )


def noise_marks(
    df: DataFrame,
    levels: Sequence[float] = NOISE_LEVELS,
    key: Key = "row_id",
    seed: int = NOISE_SEED,
    split: str | None = "split",
    train: str = "train",
    counted: DataFrame | None = None,
) -> DataFrame:
    """The rows once, with ``flipped_at``: for each level whether the row is flipped."""
    rows = _rows(df if counted is None else counted, split, train)
    by_level = _cutoff_of_level(rows, levels, key, seed)
    marks = [
        F.coalesce(
            _trained(split, train)
            & (F.col("_place") <= F.try_element_at(by_level, F.lit(float(level)))),
            F.lit(False),
        )
        for level in levels
    ]
    return (
        df.withColumn("_place", place(key, seed))
        .withColumn("flipped_at", F.array(*marks))
        .drop("_place")
    )


NOISE_KINDS: dict[str, Callable[..., DataFrame]] = {NOISE_KIND: flip_labels}


def add_noise(df: DataFrame, noise: Noise, key: Key = "row_id", **more: object) -> DataFrame:
    """Apply the noise of the given kind."""
    if noise.kind not in NOISE_KINDS:
        raise ValueError(f"unknown noise type: {noise.kind}")
    return NOISE_KINDS[noise.kind](df, noise.level, key=key, seed=noise.seed, **more)
