"""ROUGE of predictions against references."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import exp, floor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.functions.tokens import words
from duelframe.keys import Key, key_names


def _f_measure(overlap: Column, predicted: Column, referred: Column) -> Column:
    both = predicted + referred
    return F.coalesce(F.try_divide(F.lit(2.0) * overlap, both), F.lit(0.0))


def _common_grams(a: list[str], b: list[str], n: int) -> int:
    """N-grams of both, each as often as both have it."""
    one, other = (Counter(zip(*(words[k:] for k in range(n)))) for words in (a, b))
    return (one & other).total()


def rouge_n(
    df: DataFrame,
    n: int,
    prediction: str = "prediction",
    reference: str = "reference",
    key: Key = "row_id",
) -> DataFrame:
    """ROUGE-n of every row: precision, recall and F over clipped n-gram counts.

    Rows are spread by key, and n-grams are counted row by row inside Arrow
    batches: none of them becomes a row, is grouped or shuffled.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    names = key_names(key)

    @F.pandas_udf("long")
    def common(p: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([_common_grams(list(a), list(b), n) for a, b in zip(p, r)], dtype="int64")

    def grams(text: str) -> Column:
        return F.greatest(F.size(_words(text)) - (n - 1), F.lit(0))

    rows = df.select(*names, prediction, reference).repartition(*names)
    hits = common(_words(prediction), _words(reference))
    return _from_hits(rows, hits, grams(prediction), grams(reference), key)


def _match_rows(a: list[str], b: list[str]) -> Iterator[int]:
    """Bit rows of the common-subsequence table of ``a`` and ``b``.

    Bit j of row i is set where the length rises from column j to j + 1, so the
    length at (i, j) is the number of bits of row i below j. One row costs a few
    operations on an integer of ``len(b)`` bits.
    """
    where: dict[str, int] = {}
    for j, word in enumerate(b):
        where[word] = where.get(word, 0) | (1 << j)
    full = (1 << len(b)) - 1
    rises = 0
    yield rises
    for word in a:
        hits = where.get(word, 0) | rises
        rises = hits & ~(hits - ((rises << 1) | 1)) & full
        yield rises


def _common_length(a: list[str], b: list[str]) -> int:
    for row in _match_rows(a, b):
        last = row
    return last.bit_count()


def _common_places(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of one longest common subsequence, found from the end."""
    rows = list(_match_rows(a, b))

    def length(i: int, j: int) -> int:
        return (rows[i] & ((1 << j) - 1)).bit_count()

    places = set()
    i, j = len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            places.add(i)
        elif length(i, j - 1) > length(i - 1, j):
            j -= 1
        else:
            i -= 1
    return places


def _summary_hits(reference: list[list[str]], prediction: list[list[str]]) -> int:
    """Words of the reference sentences covered by any prediction sentence, clipped."""
    left_p = Counter(w for s in prediction for w in s)
    left_r = Counter(w for s in reference for w in s)
    hits = 0
    for sentence in reference:
        covered = set().union(*[_common_places(sentence, other) for other in prediction])
        for place in sorted(covered):
            word = sentence[place]
            if left_p[word] > 0 and left_r[word] > 0:
                hits += 1
                left_p[word] -= 1
                left_r[word] -= 1
    return hits


def _whole(text: str) -> Column:
    """A null text has no words, for every kind of ROUGE."""
    return F.coalesce(F.col(text), F.lit(""))


def _words(text: str) -> Column:
    return words(_whole(text))


def rouge_l(
    df: DataFrame,
    prediction: str = "prediction",
    reference: str = "reference",
    key: Key = "row_id",
) -> DataFrame:
    """ROUGE-L of every row: the longest common subsequence of the whole texts."""

    @F.pandas_udf("long")
    def common(p: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([_common_length(list(a), list(b)) for a, b in zip(p, r)], dtype="int64")

    mine, theirs = _words(prediction), _words(reference)
    return _from_hits(df, common(mine, theirs), F.size(mine), F.size(theirs), key)


def rouge_l_sum(
    df: DataFrame,
    prediction: str = "prediction",
    reference: str = "reference",
    key: Key = "row_id",
) -> DataFrame:
    """ROUGE-Lsum of every row: subsequences per line, united over the prediction's lines."""

    @F.pandas_udf("long")
    def hits(p: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(
            [
                _summary_hits([list(s) for s in b], [list(s) for s in a])
                for a, b in zip(p, r)
            ],
            dtype="int64",
        )

    def lines(text: str) -> Column:
        # fixed value: sentences are the lines of a text
        return F.transform(F.split(_whole(text), "\n"), lambda line: words(line))

    mine, theirs = _words(prediction), _words(reference)
    return _from_hits(
        df, hits(lines(prediction), lines(reference)), F.size(mine), F.size(theirs), key
    )


def _from_hits(
    df: DataFrame, hits: Column, predicted: Column, referred: Column, key: Key
) -> DataFrame:
    names = key_names(key)
    counted = df.select(
        *names, hits.alias("hits"), predicted.alias("predicted"), referred.alias("referred")
    )
    return counted.select(
        *names,
        F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("hits", "referred"), F.lit(0.0)).alias("recall"),
        _f_measure(F.col("hits"), F.col("predicted"), F.col("referred")).alias("f"),
    )


ROUGE_KINDS = {
    "rouge1": lambda df, *names: rouge_n(df, 1, *names),
    "rouge2": lambda df, *names: rouge_n(df, 2, *names),
    "rougeL": rouge_l,
    "rougeLsum": rouge_l_sum,
}


def rouge(
    df: DataFrame,
    kinds: tuple[str, ...] = ("rouge1", "rouge2", "rougeL", "rougeLsum"),
    prediction: str = "prediction",
    reference: str = "reference",
    key: Key = "row_id",
) -> DataFrame:
    """Corpus ROUGE: the mean F of each kind, ``(kind, f, n)``."""
    parts = [
        ROUGE_KINDS[kind](df, prediction, reference, key)
        .agg(F.avg("f").alias("f"), F.count("*").alias("n"))
        .select(F.lit(kind).alias("kind"), "f", "n")
        for kind in kinds
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


REPLICATES = 200
_DRAWS = 1 << 32


def poisson_steps(most: int = 10) -> list[int]:
    """A uniform number below 2 to the 32 is a Poisson number with mean one: how many steps it reaches."""
    chance, total, steps = exp(-1), 0.0, []
    for k in range(most):
        total += chance
        steps.append(floor(total * _DRAWS))
        chance /= k + 1
    return steps


def bootstrap(
    scores: DataFrame, replicates: int = REPLICATES, value: str = "f", key: Key = "row_id", seed: int = 42
) -> DataFrame:
    """``(low, middle, high, n)`` of resampled means: the median and a 95 % interval.

    A row counts in a replicate as often as a Poisson number says that follows
    from its key and the replicate, so the result doesn't depend on how the rows are
    spread. Each task adds up its rows for all replicates, and only these sums move.
    """
    names = key_names(key)
    word = F.md5(F.concat_ws(":", F.lit(str(seed)), "_replicate", *[F.col(c).cast("string") for c in names]))
    number = F.conv(F.substring(word, 1, 8), 16, 10).cast("bigint")
    times = sum(((F.col("_number") >= step).cast("long") for step in poisson_steps()), F.lit(0).cast("long"))
    every = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_replicate")
    drawn = scores.select(*names, F.col(value).alias("_value"), every).withColumn("_number", number)
    sums = drawn.withColumn("_times", times).groupBy("_replicate").agg(
        F.try_divide(F.sum(F.col("_times") * F.col("_value")), F.sum("_times")).alias("mean"), F.count("*").alias("n")
    )
    # as many rows as there are replicates
    at = lambda share: F.percentile("mean", F.lit(share))
    return sums.agg(at(0.025).alias("low"), at(0.5).alias("middle"), at(0.975).alias("high"), F.max("n").alias("n"))


def rouge_bootstrap(
    df: DataFrame,
    kinds: tuple[str, ...] = ("rouge1", "rouge2", "rougeL", "rougeLsum"),
    replicates: int = REPLICATES,
    prediction: str = "prediction",
    reference: str = "reference",
    key: Key = "row_id",
    seed: int = 42,
) -> DataFrame:
    """Corpus ROUGE resampled: ``(kind, low, middle, high, n)`` of the mean F of each kind."""
    parts = [
        bootstrap(ROUGE_KINDS[kind](df, prediction, reference, key), replicates, "f", key, seed).select(
            F.lit(kind).alias("kind"), "low", "middle", "high", "n"
        )
        for kind in kinds
    ]
    return reduce(DataFrame.unionByName, parts)
