"""Scores of two runs side by side, and the divergence between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.keys import Key, key_names


def _once(df: DataFrame, *keys: str) -> DataFrame:
    """The rows; a repeated key is an error."""
    values = [c for c in df.columns if c not in keys]
    repeated = F.raise_error(F.lit(f"a key occurs twice: {list(keys)}"))
    rows = df.groupBy(*keys).agg(
        F.count("*").alias("_times"), *[F.first(v).alias(v) for v in values]
    )
    return rows.where(F.when(F.col("_times") == 1, True).otherwise(repeated)).select(*df.columns)


def _agree(ours: DataFrame, theirs: DataFrame, names: list[str], run: str) -> Column:
    """True if every run has as many keys as the reference, and the same ones; else an error."""
    keys = F.struct(
        F.count("*"), F.bit_xor(F.xxhash64(*[F.col(name).cast("string") for name in names]))
    )
    expected = theirs.agg(keys).scalar()
    said = F.concat(
        F.lit("run "), F.col(run).cast("string"), F.lit(" and the reference do not score the same rows")
    )
    same = F.when(F.col("keys") == expected, True).otherwise(F.raise_error(said))
    by_run = ours.groupBy(run).agg(keys.alias("keys"))
    return by_run.agg(F.coalesce(F.bool_and(same), F.lit(True))).scalar()


def pair_runs(
    policy: DataFrame,
    reference: DataFrame,
    key: Key = "row_id",
    *also: str,
    run: str | None = None,
    unmatched: str = "error",
) -> DataFrame:
    """Per row the policy's response and score, the reference's, and the uplift.

    With ``run``, the column that names the policy's runs, each run is paired with
    the whole reference. A key that occurs twice, in a run or in the reference, is an
    error. So is a row without counterpart, or it is left out with ``unmatched='drop'``.
    """
    if unmatched not in ("error", "drop"):
        raise ValueError(f"unmatched must be error or drop, not {unmatched!r}")
    names = key_names(key)
    runs = [] if run is None else [run]
    ours = _once(
        policy.select(
            *names,
            *dict.fromkeys([*runs, *also]),
            F.col("response").alias("response_best"),
            F.col("score").alias("score_best"),
        ),
        *names,
        *runs,
    )
    theirs = reference.select(
        *names, F.col("response").alias("response_ref"), F.col("score").alias("score_ref")
    )
    theirs = _once(theirs, *names)
    alone = F.raise_error(F.lit("a row without counterpart in the other run"))
    if unmatched == "drop":
        paired = ours.join(theirs, names)
    elif run is None:
        ours, theirs = ours.withColumn("_ours", F.lit(1)), theirs.withColumn("_theirs", F.lit(1))
        both = F.col("_ours").isNotNull() & F.col("_theirs").isNotNull()
        paired = ours.join(theirs, names, "full").where(F.when(both, True).otherwise(alone))
        paired = paired.drop("_ours", "_theirs")
    else:
        whole = _agree(policy.select(run, *names), reference.select(*names), names, run)
        found = F.when(F.col("_theirs"), True).otherwise(alone)
        paired = ours.join(theirs.withColumn("_theirs", F.lit(True)), names, "left").where(found & whole)
        paired = paired.drop("_theirs")
    return paired.withColumn("uplift", F.col("score_best") - F.col("score_ref"))


def align_scores(
    scores: DataFrame,
    reference: DataFrame,
    key: Key = "row_id",
    run: str = "run",
    score: str = "score",
    unmatched: str = "error",
) -> DataFrame:
    """``(run, key, p, q)``: each run's scores next to the reference's.

    A run must have the reference's keys, each once. Otherwise reading the
    result fails, or with ``unmatched='drop'`` it holds the shared keys only.
    """
    if unmatched not in ("error", "drop"):
        raise ValueError(f"unmatched must be error or drop, not {unmatched!r}")
    names = key_names(key)
    ours = scores.select(run, *names, F.col(score).cast("double").alias("p"))
    theirs = reference.select(*names, F.col(score).cast("double").alias("q"))
    if unmatched == "drop":
        rows = _once(ours, *names, run).join(_once(theirs, *names), names)
        return rows.select(run, *names, "p", "q")
    keys_agree = _agree(ours, theirs, names, run)
    missing = F.raise_error(F.lit("a score without counterpart in the reference"))
    found = F.when(F.col("_found"), True).otherwise(missing)
    return (
        ours.join(_once(theirs, *names).withColumn("_found", F.lit(True)), names, "left")
        .where(found & keys_agree)
        .select(run, *names, "p", "q")
    )


def _divergence(p: Column, q: Column) -> Column:
    nan = F.lit(float("nan"))
    infinite = F.lit(float("inf"))

    def unusable(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (x == infinite)

    p_sum, q_sum = F.sum(p), F.sum(q)
    negative = F.bool_or((p < 0) | (q < 0))
    term = (
        F.when(p == 0, F.lit(0.0)).when(q == 0, infinite).otherwise(p * (F.ln(p) - F.ln(q)))
    )
    return (
        F.when(negative, F.raise_error(F.lit("negative score in a divergence")))
        .when(F.bool_or(unusable(p) | unusable(q)), nan)
        .when((p_sum == 0) | (q_sum == 0), nan)
        .otherwise(F.try_divide(F.sum(term), p_sum) - (F.ln(p_sum) - F.ln(q_sum)))
    )


def kl_divergence(
    scores: DataFrame,
    reference: DataFrame,
    key: Key = "row_id",
    run: str = "run",
    score: str = "score",
    unmatched: str = "error",
) -> DataFrame:
    """KL(run || reference) per run, both score vectors scaled to sum 1, natural log.

    Many runs are compared with one reference in one join and one aggregate.
    p=0 adds nothing, p>0 with q=0 gives +inf; a null, NaN or infinite score or
    a zero sum gives NaN; a negative score is an error.
    """
    aligned = align_scores(scores, reference, key, run, score, unmatched)
    return aligned.groupBy(run).agg(
        _divergence(F.col("p"), F.col("q")).alias("kl"), F.count("*").alias("n")
    )
