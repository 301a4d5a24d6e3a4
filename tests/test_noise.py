"""The rules of label noise, and exact samples."""

import hashlib
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from conftest import task_failure
from pyspark.sql import functions as F

from duelframe.defaults import NOISE_LEVELS as LEVELS
from duelframe.keys import hashed_int
from duelframe.operators import (
    Noise,
    add_noise,
    flip_labels,
    noise_sweep,
    sample_exact,
    validation_head,
)
from duelframe.operators.noise import noise_marks


def labelled(spark, n, held=0):
    """``n`` training rows and ``held`` validation rows with mixed labels."""
    return spark.range(n + held).select(
        F.col("id").alias("row_id"),
        (F.col("id") % 3 % 2).cast("int").alias("choice"),
        F.when(F.col("id") < n, "train").otherwise("validation").alias("split"),
    )


def flipped_ids(df):
    return {r.row_id for r in df.where("noise_flipped").select("row_id").collect()}


def expected_ids(n, k, seed=42):
    order = sorted(range(n), key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
    return set(order[:k])


@pytest.mark.parametrize("level", [0.0, 0.05, 0.29, 0.5, 1.0])
def test_exact_share_of_training_rows(spark, level):
    df = labelled(spark, 100, held=40)
    out = flip_labels(df, level)
    ids = flipped_ids(out)
    assert ids == expected_ids(100, math.floor(level * 100))
    before = {r.row_id: r.choice for r in df.collect()}
    for r in out.collect():
        assert r.choice == (1 - before[r.row_id] if r.row_id in ids else before[r.row_id])


def test_share_is_floored_in_double_precision(spark):
    assert flip_labels(labelled(spark, 100), 0.29).where("noise_flipped").count() == 28


@pytest.mark.parametrize("level", [-0.1, 1.1, float("nan")])
def test_level_out_of_range(spark, level):
    with pytest.raises(ValueError):
        flip_labels(labelled(spark, 10), level)
    with pytest.raises(ValueError):
        noise_sweep(labelled(spark, 10), [level])


def test_twice_restores_the_labels(spark):
    df = labelled(spark, 200, held=20)
    twice = flip_labels(flip_labels(df, 0.2), 0.2)
    assert sorted(twice.select("row_id", "choice").collect()) == sorted(
        df.select("row_id", "choice").collect()
    )


def test_levels_are_nested_and_agree_with_single_runs(spark):
    df = labelled(spark, 300, held=30)
    sweep = noise_sweep(df)
    sets = {level: flipped_ids(sweep.where(F.col("noise_level") == level)) for level in LEVELS}
    for low, high in zip(LEVELS, LEVELS[1:]):
        assert sets[low] < sets[high]
    for level in LEVELS:
        assert sets[level] == flipped_ids(flip_labels(df, level))
    assert sweep.count() == df.count() * len(LEVELS)
    marks = {r.row_id: r.flipped_at for r in noise_marks(df).collect()}
    for at, level in enumerate(LEVELS):
        assert {i for i, m in marks.items() if m[at]} == sets[level]


def test_set_depends_on_key_and_seed_only(spark):
    df = labelled(spark, 500)
    one = flipped_ids(flip_labels(df.coalesce(1).orderBy(F.desc("row_id")), 0.1))
    many = flipped_ids(flip_labels(df.repartition(7, "choice"), 0.1))
    assert one == many
    assert one != flipped_ids(flip_labels(df, 0.1, seed=43))


def test_counted_rows_may_differ_from_flipped_rows(spark):
    df = labelled(spark, 50)
    doubled = df.unionByName(df)
    out = flip_labels(doubled, 0.2, counted=df)
    assert out.where("noise_flipped").count() == 20
    assert flipped_ids(out) == expected_ids(50, 10)


def test_unknown_kind(spark):
    with pytest.raises(ValueError, match="unknown noise type"):
        add_noise(labelled(spark, 5), Noise(0.1, kind="shuffle_labels"))


def test_null_key_is_an_error(spark):
    df = spark.createDataFrame([(None, 1), (1, 0)], "row_id long, choice int")
    with task_failure("null in key"):
        flip_labels(df, 0.5, split=None).collect()


def test_empty_table(spark):
    assert flip_labels(labelled(spark, 0, held=3), 0.5).where("noise_flipped").count() == 0
    assert noise_sweep(labelled(spark, 0)).count() == 0


@settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(n=st.integers(1, 400), share=st.floats(0, 1), seed=st.integers(0, 1 << 20))
def test_sample_is_the_head_of_the_hash_order(spark, n, share, seed):
    k = int(share * n)
    got = {r.row_id for r in sample_exact(labelled(spark, n), k, "row_id", seed).collect()}
    assert got == expected_ids(n, k, seed)


def test_sample_with_several_key_columns(spark):
    df = spark.range(60).select((F.col("id") % 6).alias("a"), F.floor(F.col("id") / 6).alias("b"))
    got = {(r.a, r.b) for r in sample_exact(df, 17, ["a", "b"], 5).collect()}
    order = sorted(
        ((i % 6, i // 6) for i in range(60)),
        key=lambda k: (hashlib.md5(f"5:{k[0]}:{k[1]}".encode()).hexdigest(), k),
    )
    assert got == set(order[:17])


def test_repeated_keys(spark):
    """A repeated key is taken whole; a cut through it is an error, not a wrong size."""
    keys = [0] * 30 + list(range(1, 21))
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "row_id long, at int")
    order = sorted(keys, key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))
    start = order.index(0)
    for n in {start, start + 30, len(keys)} - {0}:
        assert sorted(r.row_id for r in sample_exact(df, n, "row_id").collect()) == sorted(order[:n])
    with task_failure("not unique"):
        sample_exact(df, start + 7, "row_id").collect()


@pytest.mark.parametrize("rows", [0, 9])
def test_sample_larger_than_the_table(spark, rows):
    with task_failure("smaller table"):
        sample_exact(labelled(spark, rows), 10, "row_id").collect()


def test_head(spark):
    df = labelled(spark, 50).repartition(5)
    assert {r.row_id for r in validation_head(df, "row_id", 8).collect()} == set(range(8))
    assert validation_head(df, "row_id", 80, strict=False).count() == 50
    with task_failure("fewer than 80"):
        validation_head(df, "row_id", 80).collect()
    with task_failure("fewer than 1"):
        validation_head(df.where("row_id < 0"), "row_id", 1).collect()


def test_sampled_lengths(spark):
    rows = spark.range(500).select("id", hashed_int("id", 42, 10, 25).alias("n")).collect()
    for r in rows:
        word = hashlib.md5(f"42:{r.id}".encode()).hexdigest()[:8]
        assert r.n == 10 + int(word, 16) % 15
    assert {r.n for r in rows} == set(range(10, 25))
    with pytest.raises(ValueError):
        hashed_int("id", 42, 5, 5)
