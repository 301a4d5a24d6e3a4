"""Pairing, positions, split CSV, retries, late rows, resampling, sketches and subtotals."""

import math
import random
import statistics
from collections import Counter

import pytest
from conftest import task_failure
from pyspark.sql import functions as F

from duelframe import sources
from duelframe.operators import (
    align_scores,
    bootstrap,
    merge_sketches,
    pair_runs,
    reward_sketches,
    sample_exact,
    sketch_quantiles,
    sweep_report,
    with_positions,
)
from duelframe.operators.rewards import RANK_ERROR
from duelframe.operators.rouge import poisson_steps
from duelframe.plans import evaluation_report
from duelframe.streaming import current, stream_reward_stats, upsert

SCORED = "run string, row_id int, response string, score double"


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


# --- pairing ---------------------------------------------------------------------------


def test_runs_are_paired_with_the_whole_reference(spark):
    reference = spark.createDataFrame([("r", k, f"r{k}", 1.0) for k in range(3)], SCORED)
    rows = [(run, k, f"{run}{k}", float(k)) for run in "ab" for k in range(3)]
    whole = spark.createDataFrame(rows, SCORED)
    got = {(r.run, r.row_id): (r.response_best, r.response_ref, r.uplift) for r in pair_runs(whole, reference, run="run").collect()}
    assert got == {(run, k): (f"{run}{k}", f"r{k}", k - 1.0) for run in "ab" for k in range(3)}
    assert {r.run: r.n for r in evaluation_report(whole, reference).collect()} == {"a": 3, "b": 3}
    less = spark.createDataFrame(rows[:-1], SCORED)  # run b without row 2
    with task_failure("run b and the reference"):
        evaluation_report(less, reference).collect()
    assert len(pair_runs(less, reference, run="run", unmatched="drop").collect()) == 5
    for again in (reference.union(reference.limit(1)), reference):
        ours = whole if again is not reference else whole.union(whole.where("row_id = 1"))
        with task_failure("occurs twice|do not score the same"):
            pair_runs(ours, again, run="run").collect()
    with task_failure("occurs twice"):
        pair_runs(whole.where("run = 'a'"), reference.union(reference), unmatched="drop").collect()


# --- positions -------------------------------------------------------------------------


def test_positions_are_those_of_the_lines(spark, tmp_path, small_splits):
    """Files of unlike size, split and packed into tasks in any way."""
    rng = random.Random(1)
    lines = [f"{k},{'x' * rng.randint(0, 60)}" for k in range(500)]
    at = 0
    for nth, n in enumerate((3, 0, 200, 1, 296)):
        (tmp_path / f"part-{nth:05d}.csv").write_text("".join(x + "\n" for x in ["id,t", *lines[at : at + n]]))
        at += n
    scan = spark.read.schema("id long, t string").option("header", True).csv(str(tmp_path))
    assert scan.rdd.getNumPartitions() > 20
    got = with_positions(scan)
    assert got.columns == ["id", "t", "position"]
    assert {(r.id, r.position) for r in got.collect()} == {(k, k) for k in range(500)}
    with pytest.raises(ValueError):
        with_positions(scan, "t")


def test_scores_are_aligned_by_place(spark, tmp_path, small_splits):
    rows = [(9 * k % 101, "q", "r", float(k)) for k in range(101)]
    df = spark.createDataFrame(rows, "row_id long, query string, response string, score double")
    sources.write_scores(df.coalesce(1).orderBy("score"), str(tmp_path / "a"), "csv")
    sources.write_scores(df.withColumn("score", F.col("score") * 2).repartitionByRange(4, "score").sortWithinPartitions("score"), str(tmp_path / "b"), "csv")
    ours, theirs = (with_positions(sources.read_scores(spark, str(tmp_path / p), "csv")) for p in "ab")
    got = align_scores(ours.withColumn("run", F.lit("x")), theirs, "position").collect()
    assert len(got) == 101 and all(r.q == 2 * r.p and r.p == r.position for r in got)


# --- quoted CSV in splits --------------------------------------------------------------


def test_quoted_records_are_those_of_one_task(spark, tmp_path, small_splits):
    rng = random.Random(3)
    bits = ['"', "\n", ",", "a", "bb ", "é", '""', "\n\n", '",\n"', "x" * 90]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(300)] + ["\n" * 900, '"' * 700]
    rows = [(k, t or None, "r" + (t[:3]), k / 7) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "row_id long, query string, response string, score double")
    path = str(tmp_path / "scores")
    sources.write_scores(df.repartition(3), path, "csv")
    one = Counter(map(tuple, sources.read_scores(spark, path, "csv").collect()))
    many = sources.read_scores(spark, path, "csv", splits=True)
    assert Counter(map(tuple, many.collect())) == one and sum(one.values()) == len(rows)
    assert spark.read.text(path).rdd.getNumPartitions() > 30
    sources.write_scores(df.limit(0), str(tmp_path / "none"), "csv")
    assert sources.read_scores(spark, str(tmp_path / "none"), "csv", splits=True).count() == 0


# --- retries ---------------------------------------------------------------------------


def _log(spark, *rows):
    made = [(step, ts, f"q{step}", "r", "f", 0.0, reward, run) for step, ts, reward, run in rows]
    kinds = "step long, ts string, query string, response string, ref_response string, ref_reward double, reward double, run string"
    return spark.createDataFrame(made, kinds).withColumn("ts", F.col("ts").cast("timestamp"))


def test_a_retried_step_is_in_the_log_once(spark, tmp_path):
    path = str(tmp_path / "log")
    first = _log(spark, (1, "2024-01-01", 1.0, "a"), (1, "2024-01-01", 1.0, "a"), (1, "2024-01-01", 2.0, "b"))
    second = _log(spark, (2, "2024-01-02", 3.0, "a"))
    for batch, rows in (("1", first), ("2", second), ("1", first), ("2", second)):
        sources.append_game_log(rows, path, batch=batch)
    got = Counter((r.run, r.step, r.reward) for r in sources.read_game_log(spark, path).collect())
    assert got == {("a", 1, 1.0): 2, ("b", 1, 2.0): 1, ("a", 2, 3.0): 1}
    assert sources.read_game_log(spark, path, "b").count() == 1
    with pytest.raises(ValueError):
        sources.append_game_log(second, path, batch="")


# --- late rows -------------------------------------------------------------------------


def test_late_rows_correct_earlier_versions(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / x) for x in ("log", "out", "checkpoint"))
    steps = [
        [(1, "2024-01-01 01:00", 1.0, "a"), (1, "2024-01-01 02:00", 3.0, "b")],
        [(2, "2024-01-02 00:10", 5.0, "a")],
        [(3, "2024-01-01 23:30", 9.0, "a"), (3, "2024-01-02 03:00", 7.0, "a")],  # late, within the watermark
    ]
    schema = _log(spark, *steps[0]).schema
    rows = []
    for k, step in enumerate(steps):
        _log(spark, *step).coalesce(1).write.mode("append").parquet(path)
        rows += step
        stats = stream_reward_stats(spark.readStream.schema(schema).parquet(path), late="2 hours")
        upsert(stats, out, checkpoint).awaitTermination()
        want = stream_reward_stats(_log(spark, *rows))
        key = lambda r: (r.window_start, r.run, round(r.reward_mean, 9), r.reward_std and round(r.reward_std, 9), r.n)
        assert Counter(map(key, current(spark, out).collect())) == Counter(map(key, want.collect()))
    versions = sorted({r.version for r in spark.read.parquet(out).select("version").collect()})
    assert len(versions) >= 3
    before = {r.run: r.n for r in current(spark, out, versions[0]).collect()}
    assert before == {"a": 1, "b": 1}


# --- resampling ------------------------------------------------------------------------


def test_poisson_numbers():
    steps = poisson_steps()
    chances = [steps[0], *(b - a for a, b in zip(steps, steps[1:], strict=False))]
    for k, n in enumerate(chances):
        assert n / 2**32 == pytest.approx(math.exp(-1) / math.factorial(k), abs=1e-8)


def test_resampled_means(spark):
    rng = random.Random(2)
    values = [(k, rng.random()) for k in range(400)]
    df = spark.createDataFrame(values, "row_id long, f double")
    got = bootstrap(df.repartition(7), 300).first()
    again = bootstrap(df.coalesce(1), 300).first()
    assert tuple(got) == pytest.approx(tuple(again)) and got.n == 400
    mean, error = statistics.mean(v for _, v in values), statistics.stdev(v for _, v in values) / 20
    assert got.middle == pytest.approx(mean, abs=error / 2)
    assert (got.high - got.low) / (2 * 1.96 * error) == pytest.approx(1, abs=0.25)
    assert bootstrap(df.limit(0), 10).first().middle is None


# --- sketches --------------------------------------------------------------------------


def test_sketches_of_steps_merge_to_those_of_runs(spark):
    rng = random.Random(4)
    rows = [(run, k % 40, rng.gauss(0, 1) if run == "a" else rng.random() ** 8) for run in "ab" for k in range(20_000)]
    rows += [("c", 0, None), ("c", 0, float("nan")), ("d", 0, 5.0)]
    df = spark.createDataFrame(rows, "run string, step int, reward double")
    sketches = reward_sketches(df)
    shares = (0.01, 0.25, 0.5, 0.9, 0.99)
    for found in (sketch_quantiles(merge_sketches(sketches), shares), sketch_quantiles(reward_sketches(df, ("run",)), shares)):
        got = {(r.run, r.share): (r.n, r.value) for r in found.collect()}
        assert {run for run, _ in got} == {"a", "b", "d"} and got["d", 0.5] == (1, 5.0)
        for run in "ab":
            values = sorted(v for r, _, v in rows if r == run)
            for share in shares:
                n, value = got[run, share]
                rank = sum(v <= value for v in values) / len(values)
                assert n == 20_000 and abs(rank - share) <= RANK_ERROR + 1e-4


# --- subtotals and shares --------------------------------------------------------------


def test_a_sweep_has_subtotals(spark):
    rows = [("dpo_00", 1.0), ("dpo_02", 2.0), ("dpo_02", 4.0), ("my_ppo_001", 6.0), ("plain", 7.0), ("plain", None)]
    got = {(r.method, r.level, r.subtotal): (r["mean"], r.n) for r in sweep_report(spark.createDataFrame(rows, "run string, score double")).collect()}
    assert got == {
        ("dpo", 0.0, 0): (1.0, 1), ("dpo", 0.2, 0): (3.0, 2), ("dpo", None, 1): (pytest.approx(7 / 3), 3),
        ("my_ppo", 0.01, 0): (6.0, 1), ("my_ppo", None, 1): (6.0, 1),
        ("plain", None, 0): (7.0, 1), ("plain", None, 1): (7.0, 1), (None, None, 3): (4.0, 5),
    }


def test_a_share_of_the_rows(spark):
    df = spark.range(205).withColumnRenamed("id", "row_id")
    some = sample_exact(df, 0.1, "row_id")
    assert some.count() == 20
    assert sorted(some.collect()) == sorted(sample_exact(df, 20, "row_id").collect())
    assert sample_exact(df.limit(3), 0.1, "row_id").count() == 0
