"""Best-of-n, statistics, divergence, objectives, frontier."""

import math
import statistics

import pytest
from conftest import task_failure
from pyspark.sql import functions as F

from duelframe.functions import activate, full_text
from duelframe.operators import (
    best_of_n,
    dpo_margin,
    frontier,
    kl_divergence,
    mean_reward,
    pair_runs,
    pairwise_accuracy,
    repeat_queries,
    reward_dist,
    reward_stats,
    reward_values,
    rloo_advantage,
    token_argmax,
)
from duelframe.plans import evaluate_candidates, evaluation_report, frontier_of_runs
from duelframe.plans.evaluate import candidate_requests

NAN, INF = float("nan"), float("inf")
CANDIDATES = "run string, row_id long, cand int, query string, response string, raw double"


def test_best_of_n(spark):
    df = spark.createDataFrame(
        [
            ("a", 1, 0, "q", "low", 0.1),
            ("a", 1, 1, "q", "tie first", 0.9),
            ("a", 1, 2, "q", "tie second", 0.9),
            ("a", 2, 0, "q", "number", 5.0),
            ("a", 2, 1, "q", "nan", NAN),
            ("b", 1, 3, "q", "alone", -1.0),
        ],
        CANDIDATES,
    ).withColumnRenamed("raw", "score")
    rows = {(r.run, r.row_id): r for r in best_of_n(df).collect()}
    assert rows["a", 1].response == "tie first" and rows["a", 1].cand == 1
    assert rows["a", 2].response == "nan" and math.isnan(rows["a", 2].score)
    assert rows["b", 1].score == -1.0 and len(rows) == 3


def test_evaluation(spark):
    df = spark.createDataFrame(
        [("a", i, c, f"q{i}", f"r{i}{c}", float(i - c)) for i in range(4) for c in range(3)],
        CANDIDATES,
    )
    best = evaluate_candidates(df)
    expected = [1 / (1 + math.exp(-i)) for i in range(4)]
    rows = sorted(best.collect(), key=lambda r: r.row_id)
    assert [r.response for r in rows] == ["r00", "r10", "r20", "r30"]
    assert [r.score for r in rows] == pytest.approx(expected)
    assert mean_reward(best).first().mean_reward == pytest.approx(statistics.mean(expected))

    scored = evaluate_candidates(df, lambda: lambda texts: [len(t) for t in texts], "none", True, 2)
    assert {r.score for r in scored.collect()} == {5.0}

    ref = df.where("cand = 2").select("row_id", "response", activate(F.col("raw")).alias("score"))
    pairs = {r.row_id: r for r in pair_runs(best, ref).collect()}
    assert pairs[3].uplift == pytest.approx(expected[3] - expected[1])
    assert pairs[3].response_ref == "r32" and pairs[3].response_best == "r30"
    report = evaluation_report(best, ref).first()
    assert report.n == 4
    assert report.mean_uplift == pytest.approx(report.mean_best - report.mean_ref)


def test_requests(spark):
    out = candidate_requests(spark.range(30).withColumnRenamed("id", "row_id"), 5, 4).collect()
    assert len(out) == 20 and len({r.row_id for r in out}) == 5
    assert {r.cand for r in out} == {0, 1, 2, 3}
    lengths = {(r.row_id, r.response_length) for r in out}
    assert len(lengths) == 5 and all(10 <= n < 25 for _, n in lengths)
    with pytest.raises(ValueError):
        repeat_queries(spark.range(1), 0)


def test_activation_and_text(spark):
    df = spark.createDataFrame([(0.0, "q", "r"), (2.0, "q", None)], "x double, q string, r string")
    rows = df.select(
        activate(F.col("x")).alias("s"),
        activate(F.col("x"), "none").alias("n"),
        full_text(F.col("q"), F.col("r")).alias("t"),
    ).collect()
    assert rows[0].s == 0.5 and rows[1].n == 2.0
    assert rows[0].t == "qr" and rows[1].t is None
    with pytest.raises(ValueError):
        activate(F.col("x"), "softmax")


def test_token_argmax(spark):
    df = spark.createDataFrame(
        [(1, 0, 5, 0.1), (1, 0, 7, 0.3), (1, 1, 9, 2.0), (1, 1, 4, 2.0)],
        "row_id long, pos int, token_id int, logit double",
    )
    assert {(r.pos, r.token_id) for r in token_argmax(df).collect()} == {(0, 7), (1, 4)}


def test_reward_statistics(spark):
    rows = [("a", 1, 0.5), ("a", 1, 1.5), ("a", 1, 1.5), ("a", 2, 3.0), ("b", 1, -1.0)]
    df = spark.createDataFrame(rows, "run string, step long, reward double")
    stats = {(r.run, r.step): r for r in reward_stats(df).collect()}
    assert stats["a", 1].reward_mean == pytest.approx(7 / 6) and stats["a", 1].n == 3
    assert stats["a", 1].reward_std == pytest.approx(statistics.stdev([0.5, 1.5, 1.5]))
    assert stats["a", 2].reward_std is None
    dist = {(r.run, r.bucket): r.n for r in reward_dist(df, 0.0, 2.0, 2, ("run",)).collect()}
    assert dist == {("a", 1): 1, ("a", 2): 2, ("a", 3): 1, ("b", 0): 1}
    values = {(r.run, r.step, r.reward): r.n for r in reward_values(df).collect()}
    assert values["a", 1, 1.5] == 2 and sum(values.values()) == 5


def kl(spark, p, q, **more):
    schema = "row_id long, score double"
    ours = spark.createDataFrame(list(enumerate(p)), schema).withColumn("run", F.lit("a"))
    return kl_divergence(ours, spark.createDataFrame(list(enumerate(q)), schema), **more).first().kl


def entropy(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    return sum(a * math.log(a / b) for a, b in zip(p, q) if a)


def test_kl_values(spark):
    p, q = [0.2, 0.5, 0.9, 0.1], [0.3, 0.3, 0.6, 0.7]
    assert kl(spark, p, q) == pytest.approx(entropy(p, q))
    assert kl(spark, p, p) == pytest.approx(0)
    assert kl(spark, [0.0, 0.5], [0.5, 0.5]) == pytest.approx(math.log(2))
    assert kl(spark, [0.5, 0.5], [0.0, 0.5]) == INF
    for bad in ([0.5, None], [0.5, NAN], [0.0, 0.0], [INF, 0.5]):
        assert math.isnan(kl(spark, bad, [0.5, 0.5]))
        assert math.isnan(kl(spark, [0.5, 0.5], bad))
    with task_failure("negative score"):
        kl(spark, [0.5, -0.5], [0.5, 0.5])


def test_kl_needs_the_same_rows(spark):
    with task_failure("do not score the same rows"):
        kl(spark, [0.5, 0.2, 0.1], [0.5, 0.5])
    with task_failure("do not score the same rows"):
        kl(spark, [0.5], [0.5, 0.5])
    schema = "run string, row_id long, score double"
    twice = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.5)], schema)
    other = spark.createDataFrame([("a", 1, 0.5), ("a", 3, 0.5)], schema)
    reference = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.5)], schema)
    for scores in (twice, other):
        with task_failure("do not score the same rows|without counterpart"):
            kl_divergence(scores, reference).collect()
    assert kl(spark, [0.5, 0.2, 0.1], [0.5, 0.2], unmatched="drop") == pytest.approx(0)
    with pytest.raises(ValueError):
        kl(spark, [1.0], [1.0], unmatched="outer")


def test_kl_of_many_runs(spark):
    schema = "run string, row_id long, score double"
    runs = {"a": [1.0, 2.0, 3.0], "b": [3.0, 2.0, 1.0]}
    rows = [(run, i, x) for run, xs in runs.items() for i, x in enumerate(xs)]
    reference = spark.createDataFrame([("r", i, 1.0) for i in range(3)], schema)
    got = {r.run: r.kl for r in kl_divergence(spark.createDataFrame(rows, schema), reference).collect()}
    for run, xs in runs.items():
        assert got[run] == pytest.approx(entropy(xs, [1.0] * 3))


def test_advantage(spark):
    rewards = {1: [1.0, 2.0, 6.0], 2: [5.0]}
    rows = [("a", i, c, x) for i, xs in rewards.items() for c, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "run string, row_id long, cand int, reward double")
    got = {(r.row_id, r.cand): r.advantage for r in rloo_advantage(df).collect()}
    assert got[2, 0] is None
    assert got[1, 0] == pytest.approx(1 - 4) and got[1, 2] == pytest.approx(6 - 1.5)
    assert sum(got[1, c] for c in range(3)) == pytest.approx(0)


def test_advantage_of_large_groups(spark):
    rows = [("a", 1, c, float(c)) for c in range(30)] + [
        ("a", 2, 0, 1.0),
        ("a", 2, 1, 4.0),
        (None, 1, 0, 2.0),
        (None, 1, 1, 3.0),
        ("b", 3, 0, None),
    ]
    df = spark.createDataFrame(rows, "run string, row_id long, cand int, reward double")
    out = rloo_advantage(df)
    assert out.columns == [*df.columns, "advantage"]
    got = {(r.run, r.row_id, r.cand): r.advantage for r in out.collect()}
    assert len(got) == len(rows)
    total = sum(range(30))
    for c in range(30):
        assert got["a", 1, c] == pytest.approx(c - (total - c) / 29)
    assert got["a", 2, 0] == pytest.approx(-3) and got[None, 1, 1] == pytest.approx(1)
    assert got["b", 3, 0] is None


def test_pairs_and_margins(spark):
    df = spark.createDataFrame(
        [(1.0, 0.0), (0.0, 2.0), (1.0, 1.0), (900.0, 0.0), (0.0, 900.0)],
        "score_chosen double, score_rejected double",
    )
    row = pairwise_accuracy(df).first()
    loss = [math.log1p(math.exp(-1)), math.log1p(math.exp(2)), math.log(2), 0.0, 900.0]
    assert (row.accuracy, row.n) == (pytest.approx(0.4), 5)
    assert row.loss == pytest.approx(statistics.mean(loss))
    lp = spark.createDataFrame(
        [(-1.0, -2.0, -1.5, -1.0)],
        "lp_chosen double, lp_rejected double, ref_chosen double, ref_rejected double",
    )
    out = dpo_margin(lp, beta=0.5).first()
    assert out.margin == pytest.approx(0.5 * (0.5 + 1.0)) and out.correct
    assert out.loss == pytest.approx(math.log1p(math.exp(-0.75)))


def test_frontier(spark):
    runs = [("a", 1.0, 0.1), ("b", 0.9, 0.2), ("c", 2.0, 0.2), ("d", 2.0, 0.3), ("e", 3.0, 0.5)]
    df = spark.createDataFrame(runs, "run string, mean_reward double, kl double")
    assert {r.run for r in frontier(df).collect()} == {"a", "c", "e"}


def test_frontier_of_runs(spark):
    schema = "run string, row_id long, score double"
    reference = spark.createDataFrame([("ref", i, 1.0) for i in range(4)], schema)
    rows = [("same", i, 1.0) for i in range(4)] + [("worse", i, 0.1 * (i + 1)) for i in range(4)]
    out = frontier_of_runs(spark.createDataFrame(rows, schema), reference).collect()
    assert [r.run for r in out] == ["same"]


def test_rows_without_counterpart_are_errors(spark):
    schema = "run string, row_id long, response string, score double"
    one = spark.createDataFrame([("a", 1, "x", 1.0), ("a", 2, "y", 2.0)], schema)
    for ours, theirs in ((one, one.where("row_id = 1")), (one.where("row_id = 1"), one)):
        with task_failure("without counterpart"):
            pair_runs(ours, theirs).collect()
        assert pair_runs(ours, theirs, unmatched="drop").count() == 1
    with task_failure("occurs twice"):
        kl_divergence(one, one.unionAll(one), unmatched="drop").collect()
