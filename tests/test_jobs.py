"""Sources, sinks, streams, models, and what the plans look like."""

import datetime as dt
import random

import pytest
from conftest import task_failure
from pyspark.sql import functions as F

from duelframe import sources
from duelframe.operators import (
    best_of_n,
    fit_linear_reward,
    flip_labels,
    kl_divergence,
    noise_sweep,
    rloo_advantage,
    rouge_n,
    sample_exact,
    score_responses,
)
from duelframe.operators.scoring import LinearReward, weights
from duelframe.plans import noise_vs_accuracy, prepare
from duelframe.schemas import BEST_OF, GAME_LOG, SCORES
from duelframe.session import fresh_path
from duelframe.streaming import append_closed, keep_latest, stream_reward_stats

AWKWARD = ['say "hi"', "two\nlines", "a, b", "  leading", "trailing \\", "é — ü", 'q"\n,"']


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_scores_survive_a_round_trip(spark, tmp_path, fmt):
    rows = [(i, text, text[::-1], i / 7) for i, text in enumerate(AWKWARD)]
    path = str(tmp_path / "scores")
    sources.write_scores(spark.createDataFrame(rows, SCORES), path, fmt)
    assert sorted(map(tuple, sources.read_scores(spark, path, fmt).collect())) == rows


def test_foreign_csv(spark, tmp_path):
    path = tmp_path / "foreign.csv"
    path.write_text(',query,response,score\n0,"a ""b""\nc",r,0.25\n1,,s,1e-3\n')
    rows = sources.read_scores(spark, str(path), "csv").orderBy("row_id").collect()
    assert [tuple(r) for r in rows] == [(0, 'a "b"\nc', "r", 0.25), (1, None, "s", 0.001)]
    path.write_text(",query,response,score\n0,q,r,high\n")
    with task_failure("CAST_INVALID_INPUT"):
        sources.read_scores(spark, str(path), "csv").collect()


def test_best_of_table(spark, tmp_path):
    rows = [(1, "q", "r1", 0.1, "r2", 0.2)]
    path = str(tmp_path / "best")
    sources.write_best_of(spark.createDataFrame(rows, BEST_OF), path, "csv")
    assert [tuple(r) for r in sources.read_scores(spark, path, "csv", BEST_OF).collect()] == rows
    with pytest.raises(ValueError):
        sources.write_best_of(spark.createDataFrame(rows, BEST_OF), path, "xml")


def test_snapshot_replaces_only_its_partitions(spark, comparisons, tmp_path):
    path = str(tmp_path / "orig")
    one = comparisons((1, "p", "a", "b", 0, "train"), (2, "p", "a", "b", 0, "validation"))
    sources.snapshot(one, path, "comparisons")
    sources.snapshot(comparisons((9, "p", "a", "b", 1, "train")), path, "axis")
    sources.snapshot(comparisons((3, "p", "a", "b", 1, "train")), path, "comparisons")
    rows = sources.read_comparisons(spark, f"{path}/type=comparisons")
    assert {r.row_id for r in rows.collect()} == {2, 3}
    assert rows.schema == one.schema
    train = sources.read_comparisons(spark, f"{path}/type=comparisons", split="train")
    assert "PartitionFilters: [isnotnull(split" in plan(train)
    assert [r.row_id for r in train.collect()] == [3]
    with pytest.raises(ValueError):
        sources.read_comparisons(spark, path, "avro")


def test_prompt_label_source(spark, tmp_path):
    path = str(tmp_path / "pl")
    df = spark.createDataFrame(
        [(1, "p", "l", "train"), (2, "p", "l", "valid")],
        "row_id long, prompt string, label string, split string",
    )
    df.write.json(path)
    assert sources.read_prompt_label(spark, path, "valid", "json").first().row_id == 2


def log_rows(n, days=3):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    return [
        (
            i // 4,
            start + dt.timedelta(minutes=i * days * 1440 / n),
            f"q{i}",
            "r",
            "ref",
            0.5,
            rng.random(),
            f"run{i % 2}",
        )
        for i in range(n)
    ]


def test_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame(log_rows(120), GAME_LOG)
    sources.append_game_log(df.where("step < 10"), path)
    latest, checkpoint = str(tmp_path / "latest"), str(tmp_path / "cp")

    def run():
        stream = stream_reward_stats(sources.stream_game_log(spark, path))
        keep_latest(stream, latest, checkpoint).awaitTermination()
        return spark.read.parquet(latest)

    def rounded(stats):
        rows = stats.collect()
        return sorted((r.window_start, r.run, round(r.reward_mean, 9), r.n) for r in rows)

    assert rounded(run()) == rounded(stream_reward_stats(sources.read_game_log(spark, path)))
    sources.append_game_log(df.where("step >= 10"), path)  # and goes on from its checkpoint
    assert rounded(run()) == rounded(stream_reward_stats(df))
    only = sources.read_game_log(spark, path, "run1")
    assert only.count() == 60

    closed = str(tmp_path / "closed")
    stream = stream_reward_stats(sources.stream_game_log(spark, path))
    append_closed(stream, closed, str(tmp_path / "cp2")).awaitTermination()
    done = rounded(spark.read.parquet(closed))
    whole = rounded(stream_reward_stats(df))
    assert 0 < len(done) < len(whole) and set(done) < set(whole)  # the last day is open


def test_streamed_log(spark, tmp_path):
    first, second = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame(log_rows(20), GAME_LOG)
    sources.append_game_log(df, first)
    stream = sources.stream_game_log(spark, first)
    sources.append_game_log(stream, second, str(tmp_path / "cp")).awaitTermination()
    assert sources.read_game_log(spark, second).count() == 20
    with pytest.raises(ValueError, match="checkpoint"):
        sources.append_game_log(stream, second)


def test_fresh_paths_lie_in_the_shared_folder(spark):
    one, two = fresh_path(spark, "x"), fresh_path(spark, "x")
    assert one != two and one.startswith(spark.conf.get("spark.checkpoint.dir") + "/")


def test_plug_in_scorer(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"))

    def factory():
        def scorer(texts):
            assert 0 < len(texts) <= 7
            return [len(t) for t in texts]

        return scorer

    out = score_responses(df, factory, batch_size=7)
    assert all(r.score == r.id for r in out.collect())


@pytest.fixture(scope="module")
def learnable(spark):
    """Answers with more "good" than "bad" words are preferred."""
    rng = random.Random(5)
    rows = []
    for i in range(240):
        good, bad = (
            " ".join(rng.choices([w, "the", "a", "of"], [5, 2, 2, 2], k=8)) for w in ("good", "bad")
        )
        choice = rng.randint(0, 1)
        texts = (bad, good) if choice else (good, bad)
        rows.append(
            (i, {"post": "p"}, [{"text": t} for t in texts], choice, "validation" if i % 4 == 0 else "train")
        )
    from duelframe.schemas import COMPARISONS

    return spark.createDataFrame(rows, COMPARISONS)


def test_linear_reward_learns(spark, learnable, tmp_path):
    pairs = prepare(learnable, "raw", strict_validation=False).where("split = 'train'").select(
        F.col("summaries.text")[F.col("choice")].alias("chosen"),
        F.col("summaries.text")[1 - F.col("choice")].alias("rejected"),
    )
    reward = fit_linear_reward(pairs, buckets=64, max_iter=20)
    both = reward.model.coefficients.toArray()
    assert both[:64] == pytest.approx(-both[64:], abs=1e-4)
    texts = spark.createDataFrame([("good good",), ("bad",), ("",)], "text string")
    score = {r.text: r.reward for r in reward.score(texts, "text", "reward").collect()}
    assert score["good good"] > 0 > score["bad"] and score[""] == 0
    reward.save(str(tmp_path / "m"))
    again = LinearReward.load(str(tmp_path / "m"))
    assert again.score(texts, "text", "reward").where("text = 'bad'").first().reward == score["bad"]
    assert weights(spark, reward).count() == 64


def test_pairs_are_dealt_by_the_length_of_their_texts(spark, monkeypatch):
    import duelframe.operators.scoring as scoring

    monkeypatch.setattr(scoring, "CHARACTERS", 1000)
    pairs = spark.range(300).selectExpr("concat('good ', id) AS a", "concat('bad w', id) AS b").coalesce(1)
    ways = scoring.both_ways(pairs, F.col("a"), F.col("b"), 64)
    counts = [r["count"] for r in ways.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 600 and len(counts) > 4 and max(counts) < 300


def test_noise_costs_accuracy(learnable):
    rows = noise_vs_accuracy(learnable, (0.0, 0.2, 1.0), buckets=64, max_iter=15).collect()
    by_level = {r.noise_level: r for r in rows}
    assert all(r.n == 60 for r in rows)
    assert by_level[0.0].accuracy > 0.9 and by_level[1.0].accuracy < 0.1
    assert by_level[0.0].loss < by_level[0.2].loss < by_level[1.0].loss


# --- plans ---------------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def outside_subqueries(df):
    """The main pass: the plan's lines that belong to no scalar subquery."""
    kept, below = [], None
    for line in plan(df).splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if below is not None and depth > below:
            continue
        below = None
        if line.lstrip(" :+-").startswith("Subquery"):
            below = depth
            continue
        kept.append(line)
    return "\n".join(kept)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Comparisons on disk, with fields that no task reads."""
    path = str(tmp_path_factory.mktemp("plans") / "c")
    spark.range(200).selectExpr(
        "id AS row_id",
        "named_struct('post', concat('p', id), 'title', 'unread') AS info",
        "array(named_struct('text', 'a', 'note', 'n'), named_struct('text', 'b', 'note', 'n'))"
        " AS summaries",
        "CAST(id % 2 AS INT) AS choice",
        "IF(id % 5 = 0, 'validation', 'train') AS split",
    ).write.partitionBy("split").parquet(path)
    return spark.read.parquet(path)


def test_noise_and_samples_move_no_rows(stored):
    for df in (
        flip_labels(stored, 0.2),
        noise_sweep(stored),
        sample_exact(stored, 50, "row_id"),
        prepare(stored, "dpo", validation_rows=10),
        prepare(stored, "kto", validation_rows=10),
    ):
        main = outside_subqueries(df)
        assert "Exchange" not in main and "Join" not in main and "Window" not in main
        assert "Python" not in plan(df) and "Arrow" not in plan(df)


def test_scans_read_what_the_task_needs(stored):
    main = outside_subqueries(prepare(stored, "dpo", validation_rows=10))
    assert "ReadSchema: struct<row_id:bigint,info:struct<post:string>,summaries:array<struct<text:string>>,choice:int>" in main
    hashing = plan(flip_labels(stored, 0.2).select("row_id", "noise_flipped"))
    assert "post" not in hashing and "summaries" not in hashing


def test_noise_counts_training_partitions_only(stored):
    assert "PartitionFilters: [isnotnull(split" in plan(flip_labels(stored, 0.2))


def test_encoding_moves_no_rows(stored):
    from duelframe.operators import build_vocab, encode

    vocab = build_vocab(stored.select(F.col("info.post").alias("t")), "t")
    df = encode(stored.select("row_id", F.col("info.post").alias("t")), vocab, {"t": "ids"})
    # all words are shipped, so nothing is joined
    assert "Exchange" not in plan(df) and "ArrowEvalPython" in plan(df)


def test_grams_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "a b", "b a")], "row_id long, prediction string, reference string")
    assert plan(rouge_n(df, 2)).count("Exchange") == 1


def test_grams_are_counted_within_their_row(spark):
    """No n-gram is a row of its own, so a task holds no table of them."""
    df = spark.createDataFrame([(1, "a b a b", "a b b a b"), (2, None, "a")], "row_id long, prediction string, reference string")
    rows = rouge_n(df, 2)
    assert "HashAggregate" not in plan(rows) and "Generate" not in plan(rows)
    assert {r.row_id: (r.precision, r.recall) for r in rows.collect()} == {1: (1.0, 0.75), 2: (0.0, 0.0)}


def test_groups_are_combined_before_the_shuffle(spark):
    df = spark.range(10).selectExpr(
        "'a' AS run", "id AS row_id", "1 AS cand", "'r' AS response", "0.5D AS score", "0.5D AS reward"
    )
    assert "partial_max" in plan(best_of_n(df))
    advantage = plan(rloo_advantage(df))
    assert "partial_sum" in advantage and "Window" not in advantage
    assert advantage.count("Join [") == 1 and "Hint" not in advantage
    kl = plan(kl_divergence(df, df.select("row_id", "score")))
    assert "partial_sum" in kl and "Python" not in kl and "CartesianProduct" not in kl
