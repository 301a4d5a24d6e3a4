"""Training tables."""

import pytest
from conftest import task_failure
from pyspark.sql import functions as F

from duelframe.operators import Noise, assemble_splits, build_vocab, pair_length_filter
from duelframe.plans import TASKS, prepare, register_task
from duelframe.plans.prepare import Settings, Task

LENIENT = {"strict_validation": False}


@pytest.fixture
def three(comparisons):
    return comparisons(
        (1, "post one", "first", "second words", 0, "train"),
        (2, "post two", "more", "", 1, "train"),
        (3, "post three", "x y", "z", 1, "validation"),
    )


@pytest.fixture
def vocab(three):
    return build_vocab(
        three.select(F.col("info.post").alias("p"), F.concat_ws(" ", "summaries.text").alias("s")),
        "p",
        "s",
    )


def by_id(df):
    return {r.row_id: r for r in df.collect()}


def test_dpo(three):
    rows = by_id(prepare(three, "dpo", **LENIENT))
    assert rows[1].asDict() == {
        "row_id": 1,
        "split": "train",
        "prompt": "post one",
        "chosen": "user: post one\n\nassistant: first\n\n<|endoftext|>",
        "rejected": "user: post one\n\nassistant: second words\n\n<|endoftext|>",
    }
    assert rows[3].chosen == "user: post three\n\nassistant: z\n\n<|endoftext|>"


def test_full_noise_swaps_training_pairs_only(three):
    clean, noised = (by_id(prepare(three, "dpo", noise=Noise(x), **LENIENT)) for x in (0.0, 1.0))
    for row_id in (1, 2):
        assert noised[row_id].chosen == clean[row_id].rejected
        assert noised[row_id].rejected == clean[row_id].chosen
    assert noised[3] == clean[3]


def test_kto(three):
    out = prepare(three, "kto", **LENIENT).orderBy("row_id", "ord").collect()
    assert len(out) == 6 and sum(r.label for r in out) == 3
    assert [(r.ord, r.label) for r in out[:2]] == [(0, True), (1, False)]
    assert out[0].prompt == "user: post one\n\n<|endoftext|>"
    assert out[0].completion == "assistant: first\n\n<|endoftext|>"
    assert out[1].completion == "assistant: second words\n\n<|endoftext|>"


def test_reward(three, vocab):
    settings = Settings(vocab=vocab, max_tokens=1, **LENIENT)
    rows = by_id(prepare(three, "reward", settings))
    assert set(rows) == {2}  # the other pairs have a side of two tokens
    assert rows[2].input_ids_chosen == [] and rows[2].attention_mask_chosen == []
    assert len(rows[2].input_ids_rejected) == 1 and rows[2].attention_mask_rejected == [1]
    assert set(by_id(prepare(three, "reward", vocab=vocab, **LENIENT))) == {1, 2, 3}


def test_prompts(three, vocab):
    ids = {r.token: r.token_id for r in vocab.table.collect()}
    rloo = by_id(prepare(three, "rloo", vocab=vocab, max_tokens=1, **LENIENT))
    # the role's name is no word of the corpus, the end mark is reserved
    assert rloo[1].input_ids == [1, ids["post"], ids["one"], 0] and rloo[1].lengths == 4
    assert set(by_id(prepare(three, "ppo", vocab=vocab, max_tokens=4, **LENIENT))) == {1, 2, 3}
    assert not by_id(prepare(three, "ppo", vocab=vocab, max_tokens=3, **LENIENT))
    query = by_id(prepare(three, "ppo_query", vocab=vocab))
    assert set(query) == {1, 2}
    assert query[1].query == "post one" and query[1].lengths == 2


def test_sampler_prompts(three, vocab):
    whole = by_id(prepare(three, "nsampler", vocab=vocab, **LENIENT))
    assert set(whole) == {3} and whole[3].query == "post three"
    cut = by_id(prepare(three, "nsampler", vocab=vocab, prompt_lengths=(1, 2), **LENIENT))
    assert cut[3].query == "post" and len(cut[3].input_ids) == 1


def test_sft(spark):
    df = spark.createDataFrame(
        [(1, "a b ", "c", "train"), (2, "a", "", "train"), (3, "b ", "b", "valid")],
        "row_id long, prompt string, label string, split string",
    )
    vocab = build_vocab(df, "prompt", "label")
    rows = by_id(prepare(df, "sft", vocab=vocab, lm_length=2))
    ids = {r.token: r.token_id for r in vocab.table.collect()}
    assert rows[1].input_ids == [ids["a"], ids["b"]] and rows[1].attention_mask == [1, 1]
    assert rows[2].input_ids == [ids["a"], 0] and rows[2].attention_mask == [1, 0]
    assert all(r.labels == r.input_ids for r in rows.values())
    masked = by_id(prepare(df, "sft", vocab=vocab, lm_length=2, mask_pad=True))
    assert masked[2].labels == [ids["a"], -100]
    assert len(by_id(prepare(df, "sft", vocab=vocab, validation_rows=0))) == 2


def test_raw_keeps_all_columns_and_tells_what_was_flipped(three):
    rows = prepare(three, "raw", noise=Noise(0.5), **LENIENT)
    assert rows.columns == [*three.columns, "noise_flipped"]
    assert rows.where("noise_flipped").count() == 1


def test_validation_head_in_preparation(comparisons):
    df = comparisons(
        *[(i, "p", "a", "b", 0, "train" if i % 2 else "validation") for i in range(20)]
    )
    out = prepare(df, "dpo", validation_rows=4)
    assert {r.row_id for r in out.where("split = 'validation'").collect()} == {0, 2, 4, 6}
    assert out.where("split = 'train'").count() == 10
    with task_failure("fewer than 11"):
        prepare(df, "dpo", validation_rows=11).collect()


BAD = [
    (1, None, "a", "b", 0, "train"),
    (1, "p", "a", "b", None, "train"),
    (1, "p", "a", "b", 2, "train"),
    (1, "p", "a", "b", -1, "train"),
    (1, "p", None, None, 0, "train"),
    (1, "p", "a", ..., 0, "train"),
    (1, "p", "a", None, 0, "train"),
]


@pytest.mark.parametrize("bad", BAD)
def test_bad_rows(comparisons, bad):
    df = comparisons(bad, (2, "p", "a", "b", 1, "train"))
    with task_failure("bad row: 1"):
        prepare(df, "dpo", **LENIENT).collect()
    kept = prepare(df, "dpo", on_bad_row="drop", noise=Noise(1.0), **LENIENT).collect()
    assert [r.row_id for r in kept] == [2]


def test_a_task_checks_what_it_reads(comparisons, vocab):
    df = comparisons((1, "p", "a", "b", None, "train"))
    assert prepare(df, "rloo", vocab=vocab, **LENIENT).count() == 1


def test_wrong_calls(three):
    with pytest.raises(ValueError, match="unknown task"):
        prepare(three, "ppo2")
    with pytest.raises(ValueError, match="needs a vocabulary"):
        prepare(three, "reward", **LENIENT)
    with pytest.raises(ValueError, match="on_bad_row"):
        prepare(three, "dpo", on_bad_row="ignore")
    with pytest.raises(ValueError, match="not both"):
        prepare(three, "dpo", Settings(), seed=3)
    with pytest.raises(ValueError, match="unknown noise type"):
        prepare(three, "dpo", noise=Noise(kind="other"), **LENIENT)


def test_registered_task(three):
    register_task("posts", Task(lambda df, s: df.select(s.key, "info.post"), reads_pair=False))
    try:
        assert by_id(prepare(three, "posts", **LENIENT))[1].post == "post one"
        with pytest.raises(ValueError, match="exists"):
            register_task("posts", TASKS["dpo"])
    finally:
        del TASKS["posts"]


def test_keys_for_rows_without_one(spark, monkeypatch):
    import duelframe.keys as keys

    monkeypatch.setattr(keys, "_RUN", 2)
    rows = [("a", 1)] * 5 + [("b", None), (None, None), ("a", 2)]
    df = spark.createDataFrame(rows, "`x.y` string, n int")
    got = keys.with_key(df).collect()
    assert sorted((tuple(r)[1:] for r in got), key=str) == sorted(rows, key=str)
    found = {r.row_id for r in got}
    assert len(found) == len(rows)
    again = keys.with_key(df.repartition(3)).collect()
    assert {r.row_id for r in again} == found
    assert keys.with_key(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="already"):
        keys.with_key(df, "n")


def test_equal_rows_are_written_out_by_many_tasks(spark, monkeypatch):
    import duelframe.keys as keys

    monkeypatch.setattr(keys, "_RUN", 50)
    monkeypatch.setattr(keys, "_ROWS", 100)
    keyed = keys.with_key(spark.range(2000).selectExpr("'a' AS x"))
    rows = keyed.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in rows) == keyed.select("row_id").distinct().count() == 2000
    assert len(rows) > 10 and max(r["count"] for r in rows) < 500


def test_keyed_source_keeps_its_validation_rows(spark):
    from duelframe.keys import with_key

    post = {"post": "p"}
    rows = [(post, [{"text": "a"}, {"text": "b"}], 0, s) for s in ("train", "validation") * 10]
    schema = "info struct<post: string>, summaries array<struct<text: string>>, choice int, split string"
    keyed = with_key(spark.createDataFrame(rows, schema))
    got = prepare(keyed, "dpo", noise=Noise(0.2), validation_rows=10).groupBy("split").count()
    assert {r.split: r["count"] for r in got.collect()} == {"train": 10, "validation": 10}


def test_pair_filter_bounds(spark):
    df = spark.createDataFrame(
        [(1, [0] * 128, [0]), (2, [0] * 129, [0]), (3, [0], [0] * 129)],
        "row_id long, a array<int>, b array<int>",
    )
    assert [r.row_id for r in pair_length_filter(df, "a", "b").collect()] == [1]


def test_assemble(spark):
    one, two = spark.range(2), spark.range(3)
    out = assemble_splits({"train": one, "validation": two})
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {
        "train": 2,
        "validation": 3,
    }


def test_keys_of_the_head(spark):
    from duelframe.operators import validation_head

    rows = lambda *keys: spark.createDataFrame([(k,) for k in keys], "row_id long")
    assert validation_head(rows(1, 1, 2, 3), "row_id", 3).count() == 3
    with task_failure("repeated key"):
        validation_head(rows(1, 2, 2, 2, 3), "row_id", 2).collect()
    with task_failure("null in key"):
        validation_head(rows(None, 1, 2), "row_id", 2).collect()


@pytest.mark.parametrize("noise", [0.0, 0.5])
def test_no_row_is_lost_without_a_word(comparisons, noise):
    """Null keys, null splits and unknown splits are errors; other names of validation are not."""
    good = [(k, "p", "a", "b", 1, "train") for k in range(4)]
    options = {"noise": Noise(noise), "strict_validation": False}
    for bad, message in (
        ((None, "p", "a", "b", 1, "validation"), "null in key"),
        ((9, "p", "a", "b", 1, None), "unknown split"),
        ((9, "p", "a", "b", 1, "test"), "unknown split"),
    ):
        with task_failure(message):
            prepare(comparisons(*good, bad), "dpo", **options).collect()
    held = comparisons(*good, (9, "p", "a", "b", 1, "valid"), (10, "p", "a", "b", 1, "test"))
    kept = prepare(held, "dpo", ignored_splits=("test",), **options).collect()
    assert sorted(r.row_id for r in kept) == [0, 1, 2, 3, 9]
    dropped = prepare(comparisons(*good, (None, "p", "a", "b", 1, "train")), "dpo", on_bad_row="drop", **options)
    assert dropped.count() == 4
