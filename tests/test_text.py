"""Chat rendering, tokens, vocabulary, ROUGE."""

import os
import random
import re
from collections import Counter
from dataclasses import replace

import pytest
from conftest import task_failure
from pyspark.sql import functions as F

from duelframe.functions import (
    ChatTemplate,
    attention_mask,
    level_text,
    messages,
    ngrams,
    normalised,
    render_chat,
    run_key,
    truncate_pad,
    words,
)
from duelframe.operators import vocabulary
from duelframe.operators.rouge import ROUGE_KINDS
from duelframe.operators import Vocabulary, build_vocab, decode, encode, rouge_l, rouge_l_sum, rouge_n
from duelframe.operators.rouge import _common_length, _common_places


def first(df, column):
    return df.select(column.alias("x")).first().x


def test_render_chat(spark):
    df = spark.createDataFrame([("a post", "an answer")], "p string, a string")
    chat = messages(F.col("p"), F.col("a"))
    assert first(df, render_chat(chat)) == "user: a post\n\nassistant: an answer\n\n<|endoftext|>"
    plain = ChatTemplate(prefix=" ", suffix="", with_role=False, generation_prompt=" >")
    assert first(df, render_chat(chat, plain)) == " a post an answer<|endoftext|>"
    assert first(df, render_chat(messages(user=F.col("p")), plain, True)).endswith(
        "a post ><|endoftext|>"
    )
    renamed = ChatTemplate(role_names={"user": "human"}, eos="")
    assert first(df, render_chat(chat, renamed)).startswith("human: a post\n\nassistant: ")


def test_null_content_is_an_error(spark):
    df = spark.createDataFrame([(None,)], "p string")
    with task_failure("without role or content"):
        df.select(render_chat(messages(user=F.col("p")))).collect()


@pytest.mark.parametrize(
    "level, text, key",
    [
        (0.0, "0.0", "00"),
        (0.01, "0.01", "001"),
        (0.05, "0.05", "005"),
        (0.2, "0.2", "02"),
        (1.0, "1.0", "10"),
        (0.0001, "0.0001", "00001"),
        (10.0, "10.0", "100"),
    ],
)
def test_run_key(spark, level, text, key):
    df = spark.createDataFrame([(level,)], "level double")
    assert first(df, level_text(F.col("level"))) == text
    assert first(df, run_key(F.col("level"))) == key
    assert first(df, run_key(F.col("level"), F.lit("train_dpo"))) == f"train_dpo_{key}"


@pytest.mark.parametrize("side", ["left", "right"])
@pytest.mark.parametrize("n", [0, 2, 5, 8])
def test_padding(spark, n, side):
    ids = list(range(10, 10 + n))
    df = spark.createDataFrame([(ids,)], "ids array<int>")
    row = df.select(
        truncate_pad(F.col("ids"), 5, 2, side).alias("ids"),
        attention_mask(F.col("ids"), 5, side).alias("mask"),
    ).first()
    kept, gap = ids[:5], max(0, 5 - n)
    pad, zeros, ones = [2] * gap, [0] * gap, [1] * len(kept)
    assert row.ids == (pad + kept if side == "left" else kept + pad)
    assert row.mask == (zeros + ones if side == "left" else ones + zeros)


def test_ngrams(spark):
    df = spark.createDataFrame([("One two, THREE",), ("one",), ("",)], "t string")
    got = df.select(ngrams(words(F.col("t")), 2).alias("g")).collect()
    assert [r.g for r in got] == [["one two", "two three"], [], []]


CORPUS = ["the cat the dog", "The end -- the cat!", "", "é?!", "zebra <|endoftext|>"]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(enumerate(CORPUS)), "row_id long, text string")


def test_vocabulary_order_and_size(corpus):
    rows = build_vocab(corpus, "text").table.orderBy("token_id").collect()
    assert [(r.token, r.token_id, r.n) for r in rows] == [
        ("the", 3, 4),
        ("cat", 4, 2),
        ("dog", 5, 1),
        ("end", 6, 1),
        ("zebra", 7, 1),
    ]
    assert build_vocab(corpus, "text", size=2).table.count() == 2


@pytest.mark.parametrize("shipped", [0, 2, 50_000])
def test_encode_and_decode(corpus, shipped):
    vocab = Vocabulary(build_vocab(corpus, "text").table, shipped)
    ids = encode(corpus, vocab, {"text": "ids"})
    got = {r.row_id: r.ids for r in ids.collect()}
    assert got == {0: [3, 4, 3, 5], 1: [3, 6, 3, 4], 2: [], 3: [], 4: [7, 0]}
    back = decode(ids, vocab, {"ids": "back"})
    for r in back.select("back", normalised(F.col("text")).alias("normal")).collect():
        assert r.back == r.normal
    short = Vocabulary(build_vocab(corpus, "text", size=1).table, shipped)
    some = encode(corpus, short, {"text": "ids"})
    assert {r.row_id: r.ids for r in some.collect()}[0] == [3, 1, 3, 1]
    spelled = {r.row_id: r.back for r in decode(some, short, {"ids": "back"}).collect()}
    assert spelled[0] == "the <unk> the <unk>" and spelled[4] == "<unk> <|endoftext|>"
    words_only = decode(some, short, {"ids": "back"}, skip_special_tokens=True)
    assert {r.row_id: r.back for r in words_only.collect()}[4] == ""


def test_null_text_has_null_ids(spark, corpus):
    vocab = build_vocab(corpus, "text")
    df = spark.createDataFrame([(1, None), (2, "cat")], "row_id long, text string")
    for shipped in (0, 50_000):
        vocab = Vocabulary(vocab.table, shipped)
        out = encode(df, vocab, {"text": "ids"})
        out = decode(out, vocab, {"ids": "back"})
        assert {r.row_id: (r.ids, r.back) for r in out.collect()} == {
            1: (None, None),
            2: ([4], "cat"),
        }


def test_unknown_id_is_an_error(spark, corpus):
    vocab = build_vocab(corpus, "text")
    df = spark.createDataFrame([(1, [3, 99])], "row_id long, ids array<int>")
    for shipped in (0, 50_000):
        with task_failure("outside the vocabulary"):
            decode(df, Vocabulary(vocab.table, shipped), {"ids": "t"}).collect()


def test_all_words_come_back(spark):
    """More words than are shipped, very long ones, and counts that many words share."""
    rows = [(k, f"w{k} w{k % 7} " + "x" * (60 + k % 9)) for k in range(400)]
    df = spark.createDataFrame(rows, "row_id long, text string")
    vocab = build_vocab(df, "text")
    counts = Counter(w for _, t in rows for w in t.split())
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    got = vocab.table.orderBy("token_id").collect()
    assert [(r.token, r.token_id) for r in got] == [(w, k + 3) for k, w in enumerate(ranked)]
    small = Vocabulary(vocab.table, 50)
    back = decode(encode(df, small, {"text": "ids"}), small, {"ids": "back"})
    assert back.where("back <> text").count() == 0


@pytest.mark.parametrize("kind", ["rouge1", "rouge2", "rougeL", "rougeLsum"])
def test_null_texts_have_no_words_in_any_rouge(spark, kind):
    df = spark.createDataFrame(
        [(1, None, "a b"), (2, "a b", None), (3, None, None), (4, "a b", "a b")],
        "row_id long, prediction string, reference string",
    )
    got = {r.row_id: r.f for r in ROUGE_KINDS[kind](df, "prediction", "reference", "row_id").collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 0.0, 4: 1.0}


def test_vocabulary_survives_saving(spark, corpus, tmp_path):
    vocab = build_vocab(corpus, "text")
    vocab.save(str(tmp_path / "v"))
    again = Vocabulary.load(spark, str(tmp_path / "v"))
    assert sorted(again.table.collect()) == sorted(vocab.table.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- ROUGE against direct definitions ------------------------------------------------


def tokens(text):
    return re.findall("[a-z0-9]+", text.lower())


def table(a, b):
    """The plain common-subsequence table."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
    return t


def places(a, b):
    t, i, j, out = table(a, b), len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.add(i)
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def test_subsequences_match_the_plain_table():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
        assert _common_length(a, b) == table(a, b)[-1][-1]
        assert _common_places(a, b) == places(a, b)


def scores(hits, p, r):
    precision, recall = (hits / p if p else 0.0), (hits / r if r else 0.0)
    return precision, recall, (2 * hits / (p + r) if p + r else 0.0)


def brute(kind, prediction, reference):
    p, r = tokens(prediction), tokens(reference)
    if kind == "l":
        return scores(table(p, r)[-1][-1], len(p), len(r))
    if kind == "lsum":
        ps, rs = ([tokens(s) for s in x.split("\n")] for x in (prediction, reference))
        left_p, left_r, hits = Counter(p), Counter(r), 0
        for s in rs:
            for i in sorted(set().union(*[places(s, c) for c in ps])):
                if left_p[s[i]] and left_r[s[i]]:
                    hits += 1
                    left_p[s[i]] -= 1
                    left_r[s[i]] -= 1
        return scores(hits, len(p), len(r))
    grams = [Counter(tuple(x[i : i + kind]) for i in range(len(x) - kind + 1)) for x in (p, r)]
    return scores(sum((grams[0] & grams[1]).values()), *(sum(g.values()) for g in grams))


def test_rouge_matches_the_definitions(spark):
    rng = random.Random(2)

    def text():
        sentences = [
            " ".join(rng.choice(["a", "b", "C", "d,", "e"]) for _ in range(rng.randint(0, 6)))
            for _ in range(rng.randint(1, 3))
        ]
        return "\n".join(sentences)

    rows = [(i, text(), text()) for i in range(60)]
    rows += [(60, "", ""), (61, "one", "one"), (62, "", "one two"), (63, "one two", "")]
    df = spark.createDataFrame(rows, "row_id long, prediction string, reference string")
    kinds = {
        1: rouge_n(df, 1),
        2: rouge_n(df, 2),
        3: rouge_n(df, 3),
        "l": rouge_l(df),
        "lsum": rouge_l_sum(df),
    }
    for kind, out in kinds.items():
        got = {r.row_id: (r.precision, r.recall, r.f) for r in out.collect()}
        assert len(got) == len(rows)
        for row_id, prediction, reference in rows:
            assert got[row_id] == pytest.approx(brute(kind, prediction, reference)), kind
    assert {r.row_id: r.f for r in kinds[2].collect()}[61] == 0.0


@pytest.mark.parametrize("shipped", [0, 2, 1000])
def test_tokens_of_rows_with_repeated_and_missing_keys(spark, shipped):
    """Rows are told apart by the plan, not by a key of theirs; columns of any name stay."""
    rows = [(1, "rare one two", "b b"), (1, "other words here", None), (None, "null key words", "rare"), (None, "", "one"), (2, None, "two")]
    df = spark.createDataFrame(rows, "row_id int, a string, `_row` string").repartition(3)
    vocab = replace(build_vocab(df, "a", "_row"), shipped_words=shipped)
    assert vocab.complete == (shipped == 1000)
    numbers = {r.token: r.token_id for r in vocab.table.collect()}
    assert sorted(numbers.values()) == list(range(3, 3 + len(numbers)))
    ids = lambda t: None if t is None else [numbers[w] for w in t.split()]
    got = encode(df, vocab, {"a": "ids_a", "_row": "ids_b"})
    assert got.columns == ["row_id", "a", "_row", "ids_a", "ids_b"]
    key = lambda r: tuple(map(repr, r))
    want = sorted(((k, a, b, ids(a), ids(b)) for k, a, b in rows), key=key)
    assert sorted((tuple(r) for r in got.collect()), key=key) == want
    back = decode(got, vocab, {"ids_a": "a2", "ids_b": "b2"})
    assert all((r.a2, r.b2) == (r.a, r["_row"]) for r in back.collect())


def test_words_beyond_are_joined_once_for_neighbouring_rows(spark):
    """300 rows of the same words in one partition: two neighbourhoods, so each word is joined twice."""
    df = spark.createDataFrame([(k, "one two three") for k in range(300)], "row_id int, a string").coalesce(1)
    vocab = replace(build_vocab(df, "a"), shipped_words=0)
    got = encode(df, vocab, {"a": "ids"})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "FlatMapCoGroupsInArrow" in plan
    listed = got._jdf.queryExecution().analyzed().toString().count("Join LeftOuter")
    assert listed == 1
    back = decode(got, vocab, {"ids": "b"}).collect()
    assert sorted((r.row_id, r.b) for r in back) == [(k, "one two three") for k in range(300)]


def test_shipped_words_are_looked_up_in_one_pass(spark):
    df = spark.createDataFrame([(1, "a b", "c")], "row_id int, a string, b string")
    vocab = build_vocab(df, "a", "b")
    plan = encode(df, vocab, {"a": "x", "b": "y"})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan") == 1 and plan.count("ArrowEvalPython") == 1


def test_ranges_of_a_vocabulary_follow_one_another(spark):
    """Many ranges, many words as frequent as each other."""
    words = [f"w{k % 700}" for k in range(900)] + [f"v{k}" for k in range(500)] * 2
    df = spark.createDataFrame([(" ".join(words[k::7]),) for k in range(7)], "t string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        table = build_vocab(df, "t").table.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    n = Counter(words)
    want = {w: 3 + k for k, w in enumerate(sorted(n, key=lambda w: (-n[w], w)))}
    assert {r.token: r.token_id for r in table} == want and all(r.n == n[r.token] for r in table)
    assert build_vocab(df.limit(0), "t").table.count() == 0


def kept_files(df):
    return [f.removeprefix("file:") for f in df.inputFiles() if "looked-up" in f]


def test_words_beyond_take_little_disk(spark):
    """Rows are written packed, without columns that the result doesn't have; a word once for all neighbours."""
    rng = random.Random(3)
    made = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]
    rows = [(k, " ".join(rng.choice(made) for _ in range(500))) for k in range(600)]
    df = spark.createDataFrame(rows, "row_id int, a string").coalesce(1)
    vocab = replace(build_vocab(df, "a"), shipped_words=0)
    ids = encode(df, vocab, {"a": "ids"}, keep=["row_id"])
    back = decode(ids, vocab, {"ids": "b"}, keep=["row_id"])
    assert (ids.columns, back.columns) == (["row_id", "ids"], ["row_id", "b"])
    for made_of in (ids, back):
        written = sum(os.path.getsize(f) for f in kept_files(made_of))
        assert 0 < written < sum(len(t) for _, t in rows) / 3
    listed = spark.read.parquet(*kept_files(ids)).agg(F.sum(F.size("_open")).alias("n")).first().n
    assert listed == len({w for _, t in rows for w in t.split()})
    assert sorted((r.row_id, r.b) for r in back.collect()) == rows


@pytest.mark.parametrize("together, piece", [(1, 1), (7, 3), (1 << 21, 1 << 18)])
def test_blocks_of_any_size_give_the_same_rows(spark, monkeypatch, together, piece):
    """Rows with and without words beyond, without words, null; more than one column, columns of any type."""
    monkeypatch.setattr(vocabulary, "TOGETHER", together)
    monkeypatch.setattr(vocabulary, "PIECE", piece)
    texts = ["a b a", "a a", None, "", "rare a words", "b", "other rare things here and a b"]
    df = spark.range(len(texts) * 3).select(
        "id",
        F.array(*[F.lit(t) for t in texts])[(F.col("id") % len(texts)).cast("int")].alias("a.b"),
        F.when(F.col("id") % 2 == 0, "b z").alias("`c`"),
        F.timestamp_seconds("id").alias("at"),
        F.struct(F.lit(1).alias("x"), F.array(F.col("id").cast("decimal(9,2)")).alias("y")).alias("s"),
        F.create_map(F.lit("k"), F.lit(b"v")).alias("m"),
    )
    names = df.select(F.col("`a.b`").alias("x"), F.col("```c```").alias("y"), "*")
    shipped = replace(build_vocab(names, "x", "y"), shipped_words=2)
    shown = lambda d: sorted(map(repr, d.collect()))
    full = replace(shipped, shipped_words=50_000)
    got, want = encode(names, shipped, {"x": "i", "y": "j"}), encode(names, full, {"x": "i", "y": "j"})
    assert got.columns == want.columns and shown(got) == shown(want)
    back, whole = (decode(got, v, {"i": "p", "j": "q"}, keep=["x", "y", "a.b"]) for v in (shipped, full))
    assert back.columns == whole.columns == ["x", "y", "a.b", "p", "q"] and shown(back) == shown(whole)
    assert back.count() == df.count() and back.where("not (x <=> p and y <=> q)").count() == 0
