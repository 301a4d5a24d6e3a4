"""The query catalogue: every operator over the given tables.

``QUERIES`` maps a name to a function of (spark, folder of the tables); ``SQL``
holds, for all but the operators SQL has no words for, a query with the same
rows. Float aggregates are rounded on both sides, as engines add in different
orders; arrays are shown joined.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe import sources
from duelframe.defaults import NOISE_LEVELS
from duelframe.functions import (
    attention_mask,
    cut,
    full_text,
    messages,
    render_chat,
    run_key,
    truncate_pad,
    words,
)
from duelframe.functions.tokens import WORD_OR_EOS
from duelframe.keys import hashed_int, with_key
from duelframe.operators import (
    Noise,
    add_noise,
    align_scores,
    assemble_splits,
    best_of_n,
    decode,
    dpo_margin,
    encode,
    fit_linear_reward,
    flip_labels,
    kl_divergence,
    mean_reward,
    merge_sketches,
    noise_sweep,
    pair_length_filter,
    pair_runs,
    pairwise_accuracy,
    prompt_length_filter,
    repeat_queries,
    reward_dist,
    reward_sketches,
    reward_stats,
    reward_values,
    rloo_advantage,
    rouge,
    rouge_bootstrap,
    rouge_l,
    rouge_l_sum,
    rouge_n,
    sample_exact,
    score_responses,
    sketch_quantiles,
    sweep_report,
    token_argmax,
    validation_head,
    with_positions,
)
from duelframe.operators.batches import batch_map
from duelframe.operators.rewards import RANK_ERROR
from duelframe.operators.rouge import poisson_steps
from duelframe.operators.scoring import weights
from duelframe.plans import (
    evaluate_candidates,
    evaluation_report,
    frontier_of_runs,
    noise_vs_accuracy,
    prepare,
    register_task,
)
from duelframe.plans.evaluate import candidate_requests
from duelframe.plans.prepare import TASKS, Settings, Task
from duelframe.schemas import BEST_OF
from duelframe.session import fresh_path, kept
from duelframe.streaming import append_closed, current, keep_latest, stream_reward_stats, upsert
from workloads import inputs as t
from workloads.inputs import (
    CANDIDATES_SQL,
    COMPARISONS_SQL,
    GAME_LOG_SQL,
    NOISE_RUNS_SQL,
    PAIRS_SQL,
    PROMPT_LABEL_SQL,
    USER_SCORES_SQL,
    VERDICT_KEY,
    VERDICTS_SQL,
    VOCAB_SQL,
    decode_sql,
    encode_sql,
    hashed_sql,
    noised_sql,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def shown(array: str | Column) -> Column:
    column = F.col(array) if isinstance(array, str) else array
    return F.array_join(column.cast("array<string>"), ",")


def shown_sql(array: str) -> str:
    return f"coalesce(array_to_string({array}, ','), '')"


# --- noise and sampling --------------------------------------------------------------

_KEYS = ", ".join(VERDICT_KEY)


def _flipped_sql(level: str) -> str:
    return f"""split = 'train' AND nth <= floor(CAST({level} AS DOUBLE) * c)"""


def _flip_query(level: float) -> None:
    flipped = _flipped_sql(str(level))

    @query(
        f"flip_labels_{round(level * 100):03d}",
        f"""WITH {VERDICTS_SQL}
        SELECT {_KEYS}, split, {flipped} AS noise_flipped,
               CASE WHEN {flipped} THEN 1 - choice ELSE choice END AS choice
        FROM verdict_order, train_size""",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flip_labels(t.verdicts(spark, sf_dir), level, VERDICT_KEY)


for _level in (0.01, 0.05, 0.1, 0.2):
    _flip_query(_level)


@query(
    "add_noise",
    f"""WITH {VERDICTS_SQL}
    SELECT split, {_flipped_sql("0.29")} AS noise_flipped, count(*) AS n,
           CAST(sum(CASE WHEN {_flipped_sql("0.29")} THEN 1 - choice ELSE choice END) AS BIGINT)
             AS ones
    FROM verdict_order, train_size GROUP BY 1, 2""",
)
def _add_noise(spark, sf_dir):
    noised = add_noise(t.verdicts(spark, sf_dir), Noise(0.29), VERDICT_KEY)
    return noised.groupBy("split", "noise_flipped").agg(
        F.count("*").alias("n"), F.sum("choice").alias("ones")
    )


@query(
    "noise_sweep",
    f"""WITH {VERDICTS_SQL}
    SELECT noise_level, {_KEYS}, split, {_flipped_sql("noise_level")} AS noise_flipped,
           CASE WHEN {_flipped_sql("noise_level")} THEN 1 - choice ELSE choice END AS choice
    FROM verdict_order, train_size,
         (SELECT CAST(unnest([{", ".join(map(str, NOISE_LEVELS))}]) AS DOUBLE) AS noise_level)""",
)
def _noise_sweep(spark, sf_dir):
    return noise_sweep(t.verdicts(spark, sf_dir), NOISE_LEVELS, VERDICT_KEY)


@query(
    "sample_exact",
    f"""WITH {VERDICTS_SQL}
    SELECT {_KEYS}, choice, split FROM verdicts
    ORDER BY md5({t._VERDICT_TEXT}), {_KEYS} LIMIT 2000""",
)
def _sample_exact(spark, sf_dir):
    return sample_exact(t.verdicts(spark, sf_dir), 2000, VERDICT_KEY)


@query(
    "validation_head",
    f"""WITH {VERDICTS_SQL}
    SELECT {_KEYS}, choice, split FROM verdicts WHERE split = 'validation'
    ORDER BY {_KEYS} LIMIT 2000""",
)
def _validation_head(spark, sf_dir):
    held = t.verdicts(spark, sf_dir).where("split = 'validation'")
    return validation_head(held, VERDICT_KEY)


@query(
    "sample_length",
    f"SELECT doc_id, {hashed_sql('doc_id', 42, 50, 128)} AS size FROM documents",
)
def _sample_length(spark, sf_dir):
    return t.table(spark, sf_dir, "documents").select(
        "doc_id", hashed_int("doc_id", 42, 50, 128).alias("size")
    )


@query(
    "repeat_queries",
    """SELECT conv_id, turn, text AS query, CAST(cand AS INTEGER) AS cand
    FROM conversations, (SELECT unnest(range(4)) AS cand) WHERE role = 'user'""",
)
def _repeat_queries(spark, sf_dir):
    asked = t.table(spark, sf_dir, "conversations").where("role = 'user'")
    return repeat_queries(asked.select("conv_id", "turn", F.col("text").alias("query")), 4)


@query(
    "candidate_requests",
    f"""SELECT conv_id, turn, text AS query, CAST(cand AS INTEGER) AS cand,
           {hashed_sql("conv_id || ':' || turn", 42, 10, 25)} AS response_length
    FROM (SELECT *, row_number() OVER (
                   ORDER BY md5('42:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)),
                            conv_id, turn) AS nth, count(*) OVER () AS asked
          FROM conversations WHERE role = 'user'),
         (SELECT unnest(range(4)) AS cand)
    WHERE nth <= floor(CAST({t.SHARE} AS DOUBLE) * asked)""",
)
def _candidate_requests(spark, sf_dir):
    asked = t.table(spark, sf_dir, "conversations").where("role = 'user'")
    return candidate_requests(
        asked.select("conv_id", "turn", F.col("text").alias("query")), t.SHARE, 4, ["conv_id", "turn"]
    )


# --- training tables -----------------------------------------------------------------


def _prepared(spark, sf_dir, task, level=0.2, vocab=False, head=t.HEAD, **more):
    settings = Settings(
        noise=Noise(level),
        validation_rows=head,
        strict_validation=head == t.STRICT_HEAD,
        vocab=t.vocabulary(spark, sf_dir) if vocab else None,
        **more,
    )
    return prepare(t.comparisons(spark, sf_dir), task, settings)


EOS = "<|endoftext|>"


def _rendered_sql(*turns: tuple[str, str]) -> str:
    parts = [f"'{role}: ' || {text} || E'\\n\\n'" for role, text in turns]
    return " || ".join([*parts, f"'{EOS}'"])


@query(
    "prepare_raw",
    f"""WITH {noised_sql(0.2)}
    SELECT row_id, split, post, chosen, rejected, choice, noise_flipped FROM picked""",
)
def _prepare_raw(spark, sf_dir):
    from duelframe.functions import chosen_text, post_text, rejected_text

    return _prepared(spark, sf_dir, "raw").select(
        "row_id",
        "split",
        post_text().alias("post"),
        chosen_text().alias("chosen"),
        rejected_text().alias("rejected"),
        "choice",
        "noise_flipped",
    )


@query(
    "prepare_dpo",
    f"""WITH {noised_sql(0.2)}
    SELECT row_id, split, post AS prompt,
           {_rendered_sql(("user", "post"), ("assistant", "chosen"))} AS chosen,
           {_rendered_sql(("user", "post"), ("assistant", "rejected"))} AS rejected
    FROM picked""",
)
def _prepare_dpo(spark, sf_dir):
    return _prepared(spark, sf_dir, "dpo")


@query(
    "prepare_dpo_strict_head",
    f"""WITH {noised_sql(0.2, t.STRICT_HEAD)}
    SELECT row_id, split, post AS prompt,
           {_rendered_sql(("user", "post"), ("assistant", "chosen"))} AS chosen,
           {_rendered_sql(("user", "post"), ("assistant", "rejected"))} AS rejected
    FROM picked""",
)
def _prepare_dpo_strict_head(spark, sf_dir):
    return _prepared(spark, sf_dir, "dpo", head=t.STRICT_HEAD)


@query(
    "prepare_kto",
    f"""WITH {noised_sql(0.2)}
    SELECT row_id, split, CAST(0 AS INTEGER) AS ord, {_rendered_sql(("user", "post"))} AS prompt,
           {_rendered_sql(("assistant", "chosen"))} AS completion, true AS label FROM picked
    UNION ALL
    SELECT row_id, split, CAST(1 AS INTEGER), {_rendered_sql(("user", "post"))},
           {_rendered_sql(("assistant", "rejected"))}, false FROM picked""",
)
def _prepare_kto(spark, sf_dir):
    return _prepared(spark, sf_dir, "kto")


def _mask_sql(ids: str) -> str:
    return shown_sql(f"list_transform({ids}, lambda x: 1)")


@query(
    "prepare_reward",
    f"""WITH {noised_sql(0.2)}, {VOCAB_SQL},
    {encode_sql("c", "picked", "row_id", "chosen", "ids_c")},
    {encode_sql("r", "picked", "row_id", "rejected", "ids_r")}
    SELECT row_id, split, {shown_sql("ids_c")} AS input_ids_chosen,
           {_mask_sql("ids_c")} AS attention_mask_chosen,
           {shown_sql("ids_r")} AS input_ids_rejected,
           {_mask_sql("ids_r")} AS attention_mask_rejected
    FROM picked JOIN c USING (row_id) JOIN r USING (row_id)
    WHERE len(ids_c) <= 128 AND len(ids_r) <= 128""",
)
def _prepare_reward(spark, sf_dir):
    rows = _prepared(spark, sf_dir, "reward", vocab=True)
    arrays = [f"{a}_{side}" for side in ("chosen", "rejected") for a in ("input_ids", "attention_mask")]
    return rows.select("row_id", "split", *[shown(a).alias(a) for a in arrays])


def _prompt_ids_sql(where: str = "") -> str:
    return f"""WITH {noised_sql(0.0)}, {VOCAB_SQL},
    rendered AS (SELECT row_id, split, {_rendered_sql(("user", "post"))} AS prompt FROM picked),
    {encode_sql("e", "rendered", "row_id", "prompt", "ids")}
    SELECT row_id, split, {shown_sql("ids")} AS input_ids, CAST(len(ids) AS INTEGER) AS lengths
    FROM rendered JOIN e USING (row_id) {where}"""


@query("prepare_ppo", _prompt_ids_sql("WHERE len(ids) <= 128"))
def _prepare_ppo(spark, sf_dir):
    rows = _prepared(spark, sf_dir, "ppo", 0.0, vocab=True)
    return rows.withColumn("input_ids", shown("input_ids"))


@query("prepare_rloo", _prompt_ids_sql())
def _prepare_rloo(spark, sf_dir):
    rows = _prepared(spark, sf_dir, "rloo", 0.0, vocab=True)
    return rows.withColumn("input_ids", shown("input_ids"))


@query(
    "prepare_ppo_query",
    f"""WITH {COMPARISONS_SQL}, {VOCAB_SQL},
    trained AS (SELECT * FROM comparisons WHERE split = 'train'),
    {encode_sql("e", "trained", "row_id", "post", "ids")},
    {decode_sql("d", "e", "row_id", "ids", "query")}
    SELECT row_id, split, {shown_sql("ids")} AS input_ids, query,
           CAST(len(ids) AS INTEGER) AS lengths
    FROM trained JOIN e USING (row_id) JOIN d USING (row_id)""",
)
def _prepare_ppo_query(spark, sf_dir):
    rows = _prepared(spark, sf_dir, "ppo_query", 0.0, vocab=True)
    return rows.withColumn("input_ids", shown("input_ids"))


@query(
    "prepare_nsampler",
    f"""WITH {noised_sql(0.0)}, {VOCAB_SQL},
    held AS (SELECT row_id, split, post FROM headed WHERE split = 'validation'),
    {encode_sql("e", "held", "row_id", "post", "ids")},
    cut_ids AS (
      SELECT row_id, list_slice(ids, 1, {hashed_sql("row_id", 42, 50, 128)}) AS ids FROM e),
    {decode_sql("d", "cut_ids", "row_id", "ids", "query")}
    SELECT row_id, split, {shown_sql("ids")} AS input_ids, query
    FROM held JOIN cut_ids USING (row_id) JOIN d USING (row_id)""",
)
def _prepare_nsampler(spark, sf_dir):
    rows = _prepared(spark, sf_dir, "nsampler", 0.0, vocab=True, prompt_lengths=(50, 128))
    return rows.withColumn("input_ids", shown("input_ids"))


def _padded_sql(ids: str, n: int) -> str:
    return (
        f"list_concat(list_slice({ids}, 1, {n}),"
        f" list_transform(range(greatest({n} - len({ids}), 0)), lambda x: 0))"
    )


def _padded_mask_sql(ids: str, n: int) -> str:
    return (
        f"list_concat(list_transform(range(least(len({ids}), {n})), lambda x: 1),"
        f" list_transform(range(greatest({n} - len({ids}), 0)), lambda x: 0))"
    )


@query(
    "prepare_sft",
    f"""WITH {PROMPT_LABEL_SQL}, {VOCAB_SQL},
    headed AS (
      SELECT row_id, split, prompt || label AS text
      FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY row_id) AS nth
            FROM prompt_label)
      WHERE split = 'train' OR nth <= {t.HEAD}),
    {encode_sql("e", "headed", "row_id", "text", "ids")}
    SELECT row_id, split, {shown_sql(_padded_sql("ids", 550))} AS input_ids,
           {shown_sql(_padded_mask_sql("ids", 550))} AS attention_mask,
           {shown_sql(_padded_sql("ids", 550))} AS labels
    FROM headed JOIN e USING (row_id)""",
)
def _prepare_sft(spark, sf_dir):
    rows = prepare(
        t.prompt_label(spark, sf_dir),
        "sft",
        Settings(vocab=t.vocabulary(spark, sf_dir), validation_rows=t.HEAD, strict_validation=False),
    )
    return rows.select(
        "row_id",
        "split",
        *[shown(a).alias(a) for a in ("input_ids", "attention_mask", "labels")],
    )


@query(
    "render_chat",
    f"""WITH {PAIRS_SQL}
    SELECT conv_id, turn, {_rendered_sql(("user", "prompt"), ("assistant", "label"))} AS text
    FROM pairs""",
)
def _render_chat(spark, sf_dir):
    rows = t.dialogue_pairs(spark, sf_dir)
    chat = messages(F.col("prompt"), F.col("label"))
    return rows.select("conv_id", "turn", render_chat(chat).alias("text"))


@query(
    "full_text",
    f"WITH {PAIRS_SQL} SELECT conv_id, turn, prompt || label AS text FROM pairs",
)
def _full_text(spark, sf_dir):
    rows = t.dialogue_pairs(spark, sf_dir)
    return rows.select("conv_id", "turn", full_text(F.col("prompt"), F.col("label")).alias("text"))


@query(
    "assemble_splits",
    f"""WITH {PROMPT_LABEL_SQL}
    SELECT row_id, prompt, label, CASE split WHEN 'valid' THEN 'validation' ELSE split END AS split
    FROM prompt_label""",
)
def _assemble_splits(spark, sf_dir):
    rows = t.prompt_label(spark, sf_dir)
    return assemble_splits(
        {
            "train": rows.where("split = 'train'"),
            "validation": rows.where("split = 'valid'"),
        }
    )


# --- tokens --------------------------------------------------------------------------


@query("build_vocab", f"WITH {VOCAB_SQL} SELECT token, token_id, n FROM vocab")
def _build_vocab(spark, sf_dir):
    return t.vocabulary(spark, sf_dir).table


_DOCUMENT_IDS = encode_sql("e", "documents", "doc_id", "text", "ids")


def _document_ids(spark, sf_dir, keep=None, **more):
    documents = sources.spread(
        t.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"
    )
    vocab = replace(t.vocabulary(spark, sf_dir), **more)
    return vocab, encode(documents, vocab, {"text": "ids"}, keep)


_ENCODED = f"""WITH {VOCAB_SQL}, {_DOCUMENT_IDS}
    SELECT doc_id, {shown_sql("ids")} AS ids, CAST(len(ids) AS INTEGER) AS length FROM e"""


@query("encode_ids", _ENCODED)
def _encode_ids(spark, sf_dir):
    rows = _document_ids(spark, sf_dir)[1]
    return rows.select("doc_id", shown("ids").alias("ids"), F.size("ids").alias("length"))


@query("encode_ids_joined", _ENCODED)
def _encode_ids_joined(spark, sf_dir):
    rows = _document_ids(spark, sf_dir, shipped_words=0)[1]
    return rows.select("doc_id", shown("ids").alias("ids"), F.size("ids").alias("length"))


_DECODED = f"""WITH {VOCAB_SQL}, {_DOCUMENT_IDS}, {decode_sql("d", "e", "doc_id", "ids", "words")}
    SELECT doc_id, words FROM d"""


@query("decode_text", _DECODED)
def _decode_text(spark, sf_dir):
    vocab, rows = _document_ids(spark, sf_dir)
    return decode(rows, vocab, {"ids": "words"}).select("doc_id", "words")


@query("decode_text_joined", _DECODED)
def _decode_text_joined(spark, sf_dir):
    vocab, rows = _document_ids(spark, sf_dir, keep=["doc_id"], shipped_words=0)
    return decode(rows, vocab, {"ids": "words"}, keep=["doc_id"])


@query(
    "token_round_trip",
    rf"""SELECT doc_id, words, words = array_to_string(regexp_extract_all(lower(text), '{t.TOKENS}'), ' ') AS same
    FROM (SELECT doc_id, text, array_to_string(regexp_extract_all(lower(text), '{t.TOKENS}'), ' ') AS words
          FROM documents)""",
)
def _token_round_trip(spark, sf_dir):
    vocab, rows = _document_ids(spark, sf_dir, shipped_words=1000)
    back = decode(rows, vocab, {"ids": "words"})
    normal = F.array_join(words(F.col("text"), WORD_OR_EOS), " ")
    return back.select("doc_id", "words", (F.col("words") == normal).alias("same"))


@query(
    "truncate_pad",
    f"""WITH {VOCAB_SQL}, {_DOCUMENT_IDS}
    SELECT doc_id, {shown_sql(_padded_sql("ids", 128))} AS ids,
           {shown_sql(_padded_mask_sql("ids", 128))} AS mask FROM e""",
)
def _truncate_pad(spark, sf_dir):
    rows = _document_ids(spark, sf_dir)[1]
    return rows.select(
        "doc_id",
        shown(truncate_pad(F.col("ids"), 128)).alias("ids"),
        shown(attention_mask(F.col("ids"), 128)).alias("mask"),
    )


@query(
    "truncate_pad_left",
    f"""WITH {VOCAB_SQL}, {_DOCUMENT_IDS}
    SELECT doc_id, {shown_sql(
        "list_concat(list_transform(range(greatest(128 - len(ids), 0)), lambda x: 2),"
        " list_slice(ids, 1, 128))")} AS ids FROM e""",
)
def _truncate_pad_left(spark, sf_dir):
    rows = _document_ids(spark, sf_dir)[1]
    return rows.select("doc_id", shown(truncate_pad(F.col("ids"), 128, 2, "left")).alias("ids"))


_WORDS = rf"regexp_extract_all(lower(text), '{t.TOKENS}')"


@query(
    "random_cut",
    f"""SELECT doc_id, array_to_string(
             list_slice({_WORDS}, 1, {hashed_sql("doc_id", 42, 50, 128)}), ' ') AS head
    FROM documents""",
)
def _random_cut(spark, sf_dir):
    size = hashed_int("doc_id", 42, 50, 128)
    head = cut(words(F.col("text"), WORD_OR_EOS), size)
    return t.table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(head, " ").alias("head")
    )


@query(
    "pair_length_filter",
    rf"""WITH {COMPARISONS_SQL}
    SELECT row_id, CAST(len(a) AS INTEGER) AS length_a, CAST(len(b) AS INTEGER) AS length_b
    FROM (SELECT row_id, regexp_extract_all(lower(answers[1]), '[a-z0-9]+') AS a,
                 regexp_extract_all(lower(answers[2]), '[a-z0-9]+') AS b FROM comparisons)
    WHERE len(a) <= 128 AND len(b) <= 128""",
)
def _pair_length_filter(spark, sf_dir):
    rows = t.comparisons(spark, sf_dir).select(
        "row_id",
        words(F.col("summaries.text")[0]).alias("a"),
        words(F.col("summaries.text")[1]).alias("b"),
    )
    return pair_length_filter(rows, "a", "b").select(
        "row_id", F.size("a").alias("length_a"), F.size("b").alias("length_b")
    )


@query(
    "prompt_length_filter",
    rf"""WITH {COMPARISONS_SQL}
    SELECT row_id, lengths FROM (
      SELECT row_id, CAST(len(regexp_extract_all(lower(post), '[a-z0-9]+')) AS INTEGER) AS lengths
      FROM comparisons) WHERE lengths <= 128""",
)
def _prompt_length_filter(spark, sf_dir):
    rows = t.comparisons(spark, sf_dir).select(
        "row_id", F.size(words(F.col("info.post"))).alias("lengths")
    )
    return prompt_length_filter(rows)


# --- rewards -------------------------------------------------------------------------


@query(
    "best_of_n",
    f"""WITH {CANDIDATES_SQL}
    SELECT run, row_id, cand, round(score, 9) AS score, query, response FROM best""",
)
def _best_of_n(spark, sf_dir):
    best = best_of_n(t.scored_candidates(spark, sf_dir), keep=("query", "response"))
    return best.withColumn("score", F.round("score", 9))


@query(
    "token_argmax",
    """SELECT row_id, pos, token_id, logit FROM (
      SELECT l_orderkey AS row_id, l_linenumber AS pos, l_partkey AS token_id,
             l_extendedprice AS logit,
             row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                ORDER BY l_extendedprice DESC, l_partkey) AS nth
      FROM lineitem) WHERE nth = 1""",
)
def _token_argmax(spark, sf_dir):
    logits = t.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("row_id"),
        F.col("l_linenumber").alias("pos"),
        F.col("l_partkey").alias("token_id"),
        F.col("l_extendedprice").alias("logit"),
    )
    return token_argmax(logits)


@query(
    "mean_reward",
    f"""WITH {CANDIDATES_SQL}
    SELECT run, round(avg(score), 9) AS mean_reward, count(*) AS n FROM best GROUP BY run""",
)
def _mean_reward(spark, sf_dir):
    best = evaluate_candidates(t.candidates(spark, sf_dir))
    return mean_reward(best).withColumn("mean_reward", F.round("mean_reward", 9))


@query(
    "reward_stats",
    f"""WITH {GAME_LOG_SQL}
    SELECT run, step, round(avg(reward), 6) AS reward_mean,
           round(stddev_samp(reward), 6) AS reward_std, count(*) AS n
    FROM game_log GROUP BY run, step""",
)
def _reward_stats(spark, sf_dir):
    return _rounded(reward_stats(t.game_log(spark, sf_dir)))


def _rounded(stats: DataFrame) -> DataFrame:
    return stats.withColumns({c: F.round(c, 6) for c in ("reward_mean", "reward_std")})


@query(
    "reward_dist",
    f"""WITH {GAME_LOG_SQL}
    SELECT run, CASE WHEN reward < 0 THEN 0 WHEN reward >= 500 THEN 26
                     ELSE CAST(floor(25 * reward / 500) AS BIGINT) + 1 END AS bucket,
           count(*) AS n
    FROM game_log GROUP BY ALL""",
)
def _reward_dist(spark, sf_dir):
    return reward_dist(t.game_log(spark, sf_dir), 0.0, 500.0, 25, by=("run",))


@query(
    "reward_values",
    f"WITH {GAME_LOG_SQL} SELECT run, reward, count(*) AS n FROM game_log GROUP BY ALL",
)
def _reward_values(spark, sf_dir):
    return reward_values(t.game_log(spark, sf_dir), by=("run",))


def _best_and_first(spark, sf_dir):
    scored = t.scored_candidates(spark, sf_dir)
    best = best_of_n(scored, keep=("query", "response"))
    ranked = scored.withColumn("_early", -F.col("cand"))
    first = best_of_n(ranked, score="_early", keep=("response", "score"))
    return best, first.drop("_early", "cand")


@query(
    "ref_vs_best",
    f"""WITH {CANDIDATES_SQL}
    SELECT run, row_id, b.response AS response_best, round(b.score, 9) AS score_best,
           f.response AS response_ref, round(f.score, 9) AS score_ref,
           round(b.score - f.score, 9) AS uplift
    FROM best b JOIN first_answers f USING (run, row_id)""",
)
def _ref_vs_best(spark, sf_dir):
    best, first = _best_and_first(spark, sf_dir)
    pairs = pair_runs(best, first, ["run", "row_id"])
    return pairs.withColumns({c: F.round(c, 9) for c in ("score_best", "score_ref", "uplift")})


@query(
    "evaluation_report",
    f"""WITH {CANDIDATES_SQL}
    SELECT run, round(avg(f.score), 9) AS mean_ref, round(avg(b.score), 9) AS mean_best,
           round(avg(b.score - f.score), 9) AS mean_uplift, count(*) AS n
    FROM best b JOIN first_answers f USING (run, row_id) GROUP BY run""",
)
def _evaluation_report(spark, sf_dir):
    best, first = _best_and_first(spark, sf_dir)
    report = evaluation_report(best, first, ["run", "row_id"])
    means = ("mean_ref", "mean_best", "mean_uplift")
    return report.withColumns({c: F.round(c, 9) for c in means})


@query(
    "rloo_advantage",
    f"""WITH {CANDIDATES_SQL}
    SELECT run, row_id, cand, reward, round(reward - (total - reward) / nullif(k - 1, 0), 9)
             AS advantage
    FROM (SELECT *, sum(reward) OVER w AS total, count(*) OVER w AS k FROM candidates
          WINDOW w AS (PARTITION BY run, row_id))""",
)
def _rloo_advantage(spark, sf_dir):
    rows = t.candidates(spark, sf_dir).select("run", "row_id", "cand", "reward")
    return rloo_advantage(rows).withColumn("advantage", F.round("advantage", 9))


@query(
    "pairwise_accuracy",
    f"""WITH {noised_sql(0.2)}
    SELECT split, round(avg(CAST(margin > 0 AS INTEGER)), 9) AS accuracy,
           round(avg(ln(1 + exp(-abs(margin))) + greatest(-margin, 0)), 9) AS loss, count(*) AS n
    FROM (SELECT split, (len(regexp_extract_all(lower(chosen), '[a-z0-9]+'))
                         - len(regexp_extract_all(lower(rejected), '[a-z0-9]+'))) / 10 AS margin
          FROM picked)
    GROUP BY split""",
)
def _pairwise_accuracy(spark, sf_dir):
    from duelframe.functions import chosen_text, rejected_text

    rows = _prepared(spark, sf_dir, "raw").select(
        "split",
        (F.size(words(chosen_text())) / 10).alias("score_chosen"),
        (F.size(words(rejected_text())) / 10).alias("score_rejected"),
    )
    return pairwise_accuracy(rows, by=["split"]).withColumns(
        {c: F.round(c, 9) for c in ("accuracy", "loss")}
    )


_LOG_PROBS = ("lp_chosen", "lp_rejected", "ref_chosen", "ref_rejected")


@query(
    "dpo_margin",
    "WITH lp AS (SELECT doc_id, "
    + ", ".join(
        f"{hashed_sql('doc_id', 100 + i, 0, 20000)} / -100 AS {name}"
        for i, name in enumerate(_LOG_PROBS)
    )
    + """ FROM documents),
    m AS (SELECT *, 0.1::DOUBLE * ((lp_chosen - ref_chosen) - (lp_rejected - ref_rejected))
            AS margin FROM lp)
    SELECT doc_id, round(margin, 9) AS margin,
           round(ln(1 + exp(-abs(margin))) + greatest(-margin, 0), 9) AS loss,
           margin > 0 AS correct FROM m""",
)
def _dpo_margin(spark, sf_dir):
    documents = t.table(spark, sf_dir, "documents")
    log_probs = documents.select(
        "doc_id",
        *[
            (hashed_int("doc_id", 100 + i, 0, 20000) / -100).alias(name)
            for i, name in enumerate(_LOG_PROBS)
        ],
    )
    return dpo_margin(log_probs).select(
        "doc_id",
        F.round("margin", 9).alias("margin"),
        F.round("loss", 9).alias("loss"),
        "correct",
    )


# --- divergence and frontier ---------------------------------------------------------

_KL_TERM = "CASE WHEN p = 0 THEN 0 ELSE p * (ln(p) - ln(q)) END"
_KL = f"round(sum({_KL_TERM}) / sum(p) - (ln(sum(p)) - ln(sum(q))), 9)"


@query(
    "align_scores",
    f"""WITH {USER_SCORES_SQL}
    SELECT a.run, row_id, round(a.score, 6) AS p, round(b.score, 6) AS q
    FROM user_scores a JOIN user_scores b USING (row_id)
    WHERE a.run <> 'view' AND b.run = 'view'""",
)
def _align_scores(spark, sf_dir):
    scores = t.user_scores(spark, sf_dir)
    aligned = align_scores(
        scores.where("run <> 'view'"), scores.where("run = 'view'"), unmatched="drop"
    )
    return aligned.withColumns({"p": F.round("p", 6), "q": F.round("q", 6)})


@query(
    "kl_divergence",
    f"""WITH p AS (SELECT l_returnflag AS run, CAST(l_quantity AS INTEGER) AS row_id,
                      sum(l_extendedprice) AS p FROM lineitem GROUP BY ALL),
    q AS (SELECT CAST(l_quantity AS INTEGER) AS row_id, avg(l_extendedprice) AS q
          FROM lineitem GROUP BY ALL)
    SELECT run, {_KL} AS kl, count(*) AS n FROM p JOIN q USING (row_id) GROUP BY run""",
)
def _kl_divergence(spark, sf_dir):
    rows = t.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("run"),
        F.col("l_quantity").cast("int").alias("row_id"),
        "l_extendedprice",
    )
    scores = rows.groupBy("run", "row_id").agg(F.sum("l_extendedprice").alias("score"))
    reference = rows.groupBy("row_id").agg(F.avg("l_extendedprice").alias("score"))
    return kl_divergence(scores, reference).withColumn("kl", F.round("kl", 9))


@query(
    "kl_shared_rows",
    f"""WITH {USER_SCORES_SQL}
    SELECT run, {_KL} AS kl, count(*) AS n
    FROM (SELECT a.run, a.score AS p, b.score AS q
          FROM user_scores a JOIN user_scores b USING (row_id)
          WHERE a.run <> 'view' AND b.run = 'view') GROUP BY run""",
)
def _kl_shared_rows(spark, sf_dir):
    scores = t.user_scores(spark, sf_dir)
    kl = kl_divergence(
        scores.where("run <> 'view'"), scores.where("run = 'view'"), unmatched="drop"
    )
    return kl.withColumn("kl", F.round("kl", 9))


@query(
    "frontier",
    f"""WITH {NOISE_RUNS_SQL},
    ref AS (SELECT user_id AS row_id, avg(value) AS q FROM events GROUP BY ALL),
    kls AS (SELECT run, sum({_KL_TERM}) / sum(p) - (ln(sum(p)) - ln(sum(q))) AS kl
            FROM (SELECT run, score AS p, q FROM noise_runs JOIN ref USING (row_id)) GROUP BY run),
    means AS (SELECT run, avg(score) AS mean_reward FROM noise_runs GROUP BY run),
    summary AS (SELECT * FROM means JOIN kls USING (run))
    SELECT run, round(mean_reward, 6) AS mean_reward, round(kl, 6) AS kl FROM (
      SELECT *, max(mean_reward) OVER (ORDER BY kl, mean_reward DESC, run
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM summary)
    WHERE before IS NULL OR mean_reward > before""",
)
def _frontier(spark, sf_dir):
    reference = (
        t.table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("row_id"))
        .agg(F.avg("value").alias("score"))
    )
    best = frontier_of_runs(t.noise_runs(spark, sf_dir), reference, unmatched="drop")
    return best.withColumns({c: F.round(c, 6) for c in ("mean_reward", "kl")})


@query(
    "run_key",
    """SELECT run_key, count(*) AS n FROM (
      SELECT l_returnflag || '_' || replace(CASE WHEN strpos(lv, '.') = length(lv)
               THEN lv || '0' ELSE lv END, '.', '') AS run_key
      FROM (SELECT l_returnflag, rtrim(CAST(CAST(l_discount AS DECIMAL(10,6)) AS VARCHAR), '0')
              AS lv FROM lineitem)) GROUP BY run_key""",
)
def _run_key(spark, sf_dir):
    rows = t.table(spark, sf_dir, "lineitem")
    key = run_key(F.col("l_discount"), F.col("l_returnflag"))
    return rows.groupBy(key.alias("run_key")).agg(F.count("*").alias("n"))


def _answers(requests: DataFrame) -> DataFrame:
    """Stand-ins for generated answers: beginnings of the given one, of different lengths."""
    size = (1 + F.col("row_id") * (F.col("cand") + 3) % 97).cast("int")
    answer = F.substring("label", F.lit(1), size)
    return requests.select(
        F.lit("policy").alias("run"), "row_id", "cand", "query", answer.alias("response")
    )


@query(
    "evaluate_end_to_end",
    f"""WITH {PROMPT_LABEL_SQL},
    sampled AS (
      SELECT * FROM (
        SELECT *, row_number() OVER (ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id) AS nth,
               count(*) OVER () AS asked
        FROM prompt_label)
      WHERE nth <= floor(CAST({t.SHARE} AS DOUBLE) * asked)),
    scored AS (
      SELECT row_id, cand, 1 / (1 + exp(-(length(prompt || substring(label, 1,
               CAST(1 + row_id * (cand + 3) % 97 AS INTEGER))) / 1000 - 1))) AS score
      FROM sampled, (SELECT unnest(range(4)) AS cand)),
    pairs_of AS (
      SELECT row_id, max(score) AS best, max(score) FILTER (cand = 0) AS first
      FROM scored GROUP BY row_id)
    SELECT 'policy' AS run, round(avg(first), 9) AS mean_ref, round(avg(best), 9) AS mean_best,
           round(avg(best - first), 9) AS mean_uplift, count(*) AS n
    FROM pairs_of""",
)
def _evaluate_end_to_end(spark, sf_dir):
    """Sample, copies, answers, scorer, best of each, report."""
    prompts = t.prompt_label(spark, sf_dir).withColumn("query", F.col("prompt"))
    candidates = _answers(candidate_requests(prompts, t.SHARE, 4))
    best = evaluate_candidates(candidates, _length_scorer, with_query=True)
    first = evaluate_candidates(candidates.where("cand = 0"), _length_scorer, with_query=True)
    report = evaluation_report(best, first)
    means = ("mean_ref", "mean_best", "mean_uplift")
    return report.withColumns({c: F.round(c, 9) for c in means})


# --- ROUGE ---------------------------------------------------------------------------


def _rouge_sql(n: int) -> str:
    if n == 1:
        grams = "{w}"
    else:
        steps = " || ' ' || ".join(f"{{w}}[i + {k}]" for k in range(n))
        grams = f"list_transform(range(1, len({{w}}) - {n - 2}), lambda i: {steps})"
    side = "regexp_extract_all(lower({c}), '[a-z0-9]+')"
    p, r = (
        f"(SELECT conv_id, turn, unnest({grams.format(w='w')}) AS g"
        f" FROM (SELECT conv_id, turn, {side.format(c=c)} AS w FROM pairs))"
        for c in ("label", "prompt")
    )
    return f"""{PAIRS_SQL},
    p AS (SELECT conv_id, turn, g, count(*) AS k FROM {p} GROUP BY ALL),
    r AS (SELECT conv_id, turn, g, count(*) AS k FROM {r} GROUP BY ALL),
    p_n AS (SELECT conv_id, turn, sum(k) AS n FROM p GROUP BY ALL),
    r_n AS (SELECT conv_id, turn, sum(k) AS n FROM r GROUP BY ALL),
    o AS (SELECT conv_id, turn, sum(least(p.k, r.k)) AS n
          FROM p JOIN r USING (conv_id, turn, g) GROUP BY ALL),
    f AS (
      SELECT conv_id, turn, coalesce(o.n / nullif(p_n.n, 0), 0) AS precision,
             coalesce(o.n / nullif(r_n.n, 0), 0) AS recall,
             coalesce(2 * o.n / nullif(coalesce(p_n.n, 0) + coalesce(r_n.n, 0), 0), 0) AS f
      FROM pairs LEFT JOIN p_n USING (conv_id, turn) LEFT JOIN r_n USING (conv_id, turn)
           LEFT JOIN o USING (conv_id, turn)
    )"""


def _rouge_rows(spark, sf_dir):
    pairs = t.dialogue_pairs(spark, sf_dir)
    return pairs.select(
        "conv_id", "turn", F.col("label").alias("prediction"), F.col("prompt").alias("reference")
    )


_PAIR_KEY = ["conv_id", "turn"]
_MEASURES = ("precision", "recall", "f")


def _rounded_measures(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in _MEASURES})


_ROUGE_SHOWN = ", ".join(f"round({c}, 9) AS {c}" for c in _MEASURES)


@query("rouge_1", f"WITH {_rouge_sql(1)} SELECT conv_id, turn, {_ROUGE_SHOWN} FROM f")
def _rouge_1(spark, sf_dir):
    return _rounded_measures(rouge_n(_rouge_rows(spark, sf_dir), 1, key=_PAIR_KEY))


@query("rouge_2", f"WITH {_rouge_sql(2)} SELECT conv_id, turn, {_ROUGE_SHOWN} FROM f")
def _rouge_2(spark, sf_dir):
    return _rounded_measures(rouge_n(_rouge_rows(spark, sf_dir), 2, key=_PAIR_KEY))


# A row of lengths per word of the prediction: the longest common subsequence of
# the words so far with each beginning of the reference is a running maximum.
_ROUGE_L_SQL = f"""RECURSIVE {PAIRS_SQL},
    worded AS (
      SELECT conv_id, turn, regexp_extract_all(lower(label), '[a-z0-9]+') AS p,
             regexp_extract_all(lower(prompt), '[a-z0-9]+') AS r FROM pairs),
    cells AS (
      SELECT conv_id, turn, CAST(0 AS BIGINT) AS i, j, CAST(0 AS BIGINT) AS v
      FROM (SELECT conv_id, turn, unnest(range(1, len(r) + 1)) AS j FROM worded)
      UNION ALL
      SELECT conv_id, turn, i + 1, j, max(c) OVER (PARTITION BY conv_id, turn ORDER BY j)
      FROM (SELECT conv_id, turn, i, j, CASE WHEN p[i + 1] = r[j]
                   THEN 1 + coalesce(lag(v) OVER (PARTITION BY conv_id, turn ORDER BY j), 0)
                   ELSE v END AS c
            FROM cells JOIN worded USING (conv_id, turn) WHERE i < len(p))),
    common AS (SELECT conv_id, turn, max(v) AS n FROM cells GROUP BY ALL),
    f AS (
      SELECT conv_id, turn, coalesce(n / nullif(len(p), 0), 0) AS precision,
             coalesce(n / nullif(len(r), 0), 0) AS recall,
             coalesce(2 * n / nullif(len(p) + len(r), 0), 0) AS f
      FROM worded LEFT JOIN common USING (conv_id, turn))"""


@query("rouge_l", f"WITH {_ROUGE_L_SQL} SELECT conv_id, turn, {_ROUGE_SHOWN} FROM f")
def _rouge_l(spark, sf_dir):
    return _rounded_measures(rouge_l(_rouge_rows(spark, sf_dir), key=_PAIR_KEY))


@query("rouge_l_sum")
def _rouge_l_sum(spark, sf_dir):
    return _rounded_measures(rouge_l_sum(_rouge_rows(spark, sf_dir), key=_PAIR_KEY))


def _corpus_sql(n: int) -> str:
    return f"""SELECT * FROM (WITH {_rouge_sql(n)}
    SELECT 'rouge{n}' AS kind, round(avg(f), 9) AS f, count(*) AS n FROM f)"""


@query("rouge_corpus", f"{_corpus_sql(1)} UNION ALL {_corpus_sql(2)}")
def _rouge_corpus(spark, sf_dir):
    rows = rouge(_rouge_rows(spark, sf_dir), ("rouge1", "rouge2"), key=_PAIR_KEY)
    return rows.withColumn("f", F.round("f", 9))


@query("rouge_corpus_all")
def _rouge_corpus_all(spark, sf_dir):
    return rouge(_rouge_rows(spark, sf_dir), key=_PAIR_KEY).withColumn("f", F.round("f", 9))


# --- user code and models ------------------------------------------------------------


def _length_scorer():
    """Stands in for a model: a text's raw score grows with its length."""
    return lambda texts: [len(text) / 1000 - 1 for text in texts]


@query(
    "score_responses",
    f"""WITH {PAIRS_SQL}
    SELECT conv_id, turn, round(1 / (1 + exp(-(length(prompt || label) / 1000 - 1))), 9) AS score
    FROM pairs""",
)
def _score_responses(spark, sf_dir):
    rows = t.dialogue_pairs(spark, sf_dir).select(
        "conv_id", "turn", full_text(F.col("prompt"), F.col("label")).alias("text")
    )
    scored = score_responses(rows, _length_scorer, activation="sigmoid")
    return scored.select("conv_id", "turn", F.round("score", 9).alias("score"))


@query(
    "batch_map",
    "SELECT conv_id, turn, upper(role) AS role, length(text) AS size FROM conversations",
)
def _batch_map(spark, sf_dir):
    def shape(batch, case):
        return batch.assign(
            role=getattr(batch["role"].str, case)(), size=batch["text"].str.len()
        ).drop(columns="text")

    return batch_map(
        t.table(spark, sf_dir, "conversations"),
        shape,
        "conv_id bigint, turn bigint, role string, size bigint",
        case="upper",
    )


@query("fit_linear_reward")
def _fit_linear_reward(spark, sf_dir):
    pairs = _prepared(spark, sf_dir, "dpo").where("split = 'train'")
    reward = fit_linear_reward(pairs)
    return weights(spark, reward).select("bucket", F.round("weight", 6).alias("weight"))


@query("noise_vs_accuracy")
def _noise_vs_accuracy(spark, sf_dir):
    rows = noise_vs_accuracy(t.comparisons(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 6) for c in ("accuracy", "loss")})


# --- sources, sinks, streams ---------------------------------------------------------


@query(
    "read_scores_csv",
    rf"""WITH {PAIRS_SQL}
    SELECT conv_id * 1000 + turn AS row_id, prompt AS query, label AS response,
           length(label) / 1000 AS score FROM pairs""",
)
def _read_scores_csv(spark, sf_dir):
    scores = t.dialogue_pairs(spark, sf_dir).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
        F.col("prompt").alias("query"),
        F.col("label").alias("response"),
        (F.length("label") / 1000).alias("score"),
    )
    path = fresh_path(spark, "scores-csv")
    sources.write_scores(scores, path, "csv")
    return sources.read_scores(spark, path, "csv")


@query(
    "write_best_of",
    f"""WITH {CANDIDATES_SQL}
    SELECT f.row_id * 10 + CASE f.run WHEN 'O' THEN 1 ELSE 0 END AS row_id, f.query,
           f.response AS response_ref, round(f.score, 9) AS score_ref,
           b.response AS response_best, round(b.score, 9) AS score_best
    FROM best b JOIN first_answers f USING (run, row_id)""",
)
def _write_best_of(spark, sf_dir):
    best, first = _best_and_first(spark, sf_dir)
    pairs = pair_runs(best, first, ["run", "row_id"], "query")
    both = F.col("row_id") * 10 + (F.col("run") == "O").cast("int")
    path = fresh_path(spark, "best-of")
    sources.write_best_of(pairs.withColumn("row_id", both), path)
    rows = sources.read_scores(spark, path, schema=BEST_OF)
    return rows.withColumns({c: F.round(c, 9) for c in ("score_ref", "score_best")})


@query(
    "best_of_csv",
    f"""WITH {CANDIDATES_SQL}
    SELECT f.row_id * 10 + CASE f.run WHEN 'O' THEN 1 ELSE 0 END AS row_id, f.query,
           f.response AS response_ref, round(f.score, 9) AS score_ref,
           b.response AS response_best, round(b.score, 9) AS score_best
    FROM best b JOIN first_answers f USING (run, row_id)""",
)
def _best_of_csv(spark, sf_dir):
    best, first = _best_and_first(spark, sf_dir)
    pairs = pair_runs(best, first, ["run", "row_id"], "query")
    both = F.col("row_id") * 10 + (F.col("run") == "O").cast("int")
    path = fresh_path(spark, "best-of-csv")
    sources.write_best_of(pairs.withColumn("row_id", both), path, "csv")
    rows = sources.read_scores(spark, path, "csv", BEST_OF)
    return rows.withColumns({c: F.round(c, 9) for c in ("score_ref", "score_best")})


@query(
    "read_prompt_label",
    f"WITH {PROMPT_LABEL_SQL} SELECT row_id, prompt, label, split FROM prompt_label",
)
def _read_prompt_label(spark, sf_dir):
    path = fresh_path(spark, "prompt-label")
    t.prompt_label(spark, sf_dir).write.partitionBy("split").parquet(path)
    return sources.read_prompt_label(spark, path)


@query(
    "register_task",
    f"""WITH {COMPARISONS_SQL}
    SELECT row_id, length(post) AS size FROM comparisons WHERE split = 'train'""",
)
def _register_task(spark, sf_dir):
    def sizes(rows, settings):
        return rows.select(settings.key, F.length("info.post").alias("size"))

    if "post_sizes" not in TASKS:
        task = Task(sizes, noised=False, splits=("train",), reads_pair=False)
        register_task("post_sizes", task)
    return prepare(t.comparisons(spark, sf_dir), "post_sizes")


@query(
    "with_key",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) AS keys
    FROM lineitem GROUP BY ALL""",
)
def _with_key(spark, sf_dir):
    flags = t.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus")
    keyed = with_key(flags).groupBy("l_returnflag", "l_linestatus")
    return keyed.agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("keys"))


@query(
    "append_game_log",
    f"""WITH {GAME_LOG_SQL}
    SELECT run, step, query, response, ref_response, ref_reward, reward FROM game_log""",
)
def _append_game_log(spark, sf_dir):
    path = fresh_path(spark, "game-log")
    sources.append_game_log(t.game_log(spark, sf_dir), path)
    return sources.read_game_log(spark, path).drop("ts")


@query(
    "snapshot",
    f"""WITH {COMPARISONS_SQL}
    SELECT row_id, split, post, answers[1] AS answer_0, answers[2] AS answer_1, choice
    FROM comparisons""",
)
def _snapshot(spark, sf_dir):
    path = fresh_path(spark, "snapshot")
    sources.snapshot(t.comparisons(spark, sf_dir), path, "comparisons")
    rows = sources.read_comparisons(spark, f"{path}/type=comparisons")
    return rows.select(
        "row_id",
        "split",
        F.col("info.post").alias("post"),
        F.col("summaries.text")[0].alias("answer_0"),
        F.col("summaries.text")[1].alias("answer_1"),
        "choice",
    )


def _daily_sql(having: str = "") -> str:
    return f"""WITH {GAME_LOG_SQL}
    SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start, run,
           round(avg(reward), 6) AS reward_mean, round(stddev_samp(reward), 6) AS reward_std,
           count(*) AS n
    FROM game_log GROUP BY date_trunc('day', ts), run {having}"""


def _arriving_log(spark, sf_dir):
    schema = t.table(spark, sf_dir, "events").schema
    # a pattern, as a stream does not start from a single file
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return t.as_game_log(events)


@query("stream_reward_stats", _daily_sql())
def _stream_reward_stats(spark, sf_dir):
    path = fresh_path(spark, "stream-stats")
    stats = stream_reward_stats(_arriving_log(spark, sf_dir))
    keep_latest(stats, path, fresh_path(spark, "stream-checkpoint")).awaitTermination()
    return _rounded(spark.read.parquet(path))


@query(
    "stream_closed_windows",
    _daily_sql(
        "HAVING date_trunc('day', ts) + INTERVAL 1 DAY"
        " <= (SELECT max(ts) FROM game_log) - INTERVAL 1 HOUR"
    ),
)
def _stream_closed_windows(spark, sf_dir):
    path = fresh_path(spark, "stream-closed")
    stats = stream_reward_stats(_arriving_log(spark, sf_dir), late="1 hour")
    append_closed(stats, path, fresh_path(spark, "stream-checkpoint")).awaitTermination()
    return _rounded(spark.read.parquet(path))


@query("batch_reward_stats", _daily_sql())
def _batch_reward_stats(spark, sf_dir):
    return _rounded(stream_reward_stats(t.game_log(spark, sf_dir)))


# --- pairing by place, split CSV, retries, late rows, resampling, sketches, subtotals ----


def _users(spark, sf_dir):
    """Two scores per user."""
    values = t.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("row_id"))
    return values.agg(F.avg("value").alias("p"), F.max("value").alias("q")).select(
        "row_id",
        F.concat(F.lit('user "'), F.col("row_id").cast("string"), F.lit('"\n,and more')).alias("query"),
        F.lit("answer").alias("response"),
        "p",
        "q",
    )


_USERS_SQL = """users AS (
  SELECT user_id AS row_id, avg(value) AS p, max(value) AS q FROM events GROUP BY user_id)"""


def _one_line(rows: DataFrame, score: str) -> DataFrame:
    return rows.select("row_id", F.lit("q").alias("query"), "response", F.col(score).alias("score"))


@query(
    "align_by_position",
    f"""WITH {_USERS_SQL}
    SELECT 'policy' AS run, row_number() OVER (ORDER BY row_id) - 1 AS position,
           round(p, 9) AS p, round(q, 9) AS q FROM users""",
)
def _align_by_position(spark, sf_dir):
    """Two CSV files of one order and unlike splitting, whose row numbers are not used."""
    users = kept(_users(spark, sf_dir), "users")
    paths = fresh_path(spark, "policy-csv"), fresh_path(spark, "reference-csv")
    spread = _one_line(users, "p").repartitionByRange(5, "row_id").sortWithinPartitions("row_id")
    sources.write_scores(spread, paths[0], "csv")
    sources.write_scores(_one_line(users, "q").coalesce(1).sortWithinPartitions("row_id"), paths[1], "csv")
    ours, theirs = (with_positions(sources.read_scores(spark, p, "csv")).drop("row_id") for p in paths)
    aligned = align_scores(ours.withColumn("run", F.lit("policy")), theirs, "position")
    return aligned.withColumns({c: F.round(c, 9) for c in ("p", "q")})


@query(
    "read_scores_csv_splits",
    f"""WITH {_USERS_SQL}
    SELECT row_id, 'user "' || CAST(row_id AS VARCHAR) || '"' || chr(10) || ',and more' AS query,
           'answer' AS response, round(p, 9) AS score FROM users""",
)
def _read_scores_csv_splits(spark, sf_dir):
    path = fresh_path(spark, "quoted-csv")
    sources.write_scores(_users(spark, sf_dir).withColumn("score", F.col("p")), path, "csv")
    return sources.read_scores(spark, path, "csv", splits=True).withColumn("score", F.round("score", 9))


@query(
    "rouge_bootstrap",
    f"""WITH {_rouge_sql(1)},
    drawn AS (
      SELECT b, f, {" + ".join(f"(CASE WHEN x >= {step} THEN 1 ELSE 0 END)" for step in poisson_steps())} AS times
      FROM (SELECT b, f, CAST('0x' || substr(md5('42:' || b || ':' || conv_id || ':' || turn), 1, 8) AS BIGINT) AS x
            FROM f, (SELECT unnest(range(1, 201)) AS b))),
    means AS (SELECT b, sum(times * f) / sum(times) AS mean, count(*) AS n FROM drawn GROUP BY b)
    SELECT 'rouge1' AS kind, round(quantile_cont(mean, 0.025), 9) AS low,
           round(quantile_cont(mean, 0.5), 9) AS middle, round(quantile_cont(mean, 0.975), 9) AS high,
           max(n) AS n
    FROM means""",
)
def _rouge_bootstrap(spark, sf_dir):
    rows = rouge_bootstrap(_rouge_rows(spark, sf_dir), ("rouge1",), key=_PAIR_KEY)
    return rows.withColumns({c: F.round(c, 9) for c in ("low", "middle", "high")})


@query("stream_reward_upserts", _daily_sql())
def _stream_reward_upserts(spark, sf_dir):
    path = fresh_path(spark, "stream-versions")
    stats = stream_reward_stats(_arriving_log(spark, sf_dir))
    upsert(stats, path, fresh_path(spark, "stream-checkpoint")).awaitTermination()
    return _rounded(current(spark, path))


@query(
    "append_game_log_again",
    f"""WITH {GAME_LOG_SQL}
    SELECT run, step, query, response, ref_response, ref_reward, reward FROM game_log""",
)
def _append_game_log_again(spark, sf_dir):
    """A log in two batches, of which the second is retried."""
    path = fresh_path(spark, "game-log-batches")
    log = t.game_log(spark, sf_dir)
    for nth in (0, 1, 1):
        sources.append_game_log(log.where(F.col("step") % 2 == nth), path, batch=f"steps-{nth}")
    return sources.read_game_log(spark, path).drop("ts")


@query(
    "reward_sketches",
    f"""WITH {GAME_LOG_SQL}
    SELECT run, CAST(share AS DOUBLE) AS share, count(reward) AS n, true AS within
    FROM game_log, (SELECT unnest([0.1, 0.5, 0.9]) AS share) GROUP BY ALL""",
)
def _reward_sketches(spark, sf_dir):
    """Quantiles of runs from sketches of steps; whether their ranks are off by no more than stated."""
    log = t.game_log(spark, sf_dir)
    merged = merge_sketches(reward_sketches(log))
    found = kept(sketch_quantiles(merged, (0.1, 0.5, 0.9)), "sketch-quantiles")
    below, upto = F.count_if(F.col("reward") < F.col("value")), F.count_if(F.col("reward") <= F.col("value"))
    ranks = log.select("run", "reward").join(found, "run").groupBy("run", "share", "n")
    margin = RANK_ERROR * F.col("n") + 1
    off = F.greatest(F.col("below") - F.col("share") * F.col("n"), F.col("share") * F.col("n") - F.col("upto"))
    return ranks.agg(below.alias("below"), upto.alias("upto")).select("run", "share", "n", (off <= margin).alias("within"))


@query(
    "sweep_report",
    f"""WITH {NOISE_RUNS_SQL},
    named AS (
      SELECT regexp_extract(run, '^(.*?)(?:_([0-9]+))?$', 1) AS method,
             regexp_extract(run, '^(.*?)(?:_([0-9]+))?$', 2) AS digits, score FROM noise_runs),
    levels AS (
      SELECT method, CAST(digits[1] || '.' || substr(digits, 2) AS DOUBLE) AS level, score FROM named)
    SELECT method, level, CAST(grouping(method, level) AS INTEGER) AS subtotal,
           round(avg(score), 12) AS mean, count(score) AS n
    FROM levels GROUP BY ROLLUP (method, level)""",
)
def _sweep_report(spark, sf_dir):
    return sweep_report(t.noise_runs(spark, sf_dir)).withColumn("mean", F.round("mean", 12))
