"""From comparisons to the table a preference-learning method trains on.

Order of a preparation: drop or check bad rows, keep the validation head, flip
labels, shape. Up to the tokens, everything is one pass over the rows; noise and
head read key and label in scalar subqueries. Nothing is shuffled, and a scan
reads the columns of the task only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.defaults import (
    IGNORED_LABEL,
    LM_LENGTH,
    MAX_TOKENS,
    SAMPLING_SEED,
    VALIDATION_ROWS,
)
from duelframe.functions.chat import ROLE_LINES, ChatTemplate, messages, render_chat
from duelframe.functions.pairs import chosen_text, post_text, rejected_text
from duelframe.functions.tokens import (
    EOS_ID,
    WORD_OR_EOS,
    attention_mask,
    cut,
    truncate_pad,
    words,
)
from duelframe.keys import hashed_int, key_value
from duelframe.operators.heads import head_end
from duelframe.operators.noise import Noise, add_noise
from duelframe.operators.rows import prompt_length_filter, to_kto, within
from duelframe.operators.vocabulary import Vocabulary, decode, encode


@dataclass(frozen=True)
class Settings:
    """Parameters of a preparation; a task takes from them what it needs."""

    noise: Noise = field(default_factory=Noise)
    vocab: Vocabulary | None = None
    template: ChatTemplate = ROLE_LINES
    max_tokens: int = MAX_TOKENS
    validation_rows: int = VALIDATION_ROWS
    strict_validation: bool = True
    prompt_lengths: tuple[int, int] | None = None
    lm_length: int = LM_LENGTH
    pad_id: int = EOS_ID
    pad_side: str = "right"
    mask_pad: bool = False
    on_bad_row: str = "error"
    ignored_splits: tuple[str, ...] = ()
    seed: int = SAMPLING_SEED
    key: str = "row_id"

    def tokeniser(self) -> Vocabulary:
        if self.vocab is None:
            raise ValueError("this task needs a vocabulary")
        return self.vocab

    def encode(self, df: DataFrame, columns: dict[str, str]) -> DataFrame:
        return encode(df, self.tokeniser(), columns)

    def decode(self, df: DataFrame, columns: dict[str, str]) -> DataFrame:
        return decode(df, self.tokeniser(), columns)


Shape = Callable[[DataFrame, Settings], DataFrame]


@dataclass(frozen=True)
class Task:
    shape: Shape
    noised: bool = True
    splits: tuple[str, ...] = ("train", "validation")
    reads_post: bool = True
    reads_pair: bool = True
    comparisons: bool = True


def _dpo(df: DataFrame, s: Settings) -> DataFrame:
    def rendered(answer: Column) -> Column:
        return render_chat(messages(post_text(), answer), s.template)

    return df.select(
        s.key,
        "split",
        post_text().alias("prompt"),
        rendered(chosen_text()).alias("chosen"),
        rendered(rejected_text()).alias("rejected"),
    )


def _kto(df: DataFrame, s: Settings) -> DataFrame:
    def answer(text: Column) -> Column:
        return render_chat(messages(assistant=text), s.template)

    return to_kto(
        df,
        render_chat(messages(user=post_text()), s.template),
        answer(chosen_text()),
        answer(rejected_text()),
        s.key,
        "split",
    )


def _reward(df: DataFrame, s: Settings) -> DataFrame:
    texts = df.select(
        s.key, "split", chosen_text().alias("_chosen"), rejected_text().alias("_rejected")
    )
    # Too long pairs are left out, not cut. There is one id per word, so words
    # are counted and only the rows that stay are encoded.
    short = texts.where(
        within(words(F.col("_chosen"), WORD_OR_EOS), s.max_tokens)
        & within(words(F.col("_rejected"), WORD_OR_EOS), s.max_tokens)
    )
    ids = s.encode(
        short, {"_chosen": "input_ids_chosen", "_rejected": "input_ids_rejected"}
    )
    return ids.select(
        s.key,
        "split",
        "input_ids_chosen",
        attention_mask(F.col("input_ids_chosen")).alias("attention_mask_chosen"),
        "input_ids_rejected",
        attention_mask(F.col("input_ids_rejected")).alias("attention_mask_rejected"),
    )


def _rendered_prompts(df: DataFrame, s: Settings) -> DataFrame:
    prompt = render_chat(messages(user=post_text()), s.template, add_generation_prompt=True)
    return df.select(s.key, "split", prompt.alias("_prompt"))


def _prompt_ids(texts: DataFrame, s: Settings) -> DataFrame:
    return s.encode(texts, {"_prompt": "input_ids"}).select(
        s.key, "split", "input_ids", F.size("input_ids").alias("lengths")
    )


def _ppo(df: DataFrame, s: Settings) -> DataFrame:
    texts = _rendered_prompts(df, s)
    counted = texts.withColumn("lengths", F.size(words(F.col("_prompt"), WORD_OR_EOS)))
    return _prompt_ids(prompt_length_filter(counted, "lengths", s.max_tokens), s)


def _rloo(df: DataFrame, s: Settings) -> DataFrame:
    return _prompt_ids(_rendered_prompts(df, s), s)


def _ppo_query(df: DataFrame, s: Settings) -> DataFrame:
    texts = df.select(s.key, "split", post_text().alias("_post"))
    ids = s.encode(texts, {"_post": "input_ids"})
    return s.decode(ids, {"input_ids": "query"}).select(
        s.key, "split", "input_ids", "query", F.size("input_ids").alias("lengths")
    )


def _nsampler(df: DataFrame, s: Settings) -> DataFrame:
    texts = df.select(s.key, "split", post_text().alias("_post"))
    ids = s.encode(texts, {"_post": "input_ids"})
    if s.prompt_lengths is not None:
        size = hashed_int(s.key, s.seed, *s.prompt_lengths)
        ids = ids.withColumn("input_ids", cut(F.col("input_ids"), size))
    return s.decode(ids, {"input_ids": "query"}).select(
        s.key, "split", "input_ids", "query"
    )


def _sft(df: DataFrame, s: Settings) -> DataFrame:
    texts = df.select(s.key, "split", F.concat("prompt", "label").alias("_text"))
    raw = s.encode(texts, {"_text": "_ids"})
    padded = raw.select(
        s.key,
        "split",
        truncate_pad(F.col("_ids"), s.lm_length, s.pad_id, s.pad_side).alias("input_ids"),
        attention_mask(F.col("_ids"), s.lm_length, s.pad_side).alias("attention_mask"),
    )
    labels = F.col("input_ids")
    if s.mask_pad:
        labels = F.zip_with(
            "input_ids",
            "attention_mask",
            lambda i, m: F.when(m == 1, i).otherwise(F.lit(IGNORED_LABEL)),
        )
    return padded.withColumn("labels", labels)


def _raw(df: DataFrame, s: Settings) -> DataFrame:
    return df


TASKS: dict[str, Task] = {
    "dpo": Task(_dpo),
    "kto": Task(_kto),
    "reward": Task(_reward, reads_post=False),
    "ppo": Task(_ppo, reads_pair=False),
    "rloo": Task(_rloo, reads_pair=False),
    "ppo_query": Task(_ppo_query, splits=("train",), reads_pair=False),
    "nsampler": Task(_nsampler, noised=False, splits=("validation",), reads_pair=False),
    "sft": Task(_sft, noised=False, splits=("train", "validation"), comparisons=False),
    "raw": Task(_raw),
}


def register_task(name: str, task: Task) -> None:
    """Make a further table available to ``prepare``."""
    if name in TASKS:
        raise ValueError(f"task {name!r} exists")
    TASKS[name] = task


def _bad(task: Task, key: str) -> Column:
    """Whether a row lacks what the task reads."""
    if not task.comparisons:
        return F.col(key).isNull() | F.col("prompt").isNull() | F.col("label").isNull()
    bad = F.col(key).isNull()
    if task.reads_post:
        bad = bad | post_text().isNull()
    if task.reads_pair:
        texts = F.col("summaries.text")
        # field by field, for size(NULL) and NULL labels
        bad = (
            bad
            | F.col("choice").isNull()
            | ~F.col("choice").isin(0, 1)
            | F.coalesce(F.size(texts) != 2, F.lit(True))
            | F.exists(texts, lambda t: t.isNull())
        )
    return F.coalesce(bad, F.lit(True))


def _checked(df: DataFrame, task: Task, key: str) -> DataFrame:
    problem = F.raise_error(
        F.concat(F.lit("bad row: "), F.coalesce(F.col(key).cast("string"), F.lit("no key")))
    )
    return df.where(F.when(_bad(task, key), problem).otherwise(F.lit(True)))


def prepare(df: DataFrame, task: str, settings: Settings | None = None, **changes) -> DataFrame:
    """The training table of ``task``, one of ``TASKS``.

    Input is the comparisons table, or prompt+label rows for ``sft``; output has
    the key, ``split`` and the task's columns.
    """
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}; known are {sorted(TASKS)}")
    s = settings or Settings(**changes)
    if settings is not None and changes:
        raise ValueError("give settings or single parameters, not both")
    if s.on_bad_row not in ("error", "drop"):
        raise ValueError(f"on_bad_row must be error or drop, not {s.on_bad_row!r}")
    plan = TASKS[task]

    # a split whose name contains "valid" is the validation split, whatever its ending
    held_split = F.contains("split", F.lit("valid"))
    # not by equality: a later filter on the split would be put into the comparison
    named = F.array(*[F.lit(name) for name in ("train", *s.ignored_splits)])
    known = F.array_contains(named, F.col("split")) | held_split
    unknown = F.raise_error(
        F.concat(F.lit("unknown split: "), F.coalesce(F.col("split"), F.lit("none")))
    )
    wanted = F.lit(False)
    if "train" in plan.splits:
        wanted = wanted | (F.col("split") == "train")
    if "validation" in plan.splits:
        wanted = wanted | held_split
    rows = df.where(F.when(F.coalesce(known, F.lit(False)), wanted).otherwise(unknown))
    if s.on_bad_row == "drop":
        rows = rows.where(~_bad(plan, s.key))
    held = [name for name in plan.splits if name != "train"]
    if held:
        head = rows.where(F.col("split") != "train")
        strict = s.strict_validation and plan.comparisons
        end = head_end(head, s.validation_rows, s.key, strict)
        rows_kept = rows.where(
            F.coalesce((F.col("split") == "train") | (key_value(s.key) <= end), F.lit(False))
        )
    else:
        rows_kept = rows
    if plan.noised:
        # counted on the input: the head does not concern the training rows
        rows_kept = add_noise(rows_kept, s.noise, s.key, counted=rows)
    if s.on_bad_row == "error":
        rows_kept = _checked(rows_kept, plan, s.key)
    return plan.shape(rows_kept, s)
