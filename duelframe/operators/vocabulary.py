"""Corpus vocabulary, and texts to token ids and back."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from duelframe.functions.tokens import (
    EOS_ID,
    EOS_TEXT,
    FIRST_WORD_ID,
    PAD_ID,
    PAD_TEXT,
    UNK_ID,
    UNK_TEXT,
    WORD_OR_EOS,
    words,
)
from duelframe.session import kept

# So many of the most frequent words go to the executors, those of usual length: some
# megabytes. Words beyond are joined.
SHIPPED_WORDS = 500_000
SHIPPED_LENGTH = 64
# For words beyond, neighbouring rows with about so many words share one list of them. Their
# arrays are made again in pieces of about so many words, which are what a task holds as text.
TOGETHER = 1 << 21
PIECE = 1 << 18


@dataclass(frozen=True)
class Vocabulary:
    """A table ``(token, token_id, n)`` without the reserved tokens."""

    table: DataFrame
    shipped_words: int = SHIPPED_WORDS

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Vocabulary:
        return cls(spark.read.parquet(path))

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)

    @cached_property
    def shipped(self) -> Broadcast:
        """``(tokens, ids)`` arrays of the reserved tokens and the frequent words, on the executors."""
        last = FIRST_WORD_ID + self.shipped_words
        usual = (F.col("token_id") < last) & (F.octet_length("token") <= SHIPPED_LENGTH)
        rows = self.table.where(usual).select("token", "token_id").toArrow()
        tokens = pa.concat_arrays(
            [pa.array([EOS_TEXT, UNK_TEXT, PAD_TEXT])]
            + [c.cast(pa.string()) for c in rows["token"].chunks]
        )
        ids = pa.concat_arrays(
            [pa.array([EOS_ID, UNK_ID, PAD_ID], pa.int32())]
            + [c.cast(pa.int32()) for c in rows["token_id"].chunks]
        )
        return self.table.sparkSession.sparkContext.broadcast((tokens, ids))

    @cached_property
    def complete(self) -> bool:
        """Whether all words are shipped, so that nothing is joined."""
        tokens, _ = self.shipped.value
        return self.table.count() == len(tokens) - FIRST_WORD_ID


def build_vocab(df: DataFrame, *texts: str, size: int | None = None) -> Vocabulary:
    """All words of the text columns, the most frequent first; ties in word order.

    ``size`` keeps that many only. Words are counted once, spread by ranges of
    their order and written. Each knows its place within its range, and what
    precedes a range is a sum over as many numbers as there are ranges.
    """
    each = [F.coalesce(words(F.col(t), WORD_OR_EOS), F.array().cast("array<string>")) for t in texts]
    word = F.explode(F.concat(*each)).alias("token")
    counted = df.select(word).where(F.col("token") != EOS_TEXT).groupBy("token").agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.col("token")]
    place = F.monotonically_increasing_id()  # the range's number, and 33 bits of the place in it
    ranged = kept(
        counted.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("token", "n", F.shiftright(place, 33).alias("_range"), place.bitwiseAND((1 << 33) - 1).alias("_nth")),
        "vocabulary",
    )
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_at"))
    number = (F.col("_at") + F.col("_nth") + FIRST_WORD_ID).cast("int")
    # as many rows as there are ranges
    table = ranged.join(F.broadcast(starts), "_range").select("token", number.alias("token_id"), "n")
    return Vocabulary(table if size is None else table.where(F.col("token_id") < FIRST_WORD_ID + size))


def _lists(values: pa.Array, lengths: pa.Array) -> pa.ListArray:
    """Lists of ``values`` with these lengths, and null where those are."""
    ends = pc.cumulative_sum(pc.fill_null(lengths, 0).cast(pa.int32()))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
    missing = lengths.is_null() if lengths.null_count else None
    return pa.ListArray.from_arrays(offsets, values, mask=missing)


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Rows as runs (first, after the last) with equal shares of the values, ``most`` or so each; ``ends`` adds up the values."""
    if not len(ends):
        return
    total = int(ends[-1])
    of = np.maximum(ends - 1, 0) * (total // most + 1) // max(total, 1)
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    yield from zip(starts.tolist(), [*starts[1:].tolist(), len(ends)], strict=True)


def _packed(arrays: dict[str, pa.Array]) -> bytes:
    """Arrays of one length as compressed bytes."""
    sink, batch = pa.BufferOutputStream(), pa.RecordBatch.from_pydict(arrays)
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(data.as_buffer()).read_next_batch()


def encode(
    df: DataFrame, vocab: Vocabulary, columns: dict[str, str], keep: Sequence[str] | None = None
) -> DataFrame:
    """Add id arrays: ``columns`` maps a text column to the array's name.

    Frequent words are looked up inside Arrow batches, where the rows are, for all
    columns in one pass. See ``_filled`` for other words. ``keep`` names the columns
    of ``df`` that the result has, all unless given: what is written and shuffled for
    other words has no others.
    """
    shared = vocab.shipped

    def look_up(tokens: pa.Array) -> pa.Array:
        known, numbers = shared.value
        return numbers.take(pc.index_in(tokens.cast(pa.string()), value_set=known))

    table = vocab.table.select(F.col("token").alias("_value"), F.col("token_id").alias("_found"))
    values = {ids: words(F.col(text), WORD_OR_EOS) for text, ids in columns.items()}
    return _filled(df, values, look_up, "string", "int", None if vocab.complete else table, UNK_ID, keep)


def decode(
    df: DataFrame,
    vocab: Vocabulary,
    columns: dict[str, str],
    skip_special_tokens: bool = False,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add texts: ``columns`` maps an id array to the text's name.

    Words are joined by a blank. An id without a word is an error. ``keep`` as in ``encode``.
    """
    shared = vocab.shipped

    def spell(ids: pa.Array) -> pa.Array:
        known, numbers = shared.value
        return known.take(pc.index_in(ids.cast(pa.int32()), value_set=numbers))

    def kept_ids(ids: str) -> Column:
        return F.filter(F.col(ids), lambda i: i >= FIRST_WORD_ID) if skip_special_tokens else F.col(ids)

    table = vocab.table.select(F.col("token_id").alias("_value"), F.col("token").alias("_found"))
    values = {text: kept_ids(ids) for ids, text in columns.items()}
    spelled = _filled(df, values, spell, "int", "string", None if vocab.complete else table, None, keep)
    return spelled.withColumns({text: F.array_join(text, " ") for text in values})


OUTSIDE = "token id outside the vocabulary"


def _filled(
    df: DataFrame,
    values: dict[str, Column],
    look_up: Callable[[pa.Array], pa.Array],
    given: str,
    kind: str,
    table: DataFrame | None,
    unknown: int | None,
    keep: Sequence[str] | None,
) -> DataFrame:
    """Add arrays: for each value what the look-up has, or else what ``table`` has, or ``unknown``.

    Without ``unknown`` a value that neither has is an error. Without a table nothing
    is joined. Otherwise rows are written in blocks of neighbours: the rows, their
    distinct values, and each value as a place among these. Of the values that the
    look-up doesn't have, each is joined to the table once for a block, and the block
    meets that list, whatever keys its rows have. Rows without such values are in
    blocks of their own and stay out of it.
    """
    others = [c for c in (df.columns if keep is None else keep) if c not in values]

    def quoted(name: str) -> Column:
        return F.col("`" + name.replace("`", "``") + "`")

    def complete(batch: pa.Array) -> pa.Array:
        found = look_up(batch.flatten())
        if found.null_count and unknown is None:
            raise ValueError(OUTSIDE)
        return _lists(found if unknown is None else found.fill_null(unknown), pc.list_value_length(batch))

    if table is None:
        complete = F.arrow_udf(complete, f"array<{kind}>")
        whole = df.withColumns({name: complete(value) for name, value in values.items()})
        return whole if keep is None else whole.select(*[quoted(c) for c in [*others, *values]])

    each = range(len(values))

    def block(rows: pa.RecordBatch, distinct: pa.Array, found: pa.Array, places: np.ndarray, near: int) -> pa.RecordBatch:
        """Rows with the lengths of their arrays, and the places of all values, here by frequency and by bytes."""
        counts = np.bincount(places, minlength=len(distinct))
        order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
        nth = np.empty(len(distinct), "<u4")
        nth[order] = np.arange(len(order))
        parts = nth[places].view("u1").reshape(-1, 4)
        distinct, found = distinct.take(pa.array(order)), found.take(pa.array(order))
        rest = distinct.filter(found.is_null())
        arrays = {
            "_near": pa.array([near]),
            "_rows": pa.array([_packed(dict(zip(rows.schema.names, rows.columns, strict=True)))]),
            "_places": pa.array([_packed({str(k): pa.array(np.ascontiguousarray(parts[:, k])) for k in range(4)})]),
            "_known": pa.array([_packed({"known": found})]),
            "_open": pa.ListArray.from_arrays(pa.array([0, len(rest)], pa.int32()), rest),
        }
        return pa.RecordBatch.from_pydict(arrays)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = TaskContext.get().partitionId() << 33
        for batch in batches:
            sizes = sum(pc.fill_null(pc.list_value_length(batch[f"_{nth}"]), 0).to_numpy() for nth in each)
            for start, end in _runs(np.cumsum(sizes, dtype="int64"), TOGETHER):
                some = batch.slice(start, end - start)
                lists = [some[f"_{nth}"] for nth in each]
                lengths = [pc.list_value_length(x) for x in lists]
                rows = pa.RecordBatch.from_pydict({"_in": some["_in"]} | {f"_{nth}": lengths[nth] for nth in each})
                coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode(null_encoding="encode")
                found, places = look_up(coded.dictionary), coded.indices.to_numpy()
                missing = found.is_null().to_numpy(zero_copy_only=False)
                counts = np.concatenate([pc.fill_null(x, 0).to_numpy() for x in lengths])
                before = np.concatenate([[0], np.cumsum(missing[places], dtype="int32")])
                misses = np.diff(before[np.concatenate([[0], np.cumsum(counts, dtype="int64")])])
                late = misses.reshape(len(each), -1).any(axis=0)
                for which in (late, ~late):
                    if which.all():
                        yield block(rows, coded.dictionary, found, places, near)
                    elif which.any():
                        own = places[np.repeat(np.tile(which, len(each)), counts)]
                        yield block(rows.filter(pa.array(which)), coded.dictionary, found, own, near)
                    near += 1

    def filled(rows: pa.Scalar, places: pa.Scalar, found: pa.Array) -> Iterator[pa.RecordBatch]:
        """The rows of a block and their arrays, some at a time."""
        rows = _unpacked(rows)
        nth_value = np.stack([x.to_numpy() for x in _unpacked(places).columns], axis=1).reshape(-1).view("<u4")
        lengths = [rows[f"_{nth}"] for nth in each]
        ends = [np.cumsum(pc.fill_null(x, 0).to_numpy(), dtype="int64") for x in lengths]
        first = np.cumsum([0] + [x[-1] for x in ends])
        for start, end in _runs(sum(ends), PIECE):
            arrays = {"_in": rows["_in"].slice(start, end - start)}
            for nth in each:
                since, until = (first[nth] + (ends[nth][k - 1] if k else 0) for k in (start, end))
                flat = found.take(pa.array(nth_value[since:until]))
                arrays[f"_found{nth}"] = _lists(flat, lengths[nth].slice(start, end - start))
            yield pa.RecordBatch.from_pydict(arrays)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, places, known in zip(*[batch[c] for c in ("_rows", "_places", "_known")], strict=True):
                yield from filled(rows, places, _unpacked(known)["known"])

    def patched(rows: pa.Table, late: pa.Table) -> pa.Table:
        rows, late = rows.combine_chunks(), late.combine_chunks()
        known, found = _unpacked(rows["_known"][0])["known"], late["_found"].combine_chunks()
        at = np.empty(known.null_count, "int64")
        at[late["_nth"].to_numpy()] = np.arange(late.num_rows)
        found = pc.replace_with_mask(known, known.is_null(), found.take(pa.array(at)))
        return pa.Table.from_batches(filled(rows["_rows"][0], rows["_places"][0], found))

    looked = df.select(
        F.struct(*[quoted(c) for c in others]).alias("_in"), *[value.alias(f"_{nth}") for nth, value in enumerate(values.values())]
    )
    shape = f"_near long, _rows binary, _places binary, _known binary, _open array<{given}>"
    marked = kept(looked.mapInArrow(blocks, shape), "looked-up", {"compression": "zstd", "parquet.block.row.count.limit": "4"})
    some = F.size("_open") > 0
    instead = F.raise_error(F.lit(OUTSIDE)).cast(kind) if unknown is None else F.lit(unknown)
    rest = marked.where(some).select(F.col("_near").alias("_of"), F.posexplode("_open").alias("_nth", "_value"))
    listed = rest.join(table, "_value", "left").select("_of", "_nth", F.coalesce("_found", instead).alias("_found"))
    near = marked.where(some).select("_near", "_rows", "_places", "_known").groupBy("_near").cogroup(listed.groupBy("_of"))
    arrays = [f"_found{nth}" for nth in each]
    found = StructType([looked.schema["_in"], *StructType.fromDDL(", ".join(f"{a} array<{kind}>" for a in arrays))])
    done = marked.where(~some).select("_rows", "_places", "_known").mapInArrow(opened, found)
    whole = done.unionByName(near.applyInArrow(patched, found))
    return whole.select(
        *[F.col("_in")[c].alias(c) for c in others], *[F.col(a).alias(name) for a, name in zip(arrays, values, strict=True)]
    )
