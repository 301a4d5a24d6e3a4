"""Ranked lexical search: all documents for each item, with partial sums that items share.

Items are taken in blocks of bounded size. Of a block, the sets of terms that the
same items share are mined first, and then the runs of such sets that items have
in common, the most shared first. They form a graph: a set's sum is made once
per document, a common run once per document, and an item's score is the end of
its path. Tasks keep each item's best documents only, so what is shuffled
doesn't depend on how many documents have its terms.

A null text has no terms. A document without terms doesn't count. An item
without terms has no rows; rows of the items that are repeated are ranked each.
Documents with an equal doc_id are ranked each, and a null doc_id comes last
among equal scores. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from duelframe.llm.common import arrow_type, cut, drop

TOP = 20
BLOCK_WORDS = 1 << 17  # words of the items that are searched for at a time
CELLS = 1 << 22  # sums that a task holds at a time
PARTS = 64  # an item's best documents of the tasks are ranked in so many parts first

# Letters A to Z lower-cased, digits and all beyond ASCII kept, anything else a blank.
_TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


@dataclass(frozen=True)
class Sharing:
    """The graph of a block: which terms make which sets, and which sets which items.

    Set ``0`` to ``n_sets - 1`` add up terms; node 0 is empty, and every other
    node adds one set to its parent. Nodes are numbered by level.
    """

    vocabulary: dict[bytes, int]
    starts: np.ndarray  # of each term's sets in ``sets``
    sets: np.ndarray
    n_sets: int
    levels: list[tuple[np.ndarray, np.ndarray]]  # parents and sets of a level's nodes
    ends: np.ndarray  # each item's node; 0 if it has no terms

    @classmethod
    def mine(cls, items: list[list[bytes]]) -> Sharing:
        holders: dict[tuple[bytes, int], list[int]] = defaultdict(list)
        for slot, words in enumerate(items):
            for word, n in Counter(words).items():
                for nth in range(n):
                    holders[word, nth].append(slot)
        # terms held by the same items are one set
        numbers: dict[tuple[int, ...], int] = {}
        vocabulary: dict[bytes, int] = {}
        members = []
        for (word, _), slots in holders.items():
            number = numbers.setdefault(tuple(slots), len(numbers))
            members.append((vocabulary.setdefault(word, len(vocabulary)), number))
        members.sort()
        of_term = np.array([t for t, _ in members], np.int64)
        starts = np.searchsorted(of_term, np.arange(len(vocabulary) + 1))
        paths: list[list[int]] = [[] for _ in items]
        for slots, number in sorted(numbers.items(), key=lambda x: (-len(x[0]), x[1])):
            for slot in slots:
                paths[slot].append(number)
        ends = np.zeros(len(items), np.int64)
        levels: list[tuple[np.ndarray, np.ndarray]] = []
        n_nodes, depth = 1, 0
        open_slots = [slot for slot, path in enumerate(paths) if path]
        while open_slots:
            found: dict[tuple[int, int], int] = {}
            for slot in open_slots:
                step = int(ends[slot]), paths[slot][depth]
                ends[slot] = n_nodes + found.setdefault(step, len(found))
            parents, sets = (np.array(x, np.int64) for x in zip(*found, strict=True))
            levels.append((parents, sets))
            n_nodes, depth = n_nodes + len(found), depth + 1
            open_slots = [slot for slot in open_slots if len(paths[slot]) > depth]
        sets = np.array([s for _, s in members], np.int64)
        return cls(vocabulary, starts, sets, len(numbers), levels, ends)

    @cached_property
    def n_nodes(self) -> int:
        return 1 + sum(len(parents) for parents, _ in self.levels)

    def scores(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Items by documents, from each document's terms and their values. Whole numbers."""
        times = self.starts[term + 1] - self.starts[term]
        entry = np.repeat(np.arange(len(term)), times)
        at = np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times) + self.starts[term[entry]]
        sums = np.zeros((self.n_sets, n), np.int64)
        np.add.at(sums.reshape(-1), self.sets[at] * n + row[entry], value[entry])
        nodes = np.zeros((self.n_nodes, n), np.int64)
        first = 1
        for parents, sets in self.levels:
            np.add(nodes[parents], sums[sets], out=nodes[first : first + len(sets)])
            first += len(sets)
        return nodes[self.ends]


@dataclass(frozen=True)
class Block:
    """A block of items, and what their scores need to know of the corpus."""

    items: pa.Array  # their ids
    sharing: Sharing
    weights: np.ndarray
    n_docs: int
    n_terms: int


class Best:
    """The best documents of each item so far."""

    def __init__(self, block: Block, top: int) -> None:
        self.block, self.top = block, top
        self.slot = self.score = np.zeros(0, np.int64)
        self.unnamed, self.doc = np.zeros(0, bool), None
        self.least = np.ones(len(block.items), np.int64)  # scores below can't be among them

    def add(self, batch: pa.RecordBatch) -> None:
        block = self.block
        ids, n = batch.column("doc_id"), batch.column("n").to_numpy(zero_copy_only=False)
        lengths = pc.list_value_length(batch.column("at")).to_numpy(zero_copy_only=False).astype(np.int64)
        term, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "tf"))
        row = np.repeat(np.arange(len(n)), lengths)
        m = 100 - 25 + (25 * n * block.n_docs) // block.n_terms
        value = block.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        unnamed = ids.is_null().to_numpy(zero_copy_only=False)
        doc = ids.fill_null("" if pa.types.is_string(ids.type) else 0).to_numpy(zero_copy_only=False)
        step = max(16, CELLS // (block.sharing.n_nodes + len(block.items)))
        for at in range(0, len(n), step):
            to = min(at + step, len(n))
            part = slice(ends[at], ends[to])
            scores = block.sharing.scores(row[part] - at, term[part], value[part], to - at)
            slot, column = np.nonzero(scores >= self.least[:, None])
            self.merge(slot, scores[slot, column], unnamed[at + column], doc[at + column])

    def merge(self, slot: np.ndarray, score: np.ndarray, unnamed: np.ndarray, doc: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score = np.concatenate([self.slot, slot]), np.concatenate([self.score, score])
        unnamed = np.concatenate([self.unnamed, unnamed])
        doc = doc if self.doc is None else np.concatenate([self.doc, doc])
        order = np.lexsort((np.unique(doc, return_inverse=True)[1], unnamed, -score, slot))
        slot = slot[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = order[rank < self.top]
        full = np.flatnonzero(rank == self.top - 1)
        self.least[slot[full]] = score[order[full]]
        self.slot, self.score, self.unnamed, self.doc = slot[rank < self.top], score[keep], unnamed[keep], doc[keep]

    def table(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if len(self.slot):
            doc = pa.array(self.doc, schema.field("doc_id").type, mask=self.unnamed)
            slot = pa.array(self.slot, pa.int32())
            yield pa.record_batch([slot, self.block.items.take(slot), doc, pa.array(self.score)], schema=schema)


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``(doc_id, n, at, tf)`` of documents with terms: how many, and which of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(texts: pa.Array) -> pa.Array:
        known = shared.value
        sizes, at, tf, ends = [], [], [], [0]
        for text in texts.cast(pa.binary()):
            found = terms(text.as_py())
            counts = Counter(found)
            for word in counts.keys() & known.keys() if len(counts) > len(known) else counts:
                if word in known:
                    at.append(known[word])
                    tf.append(counts[word])
            sizes.append(len(found))
            ends.append(len(at))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (at, tf)]
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), *lists], ["n", "at", "tf"])

    found = F.arrow_udf(run, "struct<n:long,at:array<int>,tf:array<int>>")("text")
    return docs.select("doc_id", found.alias("v")).select("doc_id", "v.*").where("n > 0")


def _ranked(rows: DataFrame, by: list[str], top: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top)


def search_block(docs: DataFrame, items: DataFrame, ids: pa.Array, words: list[list[bytes]], top: int) -> DataFrame:
    """``(item_id, rank, doc_id, score)`` of one block of items, written."""
    spark = docs.sparkSession
    sharing = Sharing.mine(words)
    found = cut(vectors(docs, sharing.vocabulary), "term-counts")
    n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # as many rows as the block has terms
    df = found.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("df")).toArrow()
    weights = np.zeros(len(sharing.vocabulary), np.int64)
    for at, n in zip(df["at"].to_pylist(), df["df"].to_pylist(), strict=True):
        weights[at] = floor(1000 * log((2 * n_docs + 2) / (2 * n + 1)))
    block = spark.sparkContext.broadcast(Block(ids, sharing, weights, n_docs, n_terms))
    schema = StructType(
        [
            StructField("slot", IntegerType()),
            StructField("item_id", items.schema["item_id"].dataType),
            StructField("doc_id", docs.schema["doc_id"].dataType),
            StructField("score", LongType()),
        ]
    )
    kinds = pa.schema([("slot", pa.int32()), ("item_id", ids.type), ("doc_id", arrow_type(docs, "doc_id")), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(block.value, top)
        for batch in batches:
            best.add(batch)
        yield from best.table(kinds)

    mine = found.mapInArrow(run, schema)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part")
    some = _ranked(mine.select("*", part), ["slot", "part"], top)
    out = cut(_ranked(some, ["slot"], top).select("item_id", "rank", "doc_id", "score"), "ranked")
    block.destroy()
    drop(found)
    return out


def blocks(items: DataFrame, most: int = BLOCK_WORDS) -> Iterator[tuple[pa.Array, list[list[bytes]]]]:
    """Ids and terms of items, some at a time; the driver holds one block and one partition's rows."""
    kind = arrow_type(items, "item_id")
    ids, words, n = [], [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        ids.append(row.item_id)
        words.append(terms((row.text or "").encode()))
        n += len(words[-1])
        if n >= most:
            yield pa.array(ids, kind), words
            ids, words, n = [], [], 0
    if ids:
        yield pa.array(ids, kind), words


def search(docs: DataFrame, items: DataFrame, top: int = TOP, most: int = BLOCK_WORDS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``top`` documents, best first."""
    docs = docs.select("doc_id", "text")
    found = None
    for ids, words in blocks(items, most):
        one = search_block(docs, items, ids, words, top)
        found = one if found is None else found.unionByName(one)
    if found is None:
        ranked = docs.select("doc_id").limit(0).join(items.select("item_id").limit(0))
        found = ranked.select("item_id", F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    return found
