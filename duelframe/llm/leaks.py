"""Benchmark decontamination: windows as long as an item, by SimHash and then exactly.

Items of fewer than five words are too short for fingerprints: their words are
looked for in a row, anywhere in a text.

A null text, of a document or an item, has no words and matches nothing. Rows
with an equal doc_id are searched one by one; items with an equal item_id, of any
type, are matched each, and the best match counts. Other columns are not read. An
empty table on either side gives no matches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cached_property, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from duelframe.llm.common import arrow_type, cut, drop

SHINGLE = 5
SIMILARITY = 0.8
# Items edited down to the least similarity differ in about 10 bits, rarely in more than 15.
RADIUS = 19
BLOCKS = 5  # of 12 or 13 bits
BLOCK_ENDS = [64 * b // BLOCKS for b in range(BLOCKS + 1)]
ITEMS = 2048  # about so many of a benchmark are searched for at a time

_EDGES = b"\"'`.,;:!?()[]{}<>*#-_"
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                     0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case without punctuation at their ends."""
    found = [w.strip(_EDGES) for w in (text or "").lower().encode().split()]
    return [w for w in found if w]


def shingles(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """A hash of each five words, or ``width``, in a row; of all words where there are fewer."""
    n = len(hashes)
    width = min(width, n)
    with np.errstate(over="ignore"):
        mixed = np.zeros(n - width + 1 if n else 0, np.uint64)
        for k in range(width):
            mixed += hashes[k : n - width + 1 + k] * _FACTORS[k]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x7FB5D329728EA185)
        mixed ^= mixed >> np.uint64(27)
    return mixed


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def simhash(hashes: np.ndarray) -> int:
    ones = _bits(hashes).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def flips(width: int, most: int) -> np.ndarray:
    """All patterns of ``width`` bits with up to ``most`` bits set."""
    chosen = [bits for n in range(most + 1) for bits in combinations(range(width), n)]
    return np.array([sum(1 << b for b in bits) for bits in chosen], np.int64)


def block_keys(fps: np.ndarray, block: int) -> np.ndarray:
    """A block's number and value; the flipped bits are those of the value."""
    low, high = BLOCK_ENDS[block], BLOCK_ENDS[block + 1]
    value = (fps >> np.uint64(low)) & np.uint64((1 << high - low) - 1)
    return value.astype(np.int64) | block << 13


class Index:
    """Items by length in shingles, and by every value that a block of theirs may take.

    Of five blocks one has no more than a fifth of the differing bits. The
    items' values are listed with that many bits flipped, so a window within the
    radius finds the item at one of its own five values.

    ``having`` counts the distinct items of the whole benchmark that have a
    shingle, where they are several; without it these items are the whole.
    """

    def __init__(self, items: list[tuple[int, str]], having: dict[int, int] | None = None) -> None:
        self.words: dict[bytes, int] = {}
        listed = [(item_id, self.hashed(tokens(text))) for item_id, text in items]
        self.items = [(item_id, shingles(h)) for item_id, h in listed if len(h) >= SHINGLE]
        #: ids of shorter items by their number of words and these words' hash
        self.short: dict[int, dict[int, list]] = {}
        for item_id, h in listed:
            if 0 < len(h) < SHINGLE:
                key = int(shingles(h)[0])
                self.short.setdefault(len(h), {}).setdefault(key, []).append(item_id)
        if having is None:
            distinct = {frozenset(s.tolist()) for _, s in self.items}
            having = Counter(h for own in distinct for h in own)
        #: a shingle that several items have says less about each
        self.weights = {h: 1.0 / having.get(h, 1) for _, s in self.items for h in s.tolist()}
        #: what an item does not have weighs as much as its own shingles do on average
        self.foreign = [sum(self.weights[h] for h in s.tolist()) / len(s) for _, s in self.items]
        self.known = np.sort(np.array(list(self.weights), np.uint64))
        self.fps = np.array([simhash(s) for _, s in self.items], np.uint64)
        self.counts = [Counter(s.tolist()) for _, s in self.items]
        self.having: dict[int, set[int]] = {}
        for _, s in self.items:
            for h in s.tolist():
                self.having.setdefault(h, set()).add(len(s))
        lengths = np.array([len(s) for _, s in self.items], np.int64)
        keys, owners = [], []
        for block in range(BLOCKS):
            near = flips(BLOCK_ENDS[block + 1] - BLOCK_ENDS[block], RADIUS // BLOCKS)
            value = block_keys(self.fps, block)[:, None] ^ near
            keys.append((lengths[:, None] << 16 | value).ravel())
            owners.append(np.repeat(np.arange(len(self.items), dtype=np.int32), len(near)))
        none = np.zeros(0, np.int64)
        self.keys, self.owners = np.concatenate([none, *keys]), np.concatenate([none.astype(np.int32), *owners])
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.owners = self.keys[order], self.owners[order]
        # one bit for each value of the first 20 bits
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.known >> np.uint64(44)] = True

    def hashed(self, words: list[bytes]) -> np.ndarray:
        known = self.words
        if len(known) > 100_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxh64_intdigest(w)
        return np.array([known[w] for w in words], np.uint64)

    def similarity(self, window: Counter, k: int) -> float:
        """Common weight over all weight of two bags of shingles; only item ``k`` decides weights."""
        mine, both, all_ = self.counts[k], 0.0, 0.0
        for h in sorted(mine.keys() | window.keys()):
            weight = self.weights[h] if h in mine else self.foreign[k]
            both += weight * min(mine[h], window[h])
            all_ += weight * max(mine[h], window[h])
        return both / all_

    def search(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """Per item found ``(item_id, first word, words, similarity)``, by its best window.

        A window without a shingle of any item has similarity zero to all, so
        fingerprints are made of windows with one, of the lengths of its items. A
        text with fewer shingles than an item is compared with it as a whole.
        """
        hashes = self.hashed(tokens(text))
        short = self._short(hashes)
        found = shingles(hashes) if len(hashes) >= SHINGLE else hashes[:0]
        maybe = np.flatnonzero(self.filter[found >> np.uint64(44)]) if len(found) else found
        hits = [(i, h) for i in maybe.tolist() if (h := int(found[i])) in self.having]
        if not hits:
            return short
        starts: dict[int, set[int]] = {}
        for i, h in hits:
            for size in self.having[h]:
                last = max(0, len(found) - size)
                starts.setdefault(size, set()).update(range(max(0, i - size + 1), min(i, last) + 1))
        best: dict[int, tuple[float, int, int, int]] = {}
        for size, begin in starts.items():
            width = min(size, len(found))
            at, fps = self._windows(found, np.array(sorted(begin), np.int64), width)
            for w, k in self._near(fps, size):
                start = int(at[w])
                window = Counter(found[start : start + width].tolist())
                similarity = self.similarity(window, k)
                item_id = self.items[k][0]
                known = best.get(item_id)
                if similarity >= SIMILARITY and (known is None or (similarity, -start) > known[:2]):
                    best[item_id] = (similarity, -start, width)
        for item_id, at, width, similarity in short:
            if item_id not in best or best[item_id][0] < similarity:
                best[item_id] = (similarity, -at, width - SHINGLE + 1)
        return [
            (item_id, -at, width + SHINGLE - 1, similarity)
            for item_id, (similarity, at, width) in sorted(best.items(), key=lambda x: str(x[0]))
        ]

    def _short(self, hashes: np.ndarray) -> list[tuple[int, int, int, float]]:
        """Items of fewer than five words, where they occur first."""
        found = {}
        for width, known in self.short.items():
            if len(hashes) >= width:
                own = shingles(hashes, width)
                for at in np.flatnonzero(np.isin(own, np.fromiter(known, np.uint64, len(known)))).tolist():
                    for item_id in known[int(own[at])]:
                        found.setdefault(item_id, (item_id, at, width, 1.0))
        return sorted(found.values(), key=lambda x: str(x[0]))

    def _windows(
        self, found: np.ndarray, begin: np.ndarray, size: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """Starts and fingerprints of windows, from sums over stretches of the text."""
        fps = [np.zeros(0, np.uint64)]
        apart = np.diff(begin) > size
        long = np.arange(1, len(begin)) % 4096 == 0  # bounds what is summed at once
        for run in np.split(begin, np.flatnonzero(apart | long) + 1):
            if len(run):
                low, high = int(run[0]), int(run[-1]) + size
                sums = np.zeros((high - low + 1, 64), np.int32)
                np.cumsum(_bits(found[low:high]), axis=0, dtype=np.int32, out=sums[1:])
                ones = sums[run - low + size] - sums[run - low]
                bits = np.packbits(2 * ones > size, axis=1)
                fps.append(bits.view(">u8").ravel().astype(np.uint64))
        return begin, np.concatenate(fps)

    def _near(self, fps: np.ndarray, size: int) -> list[tuple[int, int]]:
        """``(window, item)`` within the radius, from the blocks' keys."""
        pairs = []
        for block in range(BLOCKS):
            keys = size << 16 | block_keys(fps, block)
            low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
            window = np.repeat(np.arange(len(fps)), high - low)
            within = np.arange(len(window)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
            item = self.owners[np.repeat(low, high - low) + within]
            close = np.bitwise_count(fps[window] ^ self.fps[item]) <= RADIUS
            pairs.append(np.stack([window[close], item[close]], axis=1))
        return [(int(w), int(k)) for w, k in np.unique(np.concatenate(pairs), axis=0)]


class Items:
    """A block of the benchmark; workers keep its index as long as they keep the broadcast."""

    def __init__(self, items: list[tuple[int, str]], having: dict[int, int]) -> None:
        self.items, self.having = items, having

    @cached_property
    def index(self) -> Index:
        return Index(self.items, self.having)

    def __getstate__(self) -> dict:
        return {"items": self.items, "having": self.having}


def _own(texts: pa.Array) -> pa.Array:
    """Each item's distinct shingles in order."""
    words: dict[bytes, int] = {}
    found = []
    for t in texts:
        listed = tokens(t.as_py())
        for w in set(listed).difference(words):
            words[w] = xxh64_intdigest(w)
        hashes = np.array([words[w] for w in listed], np.uint64)
        found.append(np.unique(shingles(hashes)).view(np.int64))
    return pa.array(found, pa.list_(pa.int64()))


def _weighed(benchmark: DataFrame) -> DataFrame:
    """``(item_id, text, shared)``: an item's shingles that several distinct items have, with their number.

    Items with the same shingles are one, whatever their ids, case or punctuation.
    """
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    own = F.arrow_udf(_own, "array<long>")("text")
    items = cut(items.withColumn("own", own), "benchmark")
    counted = items.select("own").distinct().select(F.explode("own").alias("shingle"))
    counted = counted.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    counted = cut(counted, "shared-shingles")
    each = items.select("item_id", "text", F.explode_outer("own").alias("shingle"))
    told = F.when(F.col("n").isNotNull(), F.struct("shingle", "n"))
    rows = each.join(counted, "shingle", "left").groupBy("item_id", "text")
    return rows.agg(F.collect_list(told).alias("shared"))


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """Blocks of about ``ITEMS`` items, however many the benchmark has; the driver holds one."""
    weighed = _weighed(benchmark)
    n = max(1, -(-weighed.count() // ITEMS))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("block")
    # in order, so that a block is read from its part of the files
    ordered = cut(weighed.select("*", place).repartitionByRange("block").sortWithinPartitions("block"), "benchmark")
    for block in range(n):
        rows = ordered.where(F.col("block") == block).orderBy("item_id", "text").collect()
        having = {m.shingle % (1 << 64): m.n for r in rows for m in r.shared}
        yield Items([(r.item_id, r.text) for r in rows], having)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, word, n_words, similarity)``: where documents hold items.

    The benchmark is searched for in blocks, each with an index of bounded size
    and in a pass of its own, whose matches are written; no document moves.
    """
    names = ("item_id", "word", "n_words", "similarity")
    kinds = (arrow_type(benchmark, "item_id"), pa.int64(), pa.int64(), pa.float64())
    kind = pa.list_(pa.struct(list(zip(names, kinds, strict=True))))
    named = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"array<struct<item_id:{named},word:long,n_words:long,similarity:double>>"

    def searched(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            index = shared.value.index
            for batch in batches:
                hits = [index.search(t.as_py()) for t in batch]
                yield pa.array([[dict(zip(names, m, strict=True)) for m in h] for h in hits], kind)

        found = docs.select("doc_id", F.explode(F.arrow_udf(run, schema)("text")).alias("m"))
        return cut(found.select("doc_id", "m.*"), "leaks")

    found = []
    for items in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        found.append(searched(shared))
        shared.destroy()
    return reduce(DataFrame.unionByName, found)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all columns; rows are not moved.

    What the blocks but the last leave is written before the next one is read.
    """

    def clean(shared: Broadcast) -> Column:
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            index = shared.value.index
            for batch in batches:
                yield pa.array([not index.search(t.as_py()) for t in batch], pa.bool_())

        return F.arrow_udf(run, "boolean")(F.col("text"))

    left, shared = docs, None
    for items in _blocks(benchmark):
        if shared is not None:
            before, left = left, cut(left.where(clean(shared)), "clean")
            shared.destroy()
            if before is not docs:
                drop(before)
        shared = docs.sparkSession.sparkContext.broadcast(items)
    return left.where(clean(shared))
