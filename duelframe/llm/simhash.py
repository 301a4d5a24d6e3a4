"""SimHash near-dedup: fingerprints are linked by way of their counts of bits.

A fingerprint is mapped to its counts of set bits in 32 segments of two bits.
The Manhattan distance of two such points is no more than the fingerprints'
Hamming distance, so a pair within the radius lies within it on the grid too.
The segments form blocks, of which the radius can touch no more than itself:
such a pair agrees on all other blocks, and meets in the cell of some choice of
them. Points that meet and lie within the radius on the grid are then compared
exactly.

A null text is empty; texts without a word have the fingerprint zero. A null
doc_id is linked like others, and is no component's name unless all are null.
Rows with an equal doc_id are linked each. Other columns are not read. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from duelframe.llm.common import column, cut, drop

SEED = 42
BLOCKS = 6
SHARED_BLOCKS = 3  # blocks less the radius

# A cell with more fingerprints is worked on in parts, two at a time.
PART = 8192


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The majority of the hashes' bits; each shingle counts as often as it occurs."""
    words = (text or "").encode().lower().split()  # lower-cases and splits at ASCII only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashes = np.array([xxh64_intdigest(g, SEED) for g in grams], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """Add ``fp``: the fingerprint's 64 bits as a signed number."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            bits = np.array([fingerprint(t.as_py(), shingle) for t in batch], np.uint64)
            yield pa.array(bits.view(np.int64))

    return docs.withColumn("fp", F.arrow_udf(run, "long")(text))


def cells(bits: np.ndarray) -> np.ndarray:
    """The grid cells of each fingerprint: one for each choice of blocks."""
    pairs = np.uint64(0x5555555555555555)
    counts = bits - ((bits >> np.uint64(1)) & pairs)  # of each two bits, 0 to 2
    blocks = [np.zeros(len(bits), np.int64) for _ in range(BLOCKS)]
    for segment in range(32):
        digit = (counts >> np.uint64(2 * segment)) & np.uint64(3)
        block = segment * BLOCKS // 32
        blocks[block] = blocks[block] * 3 + digit.astype(np.int64)
    wide = 3**6
    chosen = list(combinations(range(BLOCKS), SHARED_BLOCKS))
    found = np.empty((len(bits), len(chosen)), np.int64)
    for k, choice in enumerate(chosen):
        key = np.full(len(bits), k, np.int64)
        for block in choice:
            key = key * wide + blocks[block]
        found[:, k] = key
    return found


def unary(bits: np.ndarray) -> np.ndarray:
    """The point on the grid: as many low bits set in each segment as the segment has.

    Two points' Manhattan distance is the number of bits that differ.
    """
    low = np.uint64(0x5555555555555555)
    shifted = bits >> np.uint64(1)
    return ((bits | shifted) & low) | (((bits & shifted) & low) << np.uint64(1))


def within(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Pairs within the radius: by their points' Manhattan distance, then exactly."""
    near = np.bitwise_count(unary(a) ^ unary(b)) <= radius
    if near.any():
        a, b = np.broadcast_arrays(a, b)
        near[near] = np.bitwise_count(a[near] ^ b[near]) <= radius
    return near


def cell_links(cell: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest ``(a, b)`` that joins what is within the radius in each cell.

    ``cell`` is sorted. Small cells compare neighbours at every distance at once.
    In a large cell, what a fingerprint reaches leaves the others, so that a
    dense cell shrinks with each step.
    """
    a, b = [], []
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.array([], int)
    size = np.diff(np.r_[first, len(cell)])
    bits = fps.view(np.uint64)
    small = np.repeat(size <= 32, size)
    for step in range(1, min(32, size.max(initial=0))):
        i = np.flatnonzero(small[:-step] & (cell[:-step] == cell[step:]))
        near = within(bits[i], bits[i + step], radius)
        a.append(fps[i[near]])
        b.append(fps[i[near] + step])
    for at, n in zip(first[size > 32], size[size > 32], strict=True):
        left = bits[at : at + n]
        while len(left):
            root, ahead, left = left[0], [left[0]], left[1:]
            while ahead and len(left):
                near = within(left, ahead.pop(), radius)
                reached = left[near]
                ahead.extend(reached)
                a.append(np.full(len(reached), root).view(np.int64))
                b.append(reached.view(np.int64))
                left = left[~near]
    none = np.array([], np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(points: DataFrame, radius: int = 3) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp``, enough to join all within the radius.

    Cells with more than ``PART`` fingerprints are split into parts of about that
    size, and every two parts are one task's group: no fingerprint is left out,
    and no group grows with the cell.
    """
    if not 0 <= radius <= BLOCKS - SHARED_BLOCKS:
        raise ValueError(f"a radius up to {BLOCKS - SHARED_BLOCKS} is guaranteed")

    def spread(fps: pa.Array) -> pa.Array:
        found = cells(fps.to_numpy(zero_copy_only=False).view(np.uint64))
        ends = pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(found.ravel()))

    spread = F.arrow_udf(spread, "array<long>")
    placed = points.select("fp", F.explode(spread("fp")).alias("cell"))
    crowded = placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > PART)
    # written, as few or none are known to be few then
    crowded = cut(crowded.select("cell", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "crowded")
    parted = placed.join(crowded, "cell", "left").withColumn(
        "part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("fp"), F.col("parts")))
    )
    pair = F.struct(F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    others = F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))
    grouped = parted.select("fp", "cell", "part", F.explode(others).alias("other")).select(
        "fp", "cell", F.when(F.col("part").isNotNull(), pair).alias("pair")
    )
    grouped = grouped.withColumn(
        "cell", F.when(F.col("pair").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", "pair"))
    ).select("fp", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({"fp": pa.array([], pa.int64()), "cell": pa.array([], pa.int64())})
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])])
            cell = held["cell"].to_numpy()
            whole = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            if whole:  # the last cell may go on in the next batch
                yield linked(held.slice(0, whole))
                held = held.slice(whole)
        yield linked(held)

    def linked(rows: pa.Table) -> pa.RecordBatch:
        a, b = cell_links(rows["cell"].to_numpy(), rows["fp"].to_numpy(), radius)
        return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sorted_cells = grouped.repartition("cell").sortWithinPartitions("cell", "fp")
    return sorted_cells.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node that each node is joined with.

    Alternates two steps until only stars are left: every node's larger
    neighbours, and then its smaller ones, are linked to the smallest node it
    sees. A node with very many links is joined as rows, never gathered.
    """

    def all_stars(links: DataFrame) -> bool:
        """Whether each node has one link to a smaller one, or only links to larger ones."""
        up = F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        down = F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        ends = links.select(F.explode(F.array(up, down)).alias("end")).select("end.*")
        seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return not seen.agg(F.max(F.expr("up + down > 1 AND up > 0"))).first()[0]

    def stars(links: DataFrame, large: bool) -> DataFrame:
        """From rows (a, b): b's and a's smallest neighbour."""
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        # written, as a side still grouped by the key would keep a hub from being split
        least = cut(least.select("a", F.least("a", "m").alias("m")), "least")
        to = links.join(least, "a")
        to = to.where("b > a").select("b", "m") if large else to.select("b", "m").unionByName(
            least.select(F.col("a").alias("b"), "m")
        )
        out = cut(to.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links")
        drop(least)
        return out

    greater, lesser = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = cut(edges.where("a <> b").select(greater, lesser).distinct(), "links")
    while not all_stars(edges):
        half = stars(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), True)
        drop(edges)
        edges = stars(half, False)
        drop(half)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def labels(marked: DataFrame, radius: int) -> DataFrame:
    """``(fp, least)``: the first row of each fingerprint's component."""
    return first_rows(marked, components(links(marked.select("fp").distinct(), radius)))


def first_rows(marked: DataFrame, roots: DataFrame) -> DataFrame:
    """``(fp, least)``: the first row of each fingerprint's component in ``roots``.

    ``marked`` has ``doc_id, fp, n``, where ``n`` numbers the rows. Texts with the
    same fingerprint are one point, whatever their number. Null doc_ids come last.
    """
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "n")
    points = marked.groupBy("fp").agg(F.min(row).alias("least"))
    named = points.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = cut(named, "roots")
    names = cut(named.groupBy("root").agg(F.min("least").alias("least")), "names")
    return named.drop("least").join(names, "root").select("fp", "least")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every document."""
    marked = fingerprints(docs.select("doc_id", "text"), shingle).select("doc_id", "fp")
    marked = cut(marked.withColumn("n", F.monotonically_increasing_id()), "fingerprints")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(labels(marked, radius), "fp").select(
        "doc_id", shown.alias("fingerprint"), F.col("least.doc_id").alias("component_id")
    )


def keep_first(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component, that with the smallest doc_id, with all its columns.

    The rows are numbered and written with their fingerprints, so each is read
    for its text once, and full repeats of a row are told apart.
    """
    row = F.struct(*[column(c) for c in docs.columns]).alias("_row")
    packed = fingerprints(docs.select(row, "doc_id", "text"), shingle)
    marked = packed.select("_row", "doc_id", "fp", F.monotonically_increasing_id().alias("n"))
    marked = cut(marked, "fingerprints")
    first = labels(marked.select("doc_id", "fp", "n"), radius)
    first = first.select(F.col("least.n").alias("n")).distinct()
    return marked.join(first.hint("shuffle_hash"), "n", "left_semi").select("_row.*")
