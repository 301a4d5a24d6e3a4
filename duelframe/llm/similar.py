"""Near copies by their five-word shingles: all pairs with a similarity of 0.8 are linked.

The rule of ``simhash`` stands, and texts whose sets of shingles have a Jaccard
similarity of at least ``SIMILARITY`` are linked as well, whatever their
fingerprints. Of two such sets the first fifths, in one order of all shingles,
have a shingle in common, so each set is placed at these only. How many they
must have in common follows from the sizes; what remains is compared exactly.
Any order gives the same links: frequent shingles of a sample come last, so that
few sets are placed at them.

Only shingles at which several groups meet are kept, and no two texts of a group
that is joined already are compared. Of each shingle's texts that with the fewest
rare shingles, which is nearest to what the others have in common, is compared
with the others there first, as long as this joins enough of them: a large group
of near copies becomes one so, and its texts aren't compared with each other. A
first shingle that no other set has is lost to any overlap: two texts of which
one has too many of them don't meet.

A null text is empty; a text without a word has no shingles and is linked by
its fingerprint only. A text of fewer than five words is one shingle. Rows with
an equal or null doc_id are linked each. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from duelframe.llm import simhash
from duelframe.llm.common import column, cut, drop
from duelframe.llm.leaks import shingles

# As whole numbers, so that no rounding decides: 4 / 5.
OF, IN = 4, 5
SAMPLE = 20_000  # documents whose shingles are counted for the order, a tenth at most
FREQUENT = 3  # documents of the sample
LAST = 100_000  # shingles that are put last, at most
KEYS = 1_000_000  # row numbers that are broadcast, at most; more are joined by a shuffle

_WORDS: dict[bytes, int] = {}


def shingle_set(text: str | None) -> np.ndarray:
    """The text's distinct shingles, sorted; 63 bits each."""
    words = (text or "").encode().lower().split()
    if len(_WORDS) > 100_000:
        _WORDS.clear()
    for w in set(words).difference(_WORDS):
        _WORDS[w] = xxh64_intdigest(w)
    found = shingles(np.array([_WORDS[w] for w in words], np.uint64))
    return np.unique(found >> np.uint64(1)).astype(np.int64)


def _arrays(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(
        pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))
    )


def _sets(text: str) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return _arrays([shingle_set(t.as_py()) for t in texts])

    return F.arrow_udf(run, "array<long>")(text)


def _frequent(docs: DataFrame) -> np.ndarray:
    """Shingles that several documents of a sample have."""
    share = min(0.1, SAMPLE / max(1, docs.count()))
    sample = docs.select("text").sample(share, 42).select(F.explode(_sets("text")).alias("shingle"))
    often = sample.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    rows = often.orderBy(F.desc("n"), "shingle").limit(LAST).collect()
    return np.sort(np.array([r.shingle for r in rows], np.int64))


def _known(text: str) -> Column:
    """The hash and the size of a text's set."""

    def run(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(t.as_py()) for t in texts]
        same = [np.int64(xxh64_intdigest(own.tobytes()) >> 1) for own in sets]
        sizes = pa.array([len(own) for own in sets], pa.int32())
        return pa.StructArray.from_arrays([pa.array(same, pa.int64()), sizes], ["same", "size"])

    return F.arrow_udf(run, "struct<same:long,size:int>")(text)


def _placed(text: str, last: np.ndarray) -> Column:
    """The first shingles of a text's set, where ``last`` come last, and how many aren't of ``last``."""

    def run(texts: pa.Array) -> pa.Array:
        firsts, rare = [], []
        for t in texts:
            own = shingle_set(t.as_py())
            if len(own):
                at = np.minimum(np.searchsorted(last, own), max(len(last) - 1, 0))
                late = last[at] == own if len(last) else np.zeros(len(own), bool)
                own = np.concatenate([own[~late], own[late]])
            firsts.append(own[: _first(len(own))])
            rare.append(int((~late).sum()) if len(own) else 0)
        return pa.StructArray.from_arrays([_arrays(firsts), pa.array(rare, pa.int32())], ["first", "rare"])

    return F.arrow_udf(run, "struct<first:array<long>,rare:int>")(text)


def _first(n: int) -> int:
    """Of two similar sets these many first shingles have one in common."""
    return n - -(-OF * n // IN) + 1 if n else 0


def _those(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose ``n`` is among written keys; whole rows move only where the keys are many."""
    few = keys.limit(KEYS + 1).count() <= KEYS
    return rows.join(F.broadcast(keys) if few else keys, "n", "left_semi")


def _similar_sizes(a: str, b: str) -> str:
    return f"{IN} * {a} >= {OF} * {b} AND {IN} * {b} >= {OF} * {a}"


def _room(a: str, most_a: str, b: str, most_b: str) -> str:
    """Whether sets of these sizes are similar if they have in common what both can have at most."""
    return f"{OF + IN} * least({most_a}, {most_b}) >= {OF} * ({a} + {b})"


def _enough(met: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` that meet as often as similar ones do, from ``a, b, _a, _b`` with sizes.

    Of two sets whose first shingles end at the same or an earlier place, the
    common ones among them are all those up to there; the remaining overlap is
    no more than what the set has left.
    """
    both = met.groupBy("a", "b", "_a", "_b").agg(F.count("*").alias("common"))
    whole = f"({OF} * (_a + _b) + {OF + IN - 1}) div {OF + IN}"
    most = f"({OF} * greatest(_a, _b) + {IN - 1}) div {IN}"
    return both.where(f"common >= {whole} - {most} + 1").select("a", "b")


def first_pairs(mixed: DataFrame) -> DataFrame:
    """Candidates of each shingle's first text with the others, from ``shingle, n, size, most, root, first``."""
    near = _similar_sizes("size", "first.size") + " AND " + _room("size", "most", "first.size", "first.most")
    met = mixed.where("root <> first.root AND " + near)
    return _enough(met.selectExpr("first.n AS a", "n AS b", "first.size AS _a", "size AS _b"))


def all_pairs(mixed: DataFrame) -> DataFrame:
    """Candidates of any two texts at a shingle that aren't joined yet: all similar ones, and few others."""
    one = mixed.selectExpr("shingle", "n AS a", "size AS _a", "most AS _most", "root AS _r")
    two = mixed.selectExpr("shingle", "n AS b", "size AS _b", "most AS _least", "root AS _s")
    near = _similar_sizes("_a", "_b") + " AND " + _room("_a", "_most", "_b", "_least")
    return _enough(one.join(two, "shingle").where("a < b AND _r <> _s AND " + near))


def _verified(marked: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between the fingerprints of written pairs that are similar, written."""
    needed = cut(pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct(), "needed")
    own = cut(_those(marked, needed).select("n", "fp", _sets("text").alias("own")), "shingle-sets")
    one = own.select(F.col("n").alias("a"), F.col("fp").alias("_a"), F.col("own").alias("_own"))
    two = own.select(F.col("n").alias("b"), F.col("fp").alias("_b"), F.col("own").alias("_other"))
    common = F.size(F.array_intersect("_own", "_other"))
    every = F.size("_own") + F.size("_other") - common
    near = pairs.join(one, "a").join(two, "b").where(common * IN >= every * OF)
    out = cut(near.select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "similar-links")
    drop(needed, own)
    return out


def _meeting(marked: DataFrame, last: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """``(n, fp, size, rare, most)`` of one text for each set, and ``(shingle, n)`` of shingles where several meet.

    ``most`` is what a set can have in common with any other: all but the first
    shingles that it has alone. Sets whose first shingles no other has are left out.
    """
    alike = cut(marked.where("size > 0").groupBy("same").agg(F.min("n").alias("n")).select("n"), "alike")
    placed = _those(marked, alike).select("n", "fp", "size", _placed("text", last).alias("_placed"))
    some = cut(placed.select("n", "fp", "size", "_placed.*"), "first-shingles")
    at = some.select("n", F.explode("first").alias("shingle"))
    several = at.groupBy("shingle").agg(F.count("*").alias("_times")).where("_times > 1").select("shingle")
    several = cut(several, "several")
    shared = cut(at.join(several, "shingle").select("shingle", "n"), "shared-shingles")
    met = shared.groupBy("n").agg(F.count("*").alias("_met"))
    alone = F.size("first") - F.col("_met")
    most = (F.col("size") - alone).cast("int").alias("most")
    texts = some.join(met, "n").select("n", "fp", "size", "rare", most)
    texts = cut(texts, "texts")
    drop(alike, some, several)
    return texts, shared


def _mixed(texts: DataFrame, shared: DataFrame, roots: DataFrame) -> DataFrame:
    """``(shingle, n, size, most, root, first)`` where several groups meet, with the first text there; written."""
    root = F.coalesce("root", "fp").alias("root")
    named = cut(texts.join(roots, F.col("fp") == F.col("node"), "left").select("n", "size", "rare", "most", root), "named")
    rows = cut(shared.join(named, "n"), "shingle-texts")
    first = F.min(F.struct("rare", "n", "size", "most", "root")).alias("first")
    least, most = F.min("root").alias("_least"), F.max("root").alias("_most")
    met = rows.groupBy("shingle").agg(first, least, most).where("_least <> _most")
    met = cut(met.select("shingle", "first"), "meeting")
    out = cut(rows.join(met, "shingle"), "mixed-shingles")
    drop(named, rows, met)
    return out


def similar_roots(marked: DataFrame, near: DataFrame, last: np.ndarray) -> DataFrame:
    """``(node, root)`` of fingerprints: what the links ``near`` join, and similar texts beyond them.

    ``marked`` has ``n, fp, text, same, size``. Texts with the same set are
    compared once.
    """
    firsts = marked.where("size > 0").groupBy("same").agg(F.min("fp").alias("m"))
    firsts = cut(firsts, "same-sets")
    equal = marked.where("size > 0").select("same", "fp").distinct().join(firsts, "same").where("fp <> m")
    links = [near.select("a", "b"), equal.selectExpr("fp AS a", "m AS b").distinct()]
    joined = lambda: simhash.components(reduce(DataFrame.unionByName, links))
    roots = joined()
    texts, shared = _meeting(marked, last)
    drop(firsts)
    links = [roots.selectExpr("node AS a", "root AS b")]
    before = None
    while (n := (mixed := _mixed(texts, shared, roots)).count()) and (before is None or 2 * n <= before):
        before = n
        pairs = cut(first_pairs(mixed), "first-pairs")
        links.append(_verified(marked, pairs))
        roots = joined()
        drop(mixed, pairs)
    if n:
        pairs = cut(all_pairs(mixed), "similar-pairs")
        links.append(_verified(marked, pairs))
        roots = joined()
        drop(pairs)
    drop(texts, shared, mixed, *links[1:])
    return roots


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, that with the smallest doc_id, with all its columns."""
    row = F.struct(*[column(c) for c in docs.columns]).alias("_row")
    packed = simhash.fingerprints(docs.select(row, "doc_id", "text"))
    packed = packed.withColumn("_set", _known("text"))
    marked = packed.select("_row", "doc_id", "fp", "_set.*", F.monotonically_increasing_id().alias("n"))
    marked = cut(marked, "fingerprints")
    near = simhash.links(marked.select("fp").distinct())
    texts = marked.select("n", "fp", F.col("_row").getField("text").alias("text"), "same", "size")
    roots = similar_roots(texts, near, _frequent(docs))
    first = simhash.first_rows(marked.select("doc_id", "fp", "n"), roots)
    first = cut(first.select(F.col("least.n").alias("n")).distinct(), "kept-rows")
    return _those(marked, first).select("_row.*")
