"""Quality classifier: boosted trees over a document's statistics, fitted on histograms.

The fit works on at most ``SAMPLE`` labelled texts, those whose keys have the
least hashes; only their statistics reach the driver. Each tree is grown level by
level: every statistic is cut into at most ``BINS`` bins, and gradients are added
up per node and bin. Trees are complete and lie in flat arrays, so that a batch
of texts goes down all of them at once.

A null text is scored like an empty one. Rows with an equal doc_id are scored
one by one. A null doc_id has no label and isn't held out. Labels other than 0
and 1 and null teach nothing; where no label is left all scores are 0.5, and with
one label alone that label. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000  # labelled texts that the fit may use
HELD_OUT = 5  # one in so many is never learned from
EVEN = 0.3  # scores from here on are predicted 1
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
SHRINK = 1.0  # added to a leaf's curvature
LEAST = 5.0  # curvature-weighted rows that a child needs, in quarters

STATISTICS = (
    "words",
    "chars_a_word",
    "distinct_words",
    "commonest_word",
    "repeated_triples",
    "longest_word",
    "capitals",
    "digits",
    "blanks",
    "symbols",
    "stops",
    "other_marks",
    "beyond_ascii",
    "entropy",
    "words_with_symbols",
    "lines",
    "repeated_lines",
    "words_a_line",
    "lines_ended",
)

_KIND = np.zeros(256, np.int64)
for _n, _chars in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b"#$%&*|<>", b".,;:!?", b"'\"()-/_+=@[]{}~^`\\"), 1
):
    _KIND[list(_chars)] = _n
_KIND[128:] = 7


def statistics(text: str | None) -> list[float]:
    """The text's ``STATISTICS``; shares are of words, bytes or lines."""
    raw = (text or "").encode()
    size = len(raw) or 1
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, counts, minlength=8) / size
    used = counts[counts > 0] / size
    words = raw.split()
    n = len(words) or 1
    known = Counter(words)
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    ended = sum(x.rstrip()[-1:] in b".!?" for x in lines)
    marked = sum(c for w, c in known.items() if w.translate(None, b"#$%&*|<>") != w)
    return [
        log1p(len(words)),
        sum(len(w) * c for w, c in known.items()) / n,
        len(known) / n,
        max(known.values(), default=0) / n,
        1 - len(triples) / max(len(words) - 2, 1),
        log1p(max(map(len, known), default=0)),
        *kinds[1:8].tolist(),
        float(-(used * np.log2(used)).sum()),
        marked / n,
        log1p(len(lines)),
        1 - len(set(lines)) / max(len(lines), 1),
        log1p(len(words) / max(len(lines), 1)),
        ended / max(len(lines), 1),
    ]


def _table(texts: pa.Array) -> np.ndarray:
    rows = [statistics(t.as_py()) for t in texts]
    return np.array(rows, np.float64).reshape(len(rows), len(STATISTICS))


@dataclass(frozen=True)
class Forest:
    """Complete trees: inner node ``k`` of a tree goes on at ``2k + 1`` or ``2k + 2``."""

    base: float
    feature: np.ndarray  # trees by inner nodes
    edge: np.ndarray  # larger values go to the second child
    leaf: np.ndarray  # trees by leaves

    def scores(self, x: np.ndarray) -> np.ndarray:
        """All rows through all trees, a level at a time."""
        depth = (self.leaf.shape[1] if self.leaf.size else 1).bit_length() - 1
        tree = np.arange(len(self.leaf))
        node = np.zeros((len(x), len(tree)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.edge[tree, node])
        total = self.base + self.leaf[tree, node - ((1 << depth) - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -700, 700)))

    @classmethod
    def constant(cls, share: float, depth: int = DEPTH) -> Forest:
        base = {0.0: -700.0, 1.0: 700.0}.get(share) or float(np.log(share / (1 - share)))
        none = np.zeros((0, (1 << depth) - 1))
        return cls(base, none.astype(np.int64), none, np.zeros((0, 1 << depth)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
        """Logistic loss, second order; a node without a gain sends all rows to its first child."""
        if len(np.unique(y)) < 2:
            return cls.constant(float(y[0]) if len(y) else 0.5, depth)
        edges = [bin_edges(c) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        out = cls.constant(float(y.mean()), depth)
        total = np.full(len(y), out.base)
        feature, edge, leaf = [], [], []
        for _ in range(trees):
            chance = 1 / (1 + np.exp(-total))
            one = grow(binned, chance - y, chance * (1 - chance), edges, depth)
            feature.append(one[0])
            edge.append(one[1])
            leaf.append(one[2] * rate)
            total += leaf[-1][one[3]]
        return cls(out.base, np.stack(feature), np.stack(edge), np.stack(leaf))


def bin_edges(values: np.ndarray) -> np.ndarray:
    """At most ``BINS - 1`` values; a bin ends with its edge."""
    found = np.unique(np.quantile(values, np.arange(1, BINS) / BINS, method="lower"))
    return found[found < values.max()]


def split_gains(grad: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """The gain of a split after each bin, from sums per ``(node, feature, bin)``."""
    g, h = grad.cumsum(axis=2), curve.cumsum(axis=2)
    whole_g, whole_h = g[:, :, -1:], h[:, :, -1:]
    gain = g**2 / (h + SHRINK) + (whole_g - g) ** 2 / (whole_h - h + SHRINK) - whole_g**2 / (whole_h + SHRINK)
    small = (h < LEAST / 4) | (whole_h - h < LEAST / 4)
    return np.where(small, -np.inf, gain)


def grow(
    binned: np.ndarray, grad: np.ndarray, curve: np.ndarray, edges: list[np.ndarray], depth: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree: ``(feature, edge, leaf, each row's leaf)``."""
    n, width = binned.shape
    feature = np.zeros((1 << depth) - 1, np.int64)
    edge = np.full((1 << depth) - 1, np.inf)
    node = np.zeros(n, np.int64)  # within its level
    for level in range(depth):
        nodes = 1 << level
        at = ((node[:, None] * width + np.arange(width)) * BINS + binned).ravel()
        sums = [
            np.bincount(at, np.repeat(v, width), nodes * width * BINS).reshape(nodes, width, BINS) for v in (grad, curve)
        ]
        gains = split_gains(*sums).reshape(nodes, -1)
        best = gains.argmax(axis=1)
        f, b = best // BINS, best % BINS
        works = gains[np.arange(nodes), best] > 1e-9
        first = nodes - 1
        feature[first : first + nodes] = np.where(works, f, 0)
        for k in np.flatnonzero(works):
            edge[first + k] = edges[f[k]][b[k]]
        beyond = works[node] & (binned[np.arange(n), f[node]] > b[node])
        node = 2 * node + beyond
    sums = [np.bincount(node, v, 1 << depth) for v in (grad, curve)]
    return feature, edge, -sums[0] / (sums[1] + SHRINK), node


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def sample_table(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the sample, in the order of the keys' hashes.

    ``labels`` is ``(doc_id, label)``. Its keys go to the texts, so texts aren't moved.
    """
    fit = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    hashed = fit.select("doc_id", "label").distinct().withColumn("h", F.xxhash64("doc_id", F.lit("sample")))
    keys = hashed.orderBy("h", "label").limit(sample)
    stats = F.arrow_udf(lambda t: pa.array(list(_table(t)), pa.list_(pa.float64())), "array<double>")("text")
    found = docs.select("doc_id", "text").join(F.broadcast(keys), "doc_id").select("h", "label", stats.alias("x"))
    got = found.orderBy("h", "label", "x").limit(sample).toArrow()
    x = np.array(got["x"].to_pylist(), np.float64).reshape(-1, len(STATISTICS))
    return x, np.array(got["label"].to_pylist(), np.float64)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """A fit on labels ``(doc_id, label)``, none of which is held out."""
    return Forest.fit(*sample_table(docs, labels, sample))


def score(docs: DataFrame, model: Forest) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(_table(texts)))

    found = docs.select("doc_id", F.arrow_udf(run, "double")("text").alias("score"))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= EVEN).cast("int").alias("predicted"),
    )
