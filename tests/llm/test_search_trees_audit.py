"""Ranked search, boosted trees and the filter audit against plain Python on small tables."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelframe.llm import audit, search, trees

# --- ranked search ---------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(SMALL))


def plain_search(docs, items, top):
    counted = [(d, Counter(plain_terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    found = Counter()
    for item, text in items:
        scored = []
        for d, c in counted:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = 0
            for t in plain_terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score:
                scored.append((-score, d is None, d))
        for rank, (score, _, d) in enumerate(sorted(scored, key=lambda x: (*x[:2], x[2] or 0))[:top], 1):
            found[item, rank, d, -score] += 1
    return found


@pytest.fixture(scope="module")
def searched():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcDEÉß9ñ", k=rng.randint(1, 4))) for _ in range(60)]
    prose = lambda n: rng.choice([" ", "-", "_\n", "\x7f"]).join(rng.choices(words, k=n))
    docs = [(k, prose(rng.choice([1, 5, 30, 200]))) for k in range(150)]
    docs += docs[:6] + [(900 + k, docs[3][1]) for k in range(30)]  # repeated rows and ties
    docs += [(None, docs[3][1]), (None, None), (500, None), (501, ""), (502, " .,;"), (503, prose(40_000))]
    frame = prose(12)
    items = [(k, prose(rng.randint(1, 25))) for k in range(25)] + [(100 + k, frame + " " + prose(3)) for k in range(8)]
    items += items[:2] + [(None, prose(3)), (60, None), (61, " "), (62, "nowhere else"), (63, "a a a A")]
    return docs, items


@pytest.mark.parametrize(("most", "cells"), [(1 << 17, 1 << 22), (40, 300)])
def test_ranked_documents_are_those_of_a_full_search(spark, searched, most, cells, monkeypatch):
    monkeypatch.setattr(search, "CELLS", cells)
    docs, items = searched
    table = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, slot string, n int")
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int").repartition(3)
    got = search.search(table.repartition(5), asked, 20, most)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain_search(docs, items, 20)


def test_search_in_tables_without_rows_and_with_names_as_keys(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two"), ("c", "two")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "ONE")], "item_id string, text string")
    assert [tuple(r)[:3] for r in search.search(docs, items).orderBy("rank").collect()] == [
        ("q", 1, "a"), ("q", 2, "b"), ("q", 3, None)
    ]
    assert search.search(docs.limit(0), items).count() == 0
    none = search.search(docs, items.limit(0))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_what_items_share_is_summed_once():
    items = [x.split() for x in ("a b c d", "a b c e", "a b f f", "", "a b c d")]
    items = [[w.encode() for w in x] for x in items]
    sharing = search.Sharing.mine(items)
    assert sharing.n_sets == 5  # ab, c, d, e, ff
    assert sharing.n_nodes == 1 + 1 + 2 + 2  # nothing; ab; abc, abff; abcd, abce
    assert sharing.ends[0] == sharing.ends[4] and sharing.ends[3] == 0
    rng = np.random.default_rng(1)
    row, term = np.divmod(np.flatnonzero(rng.random((7, len(sharing.vocabulary))) < 0.6), len(sharing.vocabulary))
    value = rng.integers(1, 1000, len(row))
    want = np.zeros((len(items), 7), int)
    for slot, words in enumerate(items):
        for r, t, v in zip(row, term, value, strict=True):
            want[slot, r] += v * sum(sharing.vocabulary[w] == t for w in words)
    assert (sharing.scores(row, term, value, 7) == want).all()


# --- quality classifier ----------------------------------------------------------------


def test_gains_and_splits_are_those_of_all_cuts():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 3)), 1)
    x[:, 2] = 1.0  # one value: no cut
    grad, curve = rng.normal(size=400), rng.uniform(0.05, 0.25, 400)
    edges = [trees.bin_edges(c) for c in x.T]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], axis=1)
    assert all((binned[:, f] > b).tolist() == (x[:, f] > e).tolist() for f in range(3) for b, e in enumerate(edges[f]))
    feature, edge, leaf, at = trees.grow(binned, grad, curve, edges, 2)

    def best(rows):
        part = lambda keep: grad[keep].sum() ** 2 / (curve[keep].sum() + trees.SHRINK)
        found = []
        for f in range(3):
            for e in edges[f]:
                low, high = rows & (x[:, f] <= e), rows & (x[:, f] > e)
                if min(curve[low].sum(), curve[high].sum()) >= trees.LEAST / 4:
                    found.append((part(low) + part(high) - part(rows), -f, -e))
        return max(found)

    rows = np.ones(400, bool)
    gain, f, e = best(rows)
    assert (feature[0], edge[0]) == (-f, pytest.approx(-e))
    for child, side in ((1, x[:, feature[0]] <= edge[0]), (2, x[:, feature[0]] > edge[0])):
        gain, f, e = best(rows & side)
        assert (feature[child], edge[child]) == (-f, pytest.approx(-e))
    for k in range(4):
        assert leaf[k] == pytest.approx(-grad[at == k].sum() / (curve[at == k].sum() + trees.SHRINK))


def test_flat_trees_give_what_a_walk_gives():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(600, 5)), rng.random(600)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3) ^ (y < 0.05)).astype(float)
    forest = trees.Forest.fit(x, y, trees=12, depth=3)
    for row, score in zip(x[:80], forest.scores(x[:80]), strict=True):
        total = forest.base
        for feature, edge, leaf in zip(forest.feature, forest.edge, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > edge[node] else 1)
            total += leaf[node - len(feature)]
        assert score == pytest.approx(1 / (1 + math.exp(-total)))
    right = (forest.scores(x) > 0.5) == (y > 0)
    assert right.mean() > 0.9
    assert trees.Forest.fit(x[:0], y[:0]).scores(x[:2]).tolist() == [0.5, 0.5]
    for only in (0.0, 1.0):
        assert trees.Forest.fit(x[:9], np.full(9, only)).scores(x[:1])[0] == pytest.approx(only)


def test_held_out_quality(spark):
    """Texts that are not learned from are told apart, whatever their language or key."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklé", k=rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for k in range(900):
        text = ". ".join(" ".join(rng.choices(words, k=rng.randint(5, 15))).capitalize() for _ in range(rng.randint(1, 20)))
        if bad := k % 4 == 0:
            text = rng.choice([text.upper(), " ".join(w + rng.choice(["$$$", "###", ""]) for w in text.split()), (text[:40] + " ") * 9])
        rows.append((k, text, "x", 0))
        labels.append((k, None if k % 11 == 0 else 2 if k % 13 == 0 else int(not bad)))
    labels += [labels[1], (None, 1), (5000, 0)]
    rows += [(None, rows[0][1], "", 1), (2000, None, "", 1), (2001, "", "", 1), (2002, rows[1][1] * 3000, "", 1), rows[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, score int")
    known = spark.createDataFrame(labels, "doc_id long, label int")
    got = trees.score(docs, trees.learn(docs, known)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    by_id = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    out = [r for r in got if r.held_out and (r.doc_id or 9999) < 900]
    assert len(out) > 100 and sum(r.predicted == (r.doc_id % 4 > 0) for r in out) / len(out) > 0.97
    assert by_id[2000].score == by_id[2001].score
    # a held-out label changes nothing
    flip = F.when(trees.held_out(F.col("doc_id")), 1 - F.col("label")).otherwise(F.col("label"))
    again = trees.score(docs, trees.learn(docs.repartition(7), known.withColumn("label", flip)))
    assert {(r.doc_id, r.score) for r in again.collect()} == {(r.doc_id, r.score) for r in got}
    assert trees.score(docs.limit(0), trees.learn(docs.limit(0), known.limit(0))).count() == 0
    assert {r.score for r in trees.score(docs, trees.learn(docs, known.limit(0))).collect()} == {0.5}


# --- filter audit ----------------------------------------------------------------------


def plain_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    order = lambda d: (d is None, d or 0)
    least = {}
    for d, t, _ in docs:
        least[t or ""] = min(least.get(t or "", (True, 0)), order(d))
    parts = defaultdict(list)
    for d, t, source in docs:
        text = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(ws) < 50:
            fails.add("A")
        if 100 * len(set(ws)) < 65 * len(ws):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if order(d) > least[text]:
            fails.add("E")
        parts[source or ""].append((fails, d in good, d in toxic))
    found = {}
    for part, rows in parts.items():
        shapley = Counter()
        for o in itertools.permutations("ABCDE"):
            left = rows
            for step, x in enumerate(o, 1):
                gone = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                failing = sum(x in r[0] for r in rows)
                found[part, "".join(o), step] = (
                    len(left), len(gone), failing - len(gone), sum(r[0] == {x} for r in rows),
                    sum(r[1] for r in gone), sum(r[2] for r in gone),
                )
                shapley[x] += len(gone)
        for o in itertools.permutations("ABCDE"):
            for step, x in enumerate(o, 1):
                found[part, "".join(o), step] += (shapley[x],)
    return found


@pytest.fixture(scope="module")
def audited_rows():
    rng = random.Random(12)
    words = [f"w{k}" for k in range(300)]
    texts = [None, "", "short", "A B C D", "x" * 9000]
    for k in range(40):
        text = " ".join(rng.sample(words, rng.randint(40, 90)))
        text = text if k % 3 else " ".join(rng.choices(words[:20], k=90))
        text = text.upper() if k % 5 == 0 else text
        texts.append(text + " #" if k % 4 == 0 else text)
    ids = list(range(1000, 1400))
    rng.shuffle(ids)
    docs = [(d, rng.choice(texts), rng.choice(["s0", "s0", "s1", None])) for d in ids]
    docs += [(d, texts[9], "s2") for d in range(1, 60)]  # a large group
    docs += [docs[0], docs[5], docs[5], (None, texts[9], "s0"), (None, "alone " * 60, "s1"), (None, "alone " * 60, "s1")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d, *_ in docs[::2]]
    return docs, labels + [(docs[0][0], 1, 0), (None, 1, 1), (77777, 1, 1)]


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_audit_with_smaller_ids_in_later_files(spark, audited_rows, tmp_path, batches):
    docs, labels = audited_rows
    path = str(tmp_path / "documents.parquet")
    rows = sorted(docs, key=lambda r: -(r[0] or 10**6))
    for k in range(9):  # the files' ids fall
        part = spark.createDataFrame(rows[len(rows) * k // 9 : len(rows) * (k + 1) // 9], "doc_id long, text string, source string")
        part.withColumns({"mask": F.lit("x"), "good": F.lit(1), "n": F.lit(2)}).coalesce(1).write.mode("append").parquet(path)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(spark, path, table, batches).collect()}
    assert got == plain_audit(docs, labels)


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    docs = lambda *ids: spark.createDataFrame([(d, "same text", "s") for d in ids], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    counts = audit.Counts(spark, labels, str(tmp_path / "tables"))
    counts.add(docs(5, 6, 9), 0)
    counts.add(docs(3, 7), 1)
    counts.add(docs(3, 7), 1)
    short, again = 1, 1 | audit.REPEATED
    assert {(r["mask"], r.n) for r in counts.totals().collect()} == {(short, 1), (again, 4)}
    counts.add(docs(4, 3), 2)
    assert {(r["mask"], r.n) for r in counts.totals().collect()} == {(short, 2), (again, 5)}


def test_audit_of_a_table_without_rows(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(path)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = audit.audit(spark, path, labels)
    assert got.count() == 0 and got.columns[:3] == ["part", "filter_order", "step"]
