"""Hubs, very many matches, skewed sources, short items and clashing names, against plain Python."""

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from duelframe.llm import bpe, leaks, lines, links, quality, secret_scan, simhash, toxicity
from duelframe.llm.queries import URL_RULES, vocabulary


def plain_rank(edges, seeds, rounds=400):
    """Personalised PageRank by plain iteration, until nothing more moves."""
    out = defaultdict(set)
    for src, dst in edges:
        out[src].add(dst)
    mass = dict(seeds)
    for _ in range(rounds):
        after = {h: (1 - links.KEPT) * s for h, s in seeds.items()}
        for src, m in mass.items():
            for dst in out[src]:
                after[dst] = after.get(dst, 0.0) + links.KEPT * m / len(out[src])
        mass = after
    return mass


@pytest.fixture(scope="module")
def graph():
    """Random links, a chain of 20, a cycle, two hubs in a row, and hosts without onward links."""
    rng = random.Random(2)
    edges = {(f"h{rng.randrange(60)}", f"h{rng.randrange(60)}") for _ in range(150)}
    edges |= {(f"c{k}", f"c{k + 1}") for k in range(20)} | {("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("c20", "r0")}
    edges |= {("hub1", f"x{k}") for k in range(3000)} | {("hub1", "hub2")} | {("hub2", f"y{k}") for k in range(3000)}
    return {(a, b) for a, b in edges if a != b}


def test_masses_are_those_of_plain_iteration(spark, graph):
    trust = {"h1": 1.0, "h2": 0.5, "c0": 1.0, "hub1": 0.25}
    distrust = {"h5": 1.0, "y7": 1.0, "r1": 0.125}
    edges = spark.createDataFrame(sorted(graph), "src string, dst string")
    rows = [("trust", h, s) for h, s in trust.items()] + [("distrust", h, s) for h, s in distrust.items()]
    seeds = spark.createDataFrame(rows, "kind string, host string, seed double")
    got = defaultdict(dict)
    for r in links.propagate(edges, seeds, 1e-6).collect():
        got[r.kind][r.host] = r.mass
    for kind, seeded, way in (("trust", trust, graph), ("distrust", distrust, {(b, a) for a, b in graph})):
        want = plain_rank(way, seeded)
        assert set(want) <= set(got[kind])
        assert all(got[kind][h] == pytest.approx(want.get(h, 0.0), abs=1e-5) for h in got[kind])
    assert got["trust"]["c20"] > 0 and got["trust"]["r2"] > 0  # beyond eight links
    assert got["trust"]["y9"] == pytest.approx(0.25 * 0.15 * 0.85**2 / 3001 / 3000, rel=1e-6)


def test_links_of_label_and_base(spark):
    pages = spark.createDataFrame(
        [
            ("http://a.example.com/x", '<base href="//Other.org/"><a href="y">'),
            ("http://example.com/", '<a href="/z"><a href="//example.com/q"><img src=HTTPS://cdn.net/p>'),
            ("http://example.com/", None),
        ],
        "url string, html string",
    )
    edges = lambda *a: {tuple(r) for r in links.host_edges(pages, *a).collect()}
    linked = {("a.example.com", "other.org"), ("example.com", "cdn.net")}
    assert edges() == linked
    assert edges(True) == linked | {("a.example.com", "example.com"), ("example.com", "a.example.com")}


def test_a_host_behind_hubs_is_blocked_by_what_it_links_to(spark):
    """One link of thousands to a blocked host; no trust speaks for the linking host."""
    link = '<a href="https://{}/x">'.format
    pages = [(1, "http://spam.com/de/1", ""), (2, "http://hub.net/", "".join(link(f"s{k}.net") for k in range(4000)) + link("spam.com"))]
    pages += [(3, "http://feeder.net/", link("hub.net")), (4, "http://quiet.net/", link("s1.net"))]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in links.filter_urls(table, URL_RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow"}


# --- secrets ---------------------------------------------------------------------------


def test_very_many_matches_in_one_text(spark):
    rng = random.Random(7)
    parts = ["%032x" % rng.getrandbits(128) if k % 3 else f"token={rng.getrandbits(40):x}é" for k in range(60_000)]
    texts = [" ".join(parts), "\n".join(parts[:50]), " ".join(parts[:1]), "x" * 31]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    table.count()
    began = time.time()
    got = {r.doc_id: r for r in secret_scan.secret_report(table).collect()}
    assert time.time() - began < 60
    for doc_id, text in enumerate(texts):
        found = []
        for no, rule in enumerate(secret_scan.BASE + secret_scan.ADDED):
            for m in regex.finditer(rule.regex, text):
                if len(m.group(rule.group)) >= rule.least:
                    found.append((m.start(), no, m.end(), rule.kind))
        assert got[doc_id].spans == ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))
    assert got[0].n_hex == 40_000


# --- quality ---------------------------------------------------------------------------


def test_verdicts_follow_the_spread_of_the_source(spark):
    """The same documents in two sources: usual in the one, far out in the other, both ways."""
    rng = random.Random(5)

    def text(symbols=0.0, letters=5):
        words = [rng.choice("abcdefghijklmn") * rng.choice([letters - 1, letters, letters + 1]) + str(k) for k in range(120)]
        return " ".join(w + ("#" if rng.random() < symbols else "") for w in words)

    made = []
    for k in range(100):
        made.append((k, text(0.3 if k % 5 < 2 else 0.0), "en", "mixed"))
        made.append((200 + k, text(), "en", "prose"))
        made.append((400 + k, text(letters=10), "en", "long words"))
    odd = [text(0.3), text(letters=10), text()]
    for k, source in enumerate(("mixed", "prose", "long words")):
        made += [(900 + 10 * k + j, t, "en", source) for j, t in enumerate(odd)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    assert set(range(100)) | set(range(200, 300)) | set(range(400, 500)) <= kept  # 40 % with symbols stay
    assert 900 in kept and 910 not in kept  # symbols
    assert 921 in kept and 911 not in kept  # long words
    assert 912 in kept and 922 not in kept  # short words: below the lower fence


# --- lines -----------------------------------------------------------------------------


def test_lines_with_names_as_keys_and_clashing_columns(spark):
    passage = "one line here\nanother line\nthe third line"
    made = [("b", passage, 1, "x", "y"), ("a", "first\n" + passage, 2, "x", "y"), (None, None, 3, "x", "y"), ("c", passage + "\nend", 4, "x", "y")]
    docs = spark.createDataFrame(made, "doc_id string, text string, _n_lines int, row string, n_removed string")
    got = lines.without_repeats(docs)
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == Counter([made[1], made[2], ("c", "end", 4, "x", "y")])


# --- tokens ----------------------------------------------------------------------------


def test_patterns_whose_pieces_hold_blanks():
    ranks = {bytes([b]): b for b in range(256)} | {b"a ": 256, b"a b": 257}
    vocab = bpe.Vocabulary(ranks, r"\S+ \S+|\s+|\S+")
    text = "a b a b  aa b"
    assert " ".join(d[0] for d in vocab.encoder.digests(text)) == " ".join(map(str, vocab.encoder.ids(text)))
    assert vocabulary().blanks_apart


# --- fingerprints ----------------------------------------------------------------------


def test_the_grid_distance_is_a_lower_bound():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 3000, np.int64).astype(np.uint64) << np.uint64(1)
    flips = rng.integers(0, 64, (3000, 5)).astype(np.uint64)
    b = a.copy()
    for k in range(5):
        b ^= np.uint64(1) << flips[:, k]
    count = lambda x: np.stack([np.bitwise_count((x >> np.uint64(2 * s)) & np.uint64(3)) for s in range(32)])
    manhattan = np.abs(count(a).astype(int) - count(b).astype(int)).sum(axis=0)
    grid = np.bitwise_count(simhash.unary(a) ^ simhash.unary(b))
    hamming = np.bitwise_count(a ^ b)
    assert (grid == manhattan).all() and (grid <= hamming).all() and (grid < hamming).any()
    assert (simhash.within(a, b, 3) == (hamming <= 3)).all()


# --- benchmark -------------------------------------------------------------------------


def test_items_of_a_few_words_are_found_anywhere(spark, monkeypatch):
    items = [("i0", "Paris is capital"), ("i1", "one"), ("i2", "the same, words!"), ("i3", "five words are no fewer"), ("i4", ""), (None, "rare pair")]
    texts = ["They say paris is, capital of all", "paris is", "paris is capital", "none", "one", "THE same words", "a rare pair here rare pair", "pair rare", "well five words are no fewer then", None, ""]
    bench = spark.createDataFrame(items, "item_id string, text string")
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(0, "i0", 2, 3), (2, "i0", 0, 3), (4, "i1", 0, 1), (5, "i2", 0, 3), (6, None, 1, 2), (8, "i3", 1, 5)}
    for size in (2048, 1):
        monkeypatch.setattr(leaks, "ITEMS", size)
        got = leaks.find_leaks(table, bench).collect()
        assert {(r.doc_id, r.item_id, r.word, r.n_words) for r in got} == want and len(got) == len(want)
        clean = leaks.without_leaks(table, bench)
        assert sorted(r.doc_id for r in clean.collect()) == [1, 3, 7, 9, 10]


# --- toxicity --------------------------------------------------------------------------


def test_the_gradient_is_that_of_the_likelihood():
    """Against differences, and the likelihood against its plain definition."""
    rng = np.random.default_rng(5)
    rows, columns = 40, 6
    dense = rng.random((rows, columns)) * (rng.random((rows, columns)) < 0.5)
    row, at = np.nonzero(dense)
    grades = rng.integers(0, 4, rows)
    weigh = rng.uniform(0.5, 2, rows)
    problem = toxicity.Problem(row, at, dense[row, at], grades, weigh, columns, 3)
    params = rng.normal(size=columns + 3) * 0.5
    edges = [-np.inf, params[columns], params[columns] + np.exp(params[columns + 1])]
    edges += [edges[-1] + np.exp(params[columns + 2]), np.inf]
    plain = 0.0
    for k in range(rows):
        score = dense[k] @ params[:columns]
        chance = [1 / (1 + np.exp(score - e)) for e in edges]
        plain += weigh[k] * np.log(chance[grades[k] + 1] - chance[grades[k]])
    plain = plain / rows - toxicity.SHRINK / 2 * (params[:columns] ** 2).sum()
    assert problem.likelihood(params) == pytest.approx(plain)
    for k, slope in enumerate(problem.gradient(params)):
        step = np.zeros(len(params))
        step[k] = 1e-5
        assert slope == pytest.approx((problem.likelihood(params + step) - problem.likelihood(params - step)) / 2e-5, abs=1e-7)


def test_toxic_texts_that_were_not_learned_from(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/labels.parquet").where("doc_id is not null")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    model = toxicity.learn(docs, labels.where(~out).select("doc_id", F.col("toxic").alias("grade")))
    rows = toxicity.score(docs, model).join(labels.where(out), "doc_id").collect()
    toxic = [r.grade >= 1 for r in rows if r.toxic == 1]
    clean = [r.grade >= 1 for r in rows if r.toxic == 0]
    assert len(toxic) > 100 and np.mean(toxic) > 0.7 and np.mean(clean) < 0.05
