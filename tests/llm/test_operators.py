"""The training-data operators against plain Python on small tables."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from duelframe.llm import (
    archives,
    bpe,
    languages,
    leaks,
    lines,
    links,
    quality,
    secret_scan,
    simhash,
    similar,
    toxicity,
)
from duelframe.llm.queries import URL_RULES, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, lines string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    base = "\n".join(prose(25) for _ in range(5))
    texts = [None, "", " \n\t ", "word", base, base, base.replace(" ", "  ", 1), base + "\n" + prose(4)]
    near = base.split(" ")
    for k in range(40):
        copy = list(near)
        copy[k] = "changed"
        texts.append(" ".join(copy))
    texts += ["\n".join(prose(12) for _ in range(9)) for _ in range(20)]
    texts += [prose(30) + "\n" + base.split("\n")[0] + "\n" + base.split("\n")[1] + "\n" + base.split("\n")[2]]
    texts += ["x" * 30_000, prose(9_000), "same line here\n" * 50, "### $$$ %%% " * 60, "dé ÉA日本 ñ ẞ\x85y " * 20]
    rows = [(k, t, ["en", "de", None][k % 3], f"s{k % 2}", len(t or ""), "x", "y") for k, t in enumerate(texts)]
    rows += [rows[4], rows[7], (None, base, "en", "s0", 1, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


def count(df):
    return Counter(map(tuple, df.collect()))


def words(text):
    return (text or "").encode().split()


# --- urls ------------------------------------------------------------------------------


def test_trust_and_distrust_follow_links(spark):
    link = '<a href="https://{}/x">'.format
    pages = spark.createDataFrame(
        [
            (1, "http://good.org/a", link("Friend.net"), "x"),
            (2, "http://friend.net/", None, "x"),
            (3, "http://spam.com/de/1", "", "x"),
            (4, "http://feeder.net/z?q", link("spam.com") * 2, "x"),
            (5, "http://both.net", link("spam.com") + link("nobody.net"), "x"),
            (6, None, link("spam.com"), "x"),
            (7, "no scheme", None, None),
            (7, "HTTP://EXAMPLE.ORG/es/1#a", None, None),
        ],
        "page_id long, url string, html string, verdict string",
    )
    got = links.filter_urls(pages, URL_RULES).collect()
    by_id = defaultdict(list)
    for r in got:
        by_id[r.page_id].append((r.host, r.path, r.rule, r.verdict))
    assert by_id[1] == [("good.org", "/a", "org/", "allow")]
    assert by_id[2] == [("friend.net", "/", None, "allow")]
    assert by_id[3] == [("spam.com", "/de/1", "com/de/", "block")]
    assert by_id[4] == [("feeder.net", "/z", None, "block")]
    assert by_id[5] == [("both.net", "", None, "block")]
    assert by_id[6] == [("", "", None, "allow")]
    assert sorted(by_id[7]) == [("", "", None, "allow"), ("example.org", "/es/1", "example.org/es/", "block")]
    assert links.filter_urls(pages.limit(0), URL_RULES).count() == 0


# --- secrets ---------------------------------------------------------------------------


def test_trigram_queries():
    assert secret_scan.trigram_query("[0-9a-f]{32,}") == []
    assert secret_scan.trigram_query("AKIA[A-Z]+") == [[frozenset({"aki", "kia"})]]
    (clause,) = secret_scan.trigram_query("(abcd|xyz)[0-9]+")
    assert set(clause) == {frozenset({"abc", "bcd"}), frozenset({"xyz"})}
    assert len(secret_scan.trigram_query("abc[0-9]+def")) == 2


def test_secrets_are_those_of_a_plain_scan(spark):
    import regex

    rng = random.Random(3)
    bits = ["token=", "abcd1234efgh", "PassWord : ", "'", " ", "\n", "é", "🙂", "api_key:", "AKIA", "ABCDEFGHIJKL", "0f" * 16, "secret: token: ", "ghp_" + "a1" * 18, "-----BEGIN RSA PRIVATE KEY-----", "http://me:pw@host.org", "ſecret=abcdefgh1"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(300)] + [None, "", "a" * 50_000]
    table = spark.createDataFrame([(k // 2, t, "x") for k, t in enumerate(texts)] + [(None, "token=abcdefgh", "")], "doc_id long, text string, found string")
    got = count(secret_scan.secret_report(table).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"))
    want = Counter()
    for r in table.collect():
        found = []
        for no, rule in enumerate(secret_scan.BASE + secret_scan.ADDED):
            for m in regex.finditer(rule.regex, r.text or ""):
                if len(m.group(rule.group)) >= rule.least:
                    found.append((m.start(), no, m.end(), rule.kind))
        show = lambda fs: ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(fs))
        n = Counter(f[3] for f in found)
        digest = hashlib.sha256(show([f for f in found if f[1] < 3]).encode()).hexdigest()
        want[r.doc_id, n["assign"], n["access"], n["hex"], digest, show(found)] += 1
    assert got == want
    assert secret_scan.secret_report(table.limit(0)).count() == 0


# --- quality ---------------------------------------------------------------------------


def test_quality_counts(docs, rows, none):
    want = Counter()
    for r in rows:
        ws = [w.decode() for w in words(r.text)]
        n = len(ws)
        windows = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        repeated = {i + k for i in range(n - 2) if windows[tuple(ws[i : i + 3])] > 1 for k in range(3)}
        ls = [x for x in (r.text or "").split("\n") if words(x)]
        symbols = sum(c in quality.SYMBOLS for c in r.text or "")
        failed = n < 50 or 100 * len(repeated) > 50 * n
        want[r.doc_id, n, sum(map(len, ws)), symbols, len(ls) - len(set(ls)), len(repeated), failed] += 1
    got = quality.quality(docs)
    assert count(got.drop("kept")) == want
    assert not got.where("base_failed and kept").count()
    assert quality.quality(none).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert count(kept.select("doc_id")) == count(got.where("kept").select("doc_id"))


def test_fences_follow_their_source(spark):
    """A rate that is usual in one source is an outlier in another."""
    rng = random.Random(1)
    text = lambda share: " ".join(rng.choice("abcdefghijklmn") * 5 + str(k) + ("#" if rng.random() < share else "") for k in range(100))
    made = [(k, text(0.0), "en", "prose") for k in range(80)] + [(100 + k, text(0.9), "en", "code") for k in range(80)]
    made += [(900, text(0.9), "en", "prose"), (901, text(0.9), "en", "code")]
    kept = {r.doc_id for r in quality.quality(spark.createDataFrame(made, "doc_id long, text string, lang string, source string")).where("kept").collect()}
    assert 900 not in kept and 901 in kept and len(kept) == 161


# --- tokens ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocab():
    return vocabulary()


@pytest.fixture(scope="module")
def reference(vocab):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def test_tokens_are_those_of_the_library(docs, rows, none, vocab, reference):
    want, listed = Counter(), Counter()
    for r in rows:
        ids = reference.encode_ordinary(r.text or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want[r.doc_id, len(ids), digest, hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
        listed[r.doc_id, tuple(ids), (r.text or "").encode()] += 1
    assert count(bpe.token_report(docs, vocab)) == want
    back = bpe.decode(bpe.encode(docs, vocab), vocab).select("doc_id", "token_ids", "bytes")
    assert Counter((a, tuple(b), bytes(c)) for a, b, c in back.collect()) == listed
    assert bpe.token_report(none, vocab).count() == 0


def test_tokens_of_odd_texts(vocab, reference):
    rng = random.Random(1)
    letters = "aab  \n\t'sé日本\x85 \x1c🙂12,.-_AAthe"
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randrange(40)))
        digests = vocab.encoder.digests(text)
        assert " ".join(d[0] for d in digests) == " ".join(map(str, reference.encode_ordinary(text)))
        assert b"".join(d[2] for d in digests) == text.encode()


def test_appends_and_edits_keep_the_table(vocab):
    rng, merges = random.Random(2), vocab.encoder.merges
    draw = lambda n: bytes(rng.choices(b"aabthe ing", k=n))
    for _ in range(200):
        data, more = draw(60), draw(5)
        table = bpe.Prefixes(merges)
        table.append(data)
        table.append(more)
        data += more
        start = rng.randrange(60)
        end, new = start + rng.randrange(4), draw(rng.randrange(4))
        table.edit(start, end, new)
        fresh = bpe.Prefixes(merges)
        fresh.append(data[:start] + new + data[end:])
        assert (table.data, table.last) == (fresh.data, fresh.last)
        assert table.ids() == vocab.encoder.piece(bytes(table.data))
    long = bpe.Prefixes(merges)
    long.append(draw(4000))
    assert long.edit(100, 101, b"x") < 1000


# --- lines -----------------------------------------------------------------------------


def test_lines_of_earlier_passages_go(docs, rows, none):
    first, out = {}, Counter()
    order = sorted({(r.doc_id is not None, r.doc_id or 0, r.text, r.doc_id) for r in rows if r.text is not None}, key=lambda x: x[:3])
    gone = {}
    for _, _, text, doc_id in order:
        ls = text.split("\n")
        worded = [i for i, x in enumerate(ls) if words(x)]
        drop = set()
        for at in zip(worded, worded[1:], worded[2:], strict=False):
            key = tuple(ls[i] for i in at)
            if key in first:
                drop.update(at)
            first.setdefault(key, doc_id)
        gone[doc_id, text] = drop
    for r in rows:
        if r.text is None:
            out[r.doc_id, None, 0, 0] += 1
        else:
            ls, drop = r.text.split("\n"), gone[r.doc_id, r.text]
            out[r.doc_id, "\n".join(x for i, x in enumerate(ls) if i not in drop), len(ls), len(drop)] += 1
    assert count(lines.line_report(docs)) == out
    assert lines.line_report(none).count() == 0
    kept = lines.without_repeats(docs)
    assert kept.columns == docs.columns
    assert all(r.text is None or r.n_chars is not None for r in kept.collect())


# --- toxicity --------------------------------------------------------------------------


def test_severity_grows_with_the_grade(spark, none):
    rng = random.Random(4)
    plain = ["w%d" % k for k in range(200)]
    made = []
    for k in range(600):
        grade = k % 3
        text = rng.choices(plain, k=60) + rng.choices(["mild", "rude"], k=4 * (grade >= 1)) + rng.choices(["vile", "awful"], k=4 * (grade == 2))
        rng.shuffle(text)
        made.append((k, " ".join(text), grade, "x"))
    table = spark.createDataFrame(made, "doc_id long, text string, grade int, severity string")
    seen = table.where("doc_id % 2 = 0")
    model = toxicity.learn(seen, seen.select("doc_id", "grade"))
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    right = sum(got[k].grade == k % 3 for k in range(1, 600, 2))
    assert right >= 285
    mean = [np.mean([got[k].severity for k in range(600) if k % 3 == g]) for g in range(3)]
    assert mean[0] < 0.3 and mean[2] > 1.6 and mean[0] < mean[1] < mean[2]
    odd = spark.createDataFrame([(1, None), (1, ""), (2, "vile " * 20_000)], "doc_id long, text string")
    assert [r.grade for r in toxicity.score(odd, model).orderBy("doc_id").collect()] == [0, 0, 2]
    assert toxicity.score(none, model).count() == 0
    empty = toxicity.learn(none, none.select("doc_id", F.lit(1).alias("grade")))
    assert toxicity.score(odd, empty).select("grade").distinct().collect() == [(0,)]


# --- languages -------------------------------------------------------------------------


def test_phrases_are_the_longest_that_occur():
    rng = random.Random(6)
    text = lambda n: "".join(rng.choices("abc ", [5, 3, 2, 1], k=n))
    model = languages.Languages({"x": [text(300)], "y": [text(500)]})
    texts = [languages.folded(text(n)) for n in (0, 1, 700, 5000)] + [languages.folded("zz日z ab")]
    got = model.phrases(texts)
    for k, t in enumerate(texts):
        for j, name in enumerate(model.names):
            source = model.texts[name].tobytes()
            total = 0
            for at in range(0, len(t), languages.BLOCK):
                block = t[at : at + languages.BLOCK].tobytes()
                n, phrase = 1, b""
                for byte in block:
                    grown = phrase + bytes([byte])
                    if grown in source:
                        phrase = grown
                    else:
                        n += 1
                        phrase = bytes([byte]) if bytes([byte]) in source else b""
                total += n
            assert got[k, j] == total


def test_languages_of_held_out_texts(spark, sf_dir, none):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = languages.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (None, "the of and")], "doc_id long, text string")
    model = languages.learn(docs)
    found = {r.doc_id: r for r in languages.predict(odd, model).collect()}
    assert {found[k].lang_pred for k in (1, 2, 3)} == {"und"} and found[1].score == 0.0
    assert found[None].lang_pred == "en" and 0 < found[None].score <= 1
    assert languages.language_report(none).count() == 0
    assert languages.predict(odd, languages.learn(none)).where("lang_pred <> 'und'").count() == 0


# --- archives --------------------------------------------------------------------------


def test_archives_give_back_every_page(spark, monkeypatch):
    magic = "WARC/1.1\r\n"
    inner = f"{magic}WARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Type: text/html\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    big = "é" * 700
    made = [(1, "http://a/\r\nX: y", big), (2, None, big), (2, "u", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (-6, "u", inner * 3), (7, "u", "x" + inner + magic + "tail"), (8, "u", magic), (9, "u", "\r\n\r\n" * 400), (10, "u", "z" * 300_000), (11, "u", magic * 200)]
    pages = spark.createDataFrame([(*r, "x") for r in made], "page_id long, url string, html string, digest string")
    want = Counter()
    largest = defaultdict(lambda: -1)
    for page, _, html in made:
        largest[html] = max(largest[html], page if page is not None else -1)
    for page, _, html in made:
        data = (html or "").encode()
        again = len(data) >= 1000 and page != largest[html]
        want[page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", largest[html] if again else None] += 1
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert count(archives.round_trip(pages).select(columns)) == want
    # the same when files are read in many splits
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert count(archives.round_trip(pages.coalesce(1), "none").select(columns)) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert archives.round_trip(pages.limit(0)).count() == 0


# --- near duplicates -------------------------------------------------------------------


def plain_fingerprint(text):
    ws = words((text or ""))
    ws = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in ws]
    grams = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([b" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius):
    parent = list(range(len(fps)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            parent[find(i)] = find(j)
    return [find(k) for k in range(len(fps))]


def test_components_of_texts(docs, rows, none):
    small = docs.where("text is null or length(text) < 5000")
    rows = [r for r in rows if r.text is None or len(r.text) < 5000]
    fps = [plain_fingerprint(r.text) for r in rows]
    group = plain_components(fps, 3)
    names = defaultdict(list)
    for r, g in zip(rows, group, strict=True):
        names[g] += [] if r.doc_id is None else [r.doc_id]
    want = Counter((r.doc_id, f"{fp:016x}", min(names[g], default=None)) for r, fp, g in zip(rows, fps, group, strict=True))
    assert count(simhash.near_duplicates(small)) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_first(small)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(n) for n in names.values())


def test_links_join_all_within_the_radius(spark, monkeypatch):
    """Chains, dense balls and far points, in one part and in many."""
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(120):
            fps.add(at ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
        for _ in range(40):
            at ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            fps.add(at)
    fps = sorted(fps)
    signed = [fp - (1 << 64) if fp >> 63 else fp for fp in fps]
    points = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = plain_components(fps, 3)
    for part in (simhash.PART, 20):
        monkeypatch.setattr(simhash, "PART", part)
        roots = {r.node: r.root for r in simhash.components(simhash.links(points)).collect()}
        got = [roots.get(x, x) for x in signed]
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_near_copies_are_those_of_all_pairs(spark, none, monkeypatch):
    """Edited copies that fingerprints miss, against the Jaccard similarity of every pair."""
    import corpus_pipeline

    rng = random.Random(12)
    vocab = ["w%d" % k for k in range(3000)]
    common = rng.choices(vocab, k=12)
    texts = [None, "", "one two", "One  two", "one three"]
    for _ in range(40):
        base = rng.choices(vocab, k=rng.randint(20, 200)) + common
        for edits in (0, len(base) // 60, len(base) // 45, len(base) // 25):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "changed%d" % rng.randrange(999)
            texts.append(" ".join(copy + rng.choices(vocab, k=rng.randint(0, 4))))
    texts += [" ".join(rng.choices(vocab, k=60) + common) for _ in range(60)]
    rng.shuffle(texts)

    def grams(text):
        ws = words(text)
        return {tuple(w.lower() for w in ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    fps, sets = [plain_fingerprint(t) for t in texts], [grams(t) for t in texts]
    parent, missed, fewer = list(range(len(texts))), 0, 0

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, j in itertools.combinations(range(len(texts)), 2):
        close = (fps[i] ^ fps[j]).bit_count() <= 3
        alike = bool(sets[i]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
        missed += alike and not close
        if close or alike:
            low, high = sorted((find(i), find(j)))
            parent[high] = low
    assert missed > 20
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    want = sorted({find(k) for k in range(len(texts))})
    assert len(similar._frequent(docs)) < 100
    for sample, last in ((20_000, 3), (1, 10**9)):
        monkeypatch.setattr(similar, "SAMPLE", sample)
        monkeypatch.setattr(similar, "FREQUENT", last)
        kept = corpus_pipeline.near_dedup(spark, docs, "")
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == want
    assert similar.keep_first(none).count() == 0


def test_edited_copies_of_one_text_do_not_all_meet(spark, monkeypatch):
    """Texts with too many shingles of their own to be similar aren't paired."""
    rng = random.Random(5)
    base = ["w%d" % k for k in rng.sample(range(3000), 100)]
    docs = []
    for k in range(60):
        copy = list(base)
        for place in range(5, 5 + 9 * (3 if k else 0), 9):
            copy[place] = f"own{k}x{place}"
        docs.append((k, k, " ".join(copy)))
    last = similar.shingle_set(" ".join(base))
    marked = spark.createDataFrame(docs, "n long, fp long, text string").withColumn("_set", similar._known("text"))
    texts, shared = similar._meeting(marked.select("n", "fp", "text", "_set.*"), last)
    sets = {k: set(similar.shingle_set(text).tolist()) for k, _, text in docs}
    held = Counter(x for own in sets.values() for x in own)
    got = {r.n: r for r in texts.collect()}
    assert all(r.rare == sum(held[x] == 1 for x in sets[k]) == r.size - r.most == 15 for k, r in got.items() if k)
    assert len(got) > 40
    roots = spark.createDataFrame([], "node long, root long")
    mixed = similar._mixed(texts, shared, roots)
    assert mixed.count() > 40
    met, enough = [], similar._enough
    monkeypatch.setattr(similar, "_enough", lambda rows: met.append(rows.count()) or enough(rows))
    similar.all_pairs(mixed)
    assert met == [0]  # one overlap of 81 at most, of 86 that two sets of 96 need


# --- benchmark -------------------------------------------------------------------------


def test_leaks(spark, none):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(2000)]
    prose = lambda n: rng.choices(vocab, k=n)
    items = [prose(n) for n in (14, 20, 36, 36, 59, 200)]
    bench = spark.createDataFrame([(k, " ".join(x), "x") for k, x in enumerate(items)] + [(90, None, ""), (91, "", ""), (0, " ".join(items[0]), "")], "item_id long, text string, word string")
    made, want = [], set()
    for k, item in enumerate(items):
        made.append((k, " ".join(prose(80) + item + prose(50))))
        made.append((10 + k, ("\n" + " ".join(item).upper().replace(" ", ", ") + "!")))
        want |= {(k, k), (10 + k, k)}
    edited = items[5][:100] + ["new"] + items[5][101:]
    made += [(30, " ".join(prose(9) + edited + prose(9))), (31, " ".join(items[4][:30])), (32, None), (33, ""), (34, " ".join(prose(20_000))), (34, " ".join(items[3] + items[1])), (None, " ".join(items[2]))]
    want |= {(30, 5), (34, 3), (34, 1), (None, 2)}
    table = spark.createDataFrame([(*r, "x") for r in made], "doc_id long, text string, similarity string")
    got = leaks.find_leaks(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.similarity == 1.0 for r in got if r.doc_id != 30)
    assert [r.word for r in got if r.doc_id == 0] == [80]
    clean = leaks.without_leaks(table, bench)
    assert sorted(r.doc_id for r in clean.collect()) == [31, 32, 33, 34]
    assert leaks.find_leaks(none, bench).count() == 0
    assert leaks.find_leaks(table, bench.limit(0)).count() == 0


def test_leaks_are_those_of_a_full_search(spark, monkeypatch):
    """All windows against all items, with the same radius and similarity; also in blocks."""
    rng = random.Random(2)
    vocab = ["w%d" % k for k in range(400)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(14, 60)))) for k in range(12)]
    texts = []
    for k in range(60):
        item = items[k % 12][1].split()
        for _ in range(rng.randint(0, 3)):
            item[rng.choice([0, 1, -1, -2])] = "changed"
        texts.append((k, " ".join(rng.choices(vocab, k=30) + item + rng.choices(vocab, k=30))))
    index = leaks.Index(items)
    want = set()
    for k, text in texts:
        found = leaks.shingles(index.hashed(leaks.tokens(text)))
        for i, (item_id, s) in enumerate(index.items):
            for at in range(len(found) - len(s) + 1):
                window = found[at : at + len(s)]
                if (leaks.simhash(window) ^ int(index.fps[i])).bit_count() <= leaks.RADIUS and index.similarity(Counter(window.tolist()), i) >= leaks.SIMILARITY:
                    want.add((k, item_id))
    table = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(table, bench).collect()} == want and len(want) > 20
    monkeypatch.setattr(leaks, "ITEMS", 5)
    assert leaks.find_leaks(table, bench).count() >= 20


def test_leaks_in_texts_shorter_than_the_item(spark):
    """Whole texts against all items, with the same radius and similarity."""
    rng = random.Random(6)
    vocab = ["w%d" % k for k in range(2000)]
    items = [(k, rng.choices(vocab, k=rng.randint(14, 60))) for k in range(20)]
    texts = []
    for k, item in items:
        for cut in (1, 3, 5, 9):
            texts += [item[:-cut], item[cut:], item[cut:-1]]
    texts = [(k, " ".join(t)) for k, t in enumerate(texts)]
    items = [(k, " ".join(t)) for k, t in items]
    index = leaks.Index(items)
    want = set()
    for k, text in texts:
        found = leaks.shingles(index.hashed(leaks.tokens(text)))
        for i, (item_id, s) in enumerate(index.items):
            bits = (leaks.simhash(found) ^ int(index.fps[i])).bit_count()
            if len(found) < len(s) and bits <= leaks.RADIUS and index.similarity(Counter(found.tolist()), i) >= leaks.SIMILARITY:
                want.add((k, item_id, 0, len(text.split())))
    table = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = leaks.find_leaks(table, bench).collect()
    assert {(r.doc_id, r.item_id, r.word, r.n_words) for r in got} == want and len(want) > 100
    assert sorted(r.doc_id for r in leaks.without_leaks(table, bench).collect()) == sorted({k for k, _ in texts} - {w[0] for w in want})


def test_leaks_do_not_depend_on_blocks_or_repeated_items(spark, monkeypatch):
    """Items under several ids with one inner word changed, and templated ones with one of the frame's."""
    rng = random.Random(14)
    vocab = ["w%d" % k for k in range(3000)]
    frame = rng.choices(vocab, k=30)
    items = [rng.choices(vocab, k=60) for _ in range(4)] + [frame + rng.choices(vocab, k=30) for _ in range(8)]
    listed = [(k, " ".join(x)) for k, x in enumerate(items)]
    listed += [(20 + k, " ".join(x)) for k, x in enumerate(items[:2])] + [(30, " ".join(items[0]).upper()), listed[1]]
    listed += [(None, " ".join(items[3])), (31, ""), (32, None)]
    texts = []
    for k, item in enumerate(items):
        for at in (3, 15, 40 if k < 4 else 20):
            texts.append((k, " ".join(rng.choices(vocab, k=20) + item[:at] + ["changed"] + item[at + 1 :] + rng.choices(vocab, k=20))))
    texts.append((99, " ".join(rng.choices(vocab, k=20) + frame + rng.choices(vocab, k=50))))
    table = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(listed, "item_id long, text string")
    found = []
    for size in (2048, 5, 1):
        monkeypatch.setattr(leaks, "ITEMS", size)
        found.append(count(leaks.find_leaks(table, bench)))
        assert [r.doc_id for r in leaks.without_leaks(table, bench).collect()] == [99]
    assert found[0] == found[1] == found[2]
    pairs = Counter((doc, item) for doc, item, *_ in found[0].elements())
    assert all(pairs[k, item] == 3 for k, item in [(k, k) for k in range(12)] + [(0, 20), (0, 30), (1, 21), (3, None)])
    assert not [doc for doc, _ in pairs if doc == 99]


def test_the_radius_covers_the_least_similarity():
    """Items with words changed anywhere, against the similarity without fingerprints."""
    rng = random.Random(4)
    vocab = ["w%d" % k for k in range(5000)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(20, 60)))) for k in range(100)]
    index = leaks.Index(items)
    similar = found = 0
    for k, text in items * 10:
        words = text.split()
        for _ in range(rng.randint(1, 2)):
            words[rng.randrange(len(words))] = "changed%d" % rng.randrange(9)
        window = Counter(leaks.shingles(index.hashed(leaks.tokens(" ".join(words)))).tolist())
        if index.similarity(window, k) >= leaks.SIMILARITY:
            similar += 1
            found += k in {m[0] for m in index.search(" ".join(words))}
    assert similar > 100 and found >= 0.99 * similar
