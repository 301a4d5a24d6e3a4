"""The queries against their SQL on the smallest tables, and the pipeline's stages."""

import os

import duckdb
import pytest

import corpus_pipeline
from duelframe.llm.queries import QUERIES, SQL
from tools.check import rows_of


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for file in sorted(os.listdir(sf_dir)):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf_dir}/{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    got = db.execute(SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, got.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def first_of_near_copies(rows):
    """The least doc_id of each group of texts that 3 bits or a five-word similarity of 0.8 join."""
    import itertools

    from duelframe.llm import simhash

    words = [r.text.encode().lower().split() for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    fps = [simhash.fingerprint(r.text) for r in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        alike = bool(sets[i]) and 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common)
        if group[i] != group[j] and (alike or (fps[i] ^ fps[j]).bit_count() <= 3):
            old = group[j]
            group = [group[i] if g == old else g for g in group]
    least = {}
    for r, g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    return sorted(least.values())


def test_the_pipeline_is_its_stages_in_turn(spark, sf_dir):
    """Each stage against the query of its operator, on what the stage before kept."""
    from collections import Counter

    from duelframe.llm import leaks, lines, quality
    from duelframe.llm.queries import vocabulary

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda df: Counter(r[0] for r in df.select("doc_id").collect())
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        kept.append(docs)
        docs = stage(spark, docs, sf_dir).cache()
    tokens = docs
    assert ids(kept[1]) == ids(quality.quality(kept[0]).where("kept"))
    texts = {r.doc_id: r.text for r in lines.line_report(kept[1]).collect()}
    assert all(texts[r.doc_id] == r.text and r.n_chars == len(r.text) for r in kept[2].collect())
    assert {d for d, t in texts.items() if t.split()} == set(ids(kept[2]))
    assert sorted(r.doc_id for r in kept[3].collect()) == first_of_near_copies(kept[2].collect())
    leaked = set(ids(leaks.find_leaks(kept[3], spark.read.parquet(f"{sf_dir}/benchmark.parquet"))))
    assert set(ids(kept[4])) == set(ids(kept[3])) - leaked
    assert tokens.columns == [*kept[0].columns, "token_ids"]
    encoder = vocabulary().encoder
    assert all(r.token_ids == encoder.ids(r.text) for r in tokens.collect())
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "text").collect())) == Counter(
        map(tuple, tokens.select("doc_id", "text").collect())
    )


def test_stages_take_tables_without_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
