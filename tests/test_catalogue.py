"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from tools.check import rows_of
from workloads.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for file in sorted(os.listdir(sf_dir)):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf_dir}/{file}'")
    return connection


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {
        "rouge_l_sum",
        "rouge_corpus_all",
        "fit_linear_reward",
        "noise_vs_accuracy",
    }


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert mine
        return
    got = db.execute(SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert mine == rows_of(columns, got.fetchall())


def test_entry(spark, sf_dir):
    assert entry_points.entry(spark).columns == ["row_id", "split", "prompt", "chosen", "rejected"]
