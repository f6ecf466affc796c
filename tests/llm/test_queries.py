"""Every numbered query and the pipeline on the smallest tables; those with SQL against DuckDB."""

import glob
import math
import os

import duckdb
import pytest

import corpus_pipeline
from quillon.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
#: The rows that a query returns: one for each row of the table, or any number.
ONE_A_ROW = {"op10_chat_format": None, "op11_topk_search": None, "op12_lexical_search": None, "op8_url_filter": "pages"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "" if math.isnan(v) else f"{v:.6g}"
    return "" if v is None else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    assert got
    if table := ONE_A_ROW.get(name, "documents"):
        assert len(got) == duck.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
    if name in ORACLE:
        want = duck.execute(ORACLE[name])
        columns = [c[0] for c in want.description]
        assert sorted(df.columns) == sorted(columns)
        assert rows(df.columns, got) == rows(columns, want.fetchall())


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, DATA).collect()
    assert got and set(got[0].asDict()) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
