"""Every registered query against its SQL on the smallest sample."""

import os

import pytest

import __spark_entry__ as entry
from chunkloom.plans.compare import _norm

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(entry.oracle_sql()[name])
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=key)
    want = sorted((tuple(_norm(r[i]) for i in at) for r in rel.fetchall()), key=key)
    assert got == want


def test_chunk_stats_have_a_row_per_document(spark, tmp_path):
    import duckdb

    texts = [(1, "One line.\nAnother."), (2, ""), (3, " \n "), (4, None), (None, "No id."), (5, "Twice."), (5, "Twice.")]
    spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = entry.queries()["general_chunk_stats"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()['general_chunk_stats']})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want)) and len(want) == 7
