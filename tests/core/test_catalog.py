"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

from quillon import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(rows):
    value = lambda x: None if x is None else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted((tuple(value(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    rows = got.collect()
    if name not in SQL:
        assert rows
        return
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == sorted(got.columns)
    assert plain(rows) == plain([[r[want.columns.index(c)] for c in got.columns] for r in want.fetchall()])


def test_partitions_change_nothing(spark, sf):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    some = ("bm25_topk", "hybrid_search", "candidate_rank", "minute_limiter", "load_chunks")
    first = {n: plain(QUERIES[n](spark, sf).collect()) for n in some}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert {n: plain(QUERIES[n](spark, sf).collect()) for n in some} == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
