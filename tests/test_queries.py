"""Every query against its SQL, on the same tables."""

import datetime
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from brevia import compressor_queries, queries, rule_queries  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = queries.QUERIES | compressor_queries.QUERIES | rule_queries.QUERIES
ORACLE = queries.ORACLE_SQL | compressor_queries.ORACLE_SQL | rule_queries.ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_is_its_sql(spark, duck, name):
    d = QUERIES[name](spark, SF)
    names = sorted(d.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in d.collect()), key=str)
    r = duck.execute(ORACLE[name])
    at = {x[0]: i for i, x in enumerate(r.description)}
    assert sorted(at) == names
    assert got == sorted((tuple(plain(x[at[c]]) for c in names) for x in r.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
