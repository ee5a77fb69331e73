"""Registered queries against their SQL, also on pages that are linked."""

from pathlib import Path

import duckdb
import pytest

from brevia.llm import queries, urls

SF = "/root/testdata/sf0.001"


def rows_of(spark, name, sf):
    con = duckdb.connect()
    for t in (t for t in ("documents", "pages", "benchmark") if (Path(sf) / f"{t}.parquet").exists()):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    r = con.execute(queries.ORACLE_SQL[name])
    d = queries.QUERIES[name](spark, sf)
    assert sorted(d.columns) == sorted(x[0] for x in r.description)
    names = [x[0] for x in r.description]
    return sorted((tuple(x[c] for c in names) for x in d.collect()), key=str), sorted(r.fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_is_its_sql(spark, name):
    got, want = rows_of(spark, name, SF)
    assert got == want


def test_linked_pages_are_judged_as_their_sql_says(spark, tmp_path):
    def tag(i):
        return ("<link rel=canonical href='{}'>", '<link href="{}" rel="canonical">', '<META http-equiv="Refresh" content="0; url={}">')[i % 3]

    blocked, allowed = "http://a.example.org/es/1", "https://b.net.org/x"
    targets = [(1, "http://x.net/1", blocked), (2, "http://x.net/2", "//x.net/1#top"), (3, "http://x.net/a/3?q=1", "../no/such"), (4, "http://x.net/4", "/2"), (5, "http://y.net/5", blocked), (6, "http://z.net/6", allowed), (7, "http://z.net/7", "6"), (8, "http://z.net/8", "http://z.net/7")]
    rows = [(i, u, "<html>" + tag(i).format(t) + "</html>") for i, u, t in targets]
    rows += [(9, blocked, None), (10, None, "<link rel=canonical href=http://x.net/1>"), (11, "no scheme", ""), (12, "http://z.net/6", "<link rel=canonical>"), (13, "http://z.net/8", tag(1).format(blocked))]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "p"))
    next((tmp_path / "p").glob("part-*.parquet")).rename(tmp_path / "pages.parquet")
    spark.createDataFrame([(1, "a")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("part-*.parquet")).rename(tmp_path / "documents.parquet")
    got, want = rows_of(spark, "op8_url_filter", str(tmp_path))
    assert got == want
    # the second link of page 13 joins both components, and in one of them a page of net.org is allowed
    assert urls.filter_urls(spark.read.parquet(str(tmp_path / "pages.parquet")).filter("page_id <> 13")).filter("verdict = 'block' and rule is null").count() == 4


#: The last bits of a sum depend on its order, so that scores are compared to twelve digits.
_NEIGHBOURS = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""


def test_neighbours_are_those_of_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    want = sorted((q, r, v, round(s, 12)) for q, r, v, s in con.execute(_NEIGHBOURS).fetchall())
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in queries.QUERIES["op7_nearest_neighbours"](spark, SF).collect())
    assert got == want
