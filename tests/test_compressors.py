"""Compressor queries over whole tables, and text filters of single tools."""

import duckdb

from brevia import compressor_queries
from brevia.functions import text as T
from brevia.operators import compressors, tools

SF = "/root/testdata/sf0.01"

def test_ls_listing_takes_every_customer(spark):
    con = duckdb.connect()
    con.execute(f"create view customer as select * from read_parquet('{SF}/customer.parquet')")
    got = sorted((r["run_id"], r["shown"], r["is_dir"]) for r in compressor_queries.ls_listing(spark, SF).collect())
    assert got == sorted(con.execute(compressor_queries.ORACLE_SQL["ls_listing"]).fetchall())
    assert len(got) == con.execute("select count(*) from customer").fetchone()[0] and any(x[1].endswith("K)") for x in got)


def test_sizes_of_every_unit(spark):
    sizes = {1023: "1023B", 1024: "1.0K", 1280: "1.2K", 1792: "1.8K", 2**20: "1.0M", 5 * 2**18: "1.2M", 2**30: "1.0G", 7 * 2**28: "1.8G", 2**41: "2048.0G"}
    d = spark.createDataFrame([(x,) for x in sizes], "size long")
    assert {r["size"]: r["shown"] for r in d.select("size", T.format_size(d["size"]).alias("shown")).collect()} == sizes


def test_compress_on_odd_runs(spark):
    rows = [
        (1, None, None), (2, "", ""), (3, "git push", None), (4, None, "token=abcdefgh12345678 at /home/ann/x"), (5, "cat  a.txt", "  "), (6, "rm x", ""), (7, "npm i", "\n \n"),
        (8, "go build", "nothing wrong"), (9, "go build", "nothing wrong"), (10, "docker images", "no table"), (11, "kubectl get svc", "error: x"), (12, "brew list", ""), (13, "\tcargo clippy ", "    Checking x\n"),
        (14, "cat b", "\n".join(map(str, range(101)))), (15, "pip install x", "\x1b[1mSuccessfully installed x\x1b[0m\r\n"),
    ]
    d = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "run_id long, command string, raw string, rule string, how string")
    got = {r["run_id"]: (r["how"], r["compressed"]) for r in tools.compress(d).collect()}
    assert len(got) == 15 and all(x[1] is not None for x in got.values())
    assert got[1] == got[2] == ("none", "") and got[3] == ("native", "ok push") and got[4][0] == "none" and "abcdefgh" not in got[4][1] and "/home/user" in got[4][1]
    assert [got[i][1] for i in (5, 6, 7, 8, 9, 10, 11, 12, 13, 15)] == ["(empty file: a.txt)", "ok", "", "nothing wrong", "nothing wrong", "no table", "error: x", "", "ok", "Successfully installed x"]
    assert got[14][1].startswith("b  (101 lines, showing first 40 + last 20)\n   1  0\n") and "\n\n... (41 lines omitted) ...\n\n  82  81\n" in got[14][1]
    assert tools.compress(d.limit(0)).count() == 0


def plan_of(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_diff_is_cut_run_by_run(spark):
    two = "before\ndiff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-old\n+new\n+++\n---\ndiff --git a/x b/y\ndiff --git a/x b/x\n+z\n"
    d = compressors.git_diff(spark.createDataFrame([(1, two), (2, None), (3, ""), (4, "no header\n+x"), (5, two.replace("\n", "\r\n"))], "run_id long, raw string"))
    want = [(1, "x", 2, 2, 1), (9, "y", 0, 0, 0), (10, "x", 1, 0, 0)]
    assert sorted(map(tuple, d.collect())) == [(run, *x) for run in (1, 5) for x in want]
    # all lines of all runs in a partition were sorted at once
    assert not any(x in plan_of(d) for x in ("Exchange", "Sort", "Window"))


def test_log_is_cut_run_by_run(spark):
    log = "x\ncommit 0123456789\nAuthor: A\n\n    Fix it  \n\n    Body\ncommit abcdef\n    of no commit\ncommit abcdef0\nDate: d\n"
    d = compressors.git_log(spark.createDataFrame([(1, log), (2, None), (3, ""), (4, "nothing")], "run_id long, raw string"))
    assert sorted(map(tuple, d.collect())) == [(1, 1, "0123456", "Fix it"), (1, 9, "abcdef0", None)]
    assert not any(x in plan_of(d) for x in ("Exchange", "Sort", "Window"))


def test_mixed_runs_are_made_in_tasks_that_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(compressor_queries, "LINES_A_TASK", 1_000)
    made = []
    monkeypatch.setattr(tools, "compress", lambda runs, rules: made.append(runs) or runs.selectExpr("run_id", "tool", "'' as how", "raw as compressed"))
    compressor_queries.compress_more_commands(spark, SF)
    plan = plan_of(made[0])
    # 2,000 parts make a line each for every tool; before, all were made in the one task that reads the file, and then shuffled
    assert plan.count("Exchange") == 1 and "Generate" not in plan[plan.index("Exchange") :]
    assert made[0].rdd.getNumPartitions() == 1 + 2 * len(compressor_queries.MORE_TOOLS)


def test_runs_are_put_together_in_tasks_that_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(compressor_queries, "ROWS_A_TASK", 1_000)
    d = compressor_queries.git_log_compact(spark, SF)
    # before, the tasks that read the file grouped, and so sorted, all of their rows, and what they made was shuffled
    plan = plan_of(d)
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan[plan.index("Exchange") :]
    assert d.rdd.getNumPartitions() == 16
    con = duckdb.connect()
    con.execute(f"create view orders as select * from read_parquet('{SF}/orders.parquet')")
    assert sorted(map(tuple, d.collect())) == sorted(con.execute(compressor_queries.ORACLE_SQL["git_log_compact"]).fetchall())
    for name in ("git_diff_stat", "git_status_sections", "eslint_summary"):
        plan = plan_of(compressor_queries.QUERIES[name](spark, SF))
        assert plan.count("Exchange") == 1 and "Aggregate" not in plan[plan.index("Exchange") :]
