"""Kept statistics read new facts only, and reports read the files that an index names; reports of the meter."""

import hashlib
import json
from pathlib import Path

from pyspark.sql import functions as F

from brevia.operators import meter
from brevia.operators.snapshot import Snapshot, cached, index_files, read_between, retention, write_clustered


def sums(d):
    return sorted((tuple(r[c] for c in ("k", "facts", "v")) for r in d.collect()), key=str)


def test_refresh_adds_new_facts_only(spark, tmp_path):
    path, kept = str(tmp_path / "facts"), Snapshot(str(tmp_path / "kept"), ["k"], ["v"], "part")
    facts = lambda: spark.read.schema("k string, v long, part long").parquet(path)
    rows = lambda a, b: spark.range(a, b).selectExpr("if(id % 3 = 0, null, concat('k', id % 3)) as k", "id as v")
    for part in (0, 1):
        rows(100 * part, 100 * part + 100).write.parquet(f"{path}/part={part}")
    full = lambda n: sums(rows(0, n).groupBy("k").agg(F.count("*").alias("facts"), F.sum("v").alias("v")))
    assert sums(kept.refresh(facts(), now=0)) == full(200)
    rows(200, 300).write.parquet(f"{path}/part=2")
    assert sums(kept.refresh(facts(), now=59)) == full(200)  # within the time limit
    # what was read is overwritten: a refresh doesn't look at it again
    rows(0, 1).write.mode("overwrite").parquet(f"{path}/part=0")
    assert sums(kept.refresh(facts(), now=60)) == full(300)
    assert kept.state(spark)["read_rows"] == 100 and kept.state(spark)["version"] == 1
    assert sums(kept.refresh(facts(), now=500)) == full(300) and kept.state(spark)["read_rows"] == 0


def test_refresh_of_nothing(spark, tmp_path):
    kept = Snapshot(str(tmp_path / "kept"), ["k"], ["v"], "part")
    none = spark.createDataFrame([], "k string, v long, part long")
    assert kept.state(spark) is None and sums(kept.refresh(none, now=0)) == []
    some = spark.createDataFrame([("a", 1, -5), ("a", 2, None)], none.schema)
    assert sums(kept.refresh(some, now=100)) == [("a", 1, 1)]


def test_a_kept_result_has_its_time(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(len(made))

    assert [cached(spark, str(tmp_path / "r"), now, make, 60).count() for now in (0, 59.5, 60, 100, 130)] == [1, 1, 2, 2, 3]


def test_files_that_hold_nothing_wanted_are_skipped(spark, tmp_path):
    path = str(tmp_path)
    facts = spark.range(10_000).selectExpr("timestamp_seconds((id * 7919) % 10000 * 3600) as ts", "id as v")
    index = write_clustered(facts, path, "ts", 10)
    assert index.count() == 10 and index.agg(F.sum("n")).first()[0] == 10_000
    low, high = F.timestamp_seconds(F.lit(2_000 * 3600)), F.timestamp_seconds(F.lit(2_500 * 3600))
    d = read_between(spark, path, "ts", low, high)
    assert d.count() == facts.filter((F.col("ts") >= low) & (F.col("ts") < high)).count() == 500
    assert len(d.inputFiles()) <= 2 < len(spark.read.parquet(f"{path}/facts").inputFiles())
    assert read_between(spark, path, "ts", F.timestamp_seconds(F.lit(10**9))).count() == 0 and read_between(spark, path, "ts").count() == 10_000
    actions = {Path(r["file"]).name: r["action"] for r in retention(index, low).collect()}
    assert sorted(actions.values()).count("delete") in (1, 2) and len(actions) <= 3
    assert index_files(spark.read.parquet(f"{path}/facts"), "ts").count() == 10


def test_meter_reports(spark):
    runs = spark.createDataFrame([("a b c d", "a", "2024-01-02 10:00:00", "git log src/x.rs", "/p"), ("x y", "", "2024-01-02 11:00:00", "ls", "/p"), (None, None, "2024-01-01 11:00:00", "ls", "/p")], "raw string, out string, ts string, command string, project string")
    facts = meter.record(runs.withColumn("ts", F.to_timestamp("ts")), "raw", "out", "ts", "command", "project").na.fill(0)
    assert sorted((r["command"], r["input_tokens"], r["saved_tokens"]) for r in facts.collect()) == [("git log src/x.rs", 4, 3), ("ls", 0, 0), ("ls", 2, 2)]
    none = meter._as_rollup(facts.limit(0))
    today = F.lit("2024-01-02").cast("date")
    shown = {s: [r["line"] for r in meter.report(facts, none, today, s)["summary"].collect()] for s in ("text", "csv", "json")}
    assert shown["text"] == ["Total commands:  3", "Input tokens:    6", "Output tokens:   1", "Tokens saved:    5 (83.3%)", "", "Top commands by savings:", "  git log src/x.rs            3 tokens", "  ls                          2 tokens"]
    assert shown["csv"] == ["command,saved_tokens", "git log src/x.rs,3", "ls,2"]
    assert json.loads(shown["json"][0]) == {"total_input_tokens": 6, "total_output_tokens": 1, "total_commands": 3, "top_commands": [["git log src/x.rs", 3], ["ls", 2]]}
    assert [r["line"] for r in meter.report(facts.limit(0), none, today)["summary"].collect()][-1] == "Tokens saved:    0 (0.0%)"
    assert [r["line"] for r in meter.report(facts, none, today, days=5, width=4)["graph"].collect()] == ["2024-01-01      0 ", "2024-01-02      5 ████"]
    r = meter.telemetry(facts, none, today, "u", "/c", "1", "linux").first()
    assert r["installation_id"] == hashlib.sha256(b"u:/c").hexdigest()
    assert [(c["command"], c["saved_tokens"]) for c in r["top_commands"]] == [("git log", 3), ("ls", 2)] and r["today"]["commands"] == 2 and r["total_commands"] == 3
    assert meter.telemetry(facts, none, F.lit("2030-01-01").cast("date"), "u", "/c", "1", "linux").first()["today"] is None
    team = spark.createDataFrame([('{"savings_pct":40,"total_commands":7,"total_input_tokens":10,"total_output_tokens":6,"members":2}',), ("{}",), ("x",)], "body string")
    assert [r["shown"].split("\n")[0] for r in meter.team_line(team).collect()] == ["Team savings : 40%", "Team savings : 0%", "Team savings : 0%"]


def test_meter_tables(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS brevia_test")
    try:
        meter.create_tables(spark, str(tmp_path), "brevia_test")
        meter.create_tables(spark, str(tmp_path), "brevia_test")
        assert {r["tableName"] for r in spark.sql("SHOW TABLES IN brevia_test").collect()} == set(meter.TABLES)
        assert spark.table("brevia_test.commands_rollup").columns[-1] == "date"
    finally:
        spark.sql("DROP DATABASE brevia_test CASCADE")
