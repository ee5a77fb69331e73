"""Streams against the batch forms."""

import os
import time

from pyspark.sql import functions as F

from brevia.operators import dedup, fleet
from brevia.sources import rule_files
from brevia.streaming import jobs


def runs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr(
        "event_id as run_id", "'t' as tool_id", "cast(user_id % 3 as string) as project_path", "event_type as cmd_key", "ts", "concat('out', event_id % 2) as output", "0 as exit_code", "0L as cwd_mtime", "event_id % 13 = 0 as opted_out"
    )


# with timeouts in processing time a query goes on with empty batches, so it is run once


def test_dedup_stream_is_the_batch_with_a_restart(spark, tmp_path):
    jobs.state_store(spark)
    d = runs(spark)
    cut = d.agg(F.expr("percentile_approx(unix_timestamp(ts), 0.5)")).first()[0]
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "c")
    for i, part in enumerate((F.unix_timestamp("ts") <= cut, F.unix_timestamp("ts") > cut)):
        d.filter(part).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.decide_stream(spark.readStream.schema(d.schema).parquet(source), ttl_s=7200)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", checkpoint).trigger(once=True).start()
        assert q.awaitTermination(180) and q.exception() is None
        assert spark.read.parquet(str(tmp_path / "out")).count() == (d.filter(part).count() if i == 0 else d.count())
    got = {(r["run_id"], r["decision"], r["previous_run"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r["run_id"], r["decision"], r["previous_run"]) for r in dedup.decide(d, ttl_s=7200).collect()}
    held = {(r["project_path"], r["cmd_key"]): r["run_id"] for r in jobs.last_runs(spark, checkpoint).collect()}
    last = d.filter("not opted_out").groupBy("project_path", "cmd_key").agg(F.max_by("run_id", F.struct("ts", "run_id")).alias("run_id")).collect()
    assert held == {(r["project_path"], r["cmd_key"]): r["run_id"] for r in last}


def test_last_runs_are_forgotten(spark, tmp_path):
    jobs.state_store(spark)
    source = str(tmp_path / "in")
    seen = []
    for i in range(2):
        spark.range(1).selectExpr(f"{i}L as run_id", "'t' as tool_id", "'p' as project_path", "'k' as cmd_key", "timestamp_seconds(100) as ts", "'o' as output", "0 as exit_code", "0L as cwd_mtime", "false as opted_out").write.mode("append").parquet(source)
        stream = jobs.decide_stream(spark.readStream.schema("run_id long, tool_id string, project_path string, cmd_key string, ts timestamp, output string, exit_code int, cwd_mtime long, opted_out boolean").parquet(source), ttl_s=1)
        q = stream.writeStream.foreachBatch(lambda b, n: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        time.sleep(2)
    assert [r["decision"] for r in sorted(seen, key=lambda r: r["run_id"])] == ["miss", "miss"]


def rule_file(folder, name, message, when):
    path = folder / f"{name}.toml"
    path.write_text(f'[filter]\nname = "{name}"\ncommands = ["{name}"]\nstrip_patterns = ["."]\nempty_message = "{message}"\n')
    os.utime(path, ns=(when, when))


def test_a_stream_of_rule_files_gives_changed_ones_only(spark, tmp_path):
    folder = tmp_path / "rules"
    folder.mkdir()
    rule_file(folder, "a", "one", 10**18)
    rule_file(folder, "b", "one", 10**18)
    rule_files.register(spark)
    batches = []

    def start():
        d = spark.readStream.format(rule_files.NAME).option("path", str(folder)).load()
        return d.writeStream.foreachBatch(lambda b, n: batches.append(sorted((os.path.basename(r["path"]), r["modified"]) for r in b.collect()))).option("checkpointLocation", str(tmp_path / "c")).start()

    q = start()
    q.processAllAvailable()
    rule_file(folder, "b", "two", 10**18 + 1)
    q.processAllAvailable()
    q.stop()
    rule_file(folder, "c", "one", 10**18)
    (folder / "a.toml").unlink()
    q = start()
    q.processAllAvailable()
    q.stop()
    assert batches == [[("a.toml", 10**18), ("b.toml", 10**18)], [("b.toml", 10**18 + 1)], [("a.toml", None), ("c.toml", 10**18)]]


def test_a_running_stream_takes_up_changed_rules(spark, tmp_path):
    folder, source = tmp_path / "rules", str(tmp_path / "in")
    folder.mkdir()
    rule_file(folder, "mine", "one", 10**18)
    rule_file(folder, "other", "one", 10**18)
    (folder / "bad.toml").write_text("not toml [")
    (folder / "orphan.toml").write_text('name = "orphan"\ncommands = ["mine x"]\nextends = "none"\n')
    cache, got = rule_files.RuleCache(str(folder)), {}
    schema = "command string, raw string"
    spark.createDataFrame([("mine x", "text")], schema).coalesce(1).write.parquet(source)
    q = jobs.compress_stream(spark.readStream.schema(schema).parquet(source), cache, lambda d, n: got.update({n: [(r["compressed"], r["how"]) for r in d.collect()]}), str(tmp_path / "c"))
    q.processAllAvailable()
    assert got[0] == [("one", "rule")] and cache.parsed == 4
    rule_file(folder, "mine", "two", 10**18 + 1)
    spark.createDataFrame([("mine   x", "text")], schema).coalesce(1).write.mode("append").parquet(source)
    q.processAllAvailable()
    q.stop()
    assert got[1] == [("two", "rule")] and cache.parsed == 5
    assert not cache.stale(str(folder / "mine.toml")) and cache.stale(str(folder / "new.toml"))


def test_days_of_a_stream_of_facts(spark, tmp_path):
    source = str(tmp_path / "in")
    facts = spark.range(100).selectExpr("timestamp_seconds(id * 20000) as timestamp", "concat('c', id % 2) as command", "id as input_tokens", "id div 2 as saved_tokens")
    facts.coalesce(1).write.parquet(source)
    q = jobs.daily_tokens(spark.readStream.schema(facts.schema).parquet(source)).writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    day = F.to_date("timestamp")
    want = facts.groupBy(day.alias("date"), "command").agg(F.count("*").alias("commands"), F.sum("input_tokens"), F.sum("saved_tokens")).filter(F.col("date") < F.lit("1970-01-22").cast("date")).collect()
    got = {tuple(r) for r in spark.table("days").collect()}
    assert got and got <= {tuple(r) for r in want} and len(got) >= len(want) - 4


def test_fleet_ingest_merges_batches(spark, tmp_path):
    schema = "ping_id long, installation_id string, ts timestamp, country string, os string, version string, total_commands long, total_saved_tokens long, avg_savings_pct double"
    rows = spark.range(60).selectExpr("id as ping_id", "cast(id % 7 as string) as installation_id", "timestamp_seconds(id * 60) as ts", "if(id % 5 = 0, 'DE', null) as country", "concat('os', id % 4) as os", "'1' as version", "id as total_commands", "id as total_saved_tokens", "1.0D as avg_savings_pct")
    for i in range(3):
        rows.filter(F.col("ping_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start = lambda: jobs.ingest_fleet(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"))
    q = start()
    q.processAllAvailable()
    q.stop()
    columns = ["installation_id", "first_seen", "last_seen", "country", "os", "total_commands"]
    found = lambda: sorted(tuple(r) for r in jobs.read_fleet(spark, str(tmp_path / "out")).select(columns).collect())
    want = lambda d: sorted(tuple(r) for r in fleet.instances(d).select(columns).collect())
    assert found() == want(rows)
    assert len(list((tmp_path / "out" / "batches").glob("batch=*"))) == 3  # each wrote its own rows only
    jobs.compact_fleet(spark, str(tmp_path / "out"))
    jobs.compact_fleet(spark, str(tmp_path / "out"))
    assert found() == want(rows)
    more = rows.withColumns({"ping_id": F.col("ping_id") + 60, "ts": F.col("ts") + F.expr("interval 1 day"), "country": F.lit(None).cast("string")})
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = start()
    q.processAllAvailable()
    q.stop()
    assert found() == want(rows.union(more))
    jobs.compact_fleet(spark, str(tmp_path / "out"))
    assert found() == want(rows.union(more))
