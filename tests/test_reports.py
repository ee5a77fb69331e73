"""Functions and reports that no query covers: messages of hits, formats, maps, transcripts on disk and file hashes."""

import hashlib

from pyspark.sql import functions as F

from brevia.functions import text as T
from brevia.operators import dedup, fleet, scan
from brevia.sources import transcripts


def column(spark, rows, schema, value):
    return [r["x"] for r in spark.createDataFrame(rows, schema).select(value.alias("x")).collect()]


def test_message_of_a_hit(spark):
    d = spark.createDataFrame([("hit", "out", 75, 2), ("miss", "out", None, 0)], "decision string, output string, age_s long, exit_code int")
    run = hashlib.sha256(b"out").hexdigest()[:10]
    assert [r["message"] for r in dedup.hit_message(d).collect()] == [f"[unchanged since run {run}, 1m ago]\n[exit code 2]", None]


def test_formats(spark):
    assert column(spark, [(0,), (999,), (1200,), (3_400_000,), (2_000_000_000,)], "n long", T.human_count(F.col("n"))) == ["0", "999", "1.2K", "3.40M", "2.00B"]
    assert column(spark, [(3, 1), (0, 5), (8, 1), (1, 2)], "a long, b long", T.savings_pct_rounded(F.col("a"), F.col("b"))) == [66.67, 0.0, 87.5, -100.0]
    words = [(["-o", "json"],), (["-ojson"],), (["--output=yaml"],), (["x"],), ([],)]
    assert column(spark, words, "a array<string>", T.output_format(F.col("a")))[0] == "json"
    assert column(spark, [("vim",), ("sudo",), ("git",), ("/usr/bin/vim",)], "w string", T.needs_terminal(F.col("w"))) == [True, True, False, False]


def test_dimensions_as_a_map(spark):
    inst = spark.createDataFrame([("a", "DE"), ("b", None), ("c", "DE")], "installation_id string, country string").withColumn("last_seen", F.lit("2024-01-01").cast("timestamp"))
    d = fleet.as_map(fleet.by(inst, F.lit("2024-01-05").cast("timestamp"), "country"), "country", "instances")
    assert d.first()["country"] == {"??": 1, "DE": 2}


def test_transcripts_on_disk(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    call = '{"type":"tool_use","name":"Bash","input":{"command":"%s"}}\n'
    (tmp_path / "a" / "b" / "x.jsonl").write_text(call % "git status" + "broken {\n" + call % "git status")
    (tmp_path / "y.jsonl").write_text(call % "ls -la | wc" + '{"type":"text"}\n')
    (tmp_path / "z.txt").write_text(call % "cargo test")
    lines = transcripts.read_lines(spark, str(tmp_path))
    assert lines.count() == 5
    found = scan.opportunities(transcripts.shell_commands(lines))
    assert [tuple(r) for r in found.collect()] == [("git status", "git", 2), ("ls -la", "system", 1)]
    top, sums = scan.report(found, 1)
    assert [r["command"] for r in top.collect()] == ["git status"] and tuple(sums.first()) == (3, 2)


def test_hashes_of_files(spark):
    files = spark.createDataFrame([("a", b"x"), ("b", b"y")], "path string, content binary")
    expected = spark.createDataFrame([("a", hashlib.sha256(b"x").hexdigest()), ("b", "0"), ("c", "0")], "path string, sha256 string")
    assert {r["path"]: r["verdict"] for r in scan.verify_files(files, expected).collect()} == {"a": "ok", "b": "tampered", "c": "missing"}
