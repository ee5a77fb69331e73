"""Repeated runs: a run repeats the one before it under the same key if nothing changed in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brevia.functions import text as T

KEY = ("tool_id", "project_path", "cmd_key")
TTL_S = 1800


def decide(runs: DataFrame, ttl_s: int = TTL_S) -> DataFrame:
    """Add ``decision``, ``previous_run`` and ``age_s`` to runs (run_id, KEY, ts, output, exit_code, cwd_mtime, opted_out).

    ``hit``: the key's previous run is at most ``ttl_s`` seconds older and has the same directory time, exit code and output.
    ``miss``: otherwise. ``skip``: empty output or opted out; such runs are nobody's previous run.
    """
    skip = (F.coalesce(F.col("output"), F.lit("")) == "") | F.coalesce(F.col("opted_out"), F.lit(False))
    d = runs.withColumns({"__skip": skip, "__hash": T.content_hash(F.col("output"))})
    # skipped runs stay in the key's window but are passed over, so one shuffle does
    w = Window.partitionBy(*KEY).orderBy("ts", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    state = F.struct("run_id", "ts", F.col("__hash").alias("hash"), "exit_code", "cwd_mtime")
    d = d.withColumn("__prev", F.last(F.when(~F.col("__skip"), state), ignorenulls=True).over(w))
    age = F.unix_timestamp("ts") - F.unix_timestamp("__prev.ts")
    same = (age <= ttl_s) & (F.col("__prev.hash") == F.col("__hash")) & F.col("__prev.exit_code").eqNullSafe(F.col("exit_code")) & F.col("__prev.cwd_mtime").eqNullSafe(F.col("cwd_mtime"))
    decision = F.when(F.col("__skip"), "skip").when(F.coalesce(same, F.lit(False)), "hit").otherwise("miss")
    return d.withColumns({"decision": decision, "previous_run": F.when(decision == "hit", F.col("__prev.run_id")), "age_s": F.when(decision == "hit", age)}).drop("__skip", "__hash", "__prev")


def hit_message(d: DataFrame) -> DataFrame:
    """Add ``message``: what stands in for the output of a hit."""
    text = F.concat(F.lit("[unchanged since run "), T.run_id(F.col("output")), F.lit(", "), T.format_age(F.col("age_s")), F.lit(" ago]\n[exit code "), F.col("exit_code").cast("string"), F.lit("]"))
    return d.withColumn("message", F.when(F.col("decision") == "hit", text))
