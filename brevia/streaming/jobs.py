"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from brevia.functions import text as T
from brevia.operators import dedup, fleet, tools
from brevia.plans.rules import Rule, by_precedence, extended
from brevia.sources.rule_files import RuleCache

_LAST = "run_id long, ts double, hash string, exit_code int, cwd_mtime long"
_OUT = "tool_id string, project_path string, cmd_key string, run_id long, decision string, previous_run long"


class LastRuns(StatefulProcessor):
    """The last run of each key, which the state store forgets by itself ``ttl_s`` seconds after it was written."""

    def __init__(self, ttl_s: int):
        self.ttl_s = ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _LAST, ttlDurationMs=self.ttl_s * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - the interface's names
        last = self.last.get()
        before = last
        runs = pd.concat(list(rows)).sort_values(["ts", "run_id"])  # a key's runs in one micro-batch, without their output
        out = []
        for r in runs.itertuples():
            if r.skip:
                out.append((*key, r.run_id, "skip", None))
                continue
            same = last is not None and r.ts - last[1] <= self.ttl_s and (r.hash, r.exit_code, r.cwd_mtime) == tuple(last[2:])
            out.append((*key, r.run_id, "hit" if same else "miss", last[0] if same else None))
            last = (int(r.run_id), float(r.ts), r.hash, int(r.exit_code), int(r.cwd_mtime))
        if last is not before:
            self.last.update(last)
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])
        frame["previous_run"] = frame["previous_run"].astype("Int64")
        yield frame

    def close(self) -> None:
        pass


def decide_stream(runs: DataFrame, ttl_s: int = dedup.TTL_S) -> DataFrame:
    """The decisions of ``dedup.decide`` on a stream of runs; the state of a key is its last run, kept for ``ttl_s`` seconds.

    Runs of a key within a micro-batch are taken in order of time. Rows: the key, run_id, decision and previous_run. The session needs the
    RocksDB state store (``state_store``), which also removes what has expired. The state can be read by ``last_runs``.
    """
    skip = (F.coalesce(F.col("output"), F.lit("")) == "") | F.coalesce(F.col("opted_out"), F.lit(False))
    d = runs.select(*dedup.KEY, "run_id", F.unix_timestamp("ts").cast("double").alias("ts"), T.content_hash(F.col("output")).alias("hash"), "exit_code", "cwd_mtime", skip.alias("skip"))
    return d.groupBy(*dedup.KEY).transformWithStateInPandas(LastRuns(ttl_s), _OUT, "append", "processingTime")


def state_store(spark: SparkSession) -> None:
    """Let the session's streams keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def last_runs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, run_id, ts, hash, exit_code, cwd_mtime, expires) of the keys that the state of a stopped or running ``decide_stream`` holds."""
    d = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "last").load()
    value = F.col("value.value") if "value" in d.schema["value"].dataType.names else F.col("value")
    expires = F.timestamp_millis("value.ttlExpirationMs") if "ttlExpirationMs" in d.schema["value"].dataType.names else F.lit(None).cast("timestamp")
    return d.select("key.*", *[value[c.split()[0]].alias(c.split()[0]) for c in _LAST.split(", ")], expires.alias("expires"))


def compress_stream(runs: DataFrame, cache: RuleCache, write: Callable[[DataFrame, int], None], checkpoint: str, builtin: Iterable[Rule] = (), **options) -> StreamingQuery:
    """Start a query that compresses each micro-batch of runs by the rules as they are then, and hands it to ``write`` with its number.

    Project rules come from the cache's folder, of which only changed files are parsed again; they go before ``builtin`` ones of their name. Files that
    are no rules, or extend none that there is, are left out.
    """

    def step(batch: DataFrame, number: int) -> None:
        rules = [*cache.rules(), *builtin]
        names = {r.name for r in rules}
        rules = by_precedence(extended(r for r in rules if r.extends is None or r.extends in names))
        write(tools.compress(batch, rules, **options), number)

    return runs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def daily_tokens(facts: DataFrame, late: str = "1 day") -> DataFrame:
    """Tokens by day and command of a stream of facts; a day is done when the watermark has passed it."""
    d = facts.withWatermark("timestamp", late).groupBy(F.window("timestamp", "1 day"), "command")
    return d.agg(F.count("*").alias("commands"), F.sum("input_tokens").alias("input_tokens"), F.sum("saved_tokens").alias("saved_tokens")).select(F.col("window.start").cast("date").alias("date"), "command", "commands", "input_tokens", "saved_tokens")


def ingest_fleet(pings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that adds each micro-batch of pings to the table of installations below ``path``: a row for each installation that it saw.

    A batch writes its own folder and nothing else, so its work is that of its pings, and a batch that is run again writes the same. ``read_fleet`` merges
    the rows; ``compact_fleet`` does so once for all.
    """

    def add(batch: DataFrame, number: int) -> None:
        fleet.instances(batch).write.mode("overwrite").parquet(f"{path}/batches/batch={number}")

    return pings.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()


def _merged(rows: DataFrame) -> DataFrame:
    latest = [F.max_by(c, F.struct("last_seen", "batch")).alias(c) for c in ("os", "version", "total_commands", "total_saved_tokens", "avg_savings_pct")]
    country = F.max_by("country", F.when(F.col("country").isNotNull(), F.struct("last_seen", "batch"))).alias("country")
    d = rows.groupBy("installation_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("seen"), country, *latest, F.max("batch").alias("batch"))
    return d.withColumnRenamed("seen", "last_seen")


def _since(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """The last batch that is compacted (-1 if none), and rows of that with those of later batches."""
    batches = spark.read.parquet(f"{path}/batches")
    try:
        done = spark.read.parquet(f"{path}/compacted")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return -1, batches
    upto = done.agg(F.max("upto")).first()[0]
    return upto, done.filter(F.col("upto") == upto).drop("upto").unionByName(batches.filter(F.col("batch") > upto))


def read_fleet(spark: SparkSession, path: str) -> DataFrame:
    """The table of installations as of the last batch: what was compacted, merged with later batches; older ones aren't read."""
    return _merged(_since(spark, path)[1]).drop("batch")


def compact_fleet(spark: SparkSession, path: str) -> None:
    """Merge all batches up to now into one table beside the ones before, whose folder says how far it reaches."""
    upto, rows = _since(spark, path)
    newest = spark.read.parquet(f"{path}/batches").agg(F.max("batch")).first()[0]
    if newest is not None and newest > upto:
        _merged(rows.filter(F.col("batch") <= newest)).write.mode("overwrite").parquet(f"{path}/compacted/upto={newest}")
