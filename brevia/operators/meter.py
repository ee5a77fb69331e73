"""Usage meter: facts and rollup in one view, reports, compaction and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brevia.functions import text as T

SUMS = ("commands", "input_tokens", "output_tokens", "saved_tokens")
#: A day with more facts of its own is compacted.
ROLLUP_ABOVE = 100


def record(runs: DataFrame, raw: str, compressed: str, ts: str, command: str, project: str) -> DataFrame:
    """Facts (timestamp, command, project_path, input_tokens, output_tokens, saved_tokens, savings_pct) of runs."""
    d = runs.select(
        F.col(ts).alias("timestamp"), F.col(command).alias("command"), F.col(project).alias("project_path"),
        T.count_tokens(F.col(raw)).alias("input_tokens"), T.count_tokens(F.col(compressed)).alias("output_tokens"),
    )
    return d.withColumns({"saved_tokens": T.saved(F.col("input_tokens"), F.col("output_tokens")), "savings_pct": T.savings_pct(F.col("input_tokens"), F.col("output_tokens"))})


#: Tables of the meter; both are partitioned by date, which stands for the indexes of a row store.
TABLES = {
    "commands": "timestamp TIMESTAMP NOT NULL, command STRING NOT NULL, full_command STRING, input_tokens BIGINT NOT NULL, output_tokens BIGINT NOT NULL, saved_tokens BIGINT NOT NULL, savings_pct DOUBLE NOT NULL, duration_ms BIGINT, project_path STRING, date DATE",
    "commands_rollup": "command STRING NOT NULL, commands BIGINT NOT NULL, input_tokens BIGINT NOT NULL, output_tokens BIGINT NOT NULL, saved_tokens BIGINT NOT NULL, avg_savings_pct DOUBLE NOT NULL, date DATE",
}


def create_tables(spark: SparkSession, path: str, database: str = "default") -> None:
    """Make the tables known, with their files below ``path``; tables that there are stay."""
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet PARTITIONED BY (date) LOCATION '{path}/{name}'")


def _as_rollup(facts: DataFrame) -> DataFrame:
    return facts.groupBy(F.to_date("timestamp").alias("date"), "command").agg(
        F.count("*").alias("commands"), *[F.sum(c).alias(c) for c in SUMS[1:]], F.avg("savings_pct").alias("avg_savings_pct")
    )


def everything(facts: DataFrame, rollup: DataFrame) -> DataFrame:
    """Facts, aggregated by day and command before any shuffle of detail, with the rollup."""
    return _as_rollup(facts).unionByName(rollup)


def _totals() -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in SUMS]


def _pct() -> Column:
    return F.coalesce(F.try_divide(100.0 * F.col("saved_tokens"), F.col("input_tokens")), F.lit(0.0))


def summary(facts: DataFrame, rollup: DataFrame) -> DataFrame:
    return everything(facts, rollup).agg(*_totals()).withColumn("savings_pct", _pct())


def daily(facts: DataFrame, rollup: DataFrame, today: Column, days: int) -> DataFrame:
    """One row a day over the last days, both sides cut at dates, newest first."""
    d = everything(facts, rollup).filter(F.col("date") >= F.date_sub(today, days))
    return d.groupBy("date").agg(*_totals()).withColumn("savings_pct", _pct()).orderBy(F.desc("date"))


def recent(facts: DataFrame, n: int, tie: str) -> DataFrame:
    return facts.orderBy(F.desc("timestamp"), F.desc(tie)).limit(n)


def top_commands(facts: DataFrame, rollup: DataFrame, n: int) -> DataFrame:
    d = everything(facts, rollup).groupBy("command").agg(*_totals()).withColumn("savings_pct", _pct())
    return d.orderBy(F.desc("saved_tokens"), "command").limit(n)


def rollup_days(facts: DataFrame, today: Column, above: int = ROLLUP_ABOVE) -> DataFrame:
    """Days before today with more than ``above`` facts."""
    d = facts.groupBy(F.to_date("timestamp").alias("date")).agg(F.count("*").alias("n"))
    return d.filter((F.col("n") > above) & (F.col("date") < today))


def compact(facts: DataFrame, rollup: DataFrame, today: Column, above: int = ROLLUP_ABOVE) -> tuple[DataFrame, DataFrame]:
    """(facts left, new rollup): facts of full days are merged into the rollup, whose averages are weighed by counts.

    Days are few, so the list of them is joined by broadcast only if the engine sees that it is small.
    """
    days = rollup_days(facts, today, above).select(F.col("date").alias("__day"))
    on = F.to_date("timestamp") == F.col("__day")
    moved = _as_rollup(facts.join(days, on, "left_semi"))
    merged = moved.unionByName(rollup).groupBy("date", "command").agg(
        *[F.sum(c).alias(c) for c in SUMS], (F.sum(F.col("avg_savings_pct") * F.col("commands")) / F.sum("commands")).alias("avg_savings_pct")
    )
    return facts.join(days, on, "left_anti"), merged


def cleanup(facts: DataFrame, now: Column, days: int) -> DataFrame:
    return facts.filter(F.col("timestamp") >= now - F.make_interval(days=F.lit(days)))


def write_compacted(facts: DataFrame, rollup: DataFrame, path: str) -> None:
    """Both tables as Parquet by date; only the dates at hand are replaced, so a rerun gives the same."""
    for name, d in (("commands", facts.withColumn("date", F.to_date("timestamp"))), ("commands_rollup", rollup)):
        d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{path}/{name}")


def format_summary(summary: DataFrame, top: DataFrame, style: str = "text") -> DataFrame:
    """(line) of the report on a ``summary`` of one row and its ``top`` commands, in order, as ``text``, ``csv`` or ``json``.

    The top commands are a few rows, so they are put into one.
    """
    rows = F.array_sort(F.collect_list(F.struct((-F.col("saved_tokens")).alias("o"), "command", "saved_tokens")))
    d = summary.select(F.lit(1).alias("one"), *SUMS, "savings_pct").join(top.groupBy(F.lit(1).alias("one")).agg(rows.alias("top")), "one", "left").withColumn("top", F.coalesce("top", F.expr("cast(array() as array<struct<o: long, command: string, saved_tokens: long>>)")))
    if style == "csv":
        lines = F.concat(F.array(F.lit("command,saved_tokens")), F.transform("top", lambda r: F.concat(r["command"], F.lit(","), r["saved_tokens"].cast("string"))))
    elif style == "json":
        pairs = F.transform("top", lambda r: F.concat(F.lit("["), F.to_json(F.struct(r["command"].alias("c"))).substr(F.lit(6), F.length(F.to_json(F.struct(r["command"].alias("c")))) - 6), F.lit(","), r["saved_tokens"].cast("string"), F.lit("]")))
        numbers = F.format_string('{"total_input_tokens":%d,"total_output_tokens":%d,"total_commands":%d,"top_commands":[', "input_tokens", "output_tokens", "commands")
        lines = F.array(F.concat(numbers, F.array_join(pairs, ","), F.lit("]}")))
    else:
        heads = F.array(
            F.format_string("Total commands:  %d", "commands"), F.format_string("Input tokens:    %d", "input_tokens"), F.format_string("Output tokens:   %d", "output_tokens"),
            F.format_string("Tokens saved:    %d (%.1f%%)", F.greatest(F.col("input_tokens") - F.col("output_tokens"), F.lit(0)), "savings_pct"),
        )
        shown = F.transform("top", lambda r: F.concat(F.lit("  "), T.left(r["command"], 20), F.lit(" "), T.right(r["saved_tokens"].cast("string"), 8), F.lit(" tokens")))
        lines = F.concat(heads, F.when(F.size("top") > 0, F.concat(F.array(F.lit(""), F.lit("Top commands by savings:")), shown)).otherwise(F.array().cast("array<string>")))
    return d.select(F.posexplode(lines).alias("n", "line")).orderBy("n").select("line")


def report(facts: DataFrame, rollup: DataFrame, today: Column, style: str = "text", top: int = 10, days: int | None = None, width: int = 40) -> dict[str, DataFrame]:
    """The parts of a statistics report: ``summary`` and, with ``days``, ``graph``: a line for each of the last days, oldest first."""
    parts = {"summary": format_summary(summary(facts, rollup), top_commands(facts, rollup, top), style)}
    if days is not None:
        d = graph(daily(facts, rollup, today, days), "saved_tokens", width)
        parts["graph"] = d.orderBy("date").select(F.concat_ws(" ", F.col("date").cast("string"), T.right(F.col("saved_tokens").cast("string"), 6), "bar").alias("line"))
    return parts


def telemetry(facts: DataFrame, rollup: DataFrame, today: Column, user: str, folder: str, version: str, os: str) -> DataFrame:
    """One row, the payload of a telemetry ping: an id that names no one, the totals, the ten commands that save most, without their arguments, and today's sums or null."""
    best = top_commands(facts, rollup, 10).select(F.struct(T.sanitize_command(F.col("command")).alias("command"), F.lit(0).cast("long").alias("count"), "saved_tokens").alias("c"), (-F.col("saved_tokens")).alias("o"), "command")
    best = best.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "command", "c"))), lambda x: x["c"]).alias("top_commands"))
    now = everything(facts, rollup).filter(F.col("date") == today).agg(F.max("date").cast("string").alias("date"), *_totals())
    now = now.select(F.when(F.col("date").isNotNull(), F.struct("date", *SUMS)).alias("today"))
    total = summary(facts, rollup).select(F.col("commands").alias("total_commands"), F.col("saved_tokens").alias("total_saved_tokens"), F.col("savings_pct").alias("avg_savings_pct"))
    one = lambda d: d.withColumn("__one", F.lit(1))  # noqa: E731 - each side is a single row
    d = one(total).join(F.broadcast(one(best)), "__one").join(F.broadcast(one(now)), "__one").drop("__one")
    return d.select(F.sha2(F.lit(f"{user}:{folder}"), 256).alias("installation_id"), F.lit(version).alias("version"), F.lit(os).alias("os"), "total_commands", "total_saved_tokens", "avg_savings_pct", "top_commands", "today")


def team_line(stats: DataFrame, body: str = "body") -> DataFrame:
    """Add ``shown``: a team's statistics, a JSON object in ``body``, as four lines; what is missing or no whole number counts as 0."""
    n = lambda name: F.coalesce(F.when(F.get_json_object(body, f"$.{name}").rlike(r"^\d+$"), F.get_json_object(body, f"$.{name}")), F.lit("0"))
    shown = F.concat(
        F.lit("Team savings : "), n("savings_pct"), F.lit("%\nTotal tokens : "), n("total_input_tokens"), F.lit(" in → "), n("total_output_tokens"), F.lit(" out\nCommands     : "), n("total_commands"), F.lit("\nMembers      : "), n("members"),
    )
    return stats.withColumn("shown", shown)


def graph(d: DataFrame, value: str, width: int = 40) -> DataFrame:
    """Add ``bar``, in proportion to the greatest value; for reports of a few rows."""
    most = d.agg(F.max(value).alias("__most"))
    return d.crossJoin(F.broadcast(most)).withColumn("bar", T.bar(F.col(value), F.col("__most"), width)).drop("__most")
