"""Fleet telemetry: validation, latest-wins tables and the dashboard's statistics."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevia.functions import text as T

#: The payload's schema, as DDL.
PAYLOAD_DDL = (
    "installation_id string, os string, version string, total_commands long, total_saved_tokens long, avg_savings_pct double, "
    "top_commands array<struct<command:string,count:long,saved_tokens:long>>, "
    "today struct<date:string,commands:long,input_tokens:long,output_tokens:long,saved_tokens:long>"
)
LARGEST_BODY = 65_536
ACTIVE_DAYS = 10


def parse(events: DataFrame, body: str = "body") -> DataFrame:
    """Add ``payload`` and ``status`` (200, 400 or 413) with ``reason``."""
    p = F.col("payload")
    d = events.withColumn("payload", F.when(F.octet_length(body) <= LARGEST_BODY, F.from_json(body, PAYLOAD_DDL)))
    text = lambda c, most: F.char_length(c).between(1, most)
    counts = lambda *cs: [F.coalesce(c >= 0, F.lit(False)) for c in cs]
    today = p["today"]
    rules = {
        "installation_id": p["installation_id"].rlike("^[0-9a-f]{64}$"),
        "os": text(p["os"], 40),
        "version": text(p["version"], 40),
        "total_commands": p["total_commands"] >= 0,
        "total_saved_tokens": p["total_saved_tokens"] >= 0,
        "avg_savings_pct": p["avg_savings_pct"].between(0, 100),
        "top_commands": p["top_commands"].isNull() | (F.size(p["top_commands"]) <= 50) & F.forall(p["top_commands"], lambda x: text(x["command"], 100) & (x["count"] >= 0) & (x["saved_tokens"] >= 0)),
        "today": today.isNull() | (today["date"].rlike(r"^\d{4}-\d{2}-\d{2}$") & reduce(and_, counts(*[today[c] for c in ("commands", "input_tokens", "output_tokens", "saved_tokens")]))),
    }
    failed = F.concat_ws(",", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    status = F.when(F.octet_length(body) > LARGEST_BODY, 413).when(p.isNull() | (failed != ""), 400).otherwise(200)
    reason = F.when(status == 413, "too large").when(status == 400, failed)
    return d.withColumns({"status": status, "reason": reason})


def clean_country(country: Column) -> Column:
    return F.when(country.rlike("^[A-Z0-9]{2}$") & ~country.isin("XX", "T1"), country)


def instances(pings: DataFrame) -> DataFrame:
    """One row for each installation: first and last sight, the last known country, the rest from the last ping."""
    newest = F.struct("ts", "ping_id")
    latest = F.max_by(F.struct("os", "version", "total_commands", "total_saved_tokens", "avg_savings_pct"), newest)
    d = pings.groupBy("installation_id").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), latest.alias("x"), F.max_by(F.when(F.col("country").isNotNull(), F.col("country")), F.when(F.col("country").isNotNull(), newest)).alias("country")
    )
    return d.select("installation_id", "first_seen", "last_seen", "country", "x.*")


def command_stats(pings: DataFrame) -> DataFrame:
    """Counts added up by day and command; repeated pings count again."""
    d = pings.select(F.to_date("ts").alias("date"), F.explode("top_commands").alias("c"))
    return d.groupBy("date", "c.command").agg(F.sum("c.count").alias("total_count"), F.sum("c.saved_tokens").alias("total_saved"))


def instance_daily(pings: DataFrame) -> DataFrame:
    """The last snapshot of each installation and day; pings without one are passed over."""
    d = pings.filter("today is not null").groupBy("installation_id", F.col("today.date").alias("date"))
    return d.agg(F.max_by("today", F.struct("ts", "ping_id")).alias("x")).select("installation_id", "date", "x.commands", "x.input_tokens", "x.output_tokens", "x.saved_tokens")


def active(inst: DataFrame, now: Column) -> DataFrame:
    return inst.filter(F.col("last_seen") >= now - F.make_interval(days=F.lit(ACTIVE_DAYS)))


def totals(inst: DataFrame, now: Column) -> DataFrame:
    is_active = F.col("last_seen") >= now - F.make_interval(days=F.lit(ACTIVE_DAYS))
    weighed = F.try_divide(F.sum(F.col("avg_savings_pct") * F.col("total_commands")), F.sum("total_commands"))
    return inst.agg(
        F.count("*").alias("total_instances"), F.count_if(is_active).alias("active_instances"), F.coalesce(F.sum("total_saved_tokens"), F.lit(0)).alias("saved_tokens"),
        F.coalesce(F.avg("avg_savings_pct"), F.lit(0.0)).alias("avg_savings_pct"), F.coalesce(weighed, F.lit(0.0)).alias("weighted_savings_pct"),
    )


def by(inst: DataFrame, now: Column, dim: str, missing: str = "??") -> DataFrame:
    return active(inst, now).groupBy(F.coalesce(F.col(dim), F.lit(missing)).alias(dim)).agg(F.count("*").alias("instances"))


def as_map(d: DataFrame, key: str, value: str) -> DataFrame:
    """One row with a map, for a dimension of few values."""
    return d.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(key))


def top_commands(stats: DataFrame, today: Column, days: int = 30, n: int = 10) -> DataFrame:
    d = stats.filter(F.col("date") >= F.date_sub(today, days)).groupBy("command").agg(F.sum("total_count").alias("count"), F.sum("total_saved").alias("saved_tokens"))
    return d.orderBy(F.desc("saved_tokens"), "command").limit(n)


def daily_series(daily: DataFrame, since: str) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("commands", "input_tokens", "output_tokens", "saved_tokens")]
    return daily.filter(F.col("date") >= since).groupBy("date").agg(F.countDistinct("installation_id").alias("instances"), *sums).orderBy("date")


def statistics(inst: DataFrame, stats: DataFrame, daily: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """One row, the dashboard's answer: totals, maps of active installations by country, system and version, the top commands and a series of days, with ``generated_at``.

    Each part is aggregated where its rows are and is small by then (one row, or one for each value of a dimension, each of the top
    commands, each day of the window), so that the parts are put together by broadcast.
    """
    one = lambda d: d.withColumn("__one", F.lit(1))  # noqa: E731 - each side is a single row
    since = F.date_sub(F.to_date(now), days)
    top = top_commands(stats, F.to_date(now), days).agg(F.array_sort(F.collect_list(F.struct((-F.col("saved_tokens")).alias("o"), "command", "count", "saved_tokens"))).alias("x"))
    top = top.select(F.transform("x", lambda r: F.struct(r["command"].alias("command"), r["count"].alias("count"), r["saved_tokens"].alias("saved_tokens"))).alias("top_commands"))
    series = daily.filter(F.col("date") >= F.date_format(since, "yyyy-MM-dd")).groupBy("date").agg(F.count_distinct("installation_id").alias("active_instances"), *[F.sum(c).alias(c) for c in ("commands", "input_tokens", "output_tokens", "saved_tokens")])
    series = series.withColumn("avg_savings_pct", T.savings_pct_rounded(F.col("input_tokens"), F.col("output_tokens")))
    series = series.agg(F.array_sort(F.collect_list(F.struct("date", "active_instances", "commands", "input_tokens", "output_tokens", "saved_tokens", "avg_savings_pct"))).alias("daily"))
    total = totals(inst, now).select("active_instances", "total_instances", F.lit(ACTIVE_DAYS).alias("inactive_threshold_days"), F.col("saved_tokens").alias("total_saved_tokens"), (F.floor(F.col("avg_savings_pct") * 100 + 0.5) / 100).alias("avg_savings_pct"))
    d = one(total)
    for dim in ("country", "os", "version"):
        d = d.join(F.broadcast(one(as_map(by(inst, now, dim), dim, "instances").withColumnRenamed(dim, f"by_{dim}"))), "__one")
    return d.join(F.broadcast(one(top)), "__one").join(F.broadcast(one(series)), "__one").drop("__one").withColumn("generated_at", now)


REPORT_DDL = "array<struct<command: string, input_tokens: long, output_tokens: long, savings_pct: long, timestamp_secs: long>>"


def report_events(reports: DataFrame, body: str = "body") -> DataFrame:
    """The events of batch reports, a JSON array in each ``body``, a row each beside the report's other columns.

    A report that is no array, or holds an event without one of its fields or with a negative number, is rejected as a whole and gives no rows.
    """
    whole = lambda e: e["command"].isNotNull() & reduce(and_, [F.coalesce(e[c] >= 0, F.lit(False)) for c in ("input_tokens", "output_tokens", "savings_pct", "timestamp_secs")])
    d = reports.select(F.struct(*[c for c in reports.columns if c != body]).alias("__report"), F.from_json(body, REPORT_DDL).alias("__events"))
    d = d.filter(F.col("__events").isNotNull() & F.forall("__events", whole))
    return d.select("__report", F.explode("__events").alias("__event")).select("__report.*", "__event.*")


def team_stats(events: DataFrame, team: str = "team", member: str = "member") -> DataFrame:
    """(team, total_input_tokens, total_output_tokens, savings_pct, total_commands, members); percents are whole, rounded down."""
    d = events.groupBy(team).agg(
        F.sum("input_tokens").alias("total_input_tokens"), F.sum("output_tokens").alias("total_output_tokens"), F.count("*").alias("total_commands"), F.count_distinct(member).alias("members")
    )
    return d.withColumn("savings_pct", T.savings_pct_floor(F.col("total_input_tokens"), F.col("total_output_tokens")))
