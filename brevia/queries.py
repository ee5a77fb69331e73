"""Named queries over the test tables, each with the SQL that gives the same rows.

Facts come from the tables by fixed rules, and "now" is the greatest time in them, so every query can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brevia.functions import text as T
from brevia.operators import dedup, fleet, meter, scan, snapshot
from brevia.plans import rules as R
from brevia.sources import transcripts
from brevia.sources.folders import shared_folder
from brevia.sources.tables import read as table
from brevia.sources.tables import spread

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents for work on their texts."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *columns), "doc_id")


#: The rule that documents are compressed with in the queries below.
DOC_RULE = R.Rule("documents", strip_patterns=(r"^\s*$", r"^\S+$"), head_lines=8, tail_lines=4, max_line_chars=200, empty_message="ok")

# SQL pieces. A line array as the engine makes it, and tokens of a text.
_LINES = "CASE WHEN {0} = '' THEN [] ELSE string_split(regexp_replace({0}, '\\r?\\n$', ''), chr(10)) END"
_TOKENS = "len(regexp_extract_all({0}, '\\S+'))"
_RUNS = "list_filter(range(1, len({0}) + 1), lambda i: i = 1 OR {0}[i] <> {0}[i - 1])"
_PIPELINE = f"""
d AS (SELECT doc_id, lang, source, text, {_LINES.format('text')} AS a0 FROM documents),
s AS (SELECT *, list_filter(a0, lambda x: NOT regexp_matches(x, '(?:^\\s*$)|(?:^\\S+$)')) AS a FROM d),
r AS (SELECT *, {_RUNS.format('a')} AS st FROM s),
u AS (SELECT *, flatten(list_transform(range(1, len(st) + 1), lambda k:
        CASE WHEN coalesce(st[k + 1], len(a) + 1) - st[k] >= 3
             THEN [a[st[k]] || ' (×' || (coalesce(st[k + 1], len(a) + 1) - st[k])::VARCHAR || ')']
             ELSE list_transform(range(0, coalesce(st[k + 1], len(a) + 1) - st[k]), lambda j: a[st[k]]) END)) AS b FROM r),
w AS (SELECT *, CASE WHEN len(b) > 12 THEN list_concat(b[1:8], b[len(b) - 3:len(b)]) ELSE b END AS c FROM u),
p AS (SELECT doc_id, lang, source, text, CASE WHEN NOT regexp_matches(text, '\\S') OR NOT regexp_matches(array_to_string(list_transform(c, lambda x: x[1:200]), chr(10)), '\\S')
        THEN 'ok' ELSE array_to_string(list_transform(c, lambda x: x[1:200]), chr(10)) END AS out FROM w)"""


def compressed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir, "lang", "source")
    return R.apply_rule(d, DOC_RULE, "text", "out")


@query(
    f"WITH {_PIPELINE} SELECT lang, count(*) AS documents, sum({_TOKENS.format('text')})::BIGINT AS input_tokens, sum({_TOKENS.format('out')})::BIGINT AS output_tokens, "
    f"sum(greatest({_TOKENS.format('text')} - {_TOKENS.format('out')}, 0))::BIGINT AS saved_tokens FROM p GROUP BY lang"
)
def doc_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = compressed_documents(spark, sf_dir).select("lang", T.count_tokens(F.col("text")).alias("i"), T.count_tokens(F.col("out")).alias("o"))
    return d.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), F.sum(T.saved(F.col("i"), F.col("o"))).alias("saved_tokens"))


@query(f"WITH {_PIPELINE} SELECT doc_id, md5(out) AS digest, {_TOKENS.format('out')}::BIGINT AS tokens FROM p")
def rule_pipeline_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed_documents(spark, sf_dir).select("doc_id", F.md5("out").alias("digest"), T.count_tokens(F.col("out")).alias("tokens"))


@query(f"SELECT lang, sum({_TOKENS.format('text')})::BIGINT AS tokens, sum(len({_LINES.format('text')}))::BIGINT AS n_lines FROM documents GROUP BY lang")
def count_tokens_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir, "lang")
    return d.groupBy("lang").agg(F.sum(T.count_tokens(F.col("text"))).alias("tokens"), F.sum(F.size(T.lines(F.col("text")))).cast("long").alias("n_lines"))


_LITERALS = " UNION ALL SELECT * FROM (VALUES (-1, 'auth: Bearer abc.def token=xyz'), (-2, '/home/ann/x /Users/bob.b/y ghp_' || repeat('a', 36)), (-3, 'AKIA' || repeat('Q', 16) || ' sk-' || repeat('b', 48) || ' -----BEGIN RSA PRIVATE KEY-----')) t(doc_id, text)"


@query(
    "WITH t AS (SELECT doc_id, text FROM documents" + _LITERALS + "), "
    "r AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(/Users/|/home/)[a-zA-Z0-9_.\\-]+', '\\1user', 'g'), "
    "'Bearer\\s+[A-Za-z0-9\\-._~+/]+=*', '[REDACTED]', 'g'), '(?i)(api[_\\-]?key|token|secret|password|credential|auth)\\s*[:=]\\s*\\S+', '[REDACTED]', 'g'), 'ghp_[A-Za-z0-9]{36}', '[REDACTED]', 'g'), "
    "'AKIA[0-9A-Z]{16}', '[REDACTED]', 'g'), 'sk-[A-Za-z0-9]{48}', '[REDACTED]', 'g'), '(?i)-----BEGIN\\s+(?:RSA\\s+)?PRIVATE\\s+KEY-----', '[REDACTED]', 'g') AS clean FROM t) "
    "SELECT doc_id::BIGINT AS doc_id, md5(clean) AS digest, (len(regexp_extract_all(clean, '\\[REDACTED\\]')))::BIGINT AS hits FROM r WHERE clean <> text"
)
def redact_secrets_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = [(-1, "auth: Bearer abc.def token=xyz"), (-2, "/home/ann/x /Users/bob.b/y ghp_" + "a" * 36), (-3, "AKIA" + "Q" * 16 + " sk-" + "b" * 48 + " -----BEGIN RSA PRIVATE KEY-----")]
    d = texts(spark, sf_dir).union(spark.createDataFrame(more, "doc_id long, text string"))
    d = d.withColumn("clean", T.sanitize_output(F.col("text"))).filter("clean <> text")
    return d.select("doc_id", F.md5("clean").alias("digest"), F.regexp_count("clean", F.lit(r"\[REDACTED\]")).cast("long").alias("hits"))


@query(
    "WITH t AS (SELECT doc_id, chr(27) || '[31m' || text || chr(27) || '[0m' AS x, '10%' || chr(13) || '50%██░░' || chr(13) || text AS y FROM documents), "
    "u AS (SELECT doc_id, regexp_replace(x, '\\x1b\\[[0-9;]*[a-zA-Z]', '', 'g') AS plain, " + _LINES.format("y") + " AS ls FROM t) "
    "SELECT doc_id, md5(plain) AS plain, md5(regexp_replace(array_to_string(list_transform(ls, lambda l: regexp_replace(l, '(?s)^.*\\r', '')), chr(10)), '[█▓▒░╱╲│─━═]{2,}', '', 'g')) AS quiet FROM u"
)
def strip_ansi_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir)
    x, y = F.concat(F.lit("\x1b[31m"), "text", F.lit("\x1b[0m")), F.concat(F.lit("10%\r50%██░░\r"), "text")
    return d.select("doc_id", F.md5(T.strip_ansi(x)).alias("plain"), F.md5(T.strip_progress_noise(y)).alias("quiet"))


@query(
    f"WITH l AS (SELECT doc_id, unnest({_LINES.format('text')}) AS line, unnest(range(1, len({_LINES.format('text')}) + 1)) AS pos FROM documents WHERE text <> ''), "
    "g AS (SELECT *, CASE WHEN line = lag(line) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM l), "
    "i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM g), "
    "n AS (SELECT doc_id, island, count(*) AS n FROM i GROUP BY doc_id, island) "
    "SELECT doc_id, count(*)::BIGINT AS runs, sum(CASE WHEN n >= 3 THEN 1 ELSE n END)::BIGINT AS lines_left, count_if(n >= 3)::BIGINT AS folded FROM n GROUP BY doc_id"
)
def dedupe_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.once(texts(spark, sf_dir).filter("text <> ''"), a=T.lines(F.col("text")))
    d = T.once(d, runs=F.size(T.dedupe_repeated_lines(F.col("a"), 2)).cast("long"), out=T.dedupe_repeated_lines(F.col("a")))
    folded = F.size(F.filter("out", lambda x: x.rlike(" \\(×[0-9]+\\)$"))).cast("long")
    return d.select("doc_id", "runs", F.size("out").cast("long").alias("lines_left"), folded.alias("folded"))


@query(
    f"WITH d AS (SELECT doc_id, text, {_LINES.format('text')} AS a FROM documents) SELECT doc_id, "
    "md5(array_to_string(CASE WHEN len(a) > 8 THEN list_concat(list_concat(a[1:5], ['... (' || (len(a) - 8)::VARCHAR || ' lines omitted) ...']), a[len(a) - 2:len(a)]) ELSE a END, chr(10))) AS marked, "
    "md5(array_to_string(CASE WHEN len(a) > 8 THEN list_concat(a[1:5], a[len(a) - 2:len(a)]) ELSE a END, chr(10))) AS plain, "
    "md5(array_to_string(list_transform(a, lambda x: CASE WHEN length(x) > 80 THEN x[1:77] || '...' ELSE x END), chr(10))) AS narrow, "
    "md5(CASE WHEN length(text) > 1000 THEN text[1:984] || '... (truncated)' ELSE text END) AS capped FROM d"
)
def head_tail_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.once(texts(spark, sf_dir), a=T.lines(F.col("text")))
    a = F.col("a")
    return d.select(
        "doc_id", F.md5(T.joined(T.head_tail(a, 5, 3))).alias("marked"), F.md5(T.joined(T.window(a, 5, 3))).alias("plain"),
        F.md5(T.joined(F.transform(a, lambda x: T.truncate_line(x, 80)))).alias("narrow"), F.md5(T.hard_cap(F.col("text"), 1000)).alias("capped"),
    )


@query(
    f"WITH l AS (SELECT doc_id, unnest({_LINES.format('text')}) AS line, unnest(range(1, len({_LINES.format('text')}) + 1)) AS pos FROM documents WHERE text <> ''), "
    f"t AS (SELECT *, {_TOKENS.format('line')} AS tok, count(*) OVER (PARTITION BY doc_id) AS n FROM l), "
    "c AS (SELECT *, sum(tok) OVER (PARTITION BY doc_id) AS total, sum(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS up, sum(tok) OVER (PARTITION BY doc_id ORDER BY pos DESC) AS down FROM t), "
    "g AS (SELECT doc_id, any_value(n) AS n, any_value(total) AS total, coalesce(min(CASE WHEN up > 60 THEN pos END) - 1, any_value(n)) AS h, coalesce(any_value(n) - max(CASE WHEN down > 40 THEN pos END), any_value(n)) AS t FROM c GROUP BY doc_id) "
    "SELECT doc_id, (CASE WHEN total <= 100 OR h + t >= n OR (h = 0 AND t = 0) THEN n ELSE h + t + 1 END)::BIGINT AS lines_left FROM g"
)
def head_tail_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.once(texts(spark, sf_dir).filter("text <> ''"), a=T.lines(F.col("text")))
    return d.select("doc_id", F.size(T.head_tail_by_tokens(F.col("a"), 100)).cast("long").alias("lines_left"))


_RULES = [
    R.Rule("git", ("git", "git log"), source="builtin"), R.Rule("git-status", ("git status",), source="builtin"), R.Rule("cargo", ("cargo", "cargo test"), source="builtin"),
    R.Rule("git", ("git",), source="project"), R.Rule("npm", ("npm run", "npm"), source="extension"),
]
_COMMANDS = "CASE doc_id % 6 WHEN 0 THEN 'git status -s' WHEN 1 THEN 'git log' WHEN 2 THEN 'cargo tests' WHEN 3 THEN 'npm run build' WHEN 4 THEN 'gitk' ELSE 'npmx ' || lang END"


@query(
    f"WITH c AS (SELECT doc_id, {_COMMANDS} AS command FROM documents), t(rule, prefix, ord) AS (VALUES ('git', 'git', 0), ('git-status', 'git status', 1), ('cargo', 'cargo', 2), ('cargo', 'cargo test', 2), ('npm', 'npm run', 3), ('npm', 'npm', 3)), "
    "m AS (SELECT doc_id, command, rule, row_number() OVER (PARTITION BY doc_id ORDER BY length(prefix) DESC NULLS LAST, ord) AS k FROM c LEFT JOIN t ON starts_with(command, prefix) AND string_split(command, ' ')[1] = string_split(prefix, ' ')[1]) "
    "SELECT doc_id, command, rule FROM m WHERE k = 1"
)
def rule_match_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_COMMANDS).alias("command"))
    return R.match_rules(runs, R.rule_table(spark, R.by_precedence(_RULES)))


# Usage meter: facts are events, with tokens from their value; what is older than ten days before the end is in the rollup.

_FACTS = (
    "n AS (SELECT max(ts) AS now FROM events), "
    "f AS (SELECT event_id, ts AS timestamp, event_type AS command, user_id::VARCHAR AS project_path, floor(value)::BIGINT AS input_tokens, floor(value / 3)::BIGINT AS output_tokens FROM events), "
    "facts AS (SELECT *, greatest(input_tokens - output_tokens, 0) AS saved_tokens, CASE WHEN input_tokens > 0 THEN greatest(input_tokens - output_tokens, 0)::DOUBLE / input_tokens * 100 ELSE 0.0 END AS savings_pct FROM f), "
    "live AS (SELECT facts.* FROM facts, n WHERE timestamp::DATE >= now::DATE - 10), "
    "roll AS (SELECT timestamp::DATE AS date, command, count(*) AS commands, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, sum(saved_tokens) AS saved_tokens, avg(savings_pct) AS avg_savings_pct FROM facts, n WHERE timestamp::DATE < now::DATE - 10 GROUP BY 1, 2), "
    "every AS (SELECT timestamp::DATE AS date, command, 1 AS commands, input_tokens, output_tokens, saved_tokens FROM live UNION ALL SELECT date, command, commands, input_tokens, output_tokens, saved_tokens FROM roll)"
)
_SUMS = "sum(commands)::BIGINT AS commands, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(saved_tokens)::BIGINT AS saved_tokens, CASE WHEN sum(input_tokens) > 0 THEN 100.0::DOUBLE * sum(saved_tokens)::DOUBLE / sum(input_tokens)::DOUBLE ELSE 0.0 END AS savings_pct"


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Column]:
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now")).first()["now"]
    d = e.select("event_id", F.col("ts").alias("timestamp"), F.col("event_type").alias("command"), F.col("user_id").cast("string").alias("project_path"), F.floor("value").cast("long").alias("input_tokens"), F.floor(F.col("value") / 3).cast("long").alias("output_tokens"))
    d = d.withColumns({"saved_tokens": T.saved(F.col("input_tokens"), F.col("output_tokens")), "savings_pct": T.savings_pct(F.col("input_tokens"), F.col("output_tokens"))})
    now = F.lit(now)
    old = F.to_date("timestamp") < F.date_sub(F.to_date(now), 10)
    return d.filter(~old), meter._as_rollup(d.filter(old)), now


@query(f"WITH {_FACTS} SELECT {_SUMS} FROM every")
def meter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, rollup, _ = _facts(spark, sf_dir)
    return meter.summary(live, rollup)


@query(f"WITH {_FACTS} SELECT date, {_SUMS} FROM every, n WHERE date >= now::DATE - 14 GROUP BY date")
def meter_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, rollup, now = _facts(spark, sf_dir)
    return meter.daily(live, rollup, F.to_date(now), 14)


@query(f"WITH {_FACTS} SELECT * FROM live ORDER BY timestamp DESC, event_id DESC LIMIT 20")
def meter_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meter.recent(_facts(spark, sf_dir)[0], 20, "event_id")


@query(f"WITH {_FACTS} SELECT command, {_SUMS} FROM every GROUP BY command ORDER BY saved_tokens DESC, command LIMIT 10")
def meter_top_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, rollup, _ = _facts(spark, sf_dir)
    return meter.top_commands(live, rollup, 10)


@query(
    f"WITH {_FACTS}, s AS (SELECT {_SUMS} FROM every), t AS (SELECT command, {_SUMS} FROM every GROUP BY command ORDER BY saved_tokens DESC, command LIMIT 10) "
    "SELECT 'Total commands:  ' || commands AS line FROM s UNION ALL SELECT 'Input tokens:    ' || input_tokens FROM s UNION ALL SELECT 'Output tokens:   ' || output_tokens FROM s "
    "UNION ALL SELECT printf('Tokens saved:    %d (%.1f%%)', greatest(input_tokens - output_tokens, 0), savings_pct) FROM s UNION ALL SELECT unnest(['', 'Top commands by savings:']) FROM s "
    "UNION ALL SELECT '  ' || rpad(command, greatest(20, length(command))::INTEGER, ' ') || ' ' || lpad(saved_tokens::VARCHAR, greatest(8, length(saved_tokens::VARCHAR))::INTEGER, ' ') || ' tokens' FROM t"
)
def meter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, rollup, now = _facts(spark, sf_dir)
    return meter.report(live, rollup, F.to_date(now))["summary"]


@query(
    f"WITH {_FACTS}, d AS (SELECT date, {_SUMS} FROM every, n WHERE date >= now::DATE - 14 GROUP BY date) "
    "SELECT date::VARCHAR || ' ' || lpad(saved_tokens::VARCHAR, greatest(6, length(saved_tokens::VARCHAR))::INTEGER, ' ') || ' ' || repeat('█', round(saved_tokens::DOUBLE / greatest((SELECT max(saved_tokens) FROM d), 1) * 40)::INTEGER) AS line FROM d"
)
def meter_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, rollup, now = _facts(spark, sf_dir)
    return meter.report(live, rollup, F.to_date(now), days=14)["graph"]


@query(
    f"WITH {_FACTS}, s AS (SELECT {_SUMS} FROM every), t AS (SELECT command, {_SUMS} FROM every GROUP BY command ORDER BY saved_tokens DESC, command LIMIT 10), d AS (SELECT {_SUMS} FROM every, n WHERE date = now::DATE) "
    "SELECT sha256('ann:/home/ann/.config') AS installation_id, s.commands AS total_commands, s.saved_tokens AS total_saved_tokens, s.savings_pct AS avg_savings_pct, "
    "(SELECT string_agg(command || '=' || saved_tokens, ',' ORDER BY saved_tokens DESC, command) FROM t) AS top_commands, d.commands AS today FROM s, d"
)
def meter_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, rollup, now = _facts(spark, sf_dir)
    d = meter.telemetry(live, rollup, F.to_date(now), "ann", "/home/ann/.config", "1.0.0", "linux")
    top = F.array_join(F.transform("top_commands", lambda c: F.concat(c["command"], F.lit("="), c["saved_tokens"].cast("string"))), ",")
    return d.select("installation_id", "total_commands", "total_saved_tokens", "avg_savings_pct", top.alias("top_commands"), F.col("today.commands").alias("today"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS facts, sum(o_custkey)::BIGINT AS o_custkey FROM orders GROUP BY 1, 2")
def snapshot_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums kept over three refreshes: of a part of the facts, within the time limit, and of all."""
    facts = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    middle = facts.agg(F.avg("o_orderkey")).first()[0]
    kept = snapshot.Snapshot(shared_folder(spark), ["o_orderstatus", "o_orderpriority"], ["o_custkey"], "o_orderkey")
    kept.refresh(facts.filter(F.col("o_orderkey") < middle), now=0)
    kept.refresh(facts, now=1)
    return kept.refresh(facts, now=100)


@query(
    "WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_type, count(*) AS facts, max(ts) AS newest FROM events, n WHERE ts >= now - INTERVAL 9 DAY AND ts < now - INTERVAL 2 DAY GROUP BY event_type"
)
def facts_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a week, from the files that an index of least and greatest times names."""
    e = table(spark, sf_dir, "events").select("ts", "event_type")
    now, folder = F.lit(e.agg(F.max("ts")).first()[0]), shared_folder(spark)
    snapshot.write_clustered(e, folder, "ts", 16)
    d = snapshot.read_between(spark, folder, "ts", now - F.expr("interval 9 days"), now - F.expr("interval 2 days"))
    return d.groupBy("event_type").agg(F.count("*").alias("facts"), F.max("ts").alias("newest"))


_COMPACT = (
    "days AS (SELECT timestamp::DATE AS day FROM live, n WHERE timestamp::DATE < now::DATE GROUP BY 1 HAVING count(*) > 100), "
    "moved AS (SELECT timestamp::DATE AS date, command, count(*) AS commands, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, sum(saved_tokens) AS saved_tokens, avg(savings_pct) AS avg_savings_pct FROM live WHERE timestamp::DATE IN (SELECT day FROM days) GROUP BY 1, 2)"
)


@query(
    f"WITH {_FACTS}, {_COMPACT} SELECT date, command, sum(commands)::BIGINT AS commands, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(saved_tokens)::BIGINT AS saved_tokens, "
    "round(sum(avg_savings_pct * commands) / sum(commands), 6) AS avg_savings_pct FROM (SELECT * FROM moved UNION ALL SELECT * FROM roll) GROUP BY date, command"
)
def meter_rollup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, rollup, now = _facts(spark, sf_dir)
    merged = meter.compact(live, rollup, F.to_date(now))[1]
    return merged.withColumn("avg_savings_pct", F.round("avg_savings_pct", 6))


@query(f"WITH {_FACTS}, {_COMPACT} SELECT event_id, timestamp, command FROM live WHERE timestamp::DATE NOT IN (SELECT day FROM days)")
def meter_rollup_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, rollup, now = _facts(spark, sf_dir)
    return meter.compact(live, rollup, F.to_date(now))[0].select("event_id", "timestamp", "command")


@query(f"WITH {_FACTS} SELECT event_id FROM live, n WHERE timestamp >= now - INTERVAL 3 DAY")
def meter_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, _, now = _facts(spark, sf_dir)
    return meter.cleanup(live, now, 3).select("event_id")


@query(
    "WITH t AS (SELECT l_orderkey, l_linenumber, floor(l_extendedprice)::BIGINT AS i, floor(l_extendedprice * l_quantity / 20)::BIGINT AS o FROM lineitem) SELECT l_orderkey, l_linenumber, "
    "CASE WHEN i > 0 THEN greatest(i - o, 0)::DOUBLE / i * 100 ELSE 0.0 END AS pct, CASE WHEN i > 0 THEN (greatest(i - o, 0) * 100) // i ELSE 0 END AS floored, "
    "CASE WHEN i > 0 THEN (1 - o::DOUBLE / i) * 100 ELSE 0.0 END AS signed FROM t"
)
def savings_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem")
    i, o = F.floor("l_extendedprice").cast("long"), F.floor(F.col("l_extendedprice") * F.col("l_quantity") / 20).cast("long")
    return d.select("l_orderkey", "l_linenumber", T.savings_pct(i, o).alias("pct"), T.savings_pct_floor(i, o).alias("floored"), T.savings_pct_signed(i, o).alias("signed"))


# Repeated runs: an event is a run of a user's command; its output is empty now and then.

_DEDUP = (
    "r AS (SELECT event_id AS run_id, 'tool' || (user_id % 3)::VARCHAR AS tool_id, (user_id // 10)::VARCHAR AS project_path, event_type AS cmd_key, ts, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'out' || (event_id % 2)::VARCHAR END AS output, "
    "(event_id % 7 = 3)::INT AS exit_code, event_id % 13 = 0 AS opted_out FROM events)"
)


@query(
    f"WITH {_DEDUP}, k AS (SELECT *, lag(run_id) OVER w AS p, lag(ts) OVER w AS pts, lag(output) OVER w AS po, lag(exit_code) OVER w AS pe FROM r WHERE output <> '' AND NOT opted_out WINDOW w AS (PARTITION BY tool_id, project_path, cmd_key ORDER BY ts, run_id)), "
    "h AS (SELECT *, coalesce(floor(epoch(ts)) - floor(epoch(pts)) <= 7200 AND po = output AND pe = exit_code, false) AS hit FROM k) "
    "SELECT run_id, CASE WHEN hit THEN 'hit' ELSE 'miss' END AS decision, CASE WHEN hit THEN p END AS previous_run FROM h UNION ALL SELECT run_id, 'skip', NULL FROM r WHERE output = '' OR opted_out"
)
def dedup_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    runs = e.selectExpr(
        "event_id as run_id", "concat('tool', user_id % 3) as tool_id", "cast(user_id div 10 as string) as project_path", "event_type as cmd_key", "ts",
        "case when event_id % 11 = 0 then '' else concat('out', event_id % 2) end as output", "cast(event_id % 7 = 3 as int) as exit_code", "event_id % 13 = 0 as opted_out", "0L as cwd_mtime",
    )
    return dedup.decide(runs, ttl_s=7200).select("run_id", "decision", "previous_run")


# Fleet: an event is a ping of its user's installation.

_PINGS = (
    "p AS (SELECT event_id AS ping_id, sha256(user_id::VARCHAR) AS installation_id, ts, CASE user_id % 4 WHEN 0 THEN 'DE' WHEN 1 THEN 'XX' WHEN 2 THEN 'FR' END AS raw_country, event_type AS os, 'v' || (event_id % 5)::VARCHAR AS version, event_id AS total_commands, "
    "floor(value)::BIGINT AS total_saved_tokens, (event_id % 100)::DOUBLE AS avg_savings_pct, ts::DATE AS date FROM events), "
    "c AS (SELECT *, CASE WHEN regexp_matches(raw_country, '^[A-Z0-9]{2}$') AND raw_country NOT IN ('XX', 'T1') THEN raw_country END AS country FROM p), "
    "i AS (SELECT installation_id, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(country, (ts, ping_id)) FILTER (WHERE country IS NOT NULL) AS country, arg_max(os, (ts, ping_id)) AS os, arg_max(version, (ts, ping_id)) AS version, "
    "arg_max(total_commands, (ts, ping_id)) AS total_commands, arg_max(total_saved_tokens, (ts, ping_id)) AS total_saved_tokens, arg_max(avg_savings_pct, (ts, ping_id)) AS avg_savings_pct FROM c GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)"
)


def _pings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    e = table(spark, sf_dir, "events")
    now = F.lit(e.agg(F.max("ts").alias("now")).first()["now"])
    country = F.expr("case user_id % 4 when 0 then 'DE' when 1 then 'XX' when 2 then 'FR' end")
    saved = F.floor("value").cast("long")
    d = e.select(
        F.col("event_id").alias("ping_id"), F.sha2(F.col("user_id").cast("string"), 256).alias("installation_id"), "ts", fleet.clean_country(country).alias("country"), F.col("event_type").alias("os"),
        F.concat(F.lit("v"), (F.col("event_id") % 5).cast("string")).alias("version"), F.col("event_id").alias("total_commands"), saved.alias("total_saved_tokens"), (F.col("event_id") % 100).cast("double").alias("avg_savings_pct"),
        F.array(F.struct(F.col("event_type").alias("command"), (F.col("event_id") % 7).alias("count"), saved.alias("saved_tokens"))).alias("top_commands"),
        F.when(F.col("event_id") % 3 > 0, F.struct(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_id").alias("commands"), (saved * 2).alias("input_tokens"), saved.alias("output_tokens"), saved.alias("saved_tokens"))).alias("today"),
    )
    return d, now


@query(f"WITH {_PINGS} SELECT * FROM i")
def fleet_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.instances(_pings(spark, sf_dir)[0])


@query("SELECT ts::DATE AS date, event_type AS command, sum(event_id % 7)::BIGINT AS total_count, sum(floor(value)::BIGINT)::BIGINT AS total_saved FROM events GROUP BY 1, 2")
def fleet_command_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.command_stats(_pings(spark, sf_dir)[0])


_DAILY = (
    "dd AS (SELECT installation_id, strftime(date, '%Y-%m-%d') AS date, arg_max(total_commands, (ts, ping_id)) AS commands, arg_max(total_saved_tokens, (ts, ping_id)) * 2 AS input_tokens, "
    "arg_max(total_saved_tokens, (ts, ping_id)) AS output_tokens, arg_max(total_saved_tokens, (ts, ping_id)) AS saved_tokens FROM c WHERE ping_id % 3 > 0 GROUP BY 1, 2)"
)


@query(f"WITH {_PINGS}, {_DAILY} SELECT * FROM dd")
def fleet_daily_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.instance_daily(_pings(spark, sf_dir)[0])


@query(
    f"WITH {_PINGS} SELECT count(*) AS total_instances, count_if(last_seen >= now - INTERVAL 10 DAY) AS active_instances, sum(total_saved_tokens)::BIGINT AS saved_tokens, round(avg(avg_savings_pct), 6) AS avg_savings_pct, "
    "round(sum(avg_savings_pct * total_commands) / sum(total_commands), 6) AS weighted_savings_pct FROM i, n"
)
def fleet_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, now = _pings(spark, sf_dir)
    t = fleet.totals(fleet.instances(d), now)
    return t.withColumns({c: F.round(c, 6) for c in ("avg_savings_pct", "weighted_savings_pct")})


@query(f"WITH {_PINGS} " + " UNION ALL ".join(f"SELECT '{c}' AS dim, coalesce({c}, '??') AS value, count(*) AS instances FROM i, n WHERE last_seen >= now - INTERVAL 10 DAY GROUP BY 2" for c in ("country", "os", "version")))
def fleet_by_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, now = _pings(spark, sf_dir)
    inst = fleet.instances(d)
    parts = [fleet.by(inst, now, c).select(F.lit(c).alias("dim"), F.col(c).alias("value"), "instances") for c in ("country", "os", "version")]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT event_type AS command, sum(event_id % 7)::BIGINT AS count, sum(floor(value)::BIGINT)::BIGINT AS saved_tokens FROM events WHERE ts::DATE >= (SELECT max(ts)::DATE FROM events) - 30 GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10")
def fleet_top_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, now = _pings(spark, sf_dir)
    return fleet.top_commands(fleet.command_stats(d), F.to_date(now))


@query(f"WITH {_PINGS}, {_DAILY} SELECT date, count(DISTINCT installation_id) AS instances, sum(commands)::BIGINT AS commands, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(saved_tokens)::BIGINT AS saved_tokens FROM dd WHERE date >= '2024-01-10' GROUP BY date")
def fleet_daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.daily_series(fleet.instance_daily(_pings(spark, sf_dir)[0]), "2024-01-10")


@query(
    f"WITH {_PINGS}, {_DAILY}, a AS (SELECT i.* FROM i, n WHERE last_seen >= now - INTERVAL 10 DAY), "
    + ", ".join(f"m{c} AS (SELECT string_agg(value || '=' || k, ',' ORDER BY value) AS by_{c} FROM (SELECT coalesce({c}, '??') AS value, count(*) AS k FROM a GROUP BY 1))" for c in ("country", "os", "version"))
    + ", c30 AS (SELECT event_type AS command, sum(event_id % 7)::BIGINT AS k, sum(floor(value)::BIGINT)::BIGINT AS saved FROM events WHERE ts::DATE >= (SELECT max(ts)::DATE FROM events) - 30 GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10), "
    "d30 AS (SELECT date, count(DISTINCT installation_id) AS k, sum(commands)::BIGINT AS commands, round(100 - 100.0::DOUBLE * sum(output_tokens) / sum(input_tokens), 2) AS pct FROM dd, n WHERE date::DATE >= now::DATE - 30 GROUP BY date) "
    "SELECT (SELECT count(*) FROM a) AS active_instances, (SELECT count(*) FROM i) AS total_instances, (SELECT sum(total_saved_tokens)::BIGINT FROM i) AS total_saved_tokens, (SELECT round(avg(avg_savings_pct), 2) FROM i) AS avg_savings_pct, by_country, by_os, by_version, "
    "(SELECT string_agg(command || '=' || k || '/' || saved, ',' ORDER BY saved DESC, command) FROM c30) AS top_commands, (SELECT string_agg(date || '=' || k || '/' || commands || '/' || printf('%.2f', pct), ',' ORDER BY date) FROM d30) AS daily FROM mcountry, mos, mversion"
)
def fleet_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's answer, made once, kept, and given again within its time limit."""
    d, now = _pings(spark, sf_dir)
    folder = shared_folder(spark)
    make = lambda: fleet.statistics(fleet.instances(d), fleet.command_stats(d), fleet.instance_daily(d), now)
    for second in (0, 59):
        x = snapshot.cached(spark, folder, second, make if second == 0 else lambda: None)
    maps = [F.array_join(F.transform(F.array_sort(F.map_entries(f"by_{c}")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(f"by_{c}") for c in ("country", "os", "version")]
    top = F.array_join(F.transform("top_commands", lambda r: F.concat(r["command"], F.lit("="), r["count"].cast("string"), F.lit("/"), r["saved_tokens"].cast("string"))), ",")
    daily = F.array_join(F.transform("daily", lambda r: F.concat(r["date"], F.lit("="), r["active_instances"].cast("string"), F.lit("/"), r["commands"].cast("string"), F.lit("/"), F.format_string("%.2f", r["avg_savings_pct"]))), ",")
    return x.select("active_instances", "total_instances", "total_saved_tokens", "avg_savings_pct", *maps, top.alias("top_commands"), daily.alias("daily"))


@query(
    "WITH e AS (SELECT user_id % 5 AS team, user_id AS member, floor(value)::BIGINT AS i, floor(value / 3)::BIGINT AS o FROM events WHERE event_id % 11 > 1) "
    "SELECT team, sum(2 * i)::BIGINT AS total_input_tokens, sum(o)::BIGINT AS total_output_tokens, 2 * count(*) AS total_commands, count(DISTINCT member) AS members, "
    "CASE WHEN sum(2 * i) > 0 THEN (greatest(sum(2 * i) - sum(o), 0) * 100 // sum(2 * i))::BIGINT ELSE 0 END AS savings_pct FROM e GROUP BY team"
)
def fleet_team_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch reports of two events each, of which some are malformed or lack a field."""
    event = lambda o: F.struct(F.col("event_type").alias("command"), F.floor("value").alias("input_tokens"), o.alias("output_tokens"), F.lit(50).alias("savings_pct"), F.unix_timestamp("ts").alias("timestamp_secs"))
    good = F.to_json(F.array(event(F.floor(F.col("value") / 3)), event(F.lit(0).cast("long"))))
    bad = F.when(F.col("event_id") % 11 == 0, F.lit("{broken")).otherwise(F.to_json(F.array(F.struct(F.lit("git").alias("command"), F.lit(1).alias("input_tokens")))))
    reports = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("team"), F.col("user_id").alias("member"), F.when(F.col("event_id") % 11 > 1, good).otherwise(bad).alias("body"))
    return fleet.team_stats(fleet.report_events(reports))


@query(
    "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 400 WHEN event_id % 10 = 0 THEN 400 ELSE 200 END AS status, CASE WHEN event_id % 9 = 0 AND event_id % 10 = 0 THEN 'installation_id,avg_savings_pct' WHEN event_id % 9 = 0 THEN 'installation_id' WHEN event_id % 10 = 0 THEN 'avg_savings_pct' END AS reason FROM events"
)
def fleet_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    payload = F.struct(
        F.when(F.col("event_id") % 9 == 0, F.lit("short")).otherwise(F.sha2(F.col("user_id").cast("string"), 256)).alias("installation_id"), F.col("event_type").alias("os"), F.lit("1.0.0").alias("version"),
        F.col("event_id").alias("total_commands"), F.floor("value").alias("total_saved_tokens"), F.when(F.col("event_id") % 10 == 0, 101.0).otherwise(50.0).alias("avg_savings_pct"),
        F.array(F.struct(F.lit("git").alias("command"), F.lit(1).alias("count"), F.lit(2).alias("saved_tokens"))).alias("top_commands"),
    )
    return fleet.parse(e.select("event_id", F.to_json(payload).alias("body"))).select("event_id", "status", "reason")


# Transcripts: turns of conversations become tool calls whose command depends on the turn.

_CALLS = "CASE (conv_id * 7 + turn) % 8 WHEN 0 THEN 'git status | head' WHEN 1 THEN 'cargo test' WHEN 2 THEN 'ls -la' WHEN 3 THEN 'jq .' WHEN 4 THEN 'psql -c x' WHEN 5 THEN 'docker ps' WHEN 6 THEN 'brevia git log' ELSE 'npm run ' || role END"


def _transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("cmd", F.expr(_CALLS))
    name = F.when(F.col("turn") % 5 == 4, F.lit("Edit")).otherwise(F.lit("Bash"))
    call = F.to_json(F.struct(F.lit("tool_use").alias("type"), name.alias("name"), F.struct(F.col("cmd").alias("command")).alias("input")))
    return c.select("conv_id", "turn", F.when(F.col("turn") % 7 == 6, F.lit("{broken")).otherwise(call).alias("line"))


@query(f"SELECT conv_id, turn, {_CALLS} AS command FROM conversations WHERE turn % 5 <> 4 AND turn % 7 <> 6")
def scan_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.shell_commands(_transcript(spark, sf_dir)).select("conv_id", "turn", "command")


@query(
    f"WITH c AS (SELECT trim(string_split({_CALLS}, '|')[1]) AS command FROM conversations WHERE turn % 5 <> 4 AND turn % 7 <> 6) SELECT command, CASE WHEN starts_with(command, 'git') THEN 'git' WHEN starts_with(command, 'cargo') THEN 'rust' "
    "WHEN starts_with(command, 'npm') THEN 'js' WHEN starts_with(command, 'docker') THEN 'cloud' ELSE 'system' END AS category, count(*) AS count FROM c WHERE NOT starts_with(command, 'brevia ') AND NOT starts_with(command, 'jq') AND NOT starts_with(command, 'psql') GROUP BY 1, 2"
)
def scan_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.opportunities(transcripts.shell_commands(_transcript(spark, sf_dir)))


@query(
    "SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN 'cd /tmp && brevia git status' WHEN 1 THEN 'brevia read a.txt; brevia ls' WHEN 2 THEN 'cat x | wc' WHEN 3 THEN 'A=1 || brevia grep ''a && b'' f' ELSE 'echo $(date)' END AS rewritten FROM conversations"
)
def rewrite_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = "case (conv_id + turn) % 5 when 0 then 'cd /tmp && git status' when 1 then 'cat a.txt; ls' when 2 then 'cat x | wc' when 3 then 'A=1 || rg \\'a && b\\' f' else 'echo $(date)' end"
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(raw).alias("command"))
    return scan.rewrite(c).select("conv_id", "turn", "rewritten")


@query(
    "SELECT p_partkey, split_part(p_name, ' ', 1) || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' ' || split_part(p_name, ' ', 2) END AS safe, split_part(p_name, ' ', 1) || ' ' || p_brand AS key, left(sha256(p_name), 10) AS run, left(sha256(p_name), 32) AS hash, "
    "CASE WHEN p_partkey < 60 THEN p_partkey::VARCHAR || 's' WHEN p_partkey < 3600 THEN (p_partkey // 60)::VARCHAR || 'm' ELSE (p_partkey // 3600)::VARCHAR || 'h' END AS age, p_size % 10 > 5 AS newer FROM part"
)
def command_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part")
    w = F.split("p_name", " ")
    command = F.concat(w[0], F.when(F.col("p_size") % 2 == 0, F.lit(" -x ")).otherwise(F.lit(" ")), w[1])
    version = F.concat(F.lit("1.2."), (F.col("p_size") % 10).cast("string"))
    return d.select(
        "p_partkey", T.sanitize_command(command).alias("safe"), T.cmd_key(w[0], F.array("p_brand")).alias("key"), T.run_id(F.col("p_name")).alias("run"),
        T.content_hash(F.col("p_name")).alias("hash"), T.format_age(F.col("p_partkey")).alias("age"), T.is_newer(version, F.lit("v1.2.5")).alias("newer"),
    )
