"""Queries over rules, command lines, hook payloads and the SQL functions, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brevia import sql
from brevia.compressor_queries import runs_of
from brevia.functions import text as T
from brevia.operators import rule_reports, scan, tools
from brevia.plans import rules as R
from brevia.plans.library import library
from brevia.queries import texts
from brevia.sources import transcripts
from brevia.sources.tables import read as table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _number(value: int | None) -> str:
    return "NULL::INTEGER" if value is None else str(value)


_LINES = "CASE WHEN {0} = '' THEN [] ELSE string_split(regexp_replace({0}, '\\r?\\n$', ''), chr(10)) END"
_TOKENS = "len(regexp_extract_all({0}, '\\S+'))::BIGINT"
#: Lines of a tool's output: noise of most kinds, findings, and equal neighbours.
_LINE = (
    "CASE o_orderkey % 17 WHEN 0 THEN concat('Downloading p', o_orderkey) WHEN 1 THEN '  ✓ renders' WHEN 2 THEN '' WHEN 3 THEN concat('error: bad ', o_custkey) WHEN 4 THEN 'Done in 3 s' WHEN 5 THEN '[INFO] Scanning' "
    "WHEN 6 THEN concat('src/f', o_custkey, '.c:', o_orderkey, ': warning: unused') WHEN 7 THEN ' 45% [====>     ]' WHEN 8 THEN '--------' WHEN 9 THEN concat('ok: [host', o_custkey, ']') WHEN 10 THEN '64 bytes from 10.0.0.1' "
    "WHEN 11 THEN concat('PASS t', o_orderkey) WHEN 12 THEN 'npm notice new version' WHEN 16 THEN concat('long ', repeat('ab ', o_custkey % 90)) ELSE 'same line' END"
)
_RULES = ", ".join(f"({_text(r.name)}, {_text('|'.join(f'(?:{p})' for p in r.strip_patterns) or '^[^\\s\\S]')}, {_number(r.head_lines)}, {_number(r.tail_lines)}, {_number(r.max_line_chars)}, {_text(r.empty_message)}, {i})" for i, r in enumerate(library()))
_PREFIXES = ", ".join(f"({_text(r.name)}, {_text(p)}, {i})" for i, r in enumerate(library()) for p in r.commands)


@query(
    f"WITH rules(name, strip, head, tail, width, message, ord) AS (VALUES {_RULES}), prefixes(name, prefix, ord) AS (VALUES {_PREFIXES}), "
    f"c AS (SELECT DISTINCT o_orderkey // 64 AS run_id, [{', '.join(_text(r.commands[-1]) for r in library())}][(o_orderkey // 64) % {len(library())} + 1] || ' -x' AS command FROM orders), "
    "m AS (SELECT run_id, name, row_number() OVER (PARTITION BY run_id ORDER BY length(prefix) DESC, ord) AS k FROM c JOIN prefixes ON starts_with(command, prefix) AND string_split(command, ' ')[1] = string_split(prefix, ' ')[1]), "
    f"t AS (SELECT run_id, string_agg(l, chr(10) ORDER BY o) AS raw FROM (SELECT o_orderkey // 64 AS run_id, o_orderkey AS o, {_LINE} AS l FROM orders) GROUP BY run_id), "
    f"s AS (SELECT run_id, raw, rules.*, list_filter({_LINES.format('raw')}, lambda x: NOT regexp_matches(x, strip)) AS a FROM t JOIN m USING (run_id) JOIN rules USING (name) WHERE k = 1), "
    "r AS (SELECT *, list_filter(range(1, len(a) + 1), lambda i: i = 1 OR a[i] <> a[i - 1]) AS st FROM s), "
    "u AS (SELECT *, flatten(list_transform(range(1, len(st) + 1), lambda k: CASE WHEN coalesce(st[k + 1], len(a) + 1) - st[k] >= 3 THEN [a[st[k]] || ' (×' || (coalesce(st[k + 1], len(a) + 1) - st[k])::VARCHAR || ')'] "
    "ELSE list_transform(range(0, coalesce(st[k + 1], len(a) + 1) - st[k]), lambda j: a[st[k]]) END)) AS b FROM r), "
    "w AS (SELECT *, CASE WHEN head IS NOT NULL AND tail IS NOT NULL THEN CASE WHEN len(b) > head + tail THEN list_concat(b[1:head], b[len(b) - tail + 1:len(b)]) ELSE b END WHEN head IS NOT NULL THEN b[1:head] WHEN tail IS NOT NULL THEN b[greatest(len(b) - tail + 1, 1):len(b)] ELSE b END AS d FROM u), "
    "x AS (SELECT *, array_to_string(list_transform(d, lambda l: CASE WHEN width IS NULL THEN l ELSE l[1:width] END), chr(10)) AS out FROM w) "
    "SELECT run_id, name AS rule, CASE WHEN NOT regexp_matches(raw, '\\S') OR NOT regexp_matches(coalesce(out, ''), '\\S') THEN coalesce(message, '') ELSE out END AS compressed FROM x"
)
def rule_library_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of the library, found by one of its beginnings, over runs of up to 64 lines."""
    commands = F.array(*[F.lit(r.commands[-1]) for r in library()])
    runs = runs_of(table(spark, sf_dir, "orders"), "o_orderkey div 64", "o_orderkey", _LINE)
    runs = runs.withColumn("command", F.concat(F.get(commands, (F.col("run_id") % len(library())).cast("int")), F.lit(" -x")))
    d = R.apply_rules(R.match_rules(runs, R.rule_table(spark, library())), library())
    return d.select("run_id", "rule", "compressed")


@query(
    f"WITH s0 AS (SELECT text AS x FROM documents), s1 AS (SELECT regexp_replace(x, '\\x1b\\[[0-9;]*[a-zA-Z]', '', 'g') AS x FROM s0), l AS (SELECT {_LINES.format('x')} AS a FROM s1), "
    "s2 AS (SELECT array_to_string(CASE WHEN len(a) > 70 THEN list_concat(a[1:50], ['... (' || (len(a) - 70) || ' lines omitted) ...'], a[len(a) - 19:len(a)]) ELSE a END, chr(10)) AS x FROM l), "
    "s3 AS (SELECT CASE WHEN length(x) > 50000 THEN x[1:49984] || '... (truncated)' ELSE x END AS x FROM s2), "
    + "n AS ("
    + " UNION ALL ".join(f"SELECT {i} AS position, '{n}' AS stage, sum(length(x))::BIGINT AS chars, sum(len({_LINES.format('x')}))::BIGINT AS n_lines, sum({_TOKENS.format('x')})::BIGINT AS tokens FROM s{i}" for i, n in enumerate(("input", "strip_ansi", "head_tail", "hard_cap")))
    + ") SELECT *, coalesce(lag(tokens) OVER (ORDER BY position), tokens) - tokens AS lost_tokens, round(100.0 * (1 - tokens::DOUBLE / first_value(tokens) OVER (ORDER BY position)), 6) AS savings_pct FROM n"
)
def profile_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rule_reports.profile(texts(spark, sf_dir), "text")
    return d.withColumn("savings_pct", F.round("savings_pct", 6))


@query(
    "SELECT CASE p_partkey % 3 WHEN 0 THEN 'jest' WHEN 1 THEN 'zip' ELSE 'none such' END AS rule, 0 AS number, (CASE p_partkey % 3 WHEN 0 THEN 72 WHEN 1 THEN 67 ELSE 0 END)::BIGINT AS saved, p_partkey % 3 = 0 AND p_size % 2 = 1 AS passed, count(*) AS cases FROM part GROUP BY ALL"
)
def rule_cases_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with a case for each part, of two rules that there are and one that there isn't; half of the cases expect what isn't there."""
    name, noise = "case p_partkey % 3 when 0 then 'jest' when 1 then 'zip' else 'none such' end", "case p_partkey % 3 when 1 then '  adding: a (deflated 3%)' else 'PASS a\nTime: 1 s' end"
    toml = f"concat('[filter]\nname = \"', {name}, '\"\ncommands = []\n[[assertions]]\ninput = \"\"\"\n', {noise}, '\nFAIL t', p_partkey, '\n\"\"\"\nexpected_contains = \"FAIL ', if(p_size % 2 = 0, 'x', 't'), p_partkey, '\"\nmin_savings_pct = 70\n')"
    cases = rule_reports.rule_cases(table(spark, sf_dir, "part").select(F.expr(toml).alias("value")))
    return rule_reports.check_cases(cases, library()).groupBy("rule", "number", "saved", "passed").agg(F.count("*").alias("cases"))


_ARGS = {
    "[concat('t', p_partkey), '-x', p_brand]": "concat('brevia t', p_partkey, ' -x ', p_brand)",
    "['cat', concat('f', p_partkey)]": "concat('brevia read f', p_partkey)",
    "['tree']": "'brevia ls --tree'",
    "['cd', p_brand]": "concat('cd ', p_brand)",
    "['ls', '&&', p_brand]": "concat('ls && ', p_brand)",
    "['vim', p_brand]": "concat('vim ', p_brand)",
    "[concat('A', p_partkey, '=1'), 'x']": "concat('A', p_partkey, '=1 x')",
    "['brevia', 'ls']": "'brevia ls'",
}


@query("SELECT p_partkey, CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN {want}" for i, want in enumerate(_ARGS.values())) + " END AS rewritten, p_partkey % 8 IN (0, 1, 2) AS changed FROM part")
def argv_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = "case p_partkey % 8 " + " ".join(f"when {i} then array({a[1:-1]})" for i, a in enumerate(_ARGS)) + " end"
    d = T.once(table(spark, sf_dir, "part").select("p_partkey", F.expr(args).alias("args")), rewritten=scan.rewrite_argv(F.expr("args")))
    return d.select("p_partkey", "rewritten", (F.col("rewritten") != F.array_join("args", " ")).alias("changed"))


_NAMED = "BREVIA_TOOL=a_b BREVIA_SESSION=s' || turn || ' brevia"


@query(
    f"SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN '{_NAMED} echo \"$(date); x\" && {_NAMED} ls' WHEN 1 THEN 'cd /tmp; {_NAMED} grep ''a;b'' x' WHEN 2 THEN 'cat <<E' ELSE '{_NAMED} git log' END AS rewritten, "
    "CASE (conv_id + turn) % 4 WHEN 0 THEN 4 WHEN 1 THEN 5 ELSE 2 END AS n_words FROM conversations"
)
def rewrite_with_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = "case (conv_id + turn) % 4 when 0 then 'echo \"$(date); x\" && ls' when 1 then 'cd /tmp; rg \\'a;b\\' x' when 2 then 'cat <<E' else 'git log' end"
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(raw).alias("command"), F.lit("a_b").alias("tool"), F.expr("concat('s', turn)").alias("session"))
    return scan.rewrite(d, tool="tool", session="session").select("conv_id", "turn", "rewritten", F.size(scan.shell_words(F.col("command"))).alias("n_words"))


@query(
    "SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN 'nested' WHEN 1 THEN 'args' ELSE 'plain' END AS adapter, CASE (conv_id + turn) % 5 WHEN 0 THEN 'git log ' || turn WHEN 1 THEN 'ls -l ' || conv_id ELSE 'cat f' || turn END AS command, CASE WHEN (conv_id + turn) % 5 = 0 THEN 's' || conv_id END AS session_id "
    "FROM conversations WHERE (conv_id + turn) % 5 < 3"
)
def hook_payload_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = (
        "case (conv_id + turn) % 5 when 0 then to_json(named_struct('tool_name', 'Bash', 'tool_input', named_struct('command', concat('git log ', turn)), 'session_id', concat('s', conv_id))) "
        "when 1 then to_json(named_struct('tool', 'shell', 'args', array('ls', '-l', cast(conv_id as string)))) when 2 then to_json(named_struct('command', concat('cat f', turn))) "
        "when 3 then to_json(named_struct('tool_name', 'Read', 'tool_input', named_struct('command', 'x'))) else '{broken' end"
    )
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(body).alias("body"))
    return transcripts.decode_hooks(d).select("conv_id", "turn", "adapter", "command", "session_id")


@query(
    f"WITH d AS (SELECT doc_id, text, {_LINES.format('text')} AS a FROM documents) SELECT doc_id, {_TOKENS.format('text')} AS tokens, len(a)::INTEGER AS n_lines, md5(array_to_string(CASE WHEN len(a) > 5 THEN list_concat(a[1:3], ['... (' || (len(a) - 5) || ' lines omitted) ...'], a[len(a) - 1:len(a)]) ELSE a END, chr(10))) AS ends, "
    "left(sha256(text), 32) AS hash, greatest(len(a) - 7, 0)::BIGINT AS saved, len(list_filter(a, lambda x: NOT regexp_matches(x, '^\\s*$')))::BIGINT AS kept FROM d"
)
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    d = texts(spark, sf_dir)
    return spark.sql(
        "SELECT d.doc_id, brevia_count_tokens(text) AS tokens, brevia_n_lines(text) AS n_lines, md5(brevia_head_tail(text, 3, 2)) AS ends, brevia_content_hash(text) AS hash, brevia_saved(brevia_n_lines(text), 7) AS saved, "
        r"(SELECT count(*) FROM brevia_kept_lines(text, r'^\s*$')) AS kept FROM {d} d",
        d=d,
    )


@query(
    "WITH r AS (SELECT p_partkey, p_partkey % 3 = 0 OR p_size % 5 = 0 AS asked, 'at /home/ann/' || p_brand AS raw FROM part) "
    "SELECT p_partkey, CASE WHEN asked AND p_partkey % 2 = 0 THEN 'zip: 2' WHEN asked THEN replace(raw, 'ann', 'user') ELSE raw END AS compressed, CASE WHEN NOT asked THEN 'raw' WHEN p_partkey % 2 = 0 THEN 'rule' ELSE 'none' END AS how FROM r"
)
def compress_if_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output for a reader is compressed and cleaned, output for a pipe isn't; flags say otherwise for some."""
    d = table(spark, sf_dir, "part").select("p_partkey", F.expr("if(p_partkey % 2 = 0, 'pack x', 'other')").alias("command"), F.expr("concat('at /home/ann/', p_brand)").alias("raw"), (F.col("p_partkey") % 3 == 0).alias("terminal"), F.expr("if(p_size % 5 = 0, 'yes', 'No')").alias("force"))
    should = tools.should_compress(F.col("terminal"), F.col("force"), F.lit(None).cast("string"))
    rules = [R.Rule("pack", ("pack",), strip_patterns=("^at ",), empty_message="zip: 2")]
    return tools.maybe_compress(d, should, rules).select("p_partkey", "compressed", "how")
