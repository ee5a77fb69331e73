"""Compressor queries: rows of the tables are rendered as a tool's output, parsed and reduced; SQL starts from the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brevia.operators import compressors as C
from brevia.operators import tools
from brevia.plans.rules import Rule
from brevia.sources.tables import read as table

#: Lines of the mixed runs that one task makes and compresses, about.
LINES_A_TASK = 200_000
#: Rows that one task puts together as runs, about.
ROWS_A_TASK = 300_000

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def dealt(rows: DataFrame, run: str) -> DataFrame:
    """The rows with their ``run_id``, dealt out by it in as many tasks as there are rows for.

    Grouping sorts the rows of a task once it holds many runs, so a task's rows mustn't become more as a table grows.
    """
    return rows.withColumn("run_id", F.expr(run)).repartition(max(rows.sparkSession.sparkContext.defaultParallelism, 1 + rows.count() // ROWS_A_TASK), "run_id")


def together(rows: DataFrame, order: str, line: str, header: str = "", footer: str = "") -> DataFrame:
    """(run_id, raw): the lines of dealt rows put together in order, by SQL expressions."""
    d = rows.select("run_id", F.expr(order).alias("o"), F.expr(line).alias("l"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "l"))), lambda x: x["l"]), "\n")
    return d.groupBy("run_id").agg(F.concat(F.lit(header), text, F.lit(footer)).alias("raw"))


def runs_of(rows: DataFrame, run: str, order: str, line: str, header: str = "", footer: str = "") -> DataFrame:
    """(run_id, raw): the rows' lines put together in order, by SQL expressions.

    Runs are ranges of a unique key, so that they stay as short and become more as a table grows.
    """
    return together(dealt(rows, run), order, line, header, footer)


@query(
    "SELECT run_id, rank, bytes, path, more FROM (SELECT p_partkey // 500 AS run_id, (p_size * 1024)::DOUBLE AS bytes, './' || p_brand || '/' || p_partkey AS path, row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_size DESC, p_partkey) AS rank, "
    "greatest(count(*) OVER (PARTITION BY p_partkey // 500) - 15, 0) AS more FROM part) WHERE rank <= 15"
)
def du_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.du_top(runs_of(table(spark, sf_dir, "part"), "p_partkey div 500", "p_partkey", "concat(p_size, '.0K\t./', p_brand, '/', p_partkey)"))


@query("SELECT p_partkey // 500 AS run_id, lower(p_type) AS ext, count(*) AS files, sum(p_size)::BIGINT AS lines FROM part GROUP BY 1, 2")
def wc_by_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.wc_by_extension(runs_of(table(spark, sf_dir, "part"), "p_partkey div 500", "p_partkey", "concat('  ', p_size, ' src/f', p_partkey, '.', lower(p_type))", footer="\n  999 total"))


@query(
    "WITH f AS (SELECT p_partkey // 500 AS run_id, lower(p_type) AS ext, 'src/f' || p_partkey || '.' || lower(p_type) AS path, row_number() OVER (PARTITION BY p_partkey // 500, p_type ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY p_partkey // 500, p_type) AS files FROM part) "
    "SELECT run_id, ext, path, files, files - CASE WHEN files <= 5 THEN files ELSE 3 END AS more FROM f WHERE k <= CASE WHEN files <= 5 THEN files ELSE 3 END"
)
def find_by_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.find_by_extension(runs_of(table(spark, sf_dir, "part"), "p_partkey div 500", "p_partkey", "concat('src/f', p_partkey, '.', lower(p_type))"))


@query(
    "WITH m AS (SELECT o_orderkey // 4000 AS run_id, 'src/' || (o_custkey % 7) || '.py' AS file, o_orderkey AS lineno, o_orderpriority || ' order' AS content, row_number() OVER (PARTITION BY o_orderkey // 4000, o_custkey % 7 ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderkey // 4000, o_custkey % 7) AS matches FROM orders), "
    "s AS (SELECT run_id, file, count(*) AS shown FROM m WHERE k <= 25 GROUP BY 1, 2), b AS (SELECT run_id, file, coalesce(sum(shown) OVER (PARTITION BY run_id ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) "
    "SELECT m.run_id, m.file, matches, lineno, content FROM m JOIN b USING (run_id, file) WHERE k <= 25 AND before < 100"
)
def grep_group_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.grep_grouped(runs_of(table(spark, sf_dir, "orders"), "o_orderkey div 4000", "o_orderkey", "concat('src/', o_custkey % 7, '.py:', o_orderkey, ':', o_orderpriority, ' order')"))


@query(
    "SELECT c_custkey // 500 AS run_id, CASE c_custkey % 3 WHEN 0 THEN c_name || '/' WHEN 1 THEN c_name || ' ->' ELSE c_name || ' (' || CASE "
    "WHEN c_custkey >= 1073741824 THEN printf('%.1fG', c_custkey / 1073741824.0::DOUBLE) WHEN c_custkey >= 1048576 THEN printf('%.1fM', c_custkey / 1048576.0::DOUBLE) "
    "WHEN c_custkey >= 1024 THEN printf('%.1fK', c_custkey / 1024.0::DOUBLE) ELSE c_custkey || 'B' END || ')' END AS shown, c_custkey % 3 = 0 AS is_dir FROM customer"
)
def ls_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "concat(case c_custkey % 3 when 0 then 'drwxr-xr-x' when 1 then 'lrwxrwxrwx' else '-rw-r--r--' end, '  1 user group ', c_custkey, ' Jan  1 10:00 ', c_name, case when c_custkey % 3 = 1 then ' -> /target' else '' end)"
    d = runs_of(table(spark, sf_dir, "customer"), "c_custkey div 500", "c_custkey", line, header="total 8\ndrwxr-xr-x  2 user group 4096 Jan  1 10:00 .\n")
    return C.ls_entries(d).select("run_id", "shown", "is_dir")


@query("SELECT c_custkey // 500 AS run_id, CASE WHEN c_custkey % 4 = 0 THEN '(dir)' ELSE lower(c_mktsegment) END AS ext, count(*) AS files, sum(c_custkey)::BIGINT AS bytes FROM customer GROUP BY 1, 2")
def tar_by_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "concat(case when c_custkey % 4 = 0 then 'drwxr-xr-x' else '-rw-r--r--' end, ' user/group ', c_custkey, ' 2024-01-01 10:00 a/', c_custkey, '.', lower(c_mktsegment))"
    return C.tar_by_extension(runs_of(table(spark, sf_dir, "customer"), "c_custkey div 500", "c_custkey", line))


@query("SELECT s_suppkey // 100 AS run_id, 'disk' || s_suppkey || ' 10G 5G 5G 50% /mnt/' || s_suppkey AS line FROM supplier WHERE s_suppkey % 3 > 0 UNION ALL SELECT DISTINCT s_suppkey // 100, 'Filesystem Size Used Avail Use% Mounted on' FROM supplier")
def df_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "concat(case when s_suppkey % 3 = 0 then 'tmpfs' else concat('disk', s_suppkey) end, ' 10G 5G 5G 50% /mnt/', s_suppkey)"
    return C.df_mounts(runs_of(table(spark, sf_dir, "supplier"), "s_suppkey div 100", "s_suppkey", line, header="Filesystem Size Used Avail Use% Mounted on\n")).select("run_id", "line")


@query(
    "WITH c AS (SELECT o_orderkey // 4000 AS run_id, 'cmd' || (o_custkey % 40) AS cmd, count(*) AS files FROM orders GROUP BY 1, 2) SELECT run_id, cmd, files FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY files DESC, cmd) AS k, sum(files) OVER (PARTITION BY run_id) AS n FROM c) WHERE k <= 20 AND n > 100"
)
def lsof_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "concat('cmd', o_custkey % 40, ' ', o_custkey, ' user 5u REG 1,4 100 ', o_orderkey, ' /tmp/f')"
    return C.lsof_top(runs_of(table(spark, sf_dir, "orders"), "o_orderkey div 4000", "o_orderkey", line, header="COMMAND PID USER FD TYPE DEVICE SIZE NODE NAME\n"))


@query(
    "WITH s AS (SELECT c_custkey // 500 AS run_id, c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'LISTEN' WHEN 1 THEN 'ESTABLISHED' WHEN 2 THEN 'TIME_WAIT' ELSE 'CLOSE_WAIT' END AS state FROM customer), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY run_id, state ORDER BY c_custkey) AS k, count(*) OVER (PARTITION BY run_id, state) AS sockets FROM s) "
    "SELECT run_id, state, sockets, CASE WHEN state = 'LISTEN' THEN '0.0.0.0:' ELSE '10.0.0.1:' END || c_custkey AS peer, CASE WHEN state = 'LISTEN' THEN 0 ELSE greatest(sockets - 10, 0) END AS more FROM k WHERE state = 'LISTEN' OR k <= 10"
)
def netstat_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "concat('tcp        0      0 0.0.0.0:', c_custkey, '  10.0.0.1:', c_custkey, '   ', case c_nationkey % 4 when 0 then 'LISTEN' when 1 then 'ESTABLISHED' when 2 then 'TIME_WAIT' else 'CLOSE_WAIT' end)"
    return C.netstat_states(runs_of(table(spark, sf_dir, "customer"), "c_custkey div 500", "c_custkey", line, header="Proto Recv-Q Send-Q Local Address Foreign Address State\n"))


@query(
    "SELECT c_custkey // 500 AS run_id, CASE WHEN c_custkey % 5 = 0 THEN 'API_KEY_' ELSE 'VAR_' END || c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN '[REDACTED]' ELSE c_name END AS value FROM customer"
)
def env_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "concat(case when c_custkey % 5 = 0 then 'API_KEY_' else 'VAR_' end, c_custkey, '=', c_name)"
    return C.env_pairs(runs_of(table(spark, sf_dir, "customer"), "c_custkey div 500", "c_custkey", line, footer="\nSHLVL=1\n_=/usr/bin/env"))


@query(
    "SELECT s_suppkey // 100 AS run_id, left(md5(s_name), 12) AS id, 'team/app' || s_suppkey AS image, CASE WHEN s_suppkey % 4 = 0 THEN 'exited(1)' ELSE 'up' END AS status, s_name AS name FROM supplier"
)
def docker_ps_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "concat(md5(s_name), '   registry.local:5000/team/app', s_suppkey, ':v1   \"run it\"   2 hours ago   ', case when s_suppkey % 4 = 0 then 'Exited (1) 3 hours ago' else 'Up 2 hours (healthy)' end, '   0.0.0.0:80->80/tcp   ', s_name)"
    return C.docker_ps(runs_of(table(spark, sf_dir, "supplier"), "s_suppkey div 100", "s_suppkey", line, header="CONTAINER ID   IMAGE   COMMAND   CREATED   STATUS   PORTS   NAMES\n")).drop("pos")


@query("SELECT s_suppkey // 50 AS run_id, 'pod-' || s_suppkey || ' 1/1 Running ' || CASE WHEN s_suppkey // 50 % 2 = 1 THEN '' ELSE (s_suppkey % 5)::VARCHAR || ' ' END || '3d' AS shown FROM supplier")
def kubectl_pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "concat('pod-', s_suppkey, '   1/1   Running   ', if((s_suppkey div 50) % 2 = 1, 0, s_suppkey % 5), '   3d')"
    return C.kubectl_pods(runs_of(table(spark, sf_dir, "supplier"), "s_suppkey div 50", "s_suppkey", line, header="NAME READY STATUS RESTARTS AGE\n")).drop("pos")


@query(
    "WITH l AS (SELECT o_orderkey // 4000 AS run_id, o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN 'ERROR at ' ELSE 'line ' END || o_orderkey AS line, row_number() OVER (PARTITION BY o_orderkey // 4000 ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_orderkey // 4000) AS n FROM orders), "
    "k AS (SELECT * FROM l WHERE pos < 20 OR pos >= n - 20 OR o_orderkey % 31 = 0) SELECT run_id, line, (pos - coalesce(lag(pos) OVER (PARTITION BY run_id ORDER BY pos), -1) - 1)::INT AS gap FROM k"
)
def docker_logs_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "concat(case when o_orderkey % 31 = 0 then 'ERROR at ' else 'line ' end, o_orderkey)"
    return C.head_important_tail(runs_of(table(spark, sf_dir, "orders"), "o_orderkey div 4000", "o_orderkey", line)).select("run_id", "line", "gap")


@query("SELECT o_orderkey // 4000 AS run_id, left(md5(o_orderkey::VARCHAR), 7) AS hash, 'Fix ' || o_orderpriority AS subject FROM orders")
def git_log_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "concat('commit ', md5(cast(o_orderkey as string)), '\nAuthor: A <a@b.c>\nDate:   ', o_orderdate, '\n\n    Fix ', o_orderpriority, '\n\n    Body text.\n')"
    return C.git_log(runs_of(table(spark, sf_dir, "orders"), "o_orderkey div 4000", "o_orderkey", line)).drop("pos")


@query("SELECT l_orderkey // 2000 AS run_id, 'src/' || l_suppkey || '.py' AS file, sum(l_linenumber)::BIGINT AS added, count(*) AS deleted, count(*) AS hunks FROM lineitem GROUP BY 1, 2")
def git_diff_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey div 2000").groupBy("run_id", "l_suppkey").agg(F.array_join(F.collect_list(F.expr("concat('@@ -1 +1 @@\n-old\n', repeat('+new\n', l_linenumber), ' same')")), "\n").alias("hunks"))
    line = "concat('diff --git a/src/', l_suppkey, '.py b/src/', l_suppkey, '.py\nindex 1..2 100644\n--- a/src/', l_suppkey, '.py\n+++ b/src/', l_suppkey, '.py\n', hunks)"
    return C.git_diff(together(d, "l_suppkey", line)).drop("pos")


@query(
    "WITH f AS (SELECT p_partkey // 500 AS run_id, CASE p_size % 3 WHEN 0 THEN 'staged' WHEN 1 THEN 'unstaged' ELSE 'untracked' END AS section, 'f' || p_partkey AS file, CASE WHEN p_size % 3 = 2 THEN '' ELSE 'modified' END AS action, "
    "row_number() OVER (PARTITION BY p_partkey // 500, p_size % 3 ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY p_partkey // 500, p_size % 3) AS n FROM part) "
    "SELECT run_id, section, file, action, CASE WHEN section = 'untracked' THEN greatest(n - 10, 0) ELSE 0 END AS more FROM f WHERE section <> 'untracked' OR k <= 10"
)
def git_status_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = "case s when 0 then 'Changes to be committed:' when 1 then 'Changes not staged for commit:' else 'Untracked files:' end"
    d = dealt(table(spark, sf_dir, "part"), "p_partkey div 500").selectExpr("run_id", "p_size % 3 as s", "p_partkey", "concat('\t', case when p_size % 3 = 2 then '' else 'modified:   ' end, 'f', p_partkey) as l")
    d = d.groupBy("run_id", "s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "l"))), lambda x: x["l"]), "\n").alias("files"))
    return C.git_status(together(d, "s", f"concat({titles}, '\n  (use it)\n', files, '\n')", header="On branch main\n\n"))


@query("SELECT p_partkey // 500 AS run_id, 'E' || p_size AS code, arg_min('src/' || p_partkey || '.py:' || p_size || ':1: E' || p_size || ' bad', p_partkey) AS first, count(*) - 1 AS more FROM part GROUP BY 1, 2")
def ruff_first_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ruff_by_code(runs_of(table(spark, sf_dir, "part"), "p_partkey div 500", "p_partkey", "concat('src/', p_partkey, '.py:', p_size, ':1: E', p_size, ' bad')", footer="\nFound many errors.")).drop("pos")


@query(
    "WITH t AS (SELECT p_partkey // 500 AS run_id, p_partkey, 'src/' || (p_partkey % 9) || '.ts' AS file, p_partkey AS lineno, 'TS' || p_size AS code, p_brand AS message FROM part), "
    "g AS (SELECT run_id, code, message, count(DISTINCT file) AS files, count(*) AS n, array_to_string(list_sort(list(DISTINCT file))[1:4], ',') AS sample FROM t GROUP BY 1, 2, 3), "
    "r AS (SELECT t.*, row_number() OVER (PARTITION BY t.run_id, t.file ORDER BY p_partkey) AS k FROM t JOIN g USING (run_id, code, message) WHERE files < 3) "
    "SELECT run_id, 'shared' AS kind, code, message, sample AS file, NULL::BIGINT AS lineno, n FROM g WHERE files >= 3 UNION ALL SELECT run_id, 'file', code, message, file, lineno, 1 FROM r WHERE k <= 3"
)
def tsc_cross_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tsc_findings(runs_of(table(spark, sf_dir, "part"), "p_partkey div 500", "p_partkey", "concat('src/', p_partkey % 9, '.ts(', p_partkey, ',5): error TS', p_size, ': ', p_brand)"))


@query("SELECT p_partkey // 500 AS run_id, '/src/' || (p_partkey % 7) || '.js' AS file, count_if(p_size % 2 = 0) AS errors, count_if(p_size % 2 = 1) AS warnings FROM part GROUP BY 1, 2 HAVING count_if(p_size % 2 = 0) > 0")
def eslint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dealt(table(spark, sf_dir, "part"), "p_partkey div 500").groupBy("run_id", F.expr("p_partkey % 7").alias("f")).agg(F.array_join(F.collect_list(F.expr("concat('  ', p_size, ':1  ', if(p_size % 2 = 0, 'error', 'warning'), '  message  rule')")), "\n").alias("x"))
    return C.eslint_files(together(d, "f", "concat('/src/', f, '.js\n', x, '\n')"))


@query("SELECT p_partkey // 500 AS run_id, 'f' || p_partkey || '.sh' AS file, p_size::BIGINT AS lineno, 'SC' || p_partkey AS code, p_name AS message FROM part")
def shellcheck_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "concat('In f', p_partkey, '.sh line ', p_size, ':\necho $x\n     ^-- SC', p_partkey, ' (info): ', p_name, '\n')"
    return C.shellcheck_flat(runs_of(table(spark, sf_dir, "part"), "p_partkey div 500", "p_partkey", line)).drop("pos")


@query("SELECT n_regionkey::BIGINT AS run_id, n_nationkey || ' ' || n_name AS line FROM nation UNION ALL SELECT r_regionkey::BIGINT, 'id name' FROM region UNION ALL SELECT r_regionkey::BIGINT, '(some rows)' FROM region")
def psql_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.psql_rows(runs_of(table(spark, sf_dir, "nation"), "cast(n_regionkey as bigint)", "n_nationkey", "concat('  ', n_nationkey, ' | ', n_name, '   ')", header=" id | name \n----+------\n", footer="\n(some rows)")).select("run_id", "line")


@query("SELECT s_suppkey AS run_id, 'i-' || s_suppkey AS id, 't3' AS type, 'running' AS state, '-' AS ip, s_name AS name FROM supplier")
def aws_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = "to_json(named_struct('Reservations', array(named_struct('Instances', array(named_struct('InstanceId', concat('i-', s_suppkey), 'InstanceType', 't3', 'State', named_struct('Name', 'running'), 'Tags', array(named_struct('Key', 'Other', 'Value', 'x'), named_struct('Key', 'Name', 'Value', s_name))))))))"
    return C.aws_instances(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run_id"), F.expr(raw).alias("raw")))


@query(
    " UNION ALL ".join(
        f"(SELECT p_partkey // 500 AS run_id, 'failure' AS kind, {bad} AS line FROM part WHERE p_size % 9 = 0 UNION ALL SELECT DISTINCT p_partkey // 500, 'summary', {end} FROM part)"
        for bad, end in (("'test t' || p_partkey || ' ... FAILED'", "'test result: FAILED. 9 passed'"), ("'FAILED tests/t.py::t' || p_partkey", "'=== 3 failed, 9 passed in 1s ==='"))
    )
)
def test_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for tool, bad, good, end in (("cargo", "'test t', p_partkey, ' ... FAILED'", "'test t', p_partkey, ' ... ok'", "test result: FAILED. 9 passed"), ("pytest", "'FAILED tests/t.py::t', p_partkey", "'tests/t.py::t', p_partkey, ' PASSED'", "=== 3 failed, 9 passed in 1s ===")):
        runs = runs_of(table(spark, sf_dir, "part"), "p_partkey div 500", "p_partkey", f"if(p_size % 9 = 0, concat({bad}), concat({good}))", footer="\n" + end)
        parts.append(C.failures_and_summary(runs, *C.TEST_RUNNERS[tool]).select("run_id", "kind", "line"))
    return parts[0].union(parts[1])


#: Rules that the mixed commands fall back to.
RULES = [Rule("lint", ("lint",), strip_patterns=("^ok ",), head_lines=2, tail_lines=1, dedupe=False, empty_message="lint: ok"), Rule("lint fix", ("lint fix",), strip_patterns=(".",), empty_message="lint: fixed")]
#: Expected text of lines joined in order; ``want`` is null for lines that are left out.
JOINED = "coalesce(string_agg(want, chr(10) ORDER BY k), '')"
#: For each tool the command, what a row of part prints, what is kept of it, the expected text, and lines before and after; expressions are of either SQL.
TOOLS = {
    "npm": ("npm install left-pad", "CASE p_size % 4 WHEN 0 THEN 'npm warn deprecated x' WHEN 1 THEN concat('added ', k, ' packages') WHEN 2 THEN 'reify: x' ELSE '' END", "CASE WHEN p_size % 4 = 1 THEN line END", JOINED, "", ""),
    "pip": ("pip install x", "CASE p_size % 3 WHEN 0 THEN 'Collecting x' WHEN 1 THEN '  Downloading y (1 MB)' ELSE concat('Successfully installed x', k) END", "CASE WHEN p_size % 3 = 2 THEN line END", JOINED, "", ""),
    "go": ("go build ./...", "CASE p_size % 3 WHEN 0 THEN '# pkg' WHEN 1 THEN concat('a/', k, '.go:1:2: bad', chr(10), chr(9), 'have x') ELSE 'other' END", "CASE WHEN p_size % 3 = 1 THEN line END", JOINED, "", ""),
    "golangci": ("golangci-lint run", "CASE WHEN p_size % 2 = 0 THEN concat('a/', k, '.go:1:2: bad') ELSE 'level=info' END", "CASE WHEN p_size % 2 = 0 THEN line END", JOINED, "", ""),
    "images": ("docker images", "CASE WHEN p_size % 5 = 0 THEN '<none>   <none>   abc   2 days ago   5MB' ELSE concat('reg.io:5000/team/a', k, '   v', p_size, '   abc123   2 days ago   ', p_size, 'MB') END", "CASE WHEN p_size % 5 > 0 THEN concat('team/a', k, ':v', p_size, ' ', p_size, 'MB') END", JOINED, "REPOSITORY   TAG   IMAGE ID   CREATED   SIZE\n", ""),
    "build": ("docker build .", "CASE p_size % 4 WHEN 0 THEN concat('Step 1/2 : RUN ', k) WHEN 1 THEN ' ---> Using cache' WHEN 2 THEN concat('error ', k) ELSE concat(' out ', k) END", "CASE p_size % 4 WHEN 0 THEN concat('  RUN ', k) WHEN 2 THEN line WHEN 3 THEN concat('    out ', k) END", JOINED, "", ""),
    "compose": ("docker compose up", "CASE p_size % 3 WHEN 0 THEN concat(' Container a-', k, ' Started') WHEN 1 THEN 'abc1: Pull complete' ELSE concat('web | ', k) END", "CASE p_size % 3 WHEN 0 THEN trim(line) WHEN 2 THEN concat('  ', line) END", JOINED, "", ""),
    "kubectl": ("kubectl get svc", "concat('svc-', k, '    ClusterIP   ', p_size, 'd')", "concat('svc-', k, ' ClusterIP ', p_size, 'd')", f"concat('NAME TYPE AGE', chr(10), {JOINED})", "NAME   TYPE   AGE\n", ""),
    "terraform": ("terraform apply", "concat('a.b', k, ': ', CASE p_size % 3 WHEN 0 THEN 'Creating...' WHEN 1 THEN 'Still creating... [10s elapsed]' ELSE 'Creation complete after 1s' END)", "CASE WHEN p_size % 3 <> 1 THEN line END", JOINED, "", ""),
    "clippy": ("cargo clippy", "CASE p_size % 3 WHEN 0 THEN concat('    Checking c', k, ' v1.0') WHEN 1 THEN concat('warning: unused ', k, chr(10), '  --> src/', k, '.rs:1:1', chr(10), '   |', chr(10)) ELSE 'note' END", "CASE WHEN p_size % 3 = 1 THEN concat('warning: unused ', k, chr(10), '  --> src/', k, '.rs:1:1') END", JOINED, "", ""),
    "cargo": ("cargo build", "CASE WHEN p_size % 3 = 0 THEN concat('   Compiling c', k, ' v1') ELSE 'warning: x' END", "CASE WHEN p_size % 3 = 0 THEN line END", "concat(coalesce(concat(arg_max(want, k), chr(10)), ''), '    Finished dev', chr(10), 'error: bad', chr(10), '  why')", "", "\n    Finished dev\nerror: bad\n  why\n\nnote"),
    "caveats": ("brew install x", "concat('hint ', k)", "line", f"concat('==> Caveats', chr(10), {JOINED}, chr(10), '🍺  /opt/x')", "==> Pouring x\n==> Caveats\n", "\n==> Summary\n🍺  /opt/w\n🍺  /opt/x"),
    "brew": ("brew list", "concat('pkg', k, '   1.0')", "concat('pkg', k)", "concat(count(*), ' installed: ', string_agg(want, ', ' ORDER BY k))", "", ""),
    "redis": ("redis-cli info", "CASE p_size % 3 WHEN 0 THEN concat('# Section', k) WHEN 1 THEN concat('db', k, ':keys=1') ELSE concat('noise:', k) END", "CASE WHEN p_size % 3 < 2 THEN line END", JOINED, "", ""),
    "push": ("git push origin", "'Everything up-to-date'", "line", "'ok push'", "", ""),
    "mkdir": ("mkdir a", "''", "line", "'ok'", "", ""),
    "curl": ("curl -v h", "CASE p_size % 5 WHEN 0 THEN '* TLS x' WHEN 1 THEN '> GET / HTTP/1.1' WHEN 2 THEN '< Server: x' WHEN 3 THEN '< HTTP/1.1 200' ELSE concat('{', k, '}') END", "CASE WHEN p_size % 5 IN (1, 3, 4) THEN line END", f"concat('* Connected to h', chr(10), {JOINED})", "* Connected to h\n", ""),
    "cat": ("cat src/x.py", "concat('line ', k)", "concat(lpad(CAST(rn AS VARCHAR), 4, ' '), '  ', line)", f"CASE WHEN count(*) <= 100 THEN concat('src/x.py  (', count(*), ' lines)', chr(10), {JOINED}) ELSE concat('src/x.py  (', count(*), ' lines, showing first 40 + last 20)', chr(10), string_agg(want, chr(10) ORDER BY k) FILTER (rn <= 40), chr(10), chr(10), '... (', count(*) - 60, ' lines omitted) ...', chr(10), chr(10), string_agg(want, chr(10) ORDER BY k) FILTER (rn > n - 20)) END", "", ""),
    "lint": ("lint all", "CASE WHEN p_size % 2 = 0 THEN 'ok x' ELSE concat('bad ', k) END", "CASE WHEN p_size % 2 = 1 THEN line END", f"CASE WHEN count(want) = 0 THEN 'lint: ok' WHEN count(want) <= 3 THEN {JOINED} ELSE concat(list(want ORDER BY k) FILTER (want IS NOT NULL)[1], chr(10), list(want ORDER BY k) FILTER (want IS NOT NULL)[2], chr(10), list(want ORDER BY k DESC) FILTER (want IS NOT NULL)[1]) END", "", ""),
    "fix": ("lint fix all", "concat('bad ', k)", "line", "'lint: fixed'", "", ""),
    "other": ("other tool", "concat('at /home/ann/', k)", "concat('at /home/user/', k)", JOINED, "", ""),
}
#: As ``TOOLS``: version control, listings, clusters, test runners, linters and builds.
MORE_TOOLS = {
    "git_log": ("git log", "concat('commit ', lpad(concat('', k), 7, '0'), 'abc', chr(10), 'Author: a', chr(10), 'Date: d', chr(10), chr(10), '    fix ', k, chr(10))", "concat('  ', lpad(concat('', k), 7, '0'), ' fix ', k)", f"concat(count(*), ' commits', chr(10), {JOINED})", "", ""),
    "git_diff": ("git diff", "concat('diff --git a/f', k, ' b/f', k, chr(10), '+++ b/f', k, chr(10), '@@ -1 +1 @@', chr(10), '-old', chr(10), '+new', chr(10), '+', p_size)", "concat('  f', k, ' (+2 -1, 1 hunks)')", f"concat(count(*), ' files changed, +', 2 * count(*), ' -', count(*), chr(10), {JOINED})", "", ""),
    "git_status": ("git status", "concat(chr(9), 'modified:   f', k)", "concat('  modified: f', k)", f"concat('branch: main', chr(10), chr(10), 'unstaged (', count(*), '):', chr(10), {JOINED})", "On branch main\nChanges not staged for commit:\n  (use \"git add\")\n", ""),
    "diff": ("diff a b", "concat('diff --git a/f', k, ' b/f', k, chr(10), '@@ -1,2 +1,2 @@', chr(10), '-a', chr(10), '+b', chr(10), '+c', chr(10), '+d')", "concat(chr(10), 'f', k, '  (+3 -1, 1 hunks)', chr(10), '  -a', chr(10), '  +b', chr(10), '  +c', chr(10), '  ... +1 more changes')", f"concat(count(*), ' files changed, +', 3 * count(*), ' -', count(*), chr(10), {JOINED})", "", ""),
    "gh": ("gh pr list", "concat('  #', k, '  Title ', p_size, '  br  OPEN  about')", "concat('#', k, ' Title ', p_size, ' [OPEN]')", JOINED, "Showing 9 of 9\n", ""),
    "ls": ("ls src", "concat('-rw-r--r--  1 a b ', p_size, ' Jan  1 10:00 f', k)", "concat('  f', k, ' (', p_size, 'B)')", f"concat('src  (1 dirs, ', count(*), ' files)', chr(10), '  d/', chr(10), {JOINED})", "total 8\ndrwxr-xr-x  2 a b 64 Jan  1 10:00 .\ndrwxr-xr-x  2 a b 64 Jan  1 10:00 d\n", ""),
    "grep": ("grep x", "concat('a.py:', k, ': x')", "concat('  ', k, ':x')", "CASE WHEN count(*) <= 100 THEN string_agg(line, chr(10) ORDER BY k) ELSE concat(count(*), ' matches across 1 files', chr(10), chr(10), 'a.py  (', count(*), ' matches)', chr(10), string_agg(want, chr(10) ORDER BY k) FILTER (rn <= 25), chr(10), '  ... +', count(*) - 25, ' more') END", "", ""),
    "find": ("find .", "concat('f', k, '.py')", "concat('  f', k, '.py')", "CASE WHEN count(*) <= 10 THEN string_agg(line, chr(10) ORDER BY k) ELSE concat(count(*), ' files found', chr(10), chr(10), '.py (', count(*), '):', chr(10), string_agg(want, chr(10) ORDER BY k) FILTER (rn <= 3), chr(10), '  ... +', count(*) - 3, ' more') END", "", ""),
    "du": ("du -h", "concat(p_size, 'K', chr(9), 'd', k)", "concat(lpad(concat(p_size, 'K'), 8, ' '), '  d', k)", "CASE WHEN count(*) <= 15 THEN string_agg(want, chr(10) ORDER BY p_size DESC, k) ELSE concat('top 15 of ', count(*), ' entries (sorted by size):', chr(10), '  ', array_to_string(list_slice(list(want ORDER BY p_size DESC, k), 1, 15), concat(chr(10), '  ')), chr(10), '  ... and ', count(*) - 15, ' more entries') END", "", ""),
    "df": ("df -h", "CASE WHEN p_size % 2 = 0 THEN concat('tmpfs 1G /run/', k) ELSE concat('/dev/sda 1G /mnt/', k) END", "CASE WHEN p_size % 2 = 1 THEN line END", "concat('Filesystem Size Mounted', chr(10), '/dev/root 9G /', coalesce(concat(chr(10), string_agg(want, chr(10) ORDER BY k)), ''), CASE WHEN count(want) < count(*) THEN concat(chr(10), '# (', count(*) - count(want), ' virtual/internal mounts omitted)') ELSE '' END)", "Filesystem Size Mounted\n/dev/root 9G /\n", ""),
    "wc": ("wc -l", "concat('  ', p_size, ' f', k, '.py')", "concat('  ', lpad(concat('', p_size), 8, ' '), '  f', k, '.py')", "CASE WHEN count(*) = 1 THEN concat('f', max(k), '.py: ', max(p_size), ' lines') WHEN count(*) <= 10 THEN concat('total: 77 lines', chr(10), string_agg(want, chr(10) ORDER BY k)) ELSE concat('total: 77 lines across ', count(*), ' files', chr(10), chr(10), 'by extension:', chr(10), '  .py           ', lpad(concat('', sum(p_size)), 8, ' '), ' lines  (', count(*), ' files)', chr(10), chr(10), 'top files:', chr(10), array_to_string(list_slice(list(want ORDER BY p_size DESC, k), 1, 5), chr(10))) END", "", "\n  77 total"),
    "smart": ("smart a.py", "CASE p_size % 4 WHEN 0 THEN '# c' WHEN 1 THEN concat('def f', k, '():') WHEN 2 THEN '    x' ELSE '' END", "CASE WHEN p_size % 4 = 1 THEN concat('  L', rn + 40, ': def f', k, '():') END", "concat(count(*) + 41, ' lines (', 41 + count(*) FILTER (p_size % 4 IN (1, 2)), ' code, ', count(*) FILTER (p_size % 4 = 3), ' blank, ', count(*) FILTER (p_size % 4 = 0), ' comments)', coalesce(concat(chr(10), chr(10), 'Definitions (', nullif(count(want), 0), '):'), ''), coalesce(concat(chr(10), string_agg(want, chr(10) ORDER BY k)), ''))", "x\n" * 40, "\nx"),
    "dig": ("dig h", "concat('h', k, '. 60 IN A 10.0.0.', p_size)", "line", JOINED, "; <<>> DiG\n;; ANSWER SECTION:\n", "\n\n;; Query time: 1 msec"),
    "lsof": ("lsof", "concat('py ', k, ' me 3u REG 1,2 100 55 /tmp/x')", "concat('py ', k, ' me 3u REG /tmp/x')", f"concat('COMMAND PID USER FD TYPE NAME', chr(10), CASE WHEN count(*) <= 100 THEN {JOINED} ELSE concat('(', count(*), ' rows across 1 processes; showing top by fd count)', chr(10), '  py               ', count(*), ' fds') END)", "COMMAND PID USER FD TYPE DEVICE SIZE/OFF NODE NAME\n", ""),
    "netstat": ("ss -tn", "concat('LISTEN 0 128 10.0.0.1:', k, ' *:*')", "concat('  tcp 10.0.0.1:', k)", f"concat('LISTEN (', count(*), '):', chr(10), {JOINED}, chr(10), chr(10), 'ESTAB (1):', chr(10), '  tcp -> b')", "", "\nESTAB 0 0 a b"),
    "env": ("env", "concat('V', lpad(concat('', k), 9, '0'), CASE p_size % 2 WHEN 0 THEN '_TOKEN=abc' ELSE concat('=', p_size) END)", "CASE p_size % 2 WHEN 0 THEN concat('V', lpad(concat('', k), 9, '0'), '_TOKEN=[REDACTED]') ELSE line END", f"concat({JOINED}, chr(10), '# (1 internal/tooling vars omitted)')", "VSCODE_PID=1\n", ""),
    "docker_ps": ("docker ps", "concat(lpad(concat('', k), 14, '0'), '   reg.io:5000/a/b:1   x   2 h   Up 2 hours   80/tcp   w', k)", "concat(substr(lpad(concat('', k), 14, '0'), 1, 12), ' a/b up w', k)", JOINED, "CONTAINER ID   IMAGE   COMMAND   CREATED   STATUS   PORTS   NAMES\n", ""),
    "docker_logs": ("docker logs w", "concat('line ', k)", "line", "CASE WHEN count(*) <= 40 THEN string_agg(line, chr(10) ORDER BY k) ELSE concat(string_agg(want, chr(10) ORDER BY k) FILTER (rn <= 20), chr(10), '... (', count(*) - 40, ' lines omitted)', chr(10), string_agg(want, chr(10) ORDER BY k) FILTER (rn > n - 20)) END", "", ""),
    "kubectl_logs": ("kubectl logs w", "concat(CASE WHEN p_size % 7 = 0 THEN 'error ' ELSE 'line ' END, k)", "CASE WHEN rn > 20 AND rn <= n - 20 AND p_size % 7 = 0 THEN line END", "CASE WHEN count(*) <= 40 THEN string_agg(line, chr(10) ORDER BY k) ELSE concat(string_agg(line, chr(10) ORDER BY k) FILTER (rn <= 20), chr(10), '[... ', count(*) - 40 - count(want), ' lines omitted', CASE WHEN count(want) > 0 THEN concat(', ', count(want), ' errors/warnings kept') ELSE '' END, ' ...]', coalesce(concat(chr(10), string_agg(want, chr(10) ORDER BY k)), ''), chr(10), string_agg(line, chr(10) ORDER BY k) FILTER (rn > n - 20)) END", "", ""),
    "pods": ("kubectl get pods", "concat('p', k, '   1/1   Running   ', p_size % 2, '   5d')", "concat('p', k, ' 1/1 Running ', p_size % 2, ' 5d')", f"concat('NAME READY STATUS RESTARTS AGE', chr(10), {JOINED}, chr(10), 'q 1/1 Running 3 5d')", "NAME   READY   STATUS   RESTARTS   AGE\n", "\nq   1/1   Running   3   5d"),
    "plan": ("terraform plan", "concat('  # a.b', k, ' will be created', chr(10), '  + resource \"a\" \"b', k, '\" {', chr(10), '      + id = (known after apply)', chr(10), '      + n = ', p_size, chr(10), '    }')", "concat('  # a.b', k, ' will be created', chr(10), '  + resource \"a\" \"b', k, '\" {', chr(10), '      + n = ', p_size)", f"concat({JOINED}, chr(10), 'Plan: 1 to add')", "a.b: Refreshing state... [id=1]\n", "\n\nPlan: 1 to add"),
    "cargo_test": ("cargo test", "CASE WHEN p_size % 5 = 0 THEN concat('test t', k, ' ... FAILED') ELSE concat('test t', k, ' ... ok') END", "CASE WHEN p_size % 5 = 0 THEN line END", "concat('running 9 tests', coalesce(concat(chr(10), string_agg(want, chr(10) ORDER BY k)), ''), chr(10), chr(10), 'test result: FAILED. 1 passed')", "running 9 tests\n", "\ntest result: FAILED. 1 passed"),
    "pytest": ("python -m pytest", "concat('FAILED tests/t.py::t', k)", "line", f"concat({JOINED}, chr(10), '=== 9 failed in 1s ===')", "== test session starts ==\n=== short test summary info ===\n", "\n=== 9 failed in 1s ==="),
    "rspec": ("rspec", "concat('rspec ./t.rb:', k)", "line", f"concat('Failures:', chr(10), chr(10), '  1) x', chr(10), chr(10), '9 examples, 1 failure', chr(10), 'Failed examples:', chr(10), {JOINED})", ".F\nFailures:\n\n  1) x\n\n9 examples, 1 failure\n\nFailed examples:\n\n", ""),
    "go_test": ("go test ./...", "CASE WHEN p_size % 3 = 0 THEN concat('--- FAIL: T', k, chr(10), '    t.go:1: bad') ELSE concat('--- PASS: T', k, chr(10), '    t.go:2: fine') END", "CASE WHEN p_size % 3 = 0 THEN line END", "concat(coalesce(concat(string_agg(want, chr(10) ORDER BY k), chr(10)), ''), 'FAIL', chr(9), 'pkg', chr(9), '1s')", "=== RUN T\n", "\nFAIL\tpkg\t1s"),
    "npm_test": ("npm test", "concat(CASE WHEN p_size % 3 = 0 THEN ' FAIL  ' ELSE ' PASS  ' END, 'a', k, '.js', chr(10), '  ✓ fine')", "CASE WHEN p_size % 3 = 0 THEN concat(' FAIL  a', k, '.js') END", "concat(coalesce(concat(string_agg(want, chr(10) ORDER BY k), chr(10)), ''), 'Tests: 9')", "", "\nTests: 9"),
    "dotnet": ("dotnet test", "CASE WHEN p_size % 3 = 0 THEN concat('  X T', k) ELSE concat('  P T', k) END", "CASE WHEN p_size % 3 = 0 THEN line END", "concat(coalesce(concat(string_agg(want, chr(10) ORDER BY k), chr(10)), ''), 'Failed!  - Failed: 1')", "Build started 1\n", "\nFailed!  - Failed: 1"),
    "gradle": ("gradle build", "concat('> Task :t', k, CASE p_size % 3 WHEN 0 THEN ' UP-TO-DATE' WHEN 1 THEN ' FAILED' ELSE '' END)", "CASE WHEN p_size % 3 > 0 THEN line END", "concat(coalesce(concat(string_agg(want, chr(10) ORDER BY k), chr(10)), ''), '* What went wrong:', chr(10), 'bad', chr(10), 'BUILD FAILED in 3s')", "Starting Gradle Daemon\n", "\n* What went wrong:\nbad\n\nother\nBUILD FAILED in 3s"),
    "make": ("make all", "CASE p_size % 3 WHEN 0 THEN concat('gcc -c f', k, '.c') WHEN 1 THEN concat('f', k, '.c:1:2: error: bad', chr(10), '    int x;', chr(10), '    ^') ELSE concat('f', k, '.c:1: warning: w', chr(10), '    int y;') END", "CASE p_size % 3 WHEN 1 THEN line WHEN 2 THEN concat('f', k, '.c:1: warning: w') END", "concat(coalesce(concat(string_agg(want, chr(10) ORDER BY k), chr(10)), ''), 'make: *** [all] Error 1', chr(10), count(*) FILTER (p_size % 3 = 0), ' compiled, ', count(*) FILTER (p_size % 3 = 2), ' warnings, ', count(*) FILTER (p_size % 3 = 1), ' errors')", "make[1]: Entering directory 'x'\n", "\nmake: *** [all] Error 1"),
    "apt": ("apt install x", "concat(CASE p_size % 3 WHEN 0 THEN 'Unpacking ' WHEN 1 THEN 'Get:1 ' ELSE 'W: ' END, 'p', k)", "CASE WHEN p_size % 3 = 2 THEN line END", "concat(coalesce(concat(string_agg(want, chr(10) ORDER BY k), chr(10)), ''), '1 newly installed')", "Suggested packages:\n  a\n  b\n", "\n1 newly installed"),
    "ruff": ("ruff check", "concat('f', k, '.py:1:2: F1', ' bad')", "line", "concat('F1 f', min(k), '.py:1: bad', CASE WHEN count(*) > 1 THEN concat(' (+', count(*) - 1, ' more)') ELSE '' END, chr(10), 'Found 9 errors.')", "", "\nFound 9 errors."),
    "tsc": ("tsc", "concat('f', k, '.ts(', p_size, ',1): error TS1: bad ', k)", "concat('f', k, '.ts (1 error)', chr(10), '  ', p_size, ':TS1: bad ', k)", f"concat('TS2 in 3 files: same', chr(10), '  a.ts:1, b.ts:2, c.ts:3', chr(10), {JOINED}, chr(10), 'Found 9 errors.')", "a.ts(1,1): error TS2: same\nb.ts(2,1): error TS2: same\nc.ts(3,1): error TS2: same\n", "\nFound 9 errors."),
    "eslint": ("eslint .", "concat('/a/f', k, '.js', chr(10), '  1:2  ', CASE WHEN p_size % 2 = 0 THEN 'error' ELSE 'warning' END, '  Bad  no-x', chr(10))", "CASE WHEN p_size % 2 = 0 THEN concat('/a/f', k, '.js  [1 error]', chr(10), '  1:2  error  Bad  no-x') END", "concat(coalesce(concat(string_agg(want, chr(10) ORDER BY k), chr(10)), ''), '✖ 9 problems')", "", "\n✖ 9 problems"),
    "shellcheck": ("shellcheck a.sh", "concat('In a.sh line ', k, ':', chr(10), 'x', chr(10), '  ^-- SC2086: Quote')", "concat('a.sh:', k, ': SC2086: Quote')", JOINED, "", ""),
    "psql": ("psql", "concat(' ', k, ' | a  ', p_size)", "concat(k, ' a ', p_size)", f"concat('id name', chr(10), {JOINED}, chr(10), '(9 rows)')", " id | name\n----+-----\n", "\n(9 rows)\n"),
    "vite": ("vite build", "CASE WHEN p_size % 2 = 0 THEN concat('dist/a', k, '.js  1.2 kB │ gzip: 1 kB') ELSE 'transforming...' END", "CASE WHEN p_size % 2 = 0 THEN line END", "concat(coalesce(concat(string_agg(want, chr(10) ORDER BY k), chr(10)), ''), '✓ built in 1s')", "", "\n✓ built in 1s"),
    "next": ("next dev", "CASE WHEN p_size % 2 = 0 THEN ' ○ Compiling /p ...' ELSE concat(' ✓ Compiled /q', k, ' in 1s') END", "CASE WHEN p_size % 2 = 1 THEN line END", "concat(' ○ Compiling /p ...', coalesce(concat(chr(10), string_agg(want, chr(10) ORDER BY k)), ''))", " ○ Compiling /p ...\n", ""),
    "prisma": ("prisma generate", "CASE WHEN p_size % 2 = 0 THEN concat('built in ', k) ELSE 'x' END", "CASE WHEN p_size % 2 = 0 THEN line END", "concat(coalesce(concat(string_agg(want, chr(10) ORDER BY k), chr(10)), ''), '✔ Generated Prisma Client')", "", "\n✔ Generated Prisma Client"),
    "inspect": ("docker inspect x", "concat(k, ',')", "CASE WHEN rn <= 16 THEN CAST(k AS VARCHAR) END", "concat('[', chr(10), array_to_string(list(want ORDER BY k) FILTER (want IS NOT NULL), concat(',', chr(10))), ',', chr(10), CASE WHEN count(*) >= 16 THEN concat('\"…', count(*) - 15, ' more…\"') ELSE '0' END, chr(10), ']')", "[", "\n0]"),
}
#: As ``TOOLS``: single runs and views of forges, other forms of builds, and certificates.
OTHER_TOOLS = {
    "runs": ("gh run list", "concat('✓  Fix ', k, '  CI build  main  push  123  1m')", "concat('✓ Fix ', k, ' (CI build)')", JOINED, "STATUS  TITLE\n", ""),
    "issues": ("gh issue list", "concat('#', k, '  Bug ', p_size, '  bug, urgent  about 2 days ago')", "concat('#', k, ' Bug ', p_size, ' [bug]')", JOINED, "Showing 9 of 9\n", ""),
    "pr": ("gh pr view 1", "concat('author:', chr(9), 'a', k)", "line", "concat('title: Hello', chr(10), 'state: OPEN')", "title:\tHello\nstate:\tOPEN\n", ""),
    "issue": ("gh issue view 1", "concat('comments:', chr(9), k)", "line", "concat('title: Hello', chr(10), 'state: OPEN')", "title:\tHello\nstate:\tOPEN\n", ""),
    "run": ("gh run view 1", "concat(CASE WHEN p_size % 2 = 0 THEN '✓' ELSE 'X' END, ' build', k, ' in 2m', chr(10), '  ✓ Set up', chr(10), '  X Run ', p_size, ' (5s)')", "concat(CASE WHEN p_size % 2 = 0 THEN '✓' ELSE 'X' END, ' build', k, ' (2m)', CASE WHEN p_size % 2 = 1 THEN concat(chr(10), '  X Run ', p_size) ELSE '' END)", f"concat('✓ main CI', chr(10), {JOINED}, chr(10), chr(10), 'ANNOTATIONS', chr(10), 'X bad', CASE WHEN arg_max(p_size, k) % 2 = 1 THEN concat(chr(10), 'X build', max(k), ' (2m)') ELSE '' END)", "✓ main CI\nTriggered via push\n\nJOBS\n", "\n\nANNOTATIONS\nX bad"),
    "vitest": ("vitest run", "concat(CASE WHEN p_size % 2 = 0 THEN ' ✓ a' ELSE ' ✗ b' END, k, '.test.ts (1)')", "CASE WHEN p_size % 2 = 1 THEN line END", "concat(' ✗ b.test.ts (1)', chr(10), '   Error: y', coalesce(concat(chr(10), string_agg(want, chr(10) ORDER BY k)), ''), chr(10), ' ✗ z.test.ts (1)', chr(10), chr(10), 'Tests: 1 failed')", " RUN  v1\n ✗ b.test.ts (1)\n   ✓ x\n   Error: y\n", "\n ✗ z.test.ts (1)\n\nTests: 1 failed"),
    "route": ("next build", "concat('┌ ○ /p', k)", "line", f"concat('▲ Next.js 14', chr(10), 'Route (app)', chr(10), {JOINED}, chr(10), '○  (Static)')", "▲ Next.js 14\nx\nRoute (app)\n", "\n○  (Static)"),
    "dev": ("vite", "CASE WHEN p_size % 2 = 0 THEN concat('noise ', k) ELSE 'transforming' END", "line", "concat('VITE v5.0 ready in 1 ms', chr(10), '➜  Local: x')", "VITE v5.0 ready in 1 ms\n➜  Local: x\n", ""),
    "migrate": ("prisma migrate dev", "CASE WHEN p_size % 2 = 0 THEN concat('Applying migration ', k) ELSE 'foo' END", "CASE WHEN p_size % 2 = 0 THEN line END", "concat('Applying migration', coalesce(concat(chr(10), string_agg(want, chr(10) ORDER BY k)), ''))", "Environment variables loaded\nApplying migration\n", ""),
    "push": ("prisma db push", "concat('a', k)", "CASE WHEN rn <= 20 THEN line END", JOINED, "Environment variables loaded\n", ""),
    "describe": ("kubectl describe pod x", "concat('Priority:     ', k)", "line", "concat('Name: x', chr(10), 'Conditions:', chr(10), '  Type  Status')", "Name:         x\n", "\nConditions:\n  Type  Status"),
    "certificate": ("openssl x509 -text", "concat('                0', p_size % 10, ':aa:bb')", "line", "concat('Certificate:', chr(10), '    Data:', chr(10), '        Version: 3', chr(10), '        Issuer: CN=x')", "Certificate:\n    Data:\n        Version: 3\n        Serial Number:\n", "\n        Issuer: CN=x\n    Signature Value:\n        aa:bb"),
}
HOW = {"lint": "rule", "fix": "rule", "other": "none"}



def _mixed_sql(all_tools: dict) -> str:
    return " UNION ALL ".join(
        f"SELECT run_id, '{tool}' AS tool, '{HOW.get(tool, 'native')}' AS how, {text} AS compressed FROM (SELECT *, {want} AS want FROM (SELECT *, {line} AS line FROM "
        "(SELECT p_partkey // 200 AS run_id, p_partkey AS k, p_size, row_number() OVER (PARTITION BY p_partkey // 200 ORDER BY p_partkey) AS rn, count(*) OVER (PARTITION BY p_partkey // 200) AS n FROM part))) GROUP BY run_id"
        for tool, (_, line, want, text, _, _) in all_tools.items()
    )


def _mixed(spark: SparkSession, sf_dir: str, all_tools: dict) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.expr("p_partkey div 200").alias("run_id"), F.col("p_partkey").alias("k"), "p_size")
    # a row becomes a line of each tool, so rows are dealt out before that, by run, in as many tasks as there are lines for
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, 1 + rows.count() * len(all_tools) // LINES_A_TASK), "run_id")
    lines = F.array(*[F.struct(F.lit(t).alias("tool"), F.expr(c[1]).alias("line")) for t, c in all_tools.items()])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n")
    runs = rows.select("run_id", "k", F.inline(lines)).groupBy("run_id", "tool").agg(text.alias("text"))
    fixed = [F.element_at(F.create_map(*[F.lit(x) for t, c in all_tools.items() for x in (t, c[i])]), F.col("tool")) for i in (0, 4, 5)]
    runs = runs.select("run_id", "tool", fixed[0].alias("command"), F.concat(fixed[1], "text", fixed[2]).alias("raw"))
    return tools.compress(runs, RULES).select("run_id", "tool", "how", "compressed")


@query(_mixed_sql(TOOLS))
def compress_mixed_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir, TOOLS)


@query(_mixed_sql(MORE_TOOLS))
def compress_more_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir, MORE_TOOLS)


@query(_mixed_sql(OTHER_TOOLS))
def compress_other_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir, OTHER_TOOLS)
