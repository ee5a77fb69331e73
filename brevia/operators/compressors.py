"""Format-aware compressors: each parses the lines of tool output into rows and reduces them.

Input is a frame of runs with an id and an array of lines; ``exploded`` makes a row of each line. Results are rows, whose
order within a run is ``pos`` or stated columns; ``rendered`` puts them together as text again. Windows and groups are
by run, so one shuffle on the run id serves a compressor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevia.functions import text as T

RUN = "run_id"


def exploded(runs: DataFrame, raw: str = "raw") -> DataFrame:
    """(run_id, pos, line), with positions from 0; runs without lines give none."""
    return runs.select(RUN, F.posexplode(T.lines(T.strip_ansi(F.col(raw)))).alias("pos", "line"))


def rendered(rows: DataFrame, text: str, order: str = "pos") -> DataFrame:
    return rows.groupBy(RUN).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("x")).select(RUN, F.array_join(F.transform("x", lambda r: r[text]), "\n").alias("text"))


def _group(pattern: str, i: int, line: str = "line") -> Column:
    return F.regexp_extract(line, pattern, i)


def _by_run(*keys: str) -> Window:
    return Window.partitionBy(RUN, *keys)


def extension(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(path, r"\.([a-zA-Z0-9]+)$", 1), F.lit("")), F.lit("(none)"))


def sections(runs: DataFrame, header: Callable[[Column], Column], raw: str = "raw") -> DataFrame:
    """(run_id, pos, part): the lines from each header line up to the next one, and where it is; lines before the first are left out.

    Each run is cut by itself, so nothing is shuffled or sorted and a task holds the lines of one run.
    """
    d = T.once(runs.select(RUN, raw), __lines=T.lines(T.strip_ansi(F.col(raw))))
    d = T.once(d, __at=F.filter(F.transform("__lines", lambda x, i: F.when(header(x), i)), lambda i: i.isNotNull()))
    end = lambda k: F.coalesce(F.get("__at", k + 1), F.size("__lines"))
    return d.select(RUN, F.inline(F.transform("__at", lambda i, k: F.struct(i.alias("pos"), F.slice("__lines", i + 1, end(k) - i).alias("part")))))


def lines_of(parts: DataFrame, *columns: str) -> DataFrame:
    """(run_id, pos, line) of sections' lines, their headers too, with further columns of the sections."""
    return parts.select(RUN, *columns, F.col("pos").alias("__from"), F.posexplode("part").alias("__i", "line")).select(RUN, *columns, (F.col("__from") + F.col("__i")).alias("pos"), "line")


def capped(rows: DataFrame, keys: tuple[str, ...], most: int, order: list[Column | str]) -> DataFrame:
    """The first ``most`` rows of each group, with ``more``: how many were left out."""
    w = _by_run(*keys)
    d = rows.withColumns({"__k": F.row_number().over(w.orderBy(*order)), "__n": F.count("*").over(w)})
    return d.filter(F.col("__k") <= most).withColumn("more", F.greatest(F.col("__n") - most, F.lit(0))).drop("__k", "__n")


# Listings and sizes


def du_top(runs: DataFrame, n: int = 15) -> DataFrame:
    """(run_id, rank, bytes, path, more) of the largest entries."""
    p = r"^\s*([0-9.]+[BKMGTPE]?)\s+(.*)$"
    d = exploded(runs).withColumns({"size": _group(p, 1), "path": _group(p, 2)}).filter("size <> ''")
    d = d.withColumn("bytes", T.parse_size(F.col("size")))
    w = _by_run().orderBy(F.desc("bytes"), "pos")
    d = d.withColumns({"rank": F.row_number().over(w), "more": F.greatest(F.count("*").over(_by_run()) - n, F.lit(0))})
    return d.filter(F.col("rank") <= n).select(RUN, "rank", "bytes", "path", "more")


def wc_by_extension(runs: DataFrame) -> DataFrame:
    """(run_id, ext, files, lines) of counted files; the total's line isn't one."""
    p = r"^\s*(\d+)\s+(.+)$"
    d = exploded(runs).withColumns({"n": _group(p, 1).try_cast("long"), "path": _group(p, 2)}).filter("n is not null and path <> 'total'")
    return d.groupBy(RUN, extension(F.col("path")).alias("ext")).agg(F.count("*").alias("files"), F.sum("n").alias("lines"))


def find_by_extension(runs: DataFrame, all_up_to: int = 5, most: int = 3) -> DataFrame:
    """(run_id, ext, path, files, more): up to five paths of an extension in full, else three and how many more."""
    d = exploded(runs).select(RUN, "pos", F.col("line").alias("path"), extension(F.col("line")).alias("ext")).filter("path <> ''")
    w = _by_run("ext")
    d = d.withColumns({"k": F.row_number().over(w.orderBy("pos")), "files": F.count("*").over(w)})
    shown = F.when(F.col("files") <= all_up_to, F.col("files")).otherwise(F.lit(most))
    return d.filter(F.col("k") <= shown).select(RUN, "ext", "path", "files", (F.col("files") - shown).alias("more"))


def grep_grouped(runs: DataFrame, most: int = 100, per_file: int = 25) -> DataFrame:
    """(run_id, file, matches, lineno, content): per file the first matches, files in byte order until ``most`` are shown.

    Whether a file is shown is settled before it: it is if fewer than ``most`` were shown by then.
    """
    p = r"^([^:]+):(\d+):(.*)$"
    d = exploded(runs).withColumns({"file": _group(p, 1), "lineno": _group(p, 2).try_cast("long"), "content": _group(p, 3)}).filter("file <> ''")
    w = _by_run("file")
    d = d.withColumns({"k": F.row_number().over(w.orderBy("pos")), "matches": F.count("*").over(w)}).filter(F.col("k") <= per_file)
    files = d.groupBy(RUN, "file").agg(F.count("*").alias("shown"))
    before = F.coalesce(F.sum("shown").over(_by_run().orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.withColumn("before", before).filter(F.col("before") < most).select(F.col(RUN).alias("r"), F.col("file").alias("f"))
    return d.join(files, (F.col(RUN) == F.col("r")) & (F.col("file") == F.col("f")), "left_semi").select(RUN, "file", "matches", "lineno", "content")


_LS = r"^([dlbcps-])[rwxsStT-]{9}[.+@]?\s+\d+\s+\S+\s+\S+\s+(\d+)\s+\S+\s+\S+\s+\S+\s+(.+)$"


def ls_entries(runs: DataFrame) -> DataFrame:
    """(run_id, pos, shown, is_dir): ``name/``, ``name ->`` or ``name (size)``, without ``.`` and ``..``."""
    d = exploded(runs).withColumns({"kind": _group(_LS, 1), "size": _group(_LS, 2).try_cast("long"), "name": _group(_LS, 3)})
    d = d.filter("kind <> '' and name not in ('.', '..')")
    shown = (
        F.when(F.col("kind") == "d", F.concat("name", F.lit("/")))
        .when(F.col("kind") == "l", F.concat(F.split("name", " -> ")[0], F.lit(" ->")))
        .otherwise(F.concat("name", F.lit(" ("), T.format_size(F.col("size")), F.lit(")")))
    )
    return d.select(RUN, "pos", shown.alias("shown"), (F.col("kind") == "d").alias("is_dir"))


def tar_by_extension(runs: DataFrame) -> DataFrame:
    """(run_id, ext, files, bytes) of a verbose archive listing; folders count as (dir)."""
    p = r"^([d-])\S{9,10}\s+\S+\s+(\d+)\s+\S+\s+\S+\s+(.+)$"
    d = exploded(runs).withColumns({"kind": _group(p, 1), "size": _group(p, 2).try_cast("long"), "name": _group(p, 3)}).filter("kind <> ''")
    ext = F.when(F.col("kind") == "d", F.lit("(dir)")).otherwise(extension(F.col("name")))
    return d.groupBy(RUN, ext.alias("ext")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def df_mounts(runs: DataFrame, pseudo: tuple[str, ...] = ("tmpfs", "devtmpfs", "overlay", "udev", "none")) -> DataFrame:
    """(run_id, pos, line) of the header and of file systems that aren't pseudo ones."""
    first = F.regexp_extract("line", r"^(\S+)", 1)
    return exploded(runs).filter((F.col("pos") == 0) | ((F.col("line") != "") & ~first.isin(*pseudo)))


def lsof_top(runs: DataFrame, above: int = 100, n: int = 20) -> DataFrame:
    """(run_id, cmd, files) of the commands with the most open files, for runs of more than ``above`` rows."""
    d = exploded(runs).filter("pos > 0 and line <> ''").withColumn("cmd", F.regexp_extract("line", r"^(\S+)", 1))
    d = d.groupBy(RUN, "cmd").agg(F.count("*").alias("files"))
    d = d.withColumns({"rows": F.sum("files").over(_by_run()), "k": F.row_number().over(_by_run().orderBy(F.desc("files"), "cmd"))})
    return d.filter((F.col("rows") > above) & (F.col("k") <= n)).select(RUN, "cmd", "files")


def netstat_states(runs: DataFrame, peers: int = 10) -> DataFrame:
    """(run_id, state, sockets, peer, more): listening sockets in full, of other states the first peers, frequent states first."""
    p = r"^(tcp|udp)\S*\s+\d+\s+\d+\s+(\S+)\s+(\S+)\s*(\S*)$"
    d = exploded(runs).withColumns({"local": _group(p, 2), "foreign": _group(p, 3), "state": _group(p, 4)}).filter("local <> ''")
    listens = F.col("state") == "LISTEN"
    d = d.withColumn("peer", F.when(listens, F.col("local")).otherwise(F.col("foreign")))
    w = _by_run("state")
    d = d.withColumns({"sockets": F.count("*").over(w), "k": F.row_number().over(w.orderBy("pos"))})
    return d.filter(listens | (F.col("k") <= peers)).select(RUN, "state", "sockets", "peer", F.when(listens, 0).otherwise(F.greatest(F.col("sockets") - peers, F.lit(0))).alias("more"))


def env_pairs(runs: DataFrame, noisy: str = r"^(LS_COLORS|_|SHLVL|OLDPWD)$", secret: str = r"(?i)(key|token|secret|password|credential|auth)", wanted: str | None = None) -> DataFrame:
    """(run_id, key, value), by key: noise dropped, secrets redacted by the key's name or the value's form."""
    p = r"(?s)^([A-Za-z_][A-Za-z0-9_]*)=(.*)$"
    d = exploded(runs).withColumns({"key": _group(p, 1), "value": _group(p, 2)}).filter((F.col("key") != "") & ~F.col("key").rlike(noisy))
    if wanted is not None:
        d = d.filter(F.col("key").rlike(wanted))
    return d.select(RUN, "key", F.when(F.col("key").rlike(secret), F.lit("[REDACTED]")).otherwise(T.redact_secrets(F.col("value"))).alias("value"))


def columns(rows: DataFrame, names: dict[str, int], separator: str = r" {2,}") -> DataFrame:
    """Add columns of a table whose cells are apart by two or more blanks, by place from 0; missing ones are null."""
    cells = F.split("line", separator)
    return rows.withColumns({n: F.try_element_at(cells, F.lit(i + 1)) for n, i in names.items()})


def docker_ps(runs: DataFrame) -> DataFrame:
    """(run_id, pos, id, image, status, name) of containers."""
    d = exploded(runs).filter("pos > 0").withColumn("cells", F.split("line", r"\s{2,}")).filter(F.size("cells") >= 6)
    cell = lambda i: F.col("cells")[i]
    return d.select(RUN, "pos", F.left(cell(0), F.lit(12)).alias("id"), T.short_image(cell(1)).alias("image"), T.short_status(cell(4)).alias("status"), F.element_at("cells", -1).alias("name"))


def kubectl_pods(runs: DataFrame) -> DataFrame:
    """(run_id, pos, shown): name, ready, status, age, and restarts unless all pods of the run have none."""
    p = r"^(\S+)\s+(\d+/\d+)\s+(\S+)\s+(\d+)(?:\s+\([^)]*\))?\s+(\S+)\s*$"
    d = exploded(runs).withColumns({c: _group(p, i + 1) for i, c in enumerate(("name", "ready", "status", "restarts", "age"))}).filter("name <> ''")
    calm = F.bool_and(F.col("restarts") == "0").over(_by_run())
    return d.select(RUN, "pos", F.when(calm, F.concat_ws(" ", "name", "ready", "status", "age")).otherwise(F.concat_ws(" ", "name", "ready", "status", "restarts", "age")).alias("shown"))


def head_important_tail(runs: DataFrame, important: str = r"(?i)\b(error|fatal|panic|exception|warn(ing)?|fail(ed|ure)?)\b", head: int = 20, tail: int = 20) -> DataFrame:
    """(run_id, pos, line, gap): first and last lines and important ones between; ``gap`` is how many lines went before a line."""
    n = F.count("*").over(_by_run())
    d = exploded(runs).withColumn("n", n).filter((F.col("pos") < head) | (F.col("pos") >= F.col("n") - tail) | F.col("line").rlike(important))
    before = F.lag("pos", 1, -1).over(_by_run().orderBy("pos"))
    return d.select(RUN, "pos", "line", (F.col("pos") - before - 1).alias("gap"))


# Version control


def git_log(runs: DataFrame) -> DataFrame:
    """(run_id, pos, hash, subject) of commits; the subject is the first line with text after the header's blank line."""
    d = sections(runs, lambda x: F.startswith(x, F.lit("commit ")) & x.rlike(r"^commit [0-9a-f]{7,40}"))
    body = F.filter(F.slice("part", 2, F.size("part")), lambda x: x.rlike(r"^\s+\S"))
    return d.select(RUN, "pos", F.regexp_extract(F.get("part", F.lit(0)), r"^commit ([0-9a-f]{7})", 1).alias("hash"), F.trim(F.get(body, F.lit(0))).alias("subject"))


def git_diff(runs: DataFrame) -> DataFrame:
    """(run_id, pos, file, added, deleted, hunks) of a unified diff."""
    header = r"^diff --git a/(\S+) b/(\S+)"
    d = sections(runs, lambda x: F.startswith(x, F.lit("diff --git ")) & x.rlike(header))
    begin = lambda mark, but: F.size(F.filter("part", lambda x: F.startswith(x, F.lit(mark)) & ~F.startswith(x, F.lit(but)))).cast("long")
    hunks = F.size(F.filter("part", lambda x: F.startswith(x, F.lit("@@")))).cast("long")
    return d.select(RUN, "pos", F.regexp_extract(F.get("part", F.lit(0)), header, 2).alias("file"), begin("+", "+++ ").alias("added"), begin("-", "--- ").alias("deleted"), hunks.alias("hunks"))


def git_status(runs: DataFrame, untracked: int = 10) -> DataFrame:
    """(run_id, section, file, action, more): staged, unstaged and untracked files, of the last so many at most."""
    name = lambda x: F.when(F.startswith(x, F.lit("Changes to be committed")), "staged").when(F.startswith(x, F.lit("Changes not staged")), "unstaged").when(F.startswith(x, F.lit("Untracked files")), "untracked")
    d = sections(runs, lambda x: name(x).isNotNull()).withColumn("section", name(F.get("part", F.lit(0))))
    d = lines_of(d, "section").filter(F.col("line").rlike(r"^\t\S"))
    action = F.regexp_extract("line", r"^\t([a-z ]+):\s+(.+)$", 1)
    d = d.select(RUN, "pos", "section", action.alias("action"), F.when(action != "", F.regexp_extract("line", r"^\t[a-z ]+:\s+(.+)$", 1)).otherwise(F.trim(F.regexp_replace("line", "^\t", ""))).alias("file"))
    w = _by_run("section")
    d = d.withColumns({"k": F.row_number().over(w.orderBy("pos")), "n": F.count("*").over(w)})
    most = F.when(F.col("section") == "untracked", untracked).otherwise(F.col("n"))
    return d.filter(F.col("k") <= most).select(RUN, "section", "file", "action", (F.col("n") - F.least(most, F.col("n"))).alias("more"))


# Findings of linters and compilers


def ruff_by_code(runs: DataFrame) -> DataFrame:
    """(run_id, code, first, more): the first finding of each code."""
    p = r"^(\S+?):(\d+):(\d+): ([A-Z]+\d+) (.*)$"
    d = exploded(runs).withColumn("code", _group(p, 4)).filter("code <> ''")
    return d.groupBy(RUN, "code").agg(F.min_by("line", "pos").alias("first"), (F.count("*") - 1).alias("more"), F.min("pos").alias("pos"))


def tsc_findings(runs: DataFrame, spread: int = 3, sample: int = 4, per_file: int = 3) -> DataFrame:
    """(run_id, kind, code, message, file, lineno, n): findings in ``spread`` files or more as one with sample files, others per file."""
    p = r"^(.+?)\((\d+),(\d+)\): error (TS\d+): (.*)$"
    d = exploded(runs).withColumns({"file": _group(p, 1), "lineno": _group(p, 2).try_cast("long"), "code": _group(p, 4), "message": _group(p, 5)}).filter("code <> ''")
    same = _by_run("code", "message")
    d = d.withColumn("files", F.size(F.collect_set("file").over(same)))
    wide = d.filter(F.col("files") >= spread).groupBy(RUN, "code", "message").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("file")).alias("f"))
    wide = wide.select(RUN, F.lit("shared").alias("kind"), "code", "message", F.array_join(F.slice("f", 1, sample), ",").alias("file"), F.lit(None).cast("long").alias("lineno"), "n")
    rest = capped(d.filter(F.col("files") < spread), ("file",), per_file, ["pos"])
    return wide.union(rest.select(RUN, F.lit("file").alias("kind"), "code", "message", "file", "lineno", F.lit(1).cast("long").alias("n")))


def eslint_files(runs: DataFrame) -> DataFrame:
    """(run_id, file, errors, warnings) of files with errors."""
    finding = r"^\s+(\d+):(\d+)\s+(error|warning)\s+(.*)$"
    d = sections(runs, lambda x: x.rlike(r"^\S*/\S+$")).withColumn("file", F.get("part", F.lit(0)))
    d = lines_of(d, "file").withColumn("severity", _group(finding, 3)).filter("severity <> ''")
    return d.groupBy(RUN, "file").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")).filter("errors > 0")


def shellcheck_flat(runs: DataFrame) -> DataFrame:
    """(run_id, pos, file, lineno, code, message), one row a finding."""
    header = r"^In (.+) line (\d+):"
    first = F.get("part", F.lit(0))
    d = sections(runs, lambda x: F.startswith(x, F.lit("In ")) & x.rlike(header))
    d = lines_of(d.withColumns({"file": F.regexp_extract(first, header, 1), "lineno": F.regexp_extract(first, header, 2).try_cast("long")}), "file", "lineno")
    p = r"(SC\d+)(?: \([a-z]+\))?: (.*)$"
    return d.withColumn("code", _group(p, 1)).filter("code <> ''").select(RUN, "pos", "file", "lineno", "code", _group(p, 2).alias("message"))


def psql_rows(runs: DataFrame) -> DataFrame:
    """(run_id, pos, line): rules gone, bars as single blanks."""
    d = exploded(runs).filter(~F.col("line").rlike(r"^[-+\s]*$"))
    return d.withColumn("line", F.trim(F.regexp_replace(F.regexp_replace("line", r"\s*\|\s*", " "), " {2,}", " ")))


def aws_instances(runs: DataFrame, raw: str = "raw") -> DataFrame:
    """(run_id, id, type, state, ip, name) of described instances; what is missing is a dash."""
    schema = "Reservations array<struct<Instances:array<struct<InstanceId:string,InstanceType:string,State:struct<Name:string>,PublicIpAddress:string,Tags:array<struct<Key:string,Value:string>>>>>>"
    d = runs.select(RUN, F.from_json(raw, schema).alias("j")).select(RUN, F.explode("j.Reservations").alias("r")).select(RUN, F.explode("r.Instances").alias("i"))
    return d.select(RUN, *[T.field_or_dash(c).alias(n) for n, c in (("id", F.col("i.InstanceId")), ("type", F.col("i.InstanceType")), ("state", F.col("i.State.Name")), ("ip", F.col("i.PublicIpAddress")), ("name", T.name_tag(F.col("i.Tags"))))])


def failures_and_summary(runs: DataFrame, failure: str, summary: str) -> DataFrame:
    """(run_id, pos, kind, line) of a test runner's failed tests and of its last summary line."""
    line = F.col("line")
    d = exploded(runs).withColumn("kind", F.when(line.rlike(summary), "summary").when(line.rlike(failure), "failure")).filter("kind is not null")
    last = F.row_number().over(_by_run("kind").orderBy(F.desc("pos")))
    return d.withColumn("k", last).filter("kind = 'failure' or k = 1").select(RUN, "pos", "kind", "line")


#: What failed tests and summaries look like.
TEST_RUNNERS = {
    "cargo": (r"^test .* \.\.\. FAILED$", r"^test result: "),
    "pytest": (r"^FAILED ", r"^=+ .*\b(passed|failed|error)"),
    "go": (r"^\s*--- FAIL: ", r"^(FAIL|ok)\s+\S+"),
    "rspec": (r"^rspec \./", r"^\d+ examples?, "),
}
