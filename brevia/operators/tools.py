"""Text filters of single tools: the output of one run in, the few lines that matter out.

Each is a Column expression over the run's text, so runs are never shuffled or taken apart. Line filters are array
functions; blocks of lines are taken out of the whole text with one regular expression, which is linear in its length.
A blank text gives an empty one unless stated, and where nothing is left the text itself is kept if ``or_input`` holds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brevia.functions import text as T
from brevia.operators import findings as S
from brevia.operators import listings as L
from brevia.plans import rules as R

# What the tools print.
NPM_NOISE = (
    r"^[⠙⠹⠸⠼⠴⠦⠧⠇⠏⠋]", r"^\s*(reify:|timing\s)", r"^npm warn deprecated ", r"^npm timing ", r"^(\d+ packages? are looking for funding|  run `npm fund`)",
    r"^Progress: ", r"^\s*WARN\s", r"^\s*(╭─+╮|╰─+╯|│.*│)\s*$", r"^(Packages: [+-]\d+|\++)$", r"^\[\d+/\d+\]", r"^(yarn install v|info |success Saved lockfile)",
    r"^➤ YN0000: [┌└]", r"^➤ YN0013:", r"^bun install v\d", r"^(?:Lockfile is up to date|Already up to date|up to date, audited|Saved lockfile)",
)
PIP_NOISE = (r"^Collecting ", r"^\s+(Downloading|Using cached)\s", r"^\s+[━\-]{3,}")
PULL_NOISE = r"^[a-z0-9]+: (?:Pull complete|Already exists|Pulling from|Waiting|Downloading|Verifying Checksum|Download complete|Extracting)"
BUILD_NOISE = (
    r"^ ---> Using cache", r"^ ---> (?:[0-9a-f]{12}|Removing intermediate container \S+)$", r"^ ---> Running in [0-9a-f]{12}",
    r"^(?:Digest:|Status:|Sending build context)", r"^npm warn ", PULL_NOISE,
)
BUILD_STEP, BUILD_KEPT = r"^Step \d+/\d+ : (.+)$", r"(?i)^(?:error|err\b|fatal)|^(?-i:Successfully (?:built|tagged) )"
COMPOSE_STATUS = r"^\s*(?:(?:Container|Network|Volume)\s+\S+\s+(?:Creating|Created|Starting|Started|Stopping|Stopped|Removing|Removed|Running|Healthy|Unhealthy)|Building|Successfully built|Successfully tagged|Step \d+/\d+)"
COMPOSE_ERROR, RULE_LINE = r"(?i)^(?:error|err\b|fatal|warn)", r"^[─━═\-]{3,}$"
GO_NO_ERROR, GO_ERROR = r"#\s+\S|go:\s+(?:downloading|downloaded|verifying|finding)\s", r"\S.*\.go:\d+:\d*:"
LINT_FINDING, LINT_OTHER = r"^\S.*\.go:\d+:\d+:", r"^(Issues found:|Linters used:|Run with|WARN|level=)"
TABLE_HEADER = r"^[A-Z][-A-Z_/()]*(\s{2,}[A-Z][-A-Z_/()]*)+"
APPLY_KEPT = (
    r"^\S+: (?:Creating|Modifying|Destroying)\.\.\.$", r"^\S+: (?:Creation|Modification|Destruction) complete", r"^Apply complete!",
    r"^(?:Changes to )?Outputs:", r"^\s*[+~]?\s*\w[\w_]* = ",
)
BREW_DONE, BREW_HEADER = r"^🍺\s+/", r"^==> (Summary|[a-zA-Z][@\w\-./]*)$"
REDIS_KEPT = (
    r"^# \w+", r"^(?:used_memory_human|used_memory_peak_human|used_memory_rss_human|connected_clients|blocked_clients|uptime_in_seconds|uptime_in_days|redis_version"
    r"|maxmemory_human|maxmemory_policy|mem_fragmentation_ratio|db\d+):",
)
CARGO_FETCH = r"^\s*(Downloading|Downloaded|Fetching|Fetch) "
CLIPPY_GENERATED, CLIPPY_FINDING = r"warning: `\S+` \((?:bin|lib|test) ", r"(?:warning:|error(?:\[E\d+\])?:)"
CURL_PROGRESS = (r"^\s*%?\s*(Total|Dload).*", r"^\s*\d+\s+\d+\s+\d+\s+\d+\s+\d+\s+\d+", r"^[\{\}]\s+\[\d+\s+bytes data\]")
# End of the fixed values.

Filter = Callable[[Column], Column]


def _any(x: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (x.rlike(p) for p in patterns))


def _end(array: Column) -> Column:
    return F.regexp_replace(T.joined(array), r"\s+\z", "")


def _or_input(out: Column, raw: Column) -> Column:
    return F.when(T.blank(raw), F.lit("")).when(T.blank(out), raw).otherwise(out)


def dropping(*noise: str, blanks: bool = True) -> Filter:
    """Without lines of noise and blank ones."""
    return lambda raw: _end(F.filter(T.lines(raw), lambda x: ~_any(x, noise) & (~T.blank(x) if blanks else F.lit(True))))


def keeping(*wanted: str, trim: bool = False) -> Filter:
    """Wanted lines only; the text itself if there are none."""

    def of(raw: Column) -> Column:
        lines = F.transform(T.lines(raw), T.trimmed) if trim else T.lines(raw)
        return _or_input(T.joined(F.filter(lines, lambda x: _any(x, wanted))), raw)

    return of


def npm_install(raw: Column) -> Column:
    return dropping(*NPM_NOISE)(T.joined(T.strip_node_footer(T.lines(raw))))


pip_install = dropping(*PIP_NOISE)
terraform_apply = keeping(*APPLY_KEPT)
redis_info = keeping(*REDIS_KEPT, trim=True)


def silent(raw: Column) -> Column:
    """``ok`` for a command that has nothing to say."""
    return F.when(T.blank(raw), F.lit("ok")).otherwise(raw)


def done(subcommand: Column) -> Filter:
    """``ok`` and the subcommand, whatever it printed."""
    return lambda raw: F.concat(F.lit("ok "), subcommand)


def go_build(raw: Column) -> Column:
    """Errors with the tabbed lines that follow."""
    return _or_input(T.joined(F.regexp_extract_all(raw, F.lit(rf"(?m)^(?!{GO_NO_ERROR}){GO_ERROR}.*(?:\n\t.*)*+"), F.lit(0))), raw)


def golangci_lint(raw: Column) -> Column:
    return keeping(LINT_FINDING)(raw)


def docker_build(raw: Column) -> Column:
    """Errors and results as they are, steps indented by two blanks, other lines that aren't noise by four."""
    kept = F.filter(T.lines(raw), lambda x: x.rlike(BUILD_KEPT) | x.rlike(BUILD_STEP) | ~(_any(x, BUILD_NOISE) | T.blank(x)))
    shown = F.transform(kept, lambda x: F.when(x.rlike(BUILD_KEPT), x).when(x.rlike(BUILD_STEP), F.concat(F.lit("  "), F.regexp_extract(x, BUILD_STEP, 1))).otherwise(F.concat(F.lit("    "), T.trimmed(x))))
    return _or_input(T.joined(shown), raw)


def _after(raw: Column, header: str) -> Column:
    """Lines after the first that the header's pattern fits."""
    lines = T.lines(raw)
    at = F.array_position(F.transform(lines, lambda x: x.rlike(header)), True)
    return F.when(at > 0, F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0)))).otherwise(F.array().cast("array<string>"))


def _cells(line: Column) -> Column:
    return F.split(line, " {2,}")


def docker_images(raw: Column) -> Column:
    """``repository:tag size``, without unnamed images."""
    rows = F.filter(_after(raw, r"^REPOSITORY\s+TAG\s+IMAGE ID"), lambda x: ~x.rlike(r"^<none>\s+<none>") & (F.size(_cells(x)) >= 5))
    shown = F.transform(rows, lambda x: F.concat(T.short_image(_cells(x)[0]), F.lit(":"), F.trim(_cells(x)[1]), F.lit(" "), F.trim(F.element_at(_cells(x), -1))))
    return _or_input(T.joined(shown), raw)


def docker_compose(raw: Column) -> Column:
    """``name service status`` of a listing; of other subcommands errors, what was done, and lines that aren't noise, indented."""
    header = r"^NAME\s+IMAGE\s+COMMAND"
    rows = F.filter(T.lines(raw), lambda x: ~x.rlike(header) & (F.size(_cells(x)) >= 6))
    listing = F.transform(rows, lambda x: F.concat_ws(" ", F.trim(_cells(x)[0]), F.trim(_cells(x)[3]), T.short_status(_cells(x)[5])))
    kept = F.filter(T.lines(raw), lambda x: x.rlike(COMPOSE_ERROR) | x.rlike(COMPOSE_STATUS) | ~(_any(x, (PULL_NOISE, RULE_LINE)) | T.blank(x)))
    other = F.transform(kept, lambda x: F.when(x.rlike(COMPOSE_ERROR), x).when(x.rlike(COMPOSE_STATUS), T.trimmed(x)).otherwise(F.concat(F.lit("  "), T.trimmed(x))))
    return _or_input(T.joined(F.when(raw.rlike(header), listing).otherwise(other)), raw)


def kubectl_get(raw: Column) -> Column:
    """From the header on, with single blanks between cells."""
    lines = F.filter(F.transform(T.lines(raw), T.trimmed), lambda x: x != "")
    at = F.array_position(F.transform(lines, lambda x: x.rlike(TABLE_HEADER)), True)
    table = F.transform(F.slice(lines, F.greatest(at, F.lit(1)), F.greatest(F.size(lines), F.lit(1))), lambda x: F.regexp_replace(x, " {2,}", " "))
    return F.when(T.blank(raw), F.lit("")).when(at > 0, T.joined(table)).otherwise(raw)


def brew_install(raw: Column) -> Column:
    """The first block of caveats and the last line of something installed."""
    block = F.regexp_extract(raw, rf"(?m)^==> Caveats$(?:\n(?!==> Caveats$|{BREW_HEADER[1:-1]}$|{BREW_DONE[1:]}).*)*+", 0)
    installed = F.element_at(F.concat(F.array(F.lit("")), F.filter(T.lines(raw), lambda x: x.rlike(BREW_DONE))), -1)
    return _or_input(T.joined(F.filter(F.concat(T.lines(block), F.array(installed)), lambda x: ~T.blank(x))), raw)


def brew_list(raw: Column) -> Column:
    names = F.filter(F.transform(T.lines(raw), lambda x: F.regexp_extract(x, r"^\s*(\S+)", 1)), lambda x: x != "")
    return F.when(F.size(names) == 0, F.lit("")).otherwise(F.concat(F.size(names).cast("string"), F.lit(" installed: "), F.array_join(names, ", ")))


def cargo_build(raw: Column) -> Column:
    """Error blocks, up to a blank line, and the end; before each the last crate that was compiled since the one before."""
    text = T.joined(F.filter(T.lines(raw), lambda x: ~x.rlike(CARGO_FETCH)))
    step = r"[ \t]*(?:Compiling|Finished) "
    found = F.regexp_extract_all(text, F.lit(rf"(?m)^{step}.*$|^error.*(?:\n(?![ \t]*$|[ \t]*Finished |error).*)*+(?:\n[ \t]*$)?"), F.lit(0))
    crate = lambda x: x.rlike(r"\A\s*Compiling ")
    # crates that are compiled within a block are told after it
    parted = lambda b: T.let(F.split(b, "\n", -1), lambda a: F.concat(F.array(T.joined(F.filter(a, lambda x: ~crate(x)))), F.filter(a, crate)))
    found = F.flatten(F.transform(found, lambda b: F.when(F.startswith(b, F.lit("error")), parted(b)).otherwise(F.array(b))))
    kept = T.let(found, lambda a: F.filter(a, lambda x, i: ~crate(x) | F.get(a, i + 1).isNotNull() & ~crate(F.get(a, i + 1))))
    out = F.regexp_replace(T.joined(kept), r"\A\n+|\n+\z", "")
    return F.when(~text.rlike(rf"(?m)^{step}"), raw).otherwise(_or_input(out, raw))


def cargo_clippy(raw: Column) -> Column:
    """Findings with the places they point at; ``ok`` if a check found nothing."""
    finding = rf"(?m)^{CLIPPY_GENERATED}.*$|^{CLIPPY_FINDING}.*(?:\n(?!\s*$|[ \t]*Finished |{CLIPPY_FINDING}).*)*+"
    blocks = F.regexp_extract_all(raw, F.lit(finding), F.lit(0))
    out = T.joined(F.flatten(F.transform(blocks, lambda b: F.filter(F.split(b, "\n"), lambda x, i: (i == 0) | x.rlike(r"^\s+-->")))))
    checked = raw.rlike(r"(?m)^\s*(?:Checking|Finished|Downloading|Downloaded|Fetching|Fetch) ")
    return F.when(T.blank(raw), F.lit("")).when(~checked, raw).when(T.blank(out), F.lit("ok")).otherwise(out)


def read(path: Column, most: int = 100, head: int = 40, tail: int = 20, width: int = 200) -> Filter:
    """Numbered lines of a file under a title; beyond ``most`` lines only the first and last of them."""

    def of(raw: Column) -> Column:
        lines = T.lines(raw)
        n = F.size(lines)
        numbered = F.transform(lines, lambda x, i: F.concat(F.lpad((i + 1).cast("string"), F.greatest(F.lit(4), F.length((i + 1).cast("string"))), F.lit(" ")), F.lit("  "), T.truncate_line(x, width)))
        title = F.concat(path, F.lit("  ("), n.cast("string"), F.lit(" lines"))
        whole = F.concat(title, F.lit(")\n"), T.joined(numbered))
        ends = F.concat(
            title, F.lit(f", showing first {head} + last {tail})\n"), T.joined(F.slice(numbered, 1, head)), F.lit("\n\n... ("), (n - head - tail).cast("string"),
            F.lit(" lines omitted) ...\n\n"), F.regexp_replace(T.joined(F.slice(numbered, F.greatest(n - tail + 1, F.lit(1)), F.lit(tail))), r"\s+\z", ""),
        )
        return F.when(T.blank(raw), F.concat(F.lit("(empty file: "), path, F.lit(")"))).when(n <= most, whole).otherwise(ends)

    return of


def curl(raw: Column) -> Column:
    """Of a verbose transfer the connection, the request's and the answer's first line, and the body."""
    lines = T.lines(raw)
    verbose = F.exists(lines, lambda x: x.rlike(r"^[*<>] "))
    kept = F.filter(lines, lambda x: ~_any(x, CURL_PROGRESS) & F.when(x.rlike(r"^\* "), x.rlike(r"^\* Connected to")).when(x.rlike("^> "), x.rlike(r"^>\s+\S+\s+\S+\s+HTTP/")).when(x.rlike("^< "), x.rlike(r"^<\s+HTTP/")).otherwise(True))
    return F.when(T.blank(raw), F.lit("")).when(~verbose, raw).otherwise(T.trimmed(T.joined(kept)))


def _families(words: Column) -> list[tuple[Column, Filter]]:
    """Filters with the commands that they are for."""
    word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit(""))
    tool, sub, third = word(0), word(1), word(2)
    path = F.coalesce(F.element_at(words, -1), F.lit(""))
    is_build = F.array_contains(words, "build")
    docker, cluster, packages = tool.isin("docker", "podman", "nerdctl"), tool.isin("kubectl", "k"), tool.isin("npm", "pnpm", "yarn", "bun")
    return [
        (tool.isin("cat", "head", "tail", "bat"), read(F.when(F.size(words) > 1, path).otherwise(F.lit("")))),
        (tool.isin("touch", "mkdir", "cp", "mv", "rm", "chmod", "chown", "ln"), silent),
        ((tool == "git") & (sub == "log"), L.git_log),
        ((tool == "git") & (sub == "status"), L.git_status),
        ((tool == "git") & (sub == "diff"), L.git_diff),
        (tool == "git", done(sub)),
        ((tool == "gh") & (sub == "pr") & (third == "list"), L.gh_pr_list),
        ((tool == "gh") & (sub == "pr") & (third == "view"), L.gh_pr_view),
        ((tool == "gh") & (sub == "issue") & (third == "list"), L.gh_issue_list),
        ((tool == "gh") & (sub == "issue") & (third == "view"), L.gh_issue_view),
        ((tool == "gh") & (sub == "run") & (third == "list"), L.gh_run_list),
        ((tool == "gh") & (sub == "run") & (third == "view"), L.gh_run_view),
        (tool == "ls", L.ls(F.when(sub == "", F.lit(".")).otherwise(sub))),
        (tool.isin("grep", "rg", "ag"), L.grep),
        (tool.isin("find", "fd"), L.find),
        (tool == "diff", L.diff),
        (tool == "du", L.du),
        (tool == "df", L.df),
        (tool == "wc", L.wc),
        (tool == "curl", curl),
        (tool == "dig", L.dig),
        (tool == "lsof", L.lsof),
        (tool.isin("netstat", "ss"), L.netstat),
        (tool == "openssl", L.openssl),
        (tool == "tar", L.tar),
        (tool == "smart", L.smart),
        (tool.isin("env", "printenv"), L.env()),
        ((tool == "cargo") & sub.isin("test", "t", "nextest"), S.cargo_test),
        ((tool == "cargo") & sub.isin("build", "b", "check", "c"), cargo_build),
        ((tool == "cargo") & (sub == "clippy"), cargo_clippy),
        (packages & sub.isin("install", "i", "add", "ci"), npm_install),
        (packages & sub.isin("test", "t", "run"), S.npm_test),
        (tool.isin("vitest", "jest"), S.vitest),
        (tool.isin("tsc", "tsgo"), S.tsc),
        (tool == "vite", lambda raw: S.vite(raw, is_build)),
        (tool == "next", lambda raw: S.next_js(raw, is_build)),
        (tool == "prisma", lambda raw: S.prisma(raw, words)),
        ((tool == "pytest") | (tool == "python") & (sub == "-m") & (third == "pytest"), S.pytest),
        (tool == "ruff", S.ruff),
        (tool.isin("pip", "pip3") & (sub == "install") | (tool == "uv") & (sub == "pip"), pip_install),
        ((tool == "go") & (sub == "test"), S.go_test),
        ((tool == "go") & sub.isin("build", "install"), go_build),
        (tool == "golangci-lint", golangci_lint),
        (docker & (sub == "ps"), L.docker_ps),
        (docker & (sub == "build"), docker_build),
        (docker & sub.isin("images", "image"), docker_images),
        (docker & (sub == "logs"), L.docker_logs),
        (docker & (sub == "compose") | (tool == "docker-compose"), docker_compose),
        (docker & (sub == "inspect"), lambda raw: raw),
        (cluster & (sub == "get") & (third == "pods"), L.kubectl_pods),
        (cluster & (sub == "get"), kubectl_get),
        (cluster & (sub == "describe"), L.kubectl_describe),
        (cluster & sub.isin("logs", "log"), L.kubectl_logs),
        (tool.isin("terraform", "tf", "tofu") & (sub == "plan"), L.terraform_plan),
        (tool.isin("terraform", "tf", "tofu") & (sub == "apply"), terraform_apply),
        (tool == "aws", L.aws),
        (tool.isin("make", "gmake"), S.make),
        ((tool == "brew") & sub.isin("install", "upgrade", "reinstall"), brew_install),
        ((tool == "brew") & sub.isin("list", "ls", "leaves"), brew_list),
        (tool.isin("apt", "apt-get") & sub.isin("install", "upgrade", "dist-upgrade"), S.apt_install),
        (tool == "eslint", S.eslint),
        (tool == "shellcheck", S.shellcheck),
        ((tool == "dotnet") & (sub == "test"), S.dotnet_test),
        (tool.isin("gradle", "gradlew", "./gradlew"), S.gradle),
        ((tool == "rspec") | (tool == "bundle") & (sub == "exec") & (third == "rspec"), S.rspec),
        (tool == "psql", S.psql),
        ((tool == "redis-cli") & sub.isin("info", "INFO"), redis_info),
    ]


def native(words: Column, raw: Column) -> Column:
    """The filter that a command's words ask for, the first that fits; null where there is none.

    Each filter has the text as a variable of its own, so that only the one that fits is evaluated and generated code stays small.
    """
    (condition, first), *others = _families(words)
    return reduce(lambda out, c: out.when(c[0], T.let(raw, c[1])), others, F.when(condition, T.let(raw, first)))


_BUILT: dict[str, tuple[Column, Column]] = {}


def _native_once(spark: SparkSession) -> tuple[Column, Column]:
    """Whether there is a filter, and ``native``, over the columns ``__words`` and ``__raw``. Making the expression takes the driver some ten seconds, so each application makes it once."""
    application = spark.sparkContext.applicationId
    if application not in _BUILT:
        words, raw = F.col("__words"), F.col("__raw")
        _BUILT.clear()
        _BUILT[application] = reduce(or_, [condition for condition, _ in _families(words)]), native(words, raw)
    return _BUILT[application]


def prints_json(words: Column) -> Column:
    """Whether a command's words ask for a nested value that is worth compacting."""
    tool, sub = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    args = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))
    return F.coalesce(tool.isin("docker", "podman", "nerdctl") & (sub == "inspect") | tool.isin("kubectl", "k") & (sub == "get") & (T.output_format(args) == "json"), F.lit(False))


def compress(runs: DataFrame, rules: list[R.Rule] | None = None, command: str = "command", raw: str = "raw", out: str = "compressed", agent: str | Column = "unknown", ultra: bool = False, nested: bool = True) -> DataFrame:
    """Add ``out`` and ``how``: a tool's own filter, else the rule whose beginning fits best, else the text with secrets and paths redacted.

    What filters and rules give is capped by the policy of the agent, a name or a column of names (unknown and null ones have the
    smallest), and passes the last clean-up. Null texts count as empty, and a null command
    has no filter. ``nested`` compacts JSON that a command prints, in Python workers that get only such texts; without it all stays in the JVM.
    Runs aren't shuffled; rules are joined as data. Other columns stay as they are; columns named like ``out`` or ``how`` are replaced.
    """
    kept = runs.select(F.struct(*[c for c in runs.columns if c not in (out, "how")]).alias("__row"), F.col(command).alias("__command"), F.coalesce(F.col(raw), F.lit("")).alias("__given"), F.coalesce(agent if isinstance(agent, Column) else F.lit(agent), F.lit("unknown")).alias("__agent"))
    words = F.filter(F.split(T.trimmed(F.coalesce("__command", F.lit(""))), r"\s+"), lambda w: w != "")
    d = T.once(kept, __words=words, __raw=T.strip_progress_noise(T.strip_ansi(F.col("__given"))))
    has_own, own = _native_once(runs.sparkSession)
    d = d.withColumn("__has_own", has_own)
    if nested:
        d = d.withColumn("__json", S.compact_json(F.when(prints_json(F.col("__words")), F.col("__raw"))))
        d, own = d.withColumn("__has_own", F.col("__has_own") | F.col("__json").isNotNull()), F.coalesce(F.col("__json"), own)
    if rules:
        d = R.match_rules(d, R.rule_table(d.sparkSession, rules), F.array_join("__words", " ")).withColumn("rule", F.when(~F.col("__has_own"), F.col("rule")))
        d = R.apply_rules(d, rules, "__raw", "__ruled")
    else:
        d = d.withColumns({"rule": F.lit(None).cast("string"), "__ruled": F.col("__raw")})
    # the filters' expression comes last, as each later step would look through all of it again
    found = T.once(d, __found=F.when(F.col("__has_own"), own).when(F.col("rule").isNotNull(), F.col("__ruled")))
    capped = T.post_pass(T.policy_cap(F.col("__found"), F.col("__agent")), ultra)
    how = F.when(F.col("__has_own"), "native").when(F.col("rule").isNotNull(), "rule").otherwise("none")
    text = F.when(F.col("__found").isNotNull(), capped).otherwise(T.sanitize_output(F.col("__raw")))
    # in a step of its own, as within a lambda a name may mean a column that the row brings along
    done = found.select("__row", text.alias("__text"), how.alias("__how"))
    return done.select("__row.*", F.col("__text").alias(out), F.col("__how").alias("how"))


def env_flag(value: Column) -> Column:
    """Whether the value of an environment variable switches something on: it is set and none of ``0``, ``false`` and ``no``."""
    return ~F.lower(T.trimmed(F.coalesce(value, F.lit("")))).isin("", "0", "false", "no")


def should_compress(terminal: Column, force_compress: Column, force_raw: Column) -> Column:
    """Whether output is for a reader, who gets it compressed, or for a pipe, which gets it as it is; the flags override that, raw first."""
    return ~env_flag(force_raw) & (env_flag(force_compress) | F.coalesce(terminal, F.lit(False)))


def maybe_compress(runs: DataFrame, should: Column, rules: list[R.Rule] | None = None, raw: str = "raw", out: str = "compressed", **options) -> DataFrame:
    """Add ``out`` and ``how``: the text as it is where ``should`` is false or null, else compressed and free of secrets and user paths.

    ``how`` is ``raw`` for the former. Options are those of ``compress``.
    """
    asked = F.coalesce(should, F.lit(False))
    d = compress(runs.select(F.struct("*").alias("__run"), F.col(options.pop("command", "command")).alias("__cmd"), F.col(raw).alias("__text"), asked.alias("__asked")), rules, "__cmd", "__text", "__short", **options)
    text = F.when(F.col("__asked"), T.sanitize_output(F.col("__short"))).otherwise(F.col("__text"))
    columns = [F.col("__run")[c].alias(c) for c in runs.columns if c not in (out, "how")]
    return d.select(*columns, text.alias(out), F.when(F.col("__asked"), F.col("how")).otherwise("raw").alias("how"))
