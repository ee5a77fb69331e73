"""Text filters of test runners, linters, builds and web tools: failures, findings and summaries of one run.

As in ``operators.tools`` each is a Column expression over the run's text, and a blank text gives an empty one. Blocks of
lines are taken out by one pass of a pattern with possessive repetition (``functions.text.blocks``). A text in which nothing
is found stays as it is, but for the filters that say otherwise.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from brevia.functions import text as T
from brevia.operators.listings import Filter, _end, _flat, _full, _no_lines, _numbered, _or_raw, _part, _say

# What the tools print.
PYTEST_SUMMARY, PYTEST_FAILED = r"^=+\s+\d+ (passed|failed|error)", r"(?m)^FAILED |^_{5,}[ \t]+\S"
RSPEC_SUMMARY, RSPEC_FAILED = r"^\d+ examples?,", r"(?m)^[ \t]+\d+\) |^Failures:$"
CARGO_PASSED = r"^test .+ \.\.\. (?:ok|ignored)$"
GO_STOP = r"--- PASS:|=== RUN[ \t]|ok[ \t]+\S|FAIL[ \t]"
GO_TEST = r"(?m)^(?:ok[ \t]+\S|FAIL\s|=== RUN[ \t]|--- (?:PASS|FAIL):)"
NPM_SUMMARY, NPM_PASSED = "Test Suites:|Tests:|Snapshots:|Time:|Ran all", r"^> .+ test$|^> jest|^\s+✓ |^ PASS  "
VITEST_SUMMARY, VITEST_PASSED = "Tests:|Test Files:|Duration:", r"^\s+RUN\s+v|^\s+✓\s"
DOTNET_NOISE = r"^Determining projects to restore|^\s+Restored |^Build started |^\s+\d+>|^Time Elapsed |^\s+\d+ (Warning|Error)\(s\)|^Build succeeded"
DOTNET_KEPT = r"^Build FAILED|(Passed!|Failed!)\s*-\s*Failed:\s*\d+|^\s+X |^\s*(Error|error)\b"
DOTNET_SEEN = r"(?m)^Determining projects to restore|^[ \t]+Restored |^Build started |^[ \t]+\d+>|^Time Elapsed |^Build (succeeded|FAILED)|(Passed!|Failed!)[ \t]*-[ \t]*Failed:[ \t]*\d+|^A total of \d+ test files? matched"
GRADLE_SECTION, GRADLE_KEPT = r"FAILURE:|\* (?:What went wrong|Try:|Where:)", r"> Task :.+ FAILED$|> Task :\S+$|BUILD (?:SUCCESSFUL|FAILED).*|\d+ actionable tasks:.*"
GRADLE_NOISE = r"^(Starting Gradle Daemon|Gradle Daemon started)|^> Configure project|^Deprecated Gradle features|^Use '--warning-mode|^See https://docs\.gradle|^> Task :.+ (UP-TO-DATE|NO-SOURCE)$"
GRADLE_SEEN = r"(?m)^(Starting Gradle Daemon|Gradle Daemon started)|^> Configure project|^> Task :.+ (UP-TO-DATE|NO-SOURCE|FAILED)$|^> Task :\S+$|^BUILD (SUCCESSFUL|FAILED)"
MAKE_RECIPE = r"(?:gcc|g\+\+|cc|c\+\+|clang|clang\+\+|ld|ar|as|ranlib|objcopy|strip|cmake|ninja)\b"
MAKE_ERROR, MAKE_WARNING = r"[^\s:][^:\n]*:\d+(?::\d+)?: error:", r"[^\s:][^:\n]*:\d+(?::\d+)?: warning:"
MAKE_LINKER, MAKE_CONTEXT = r"undefined reference|cannot find|multiple definition|collect2:|ld returned", r"[ \t]+\^|[ \t]{4,}\S"
MAKE_KEPT, MAKE_FOLDER = r"make(?:\[\d+\])?: (?:\*\*\*|Nothing to be done|.+ is up to date)", r"^make(?:\[\d+\])?: (Entering|Leaving) directory"
APT_NOISE = (
    r"^\s*(Reading package lists|Building dependency tree|Reading state information|Get:\d+\s|Fetched\s|Selecting previously unselected package|\(Reading database"
    r"|Preparing to unpack|Unpacking\s|Setting up\s|Processing triggers for|Need to get|After this operation)"
)
APT_SKIPPED = r"The following additional packages will be installed:|Suggested packages:"
RUFF_ROW, RUFF_SUMMARY = r"^(.+):(\d+):\d+: ([A-Z]\d+)(?:\s+\[\*\])?\s+(.+)$", r"^Found \d+ errors?"
TSC_ROW, TSC_SUMMARY = r"^(.+?)\((\d+),\d+\): error (TS\d+): (.+)$", r"^Found \d+ errors?\.?$"
ESLINT_FILE = r"[ \t]*(?:/[\w./\-]+|[\w./\-]+\.(?:ts|tsx|js|jsx|mjs|cjs|vue|svelte))[ \t]*$"
ESLINT_ROW, ESLINT_SUMMARY, ESLINT_FIXABLE = r"^\s+(\d+):(\d+)\s+(error|warning)\s+(.+?)\s{2,}(\S+)\s*$", r"^[✖✗x]\s+\d+ problem", "potentially fixable with"
SHELLCHECK_FILE, SHELLCHECK_ROW = r"In (.+) line (\d+):$", r"[ \t]+\^--[ \t]+(SC\d+):[ \t]+(.+)$"
PSQL_RULE, PSQL_COUNT = r"^[-+]+$", r"^\(\d+ rows?\)$"
VITE_BUILD = r"^\s*vite\s+v[\d.]+\s+building|^\s*dist/\S+\s+\d+(?:\.\d+)?\s*kB\s+│\s+gzip:|^\s*[✓✔]\s+built in\b|(?i:error|warning)"
VITE_BUILD_NOISE = r"^\s*(transforming|rendering chunks|computing gzip size)\b"
VITE_HMR, VITE_READY = r"^\s*\d{1,2}:\d{2}:\d{2}\s*(AM|PM)?\s*\[vite\]\s+hmr\s+update", r"^\s*VITE\s+v[\d.]+\s+ready in"
VITE_DEV = r"^\s*➜\s|(?i:error|warn)"
NEXT_BANNER = r"^\s*▲\s*Next\.js\s+v?[\d.]+"
NEXT_BUILD = NEXT_BANNER + r"|^\s*[✓✔]\s*Compiled\s+successfully|^\s*Route\s+\((?:app|pages)\)|^\s*[┌├└+]\s|^\s*[○●λƒ]\s+\(|(?i:error|warning)"
NEXT_DEV = r"^\s*[✓✔]\s+Compiled\s+\S+\s+in\b|" + NEXT_BANNER + r"|^\s*-\s*(?:Local|Network):\s|^\s*[✓✔]\s+Ready in\b|(?i:error|warn)"
NEXT_COMPILING, NEXT_RELOAD = r"^\s*[○●]\s+Compiling\s+(\S+)", r"\[hot reload\]"
PRISMA_COMMANDS = ("migrate", "generate", "validate", "studio", "format", "init", "db")
PRISMA_ERROR = r"(?i:\berror\b)"
PRISMA_KEPT = {"migrate": r"(?i:migration|applied|warning)|^Your database is now in sync|" + PRISMA_ERROR, "generate": "^✔ Generated Prisma Client| in |" + PRISMA_ERROR, "validate": "is valid|" + PRISMA_ERROR}
PRISMA_NOISE = "^Environment variables loaded|^Prisma Studio is up|^Prisma schema loaded"
# End of the fixed values.


def _bare(array: Column) -> Column:
    """Joined, without empty lines at either end."""
    return F.regexp_replace(T.joined(array), r"\A\n+|\n+\z", "")


def _or_input(out: Column, raw: Column) -> Column:
    return T.let(out, lambda x: F.when(T.blank(raw), F.lit("")).when(T.blank(x), raw).otherwise(x))


def _summary(raw: Column, pattern: str) -> Column:
    """The first summary line, else the last line with text."""
    return T.trimmed(F.coalesce(F.try_element_at(F.filter(T.lines(raw), lambda x: x.rlike(pattern)), F.lit(1)), F.element_at(_full(raw), -1)))


def _last(raw: Column, pattern: str) -> Column:
    """An array of the last line that a pattern fits, or of none."""
    return T.let(F.filter(T.lines(raw), lambda x: x.rlike(pattern)), lambda a: F.slice(a, F.greatest(F.size(a), F.lit(1)), F.lit(1)))


# Test runners


def cargo_test(raw: Column) -> Column:
    """Failed tests with what they printed, numbers of tests and results, an empty line before each result."""

    def of(array: Column) -> Column:
        gap = lambda x, i: F.when(F.startswith(x, F.lit("test result:")) & (F.coalesce(F.get(array, i - 1), F.lit("")) != ""), _say("\n", x)).otherwise(x)
        return _bare(F.transform(array, gap))

    found = T.blocks(raw, "failures:|---- ", "test result:", r"test result:.*|test .+ \.\.\. FAILED$|running .*")
    kept = F.filter(_flat(found, T.block_lines), lambda x: ~x.rlike(CARGO_PASSED))
    return F.when(T.blank(raw), F.lit("")).when(~raw.rlike(r"(?m)^test result:"), raw).otherwise(T.let(kept, of))


def pytest(raw: Column) -> Column:
    """The summary; before it failed tests of the short summary, if any failed."""
    failed = _flat(T.blocks(raw, "=+[ \t]+short test summary info[ \t]+=+$", r"=+[ \t]+(?:\d+ (?:passed|failed|error)|short test summary info)"), lambda b: F.filter(T.lines(b), lambda x: F.startswith(x, F.lit("FAILED "))))
    out = T.joined(F.concat(failed, _last(raw, PYTEST_SUMMARY)))
    return F.when(T.blank(raw), F.lit("")).when(raw.rlike(PYTEST_FAILED), _or_input(out, raw)).otherwise(_summary(raw, PYTEST_SUMMARY))


def rspec(raw: Column) -> Column:
    """The summary; with failures these, the summary and the failed examples."""
    failures = r"|Failures:$(?:\n(?!Failed examples:|\d+ examples?,).*)*+|\d+ examples?,.*"
    found = T.blocks(raw, "Failed examples:", r"Failures:$|\d+ examples?,", failures[1:])
    lines = lambda b: F.filter(T.block_lines(b), lambda x, i: ~F.startswith(b, F.lit("Failed examples:")) | (i == 0) | F.startswith(x, F.lit("rspec ")))
    return F.when(T.blank(raw), F.lit("")).when(raw.rlike(RSPEC_FAILED), _or_input(_bare(_flat(found, lines)), raw)).otherwise(_summary(raw, RSPEC_SUMMARY))


def go_test(raw: Column) -> Column:
    """Failed tests with what they printed, and packages."""
    found = T.blocks(raw, "--- FAIL:", GO_STOP, r"ok[ \t]+\S.*|FAIL(?:[ \t].*)?$|ok[ \t]*$")
    return F.when(T.blank(raw), F.lit("")).when(~raw.rlike(GO_TEST), raw).otherwise(_or_input(_end(T.joined(found)), raw))


def _suites(raw: Column, head: str, stop: str, noise: str) -> Column:
    """Lines that aren't noise; empty ones only within blocks of failed suites. May give nothing."""
    found = T.blocks(raw, head, stop, r".*\S.*")
    return F.when(T.blank(raw), F.lit("")).otherwise(_end(T.joined(F.filter(_flat(found, T.block_lines), lambda x: ~x.rlike(noise)))))


def npm_test(raw: Column) -> Column:
    return _suites(raw, " FAIL  ", f" PASS  |{NPM_SUMMARY}", NPM_PASSED)


def vitest(raw: Column) -> Column:
    return _suites(raw, r"[ \t]+✗[ \t]+\S", rf"{VITEST_SUMMARY}|[ \t]+✓[ \t]+\S.*\.test\.\S", VITEST_PASSED)


def dotnet_test(raw: Column) -> Column:
    """Failed tests, errors and summaries."""
    kept = F.filter(T.lines(raw), lambda x: x.rlike(DOTNET_KEPT) & ~x.rlike(DOTNET_NOISE))
    return F.when(~raw.rlike(DOTNET_SEEN), raw).otherwise(_or_input(_bare(kept), raw))


# Builds and packages


def gradle(raw: Column) -> Column:
    """Tasks that ran or failed, the result and sections on errors."""
    found = T.blocks(raw, GRADLE_SECTION, "$", GRADLE_KEPT)
    kept = F.filter(_flat(found, T.block_lines), lambda x: ~x.rlike(GRADLE_NOISE))
    return F.when(~raw.rlike(GRADLE_SEEN), raw).otherwise(_or_input(_bare(kept), raw))


def make(raw: Column) -> Column:
    """Errors with their source lines, warnings and the tool's own notes, then numbers of each."""
    lines = F.filter(T.lines(raw), lambda x: ~x.rlike(MAKE_FOLDER))
    pattern = rf"(?dm)^(?!{MAKE_RECIPE})(?:{MAKE_ERROR}.*(?:\n(?!.*(?:{MAKE_LINKER}))(?:{MAKE_CONTEXT}).*)*+|.*(?:{MAKE_LINKER}).*|{MAKE_WARNING}.*|{MAKE_KEPT}.*)"

    def of(a: Column) -> Column:
        compiled = F.size(F.filter(a, lambda x: x.rlike(f"^{MAKE_RECIPE}")))

        def shown(found: Column) -> Column:
            errors = F.size(F.filter(found, lambda x: x.rlike(rf"\A{MAKE_ERROR}") | x.rlike(rf"(?d)\A.*(?:{MAKE_LINKER})")))
            warnings = F.size(F.filter(found, lambda x: x.rlike(rf"\A{MAKE_WARNING}") & ~x.rlike(MAKE_LINKER)))
            numbers = _say(compiled, " compiled, ", warnings, " warnings, ", errors, " errors")
            return F.when((F.size(found) == 0) & (compiled == 0), raw).otherwise(T.joined(F.concat(found, F.array(numbers))))

        return T.let(F.regexp_extract_all(T.joined(a), F.lit(pattern), F.lit(0)), shown)

    return F.when(T.blank(raw), F.lit("")).otherwise(T.let(lines, of))


def apt_install(raw: Column) -> Column:
    """What was asked for and done, without fetching, unpacking, setting up and lists of further packages."""
    text = F.regexp_replace(T.joined(T.lines(raw)), rf"(?dm)^[ \t]*(?:{APT_SKIPPED}).*(?:\n[ \t]+\S.*)*+", "")
    return _or_input(T.joined(F.filter(_full(text), lambda x: ~x.rlike(APT_NOISE))), raw)


# Linters and compilers


def ruff(raw: Column) -> Column:
    """The first finding of each code, codes in the order in which they appear, and the summary."""
    rows = F.transform(_numbered(F.filter(T.lines(raw), lambda x: ~x.rlike(RUFF_SUMMARY)), RUFF_ROW, "file", "lineno", "code", "message"), lambda r: F.struct(r["code"].alias("key"), r["pos"].alias("pos"), _say(r["code"], " ", r["file"], ":", r["lineno"], ": ", r["message"]).alias("line")))
    firsts = F.array_sort(F.transform(T.grouped(rows), lambda g: F.struct(g["rows"][0]["pos"].alias("pos"), g["rows"][0]["line"].alias("line"), F.size(g["rows"]).alias("n"))))
    shown = F.transform(firsts, lambda r: F.when(r["n"] > 1, _say(r["line"], " (+", r["n"] - 1, " more)")).otherwise(r["line"]))
    return T.let(F.concat(shown, _last(raw, RUFF_SUMMARY)), lambda a: F.when(T.blank(raw), F.lit("")).when(F.size(a) == 0, _end(raw)).otherwise(T.joined(a)))


def tsc(raw: Column, spread: int = 3, sample: int = 4, per_file: int = 3) -> Column:
    """Errors in ``spread`` files or more once with sample places, others by file, and the summary."""
    lines = F.filter(T.lines(raw), lambda x: ~x.rlike(TSC_SUMMARY))
    rows = F.transform(_numbered(lines, TSC_ROW, "file", "lineno", "code", "message"), lambda r: F.struct(r["file"].alias("key"), *[r[c].alias(c) for c in ("pos", "lineno", "code", "message")]))
    # Files are told by where they first appear.
    placed = _flat(T.grouped(rows), lambda g: F.transform(g["rows"], lambda r: F.struct(F.struct(r["code"].alias("code"), r["message"].alias("message")).alias("key"), g["rows"][0]["pos"].alias("first"), r["pos"].alias("pos"), g["key"].alias("file"), r["lineno"].alias("lineno"))))

    def of(groups: Column) -> Column:
        files = lambda g: F.size(F.array_distinct(F.transform(g["rows"], lambda r: r["first"])))
        places = lambda g: F.array_join(F.transform(F.slice(g["rows"], 1, sample), lambda r: _say(r["file"], ":", r["lineno"])), ", ")
        extra = lambda n, form: F.when(n > 0, form(n)).otherwise(F.lit(""))
        shared = _flat(F.filter(groups, lambda g: files(g) >= spread), lambda g: F.array(_say(g["key"]["code"], " in ", files(g), " files: ", g["key"]["message"]), _say("  ", places(g), extra(F.size(g["rows"]) - sample, lambda n: _say(" (+", n, " more)")))))
        rest = T.grouped(_flat(F.filter(groups, lambda g: files(g) < spread), lambda g: F.transform(g["rows"], lambda r: F.struct(r["first"].alias("key"), r["pos"].alias("pos"), r["file"].alias("file"), r["lineno"].alias("lineno"), g["key"].alias("error")))))
        n = lambda g: F.size(g["rows"])
        line = lambda r: _say("  ", r["lineno"], ":", r["error"]["code"], ": ", r["error"]["message"])
        own = _flat(rest, lambda g: F.concat(F.array(_say(g["rows"][0]["file"], " (", n(g), " error", F.when(n(g) == 1, F.lit("")).otherwise(F.lit("s")), ")")), F.transform(F.slice(g["rows"], 1, per_file), line), F.when(n(g) > per_file, F.array(_say("  ...", n(g) - per_file, " more"))).otherwise(_no_lines())))
        return T.let(F.concat(shared, own, _last(raw, TSC_SUMMARY)), lambda a: F.when(F.size(a) == 0, _end(raw)).otherwise(T.joined(a)))

    return F.when(T.blank(raw), F.lit("")).otherwise(T.let(T.grouped(placed), of))


def eslint(raw: Column) -> Column:
    """Files with errors, these, and the summary; may give nothing."""
    lines = F.filter(T.lines(raw), lambda x: ~(x.rlike(ESLINT_SUMMARY) | x.rlike(ESLINT_FIXABLE)))
    some = lambda n, what: _say(n, " ", what, F.when(n == 1, F.lit("")).otherwise(F.lit("s")))

    def file(b: Column) -> Column:
        of_kind = lambda kind: F.filter(T.lines(b), lambda x: _part(x, ESLINT_ROW, 3) == kind)
        title = lambda e, w: _say(T.trimmed(T.lines(b)[0]), "  [", some(F.size(e), "error"), F.when(F.size(w) > 0, _say(", ", some(F.size(w), "warning"))).otherwise(F.lit("")), "]")
        shown = lambda e, w: F.when(F.size(e) > 0, F.concat(F.array(title(e, w)), F.transform(e, lambda x: _say("  ", T.trimmed(x))))).otherwise(_no_lines())
        return T.let(of_kind("error"), lambda e: T.let(of_kind("warning"), lambda w: shown(e, w)))

    def of(files: Column) -> Column:
        ends = F.transform(F.concat(_last(raw, ESLINT_SUMMARY), _last(F.regexp_replace(raw, rf"(?m){ESLINT_SUMMARY}.*", ""), ESLINT_FIXABLE)), T.trimmed)
        return F.when((F.size(files) == 0) & ~raw.rlike(f"(?m){ESLINT_SUMMARY}"), _end(raw)).otherwise(T.joined(F.concat(_flat(files, file), ends)))

    return F.when(T.blank(raw), F.lit("")).otherwise(T.let(T.blocks(T.joined(lines), ESLINT_FILE), of))


def shellcheck(raw: Column) -> Column:
    """``file:line: code: message``; a second finding of a place stands without it."""
    found = F.regexp_extract_all(T.joined(T.lines(raw)), F.lit(rf"(?dm)^(?:{SHELLCHECK_FILE}|{SHELLCHECK_ROW})"), F.lit(0))

    def of(a: Column) -> Column:
        place = lambda x: F.coalesce(_say(F.nullif(_part(x, SHELLCHECK_FILE), F.lit("")), ":", _part(x, SHELLCHECK_FILE, 2), ": "), F.lit(""))
        line = lambda x, i: F.when(x.rlike(rf"\A{SHELLCHECK_ROW}"), _say(F.coalesce(place(F.get(a, i - 1)), F.lit("")), _part(x, SHELLCHECK_ROW), ": ", _part(x, SHELLCHECK_ROW, 2)))
        return T.let(F.filter(F.transform(a, line), lambda x: x.isNotNull()), lambda out: F.when(F.size(out) == 0, _end(raw)).otherwise(T.joined(out)))

    return F.when(T.blank(raw), F.lit("")).otherwise(T.let(found, of))


def psql(raw: Column) -> Column:
    """Rows with single blanks between cells, without rules."""
    kept = F.filter(F.transform(_full(raw), T.trimmed), lambda x: ~x.rlike(PSQL_RULE))
    return _or_raw(raw, F.transform(kept, lambda x: F.when(x.rlike(PSQL_COUNT), x).otherwise(F.regexp_replace(T.trimmed(F.regexp_replace(x, r"\s*\|\s*", " ")), " {2,}", " "))), T.joined)


# Web tools; all of these may give nothing


def _kept(pattern: str, noise: str | None = None) -> Filter:
    return lambda raw: T.joined(F.filter(_full(raw), lambda x: x.rlike(pattern) & (~x.rlike(noise) if noise else F.lit(True))))


def vite(raw: Column, build: Column) -> Column:
    """Of a build its table, time, errors and warnings; else the first ready line, addresses, errors and warnings, thirty at most."""

    def dev(array: Column) -> Column:
        kept = F.filter(array, lambda x: ~x.rlike(VITE_HMR) & (x.rlike(VITE_READY) | x.rlike(VITE_DEV)))
        ready = lambda a: F.array_position(F.transform(a, lambda x: x.rlike(VITE_READY)), True)
        once = T.let(kept, lambda a: T.let(ready(a), lambda at: F.filter(a, lambda x, i: ~x.rlike(VITE_READY) | (i == at - 1))))
        return T.let(once, lambda a: T.joined(F.when(F.size(a) > 30, F.concat(F.slice(a, 1, 30), F.array(F.lit("…")))).otherwise(a)))

    return F.when(build, _kept(VITE_BUILD, VITE_BUILD_NOISE)(raw)).otherwise(T.let(_full(raw), dev))


def next_js(raw: Column, build: Column, reloads: int = 32) -> Column:
    """Of a build its routes, errors and warnings; else each path's first compiling line, so many reloads, and ready lines."""

    def dev(array: Column) -> Column:
        kind = lambda x: F.when(x.rlike(NEXT_RELOAD), "reload").when(x.rlike(NEXT_COMPILING), "compiling").when(x.rlike(NEXT_DEV), "other")
        rows = F.transform(array, lambda x, i: F.struct(F.when(x.rlike(NEXT_COMPILING), _part(x, NEXT_COMPILING)).otherwise(F.lit("")).alias("key"), i.alias("pos"), x.alias("line"), kind(x).alias("kind")))
        bare = lambda a: F.transform(a, lambda r: F.struct(r["pos"].alias("pos"), r["line"].alias("line")))
        of_kind = lambda a, k: F.filter(a, lambda r: r["kind"] == k)
        firsts = lambda a: F.transform(T.grouped(of_kind(a, "compiling")), lambda g: g["rows"][0])
        return T.let(rows, lambda a: T.joined(F.transform(F.array_sort(F.concat(bare(of_kind(a, "other")), bare(F.slice(of_kind(a, "reload"), 1, reloads)), bare(firsts(a)))), lambda r: r["line"])))

    return F.when(build, _kept(NEXT_BUILD)(raw)).otherwise(T.let(_full(raw), dev))


def prisma(raw: Column, words: Column) -> Column:
    """By the first known subcommand among the words: its results and errors, else twenty lines without banners."""
    sub = F.try_element_at(F.filter(words, lambda w: w.isin(*PRISMA_COMMANDS)), F.lit(1))
    out = T.joined(F.slice(F.filter(T.lines(raw), lambda x: ~x.rlike(PRISMA_NOISE)), 1, 20))
    for name, pattern in PRISMA_KEPT.items():
        out = F.when(sub == name, _kept(pattern)(raw)).otherwise(out)
    return out


# Nested values


def json_shortener(items: int = 16, keys: int = 32) -> Callable[[str | None], str | None]:
    """A function of one JSON text: a line for each element of its top level, keys sorted, long arrays and objects cut; null if it is none.

    Nothing built in walks a value of unknown depth. Its parts are local, so that it is sent whole to workers that lack this package.
    """

    def short(value: object) -> object:
        if isinstance(value, list):
            kept = [short(x) for x in value[:items]]
            return kept + [f"…{len(value) - items} more…"] if len(value) > items else kept
        if isinstance(value, dict):
            cut = {k: short(value[k]) for k in sorted(value)[:keys]}
            if len(value) > keys:
                cut["__truncated__"] = f"…{len(value) - keys} more keys…"
            return dict(sorted(cut.items()))
        return value

    def no_constant(name: str) -> object:
        raise ValueError(name)

    def dump(value: object) -> str:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))

    def shown(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            v = short(json.loads(text, parse_constant=no_constant))
        except (ValueError, RecursionError):
            return None
        if isinstance(v, list) and v:
            return "[\n" + ",\n".join(map(dump, v)) + "\n]"
        if isinstance(v, dict) and v:
            return "{\n" + ",\n".join(f"{dump(k)}:{dump(x)}" for k, x in v.items()) + "\n}"
        return dump(v)

    return shown


def compact_json(text: Column) -> Column:
    """``json_shortener`` of each text, a batch at a time."""
    shown = json_shortener()

    def batch(texts: pd.Series) -> pd.Series:
        return pd.Series([shown(t if isinstance(t, str) else None) for t in texts], dtype=object)

    return F.pandas_udf(batch, StringType())(text)
