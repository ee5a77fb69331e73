"""Text filters of version control, listings and clusters: the output of one run in, a short listing out.

As in ``operators.tools`` each is a Column expression over the run's text, a blank text gives an empty one, and a text in
which nothing is found stays as it is. Groups within a run are made by sorting, so a long run costs n log n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from brevia.functions import text as T

# What the tools print.
COMMIT, COMMIT_META = "commit [0-9a-f]{7,40}", r"(?:Author|Date):[ \t]+\S"
STATUS_HEADS = "Changes to be committed|Changes not staged|Untracked files"
STATUS_ENTRY = r"^\s+(new file|modified|deleted|renamed|copied|typechange):\s+(.+)$"
DIFF_FILE, PLAIN_HUNK = "diff --git a/.+ b/.+", r"(?m)^@@[ \t]+-\d+(?:,\d+)?[ \t]+\+\d+(?:,\d+)?[ \t]+@@"
PR_ROW = r"^\s{0,4}#(\d+)\s{2,}(.+?)\s{2,}(\S+)\s{2,}(OPEN|MERGED|CLOSED)\s"
ISSUE_ROW = r"^#(\d+)\s{2,}(.+?)\s{2,}([\w\-,\s]+?)\s{2,}(about .+)$"
RUN_ROW = r"^([✓X✗\-*]|in_progress)\s+(.+?)\s{2,}(\S[\w\s\-]+?)\s{2,}(\S+)\s{2,}(\S+)\s{2,}(\d+)\s"
RUN_JOB, RUN_STEP = r"^([✓X✗\-])\s+(.+?)\s+in\s+(.+)$", r"^\s{2}X\s+(.+?)(?:\s+\(\d+[smh]?\d*s?\))?$"
PR_KEYS = ("title", "state", "number", "url", "labels", "reviewers", "assignees", "milestone")
ISSUE_KEYS = ("title", "state", "number", "url", "labels", "assignees", "milestone")
EXTENSION = r"\.([a-zA-Z0-9]+)$"
LS_ROW = r"^([drwx\-lsStT@+]{10,})\s+\d+\s+\S+\s+\S+\s+(\d+)\s+\w+\s+\d+\s+[\d:]+\s+(.+)$"
DU_ROW = r"^([\d.]+[BKMGTPE]?i?)\s+(.+)$"
DF_SKIPPED = (
    r"(?i)^(tmpfs|devfs|devtmpfs|sysfs|proc|cgroup|overlay|none|udev|map\s|/snap/|loop\d|nsfs|hugetlbfs|mqueue|debugfs|tracefs|pstore|securityfs|fusectl|binfmt_misc"
    r"|efivarfs|configfs|devpts|ramfs|rpc_pipefs|sunrpc|nfsd|autofs)"
)
DF_SKIPPED_MOUNT = r"^(/System/Volumes/(VM|Preboot|Update|iSCPreboot|xarts|Hardware)|/private/var/folders|/dev$|map\s)"
LSOF_ROW = r"^(\S+)\s+(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+\S+\s+\S+\s+\S+\s+(.+)$"
INET_ROW = r"^(tcp\d?|udp\d?)\s+\d+\s+\d+\s+(\S+)\s+(\S+)(?:\s+(\w+))?\s*$"
SS_ROW = r"^(LISTEN|ESTAB|TIME-WAIT|CLOSE-WAIT|SYN-SENT|SYN-RECV|FIN-WAIT-1|FIN-WAIT-2|CLOSING|LAST-ACK|UNCONN)\s+\d+\s+\d+\s+(\S+)\s+(\S+)"
TAR_ROW = r"^([dl\-][rwxstST\-]{9})\s+\S+\s+\S+(?:\s+\S+)?\s+(\d+)\s+\S+\s+\S+(?:\s+\S+)?\s+(.+)$"
ENV_ROW = r"^([A-Za-z_][A-Za-z0-9_]*)=(.*)$"
ENV_NOISE = r"^(VSCODE_|ELECTRON_|APPLICATIONINSIGHTS_|LaunchInstanceID|__CF|__CFBundle|XPC_|MACH_PORT|OTEL_|COPILOT_OTEL|CONDA_PROMPT_MODIFIER)"
ENV_SECRET = r"(?i)^(api[_\-]?key|.*[_\-]token|.*[_\-]secret|.*[_\-]password|.*[_\-]credential|.*[_\-]auth)$"
CODE_DEFINITION = r"^\s*(pub\s+)?(fn|async fn|def|function|class|struct|enum|trait|impl|interface|type)\s+"
CODE_IMPORT, CODE_COMMENT = r"^\s*(use|import|from|require|include|#include)\s+", r"^\s*(//|#|/\*|\*|<!--)"
CERTIFICATE_BLOCKS = (
    "Serial Number:|X509v3 Subject Key Identifier:|X509v3 Authority Key Identifier:|Authority Information Access:|X509v3 Certificate Policies:|CT Precertificate SCTs:"
)
CERTIFICATE_LINES = r"^\s*(?:Subject Public Key Info:|pub:|ASN1 OID:|NIST CURVE:)|^\s*[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2})+:?\s*$"
PS_HEADER, PODS_HEADER = r"^CONTAINER ID\s+IMAGE\s+COMMAND", r"^NAME\s+READY\s+STATUS"
LOG_IMPORTANT, LOG_ERROR = r"(?i)\b(?:error|fatal|panic|warn)\b", r"(?i)\b(?:ERROR|WARN|FATAL|PANIC|CRIT)\b"
DESCRIBED_KEPT, DESCRIBED_SKIPPED = "^(?:Conditions|Events)", "^(?:Annotations|Volumes|Tolerations|QoS Class|Node-Selectors)"
DESCRIBED_KEYS = "^(?:Name|Namespace|Status|IP|Controlled By|Node):"
DESCRIBED_STATE = "^(?:State|Ready|Restart Count|Limits|Requests|Liveness|Readiness|Reason|Exit Code|cpu|memory):"
PLAN_RESOURCE, PLAN_OPEN = r"[ \t]+#[ \t]+\S+[ \t]+will be[ \t]+\w+", r'[ \t]+[+~\-][ \t]+resource[ \t]+"[^"\n]+"[ \t]+"[^"\n]+"[ \t]+\{'
PLAN_TAGS, PLAN_CLOSE, PLAN_REFRESH = r"^\s+[+~\-]\s+tags\s+=", r"^\s+\}\s*$", r"^\S+: Refreshing state\.\.\."
# End of the fixed values.

Filter = Callable[[Column], Column]


def _no_lines() -> Column:
    return F.array().cast("array<string>")


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _end(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+\z", "")


def _more(n: Column, most: int, form: str = "  ... +{} more") -> Column:
    """A line that tells how many of n were left out, if any."""
    before, after = form.split("{}")
    return F.when(n > most, F.array(_say(before, n - most, after))).otherwise(_no_lines())


def _part(x: Column, pattern: str, i: int = 1) -> Column:
    return F.regexp_extract(x, pattern, i)


def _full(raw: Column) -> Column:
    return F.filter(T.lines(raw), lambda x: ~T.blank(x))


def _numbered(array: Column, pattern: str, *fields: str) -> Column:
    """Structs of a pattern's groups and ``pos`` for the lines that it fits."""
    rows = F.transform(array, lambda x, i: F.struct(*[_part(x, pattern, k + 1).alias(f) for k, f in enumerate(fields)], i.alias("pos"), x.rlike(pattern).alias("fits")))
    return F.filter(rows, lambda r: r["fits"])


def _or_raw(raw: Column, rows: Column, f: Filter) -> Column:
    """``f`` of an array, or the text itself where the array is empty; blank texts give empty ones."""
    return T.let(rows, lambda a: F.when(T.blank(raw), F.lit("")).when(F.size(a) == 0, raw).otherwise(f(a)))


def _total(rows: Column, f: Filter) -> Column:
    return F.aggregate(rows, F.lit(0).cast("long"), lambda s, r: s + f(r).cast("long"))


def _flat(rows: Column, f: Filter) -> Column:
    return F.flatten(F.transform(rows, f))


def _extension(path: Column) -> Column:
    return F.when(path.rlike(EXTENSION), _part(path, EXTENSION)).otherwise(F.lit("(no ext)"))


# Version control


def git_log(raw: Column) -> Column:
    """How many commits, and of each the short hash and the first line with text after a blank one."""
    subject = rf"(?dm)^[ \t]*\n(?:(?:[ \t]*|{COMMIT_META}.*)\n)*+(?!{COMMIT_META})(.*\S.*)$"
    rows = F.transform(T.blocks(raw, COMMIT), lambda b: F.struct(F.substr(b, F.lit(8), F.lit(7)).alias("hash"), T.trimmed(_part(b, subject)).alias("subject")))
    return _or_raw(raw, F.filter(rows, lambda r: r["subject"] != ""), lambda a: T.joined(F.concat(F.array(_say(F.size(a), " commits")), F.transform(a, lambda r: _say("  ", r["hash"], " ", r["subject"])))))


def git_status(raw: Column) -> Column:
    """Branch, staged and unstaged files with what was done, and up to ten untracked ones; never the text itself."""

    def of(found: Column) -> Column:
        inside = lambda head: _flat(F.filter(found, lambda b: F.startswith(b, F.lit(head))), lambda b: F.filter(T.lines(b), lambda x, i: (i > 0) & ~x.rlike(r'^\s+\(use "git')))
        entries = lambda head: F.transform(F.filter(inside(head), lambda x: x.rlike(STATUS_ENTRY)), lambda x: _say("  ", _part(x, STATUS_ENTRY), ": ", T.trimmed(_part(x, STATUS_ENTRY, 2))))
        other = F.transform(F.filter(inside("Untracked"), lambda x: x.rlike(r"^\s+\S.+$") & ~x.rlike(STATUS_ENTRY)), lambda x: _say("  ", T.trimmed(x)))
        section = lambda name, rows, most: T.let(rows, lambda a: F.when(F.size(a) > 0, F.concat(F.array(F.lit(""), _say(name, " (", F.size(a), "):")), F.slice(a, 1, most), _more(F.size(a), most))).otherwise(_no_lines()))
        branch = F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(raw, F.lit(r"(?m)^On branch (.+)$"), F.lit(1))), -1)
        every = 2**31 - 1
        return _end(T.joined(F.concat(F.array(_say("branch: ", branch)), section("staged", entries("Changes to"), every), section("unstaged", entries("Changes not"), every), section("untracked", other, 10))))

    return F.when(T.blank(raw), F.lit("")).otherwise(T.let(T.blocks(raw, STATUS_HEADS), of))


def _diff(raw: Column, hunk: str, title: Callable[[Column], Column], sample: int) -> Column:
    n = lambda b, p: F.regexp_count(b, F.lit(p))
    changed = lambda b: F.regexp_extract_all(b, F.lit(r"(?dm)^(?:\+[^+\n]|-[^-\n]).*$"), F.lit(0))
    fields = lambda b: F.struct(_part(b, r"(?d)^diff --git a/.+ b/(.+)").alias("name"), n(b, r"(?m)^\+[^+\n]").alias("add"), n(b, r"(?m)^-[^-\n]").alias("del"), n(b, hunk).alias("hunks"), F.slice(changed(b), 1, sample).alias("sample"))

    def of(a: Column) -> Column:
        head = _say(F.size(a), " files changed, +", _total(a, lambda r: r["add"]), " -", _total(a, lambda r: r["del"]))
        shown = _flat(a, lambda r: F.concat(F.array(title(r)), F.transform(r["sample"], lambda x: _say("  ", x)), _more(r["add"] + r["del"], sample, "  ... +{} more changes") if sample else _no_lines()))
        return _end(T.joined(F.concat(F.array(head), shown)))

    return _or_raw(raw, F.transform(T.blocks(raw, DIFF_FILE), fields), of)


def git_diff(raw: Column) -> Column:
    """Files with lines added and deleted and hunks, after their totals."""
    return _diff(raw, r"(?m)^@@[ \t]", lambda r: _say("  ", r["name"], " (+", r["add"], " -", r["del"], ", ", r["hunks"], " hunks)"), 0)


def diff(raw: Column) -> Column:
    """As ``git_diff``, with the first three changes of each file."""
    return _diff(raw, PLAIN_HUNK, lambda r: _say("\n", r["name"], "  (+", r["add"], " -", r["del"], ", ", r["hunks"], " hunks)"), 3)


def _rows(pattern: str, shown: Filter, trim: bool = False) -> Filter:
    """Lines that a pattern fits, each shown in its short form."""

    def of(raw: Column) -> Column:
        array = F.transform(T.lines(raw), T.trimmed) if trim else T.lines(raw)
        return _or_raw(raw, F.transform(F.filter(array, lambda x: x.rlike(pattern)), shown), T.joined)

    return of


gh_pr_list = _rows(PR_ROW, lambda x: _say("#", _part(x, PR_ROW), " ", T.truncate_words(_part(x, PR_ROW, 2), 40), " [", _part(x, PR_ROW, 4), "]"))
gh_run_list = _rows(RUN_ROW, lambda x: _say(_part(x, RUN_ROW), " ", T.truncate_words(_part(x, RUN_ROW, 2), 35), " (", T.truncate_words(_part(x, RUN_ROW, 3), 25), ")"))
gh_issue_list = _rows(ISSUE_ROW, lambda x: _say("#", _part(x, ISSUE_ROW), " ", T.truncate_words(_part(x, ISSUE_ROW, 2), 30), " [", T.trimmed(F.split(_part(x, ISSUE_ROW, 3), ",")[0]), "]"), trim=True)


def gh_view(*keys: str) -> Filter:
    """The named fields before the body, titles cut at 60 characters."""
    field = rf"^({'|'.join(keys)}):\t(.+)$"

    def of(raw: Column) -> Column:
        value = lambda x: F.when(_part(x, field) == "title", T.truncate_words(_part(x, field, 2), 60)).otherwise(T.trimmed(_part(x, field, 2)))
        head = F.split(raw, r"(?dm)^[ \t]*--[ \t\r]*$", 2)[0]
        return _or_raw(raw, F.transform(F.filter(T.lines(head), lambda x: x.rlike(field)), lambda x: _say(_part(x, field), ": ", value(x))), T.joined)

    return of


gh_pr_view, gh_issue_view = gh_view(*PR_KEYS), gh_view(*ISSUE_KEYS)


def gh_run_view(raw: Column) -> Column:
    """The first line, jobs with their time, failed steps of failed jobs, and annotations, after which the last job is told again if it failed."""
    parts = F.split(raw, r"(?dm)^[ \t]*ANNOTATIONS[ \t\r]*$", 2)
    jobs = T.blocks(F.regexp_replace(parts[0], r"\A.*", ""), r"[ \t]*[✓X✗\-][ \t]+.+?[ \t]+in[ \t]+.")
    failed = lambda b: F.transform(F.filter(T.lines(b), lambda x: x.rlike(RUN_STEP)), lambda x: _say("  X ", _part(x, RUN_STEP)))
    job = lambda b: T.let(T.trimmed(T.lines(b)[0]), lambda x: F.concat(F.array(_say(_part(x, RUN_JOB), " ", _part(x, RUN_JOB, 2), " (", _part(x, RUN_JOB, 3), ")")), F.when(F.startswith(x, F.lit("X")), failed(b)).otherwise(_no_lines())))
    last = F.filter(F.slice(_flat(F.slice(jobs, -1, 1), job), 1, 1), lambda x: F.startswith(x, F.lit("X")))
    again = F.when(F.size(jobs) > 0, last).otherwise(_no_lines())
    notes = F.when(F.size(parts) > 1, F.concat(F.array(F.lit(""), F.lit("ANNOTATIONS")), F.transform(_full(F.get(parts, F.lit(1))), T.trimmed), again)).otherwise(_no_lines())
    return _or_raw(raw, F.concat(_flat(jobs, job), notes), lambda a: T.joined(F.concat(F.slice(T.lines(raw), 1, 1), a)))


# Files


def ls(path: Column) -> Filter:
    """Folders, links and files with sizes under the path and their numbers."""

    def of(raw: Column) -> Column:
        rows = F.filter(_numbered(T.lines(raw), LS_ROW, "mode", "size", "name"), lambda r: ~r["name"].isin(".", ".."))
        folder, link = (lambda r: F.startswith(r["mode"], F.lit("d"))), (lambda r: F.startswith(r["mode"], F.lit("l")))
        shown = lambda r: F.when(folder(r), _say("  ", r["name"], "/")).when(link(r), _say("  ", F.split(r["name"], " -> ")[0], " ->")).otherwise(_say("  ", r["name"], " (", T.format_size(r["size"].try_cast("long")), ")"))
        head = lambda a: _say(path, "  (", _total(a, lambda r: folder(r).cast("int")), " dirs, ", _total(a, lambda r: (~folder(r) & ~link(r)).cast("int")), " files)")
        return _or_raw(raw, rows, lambda a: T.joined(F.concat(F.array(head(a)), F.transform(a, shown))))

    return of


def grep(raw: Column, most: int = 100, per_file: int = 25) -> Column:
    """Up to ``most`` matches as they are; else by file in byte order, until so many are shown by the end of a file."""
    row = r"^([^:]+):(\d+):(.*)$"

    def shown(found: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), _no_lines().alias("out"))
        line = lambda r: _say("  ", r["lineno"], ":", T.trimmed(r["content"]))
        file = lambda g: F.concat(F.array(F.lit(""), _say(g["key"], "  (", F.size(g["rows"]), " matches)")), F.transform(F.slice(g["rows"], 1, per_file), line), _more(F.size(g["rows"]), per_file))
        step = lambda acc, g: F.when(acc["n"] >= most, acc).otherwise(F.struct((acc["n"] + F.least(F.size(g["rows"]), F.lit(per_file))).alias("n"), F.concat(acc["out"], file(g)).alias("out")))
        return F.aggregate(found, start, step, lambda acc: acc["out"])

    def of(array: Column) -> Column:
        rows = F.transform(_numbered(array, row, "file", "lineno", "content"), lambda r: F.struct(r["file"].alias("key"), r["pos"].alias("pos"), r["lineno"].alias("lineno"), r["content"].alias("content")))
        body = lambda g: _end(T.joined(F.concat(F.array(_say(F.size(array), " matches across ", F.size(g), " files")), shown(g))))
        return F.when(F.size(array) == 0, F.lit("")).when(F.size(array) <= most, raw).otherwise(T.let(T.grouped(rows), body))

    return T.let(_full(raw), of)


def find(raw: Column) -> Column:
    """Up to ten paths as they are; else by extension, more than five of one as three and a number."""

    def of(array: Column) -> Column:
        rows = F.transform(array, lambda x, i: F.struct(_extension(x).alias("key"), i.alias("pos"), x.alias("path")))
        size = lambda g: F.size(g["rows"])
        block = lambda g: F.concat(F.array(F.lit(""), _say(".", g["key"], " (", size(g), "):")), F.transform(F.slice(g["rows"], F.lit(1), F.when(size(g) <= 5, size(g)).otherwise(3)), lambda r: _say("  ", r["path"])), F.when(size(g) > 5, _more(size(g), 3)).otherwise(_no_lines()))
        return F.when(F.size(array) == 0, F.lit("")).when(F.size(array) <= 10, raw).otherwise(_end(T.joined(F.concat(F.array(_say(F.size(array), " files found")), _flat(T.grouped(rows), block)))))

    return T.let(_full(raw), of)


def du(raw: Column, n: int = 15) -> Column:
    """The largest entries, of equal ones the earlier first."""
    rows = _numbered(F.transform(T.lines(raw), T.trimmed), DU_ROW, "size", "path")
    sized = F.array_sort(F.transform(rows, lambda r: F.struct((-T.parse_size(r["size"])).alias("bytes"), r["pos"].alias("pos"), r["size"].alias("size"), r["path"].alias("path"))))

    def of(a: Column) -> Column:
        line = lambda indent: lambda r: _say(indent, T.right(r["size"], 8), "  ", r["path"])
        cut = F.concat(F.array(_say(f"top {n} of ", F.size(a), " entries (sorted by size):")), F.transform(F.slice(a, 1, n), line("  ")), F.array(_say("  ... and ", F.size(a) - n, " more entries")))
        return _end(T.joined(F.when(F.size(a) <= n, F.transform(a, line(""))).otherwise(cut)))

    return _or_raw(raw, sized, of)


def df(raw: Column) -> Column:
    """The header and mounts that aren't virtual or internal, and how many were left out."""
    first, last = (lambda x: _part(x, r"^\s*(\S+)")), (lambda x: _part(x, r"(\S+)\s*$"))
    skipped = lambda x: first(x).rlike(DF_SKIPPED) | last(x).rlike(DF_SKIPPED) | last(x).rlike(DF_SKIPPED_MOUNT)

    def of(array: Column) -> Column:
        rows = F.filter(F.slice(array, F.lit(2), F.size(array)), lambda x: ~T.blank(x))
        kept = F.filter(rows, lambda x: ~skipped(x))
        out = lambda a: F.when(F.size(a) == 0, raw).otherwise(T.joined(F.concat(F.slice(array, 1, 1), a, F.when(F.size(rows) > F.size(a), F.array(_say("# (", F.size(rows) - F.size(a), " virtual/internal mounts omitted)"))).otherwise(_no_lines()))))
        return F.when(T.blank(raw), F.lit("")).otherwise(T.let(kept, out))

    return T.let(T.lines(raw), of)


def wc(raw: Column) -> Column:
    """One file as ``path: n lines``, up to ten as a list, more by extension and the five longest."""
    row = r"^\s*(\d+)\s+(.+)$"

    def of(array: Column) -> Column:
        is_total = lambda x: x.rlike(r"^\s*\d+\s+total$")
        rows = F.transform(_numbered(F.filter(array, lambda x: ~is_total(x)), row, "n", "path"), lambda r: F.struct((-r["n"].try_cast("long")).alias("n"), r["pos"].alias("pos"), T.trimmed(r["path"]).alias("path")))
        stated = F.element_at(F.concat(F.array(F.lit(None).cast("long")), F.transform(F.filter(array, is_total), lambda x: _part(x, row).try_cast("long"))), -1)

        def shown(a: Column) -> Column:
            total = F.coalesce(stated, _total(a, lambda r: -r["n"]))
            line = lambda r: _say("  ", T.right((-r["n"]).cast("string"), 8), "  ", r["path"])
            kinds = F.transform(T.grouped(F.transform(a, lambda r: F.struct(_extension(r["path"]).alias("key"), r["pos"].alias("pos"), r["n"].alias("n")))), lambda g: F.struct(_total(g["rows"], lambda r: r["n"]).alias("n"), g["key"].alias("key"), F.size(g["rows"]).alias("files")))
            kind = lambda k: _say("  .", T.left(k["key"], 12), " ", T.right((-k["n"]).cast("string"), 8), " lines  (", k["files"], " files)")
            many = F.concat(F.array(_say("total: ", total, " lines across ", F.size(a), " files"), F.lit(""), F.lit("by extension:")), F.transform(F.array_sort(kinds), kind), F.array(F.lit(""), F.lit("top files:")), F.transform(F.slice(F.array_sort(a), 1, 5), line))
            few = F.concat(F.array(_say("total: ", total, " lines")), F.transform(a, line))
            return F.when(F.size(a) == 1, _say(a[0]["path"], ": ", -a[0]["n"], " lines")).when(F.size(a) > 10, _end(T.joined(many))).otherwise(_end(T.joined(few)))

        return _or_raw(raw, rows, shown)

    return T.let(T.lines(raw), of)


def tar(raw: Column) -> Column:
    """Numbers and bytes, then entries, or of more than fifty their extensions and the five largest."""
    rows = F.transform(_numbered(T.lines(raw), TAR_ROW, "mode", "size", "name"), lambda r: F.struct((-r["size"].try_cast("long")).alias("size"), r["pos"].alias("pos"), r["name"].alias("name"), F.startswith(r["mode"], F.lit("d")).alias("folder")))

    def of(a: Column) -> Column:
        files = F.filter(a, lambda r: ~r["folder"])
        size = lambda r: T.format_size(-r["size"])
        head = lambda f: F.array(_say("archive: ", F.size(f), " files, ", F.size(a) - F.size(f), " dirs, ", T.format_size(_total(f, lambda r: -r["size"]))), F.lit(""))
        kinds = lambda f: F.array_sort(F.transform(T.grouped(F.transform(f, lambda r: F.struct(_extension(r["name"]).alias("key"), r["pos"].alias("pos"), r["size"].alias("size")))), lambda g: F.struct((-F.size(g["rows"])).alias("n"), g["key"].alias("key"), _total(g["rows"], lambda r: r["size"]).alias("size"))))
        many = lambda f: F.concat(head(f), F.array(F.lit("by extension:")), F.transform(kinds(f), lambda k: _say("  .", T.left(k["key"], 12), " ", T.right((-k["n"]).cast("string"), 5), " files  ", size(k))), F.array(F.lit(""), F.lit("top files:")), F.transform(F.slice(F.array_sort(f), 1, 5), lambda r: _say("  ", T.right(size(r), 10), "  ", r["name"])))
        few = lambda f: F.concat(head(f), F.array(F.lit("entries:")), F.transform(a, lambda r: F.when(r["folder"], _say("  ", F.regexp_replace(r["name"], "/+$", ""), "/")).otherwise(_say("  ", r["name"], " (", size(r), ")"))))
        return T.let(files, lambda f: _end(T.joined(F.when(F.size(a) > 50, many(f)).otherwise(few(f)))))

    return _or_raw(raw, F.filter(rows, lambda r: r["size"].isNotNull()), of)


def smart(raw: Column) -> Column:
    """Of more than thirty lines of code the numbers of lines, ten imports, and definitions with their places."""

    def of(array: Column) -> Column:
        kind = lambda x: F.when(x.rlike(r"^\s*$"), "blank").when(x.rlike(CODE_COMMENT), "comment").when(x.rlike(CODE_DEFINITION), "definition").when(x.rlike(CODE_IMPORT), "import").otherwise("code")
        rows = F.transform(array, lambda x, i: F.struct(kind(x).alias("kind"), i.alias("pos"), T.trimmed(x).alias("line")))

        def shown(a: Column) -> Column:
            of_kind = lambda k: F.filter(a, lambda r: r["kind"] == k)
            blanks, comments = F.size(of_kind("blank")), F.size(of_kind("comment"))
            section = lambda name, f, line, most: T.let(f, lambda x: F.when(F.size(x) > 0, F.concat(F.array(F.lit(""), _say(name, " (", F.size(x), "):")), F.transform(F.slice(x, 1, most), line), _more(F.size(x), most))).otherwise(_no_lines()))
            head = F.array(_say(F.size(a), " lines (", F.size(a) - blanks - comments, " code, ", blanks, " blank, ", comments, " comments)"))
            imports = section("Imports", of_kind("import"), lambda r: _say("  ", r["line"]), 10)
            return T.joined(F.concat(head, imports, section("Definitions", of_kind("definition"), lambda r: _say("  L", r["pos"] + 1, ": ", r["line"]), 2**31 - 1)))

        return F.when(T.blank(raw), F.lit("")).when(F.size(array) <= 30, raw).otherwise(T.let(rows, shown))

    return T.let(T.lines(raw), of)


# Network and system


def dig(raw: Column) -> Column:
    """Rows of the answer section, else all that aren't comments."""
    row = lambda x: ~x.rlike(r"^\s*;")
    answers = _flat(T.blocks(raw, ";; ANSWER SECTION:", r"[ \t]*$|;;[ \t]+\w"), lambda b: F.filter(T.lines(b), lambda x, i: (i > 0) & row(x)))
    return T.let(answers, lambda a: F.when(F.size(a) > 0, T.joined(a)).otherwise(_or_raw(raw, F.filter(_full(raw), row), T.joined)))


def lsof(raw: Column, above: int = 100, n: int = 20) -> Column:
    """Rows without device, size and node, or of more than ``above`` the commands with most of them."""
    names = ("cmd", "pid", "user", "fd", "kind", "name")
    rows = _numbered(F.filter(T.lines(raw), lambda x: ~x.rlike(r"^COMMAND\s+PID\s+USER")), LSOF_ROW, *names)

    def of(a: Column) -> Column:
        groups = F.array_sort(F.transform(T.grouped(F.transform(a, lambda r: F.struct(r["cmd"].alias("key"), r["pos"].alias("pos")))), lambda g: F.struct((-F.size(g["rows"])).alias("n"), g["key"].alias("key"))))
        many = lambda g: F.concat(F.array(_say("(", F.size(a), " rows across ", F.size(g), " processes; showing top by fd count)")), F.transform(F.slice(g, 1, n), lambda k: _say("  ", T.left(k["key"], 16), " ", -k["n"], " fds")))
        few = F.transform(a, lambda r: F.concat_ws(" ", *[r[c] if c != "name" else T.trimmed(r[c]) for c in names]))
        return _end(T.joined(F.concat(F.array(F.lit("COMMAND PID USER FD TYPE NAME")), F.when(F.size(a) > above, T.let(groups, many)).otherwise(few))))

    return _or_raw(raw, rows, of)


def netstat(raw: Column, peers: int = 10) -> Column:
    """Listening sockets, then other states, frequent ones first, with up to ten peers."""
    inet = lambda x, i: F.struct(F.coalesce(F.nullif(_part(x, INET_ROW, 4), F.lit("")), F.lit("(no-state)")).alias("key"), i.alias("pos"), _part(x, INET_ROW).alias("proto"), _part(x, INET_ROW, 2).alias("local"), _part(x, INET_ROW, 3).alias("peer"))
    ss = lambda x, i: F.struct(_part(x, SS_ROW).alias("key"), i.alias("pos"), F.lit("tcp").alias("proto"), _part(x, SS_ROW, 2).alias("local"), _part(x, SS_ROW, 3).alias("peer"))
    rows = F.filter(F.transform(T.lines(raw), lambda x, i: F.when(x.rlike(INET_ROW), inet(x, i)).when(x.rlike(SS_ROW), ss(x, i))), lambda r: r.isNotNull())

    def of(groups: Column) -> Column:
        listens = _flat(F.filter(groups, lambda g: g["key"] == "LISTEN"), lambda g: F.concat(F.array(_say("LISTEN (", F.size(g["rows"]), "):")), F.transform(g["rows"], lambda r: _say("  ", r["proto"], " ", r["local"]))))
        others = F.array_sort(F.transform(F.filter(groups, lambda g: g["key"] != "LISTEN"), lambda g: F.struct((-F.size(g["rows"])).alias("n"), g["key"].alias("key"), g["rows"].alias("rows"))))
        block = lambda g: F.concat(F.array(F.lit(""), _say(g["key"], " (", -g["n"], "):")), F.transform(F.slice(g["rows"], 1, peers), lambda r: _say("  ", r["proto"], " -> ", r["peer"])), _more(-g["n"], peers))
        # The text that no listening socket comes before starts with a line feed, as the original's does.
        return _end(T.joined(F.concat(listens, _flat(others, block))))

    return _or_raw(raw, T.grouped(rows), of)


def env(wanted: str | None = None) -> Filter:
    """Variables by name, secrets redacted; without a wanted pattern tooling variables are only counted."""

    def of(raw: Column) -> Column:
        rows = _numbered(F.transform(T.lines(raw), T.trimmed), ENV_ROW, "key", "value")
        noisy = lambda r: r["key"].rlike(ENV_NOISE)
        kept = F.filter(rows, lambda r: ~noisy(r) if wanted is None else r["key"].rlike(f"(?i){wanted}"))
        clean = lambda r: F.when(r["key"].rlike(ENV_SECRET), F.lit("[REDACTED]")).otherwise(F.regexp_replace(T.sanitize_output(_say(r["key"], "=", r["value"])), r"\A[^=]*=", ""))
        pairs = F.array_sort(F.transform(kept, lambda r: F.struct(r["key"].alias("key"), r["pos"].alias("pos"), clean(r).alias("value"))))
        left_out = F.size(F.filter(rows, noisy)) if wanted is None else F.lit(0)
        out = lambda a: _end(T.joined(F.concat(F.transform(a, lambda r: _say(r["key"], "=", r["value"])), F.when(left_out > 0, F.array(_say("# (", left_out, " internal/tooling vars omitted)"))).otherwise(_no_lines()))))
        return T.let(pairs, lambda a: F.when(T.blank(raw), F.lit("")).when(F.size(a) == 0, raw if wanted is None else F.lit("")).otherwise(out(a)))

    return of


def openssl(raw: Column) -> Column:
    """A certificate's text without keys, identifiers and signatures."""
    text = F.regexp_replace(F.split(T.joined(T.lines(raw)), r"(?dm)^[ \t]*Signature Value:", 2)[0], r"(?dm)^ {4}Signature Algorithm:.*(?:\n|\z)", "")
    text = F.regexp_replace(text, rf"(?dm)^([ \t]*)(?:{CERTIFICATE_BLOCKS}).*(?:\n(?:[ \t]*$|\1[ \t]+\S.*))*+(?:\n|\z)", "")
    out = _end(T.joined(F.filter(T.lines(text), lambda x: ~x.rlike(CERTIFICATE_LINES))))
    return T.let(out, lambda x: F.when(T.blank(raw), F.lit("")).when(T.blank(x), raw).otherwise(x))


# Containers and clusters


def _after(array: Column, header: str) -> Column:
    """Lines after the first that the header's pattern fits."""
    return T.let(array, lambda a: T.let(F.array_position(F.transform(a, lambda x: x.rlike(header)), True), lambda at: F.when(at > 0, F.slice(a, at + 1, F.size(a))).otherwise(_no_lines())))


def docker_ps(raw: Column) -> Column:
    """``id image status name`` of containers."""
    rows = F.filter(F.transform(F.filter(_after(T.lines(raw), PS_HEADER), lambda x: ~x.rlike(PS_HEADER)), lambda x: F.split(x, r"\s{2,}")), lambda c: F.size(c) >= 7)
    return _or_raw(raw, F.transform(rows, lambda c: F.concat_ws(" ", F.left(c[0], F.lit(12)), T.short_image(c[1]), T.short_status(c[4]), T.trimmed(c[6]))), lambda a: _end(T.joined(a)))


def _ends(raw: Column, middle: Callable[[Column, Column], Column], ends: int = 20, trim: bool = False) -> Column:
    """First and last lines around what ``middle`` makes of all lines and the number of the first of the last."""

    def of(a: Column) -> Column:
        n = F.size(a)
        out = T.joined(F.concat(F.slice(a, 1, ends), middle(a, n - ends), F.slice(a, F.greatest(n - ends + 1, F.lit(1)), F.lit(ends))))
        return F.when(T.blank(raw), F.lit("")).when(n <= 2 * ends, raw).otherwise(_end(out) if trim else out)

    return T.let(T.lines(raw), of)


def docker_logs(raw: Column, ends: int = 20) -> Column:
    """First and last lines and important ones between, with marks of how many lie before each."""

    def middle(a: Column, stop: Column) -> Column:
        important = F.filter(F.transform(a, lambda x, i: F.when((i >= ends) & (i < stop) & x.rlike(LOG_IMPORTANT), i)), lambda i: i.isNotNull())
        mark = lambda gap: F.when(gap > 0, F.array(_say("... (", gap, " lines omitted)"))).otherwise(_no_lines())
        before = lambda p, k: F.when(k == 0, F.lit(ends - 1)).otherwise(F.get(p, k - 1))
        rows = lambda p: F.concat(F.flatten(F.transform(p, lambda i, k: F.concat(mark(i - before(p, k) - 1), F.array(F.get(a, i))))), mark(stop - 1 - F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(ends - 1))))
        return T.let(important, rows)

    return _ends(raw, middle, ends)


def kubectl_logs(raw: Column, ends: int = 20) -> Column:
    """First and last lines around one mark and the errors and warnings between."""

    def middle(a: Column, stop: Column) -> Column:
        errors = F.filter(F.slice(a, F.lit(ends + 1), F.greatest(stop - ends, F.lit(0))), lambda x: x.rlike(LOG_ERROR))
        n = stop - ends
        mark = lambda e: F.when(F.size(e) > 0, _say("[... ", n - F.size(e), " lines omitted, ", F.size(e), " errors/warnings kept ...]")).otherwise(_say("[... ", n, " lines omitted ...]"))
        return T.let(errors, lambda e: F.concat(F.array(mark(e)), e))

    return _ends(raw, middle, ends, trim=True)


def kubectl_pods(raw: Column) -> Column:
    """Pods with single blanks between cells, without restarts if none has any."""
    rows = F.filter(F.transform(F.filter(_after(T.lines(raw), PODS_HEADER), lambda x: ~x.rlike(PODS_HEADER)), lambda x: F.split(T.trimmed(x), " {2,}")), lambda c: F.size(c) >= 5)

    def of(a: Column) -> Column:
        calm = F.forall(a, lambda c: c[3] == "0")
        few = F.concat(F.array(F.lit("NAME READY STATUS AGE")), F.transform(a, lambda c: F.concat_ws(" ", c[0], c[1], c[2], c[4])))
        return _end(T.joined(F.when(calm, few).otherwise(F.concat(F.array(F.lit("NAME READY STATUS RESTARTS AGE")), F.transform(a, lambda c: F.concat_ws(" ", F.slice(c, 1, 5)))))))

    return _or_raw(raw, rows, of)


def kubectl_describe(raw: Column) -> Column:
    """Main fields, conditions, events, and states and resources of containers."""
    single = lambda x: F.regexp_replace(x, " {2,}", " ")
    field = r"^[^ \t].*:"

    def section(lines: Column) -> Column:
        head = T.trimmed(lines[0])
        other = F.array_position(F.transform(lines, lambda x, i: (i > 0) & x.rlike(field)), True)
        inside = lambda i: (other == 0) | (i < other - 1)
        contained = head.contains("Containers") | (head == ":")

        def shown(x: Column, i: Column) -> Column:
            t = T.trimmed(x)
            name = F.endswith(t, F.lit(":")) & ~t.contains(" ") & x.rlike("^(?: {2,3}(?! )|\t)")
            state = F.when(t.rlike(DESCRIBED_STATE), _say("  ", single(t))).when(name, _say("  ", t))
            return (
                F.when(i == 0, F.when(head.rlike(DESCRIBED_KEPT), head))
                .when(x.rlike(field), F.when(t.rlike(DESCRIBED_KEYS), single(t)))
                .when(inside(i) & head.rlike(DESCRIBED_KEPT), x)
                .when(inside(i) & head.rlike(DESCRIBED_SKIPPED), F.lit(None))
                .when(contained, state)
            )

        return F.filter(F.transform(lines, shown), lambda x: x.isNotNull())

    # A heading of its own stands for the part before the first one.
    found = T.blocks(_say(":\n", raw), r"(?:[^ \t\n].*)?:[ \t]*$")
    return _or_raw(raw, _flat(found, lambda b: T.let(T.block_lines(b), section)), lambda a: T.let(_end(T.joined(a)), lambda x: F.when(x == "", raw).otherwise(x)))


def terraform_plan(raw: Column) -> Column:
    """Resources with their attributes, without tags, refreshes and what is known after apply, and the plan's line."""

    def resource(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("tags"), F.lit(False).alias("closed"), _no_lines().alias("kept"))

        def step(acc: Column, x: Column) -> Column:
            depth = acc["depth"] + F.regexp_count(x, F.lit(r"\{")) - F.regexp_count(x, F.lit(r"\}"))
            now = lambda d, tags, closed, kept: F.struct(d.alias("depth"), tags.alias("tags"), closed.alias("closed"), (F.concat(acc["kept"], F.array(x)) if kept else acc["kept"]).alias("kept"))
            no, yes = F.lit(False), F.lit(True)
            return (
                F.when(x.rlike("^Plan:") | x.rlike(f"^{PLAN_RESOURCE}"), now(acc["depth"], acc["tags"], acc["closed"], True))
                .when(x.rlike(PLAN_REFRESH), acc)
                .when(x.rlike(f"^{PLAN_OPEN}"), now(F.lit(1), acc["tags"], acc["closed"], True))
                .when(acc["closed"], acc)
                .when(x.rlike(PLAN_TAGS), now(depth, yes, no, False))
                .when(acc["tags"], now(depth, depth > 1, no, False))
                .when(x.rlike(PLAN_CLOSE), now(depth, no, depth <= 0, False))
                .when(x.rlike(r"\(known after apply\)"), now(depth, no, no, False))
                .when(T.blank(x), acc)
                .otherwise(now(depth, no, no, True))
            )

        return F.aggregate(T.lines(block), start, step, lambda acc: acc["kept"])

    found = T.blocks(raw, PLAN_RESOURCE, None, rf"Plan:.*|{PLAN_OPEN}.*")
    return _or_raw(raw, _flat(found, lambda b: F.when(b.rlike(rf"\A{PLAN_RESOURCE}"), resource(b)).otherwise(F.array(b))), T.joined)


def aws(raw: Column) -> Column:
    """A table of described instances."""
    schema = "Reservations array<struct<Instances:array<struct<InstanceId:string,InstanceType:string,State:struct<Name:string>,PublicIpAddress:string,Tags:array<struct<Key:string,Value:string>>>>>>"
    found = F.flatten(F.filter(F.transform(F.from_json(raw, schema)["Reservations"], lambda r: r["Instances"]), lambda x: x.isNotNull()))
    line = lambda i: _say(T.left(T.field_or_dash(i["InstanceId"]), 20), " ", T.left(T.field_or_dash(i["InstanceType"]), 10), " ", T.left(T.field_or_dash(i["State"]["Name"]), 8), " ", T.left(T.field_or_dash(i["PublicIpAddress"]), 14), " ", F.coalesce(T.name_tag(i["Tags"]), F.lit("-")))
    head = "INSTANCE_ID          TYPE       STATE    PUBLIC_IP      NAME"
    rows = F.filter(found, lambda i: i.isNotNull())
    return _or_raw(raw, F.coalesce(F.transform(rows, line), _no_lines()), lambda a: _end(T.joined(F.concat(F.array(F.lit(head)), a))))
