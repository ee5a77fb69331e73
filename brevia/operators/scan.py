"""Which commands of a session could be compressed, and how a command line is rewritten to be."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevia.functions import text as T

# --- fixed values: beginnings of commands; a blank at the end is part of them ---
COMPRESSIBLE = (
    "git ", "gh ", "jj ", "yadm ", "cargo ",
    "npm ", "pnpm ", "bun ", "yarn ", "deno ", "vitest", "jest", "tsc", "tsgo", "eslint", "oxlint", "biome", "turbo ", "nx ",
    "pytest", "ruff ", "mypy ", "pip ", "pip3 ", "uv ", "poetry ", "basedpyright", "ty ",
    "go ", "golangci-lint", "rspec", "bundle ", "rake", "dotnet ", "gradle", "gradlew", "./gradlew", "mvn ", "mix ", "swift build", "xcodebuild",
    "ls", "find ", "grep ", "rg ", "diff ", "cat ", "head ", "tail ", "wc ", "env", "du ", "df ", "ps ", "stat ", "ping ",
    "touch ", "mkdir ", "cp ", "mv ", "rm ", "chmod ", "chown ", "ln ", "ssh ", "rsync ",
    "docker ", "podman ", "kubectl ", "k ", "terraform ", "tf ", "tofu ", "helm ", "aws ", "gcloud ", "az ", "skopeo ",
    "make ", "gmake ", "cmake ", "bazel ", "just ", "task ", "brew ", "apt ", "apt-get ", "dnf ", "composer ", "pio ",
    "shellcheck", "hadolint", "markdownlint", "yamllint", "pre-commit", "mise ",
    "ansible-playbook", "jira ", "jq ", "ollama ", "quarto ", "sops ", "shopify ", "systemctl ", "fail2ban-client", "iptables", "spring-boot",
)
CATEGORIES = {
    "git": ("git ", "gh ", "jj ", "yadm "),
    "rust": ("cargo ",),
    "js": ("npm ", "pnpm ", "yarn ", "bun ", "deno ", "vitest", "jest", "tsc", "tsgo", "eslint", "oxlint", "biome", "turbo ", "nx "),
    "python": ("pytest", "ruff", "mypy", "pip ", "pip3 ", "uv ", "poetry ", "basedpyright", "ty "),
    "go": ("go ", "golangci-lint"),
    "ruby": ("rspec", "bundle ", "rake"),
    "dotnet": ("dotnet ",),
    "java": ("gradle", "gradlew", "./gradlew", "mvn "),
    "elixir": ("mix ",),
    "swift": ("swift build", "xcodebuild"),
    "cloud": ("docker ", "podman ", "kubectl ", "k ", "terraform ", "tf ", "tofu ", "helm ", "aws ", "gcloud ", "az ", "skopeo ", "ansible-playbook"),
    "system": (
        "ls", "find ", "grep ", "rg ", "diff ", "cat ", "head ", "tail ", "du ", "df", "wc ", "env", "ps ", "stat ", "ping ", "touch ", "mkdir ",
        "cp ", "mv ", "rm ", "chmod ", "chown ", "ln ", "ssh ", "rsync ", "systemctl ", "iptables", "fail2ban-client",
    ),
    "pkg": ("brew ", "apt ", "apt-get ", "dnf ", "composer "),
    "build": ("make ", "gmake ", "cmake ", "bazel ", "just ", "task "),
    "lint": ("shellcheck", "hadolint", "markdownlint", "yamllint"),
    "cicd": ("pre-commit",),
    "db": ("psql", "redis-cli", "mysql", "sqlite3", "mongo"),
}
RENAMED = {"cat": "read", "head": "read", "tail": "read", "tree": "ls --tree", "rg": "grep"}
# --- end of fixed values ---

#: What the rewriter puts before a command.
PREFIX = "brevia"


def _anchored(prefixes: tuple[str, ...]) -> str:
    return "^(?:" + "|".join(re.escape(p).replace(r"\ ", " ") for p in prefixes) + ")"


def is_compressible(command: Column, trimmed: bool = False) -> Column:
    """Whether a command has a beginning that can be compressed; one that is ``trimmed`` already isn't trimmed again."""
    c = command if trimmed else T.trimmed(command)
    return c.rlike(_anchored(COMPRESSIBLE)) | c.isin(*[p.strip() for p in COMPRESSIBLE])


def classify(command: Column, trimmed: bool = False) -> Column:
    """The first category with a beginning of the command, else null.

    Where the command is an expression, it's copied into every test; give a plain column that is ``trimmed`` already.
    """
    c = command if trimmed else T.trimmed(command)
    out = F.lit(None).cast("string")
    for name, prefixes in reversed(CATEGORIES.items()):
        out = F.when(c.rlike(_anchored(prefixes)), F.lit(name)).otherwise(out)
    return out


def base_command(command: Column) -> Column:
    return T.trimmed(F.split(command, r"\|", 2)[0])


def opportunities(commands: DataFrame, command: str = "command") -> DataFrame:
    """(command, category, count) of compressible commands not proxied yet, most frequent first."""
    d = commands.filter(~F.startswith(F.col(command), F.lit(PREFIX + " ")))
    d = T.once(d.select(F.col(command).alias("__c")), command=base_command(F.col("__c")))
    d = d.filter(is_compressible(F.col("command"), trimmed=True)).groupBy("command").agg(F.count("*").alias("count"))
    return T.once(d, category=classify(F.col("command"), trimmed=True)).filter("category is not null").select("command", "category", "count").orderBy(F.desc("count"), "command")


def report(found: DataFrame, n: int = 20) -> tuple[DataFrame, DataFrame]:
    return found.limit(n), found.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.count("*").alias("different"))


#: Pieces of a command line: a quoted string, an escaped character, an operator, what can't be split, a quote that isn't closed, and all else.
_PIECE = r"""(?s)"(?:[^"\\]++|\\.)*+"|'[^']*+'|\\.|&&|\|\||;|\||`|\$\(|["']|[^"'\\&|;`$]++|[&$\\]"""
#: A word of a command line, with its quotes.
_WORD = r"""(?s)(?:[^\s"'\\]++|"(?:[^"\\]++|\\.)*+"|'[^']*+'|\\.)++"""
_OPERATORS = ("&&", "||", ";")
_UNSPLIT = ("|", "`", "$(", '"', "'")
_STANDALONE = ("&&", "||", ";", "|", ">", "<", "&")


def _renamed(word: Column) -> Column:
    name = F.lit(None).cast("string")
    for old, new in RENAMED.items():
        name = F.when(word == old, F.lit(new)).otherwise(name)
    return name


def rewrite_segment(segment: Column) -> Column:
    """One simple command with the prefix, under its other name if it has one; builtins, assignments, here-documents and prefixed ones stay."""
    s = F.regexp_replace(segment, r"^\s+", "")
    first, rest = F.regexp_extract(s, r"^(\S*)", 1), F.regexp_extract(s, r"(?s)^\S*\s*(.*)\z", 1)
    name = _renamed(first)
    keep = T.is_builtin(first) | T.is_assignment(first) | segment.contains("<<") | (first == PREFIX) | (s == "")
    other = F.when(name.isNull(), s).when(rest == "", name).otherwise(F.concat(name, F.lit(" "), rest))
    return F.when(keep, segment).otherwise(F.concat(F.lit(PREFIX + " "), other))


def shell_words(command: Column) -> Column:
    """A command line's words without their quotes and escapes; what follows a quote that isn't closed is cut at blanks."""

    def plain(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(2), F.length(piece) - 2)
        return F.when(F.startswith(piece, F.lit('"')), F.regexp_replace(inner, r'\\(["\\$`])', "$1")).when(F.startswith(piece, F.lit("'")), inner).when(F.startswith(piece, F.lit("\\")), F.substr(piece, F.lit(2))).otherwise(piece)

    pieces = lambda w: F.regexp_extract_all(w, F.lit(r"""(?s)"(?:[^"\\]++|\\.)*+"|'[^']*+'|\\.|[^"'\\]++"""), F.lit(0))
    return F.transform(F.regexp_extract_all(command, F.lit(_WORD), F.lit(0)), lambda w: F.array_join(F.transform(pieces(w), plain), ""))


def compound_parts(command: Column) -> Column:
    """(segment, op after it) at ``&&``, ``||`` and ``;`` outside quotes; null if the line is to be left alone.

    That is the case with a pipe, a here-document, a substitution outside quotes, an open quote or an empty segment. A line
    without operators is one segment, as it is. One pattern cuts the line into pieces, so the work grows with its length.
    """
    is_op = lambda x: x.isin(*_OPERATORS)

    def parts(pieces: Column) -> Column:
        at = F.filter(F.transform(pieces, lambda x, i: F.when(is_op(x), i + 1)), lambda i: i.isNotNull())

        def cut(ends: Column) -> Column:
            piece = lambda e, k: F.struct(
                F.trim(F.array_join(F.slice(pieces, F.coalesce(F.get(ends, k - 1), F.lit(0)) + 1, e - F.coalesce(F.get(ends, k - 1), F.lit(0)) - 1), "")).alias("segment"),
                F.coalesce(F.get(pieces, e - 1), F.lit("")).alias("op"),
            )
            return F.transform(ends, piece)

        split = T.let(F.concat(at, F.array(F.size(pieces) + 1)), cut)
        return F.when(F.exists(pieces, lambda x: x.isin(*_UNSPLIT)), None).when(F.size(at) == 0, F.array(F.struct(command.alias("segment"), F.lit("").alias("op")))).otherwise(T.let(split, lambda p: F.when(F.exists(p, lambda x: x["segment"] == ""), None).otherwise(p)))

    return F.when(command.contains("<<"), None).otherwise(T.let(F.regexp_extract_all(command, F.lit(_PIECE), F.lit(0)), parts))


def rewritten(parts: Column, command: Column, prefix: Column | None = None) -> Column:
    """The command line from its parts, each rewritten, and with ``prefix`` before those that change; the line itself if it has none."""

    def piece(p: Column) -> Column:
        gap = F.when(p["op"] == "", F.lit("")).when(p["op"] == ";", F.lit("; ")).otherwise(F.concat(F.lit(" "), p["op"], F.lit(" ")))
        before = lambda x: F.lit("") if prefix is None else F.when(x == p["segment"], F.lit("")).otherwise(prefix)
        return T.let(rewrite_segment(p["segment"]), lambda x: F.concat(before(x), x, gap))

    return F.when(parts.isNull() | T.blank(command), command).otherwise(F.array_join(F.transform(parts, piece), ""))


def rewrite(commands: DataFrame, command: str = "command", out: str = "rewritten", tool: str | None = None, session: str | None = None) -> DataFrame:
    """Add ``out``: the command line with each of its commands rewritten; with columns of a tool and a session, these are named before each."""
    prefix = None if tool is None else environment_prefix(F.col(tool), F.col(session) if session else F.lit(None).cast("string"))
    d = T.once(commands, __parts=compound_parts(F.col(command)))
    return d.withColumn(out, rewritten(F.col("__parts"), F.col(command), prefix)).drop("__parts")


def rewrite_argv(args: Column) -> Column:
    """A list of arguments as a command line with the prefix, under the first one's other name if it has one.

    Lists that hold a standalone operator or a here-document, that are prefixed already, or whose first word is a builtin, an assignment or a
    command that needs a terminal, are joined as they are; an empty list gives an empty text.
    """
    whole, first = F.array_join(args, " "), F.coalesce(F.get(args, F.lit(0)), F.lit(""))
    rest = F.array_join(F.slice(args, F.lit(2), F.greatest(F.size(args) - 1, F.lit(0))), " ")
    keep = (F.size(args) == 0) | (first == PREFIX) | F.exists(args, lambda a: a.contains("<<") | a.isin(*_STANDALONE)) | T.is_builtin(first) | T.is_assignment(first) | T.needs_terminal(first)
    name = _renamed(first)
    return F.when(keep, whole).when(name.isNull(), F.concat(F.lit(PREFIX + " "), whole)).when(rest == "", F.concat(F.lit(PREFIX + " "), name)).otherwise(F.concat(F.lit(PREFIX + " "), name, F.lit(" "), rest))


def environment_prefix(tool: Column, session: Column) -> Column:
    """Variables that name tool and session, each only if it is harmless in a shell, and none without a tool."""
    known = F.coalesce(tool.rlike(r"^[a-z_]+\z"), F.lit(False))
    named = F.when(session.rlike(r"^[A-Za-z0-9_\-]+\z"), F.concat(F.lit("BREVIA_SESSION="), session, F.lit(" "))).otherwise(F.lit(""))
    return F.when(known, F.concat(F.lit("BREVIA_TOOL="), tool, F.lit(" "), named)).otherwise(F.lit(""))


def verify_files(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, verdict) of expected (path, sha256) against files (path, content): ok, tampered or missing."""
    d = expected.join(files.select(F.col("path").alias("__p"), F.sha2("content", 256).alias("__h")), F.col("path") == F.col("__p"), "left")
    return d.select("path", F.when(F.col("__h").isNull(), "missing").when(F.col("__h") == F.col("sha256"), "ok").otherwise("tampered").alias("verdict"))
