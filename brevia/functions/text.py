"""Text functions, Column in and Column out, in built-in expressions only.

Lengths are in characters where the text could otherwise be cut within one. Regular expressions start with ``(?dU)``,
so that classes are Unicode's and only a line feed ends a line.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U = "(?dU)"

# --- fixed values: patterns and names that results depend on ---
ANSI = "\x1b\\[[0-9;]*[a-zA-Z]"
BARS = "[█▓▒░╱╲│─━═]{2,}"
USER_PATH = r"(/Users/|/home/)[a-zA-Z0-9_.\-]+"
BUILTINS = ("cd", "pushd", "popd", "export", "set", "unset", "source", ".", "alias", "unalias", "eval", "exec")
INTERACTIVE = tuple(
    "vim nvim vi nano emacs kak helix hx less more man info top htop btop atop iotop mc ranger nnn lf mutt neomutt pine alpine "
    "ssh telnet screen tmux zellij byobu fzf dialog whiptail gum watch irb pry ipython ghci ocaml".split()
)
PRIVILEGED = ("sudo", "doas", "pkexec", "su", "runuser")
BEARER = r"Bearer\s+[A-Za-z0-9\-._~+/]+=*"
ASSIGNED = r"(?i)(api[_\-]?key|token|secret|password|credential|auth)\s*[:=]\s*\S+"
GITHUB_TOKEN = r"ghp_[A-Za-z0-9]{36}"
ACCESS_KEY = r"AKIA[0-9A-Z]{16}"
API_KEY = r"sk-[A-Za-z0-9]{48}"
PRIVATE_KEY = r"(?i)-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----"
NODE_FOOTER = r"^\(node:\d+\)\s+\[(?:DEP|EXP)\d+\]|^\(Use `node --trace-"
DONE_LINE = r"^(?:Done in \d+(?:\.\d+)?\s*(?:ms|s|m|h)|Saved lockfile|success Saved lockfile)"
POLICIES = {"unknown": (30_000, 60, 30), "claude_code": (200_000, 300, 150), "codex": (150_000, 250, 120), "gemini": (100_000, 200, 100)}
# --- end of fixed values ---

#: Bearer tokens go first: the assignment rule would take ``auth: Bearer`` and leave the token.
SECRETS = (BEARER, ASSIGNED, GITHUB_TOKEN, ACCESS_KEY, API_KEY, PRIVATE_KEY)


def once(d: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions use many times over, each evaluated once.

    A generator of one row keeps the optimiser from copying an expression into every one that uses it.
    """
    return d.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value, which is evaluated once however often ``f`` uses it, within lambdas too."""
    return F.transform(F.array(value), lambda x: f(x))[0]


def lines(text: Column) -> Column:
    """Lines without their ends (LF or CRLF); a last end makes no further line, and an empty text has none.

    Texts without CRLF, nearly all, are cut at a plain character, which takes a quarter of the time that the pattern takes.
    """

    def of(t: Column) -> Column:
        body = F.when(F.endswith(t, F.lit("\n")), F.left(t, F.char_length(t) - 1)).otherwise(t)
        with_returns = F.split(F.regexp_replace(t, r"\r?\n\z", ""), r"\r?\n", -1)
        return F.when(t == "", F.array().cast("array<string>")).when(t.contains("\r\n"), with_returns).otherwise(F.split(body, "\n", -1))

    return let(text, of)


def joined(array: Column) -> Column:
    return F.array_join(array, "\n")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def count_tokens(text: Column) -> Column:
    """Words between white space, as a long."""
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("long")


def strip_ansi(text: Column) -> Column:
    """Texts without an escape character aren't searched."""
    return let(text, lambda t: F.when(t.contains("\x1b"), F.regexp_replace(t, ANSI, "")).otherwise(t))


def strip_progress_noise(text: Column) -> Column:
    """What follows a line's last carriage return, without runs of bar characters."""
    latest = joined(F.transform(lines(text), lambda x: F.regexp_replace(x, r"(?s)^.*\r", "")))
    return F.regexp_replace(F.when(text.contains("\r"), latest).otherwise(text), BARS, "")


def truncate_line(line: Column, most: int) -> Column:
    return F.when(F.char_length(line) > most, F.concat(F.left(line, F.lit(max(most - 3, 0))), F.lit("..."))).otherwise(line)


def truncate_words(text: Column, most: int) -> Column:
    """Trimmed; a longer text gives most - 1 characters, trimmed at the right, and an ellipsis."""
    t = trimmed(text)
    return F.when(F.char_length(t) > most, F.concat(F.regexp_replace(F.left(t, F.lit(most - 1)), r"(?U)\s+\z", ""), F.lit("…"))).otherwise(t)


def head_tail(array: Column, head: int | Column, tail: int | Column) -> Column:
    """First and last elements around a line that tells how many were left out."""
    head, tail = (x if isinstance(x, Column) else F.lit(x) for x in (head, tail))
    n = F.size(array)
    gap = F.concat(F.lit("... ("), (n - head - tail).cast("string"), F.lit(" lines omitted) ..."))
    last = F.when(tail > 0, F.slice(array, n - tail + 1, tail)).otherwise(F.array().cast("array<string>"))
    return F.when(n > head + tail, F.concat(F.slice(array, F.lit(1), head), F.array(gap), last)).otherwise(array)


def window(array: Column, head: int | None, tail: int | None) -> Column:
    """First and last elements without a mark; with one of the numbers only the other end goes."""
    n = F.size(array)
    first = F.slice(array, F.lit(1), F.lit(head or 0))
    last = F.slice(array, F.greatest(n - F.lit(tail or 0) + 1, F.lit(1)), F.lit(tail or 0))
    if head is not None and tail is not None:
        return F.when(n > head + tail, F.concat(first, last)).otherwise(array)
    if head is not None:
        return first
    return array if tail is None else last


def windowed(array: Column, head: Column, tail: Column) -> Column:
    """``window`` with numbers from columns; a null is no number."""
    n = F.size(array)
    first = F.slice(array, F.lit(1), head)
    last = F.slice(array, F.greatest(n - tail + 1, F.lit(1)), tail)
    both = F.when(n > head + tail, F.concat(first, last)).otherwise(array)
    return F.when(head.isNotNull() & tail.isNotNull(), both).when(head.isNotNull(), first).when(tail.isNotNull(), last).otherwise(array)


def _budgeted(tokens: Column, budget: Column) -> Column:
    """How many leading numbers fit in a budget, stopping at the first that doesn't."""
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["open"] & (acc["sum"] + x <= budget)
        return F.struct(F.when(fits, acc["sum"] + x).otherwise(acc["sum"]).alias("sum"), F.when(fits, acc["n"] + 1).otherwise(acc["n"]).alias("n"), fits.alias("open"))

    return F.aggregate(tokens, zero, step, lambda acc: acc["n"])


def head_tail_by_tokens(array: Column, most: int | Column, ratio: float = 0.6) -> Column:
    """Whole lines up to a token budget, of which ``ratio`` is for the head; unchanged if all fits or nothing does."""
    most = most if isinstance(most, Column) else F.lit(most)
    head_budget = F.floor(most * ratio + 0.5)
    tokens = F.transform(array, count_tokens)
    total = F.aggregate(tokens, F.lit(0).cast("long"), lambda a, x: a + x)
    n, h, t = F.size(array), _budgeted(tokens, head_budget), _budgeted(F.reverse(tokens), most - head_budget)
    gap = F.concat(F.lit("... ("), (n - h - t).cast("string"), F.lit(" lines omitted) ..."))
    cut = F.concat(F.slice(array, F.lit(1), h), F.array(gap), F.slice(array, n - t + 1, t))
    return F.when((total <= most) | (h + t >= n) | ((h == 0) & (t == 0)), array).otherwise(cut)


def drop_lines(array: Column, *patterns: str) -> Column:
    """Lines in which none of the patterns is found, tested as one alternation."""
    if not patterns:
        return array
    alternation = U + "|".join(f"(?:{p})" for p in patterns)
    return F.filter(array, lambda x: ~x.rlike(alternation))


def blocks(text: Column, head: str, stop: str | None = None, others: str = "") -> Column:
    """Blocks of lines: one that starts like ``head`` with those up to the next that starts like ``stop`` (or ``head``), or a line ``others`` alone.

    The patterns see the whole text, so their white space must not match a line feed. The repetition is possessive: long
    blocks take neither stack nor backtracking.
    """
    alone = rf"|^(?:{others})" if others else ""
    return F.regexp_extract_all(joined(lines(text)), F.lit(rf"(?dm)^(?:{head}).*(?:\n(?!{stop or head}).*)*+{alone}"), F.lit(0))


def block_lines(block: Column) -> Column:
    """Lines of a block, an empty last one too."""
    return F.split(block, "\n", -1)


def grouped(rows: Column) -> Column:
    """Structs with a field ``key`` first, as (key, rows): sorted by all their fields, then cut where the key changes."""

    def cut(a: Column) -> Column:
        starts = F.filter(F.transform(a, lambda _, i: i + 1), lambda i: (i == 1) | (F.get(a, i - 1)["key"] != F.get(a, i - 2)["key"]))
        group = lambda s: lambda x, i: F.struct(F.get(a, x - 1)["key"].alias("key"), F.slice(a, x, F.coalesce(F.get(s, i + 1), F.size(a) + 1) - x).alias("rows"))
        return let(starts, lambda s: F.transform(s, group(s)))

    return let(F.array_sort(rows), cut)


def right(text: Column, width: int) -> Column:
    """Padded on the left; longer texts stay whole."""
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit(" "))


def left(text: Column, width: int) -> Column:
    return F.rpad(text, F.greatest(F.lit(width), F.length(text)), F.lit(" "))


def keep_lines(array: Column, *patterns: str) -> Column:
    alternation = U + "|".join(f"(?:{p})" for p in patterns)
    return F.filter(array, lambda x: x.rlike(alternation))


def dedupe_repeated_lines(array: Column, threshold: int = 3) -> Column:
    """Runs of at least ``threshold`` equal neighbouring lines as one line with its count; under 2 nothing is done.

    Looks up its array often: give it a column of a frame (see ``once``) rather than an expression.
    """
    if threshold < 2:
        return array
    n = F.size(array)
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.try_element_at(array, i) != F.try_element_at(array, F.greatest(i - 1, F.lit(1)))))
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(n + 1))
    runs = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), (e - s).alias("n"), F.try_element_at(array, s).alias("line")))
    shown = F.transform(runs, lambda r: F.when(r["n"] >= threshold, F.array(F.concat(r["line"], F.lit(" (×"), r["n"].cast("string"), F.lit(")")))).otherwise(F.array_repeat(r["line"], r["n"])))
    return F.when(n == 0, array).otherwise(F.flatten(shown))


def strip_node_footer(array: Column) -> Column:
    return F.filter(array, lambda x: ~x.rlike(NODE_FOOTER))


def ultra_compact(text: Column) -> Column:
    """Without lines that only tell that something is done; ``ok`` if nothing else is left."""
    out = joined(F.filter(lines(text), lambda x: ~F.regexp_replace(x, r"(?U)^\s+", "").rlike(DONE_LINE)))
    return F.when(blank(out), F.lit("ok")).otherwise(out)


def post_pass(text: Column, ultra: bool = False) -> Column:
    out = joined(strip_node_footer(lines(text)))
    return ultra_compact(out) if ultra else out


def policy_cap(text: Column, tool: Column) -> Column:
    """The output cap of the tool's policy; tools without one have that of ``unknown``."""
    policies = F.create_map(*[x for name, p in POLICIES.items() for x in (F.lit(name), F.struct(*[F.lit(n).alias(k) for k, n in zip(("most", "head", "tail"), p, strict=True)]))])
    policy = F.coalesce(F.try_element_at(policies, tool), F.try_element_at(policies, F.lit("unknown")))
    return let(policy, lambda p: output_cap(text, p["most"], p["head"], p["tail"]))


def hard_cap(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(max(most - 16, 0))), F.lit("... (truncated)"))).otherwise(text)


def output_cap(text: Column, most: int | Column, head: int | Column, tail: int | Column) -> Column:
    """Over ``most`` characters: head and tail lines around a mark, or a plain cut if there are few lines."""
    most, head, tail = (x if isinstance(x, Column) else F.lit(x) for x in (most, head, tail))

    def cut(t: Column) -> Column:
        shorter = let(lines(t), lambda a: F.when(F.size(a) <= head + tail, F.left(t, most)).otherwise(joined(head_tail(a, head, tail))))
        return F.when(F.char_length(t) > most, shorter).otherwise(t)

    return let(text, cut)


def redact_paths(text: Column) -> Column:
    return F.regexp_replace(text, USER_PATH, "$1user")


def redact_secrets(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, "[REDACTED]"), SECRETS, text)


def sanitize_output(text: Column) -> Column:
    return redact_secrets(redact_paths(text))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def sanitize_command(command: Column) -> Column:
    """The first word, and the second unless it is a flag."""
    w = words(command)
    second = F.try_element_at(w, F.lit(2))
    return F.when(second.isNotNull() & ~F.startswith(second, F.lit("-")), F.concat_ws(" ", F.slice(w, F.lit(1), F.lit(2)))).otherwise(F.coalesce(F.try_element_at(w, F.lit(1)), F.lit("")))


def cmd_key(cmd: Column, args: Column) -> Column:
    return F.concat_ws(" ", cmd, F.try_element_at(args, F.lit(1)))


def content_hash(text: Column) -> Column:
    """Half of the SHA-256, as hex."""
    return F.left(F.sha2(text, 256), F.lit(32))


def run_id(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(10))


def format_age(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0)).cast("long")
    hours, minutes = F.floor(s / 3600).cast("string"), F.floor(s / 60).cast("string")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(minutes, F.lit("m"))).otherwise(F.concat(hours, F.lit("h")))


def format_size(size: Column) -> Column:
    """1024-based with one decimal from K on, a half going to the even digit."""
    out = F.concat(size.cast("long").cast("string"), F.lit("B"))
    for i, unit in enumerate("KMG", 1):
        out = F.when(size >= 1024**i, F.concat(F.format_string("%.1f", F.bround(size.cast("double") / float(1024**i), 1)), F.lit(unit))).otherwise(out)
    return out


def parse_size(text: Column) -> Column:
    """The number of bytes of a size such as 4.0K; 0 if it is none."""
    number = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([BKMGTPE]?)i?B?\s*$", 1)
    unit = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([BKMGTPE]?)i?B?\s*$", 2)
    power = F.call_function("instr", F.lit("KMGTPE"), unit)
    return F.when(number == "", F.lit(0.0)).otherwise(number.try_cast("double") * F.pow(F.lit(1024.0), F.when(unit.isin("", "B"), 0).otherwise(power)))


def output_format(args: Column) -> Column:
    """The value of the first ``-o x``, ``-o=x``, ``--output x`` or ``--output=x`` in an array of arguments, else null."""
    at = F.array_position(F.transform(args, lambda x: x.isin("-o", "--output") | x.rlike("^(-o|--output)=")), True).cast("int")
    flag = F.try_element_at(args, at)
    inline = F.regexp_extract(flag, "^(?:-o|--output)=(?s)(.*)$", 1)
    return F.when(at == 0, F.lit(None)).when(flag.contains("="), inline).otherwise(F.try_element_at(args, at + 1))


def short_image(image: Column) -> Column:
    """A container image without digest, tag and registry host, 30 characters at most."""
    name = F.regexp_replace(F.regexp_replace(image, "@.*$", ""), r":[^:/]*$", "")
    return F.left(F.regexp_replace(name, r"^[^/]*[.:][^/]*/", ""), F.lit(30))


def short_status(status: Column) -> Column:
    s = F.lower(trimmed(status))
    code = F.regexp_extract(s, r"^exited \((\d+)\)", 1)
    return (
        F.when(F.startswith(s, F.lit("up")), F.lit("up"))
        .when(code != "", F.concat(F.lit("exited("), code, F.lit(")")))
        .otherwise(F.coalesce(F.nullif(F.regexp_extract(s, r"^(\S*)", 1), F.lit("")), F.lit("?")))
    )


def field_or_dash(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("-"))


def name_tag(tags: Column) -> Column:
    """The Value of the first struct (Key, Value) whose Key is Name."""
    return F.try_element_at(F.filter(tags, lambda t: t["Key"] == "Name"), F.lit(1))["Value"]


def parse_version(version: Column) -> Column:
    """Struct of three integers, null if the text is no X.Y.Z (a leading v is allowed)."""
    part = lambda i: F.regexp_extract(version, r"^v?(\d{1,9})\.(\d{1,9})\.(\d{1,9})$", i)
    return F.when(part(1) != "", F.struct(*[part(i).try_cast("int").alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))]))


def is_newer(candidate: Column, current: Column) -> Column:
    return F.coalesce(parse_version(candidate) > parse_version(current), F.lit(False))


def is_builtin(word: Column) -> Column:
    return word.isin(*BUILTINS)


def is_assignment(word: Column) -> Column:
    return word.rlike(r"^[A-Za-z_][A-Za-z0-9_]*=")


def needs_terminal(word: Column) -> Column:
    return word.isin(*INTERACTIVE) | word.isin(*PRIVILEGED)


def saved(before: Column, after: Column) -> Column:
    return F.greatest(before - after, F.lit(0))


def savings_pct(before: Column, after: Column) -> Column:
    """Percent saved, never negative; 0 where there was nothing."""
    return F.when(before > 0, saved(before, after).cast("double") / before * 100).otherwise(F.lit(0.0))


def savings_pct_floor(before: Column, after: Column) -> Column:
    return F.when(before > 0, F.floor(saved(before, after) * 100 / before).cast("long")).otherwise(F.lit(0).cast("long"))


def savings_pct_signed(before: Column, after: Column) -> Column:
    return F.when(before > 0, (1 - after.cast("double") / before) * 100).otherwise(F.lit(0.0))


def savings_pct_rounded(before: Column, after: Column) -> Column:
    """Two decimals, halves up."""
    return F.when(before > 0, F.floor((100 - 100.0 * after / before) * 100 + 0.5) / 100).otherwise(F.lit(0.0))


def human_count(n: Column) -> Column:
    """1.2K, 3.40M, 1.00B."""
    d = n.cast("double")
    return (
        F.when(n >= 10**9, F.concat(F.format_string("%.2f", d / 1e9), F.lit("B")))
        .when(n >= 10**6, F.concat(F.format_string("%.2f", d / 1e6), F.lit("M")))
        .when(n >= 1000, F.concat(F.format_string("%.1f", d / 1e3), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def bar(value: Column, greatest: Column, width: int = 40) -> Column:
    return F.repeat(F.lit("█"), F.round(value / F.greatest(greatest, F.lit(1)) * width).cast("int"))
