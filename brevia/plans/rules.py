"""Declarative line-filter rules: loading, inheritance, precedence, matching and the filter itself."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brevia.functions import text as T

#: A longer pattern is dropped, as is one that doesn't compile.
LONGEST_PATTERN = 4096
#: Lower numbers win.
TIERS = {"project": 0, "extension": 1, "builtin": 2}
#: Tables of rules and of their beginnings are broadcast up to so many rows, some megabytes; larger ones are joined in a shuffle.
BROADCAST_RULES = 20_000
#: Finds nothing.
_NEVER = "(?!)"
#: What a rule does, as columns.
PARAMETERS = "strip string, head int, tail int, width int, tokens int, dedupe boolean, message string"


@dataclass(frozen=True)
class Rule:
    """A rule; ``commands`` are the beginnings of command lines that it is for."""

    name: str
    commands: tuple[str, ...] = ()
    strip_patterns: tuple[str, ...] = ()
    head_lines: int | None = None
    tail_lines: int | None = None
    max_line_chars: int | None = None
    max_tokens: int | None = None
    dedupe: bool = True
    empty_message: str | None = None
    extends: str | None = None
    source: str = "builtin"


def usable(pattern: str) -> bool:
    """Whether a pattern is short enough and one that the engine can compile: Java's, if there is a Spark session, else Python's reading of it."""
    if len(pattern.encode()) > LONGEST_PATTERN:
        return False
    sc = SparkContext._active_spark_context
    try:
        if sc is None:
            re.compile(pattern)
        else:
            sc._jvm.java.util.regex.Pattern.compile(T.U + pattern)
    except (re.error, IllegalArgumentException):
        return False
    return True


def parse_rule(toml: str, source: str = "builtin") -> Rule:
    """A rule from a file's text: its fields are in a table ``filter`` or, in short files, at the top."""
    raw = tomllib.loads(toml)
    raw = raw.get("filter", raw)
    known = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in Rule.__dataclass_fields__ and k != "source"}
    if "name" not in known:
        raise ValueError("a rule needs a name")
    return replace(Rule(source=source, **known), strip_patterns=tuple(p for p in known.get("strip_patterns", ()) if usable(p)))


def load_rules(folder: str, source: str = "project", trusted: bool = True) -> list[Rule]:
    """Every TOML file of a folder, by name; files that are no rules are skipped, and so is an untrusted folder."""
    found = []
    for path in sorted(Path(folder).glob("*.toml")) if trusted else ():
        try:
            found.append(parse_rule(path.read_text(encoding="utf-8"), source))
        except (ValueError, TypeError):
            continue
    return found


def extended(rules: Iterable[Rule]) -> list[Rule]:
    """Children take what they don't set from their parent, one level up, and add their patterns to its."""
    rules = list(rules)
    by_name = {r.name: r for r in rules}
    out = []
    for r in rules:
        if r.extends is None:
            out.append(r)
            continue
        if r.extends not in by_name:
            raise ValueError(f"rule {r.name} extends {r.extends}, which there isn't")
        p = by_name[r.extends]
        own = {f: getattr(r, f) if getattr(r, f) is not None else getattr(p, f) for f in ("head_lines", "tail_lines", "max_line_chars", "max_tokens", "empty_message")}
        out.append(replace(r, strip_patterns=p.strip_patterns + r.strip_patterns, commands=r.commands or p.commands, **own))
    return out


def by_precedence(rules: Iterable[Rule]) -> list[Rule]:
    """One rule of each name: the project's before an extension's before the built-in one."""
    best: dict[str, Rule] = {}
    for r in rules:
        if r.name not in best or TIERS[r.source] < TIERS[best[r.name].source]:
            best[r.name] = r
    return list(best.values())


def rule_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """(rule, prefix, first_word, len, ord), a row for each beginning."""
    rows = [(r.name, p, p.split(" ")[0], len(p), i) for i, r in enumerate(rules) for p in r.commands]
    return spark.createDataFrame(rows, "rule string, prefix string, first_word string, len int, ord int")


def match_rules(runs: DataFrame, table: DataFrame, command: str | Column = "command") -> DataFrame:
    """Add ``rule``: that with the longest beginning of the command, the earliest of equals, null if there is none.

    Candidates share the first word. A table of up to BROADCAST_RULES rows is broadcast, and the best candidate is found within the
    row, so runs aren't shuffled. The plan is the same for any number of rules.
    """
    best = table.groupBy("first_word").agg(F.array_sort(F.collect_list(F.struct((-F.col("len")).alias("l"), "ord", "prefix", "rule"))).alias("__rules"))
    best = F.broadcast(best) if table.count() <= BROADCAST_RULES else best
    d = runs.withColumn("__command", F.col(command) if isinstance(command, str) else command).withColumn("__word", F.regexp_extract("__command", r"^(\S*)", 1))
    d = d.join(best.withColumnRenamed("first_word", "__first"), F.col("__word") == F.col("__first"), "left")
    fits = F.filter("__rules", lambda r: F.startswith(F.col("__command"), r["prefix"]))
    return d.withColumn("rule", F.try_element_at(fits, F.lit(1))["rule"]).drop("__rules", "__word", "__first", "__command")


def match_first(runs: DataFrame, rules: list[Rule], command: str = "command") -> DataFrame:
    """Add ``rule``: the first in the list with a beginning of the command, whether or not that ends with a word; null if there is none.

    All beginnings start with as many characters as the shortest has; these are the key that runs and rules are joined by.
    """
    table = rule_table(runs.sparkSession, rules).filter("prefix <> ''")
    short = min((len(p) for r in rules for p in r.commands if p), default=0)
    first = table.groupBy(F.left("prefix", F.lit(short)).alias("__start")).agg(F.array_sort(F.collect_list(F.struct("ord", "prefix", "rule"))).alias("__rules"))
    first = F.broadcast(first) if len(rules) <= BROADCAST_RULES else first
    d = runs.join(first, F.left(F.col(command), F.lit(short)) == F.col("__start"), "left")
    fits = F.filter("__rules", lambda r: F.startswith(F.col(command), r["prefix"]))
    return d.withColumn("rule", F.try_element_at(fits, F.lit(1))["rule"]).drop("__rules", "__start")


def alternation(rule: Rule) -> str:
    """A rule's strip patterns as one; what it finds in a line is found by one of them."""
    return T.U + "|".join(f"(?:{p})" for p in rule.strip_patterns) if rule.strip_patterns else _NEVER


def rule_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """(rule, source, ord, commands, patterns, extends, parameters): a row for each rule, in order of precedence."""
    rows = [
        (r.name, r.source, i, list(r.commands), list(r.strip_patterns), r.extends, (alternation(r), r.head_lines, r.tail_lines, r.max_line_chars, r.max_tokens, r.dedupe is not False, r.empty_message))
        for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, f"rule string, source string, ord int, commands array<string>, patterns array<string>, extends string, parameters struct<{PARAMETERS.replace(' ', ':').replace(',:', ',')}>")


def apply_rule(d: DataFrame, rule: Rule, text: str = "raw", out: str = "compressed", strip_ansi_first: bool = True) -> DataFrame:
    """Add ``out``: the text after the five stages: strip, fold repeats, window, width, fallback. Rows aren't shuffled."""
    raw = F.col(text)
    message = F.lit(rule.empty_message or "")
    a = T.drop_lines(T.lines(T.strip_ansi(raw) if strip_ansi_first else raw), *rule.strip_patterns)
    d = T.once(d, __a=a)
    if rule.dedupe:
        d = T.once(d, __b=T.dedupe_repeated_lines(F.col("__a"))).drop("__a").withColumnRenamed("__b", "__a")
    a = F.col("__a")
    a = T.window(a, rule.head_lines, rule.tail_lines) if rule.max_tokens is None else T.head_tail_by_tokens(a, rule.max_tokens)
    if rule.max_line_chars is not None:
        a = F.transform(a, lambda x: F.left(x, F.lit(rule.max_line_chars)))
    d = T.once(d, __t=T.joined(a))
    kept = F.when(T.blank(raw), message).when(T.blank(F.col("__t")), message).otherwise(F.col("__t"))
    return d.withColumn(out, kept).drop("__a", "__t")


def filtered(raw: Column, p: Column, strip_ansi_first: bool = True) -> Column:
    """What ``apply_rule`` adds, as an expression over the text and a struct of a rule's parameters.

    A line's test looks its pattern up, and the pattern is compiled again only where it isn't that of the line before.
    """
    a = F.filter(T.lines(T.strip_ansi(raw) if strip_ansi_first else raw), lambda x: F.regexp_instr(x, p["strip"]) == 0)
    a = T.let(a, lambda x: F.when(p["dedupe"], T.dedupe_repeated_lines(x)).otherwise(x))
    a = T.let(a, lambda x: F.when(p["tokens"].isNull(), T.windowed(x, p["head"], p["tail"])).otherwise(T.head_tail_by_tokens(x, p["tokens"])))
    a = F.transform(a, lambda x: F.when(p["width"].isNull(), x).otherwise(F.left(x, p["width"])))
    return T.let(T.joined(a), lambda t: F.when(T.blank(raw) | T.blank(t), F.coalesce(p["message"], F.lit(""))).otherwise(t))


def apply_rules(runs: DataFrame, rules: Iterable[Rule], text: str = "raw", out: str = "compressed") -> DataFrame:
    """Apply to each run the rule named in its column ``rule``; runs without a known one keep their text.

    Rules are data: they are joined to the runs by name and broadcast where they are few, so the plan is the same for any number of
    rules, and one pass applies them all. Of rules of one name the first counts.
    """
    rules = list({r.name: r for r in reversed(list(rules))}.values())
    known = rule_frame(runs.sparkSession, rules).select(F.col("rule").alias("__name"), F.col("parameters").alias("__rule"))
    d = runs.join(F.broadcast(known) if len(rules) <= BROADCAST_RULES else known, F.col("rule") == F.col("__name"), "left")
    done = F.when(F.col("__rule").isNull(), F.col(text)).otherwise(T.let(F.col(text), lambda x: filtered(x, F.col("__rule"))))
    return d.withColumn(out, done).drop("__name", "__rule")
