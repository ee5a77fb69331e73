"""Reports on rules: lists, single rules, their own test cases, and what each stage of compression takes away."""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from brevia.functions import text as T
from brevia.plans import rules as R


def _short(text: Column, most: int) -> Column:
    """Cut by bytes' worth of characters, with an ellipsis."""
    return F.when(F.octet_length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def rule_list(rules: DataFrame) -> DataFrame:
    """(ord, line) of the list of a ``rule_frame``: a title, heads, and a line for each rule with its source, name and beginnings."""
    cells = F.concat(F.lit("  "), F.rpad("source", 9, " "), F.lit("  "), T.left(_short(F.col("rule"), 32), 32), F.lit("  "), _short(F.array_join("commands", ", "), 60))
    heads = rules.agg(F.count("*").alias("n")).select(F.when(F.col("n") == 0, F.array(F.lit("No rules active."))).otherwise(F.array(F.concat(F.col("n").cast("string"), F.lit(" rule(s) active:")), F.lit(""), F.lit("  SOURCE     NAME                              COMMANDS"))).alias("lines"))
    top = heads.select(F.posexplode("lines").alias("i", "line")).select((F.col("i") - 3).alias("ord"), "line")
    return top.union(rules.select("ord", cells.alias("line"))).orderBy("ord")


def rule_show(rules: DataFrame) -> DataFrame:
    """(rule, shown): all that is set of each rule of a ``rule_frame``, a line for each field."""
    p = F.col("parameters")
    line = lambda title, value: F.when(value.isNotNull(), F.concat(F.lit(title), value.cast("string")))
    patterns = F.when(F.size("patterns") > 0, F.array_join(F.concat(F.array(F.concat(F.lit("strip_patterns ("), F.size("patterns").cast("string"), F.lit("):"))), F.transform("patterns", lambda x: F.concat(F.lit("  - "), x))), "\n"))
    parts = F.array(
        line("name:     ", F.col("rule")), line("source:   ", F.col("source")), F.concat(F.lit("commands: "), F.array_join("commands", ", ")), line("extends:  ", F.col("extends")), patterns,
        line("head_lines:    ", p["head"]), line("tail_lines:    ", p["tail"]), line("max_line_chars: ", p["width"]), line("max_tokens:    ", p["tokens"]), line("empty_message:  ", F.concat(F.lit('"'), p["message"], F.lit('"'))),
    )
    return rules.select("rule", F.array_join(parts, "\n").alias("shown"))  # leaves nulls out


def savings_whole(tokens_in: Column, tokens_out: Column) -> Column:
    """Percent of tokens saved, rounded up to whole percents: what is left is cut."""
    return F.lit(100) - F.floor(100 * tokens_out / F.greatest(tokens_in, F.lit(1)))


def rule_test(runs: DataFrame, rules: Iterable[R.Rule], text: str = "raw") -> DataFrame:
    """Add ``report`` to runs with a column ``rule``: bytes and lines before and after the rule, and its output."""
    n_lines = lambda x: F.size(T.lines(x)).cast("string")
    d = T.once(R.apply_rules(runs, rules, text, "__out"), __b=F.octet_length(text), __a=F.octet_length("__out"))
    pct = F.when(F.col("__b") == 0, F.lit(0.0)).otherwise(100.0 * F.greatest(F.col("__b") - F.col("__a"), F.lit(0)) / F.col("__b"))
    report = F.concat(
        F.lit("rule: "), "rule", F.lit("\ninput:  "), F.col("__b").cast("string"), F.lit(" bytes, "), n_lines(F.col(text)), F.lit(" line(s)\noutput: "), F.col("__a").cast("string"), F.lit(" bytes, "), n_lines(F.col("__out")), F.lit(" line(s)"),
        F.format_string("  (%.1f%% saved)\n\n--- output ---\n", pct), "__out", F.when(F.endswith("__out", F.lit("\n")), F.lit("")).otherwise(F.lit("\n")),
    )
    return d.withColumn("report", report).drop("__out", "__b", "__a")


@F.udtf(returnType="rule string, number int, input string, expected string, least_saved double")
class RuleCases:
    """The cases that a rule's file brings along: an input, what its output is to contain, and how many percent of its tokens are to be saved."""

    def eval(self, toml: str):
        try:
            raw = tomllib.loads(toml or "")
            name = raw.get("filter", raw)["name"]
            for i, case in enumerate(raw.get("assertions", ())):
                yield name, i, case["input"], case.get("expected_contains"), float(case.get("min_savings_pct", 0))
        except (tomllib.TOMLDecodeError, KeyError, TypeError, ValueError):
            return


def rule_cases(files: DataFrame, toml: str = "value") -> DataFrame:
    """(rule, number, input, expected, least_saved) of the cases in rule files, a row of text each; files that are no rules have none."""
    spark = files.sparkSession
    spark.udtf.register("brevia_rule_cases", RuleCases)
    return spark.sql("select c.* from {files} f, lateral brevia_rule_cases(f.toml) c", files=files.select(F.col(toml).alias("toml")))


def check_cases(cases: DataFrame, rules: Iterable[R.Rule]) -> DataFrame:
    """(rule, number, actual, saved, passed) of cases under the rules: one pass over all cases, whatever the number of rules.

    A case passes if the output contains what is expected and enough is saved. Cases of unknown rules fail.
    """
    rules = list(rules)
    known = [r.name for r in rules]
    d = R.apply_rules(cases, rules, "input", "actual")
    d = T.once(d, saved=savings_whole(T.count_tokens(F.col("input")), T.count_tokens(F.col("actual"))))
    fits = F.contains("actual", F.coalesce("expected", F.lit(""))) & (F.col("saved") >= F.coalesce("least_saved", F.lit(0.0)))
    return d.select("rule", "number", "actual", "saved", (F.col("rule").isin(known) & fits).alias("passed"))


def read_cases(spark: SparkSession, folder: str) -> DataFrame:
    """``rule_cases`` of the TOML files of a folder that Spark can read."""
    return rule_cases(spark.read.option("pathGlobFilter", "*.toml").text(folder, wholetext=True))


#: Stages whose effect ``profile`` tells, in order; each takes what the one before gives.
STAGES: tuple[tuple[str, Callable[[Column], Column]], ...] = (
    ("strip_ansi", T.strip_ansi),
    ("head_tail", lambda x: T.joined(T.let(T.lines(x), lambda a: T.head_tail(a, 50, 20)))),
    ("hard_cap", lambda x: T.hard_cap(x, 50_000)),
)


def staged(runs: DataFrame, text: str = "raw", stages=STAGES) -> DataFrame:
    """Add ``__0``, ``__1`` and so on: the text (null as empty), and the text after each stage."""
    d = T.once(runs, __0=F.coalesce(F.col(text), F.lit("")))
    for i, (_, f) in enumerate(stages, 1):
        d = T.once(d, **{f"__{i}": f(F.col(f"__{i - 1}"))})
    return d


def profile(runs: DataFrame, text: str = "raw", stages=STAGES) -> DataFrame:
    """(position, stage, chars, n_lines, tokens, lost_tokens, savings_pct) of all runs after each stage; position 0 is the input.

    The numbers are gathered as metrics beside one pass over the runs, which writes nothing and shuffles nothing.
    """
    seen = Observation()
    sums = []
    for i in range(len(stages) + 1):
        x = F.col(f"__{i}")
        sums += [F.sum(v).alias(f"{n}{i}") for n, v in (("chars", F.char_length(x)), ("lines", F.size(T.lines(x))), ("tokens", T.count_tokens(x)))]
    staged(runs, text, stages).observe(seen, *sums).write.format("noop").mode("overwrite").save()
    got = {k: v or 0 for k, v in seen.get.items()}
    rows, first = [], got.get("tokens0", 0)
    for i, name in enumerate(["input", *[n for n, _ in stages]]):
        tokens = got.get(f"tokens{i}", 0)
        before = got.get(f"tokens{max(i - 1, 0)}", 0)
        rows.append((i, name, got.get(f"chars{i}", 0), got.get(f"lines{i}", 0), tokens, before - tokens, 100.0 * (1 - tokens / first) if first else 0.0))
    return runs.sparkSession.createDataFrame(rows, "position int, stage string, chars long, n_lines long, tokens long, lost_tokens long, savings_pct double")
