"""Text functions, rules and the scanner on edge cases."""

import pytest
from pyspark.sql import functions as F

from brevia.functions import text as T
from brevia.operators import scan
from brevia.plans import rules as R
from brevia.sources import transcripts


def one(spark, column, **values):
    d = spark.createDataFrame([tuple(values.values())], list(values))
    return d.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("", []), ("\n", [""]), ("a\r\nb", ["a", "b"]), ("a\n\n", ["a", ""]), ("a\n", ["a"]), ("a\rb", ["a\rb"])],
)
def test_lines(spark, text, want):
    assert one(spark, T.lines(F.col("t")), t=text) == want


def test_tokens_are_between_unicode_spaces(spark):
    assert one(spark, T.count_tokens(F.col("t")), t=" a b　c\n\td ") == 4


@pytest.mark.parametrize(
    ("array", "threshold", "want"),
    [(["a", "a", "a", "b"], 3, ["a (×3)", "b"]), (["a", "a", "b"], 3, ["a", "a", "b"]), (["a", "b", "a"], 2, ["a", "b", "a"]), ([""] * 4, 3, [" (×4)"]), (["a", "a"], 1, ["a", "a"])],
)
def test_dedupe(spark, array, threshold, want):
    assert one(spark, T.dedupe_repeated_lines(F.col("a"), threshold), a=array) == want


def test_windows(spark):
    a = [str(i) for i in range(10)]
    assert one(spark, T.head_tail(F.col("a"), 2, 1), a=a) == ["0", "1", "... (7 lines omitted) ...", "9"]
    assert one(spark, T.head_tail(F.col("a"), 5, 5), a=a) == a
    assert one(spark, T.window(F.col("a"), None, 3), a=a) == ["7", "8", "9"]
    assert one(spark, T.window(F.col("a"), 3, None), a=a) == ["0", "1", "2"]
    assert one(spark, T.head_tail_by_tokens(F.col("a"), 5), a=a) == ["0", "1", "2", "... (5 lines omitted) ...", "8", "9"]
    assert one(spark, T.head_tail_by_tokens(F.col("a"), 10), a=a) == a


def test_redaction_leaves_no_bearer_token(spark):
    assert "abc" not in one(spark, T.redact_secrets(F.col("t")), t="auth: Bearer abc.def")
    assert one(spark, T.redact_paths(F.col("t")), t="/home/ann/x") == "/home/user/x"


@pytest.mark.parametrize(("size", "want"), [("4.0K", 4096.0), ("701M", 701 * 1024.0**2), ("12", 12.0), ("x", 0.0), ("1.5G", 1.5 * 1024**3)])
def test_parse_size(spark, size, want):
    assert one(spark, T.parse_size(F.col("t")), t=size) == want


@pytest.mark.parametrize(("n", "want"), [(12, "12B"), (2048, "2.0K"), (5 * 1024**2, "5.0M"), (3 * 1024**3, "3.0G")])
def test_format_size(spark, n, want):
    assert one(spark, T.format_size(F.col("n")), n=n) == want


@pytest.mark.parametrize(("args", "want"), [(["get", "-o", "json"], "json"), (["-o=yaml"], "yaml"), (["--output", "wide", "-o", "x"], "wide"), (["get"], None), (["-o"], None)])
def test_output_format(spark, args, want):
    assert one(spark, T.output_format(F.col("a")), a=args) == want


def test_images_and_statuses(spark):
    assert one(spark, T.short_image(F.col("t")), t="registry.io:5000/a/b:1.2@sha256:abc") == "a/b"
    assert one(spark, T.short_image(F.col("t")), t="library/nginx:latest") == "library/nginx"
    assert [one(spark, T.short_status(F.col("t")), t=x) for x in ("Up 2 hours (healthy)", "Exited (1) 3 hours ago", "Created")] == ["up", "exited(1)", "created"]


def test_rule_stages(spark):
    rule = R.Rule("r", ("x",), (r"^noise",), head_lines=2, tail_lines=1, max_line_chars=5, empty_message="nothing")
    texts = ["noise 1\nlong line\nb\nb\nb\nc\nd\ne", "", "noise", "  \n "]
    d = R.apply_rule(spark.createDataFrame(list(enumerate(texts)), "i int, raw string"), rule).orderBy("i")
    assert [r["compressed"] for r in d.collect()] == ["long \nb (×3\ne", "nothing", "nothing", "nothing"]


def test_rule_loading_and_inheritance(spark, tmp_path):
    (tmp_path / "a.toml").write_text('name = "a"\ncommands = ["tool run"]\nstrip_patterns = ["^x", "("]\nhead_lines = 3\n')
    (tmp_path / "b.toml").write_text('name = "b"\ncommands = ["tool"]\nextends = "a"\nstrip_patterns = ["^y"]\n')
    (tmp_path / "c.toml").write_text("not toml [")
    rules = R.load_rules(str(tmp_path))
    assert [r.name for r in rules] == ["a", "b"] and R.load_rules(str(tmp_path), trusted=False) == []
    b = R.extended(rules)[1]
    assert b.strip_patterns == ("^x", "^y") and b.head_lines == 3
    runs = spark.createDataFrame([("tool run it",), ("tool x",), ("toolx",)], "command string")
    assert [r["rule"] for r in R.match_rules(runs, R.rule_table(spark, rules)).collect()] == ["a", "b", None]
    with pytest.raises(ValueError):
        R.extended([R.Rule("c", extends="none")])


LINES = {
    "a && b": [("a", "&&"), ("b", "")], "a 'x && y'; b": [("a 'x && y'", ";"), ("b", "")], "a | b": None, "a $(b)": None, "a &&": None, "a 'b": None, "a <<E": None, "a || b": [("a", "||"), ("b", "")],
    " a b ": [(" a b ", "")], 'a "$(b) `c` || d" && e': [('a "$(b) `c` || d"', "&&"), ("e", "")], "a \\; b; c": [("a \\; b", ";"), ("c", "")], 'a "x\\"y;" ; b': [('a "x\\"y;"', ";"), ("b", "")],
    "a ;; b": None, "; a": None, "a `b`": None, "a & b && c": [("a & b", "&&"), ("c", "")], "a '<<' b": None, "a $b; c": [("a $b", ";"), ("c", "")], "a ||| b": None, "a \\": [("a \\", "")], 'a "b\\': None, "": [("", "")],
}


def test_compound_commands(spark):
    d = spark.createDataFrame([(k,) for k in LINES] + [("x" * 50_000 + '; "' + "y z" * 50_000 + '"',)], "c string").select("c", scan.compound_parts(F.col("c")).alias("p"))
    got = {r["c"]: None if r["p"] is None else [tuple(x) for x in r["p"]] for r in d.collect()}
    assert {k: got[k] for k in LINES} == LINES
    assert [len(v) for k, v in got.items() if k not in LINES] == [2]


def test_rewriting(spark):
    want = {
        "git status": "brevia git status", "  cat  a b": "brevia read a b", "tree": "brevia ls --tree", "cd /tmp": "cd /tmp", "A=1 b": "A=1 b", "brevia x": "brevia x", "a | b": "a | b", "  ": "  ", "cd x && rg 'a;b' && A=1; ls": "cd x && brevia grep 'a;b' && A=1; brevia ls",
    }
    d = spark.createDataFrame([(k, "an_agent", "s-1") for k in want], "command string, tool string, session string")
    assert {r["command"]: r["rewritten"] for r in scan.rewrite(d).collect()} == want
    named = {r["command"]: r["rewritten"] for r in scan.rewrite(d, tool="tool", session="session").collect()}
    assert named == {k: v.replace("brevia", "BREVIA_TOOL=an_agent BREVIA_SESSION=s-1 brevia") if k != "brevia x" else k for k, v in want.items()}
    assert one(spark, scan.environment_prefix(F.col("t"), F.lit("s")), t="A b") == "" and one(spark, scan.environment_prefix(F.col("t"), F.lit("s s")), t="x") == "BREVIA_TOOL=x "


def test_argument_lists(spark):
    want = {
        ("git", "status"): "brevia git status", (): "", ("brevia", "ls"): "brevia ls", ("cat",): "brevia read", ("rg", "a b", "c"): "brevia grep a b c", ("cd", "x"): "cd x", ("A=1", "b"): "A=1 b", ("vim", "x"): "vim x",
        ("sudo", "ls"): "sudo ls", ("a", "&&", "b"): "a && b", ("a", "x<<y"): "a x<<y", ("a", ">", "b"): "a > b", ("a", "b>c"): "brevia a b>c",
    }
    d = spark.createDataFrame([(list(k),) for k in want], "a array<string>").select("a", scan.rewrite_argv(F.col("a")).alias("r"))
    assert {tuple(r["a"]): r["r"] for r in d.collect()} == want
    words = {"a 'b c'  \"d\\\"e\" f\\ g": ["a", "b c", 'd"e', "f g"], "": [], " x''y ": ["xy"], "a\"b 'c'\"d": ["ab 'c'd"]}
    d = spark.createDataFrame([(k,) for k in words], "c string").select("c", scan.shell_words(F.col("c")).alias("w"))
    assert {r["c"]: r["w"] for r in d.collect()} == words


def test_hook_payloads_of_three_shapes(spark):
    bodies = {
        '{"session_id":"s","tool_name":"Bash","tool_input":{"command":"git status"},"cwd":"/p"}': ("nested", "git status", "s"), '{"tool_name":"Bash","tool_input":{"command":"ls"}}': ("nested", "ls", None),
        '{"tool":"shell","args":["git","status"]}': ("args", "git status", None), '{"tool":"shell","args":[]}': ("args", "", None), '{"command":"git log"}': ("plain", "git log", None),
        '{"tool_name":"Read","tool_input":{"command":"x"}}': None, '{"tool_name":"Bash","tool_input":{}}': None, "not json": None, '{"command":3}': None, '{"tool":"shell","args":[1]}': None, "[]": None, '{"tool_name":"Bash","tool_input":{"command":"x"},"session_id":4}': None,
    }
    d = spark.createDataFrame([(k, "old") for k in bodies] + [(None, None)], "body string, command string")
    got = {r["body"]: (r["adapter"], r["command"], r["session_id"]) for r in transcripts.decode_hooks(d.select("body")).collect()}
    assert got == {k: v for k, v in bodies.items() if v}


def test_classification(spark):
    d = spark.createDataFrame([("git status",), ("ls",), ("lsof",), ("psql x",), ("jq .",), ("unknown",)], "c string")
    rows = d.select(scan.classify(F.col("c")).alias("k"), scan.is_compressible(F.col("c")).alias("s")).collect()
    assert [(r["k"], r["s"]) for r in rows] == [("git", True), ("system", True), ("system", True), ("db", False), (None, True), (None, False)]
