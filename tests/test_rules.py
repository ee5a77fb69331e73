"""The rule library: what its rules save, which one a command finds, and reports on them."""

import pytest
from pyspark.sql import functions as F

from brevia.functions import text as T
from brevia.operators import rule_reports, tools
from brevia.plans import rules as R
from brevia.plans.library import NOISE, active_rules, catchalls, library

#: A command, what its tool prints, what must stay, and percents of tokens that must go at least.
RUNS = {
    "pnpm install": ("Lockfile is up to date, resolution step is skipped\nProgress: resolved 1, reused 0, downloaded 0, added 0\nPackages: +120\n++++++++++++++\nProgress: resolved 120, reused 118, downloaded 2, added 120, done\n\ndependencies:\n+ react 18.2.0\n\nDone in 4.1s\n", "react", 60),
    "bun install": ("bun install v1.1.0 (abc)\n\nResolving dependencies\nResolved, downloaded and extracted [24]\nSaved lockfile\n+ zod@3.2.1\n\n24 packages installed [1.2s]\n", "zod", 30),
    "bunx serve": ("Resolving dependencies\nResolved, downloaded and extracted [2]\nSaved lockfile\nChecking formatting...\n[warn] src/a.ts\n[warn] Code style issues found in the above file.\n", "src/a.ts", 30),
    "npx tsc": ("Need to install the following packages:\ntypescript@5.4.2\nOk to proceed? (y) y\nnpm warn exec The following package was not found\nnpm notice New minor version of npm available! 10.5.0 -> 10.8.1\nnpm notice To update run: npm install -g npm\nsrc/a.ts(1,2): error TS2304: Cannot find name 'x'.\n", "TS2304", 30),
    "yarn": ("yarn install v1.22.19\n[1/4] Resolving packages...\n[2/4] Fetching packages...\n[3/4] Linking dependencies...\n[4/4] Building fresh packages...\nsuccess Saved lockfile.\nwarning left-pad@1.3.0: use String.prototype.padStart()\nDone in 12.31s.\n", "left-pad", 60),
    "deno task test": ("Task test deno test\nCheck file:///a_test.ts\nrunning 3 tests from ./a_test.ts\nadds ... ok (2ms)\nsubtracts ... ok (1ms)\nfails ... FAILED (3ms)\n\nok | 2 passed | 1 failed (20ms)\n", "FAILED", 30),
    "jest": ("Determining test suites to run...\nPASS src/a.test.js\n  ✓ adds (2 ms)\n  ✓ subtracts\nPASS src/b.test.js\n  ✓ parses (1 ms)\n\nTest Suites: 2 passed, 2 total\nTests:       3 passed, 3 total\nSnapshots:   0 total\nTime:        1.2 s\nRan all test suites.\n", "3 passed", 60),
    "npx playwright test": ("Running 3 tests using 2 workers\n  ✓  1 a.spec.ts:3:1 › opens (1.2s)\n  ✓  2 a.spec.ts:9:1 › closes (0.8s)\n  ✘  3 b.spec.ts:3:1 › breaks (2s)\n\n  To open last HTML report run:\n\n  npx playwright show-report\n", "breaks", 30),
    "cypress run": ("====================\n\n  (Run Starting)\n\n  ┌──────────────┐\n  │ Cypress: 13  │\n  └──────────────┘\n\n  Running:  a.cy.js   (1 of 1)\n    ✓ loads (200ms)\n    1) fails\n\n  (Results)\n  1 failing\n", "1 failing", 30),
    "mocha": ("\n  calc\n    ✓ adds\n    ✓ subtracts\n    ✔ divides by two\n    1) fails\n\n  3 passing (12ms)\n  1 failing\n", "1 failing", 30),
    "ava": ("\n  ✔ adds\n  ✔ subtracts two numbers\n  ✖ fails\n  ─\n\n  1 test failed\n", "1 test failed", 30),
    "webpack": ("asset main.js 1.2 KiB [emitted] (name: main)\nasset vendor.js 140 KiB [emitted] (name: vendor)\nruntime modules 670 bytes 3 modules\ncacheable modules 900 bytes\n  ./src/a.js 300 bytes [built]\nERROR in ./src/b.js\nModule not found: Error: Can't resolve 'x'\n", "Can't resolve", 30),
    "esbuild a.js": ("\n".join(f"  dist/chunk-{i}.js  {i}.2kb" for i in range(40)) + "\n\nDone in 12ms", "Done", 30),
    "rollup -c": ("\nsrc/a.js → dist/a.js...\ncreated dist/a.js in 30ms\n\nsrc/b.js → dist/b.js...\n(!) Unresolved dependencies\n", "Unresolved", 30),
    "tsup": ("CLI Building entry: src/index.ts\nCLI Using tsconfig: tsconfig.json\nCLI tsup v8.0.0\nCLI Target: es2020\nESM Build start\nESM dist/index.js 12.30 KB\nESM ⚡️ Build success in 20ms\n", "success", 30),
    "swc src": ("\nSuccessfully compiled: 12 files with swc (30ms)\nwarning: x unused\n", "unused", 30),
    "prettier --write .": ("\n".join(f"src/f{i}.ts 12ms (unchanged)" for i in range(9)) + "\n[error] src/x.ts: SyntaxError", "SyntaxError", 30),
    "argocd app list": ("Name:               argocd/guestbook\nProject:            default\nServer:             https://kubernetes.default.svc\nNamespace:          guestbook\nURL:                https://argocd/a\nSource:\n- Repo:             https://git/x\nSync Status:        OutOfSync\nHealth Status:      Degraded\n", "OutOfSync", 30),
    "skaffold dev": ("Generating tags...\n - app -> app:abc\nChecking cache...\n - app: Not found. Building\nStarting build...\nStep 1/3 : FROM alpine\n ---> 05455a08881e\nStep 2/3 : RUN true\nStarting deploy...\n - deployment.apps/app created\nerror: pod app crashed\nWatching for changes...\n", "crashed", 30),
    "podman build .": ("STEP 1/3: FROM alpine\nSTEP 2/3: LABEL a=b\n--> 1a2b3c\nSTEP 3/3: RUN make\nerror: make failed\nTrying to pull docker.io/library/alpine...\nGetting image source signatures\nCopying blob 05455\nCopying config 05455\nWriting manifest to image destination\n", "make failed", 30),
    "buildah bud .": ("STEP 1: FROM alpine\nTrying to pull docker.io/alpine...\nGetting image source signatures\nCopying blob sha256:05\nWriting manifest to image\nStoring signatures\nSTEP 2: RUN false\nerror building at STEP 2\n--> 12ab\n", "error building", 30),
    "tofu init": ("\nInitializing the backend...\n\nInitializing provider plugins...\n- Finding latest version of hashicorp/null...\n- Installing hashicorp/null v3.2.2...\n- Installed hashicorp/null v3.2.2 (signed)\n\nOpenTofu has been successfully initialized!\n\nYou may now begin working with OpenTofu.\nWarning: old provider\n", "old provider", 60),
    "mvn package": ("[INFO] Scanning for projects...\n[INFO] \n[INFO] -----< a:b >-----\n[INFO] Building b 1.0\n[INFO] --- compiler:3.1:compile ---\n[INFO] Nothing to compile - all classes are up to date\nDownloading from central: https://x\n[ERROR] a.java:[3,5] cannot find symbol\n[INFO] BUILD FAILURE\n", "cannot find symbol", 60),
    "ansible-playbook a.yml": ("\nPLAY [all] ****\n\nTASK [Gathering Facts] ****\nok: [h1]\nok: [h2]\n\nTASK [copy] ****\nchanged: [h1]\nfatal: [h2]: FAILED!\n", "fatal: [h2]", 30),
    "ping h": ("PING h (10.0.0.1) 56(84) bytes of data.\n" + "64 bytes from 10.0.0.1: icmp_seq=1 ttl=64 time=0.1 ms\n" * 9 + "\n--- h ping statistics ---\n9 packets transmitted, 9 received, 0% packet loss\nrtt min/avg/max = 0.1/0.2/0.3 ms\n", "packet loss", 60),
    "ssh host": ("debug1: Connecting to host\ndebug1: Authenticated\nWarning: Permanently added 'h' to the list of known hosts.\nWelcome to Linux\n * Docs: https://x\nuptime 3 days\nConnection to h closed.\n", "uptime", 60),
    "wget http://x": ("--2024-01-01 10:00:00--  http://x\nResolving x... 1.2.3.4\nConnecting to x|1.2.3.4|:80... connected.\nHTTP request sent, awaiting response... 404 Not Found\nLength: 120 [text/html]\nSaving to: 'index.html'\n     0K .......... 50% 1M 0s\n2024-01-01 10:00:01 ERROR 404: Not Found.\n", "ERROR 404", 60),
    "unzip a.zip": ("Archive:  a.zip\n" + "".join(f"  inflating: f{i}.txt\n" for i in range(30)) + "replace g.txt? [y]es\n", "replace", 60),
    "trivy image x": ("2024-01-01T10:00:00Z\tINFO\tVulnerability scanning is enabled\n2024-01-01T10:00:01Z\tINFO\tDetected OS\n\nx (alpine 3.18)\nTotal: 1 (HIGH: 1)\n│ libssl │ CVE-2023-1 │ HIGH │\n├────────┼────────────┤\n", "CVE-2023-1", 30),
    "mypy src": ("Building (x) cached\nLOG: Mypy Version 1.8\nLOG: Config File mypy.ini\nsrc/a.py:3: error: bad type\nSuccess: no issues found in 3 source files\n", "bad type", 60),
    "uv sync": ("Resolved 24 packages in 12ms\nPrepared 3 packages in 200ms\nInstalled 3 packages in 4ms\n + anyio==4.3.0\n + idna==3.6\nwarning: `x` is yanked\n", "yanked", 60),
    "xcodebuild": ("Command line invocation:\n    /usr/bin/xcodebuild\nCompileC a.o a.m normal\n    cd /x\n    export LANG=C\nLd /x/app normal\nCodeSign /x/app\n/x/a.m:3:4: error: expected ';'\n** BUILD FAILED **\n", "expected", 60),
    "bundle install": ("Fetching gem metadata from https://rubygems.org/..\nResolving dependencies...\nUsing rake 13.0\nUsing json 2.6\nInstalling rails 7.1\nBundle complete! 3 gems\nUse `bundle info [gemname]` to see\nPost-install message from x\n", "Post-install", 60),
    "pre-commit run": ("trim trailing whitespace....................Passed\ncheck yaml...............(no files to check)Skipped\nruff.....................................Failed\n- hook id: ruff\n- duration: 0.1s\na.py:1:1: F401\n", "F401", 30),
    "gcloud compute instances list": ("NAME  ZONE\n" + "\n".join(f"vm{i}  z" for i in range(15)), "vm14", 0),
    "crane manifest x": ('{\n  "schemaVersion": 2\n}', "schemaVersion", 0),
    "terraform plan": ("aws_x.y: Refreshing state... [id=1]\nAcquiring state lock. This may take a few moments...\n\n# aws_x.y will be updated\n  # (4 unchanged attributes hidden)\nPlan: 0 to add\n", "Plan: 0", 0),
}


def test_rules_are_whole(spark):
    rules = library()
    assert len(rules) == 128 == len({r.name for r in rules})
    assert all(R.usable(p) for r in rules + catchalls() for p in r.strip_patterns) and len(catchalls()) == 12
    assert all(any(set(v) <= set(r.strip_patterns) for r in rules) for v in NOISE.values())


def test_each_run_finds_a_rule_that_keeps_what_matters(spark):
    d = spark.createDataFrame([(c, r) for c, (r, _, _) in RUNS.items()], "command string, raw string")
    got = R.apply_rules(R.match_rules(d, R.rule_table(spark, library())), library())
    got = {r["command"]: r for r in got.withColumns({"saved": rule_reports.savings_whole(T.count_tokens(F.col("raw")), T.count_tokens(F.col("compressed")))}).collect()}
    bad = [(c, got[c]["rule"], got[c]["saved"], got[c]["compressed"]) for c, (_, kept, least) in RUNS.items() if got[c]["rule"] is None or kept not in got[c]["compressed"] or got[c]["saved"] < least]
    assert bad == []


def test_every_rule_on_odd_texts(spark):
    """Empty, short, noisy, long and coloured texts: an empty one gives the rule's message, and colours don't hide noise."""
    texts = ["", " \n\t", "hello", "noise\n" * 20_000, "\x1b[31merror\x1b[0m: oops", None]
    d = spark.createDataFrame([(i, r.name, t) for r in library() for i, t in enumerate(texts)], "i int, rule string, raw string").repartition(8)
    got = {(r["rule"], r["i"]): r["compressed"] for r in R.apply_rules(d, library()).collect()}
    for r in library():
        assert got[r.name, 0] == got[r.name, 1] == (r.empty_message or "") and got[r.name, 5] is None
        assert got[r.name, 3] == "noise (×20000)" and got[r.name, 4] == "error: oops"


def test_the_plan_does_not_grow_with_rules(spark):
    d = spark.createDataFrame([("a", "b", "c")], "command string, raw string, rule string")
    plan = lambda rules: R.apply_rules(R.match_rules(d.drop("rule"), R.rule_table(spark, rules)), rules)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan(library())) == len(plan(library()[:3]))


def test_first_rule_in_order(spark):
    rules = [R.Rule("a", ("git st", "x")), R.Rule("b", ("git status", "gitk")), R.Rule("c", ("",))]
    d = spark.createDataFrame([("git status",), ("gitk",), ("xy",), ("git",), ("",), (None,)], "command string")
    assert {r["command"]: r["rule"] for r in R.match_first(d, rules).collect()} == {"git status": "a", "gitk": "b", "xy": "a", "git": None, "": None, None: None}


def test_reports(spark):
    rules = [R.Rule("a" * 40, ("a", "b"), (r"^\s*$",), 3, None, 80, empty_message="ok", source="project"), R.Rule("b", ("b" * 70,))]
    d = R.rule_frame(spark, rules)
    assert [r["line"] for r in rule_reports.rule_list(d).collect()] == [
        "2 rule(s) active:", "", "  SOURCE     NAME                              COMMANDS", "  project    " + "a" * 31 + "…  a, b", "  builtin    b" + " " * 31 + "  " + "b" * 59 + "…",
    ]
    assert [r["line"] for r in rule_reports.rule_list(d.limit(0)).collect()] == ["No rules active."]
    assert rule_reports.rule_show(d).first()["shown"] == "name:     " + "a" * 40 + "\nsource:   project\ncommands: a, b\nstrip_patterns (1):\n  - ^\\s*$\nhead_lines:    3\nmax_line_chars: 80\nempty_message:  \"ok\""
    runs = spark.createDataFrame([("b", "x\nx\nx\n"), (None, "")], "rule string, raw string")
    assert [r["report"] for r in rule_reports.rule_test(runs, rules).collect()] == ["rule: b\ninput:  6 bytes, 3 line(s)\noutput: 7 bytes, 1 line(s)  (0.0% saved)\n\n--- output ---\nx (×3)\n", None]


def test_cases_of_files(spark, tmp_path):
    (tmp_path / "a.toml").write_text('[filter]\nname = "a"\ncommands = ["a"]\nstrip_patterns = ["^n"]\n\n[[assertions]]\ninput = """\nn\nkept\n"""\nexpected_contains = "kept"\nmin_savings_pct = 50\n[[assertions]]\ninput = "x"\nexpected_contains = "y"\n')
    (tmp_path / "b.toml").write_text("oops [")
    (tmp_path / "c.txt").write_text("name = 'c'")
    cases = rule_reports.read_cases(spark, str(tmp_path))
    got = rule_reports.check_cases(cases, R.load_rules(str(tmp_path))).orderBy("number").collect()
    assert [(r["rule"], r["number"], r["actual"], r["saved"], r["passed"]) for r in got] == [("a", 0, "kept", 50, True), ("a", 1, "x", 0, False)]


def test_profile_of_nothing(spark):
    d = spark.createDataFrame([(None,), ("",)], "raw string")
    assert {(r["tokens"], r["savings_pct"]) for r in rule_reports.profile(d).collect()} == {(0, 0.0)}
    assert rule_reports.profile(d.limit(0)).count() == 4


@pytest.mark.parametrize("columns", [{"__words": "w", "__own": 1, "__found": 2, "rule": "mine", "__row": 3, "__rule": 4, "__text": 5, "__how": 6, "__agent": 7, "__given": 8}, {}])
def test_compress_keeps_columns_and_reads_single_blanks(spark, columns):
    d = spark.createDataFrame([("  pack   x ", "n\nkept"), ("git push", ""), (None, "/home/ann/")], "command string, raw string").select("*", *[F.lit(v).alias(k) for k, v in columns.items()])
    out = tools.compress(d, [R.Rule("p", ("pack x",), ("^n",))])
    assert out.columns == [*d.columns, "compressed", "how"]
    assert [(r["compressed"], r["how"], *(r[c] for c in columns)) for r in out.collect()] == [("kept", "rule", *columns.values()), ("ok push", "native", *columns.values()), ("/home/user/", "none", *columns.values())]


def test_whether_to_compress(spark):
    rows = [(t, c, r) for t in (True, False, None) for c in (None, "", "0", " No ", "FALSE", "1") for r in (None, "0", "yes")]
    d = spark.createDataFrame(rows, "t boolean, c string, r string").select("*", tools.should_compress(F.col("t"), F.col("c"), F.col("r")).alias("x"))
    assert all(r["x"] == (r["r"] != "yes" and (r["c"] == "1" or bool(r["t"]))) for r in d.collect())


def test_caps_footers_and_short_forms(spark):
    """What the last steps do: a policy's cap by lines or characters, Node's footer, and lines that only tell that something is done."""
    many, few = "\n".join(f"line {i} " + "x" * 400 for i in range(200)), "y" * 40_000
    d = spark.createDataFrame([("many", many), ("few", few), ("node", "a\n(node:12) [DEP0040] DeprecationWarning: x\n(Use `node --trace-deprecation ...` to show)"), ("done", "Done in 3.2s\n  success Saved lockfile"), ("some", "kept\nDone in 3 s")], "k string, t string")
    out = {r["k"]: r for r in d.select("k", T.policy_cap(F.col("t"), F.lit("other")).alias("cap"), T.policy_cap(F.col("t"), F.lit("claude_code")).alias("wide"), T.post_pass(F.col("t")).alias("post"), T.post_pass(F.col("t"), True).alias("ultra")).collect()}
    lines = out["many"]["cap"].split("\n")
    assert len(lines) == 91 and lines[60] == "... (110 lines omitted) ..." and lines[-1].startswith("line 199 ") and out["many"]["wide"] == many
    assert out["few"]["cap"] == few[:30_000] and out["few"]["wide"] == few
    assert out["node"]["post"] == "a" and out["done"]["ultra"] == "ok" and out["some"]["ultra"] == "kept" and out["some"]["post"] == "kept\nDone in 3 s"


def test_active_rules(spark, tmp_path):
    project, extension = tmp_path / "project", tmp_path / "ext" / "pack" / "rules"
    project.mkdir()
    extension.mkdir(parents=True)
    (project / "a.toml").write_text('[filter]\nname = "jest"\ncommands = ["jest"]\n')
    (extension / "a.toml").write_text('[filter]\nname = "jest"\ncommands = ["j"]\n')
    (extension / "b.toml").write_text('[filter]\nname = "mine"\ncommands = ["mine"]\nextends = "mypy"\n')
    (extension / "c.toml").write_text('[filter]\nname = "lost"\ncommands = ["lost"]\nextends = "none"\n')
    of = lambda **k: {r.name: r for r in active_rules(**k)}
    found = of(project=str(project), trusted=True, extensions=str(tmp_path / "ext"))
    assert found["jest"].source == "project" and found["mine"].head_lines == 80 and "lost" not in found and len(found) == 129
    assert of(project=str(project), extensions=str(tmp_path / "ext"))["jest"].commands == ("j",)
    assert active_rules(extensions=str(tmp_path / "none")) == active_rules() == list(library())


def test_policies_by_agent(spark):
    text = "\n".join(f"line {i} " + "x" * 400 for i in range(200))
    d = spark.createDataFrame([("pack", text, a) for a in ("claude_code", "gemini", "other", None)], "command string, raw string, who string")
    out = tools.compress(d, [R.Rule("p", ("pack",))], agent=F.col("who"), nested=False).collect()
    assert [len(r["compressed"].split("\n")) for r in out] == [200, 200, 91, 91]


def test_rules_for_the_rest_come_last(spark):
    runs = {"pnpm install": "pnpm", "pnpm dlx x": "npm-catchall", "terraform plan -x": "terraform-plan", "terraform import": "terraform-catchall", "pip list": "pip-catchall", "uv sync": "uv-sync"}
    rules = [*library(), *catchalls()]
    d = spark.createDataFrame([(c, "Requirement already satisfied: x\n  Downloading y\nInitializing the backend...\nkept") for c in runs], "command string, raw string")
    got = {r["command"]: (r["rule"], r["compressed"]) for r in R.apply_rules(R.match_rules(d, R.rule_table(spark, rules)), rules).collect()}
    assert {c: r for c, (r, _) in got.items()} == runs and all(text.endswith("kept") for _, text in got.values())
    assert got["pip list"][1] == "Initializing the backend...\nkept"
