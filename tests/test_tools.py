"""Text filters of single tools: forms that the queries leave out, odd texts and long ones."""

from brevia.operators import findings, tools
from brevia.plans import rules as R

CASES = {
    "gh run view 1": ("✓ main CI\nTriggered via push\n\nJOBS\n✓ build in 2m\n  ✓ Set up\nX test in 3m\n  ✓ Set up\n  X Run tests (5s)\n      detail\n\nANNOTATIONS\nX failed here\n", "✓ main CI\n✓ build (2m)\nX test (3m)\n  X Run tests\n\nANNOTATIONS\nX failed here\nX test (3m)"),
    "gh run view 2": ("✓ main CI\n\nJOBS\nX test in 3m\n  X Run (5s)\n✓ build in 2m\n\nANNOTATIONS\nX bad\n", "✓ main CI\nX test (3m)\n  X Run\n✓ build (2m)\n\nANNOTATIONS\nX bad"),
    "gh run list": ("STATUS  TITLE\n✓  Fix it  CI build  main  push  123  1m", "✓ Fix it (CI build)"),
    "gh issue list": ("#5  Bug in parser  bug, urgent  about 2 days ago", "#5 Bug in parser [bug]"),
    "gh pr view 1": ("title:\tHello\nstate:\tOPEN\nauthor:\tme\nreviewers:\ta\n--\nurl:\tno\n", "title: Hello\nstate: OPEN\nreviewers: a"),
    "gh issue view 1": ("title:\t" + "x" * 61 + "\nreviewers:\ta\n", "title: " + "x" * 59 + "…"),
    "git status": ("On branch main\nChanges to be committed:\n\tnew file:   a\n\nUntracked files:\n  (use \"git add <file>...\" to include in what will be committed)\n" + "".join(f"\tu{i}\n" for i in range(10, 22)), "branch: main\n\nstaged (1):\n  new file: a\n\nuntracked (12):\n" + "".join(f"  u{i}\n" for i in range(10, 20)) + "  ... +2 more"),
    "git status -v": ("On branch x\n\nUntracked files:\n  (use \"git add <file>...\" to include in what will be committed)\n\taa\n\tb c\n\nno changes added to commit (use \"git add\" and/or \"git commit -a\")\n", "branch: x\n\nuntracked (2):\n  aa\n  b c"),
    "cargo build": ("   Compiling a v1\nerror[E1]: x\n  --> f\n   Compiling b v1\n   | y\n\n   Compiling c v1\nerror: z\n   Compiling d v1\n", "   Compiling a v1\nerror[E1]: x\n  --> f\n   | y\n\n   Compiling c v1\nerror: z"),
    "tar -tvf x": ("drwxr-xr-x  0 u g 0 Jan  1 10:00 d/\n-rw-r--r--  0 u g 2048 Jan  1 10:00 d/a.py", "archive: 1 files, 1 dirs, 2.0K\n\nentries:\n  d/\n  d/a.py (2.0K)"),
    "tar -tvf y": ("\n".join(f"-rw-r--r--  0 u g {i} Jan  1 10:00 f{i}.py" for i in range(100, 151)), "archive: 51 files, 0 dirs, 6.2K\n\nby extension:\n  .py              51 files  6.2K\n\ntop files:\n" + "\n".join(f"        {i}B  f{i}.py" for i in range(150, 145, -1))),
    "openssl x509": ("Certificate:\n    Data:\n        Version: 3\n        Serial Number:\n            aa:bb\n    Signature Algorithm: sha\n        Issuer: CN=x\n        Subject Public Key Info:\n            pub:\n                04:aa:bb\n    Signature Value:\n        aa:bb\n", "Certificate:\n    Data:\n        Version: 3\n        Issuer: CN=x"),
    "kubectl describe pod x": ("Name:         x\nPriority:     0\nAnnotations:\n  a: b\nContainers:\n  web:\n    Image:  x\n    State:          Running\n    Limits:\n      cpu:  1\nConditions:\n  Type  Status\nVolumes:\n  v:\n    State: x\n", "Name: x\n  web:\n  State: Running\n  Limits:\n  cpu: 1\nConditions:\n  Type  Status"),
    "aws ec2 describe-instances": ('{"Reservations":[{"Instances":[{"InstanceId":"i-1","InstanceType":"t3","State":{"Name":"running"},"Tags":[{"Key":"Name","Value":"web"}]}]},{}]}', "INSTANCE_ID          TYPE       STATE    PUBLIC_IP      NAME\ni-1                  t3         running  -              web"),
    "npm t": (" FAIL  b.js\n  ✓ fine\n  ● bad\n\n    expect\n\nTests: 1 failed\n\nTime: 1s\n", " FAIL  b.js\n  ● bad\n\n    expect\n\nTests: 1 failed\nTime: 1s"),
    "vitest run": (" RUN  v1\n ✓ a.test.ts (2)\n ✗ b.test.ts (1)\n   ✓ x\n   Error: y\n\nTests: 1 failed", " ✗ b.test.ts (1)\n   Error: y\n\nTests: 1 failed"),
    "cargo test": ("running 1 test\n\nfailures:\n\n---- b stdout ----\npanic\n\ntest result: FAILED. 1 failed\n\nrunning 0 tests\n\ntest result: ok. 0 passed\n", "running 1 test\nfailures:\n\n---- b stdout ----\npanic\n\ntest result: FAILED. 1 failed\nrunning 0 tests\n\ntest result: ok. 0 passed"),
    "vite": ("VITE v5.0 ready in 1 ms\nVITE v5.0 ready in 2 ms\n➜  Local: x\nnoise\n10:00:00 AM [vite] hmr update x error", "VITE v5.0 ready in 1 ms\n➜  Local: x"),
    "next build": ("▲ Next.js 14\nx\nRoute (app)\n┌ ○ /\n○  (Static)", "▲ Next.js 14\nRoute (app)\n┌ ○ /\n○  (Static)"),
    "prisma migrate dev": ("Environment variables loaded\nApplying migration\nfoo\n", "Applying migration"),
    "prisma db push": ("Environment variables loaded\n" + "a\n" * 30, "\n".join("a" * 20)),
    "shellcheck a": ("In a line 3:\nx\n ^-- SC1: Q\n ^-- SC2: R\n", "a:3: SC1: Q\nSC2: R"),
    "ss -t": ("udp 0 0 a:1 b:2\nESTAB 0 0 a b", "\n(no-state) (1):\n  udp -> b:2\n\nESTAB (1):\n  tcp -> b"),
    "kubectl get pods -o json": ('{"kind":"List","items":[]}', '{\n"items":[],\n"kind":"List"\n}'),
    "kubectl get pods": ("NAME   READY   STATUS   RESTARTS   AGE\na   1/1   Running   0   5d", "NAME READY STATUS AGE\na 1/1 Running 5d"),
    "docker inspect y": ("oops", "oops"),
    "pytest": ("..\n2 passed, as it were\n", "2 passed, as it were"),
}
COMMANDS = (
    "git log|git status|git diff|gh pr list|gh pr view|gh issue list|gh issue view|gh run list|gh run view|ls|grep x|find|diff|du|df|wc|dig|lsof|ss|openssl|tar|smart|env|cargo test|npm test|vitest|tsc|vite|vite build|next"
    "|next build|prisma|prisma migrate|prisma generate|prisma validate|pytest|ruff|go test|docker ps|docker logs|docker inspect|kubectl get pods|kubectl describe|kubectl logs|terraform plan|aws|make|apt install|eslint|shellcheck|dotnet test|gradle|rspec|psql"
).split("|")
#: Filters that needn't keep a text in which they find nothing.
MAY_DROP = ("git status", "vite", "vite build", "next", "next build", "prisma migrate", "prisma generate", "prisma validate")


def test_forms_odd_and_long_texts(spark):
    """Blank texts give blank ones, texts without anything known stay, and long blocks take no stack."""
    odd = ["", "  \n\t\n", "plain words", "a\r\nb\r\n", "\n".join(["z"] * 7) + "\n", "x" * 100_000, None]
    long = {"rspec": ("Failures:\n" + "x\n" * 60_000 + "2 examples, 1 failure\n", 60_002), "git log": ("commit 0123456\n\n s\n" + " x\n" * 60_000, 2), "go test": ("--- FAIL: x\n" + " y\n" * 60_000 + "FAIL\tp\n", 60_002)}
    rows = [(c, r) for c, (r, _) in CASES.items()] + [(c, r) for c in COMMANDS for r in odd] + [(c, r) for c, (r, _) in long.items()]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, command string, raw string")
    got = {r["i"]: (r["how"], r["compressed"]) for r in tools.compress(d, agent="claude_code").collect()}
    assert len(got) == len(rows) and all(how == "native" and text is not None for how, text in got.values())
    for i, (command, raw) in enumerate(rows):
        text = got[i][1]
        if i < len(CASES):
            assert text == CASES[command][1], command
        elif i >= len(rows) - len(long):
            n = long[command][1]
            assert len(text.split("\n")) == n if n < 100 else len(text) >= 120_000, command
        elif not (raw or "").strip():
            assert text.strip() in ("", "branch:"), command
        elif raw.startswith("plain") and command not in MAY_DROP:
            assert text == raw, command


def test_rules_in_one_pass(spark):
    """Every rule's text is that of the rule alone, unknown rules keep theirs, and the runs are read once."""
    rules = [R.Rule("a", strip_patterns=("^x",), head_lines=2, empty_message="none"), R.Rule("b", max_tokens=4, dedupe=False, max_line_chars=3), R.Rule("c", tail_lines=1)]
    raws = ["x\ny\ny\ny\nz", "xx\nx", "", None, "one two\nthree\nfour five six\nseven"]
    d = spark.createDataFrame([(f"{r}{i}", r, raw) for r in ("a", "b", "c", "d", None) for i, raw in enumerate(raws)], "i string, rule string, raw string")
    out = R.apply_rules(d, rules)
    got = {r["i"]: r["compressed"] for r in out.collect()}
    for rule in rules:
        for r in R.apply_rule(d.filter(d["rule"] == rule.name), rule).collect():
            assert got[r["i"]] == r["compressed"]
    assert got["d0"] == raws[0] and got["None4"] == raws[4]
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_short_json():
    shown = findings.json_shortener()
    assert shown(None) is None and shown("{") is None and shown("NaN") is None and shown("[" * 5000) is None
    assert shown("3") == "3" and shown("[]") == "[]" and shown('"é"') == '"é"'
    many = shown("{" + ",".join(f'"k{i:02}":{i}' for i in range(40)) + "}")
    assert '"__truncated__":"…8 more keys…"' in many and '"k31":31' in many and "k32" not in many
