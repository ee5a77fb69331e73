"""Ready rules for tools without a filter of their own.

Most of what tools print on their way is of a few kinds, whatever the tool. ``NOISE`` names these kinds, once for all
rules; a rule is a line: the command lines that it is for, the kinds of noise that go, patterns that only its tool needs, and how much of the
rest stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

from brevia.plans.rules import Rule, by_precedence, extended, load_rules

#: Kinds of lines that tell a reader nothing, each with the patterns by which it is known.
NOISE: dict[str, tuple[str, ...]] = {
    "blank": (r"^\s*$",),
    "meter": (r"^\s*\d{1,3}(?:\.\d+)?%", r"\b\d{1,3}%\s*(?:[|\[]|complete|done)", r"^\s*[\[|][=#>.\- ]{4,}[\]|]"),
    "spinner": (r"^\s*[⠀-⣿]\s",),
    "ruler": (r"^\s*[-=_*~─━═]{3,}\s*$",),
    "fetch": (r"^\W*(?i:download|fetch|resolv|receiv|extract|unpack|retriev|pull|upload|collect)(?:ing|ed)\b",),
    "install": (r"^\W*(?i:install|prepar|select|updat|process|lock|link|us|build|pour|unlink|refresh)(?:ing|ed)\b", r"^\s*Setting up\b"),
    "timing": (r"^\W*(?i:done|finished|completed|built|took|time|duration|elapsed|total time)\b.*\d", r"\bin \d+(?:\.\d+)?\s?(?:ms|s|sec|seconds)\.?\s*$"),
    "notice": (r"(?i)\b(?:new|newer|latest) (?:\w+ )?version\b", r"(?i)\bto (?:update|upgrade),? run\b", r"(?i)\blooking for funding\b", r"(?i)\btelemetry\b", r"(?i)^\W*npm notice\b"),
    "deprecated": (r"(?i)\bdeprecat(?:ed|ion)\b",),
    "info": (r"^\s*\[?(?:INFO|info)\]?\b[:\s]?",),
    "debug": (r"^\s*\[?(?:DEBUG|TRACE|VERBOSE|debug|trace|verbose)\]?\b[:\s]?",),
    "passed": (r"^\s*(?:✓|✔|√|🟢)", r"^\s*(?:PASS|PASSED)\b", r"^\s*ok \d+\b"),
    "skipped": (r"^\s*(?:○|SKIP|SKIPPED|skipped)\b",),
    "layer": (r"^\s*[0-9a-f]{12}:? ", r"^(?:Digest|Status): ", r"^(?:Copying|Getting|Writing|Storing) (?:blob|config|image|manifest|signatures)"),
    "lock": (r"(?i)^(?:acquiring|releasing)\b.*\block\b",),
    "klog": (r"^[IW]\d{4} \d\d:\d\d",),
    "plan": (r"^\S+: (?:Refreshing state|Reading\.\.\.|Read complete|Still reading)", r"^\s*#.*\(\d+ unchanged .* hidden\)", r"^Refreshing\b"),
    "provider": (r"^Initializing\b", r"^- (?:Finding|Installing|Installed|Reusing|Using)\b", r"^Partner and community providers\b", r"^You may now begin\b"),
    "module": (r"^\s*(?:asset|modules by path|runtime modules|cacheable modules|orphan modules|chunk)\b",),
    "reporter": (r"^(?:Snapshots|Time|Ran all|Determining test suites|Test Files)\b",),
    "quiet": (r"(?i)^\W*(?:success|all (?:checks|files|good)|no issues found|no problems|everything is up.to.date)\b",),
}


def _runners(tool: str, *others: str) -> str:
    """A script's name alone and behind what starts scripts."""
    return ", ".join([tool, *[f"{r} {tool}" for r in ("npx", "yarn", "pnpm")], *others])


def _lines() -> Iterator[tuple]:
    """(name, beginnings, kinds of noise, own patterns, first lines, last lines, width, message when nothing is left).

    Names, beginnings, numbers and messages are fixed values: what is kept of a run depends on them.
    """
    # JavaScript: packages, tests, bundles, formats
    yield "ava", _runners("ava"), "blank passed spinner", (), 4, 5, None, "ok"
    yield "bun", "bun install, bun i, bun add, bun update, bun remove, bun run", "blank fetch install notice", (r"^bun (?:install|add|update|remove) v", r"^Saved lockfile", r"^\$ "), 5, 5, None, "ok"
    yield "bunx", "bunx", "blank fetch notice passed", (r"^Resolving dependencies", r"^Saved lockfile", r"^\[\d+(?:\.\d+)?ms\]", r"^Checking formatting"), 5, 5, None, "ok"
    yield "cypress", ", ".join(f"{r}cypress run" for r in ("", "npx ", "yarn ", "pnpm ")), "blank ruler passed timing", (r"^\s*[│┌└├]", r"^\s*\((?:Run Starting|Run Finished|Results|Screenshots|Video)\)", r"^\s*-\s+(?:Started|Finished) (?:processing|compressing)", r"^\s*(?:Running|DevTools|Opening):?\b"), 5, 5, None, "ok"
    yield "deno", "deno task, deno run, deno test, deno bench, deno fmt, deno lint, deno cache", "blank fetch", (r"^(?:Check|Download|Task|Initialize) ", r"\.\.\. .*ok.* \(\d+m?s\)$", r"^running \d+ tests? from"), 5, 8, None, "ok"
    yield "esbuild", _runners("esbuild"), "", (), 5, 5, None, "ok"
    yield "jest", _runners("jest", "bun jest"), "blank passed reporter", (r"^Test Suites:\s+\d+ passed, \d+ total$", r"^No tests found", r"^\s+at \S+ \(node_modules/"), 8, 8, None, "ok"
    yield "mocha", _runners("mocha"), "blank passed", (r"^\s+at .*node_modules",), 5, 8, None, "ok"
    yield "npx", "npx", "notice deprecated", (r"^Need to install the following packages", r"^Ok to proceed", r"^npm warn exec"), 5, 5, None, "ok"
    yield "nx", "nx, pnpm nx", "blank ruler passed timing", (r"^\s*> nx run\b.*\[(?:local|remote) cache\]", r"^\s*NX\s+(?:Running|Successfully)", r"\[existing outputs match the cache", r"^> \S+@\S+ "), 60, None, 150, None
    yield "oxlint", "oxlint", "blank timing quiet", (r"^Found 0 warnings",), 50, None, None, "oxlint: ok"
    yield "parcel", _runners("parcel"), "blank spinner", (r"^(?:Building|Bundling|Packaging|Optimizing)\.\.\.",), 5, 5, None, "ok"
    yield "playwright", ", ".join(f"{r}playwright test" for r in ("", "npx ", "yarn ", "pnpm ")), "blank passed skipped", (r"^Running \d+ tests? using", r"^\s*(?:To open last HTML report|Serving HTML report)", r"^\s+npx playwright show-report", r"^\s*\d+ passed \("), 5, 8, None, "ok"
    yield "pnpm", "pnpm install, pnpm i, pnpm add, pnpm update, pnpm up", "blank fetch timing notice deprecated", (r"^Progress: resolved", r"^Packages: [+-]\d+", r"^[+-]+$", r"^Lockfile is up to date", r"^Already up to date", r"^Scope: ", r"^(?:dependencies|devDependencies|optionalDependencies):$", r"^\s*[╭│╰]"), 25, 8, None, "ok"
    yield "prettier", _runners("prettier", "bunx prettier"), "", (r"\d+ms(?: \(unchanged\))?$",), 5, 5, None, "ok"
    yield "rollup", _runners("rollup"), "blank", (r"^\S+ → \S+\.\.\.$",), 4, 4, None, "ok"
    yield "swc", _runners("swc"), "blank", (r"^Successfully compiled",), 4, 4, None, "ok"
    yield "tsup", _runners("tsup"), "blank", (r"^(?:CLI|ESM|CJS|DTS|IIFE) (?:Building|Using|Target|tsup|Cleaning|Build start)", r"^(?:ESM|CJS|DTS|IIFE) .*\d+(?:\.\d+)? [KM]?B$"), 5, 8, None, "ok"
    yield "turbo", "turbo", "blank timing", (r"^\S+: cache (?:hit|miss|bypass)", r"^• (?:Packages in scope|Running|Remote caching)", r"^\S+: > ", r"^\s*(?:Tasks|Cached):\s"), 50, None, 150, "turbo: ok"
    yield "webpack", _runners("webpack"), "blank module timing", (r"^webpack \d+\.\d+\.\d+ compiled successfully", r"^\s*\./\S+ \d+(?:\.\d+)? (?:bytes|KiB)"), 8, 5, None, "ok"
    yield "yarn", "yarn, yarn install, yarn add, yarn remove, yarn upgrade, yarn up", "blank fetch timing notice", (r"^yarn (?:install|add|run|upgrade|remove) v", r"^\[\d+/\d+\]", r"^(?:info|success|\$) ?", r"^➤ YN0000: [┌└·]", r"^➤ YN00(?:13|19|07):"), 8, 5, None, "ok"
    yield "biome", "biome", "blank quiet", (r"^Checked \d+ files? in", r"^No fixes applied", r"^Formatted \d+ files?", r"^Found 0 "), 50, None, None, "biome: ok"
    yield "format", "format", "blank meter timing", (r"^(?:Reading|Checking|unchanged|formatted) ",), 4, 4, None, "format: no diffs"
    yield "markdownlint", "markdownlint", "blank", (), 50, None, 120, None
    yield "shopify-theme", "shopify theme push, shopify theme pull", "blank meter", (r"^\s*(?:Uploading|Downloading|Syncing) ",), 15, 5, None, "shopify theme: ok"
    # Python
    yield "bandit", "bandit", "blank ruler info debug", (r"^Run started:", r"^Test results:", r"^\s*No issues identified"), 60, 15, 300, None
    yield "basedpyright", "basedpyright", "blank", (r"^(?:No configuration file|Assuming Python|Searching for source|Found \d+ source|basedpyright \d)", r"^0 errors, 0 warnings"), 50, None, None, "basedpyright: ok"
    yield "black", "black", "blank debug", (r"^(?:reformatted|would reformat|Identified|Found input|Using configuration|Sources to be) ", r"^All done!", r"already well formatted"), 20, 5, 140, None
    yield "flake8", "flake8", "blank", (), 80, 5, 250, None
    yield "mypy", "mypy", "blank quiet", (r"^(?:Building|Searching|Loading|Type.checking)\b", r"^LOG: ", r"^Success: no issues"), 80, 5, 300, None
    yield "poetry-install", "poetry install, poetry lock, poetry update", "blank fetch", (r"^\s*[-•] (?:Installing|Updating|Downgrading|Removing) ", r"^(?:Installing dependencies|Updating dependencies|Writing lock file)", r"^Creating virtualenv", r"^Package operations:"), 20, None, None, None
    yield "pre-commit", "pre-commit", "blank", (r"\.{3,}(?:Passed|\(no files to check\)Skipped|Skipped)$", r"^\[INFO\]", r"^- (?:hook id|duration):"), 40, None, None, None
    yield "ty", "ty", "blank quiet", (r"^(?:Checking|All checks passed)",), 50, None, None, "ty: ok"
    yield "uv-sync", "uv sync, uv pip install", "blank", (r"^(?:Resolved|Prepared|Audited|Installed|Uninstalled|Built|Downloaded) \d+ packages?", r"^ [+~-] \S+==", r"^(?:Using (?:CPython|Python)|Creating virtual)"), 20, None, None, None
    yield "yamllint", "yamllint", "blank", (), 50, None, 120, None
    yield "semgrep", "semgrep", "blank ruler notice", (r"^\s*[│┌└├]", r"^\s*(?:Scan Status|Scanning \d+|Language\s+Rules|Loading rules|Ran \d+ rules)", r"^\s*✅"), 60, 15, 300, None
    yield "quarto-render", "quarto render", "blank meter", (r"^(?:pandoc|metadata|Executing|Starting|processing file|Rendering)\b", r"^\s+(?:to|output-file|standalone|section-divs|html-math-method|toc|title|format):", r"^\s*Cell \d+/\d+"), 20, None, None, None
    # Ruby, PHP, Elixir, Swift, C, JVM, .NET, Rust
    yield "bundle-install", "bundle install, bundle update", "blank", (r"^Using \S+ \d", r"^(?:Fetching|Resolving|Installing) ", r"^Bundle complete!|^Use `bundle info"), 20, None, None, None
    yield "composer-install", "composer install, composer update, composer require", "blank", (r"^\s+- (?:Downloading|Installing|Locking|Upgrading|Removing) ", r"^(?:Loading composer|Updating dependencies|Installing dependencies|Lock file|Package operations|Generating|Writing lock)", r"^\d+ packages? you are using", r"^Use the `composer fund`"), 20, None, None, None
    yield "mix-compile", "mix compile", "blank", (r"^==> ", r"^(?:Compiling \d+ files?|Generated) "), 40, None, None, "mix compile: ok"
    yield "mix-format", "mix format", "", (), 20, None, None, "mix format: ok"
    yield "swift-build", "swift build", "blank", (r"^\[\d+/\d+\] (?:Compiling|Linking|Emitting|Write|Wrapping)", r"^(?:Fetching|Fetched|Computing|Computed|Creating|Building for|Working copy|Build complete)"), 40, None, None, None
    yield "xcodebuild", "xcodebuild", "blank timing", (r"^(?:CompileC|CompileSwift|SwiftCompile|SwiftDriver|Ld|Libtool|CpResource|CopySwiftLibs|CopyPlistFile|ProcessInfoPlistFile|ProcessPCH|PhaseScriptExecution|CodeSign|Touch|MkDir|CreateBuildDirectory|RegisterExecutionPolicyException|Validate|WriteAuxiliaryFile|GenerateDSYMFile|EmitSwiftModule|RegisterWithLaunchServices|ProcessProductPackaging|ClangStatCache|CreateUniversalBinary)\b", r"^\s{4,}(?:cd|export|builtin-|/usr/|/Applications/|write-file|setenv) ?", r"^(?:Command line invocation|User defaults|Build settings|Build description|note: )", r"^Test (?:Case|Suite) .*(?:started|passed)", r"^\*\* (?:BUILD|TEST) SUCCEEDED \*\*"), 60, None, None, "xcodebuild: ok"
    yield "gcc", "gcc, g++", "blank", (r"^In file included from", r"^\s+from ", r"^compilation terminated", r"^\s*\d+ (?:warning|error)s? generated", r"^\s*\|\s*[~^]+\s*$"), 50, None, None, "gcc: ok"
    yield "make", "make", "blank", (r"^make(?:\[\d+\])?: (?:Entering|Leaving) directory", r"^make(?:\[\d+\])?: Nothing to be done"), 50, None, None, "make: ok"
    yield "gradle", "gradle, gradlew, ./gradlew", "blank fetch notice", (r"^> Task \S+(?: UP-TO-DATE| NO-SOURCE| FROM-CACHE| SKIPPED)?$", r"^> (?:Configure|Transform) ", r"^(?:Starting a Gradle Daemon|Reusing configuration cache|Calculating task graph|Configuration cache entry|Welcome to Gradle)", r"^\d+ actionable tasks?:", r"^BUILD SUCCESSFUL", r"^Here are the highlights|^ - |^For more details see"), 50, None, 150, "gradle: ok"
    yield "mvn-build", "mvn compile, mvn package, mvn clean, mvn install", "blank ruler fetch", (r"^\[INFO\]\s*$", r"^\[INFO\] (?:-+|Scanning|Building|Reactor|Finished|Total time|Download|Nothing to compile|Copying|Using|skip)", r"^\[INFO\] --- ", r"^\[INFO\] BUILD SUCCESS", r"^Progress \("), 50, None, None, "mvn: ok"
    yield "spring-boot", "mvn spring-boot:run, gradle bootRun", "blank", (r"^\s*[.'|/\\_(): =]+(?:Spring Boot.*)?$", r"^\[INFO\]", r"\s(?:INFO|DEBUG) \d+ ---"), 20, None, None, None
    yield "dotnet-build", "dotnet build", "blank timing", (r"^\s*(?:Determining projects|All projects are up-to-date|Restored )", r"^\s+\S+ -> ", r"^MSBuild version"), 40, None, None, None
    yield "cargo-bench", "cargo bench", "blank", (r"^\s*(?:Compiling|Downloading|Downloaded|Updating|Running|Finished) ", r"^(?:Gnuplot not found|Benchmarking .*: (?:Warming|Collecting|Analyzing))", r"^test .* \.\.\. ignored$"), 40, None, None, None
    yield "cargo-fmt", "cargo fmt", "", (), None, None, None, "ok"
    yield "pio-run", "pio run", "blank ruler", (r"^(?:Processing|Verbose mode|CONFIGURATION|PLATFORM|HARDWARE|DEBUG|PACKAGES|LDF|LIBRARIES|Dependency|Scanning|Found \d+ compatible)\b", r"^\s*- (?:framework|tool|toolchain)", r"^(?:Compiling|Archiving|Indexing|Linking|Building|Retrieving|Checking size) ", r"^(?:RAM|Flash|Advanced Memory)", r"^=+ \[SUCCESS\]"), 20, None, None, "pio run: ok"
    yield "trunk-build", "trunk build", "blank timing info", (r"^\s*(?:Compiling|Finished|Downloaded|Downloading) ", r"\b(?:starting build|fetching cargo artifacts|applying new distribution|success)\b"), 20, 5, None, "trunk build: ok"
    # tasks
    yield "act", "act", "blank", (r"^\[[^\]]+\]\s+(?:🚀|🐳|⭐|✅|🏁|☁)", r"^\[[^\]]+\]\s+\| (?:Downloading|Unpacking|Get:)"), 60, 20, 300, None
    yield "just", "just", "blank", (r"^\s*#", r"^===> "), 50, None, 150, None
    yield "mise", "mise run, mise exec, mise install, mise upgrade", "blank fetch install timing", (r"^mise \S+\s+(?:install|download|extract|checksum|✓)", r"^\[\S+\] \$ "), 50, None, 150, "mise: ok"
    yield "task", "task", "blank", (r"^task: \[[^\]]+\] ", r"^task: Task .* is up to date"), 50, None, 150, "task: ok"
    # containers and clusters
    yield "argocd", "argocd app, argocd cluster, argocd repo, argocd login", "blank ruler", (r"^(?:Project|Server|Namespace|URL|Source|SyncWindow|Sync Policy|Repo|Target|Path|Helm Values|Health Status):?\s", r"^- (?:Repo|Target|Path):", r"^GROUP\s+KIND", r"\bSynced\b.*\b(?:Healthy|Running)?\b.*(?:unchanged|configured|created)?$"), 5, 5, None, "ok"
    yield "buildah", "buildah bud, buildah build, buildah from, buildah commit, buildah pull", "blank layer fetch", (r"^Trying to pull", r"^--> ", r"^COMMIT "), 6, 8, None, "ok"
    yield "cosign", "cosign verify, cosign sign, cosign attest, cosign tree, cosign clean", "blank", (r"^\s+- ", r"^The following checks were performed", r"^Verification for "), 8, 5, None, "ok"
    yield "crane", "crane manifest, crane ls, crane digest, crane pull, crane push", "", (), 30, 10, None, "ok"
    yield "flux", "flux get, flux check, flux reconcile, flux suspend, flux resume", "blank passed", (r"^[►◎✚] ", r"\bTrue\s+(?:stored artifact|Applied revision|Helm install succeeded|Release reconciliation)", r"\bFalse\s+True\s+"), 8, 5, None, "ok"
    yield "helm", "helm", "blank klog", (r"^(?:---|# Source:)",), 40, None, 120, None
    yield "kustomize", "kustomize build, kustomize edit, kustomize create, kubectl kustomize", "blank", (r"^---$", r"^\s+(?:creationTimestamp: null|app\.kubernetes\.io/)"), 30, 10, None, "ok"
    yield "podman", "podman ps, podman build, podman pull, podman push, podman run, podman images, podman logs", "blank fetch", (r"^(?:Trying to pull|Getting image source|Copying (?:blob|config)|Writing manifest|Storing signatures)", r"^--> ", r"^STEP \d+/\d+: (?:LABEL|ENV|WORKDIR|EXPOSE)"), 5, 5, None, "ok"
    yield "skaffold", "skaffold dev, skaffold run, skaffold build, skaffold deploy, skaffold delete", "blank layer fetch", (r"^(?:Generating tags|Checking cache|Tags used|Starting (?:build|deploy|test)|Building \[|Listing files|Loading images|Watching for changes|Press Ctrl)", r"^ - \S+ -> ", r"^\s*- \S+: (?:Not found|Found)", r"^(?:Sending build context|Step \d+/\d+|#\d+ )", r"^ ---> ", r"^\s+- (?:deployment|service|configmap)\S* (?:created|configured|unchanged)", r"^Waiting for deployments|^Deployments stabilized"), 5, 5, None, "ok"
    yield "skopeo", "skopeo", "blank layer", (r"^time=.* level=(?:debug|info)", r"^Getting image source"), 20, None, 120, "skopeo: ok"
    yield "tilt", "tilt up, tilt down, tilt ci, tilt args", "blank", (r"^(?:Tilt started|v\d+\.\d+|\(space\)|\(s\)|\(t\)|\(ctrl)", r"│ (?:Initial Build|STEP|\s+Building|\s+\[|#\d+)", r"^(?:Opening browser|Loading Tiltfile|Successfully loaded)", r"│\s*$"), 10, 5, None, "ok"
    # infrastructure
    yield "ansible-playbook", "ansible-playbook", "blank", (r"^ok: \[", r"^skipping: \[", r"^(?:TASK|PLAY) \[.*\] \*+$"), 60, None, None, None
    yield "checkov", "checkov", "blank meter", (r"^\s*[_|\\/ ]+$", r"^By \S+\.io", r"^\tPASSED for resource", r"^\s+Guide:", r"^Update available"), 80, 20, 300, None
    yield "gcloud", "gcloud", "blank", (), 20, None, 120, None
    yield "terraform-plan", "terraform plan", "blank lock plan", (r"^Terraform used the selected providers",), 80, None, None, "terraform plan: no changes detected"
    yield "tofu-fmt", "tofu fmt", "", (), 20, None, None, "tofu fmt: ok (no changes)"
    yield "tofu-init", "tofu init", "blank provider", (r"^OpenTofu has (?:been successfully initialized|created a lock file)", r"^(?:Include this file|so that OpenTofu|you run \"tofu)", r"^(?:If you ever set|rerun this command|commands will detect)", r"^selections "), 20, None, None, "tofu init: ok"
    yield "tofu-plan", "tofu plan", "blank lock plan", (r"^OpenTofu used the selected providers",), 80, None, None, "tofu plan: no changes detected"
    yield "tofu-validate", "tofu validate", "blank", (r"^Success! The configuration is valid",), 20, None, None, "tofu validate: ok"
    yield "vault", "vault", "blank", (r"^-+\s+-+$", r"^Key\s+Value$"), 20, 5, 140, None
    yield "sops", "sops", "blank", (), 40, None, None, None
    yield "step", "step", "blank", (), 40, 5, 140, None
    # scanners
    yield "gitleaks", "gitleaks", "blank", (r"^\s*[○│╲░ ]+$", r"\b(?:INF|DBG)\b (?:scan|\d+ commits)", r"gitleaks$"), 60, 15, 300, None
    yield "grype", "grype", "blank passed", (r"^\s*(?:├──|└──)",), 60, 15, 300, None
    yield "hadolint", "hadolint", "blank", (), 40, None, 120, None
    yield "shellcheck", "shellcheck", "blank", (), 50, None, None, None
    yield "snyk", "snyk", "blank ruler passed", (r"^(?:Testing|Organization|Package manager|Target file|Project name|Open source|Docker image|Licenses):?\s", r"^Run `snyk (?:wizard|monitor)"), 60, 15, 300, None
    yield "tfsec", "tfsec", "blank ruler", (r"^\s*(?:timings|counts|results)$", r"^\s*(?:disk i/o|parsing|adaptation|checks|total|modules (?:downloaded|processed)|blocks processed|files read)\s", r"^\s*More Information", r"^\s*- https?://", r"^\s*(?:passed|ignored)\s+\d+"), 80, 15, 300, None
    yield "trivy", "trivy", "blank", (r"\bINFO\b", r"^\s*[├└─┼┬┴┤┌┐│]+[─┼┬┴├┤┌┐└┘]+$", r"^For OSS Maintainers|^This scan"), 80, 20, 300, None
    # version control and forges
    yield "glab", "glab", "blank", (r"^Showing \d+ .* on ",), 20, None, 140, None
    yield "jira", "jira", "blank ruler", (), 40, None, 120, None
    yield "jj", "jj", "blank", (r"^Working copy\s+\(?(?:now|@)", r"^Parent commit\s+"), 20, None, 120, None
    yield "yadm", "yadm", "blank", (r"^\s+\(use \"", r"^(?:remote: )?(?:Enumerating|Counting|Compressing|Writing) objects:"), 40, None, 120, None
    # text and data tools
    yield "awk", "awk, gawk, mawk, nawk", "", (), 80, 20, 300, None
    yield "dasel", "dasel", "blank", (), 40, None, 140, None
    yield "jq", "jq", "blank", (), 40, None, 120, None
    yield "sed", "sed", "", (), 80, 20, 300, None
    yield "sort", "sort", "blank", (), 50, 5, 140, None
    yield "uniq", "uniq", "blank", (), 50, 5, 140, None
    yield "yq", "yq", "blank", (), 40, None, 140, None
    # the system
    yield "df", "df", "", (), 20, None, 80, None
    yield "dmesg", "dmesg", "blank", (), None, 50, 300, None
    yield "du", "du", "blank", (), 40, None, 120, None
    yield "eza", "eza, exa", "blank", (r"^total \d",), 40, None, 140, None
    yield "fail2ban-client", "fail2ban-client", "blank", (), 20, None, None, None
    yield "htop", "htop", "blank", (), 40, None, 140, None
    yield "iptables", "iptables", "blank", (r"^Chain \S+ \(policy ACCEPT\)$", r"^(?:target|num)\s+(?:prot|target)\s"), 50, None, 120, None
    yield "journalctl", "journalctl", "blank", (r"^-- (?:Logs begin|Journal begins|Boot|No entries)", r"systemd\[\d+\]: (?:Starting|Started|Stopping|Stopped|Reached|Finished) ", r"session (?:opened|closed) for user"), None, 50, 300, None
    yield "ps", "ps", "", (), 20, None, 120, None
    yield "stat", "stat", "blank", (r"^\s*Birth:", r"^\s*(?:Device|Context):"), 20, None, 120, None
    yield "sysctl", "sysctl", "blank", (), 40, 5, 300, None
    yield "systemctl-status", "systemctl status", "blank", (), 20, None, None, None
    yield "top", "top, btm, btop", "blank", (r"^top - ", r"^(?:Tasks|Threads|%?Cpu\(?s?\)?|[KMG]iB (?:Mem|Swap)|Mem|Swap|Processes|Load Avg|CPU usage|SharedLibs|MemRegions|PhysMem|VM|Networks|Disks)\s*:"), 20, None, 140, None
    yield "tree", "tree", "blank", (), 60, 5, 140, None
    # archives and copies
    yield "7z", "7z, 7zz, 7za", "blank ruler", (r"^7-Zip", r"^(?:Scanning the drive|Extracting archive|Open archive|Creating archive|Updating archive|Path = |Type = |Physical Size|Headers Size|Method = |Solid = |Blocks = )", r"^\s*\d+% "), 20, 8, 140, None
    yield "rsync", "rsync", "blank", (r"^(?:sending|receiving) incremental file list", r"^\s+[\d,]+\s+\d+%"), 20, None, None, None
    yield "unzip", "unzip", "blank ruler", (r"^\s*(?:inflating|extracting|creating|linking): ", r"^Archive: ", r"^\s*Length\s+(?:Date|Method)"), 20, 5, 140, None
    yield "zip", "zip", "blank", (r"^\s*(?:adding|updating|freshening|deleting): .*\((?:stored 0%|deflated \d+%)\)$", r"^zip warning: name not matched", r"^\s*\[\d+%\]"), 20, 5, 140, None
    # networks
    yield "grpcurl", "grpcurl", "blank", (), 40, None, 140, None
    yield "httpie", "http, https, httpie", "blank", (r"^(?i:date|server|connection|keep-alive|vary|cache-control|etag|expires|age|via|x-[\w-]+|strict-transport-security|access-control-[\w-]+|content-security-policy|set-cookie|transfer-encoding|alt-svc):\s",), 60, 5, 300, None
    yield "ip", "ip addr, ip link, ip route, ip a, ip l, ip r, ip -s", "blank", (r"^\s+valid_lft ", r"^\s+link/(?:loopback|none)", r"^\s+(?:RX|TX):? "), 40, None, 140, None
    yield "mtr", "mtr", "blank", (r"^Start: ", r"^HOST: "), None, 30, 140, None
    yield "nslookup", "nslookup", "blank", (r"^(?:Server|Address):\s+\S+#?\d*$", r"^Non-authoritative answer", r"^Authoritative answers"), 20, None, 140, None
    yield "ping", "ping", "blank", (r"^PING ", r"^\d+ bytes from ", r"^(?:64 bytes|Reply from) ", r"^--- .* ---$"), None, 4, None, None
    yield "ssh", "ssh", "blank", (r"^debug\d: ", r"^(?:Warning: Permanently added|OpenSSH_|Authenticated to|Last login:|The authenticity of host)", r"^\s*\*\s", r"^(?:Pseudo-terminal|Welcome to )", r"^Connection to \S+ closed"), 200, None, 120, None
    yield "traceroute", "traceroute, tracepath, tracert", "blank", (r"^traceroute to ",), 20, None, 140, None
    yield "wget", "wget", "blank meter", (r"^--\d{4}-\d\d-\d\d", r"^(?:Resolving|Connecting to|Reusing existing|HTTP request sent|Length:|Saving to:|Proxy request|Location:)", r"^\s*\d+K[ .,]"), None, 5, 140, None
    # keys and certificates
    yield "gpg", "gpg, gpg2", "blank", (r"^gpg: (?:checking the trustdb|marginals needed|depth:|next trustdb check|keybox|using)", r"^-+$"), 20, 5, 140, None
    yield "keytool", "keytool", "blank ruler", (r"^\s*(?:[0-9A-F]{2}:){8}", r"^\*+$", r"^Warning:$"), 40, 5, 140, None
    # others
    yield "brew-install", "brew install, brew upgrade, brew reinstall", "blank meter install", (r"^==> (?:Downloading|Fetching|Pouring|Installing|Auto-updat|Updating|Caveats|Summary|Upgrading|Running|Cleaning)", r"^#+\s", r"^Already downloaded:", r"^(?:Disable this behaviour|Hide these hints)"), 20, None, None, "brew: ok"
    yield "ollama", "ollama run", "spinner", (r"^(?:pulling|verifying|writing|success)\b",), None, None, None, None


def _rest() -> Iterator[tuple]:
    """As ``_lines``, for whatever else tools with filters or rules of their own for some commands print."""
    yield "apt-catchall", "apt, apt-get", "blank fetch install meter", (r"^(?:Get|Hit|Ign):\d+ ", r"^(?:Reading|Building) (?:package|dependency|state)", r"^WARNING: apt does not have a stable"), 20, 5, 140, "apt: ok"
    yield "brew-catchall", "brew", "blank fetch install meter", (r"^==> (?:Downloading|Fetching|Pouring|Auto-updat|Updated)", r"^#+\s"), 20, 5, 140, "brew: ok"
    yield "cargo-catchall", "cargo", "blank timing", (r"^\s*(?:Compiling|Checking|Downloading|Downloaded|Updating|Fresh|Locking|Adding|Blocking|Running|Finished|Packaging|Verifying) ",), 20, 5, 140, "cargo: ok"
    yield "docker-catchall", "docker, podman", "blank layer fetch", (r"^#\d+ (?:DONE|CACHED|extracting|sha256:|transferring)", r"^(?:Using default tag|Sending build context)", r"^ ---> "), 20, 5, 140, "docker: ok"
    yield "dotnet-catchall", "dotnet", "blank timing", (r"^\s*(?:Determining projects|All projects are up-to-date|Restored|Welcome to \.NET)", r"^MSBuild version"), 20, 5, 140, "dotnet: ok"
    yield "gh-catchall", "gh", "blank notice", (r"^Showing \d+ of \d+",), 20, 5, 140, None
    yield "go-catchall", "go", "blank", (r"^go: (?:downloading|finding|extracting|found) ",), 20, 5, 140, "go: ok"
    yield "kubectl-catchall", "kubectl, k", "blank klog", (r"^Warning: .* is deprecated", r"^\s+(?:uid|resourceVersion|creationTimestamp|generation): "), 40, 5, 140, "kubectl: ok"
    yield "npm-catchall", "npm, pnpm, yarn, bun", "blank fetch timing notice deprecated spinner", (r"^npm (?:warn|info|http)\b", r"^> \S+@\S+ ", r"^Progress: resolved"), 20, 5, 140, "ok"
    yield "pip-catchall", "pip, pip3, uv", "blank fetch meter notice", (r"^\s*(?:Requirement already satisfied|Using cached|Preparing metadata|Building wheel|Created wheel|Stored in directory|Attempting uninstall)", r"^(?:Resolved|Prepared|Audited) \d+ packages?"), 20, 5, 140, "pip: ok"
    yield "redis-catchall", "redis-cli", "blank", (r"^# \w+$",), 20, 5, 140, None
    yield "terraform-catchall", "terraform, tf, tofu", "blank provider lock", (r"^(?:Terraform|OpenTofu) has (?:been successfully initialized|created a lock file)",), 20, 5, 140, "terraform: ok"


def _rules(lines: Iterator[tuple]) -> tuple[Rule, ...]:
    out = []
    for name, beginnings, kinds, own, head, tail, width, message in lines:
        patterns = tuple(p for k in kinds.split() for p in NOISE[k]) + own
        out.append(Rule(name, tuple(beginnings.split(", ")), patterns, head, tail, width, empty_message=message))
    return tuple(out)


@lru_cache(maxsize=1)
def library() -> tuple[Rule, ...]:
    """The rules that count by default, built-in ones, in order of the list above."""
    return _rules(_lines())


@lru_cache(maxsize=1)
def catchalls() -> tuple[Rule, ...]:
    """Rules for the rest of what twelve families of tools print. They don't count by default; give them after those of ``library``."""
    return _rules(_rest())


def extension_rules(folder: str) -> list[Rule]:
    """Rules of all extensions below a folder, each in its subfolder ``rules``; none if there is no such folder."""
    return [r for path in sorted(Path(folder).glob("*/rules")) if path.is_dir() for r in load_rules(str(path), "extension")]


def active_rules(project: str | None = None, trusted: bool = False, extensions: str | None = None) -> list[Rule]:
    """The rules that count: a project's, if it is trusted, then those of extensions, then the library's, less those whose name came before.

    Rules that extend one that there isn't are left out.
    """
    found = [*(load_rules(project, "project", trusted) if project else ()), *(extension_rules(extensions) if extensions else ()), *library()]
    names = {r.name for r in found}
    return by_precedence(extended(r for r in found if r.extends is None or r.extends in names))
