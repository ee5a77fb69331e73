"""URL filter: host and path rules, and block decisions that redirect and canonical links carry to aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brevia.llm.common import ascii_lower, connected_components, table

#: (verdict, host, path prefix).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Rules are parts of one expression; longer lists would belong in a table.
MOST_RULES = 1000

_HOST, _PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"
#: The link of a canonical or refresh tag, in either order of attributes.
_LINKS = (
    r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)""",
    r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?([^"'\s>]+)""",
)


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What names the resource: scheme and fragment aside, with the host in lower case; null without a host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))))


def matched_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does; of equally long ones, allow first."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0], r[1], r[2]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(order):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b) nodes: each page and what its canonical link or refresh tag names, resolved against its own url."""
    html, url = F.col(html_col), F.col(url_col)
    found = F.when(
        F.coalesce(html.rlike(r"(?i)canonical|http-equiv"), F.lit(False)),
        F.concat(*[F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in _LINKS]),
    ).otherwise(F.array().cast("array<string>"))
    d = pages.select(url.alias("url"), F.explode(found).alias("link"))
    base = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    link = F.col("link")
    full = (
        F.when(link.contains("://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.lit("http:"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(base, link))
        .otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/"))), link))
    )
    return d.select(node_of(F.col("url")).alias("a"), node_of(full).alias("b")).filter("a is not null and b is not null and a <> b").distinct()


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None, rules: tuple = RULES) -> DataFrame:
    """Rows (id, url, host, path, rule, verdict, component) of each page.

    A page that a rule fits has that rule's verdict. The others share the fate of their aliases: pages and link
    targets are the nodes of a graph whose edges are redirects (optional frame with columns ``from_url`` and
    ``to_url``), canonical links and refresh tags, and within one connected component a block by rule of any
    node, page or mere target, blocks every node without a rule, unless some node there is allowed by a rule:
    explicit allows go first. Without either the verdict is allow.

    A null url, or one without ``://``, has empty host and path, fits no rule, has no aliases and is allowed. Repeated
    urls are one node. ``component`` is the least node of the component, the page's own node if it has no edges.
    Empty tables give empty results; other columns aren't looked at.
    """
    d = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    url = F.col("url")
    d = d.withColumns({"host": host_of(url), "path": path_of(url), "node": node_of(url)})
    d = d.withColumn("own", matched_rule(F.col("host"), F.col("path"), rules))
    edges = None
    if html_col is not None:
        edges = alias_edges(pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")))
    if redirects is not None:
        more = redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b"))
        edges = more if edges is None else edges.union(more)
    if edges is None:
        fate = None
    else:
        parts = connected_components(edges)
        at = F.concat(F.lit("http://"), F.col("node"))
        ruled = matched_rule(host_of(at), path_of(at), rules)["verdict"]
        fate = parts.groupBy("component").agg(F.max(F.coalesce(ruled == "allow", F.lit(False))).alias("allows"), F.max(F.coalesce(ruled == "block", F.lit(False))).alias("blocks"))
        fate = parts.join(fate, "component").select(F.col("node").alias("alias"), "component", (F.col("blocks") & ~F.col("allows")).alias("blocked"))
    if fate is None:
        d = d.withColumns({"blocked": F.lit(False), "component": F.col("node")})
    else:
        d = d.join(fate, F.col("node") == F.col("alias"), "left")
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return d.select("id", "url", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("component", "node").alias("component"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row; a url that is null or without :// has an empty host and path, fits no rule and has no aliases."""
    return filter_urls(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")
