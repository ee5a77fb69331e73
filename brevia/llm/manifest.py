"""Merkle manifest of a dataset: tries over exact ranks, reduced by prefixes of the ranks' digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brevia.llm.common import cut, table

#: Children of a node, at most.
FANOUT = 3
#: Digits of a rank that one pass reduces: FANOUT ** STRIDE nodes at most meet in one row.
STRIDE = 5
#: Bits of an id that one histogram tells apart, and so the ids among which a window ranks.
DIGIT = 8
#: What a document's leaf is made from, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Stands for a null's digits: less than those of any id, and so are its own prefixes.
_NULL = -(1 << 62)
#: Rows of one list of copies that are made again at once.
_COPIES = 1_000
_PATH = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that fields can't run into each other; ``-`` for a null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def folded(node: Column, path: Column) -> Column:
    """What a node comes to at the end of a path of siblings; the root, if node and path are as the manifest has them."""
    return F.aggregate(path, node, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))


def siblings_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def levels_above(n: Column) -> Column:
    """How many levels are above n nodes."""
    powers = [FANOUT**i for i in range(40)]  # up to 2 ** 62
    return F.size(F.filter(F.array(*map(F.lit, powers)), lambda p: p < n))


def _runs(nodes: Column) -> Column:
    """The nodes of the level above."""
    starts = F.sequence(F.lit(0), ((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FANOUT + 1, F.lit(FANOUT)), ""), 256))


def _levels(nodes: Column, up: Column) -> Column:
    """Arrays of nodes, level by level: these, and ``up`` levels above."""
    steps = F.filter(F.sequence(F.lit(1), F.lit(STRIDE)), lambda s: s <= up)
    return F.aggregate(steps, F.array(nodes), lambda acc, _: F.concat(acc, F.array(_runs(F.element_at(acc, -1)))))


def _siblings(levels: Column, i: Column) -> Column:
    """The rest of the run of node i's ancestor, left and right of it as text, for each level but the last."""

    def of(nodes: Column, level: Column) -> Column:
        at = F.floor(i / F.pow(F.lit(float(FANOUT)), level)).cast("int")  # less than FANOUT ** STRIDE, so exact
        turn = at % FANOUT
        left = F.slice(nodes, at - turn + 1, turn)
        right = F.slice(nodes, at + 2, F.lit(FANOUT - 1) - turn)
        return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), of)


def ranked(rows: DataFrame) -> DataFrame:
    """(tree, item, node, rank, of) from (tree, key, node, item): places from 0 in order of key, a long with nulls first, and rows of the tree.

    Nothing is sorted as a whole. A histogram counts rows by all digits of their key but the last, of DIGIT bits; others, of one digit
    fewer each, add up the one below. On the way down, sums over the digits below one prefix, 2 ** DIGIT counts at most, give
    what lies before each prefix, and rows that share the longest prefix are put in order by a window.

    More rows than there are last digits share a prefix only where keys repeat. Such rows go by node among one key, are counted and parted
    further by the node's first digits, and rows that are equal are one row with a count till they have their ranks.
    """
    low, high = rows.agg(F.min("key"), F.max("key")).first()
    bits = [DIGIT]
    while low is not None and (high >> bits[-1]) - (low >> bits[-1]) >= 1 << DIGIT:
        bits.append(bits[-1] + DIGIT)
    rows = rows.withColumn("p0", F.coalesce(F.shiftright("key", DIGIT), F.lit(_NULL)))
    counts = [cut(rows.groupBy("tree", "p0").agg(F.count("*").alias("n")))]
    for i in range(1, len(bits)):
        up = F.shiftright(f"p{i - 1}", DIGIT).alias(f"p{i}")
        counts.append(counts[-1].groupBy("tree", up).agg(F.sum("n").alias("n")))
    last = len(bits) - 1
    upto = F.sum("n").over(Window.partitionBy("tree").orderBy(f"p{last}"))
    below = counts[last].select("tree", f"p{last}", "n", (upto - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("tree")).alias("of"))
    for i in range(last - 1, -1, -1):
        d = counts[i].withColumn(f"p{i + 1}", F.shiftright(f"p{i}", DIGIT))
        upto = F.sum("n").over(Window.partitionBy("tree", f"p{i + 1}").orderBy(f"p{i}"))
        d = d.withColumn("within", upto - F.col("n")).join(below.drop("n"), ["tree", f"p{i + 1}"])
        below = d.select("tree", f"p{i}", "n", (F.col("before") + F.col("within")).alias("before"), "of")
    below = cut(below)
    d = rows.join(below, ["tree", "p0"])
    place = F.row_number().over(Window.partitionBy("tree", "p0").orderBy("key", "node")) - 1
    few = d.filter(F.col("n") <= 1 << DIGIT).select("tree", "item", "node", (F.col("before") + place).alias("rank"), "of")
    if below.filter(F.col("n") > 1 << DIGIT).isEmpty():
        return few
    many = d.filter(F.col("n") > 1 << DIGIT).withColumns({"key": F.coalesce("key", F.lit(0)), "part": F.substring("node", 1, 2)})
    many = cut(many.groupBy("tree", "p0", "key", "part", "item", "node", "before", "of").agg(F.count("*").alias("copies")))
    parts = many.groupBy("tree", "p0", "key", "part").agg(F.sum("copies").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("tree", "p0").orderBy("key", "part"))
    parts = parts.select("tree", "p0", "key", "part", (upto - F.col("m")).alias("more"))
    upto = F.sum("copies").over(Window.partitionBy("tree", "p0", "key", "part").orderBy("node", "item").rowsBetween(Window.unboundedPreceding, 0))
    many = many.join(parts, ["tree", "p0", "key", "part"]).withColumn("first", F.col("before") + F.col("more") + upto - F.col("copies"))
    many = many.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(_COPIES))))
    many = many.withColumn("at", F.explode(F.sequence("at", F.least(F.col("at") + _COPIES, "copies") - 1)))
    return few.union(many.select("tree", "item", "node", (F.col("first") + F.col("at")).alias("rank"), "of"))


def reduced(nodes: DataFrame) -> list[DataFrame]:
    """Passes of rows (tree, prefix, up, items, levels) from (tree, item, node, rank, of); the last row of a tree ends in its top.

    Nodes whose ranks share all digits but the last STRIDE, in base FANOUT, are one row: FANOUT ** STRIDE at most, however large
    the tree is. A row's top is a node of the next pass, ranked by the prefix. ``up`` is how many levels are left. Passes are as many as
    the largest tree has levels, divided by STRIDE.
    """
    wide = FANOUT**STRIDE
    d = nodes.select("tree", "rank", levels_above(F.col("of")).alias("up"), "node", "item")
    left = d.agg(F.max("up")).first()[0] or 0
    passes = []
    while True:
        rows = d.groupBy("tree", F.expr(f"rank div {wide}").alias("prefix"), "up").agg(F.array_sort(F.collect_list(F.struct("rank", "node", "item"))).alias("all"))
        rows = rows.withColumn("levels", _levels(F.col("all")["node"], F.col("up"))).withColumn("items", F.col("all")["item"]).drop("all")
        passes.append(cut(rows))
        left -= STRIDE
        if left <= 0:
            return passes
        top = F.element_at(F.element_at("levels", -1), 1).alias("node")
        d = passes[-1].filter(F.col("up") > STRIDE).select("tree", F.col("prefix").alias("rank"), (F.col("up") - STRIDE).alias("up"), top, F.lit(None).cast("string").alias("item"))


def tops(passes: list[DataFrame]) -> DataFrame:
    """(tree, top): what each tree comes to."""
    top = F.element_at(F.element_at("levels", -1), 1).alias("top")
    out = [rows.filter(F.col("up") <= STRIDE).select("tree", top) for rows in passes]
    found = out[0]
    for d in out[1:]:
        found = found.union(d)
    return found


def with_paths(passes: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, item, node, path, *others) of each node of the first pass; the path ends where ``above``, (tree, path, *others), says.

    Paths go down pass by pass, a row for FANOUT ** STRIDE nodes each, and reach single nodes only in the end, where nothing is shuffled any more.
    """
    others = [c for c in above.columns if c not in ("tree", "path")]
    below = None
    for rows in reversed(passes):
        d = rows.filter(F.col("up") <= STRIDE).join(above, "tree")
        if below is not None:
            d = d.unionByName(rows.filter(F.col("up") > STRIDE).join(below, ["tree", "prefix"]))
        d = d.withColumn("i", F.explode(F.sequence(F.lit(0), F.size(F.element_at("levels", 1)) - 1)))
        path = F.concat(_siblings(F.col("levels"), F.col("i")), "path").alias("path")
        if rows is not passes[0]:
            below = cut(d.select("tree", (F.col("prefix") * FANOUT**STRIDE + F.col("i")).alias("prefix"), path, *others))
    return d.select("tree", F.get("items", F.col("i")).alias("item"), F.get(F.element_at("levels", 1), F.col("i")).alias("node"), path, *others)


def _ranked_trees(found: DataFrame) -> DataFrame:
    """(tree, item, node, rank, of) of one tree of all (tree, top), in byte order of their names: places within ranges of names, after those of the ranges before."""
    parts = cut(found.repartitionByRange("tree").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    every = Window.orderBy("part")  # a row for each range
    sizes = sizes.withColumn("before", F.sum("n").over(every) - F.col("n")).withColumn("of", F.sum("n").over(Window.partitionBy(F.lit(0)))).drop("n")
    d = parts.join(F.broadcast(sizes), "part")
    place = F.row_number().over(Window.partitionBy("part").orderBy("tree")) - 1
    return d.select(F.lit("").alias("tree"), F.struct(F.col("tree").alias("of")).alias("item"), F.col("top").alias("node"), (F.col("before") + place).alias("rank"), "of")


def manifest(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "source", fields: tuple[str, ...] = FIELDS, extra: dict[str, Column] | None = None) -> DataFrame:
    """(id, source, leaf, subroot, root, path) and the columns of ``extra``, computed from a document, for each row of docs.

    A leaf is the SHA-256 of the fields. In each source leaves ascend by id, an integer; every FANOUT neighbours become their SHA-256, level by level,
    till one is left, the subroot. Subroots in byte order of the sources' names become the root likewise. ``path`` holds
    the siblings on a leaf's way to the root, as ``folded`` takes them.

    Leaves are made once, in the scan, and only they travel: to the rows that a pass reduces, each of FANOUT ** STRIDE leaves. No task
    holds a source. A null field counts as ``-``; a null id comes first in its source, a null source before all others. Rows that
    share an id go by leaf, and equal rows are leaves of their own. Columns that aren't named aren't looked at; an empty table gives
    an empty manifest.
    """
    extra = extra or {}
    leaf = F.sha2(F.concat(*[field(F.col(c)) for c in fields]), 256)
    tree = F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit(""))
    item = F.struct(F.col(id_col).alias("id"), *[c.alias(name) for name, c in extra.items()])
    rows = cut(docs.select(tree.alias("tree"), F.col(id_col).cast("long").alias("key"), leaf.alias("node"), item.alias("item")))
    passes = reduced(ranked(rows))
    whole = reduced(_ranked_trees(tops(passes)))
    root = tops(whole).first()
    start = tops(whole).select("tree", F.expr(f"cast(array() as {_PATH})").alias("path"))
    above = with_paths(whole, start).select(F.col("item.of").alias("tree"), "path", F.col("node").alias("subroot"))
    d = with_paths(passes, cut(above))
    source = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30))
    return d.select(
        F.col("item.id").alias("id"), source.alias("source"), F.col("node").alias("leaf"), "subroot", F.lit(root["top"] if root else None).cast("string").alias("root"),
        "path", *[F.col("item")[name].alias(name) for name in extra],
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each document, where every second one, by its id's checksum, lost its line ends.

    Null texts and null ids aren't tampered with.
    """
    docs = table(spark, sf_dir, "documents")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    now = F.sha2(F.concat(*[field(changed if c == "text" else F.col(c)) for c in FIELDS]), 256)
    d = manifest(docs, extra={"now": now})
    d = d.withColumn("folded_root", folded(F.col("now"), F.col("path")))
    return d.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
