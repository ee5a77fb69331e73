"""Jaccard self-join of shingle sets by PartEnum signatures (Arasu, Ganti and Kaushik, 2006)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brevia.llm.common import connected_components, cut, slices, small_batches, table
from brevia.llm.shingles import digest, mixed, shingle_set

#: Second-level parts of a group, and how many of them may differ.
PARTS, MAY_DIFFER = 3, 1
#: Groups beyond those needed, as a share, where a signature stands for few shingles; so those that stand for none can be left out.
SPARE = 0.15
#: Bits that names of signatures go without in the shuffle; 52 are left, by which few of 10^13 meet by chance, and such pairs are told apart later.
SPARED_BITS = 12
#: Bits of a sketch for each shingle, at least.
SKETCH_BITS = 4
#: Rows of a bucket that meet those of another block, or their own, in one task.
BLOCK = 1_024
#: Rounds in which each node of a bucket meets its nearest of another component only, before all others are met.
NEAREST_ROUNDS = 2
#: Names of documents whose sets are needed are broadcast up to so many, some megabytes.
BROADCAST_IDS = 200_000


@lru_cache(maxsize=None)
def bands(up_to: int, num: int, den: int) -> tuple[tuple[int, int], ...]:
    """Bands of set sizes, (least, most), such that sets with similarity num/den lie in one band or in neighbours."""
    out, least = [], 1
    while least <= up_to:
        most = max(least, least * den // num)
        out.append((least, most))
        least = most + 1
    return tuple(out)


def may_be_apart(sizes: int, num: int, den: int) -> int:
    """How many shingles at most are in one of two sets only that are similar enough; ``sizes`` is the sum of theirs."""
    return sizes * (den - num) // (den + num)


def groups_for(k: int, num: int, den: int) -> tuple[int, int]:
    """(groups needed, groups used) where two sets differ in k shingles at most."""
    need = -(-(k + 1) // (1 + MAY_DIFFER))
    few = den + num < 13 * (den - num)  # shingles of a signature are (den + num) / (den - num) * 2 / 3 on average
    return need, int(need * (1 + SPARE)) if few else need


def signatures(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Signatures of a set: two similar enough sets share one.

    A set has signatures for the band of its size, where it meets sets of the band below, and for the next, where it meets
    those of its own band and the next; k bounds how many shingles two similar sets there don't share. The domain of shingles is cut into groups, so many that in one of them at most MAY_DIFFER such
    shingles lie, and each group into PARTS parts; a signature stands for a group without MAY_DIFFER of its parts, in
    every way to choose them. It is a sum over the shingles in the others, so all follow from sums over parts.

    Signatures that stand for no shingle are left out, as all sets without shingles there would share them. A set that has shingles
    in all signatures of as many groups as are needed loses no partner by that: one of these groups differs in MAY_DIFFER
    shingles at most, so its partner has the same there. Sets without so many such groups also give all signatures
    under other names, by which they meet each other.
    """
    n = len(s)
    steps = bands(8 << n.bit_length(), num, den)
    at = next(i for i, (_, most) in enumerate(steps) if n <= most)
    out = []
    with np.errstate(over="ignore"):
        value, place = mixed(s + np.uint64(7)), mixed(s ^ np.uint64(0x5851F42D4C957F2D))
        for band in (at, at + 1) if at else (1,):
            k = may_be_apart(steps[band - 1][1] + steps[band][1], num, den)
            need, groups, parts = (*groups_for(k, num, den), PARTS) if k else (1, 1, 1)
            where = (place % np.uint64(groups * parts)).astype(np.int64)
            sums = np.zeros(groups * parts, dtype=np.uint64)
            np.add.at(sums, where, value)
            sums, count = sums.reshape(groups, parts), np.bincount(where, minlength=groups * parts).reshape(groups, parts)
            kept, some = (sums.sum(1, dtype=np.uint64)[:, None] - sums, count.sum(1)[:, None] > count) if k else (sums, count > 0)
            name = np.arange(kept.size, dtype=np.uint64) + np.uint64(band << 40)
            found = mixed(kept.ravel() ^ mixed(name + np.uint64(1)))
            out.append(found[some.ravel()])
            if int(some.all(1).sum()) < need:
                out.append(mixed(found ^ np.uint64(0x2545F4914F6CDD1D)))
    return np.concatenate(out).astype(np.int64) >> SPARED_BITS


def sketch(s: np.ndarray) -> bytes:
    """Parities of the shingles in each of SKETCH_BITS or more classes a shingle, a power of two; sets differ in as many shingles as their sketches in bits, or more."""
    bits = 1 << max(6, (SKETCH_BITS * len(s) - 1).bit_length())
    odd = np.bincount((mixed(s ^ np.uint64(0x6A09E667F3BCC909)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: np.ndarray, size: int) -> np.ndarray:
    """Rows of sketches with ``size`` bytes each: halves are added until so few are left, as the classes are remainders."""
    while sketches.shape[1] > size:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _apart_at_least(a: bytes, b: bytes) -> int:
    """How many shingles two sets differ in at least, by their sketches."""
    size = min(len(a), len(b))
    x, y = (_folded(np.frombuffer(k, np.uint64)[None], size // 8) for k in (a, b))
    return int(np.bitwise_count(x ^ y).sum())


def _near(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes that may link by their sizes and sketches."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"k_{x}"))

    @F.pandas_udf("boolean")
    def close(n_a: pd.Series, n_b: pd.Series, k_a: pd.Series, k_b: pd.Series) -> pd.Series:
        apart = np.array([_apart_at_least(a, b) for a, b in zip(k_a, k_b, strict=True)], dtype=np.int64)
        return pd.Series(apart <= (n_a + n_b).to_numpy(np.int64) * (den - num) // (den + num))

    return pairs.join(side("a"), "a").join(side("b"), "b").filter(close("n_a", "n_b", "k_a", "k_b")).select("a", "b")


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose ends are in different components."""
    side = lambda x: parts.select(F.col("node").alias(f"__{x}"), F.col("component").alias(f"part_{x}"))
    d = pairs.join(side("a"), F.col("a") == F.col("__a"), "left").join(side("b"), F.col("b") == F.col("__b"), "left")
    return d.filter(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).select("a", "b")


def _joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Components with further links: each node and its component stand for the links known before."""
    if links.isEmpty():
        return parts
    return connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))


def _linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets are similar enough, exactly. Only texts of these nodes are looked at again."""
    meant = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", F.col("rid").alias("id")), "node")
    meant = cut(meant)
    if meant.count() <= BROADCAST_IDS:  # else texts are shuffled by id
        meant = F.broadcast(meant)

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            sets = [shingle_set(t, words) for t in b["text"]]
            keep = [digest(s) == node for s, node in zip(sets, b["node"], strict=True)]
            yield pd.DataFrame({"node": b["node"].to_numpy()[np.array(keep, dtype=bool)], "s": pd.Series([s.tobytes() for s, k in zip(sets, keep, strict=True) if k], dtype=object)})

    # rows of an id may hold the same text
    sets = cut(docs.join(meant, "id").select("node", "text").mapInPandas(sets_of, "node bigint, s binary").dropDuplicates(["node"]))
    of = lambda x: sets.select(F.col("node").alias(x), F.col("s").alias(f"s_{x}"))

    @F.pandas_udf("boolean")
    def alike(s_a: pd.Series, s_b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(s_a, s_b, strict=True):
            x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
            both = np.concatenate([x, y])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            out.append(den * shared >= num * (len(x) + len(y) - shared))
        return pd.Series(out, dtype=bool)

    return cut(pairs.join(of("a"), "a").join(of("b"), "b").filter(alike("s_a", "s_b")).select("a", "b"))


def _crossing(rows: pd.DataFrame, starts: np.ndarray, num: int, den: int, nearest: bool) -> pd.DataFrame:
    """Pairs of nodes of different components that may link by their sketches, in buckets that begin at ``starts``; all, or the nearest for each node."""
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    block, i, j, node, part, n = (rows[c].to_numpy() for c in ("block", "i", "j", "node", "part", "n"))
    for s, e in zip(starts[:-1], starts[1:], strict=True):
        held = rows["sketch"].iloc[s:e].tolist()
        size = min(map(len, held)) // 8
        sketches = np.concatenate([_folded(np.frombuffer(k, np.uint64)[None], size) for k in held])
        x = np.flatnonzero(block[s:e] == i[s])
        y = x if i[s] == j[s] else np.flatnonzero(block[s:e] == j[s])
        mine, parts, sizes = node[s:e], part[s:e], n[s:e]
        for row in x:
            # a pair of one block is met once, but the nearest is looked for from both ends
            others = y[y > row] if i[s] == j[s] and not nearest else y
            others = others[parts[others] != parts[row]]
            apart = np.bitwise_count(sketches[row] ^ sketches[others]).sum(1, dtype=np.int64)
            most = (sizes[row] + sizes[others]) * (den - num) // (den + num)
            near = others[apart <= most]
            if nearest and len(near):
                by = (apart / np.maximum(most, 1))[apart <= most]
                near = near[np.lexsort([mine[near], by])[:1]]
            out_a.append(np.maximum(mine[row], mine[near]))
            out_b.append(np.minimum(mine[row], mine[near]))
    return pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})


def _met(shared: DataFrame, parts: DataFrame, nodes: DataFrame, num: int, den: int, nearest: bool) -> DataFrame:
    """Distinct pairs (a, b) of nodes that share a bucket, are in different components by now and may link by their sketches.

    A bucket's nodes are cut into blocks; each pair of blocks is a task's group of 2 * BLOCK rows at most.
    """
    bucket = Window.partitionBy("sig")
    rest = shared.filter("node <> center").join(parts, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("part"))
    rest = rest.withColumns({"low": F.min("part").over(bucket), "high": F.max("part").over(bucket)}).filter("low < high")
    rest = rest.dropDuplicates(["sig", "node"]).withColumn("block", F.floor((F.row_number().over(bucket.orderBy("node")) - 1) / BLOCK).cast("int"))
    rest = rest.withColumn("blocks", F.max("block").over(bucket)).select("sig", "node", "part", "block", "blocks")
    rest = rest.join(nodes.select("node", "n", "sketch"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks"))))
    rest = rest.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last bucket of a batch may go on in the next; it has two blocks at most
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            keys = b[["sig", "i", "j"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(b) else np.zeros(1, int)
            held = b.iloc[starts[-1] :]
            yield _crossing(b.iloc[: starts[-1]], starts, num, den, nearest)
        if held is not None and len(held):
            yield _crossing(held, np.array([0, len(held)]), num, den, nearest)

    rest = rest.select("sig", "i", "j", "block", "node", "part", "n", "sketch").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return rest.mapInPandas(meet, "a bigint, b bigint").distinct()


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100, sign: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Rows (id, n_shingles, component_id) of each document; two link if their shingle sets' Jaccard similarity is num/den or more.

    component_id is the smallest id reachable over links, the document's own if it has none. Every link between different
    sets is found or implied: a pair goes untested only if its ends are already in one component.

    Documents with equal sets are one node, by a 64-bit digest, from the first step on. Nodes that share a PartEnum
    signature are candidates (``sign`` gives other signatures, by which all is found that shares one). In each bucket all meet its least node, unless they are in its component by then; what links is joined. Buckets that
    still hold several components, apart from that node, are then compared in blocks, on sketches that bound
    the distance from below and nearly reach it. In some rounds each node is tested against the nearest of another component
    that may link, and what links is joined; at last all pairs of components that are still different are. So a large group of
    near copies costs a few tests for each member rather than one for each pair.

    A null text is empty. Documents without words have no shingles and no links. Rows with a null id take part in nothing
    and get a null component_id. An id on several rows stands for each of their texts. Other columns aren't looked at; an
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sign_set = sign or (lambda s: signatures(s, num, den))

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            rows = [(len(s), digest(s), sketch(s)) for s in (shingle_set(t, words) for t in b["text"])]
            yield pd.DataFrame({"id": b["id"].reset_index(drop=True), **{c: pd.Series([r[i] for r in rows], dtype=t) for i, (c, t) in enumerate((("n", "int64"), ("node", "int64"), ("sketch", object)))}})

    id_type = d.schema["id"].dataType.simpleString()
    named = cut(d.mapInPandas(name, f"id {id_type}, n bigint, node bigint, sketch binary"))
    live = named.filter("id is not null and n > 0")
    nodes = cut(live.groupBy("node").agg(F.min("id").alias("rid"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))

    def signed_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # copies within a task; it grows with the task's rows only
        for b in slices(batches):
            out = []
            for t in b["text"]:
                s = shingle_set(t, words)
                if len(s) and (node := digest(s)) not in seen:
                    seen.add(node)
                    out.append((node, sign_set(s)))
            yield pd.DataFrame({"node": np.array([x[0] for x in out], dtype=np.int64), "sigs": pd.Series([x[1] for x in out], dtype=object)})

    signed = d.filter("id is not null").mapInPandas(signed_sets, "node bigint, sigs array<bigint>").select("node", F.explode("sigs").alias("sig"))
    bucket = Window.partitionBy("sig")
    least, most = F.min("node").over(bucket), F.max("node").over(bucket)
    shared = cut(signed.withColumns({"center": least, "last": most}).filter("center < last").select("sig", "node", "center"))

    stars = shared.filter("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    stars = cut(_near(stars, nodes, num, den))
    # each node meets the least of its centres, and others only if that leaves them in different components: so sets,
    # the costly part, travel about once for each node
    parts = connected_components(_linked(cut(stars.groupBy("a").agg(F.min("b").alias("b"))), d, nodes, words, num, den))
    parts = _joined(parts, _linked(cut(_apart(stars, parts)), d, nodes, words, num, den))

    tested = None
    for i in range(NEAREST_ROUNDS + 1):
        last = i == NEAREST_ROUNDS
        pairs = _met(shared, parts, nodes, num, den, nearest=not last)
        pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            if tested is None:  # no pair is left that may link; later only the nearest are known not to
                break
            continue
        parts = _joined(parts, _linked(pairs, d, nodes, words, num, den))
        tested = pairs if tested is None else tested.union(pairs)
    least_id = parts.join(nodes.select("node", "rid"), "node").groupBy("component").agg(F.min("rid").alias("component_id"))
    ids = nodes.join(parts, "node", "left").join(least_id, "component", "left").select(F.col("node").alias("__node"), F.coalesce("component_id", "rid").alias("component_id"))
    out = named.join(ids, F.when(F.col("n") > 0, F.col("node")) == F.col("__node"), "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns, less those that another document of their component with a smaller id stands for.

    Rows with a null id stay; so do all rows of an id that stays.
    """
    found = similar_documents(docs, id_col, text_col, **options).filter("id is not null and component_id < id").select(F.col("id").alias("__gone")).distinct()
    rows = docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("__id"))
    return rows.join(found, F.col("__id") == F.col("__gone"), "left_anti").select("__row.*")


def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; a null text has no shingles and no links, a null id has a null component, and rows of one id share theirs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return similar_documents(docs, words=3, num=90, den=100).withColumnRenamed("id", "doc_id")
