"""Helpers that several training-data operators share: lineage cuts, size-checked joins, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only when it was counted and has no more rows than this.
BROADCAST_ROWS = 5_000

#: Copies of the smaller side in a salted join, and so the parts into which one hot key is split.
SALTS = 16

#: Edges that one task of a connected-components round handles, some megabytes; fewer edges take fewer tasks and files.
EDGES = 200_000

#: Rows that a Python worker holds the results of at once.
SLICE = 500

#: Bytes of a batch that goes to a Python worker, about; a batch is in memory on both sides, several times over.
BATCH_BYTES = 2 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else, unlike ``lower``."""
    return F.translate(text, _UPPER, _UPPER.lower())


def word_count(text: Column) -> Column:
    """Words of a text as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on, and what it keeps is missing to the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator, rows: int = SLICE) -> Iterator[pd.DataFrame]:
    """The same rows in smaller pieces, so that what a worker makes of a batch of long texts isn't held for all of them; an empty batch is one piece.

    What earlier tasks of the worker left is given back first, and what this one leaves in the end.
    """
    give_back()
    try:
        for b in batches:
            for i in range(0, max(1, len(b)), rows):
                yield b.iloc[i : i + rows]
    finally:
        b = None
        give_back()


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends rows to Python workers in batches of about BATCH_BYTES; Spark's own bounds are 10,000 rows and 64 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the cluster's shared checkpoint folder, so that lost executors lose no data.

    The folder is the session's ``spark.checkpoint.dir``; a local session that names none (a test) gets a temporary one, and on a
    cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", rows: int | None = None) -> DataFrame:
    """Equi-join (nulls equal each other) of a large frame with a usually small one.

    The small side is counted first. Up to ``BROADCAST_ROWS`` rows it is broadcast; beyond that both
    sides are dealt by key and a salt, so that a key with a third of all rows is spread over SALTS tasks.
    """
    rows = small.count() if rows is None else rows
    renamed = small.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys])
    if rows <= BROADCAST_ROWS:
        renamed, extra = F.broadcast(renamed), None
    else:
        renamed = renamed.withColumn("__salt_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        big = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int"))
        extra = F.col("__salt") == F.col("__salt_r")
    on = extra
    for i, k in enumerate(keys):
        c = F.col(k).eqNullSafe(F.col(f"__k{i}"))
        on = c if on is None else on & c
    return big.join(renamed, on, how).drop("__salt", "__salt_r", *[f"__k{i}" for i in range(len(keys))])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the undirected edges; component is the smallest reachable node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): a logarithmic number of rounds,
    each of two joins and a distinct on keys that partial aggregation shrinks before the shuffle. Each
    round is cut into the shared checkpoint folder, in tasks of EDGES edges or more, as no round makes more edges. Self-loops and rows with a null end are no edges.
    """
    e = cut(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .filter("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    mark, tasks = None, 1 + e.count() // EDGES
    e = e.coalesce(tasks)
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(low, both.u == low.w).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(low, large.u == low.w).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    star = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.union(star.select("component", "component").distinct())
