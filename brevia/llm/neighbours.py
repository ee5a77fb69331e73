"""Nearest neighbours by inner product with an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brevia.llm.common import cut, table

#: Rows that the two codebooks are fitted on at most, by order of a hash; every row is indexed.
TRAIN_ROWS = 8_192
#: Centroids of each half.
CENTROIDS = 64
#: A query's traversal holds so large a share of all rows before bounds tell which other cells can still matter.
PROBED = 0.5
#: Rows of a shard of the index and of a block of queries, about.
SHARD_ROWS, BLOCK_ROWS = 16_384, 2_048


def _kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Lloyd's rounds from rows spread over the sample; an emptied centroid stays where it was."""
    distinct = np.unique(x, axis=0)
    c = distinct[np.random.default_rng(0).permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))[:, None]
        c = np.where(n > 0, total / np.maximum(n, 1), c)
    return c


@dataclass
class MultiIndex:
    """Two codebooks, one for each half of a vector, and the rows of each cell of their product."""

    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        h = self.first.shape[1]
        near = [((c**2).sum(1) - 2 * part @ c.T).argmin(1) for part, c in ((x[:, :h], self.first), (x[:, h:], self.second))]
        return near[0] * len(self.second) + near[1]

    def probe(self, q: np.ndarray, rows: float) -> list[int]:
        """The cells nearest to a query that together hold ``rows`` rows, by the multi-sequence walk.

        Distances are negative inner products with the centroids of each half, sorted; a heap holds the pairs next in
        line, and a pair enters when the pair before it in either direction was taken.
        """
        h = self.first.shape[1]
        a, b = -self.first @ q[:h], -self.second @ q[h:]
        ia, ib = a.argsort(kind="stable"), b.argsort(kind="stable")
        a, b = a[ia].tolist(), b[ib].tolist()
        heap, taken_to, out, held = [(a[0] + b[0], 0, 0)], [0] * len(a), [], 0
        counts, width = self.counts, len(b)
        while heap and held < rows:
            _, i, j = heapq.heappop(heap)
            taken_to[i] = j + 1
            cell = int(ia[i]) * width + int(ib[j])
            if counts[cell]:
                out.append(cell)
                held += int(counts[cell])
            if i + 1 < len(a) and taken_to[i + 1] == j:
                heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
            if j + 1 < width and (i == 0 or taken_to[i - 1] > j + 1):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        return out

    def reach(self, q: np.ndarray, x: np.ndarray, cell: int) -> np.ndarray:
        """What rows ``x`` of a cell score at most with each query, by the norms of their residuals and their own."""
        c = np.concatenate((self.first[cell // len(self.second)], self.second[cell % len(self.second)]))
        h, off, norms = self.first.shape[1], x - c, np.linalg.norm
        size = norms(q, axis=1)
        halves = norms(q[:, :h], axis=1) * norms(off[:, :h], axis=1).max() + norms(q[:, h:], axis=1) * norms(off[:, h:], axis=1).max()
        top = np.minimum(q @ c + np.minimum(halves, size * norms(off, axis=1).max()), size * norms(x, axis=1).max())
        return top + 1e-9 * (1 + size * (norms(c) + norms(x, axis=1).max()))


def _best(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, at: np.ndarray, near: np.ndarray, index: MultiIndex) -> pd.DataFrame:
    """The k best of each query in a shard: ``near`` masks the pairs (query, cell) that are probed, ``at`` is each row's cell.

    Cells that aren't probed are scored too where their bound reaches the k-th best that the probed ones gave here.
    """
    score = np.full((len(q), len(x)), -np.inf)
    own = query_ids[:, None] == ids[None, :]
    order = at.argsort(kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
    cells = [order[s:e] for s, e in zip(starts, [*starts[1:], len(order)], strict=True)]
    for rows in cells:
        asked = np.flatnonzero(near[:, at[rows[0]]])
        if len(asked):
            score[np.ix_(asked, rows)] = q[asked] @ x[rows].T
    score[own] = -np.inf
    least = np.array([np.partition(held, len(held) - k)[len(held) - k] if len(held) >= k else -np.inf for held in score])
    for rows in cells:
        cell = int(at[rows[0]])
        asked = np.flatnonzero(~near[:, cell] & (index.reach(q, x[rows], cell) >= least))
        if len(asked):
            score[np.ix_(asked, rows)] = q[asked] @ x[rows].T
    score[own] = -np.inf
    parts = []
    for i in range(len(q)):
        held = score[i]
        least = -np.inf if len(held) <= k else np.partition(held, len(held) - k)[len(held) - k]
        slack = 1e-9 * (1 + abs(least)) if np.isfinite(least) else 0.0
        c = np.flatnonzero((held >= least - slack) & (held > -np.inf))
        exact = (x[c] * q[i]).sum(axis=1)  # by row, so that equal vectors score alike wherever they lie
        best = np.lexsort((ids[c], -exact))[:k]
        parts.append(pd.DataFrame({"query_id": query_ids[i], "vec_id": ids[c[best]], "score": exact[best]}))
    return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of rows that take part: id not null; vector not null, not all zero, without null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    d = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return d.filter(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def search(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
    centroids: int = CENTROIDS, probed: float = PROBED, max_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k rows of ``vectors`` found nearest to each row of ``queries``.

    Nearness is the inner product, greatest first, ties to the smaller id; a query's own id is no candidate of it.
    Vectors are cut in halves, each quantised with a codebook fitted on at most ``max_rows`` rows, and every row is
    entered in the cell of its two codes. A query walks over cells from the nearest until they hold the share ``probed``
    of all rows, and 5 k rows at least, and scores the entries of these cells exactly, in double precision. Every other cell
    is scored as well unless the largest norms of its rows and of their residuals show that none of them is among the k
    best. So the result is exact whatever ``probed`` is and however many rows are copies; vectors without structure are all scored.

    The index is dealt evenly into shards by a hash of ids, so that a hot cell is spread over all of them; within a shard
    entries lie by cell. Each block of queries meets each shard in a task of bounded size, which passes on k rows a query.

    Rows with a null id, and vectors that are null, empty, all zero, or hold null or non-finite components take no part, nor
    do those whose length isn't the most common one (the longest of such). An id that repeats among queries is asked once, with
    one of its vectors. Other columns aren't looked at; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x, q = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    lengths = x.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return empty
    dims, n = int(lengths["n"]), int(lengths["count"])
    x, q = x.filter(F.size("v") == dims), q.filter(F.size("v") == dims).dropDuplicates(["id"])
    sample = np.array([r["v"] for r in x.orderBy(F.xxhash64("id"), "id").limit(max_rows).collect()])
    half = max(1, dims // 2)
    index = MultiIndex(_kmeans(sample[:, :half], centroids), _kmeans(sample[:, half:], centroids), np.zeros(0))

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "v": b["v"], "cell": index.cells(np.stack(b["v"].to_list()))})

    entered = cut(x.mapInPandas(enter, "id long, v array<double>, cell int"))
    counts = np.zeros(len(index.first) * len(index.second), dtype=int)
    for r in entered.groupBy("cell").count().collect():  # centroids squared at most
        counts[r["cell"]] = r["count"]
    full = MultiIndex(index.first, index.second, counts)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "v": b["v"], "cells": pd.Series([full.probe(np.asarray(v), max(probed * n, 5 * k)) for v in b["v"]], dtype=object)})

    asked = cut(q.mapInPandas(walk, "id long, v array<double>, cells array<int>"))
    shards, blocks = -(-n // SHARD_ROWS), -(-max(1, asked.count()) // BLOCK_ROWS)
    part = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = entered.withColumn("shard", part(shards)).withColumn("block", every(blocks))
    right = asked.withColumn("block", part(blocks)).withColumn("shard", every(shards))
    width = len(counts)

    def meet(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(entries) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        near = np.zeros((len(queries), width), dtype=bool)
        for row, cells in zip(near, queries["cells"], strict=True):
            row[np.asarray(cells, dtype=int)] = True
        stack = lambda f: np.stack(f["v"].to_list())
        return _best(queries["id"].to_numpy(), stack(queries), entries["id"].to_numpy(), stack(entries), k, entries["cell"].to_numpy(), near, full)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(meet, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score) of 20 neighbours at most; vectors null, zero or not finite take no part, and equal scores go by vec_id."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter("vec_id % 20 = 0"))
