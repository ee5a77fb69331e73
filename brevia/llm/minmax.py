"""Near-duplicate removal by min-max hashing (Ji, Li, Yan, Tian and Zhang, 2013)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brevia.llm.common import table
from brevia.llm.jaccard import SPARED_BITS, similar_documents
from brevia.llm.shingles import mixed

#: Permutations of the domain of shingles; each gives two values of a signature, the least and the greatest.
PERMUTATIONS = 120
#: Values in a band. With 240 values, sets of similarity 0.85 share none of the 40 bands with a probability of 6e-9.
BAND = 6
#: Shingles that all permutations are taken of at once.
PIECE = 4_096

with np.errstate(over="ignore"):
    _TIMES = mixed(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    _PLUS = mixed(_TIMES)


def min_max(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest value of a set's shingles under each permutation x -> a * x + b of 64-bit numbers.

    Two sets have the same least value with a probability of their similarity, and so the same greatest; one evaluation gives both.
    """
    least, most = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(s), PIECE):
        x = s[i : i + PIECE] * _TIMES[:, None] + _PLUS[:, None]
        least, most = np.minimum(least, x.min(1)), np.maximum(most, x.max(1))
    return least, most


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """An unbiased estimate of two sets' similarity from both halves of their signatures."""
    (low_a, high_a), (low_b, high_b) = min_max(a), min_max(b)
    return float(((low_a == low_b).mean() + (high_a == high_b).mean()) / 2)


def band_names(s: np.ndarray) -> np.ndarray:
    """A name for each band of a set's signature. Bands hold least values or greatest ones, as those of one permutation aren't independent."""
    bands = np.concatenate([half.reshape(-1, BAND) for half in min_max(s)])
    name = np.arange(len(bands), dtype=np.uint64)
    for i in range(BAND):
        name = mixed(name * np.uint64(0x9E3779B97F4A7C15) + bands[:, i])
    return name.astype(np.int64) >> SPARED_BITS


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows (id, n_shingles, component_id, kept) of each document; two link if their shingle sets' Jaccard similarity is num/den or more.

    Sets that share a band of their min-max signatures are candidates; each link is confirmed on the full sets. component_id is the smallest id
    reachable over links, and that document is kept. How candidates are met without giving out all pairs of a bucket, and what nulls, repeated
    ids, texts without words and empty tables give, is as in ``similar_documents``; rows with a null id are kept.
    """
    found = similar_documents(docs, id_col, text_col, words, num, den, sign=band_names)
    return found.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def op13_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document, at three words and a similarity of 0.85; null texts have no shingles and are kept."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, num=85).withColumnRenamed("id", "doc_id")
