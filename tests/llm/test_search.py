"""Ranked search against brute force, with several shards, ties and odd rows."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brevia.llm import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, k=10):
    """{item: [(id, score), ...]}"""
    held = [(i, TERM.findall(lowered(t))) for i, t in docs]
    n, words = sum(1 for _, t in held if t), sum(len(t) for _, t in held)
    df: dict = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall(lowered(t)))
    out = {}
    for i, terms in asked.items():
        scores = []
        for d, t in held:
            m = 10 + 90 * len(t) * n // words if words else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in terms if x in t)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        best = [(None if none else d, -s) for s, none, d in sorted(scores)[:k]]
        if best:
            out[i] = best
    return out


def found(rows):
    out: dict = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(r["item_id"], []).append((r["id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


def random_docs(n, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "naïve", "x²", "日本", "A1"]
    docs = [(int(i), " ".join(rng.choice(words, rng.integers(0, 40))) + ("." if i % 2 else "")) for i in rng.permutation(n)]
    return docs + [(n + i, docs[0][1]) for i in range(15)]  # ties


@pytest.mark.parametrize("broadcast", [True, False])
def test_search_is_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(search, "BROADCAST_PAIRS", 0)
    docs = random_docs(300)
    items = [(i, " ".join(docs[i][1].split()[:8]) + " w1 w1, none such") for i in range(30)] + [(40, None), (41, "  .,-"), (42, "unknown"), (None, "w3 w4"), (43, "w5"), (43, "w6")]
    index = search.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    got = found(search.search(index, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == brute(docs, items)


def test_many_items_need_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 4)
    docs = random_docs(60, 2)
    items = [(i, f"w{i} w{i + 1} w{2 * i}") for i in range(30)]
    index = search.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert found(search.search(index, spark.createDataFrame(items, "item_id long, text string"), k=3).collect()) == brute(docs, items, 3)


def test_shards_close_when_they_are_full(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_TERMS", 50)
    docs = random_docs(40, 3)
    index = search.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    heads = index.filter("term is null").collect()
    assert len(heads) > 5 and sum(h["words"] for h in heads) == sum(len(TERM.findall(lowered(t))) for _, t in docs)
    items = [(1, "w1 w2 w3"), (2, "ÉTÉ été")]
    assert found(search.search(index, spark.createDataFrame(items, "item_id long, text string")).collect()) == brute(docs, items)


def test_odd_rows(spark, odd, none):
    items = [(1, "one two word7"), (2, None), (3, ""), (None, "é token9 é")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(5)).withColumn("term", F.lit("t"))
    got = found(search.search(search.build_index(odd), asked).collect())
    assert got == brute([(r["doc_id"], r["text"]) for r in odd.collect()], items)
    assert search.search(search.build_index(none), asked).count() == 0
    assert search.search(search.build_index(odd), asked.limit(0)).count() == 0


def test_packed_numbers():
    rng = np.random.default_rng(5)
    values = np.r_[0, 1, 127, 128, 1 << 14, (1 << 62) - 1, rng.integers(0, 1 << 40, 500), rng.integers(0, 300, 500)].astype(np.int64)
    data, size = search.packed(values)
    assert (search.unpacked(data) == values).all() and size.sum() == len(data)
    assert len(search.unpacked(search.packed(np.zeros(0, np.int64))[0])) == 0
