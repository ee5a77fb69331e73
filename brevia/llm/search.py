"""Ranked lexical search: compressed postings of each shard, merged document at a time for blocks of items."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brevia.llm.common import ascii_lower, cut, table

#: A term is a run of these: ASCII letters and digits, and every character beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_APART = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))

#: A shard is closed when it has so many terms with repeats; a longer document is a shard of its own, or ends one.
SHARD_TERMS = 1_000_000
#: Items that are merged for at once.
BLOCK = 256
#: Terms of items, a row for each item and term, that are broadcast: some megabytes. Beyond that they are joined in a shuffle.
BROADCAST_PAIRS = 200_000
#: Rows of an index that a task hands over at once.
ROWS = 5_000
_END = 1 << 62

INDEX = "shard long, term string, n long, postings binary, words long"


def terms_of(text: str | None) -> list[bytes]:
    """A text's terms with repeats, A-Z in lower case and nothing else changed."""
    return (text or "").encode().lower().translate(_APART).split()


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each value): seven bits a byte, lowest first, with a mark where the value goes on."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        size += values >= (1 << 7 * k)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[at[some] + k] = (values[some] >> 7 * k & 127) | np.where(size[some] > k + 1, 128, 0)
    return out, size


def unpacked(data: np.ndarray) -> np.ndarray:
    """The values of ``packed``."""
    if not len(data):
        return np.zeros(0, np.int64)
    last = data < 128
    start = np.r_[0, np.flatnonzero(last)[:-1] + 1]
    place = np.arange(len(data)) - np.repeat(start, np.diff(np.r_[start, len(data)]))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, start)


def _shard(name: int, ids: pa.Array, found: list[list[bytes]], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of a shard: its documents (without a term), then each term with its postings, terms in order.

    Postings are (step from the document before, times in the document), where documents are numbered in order of id.
    """
    order = pc.sort_indices(ids).to_numpy()  # nulls last
    ids, found = ids.take(order), [found[i] for i in order]
    lengths = np.array([len(f) for f in found], np.int64)
    words = np.array([t for f in found for t in f], dtype=object)
    codes, vocabulary = pd.factorize(words)
    key, times = np.unique(codes.astype(np.int64) * len(found) + np.repeat(np.arange(len(found)), lengths), return_counts=True)
    code, doc = np.divmod(key, max(1, len(found)))
    first = np.r_[True, code[1:] != code[:-1]] if len(code) else np.zeros(0, bool)
    pairs = np.empty(2 * len(key), np.int64)
    pairs[0::2], pairs[1::2] = np.where(first, doc, doc - np.r_[0, doc[:-1]]), times
    data, size = packed(pairs)
    starts = np.flatnonzero(first)
    count = np.diff(np.r_[starts, len(key)])
    bounds = np.r_[0, np.cumsum(size)[2 * (starts + count) - 1]] if len(starts) else np.zeros(1, np.int64)

    def batch(terms: list, n: list, postings: list, words: list, ids: list, lengths: list) -> pa.RecordBatch:
        cols = [[name] * len(terms), terms, n, postings, words, ids, lengths]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind, strict=True)], schema=kind)

    yield batch([None], [int((lengths > 0).sum())], [None], [int(lengths.sum())], [ids.to_pylist()], [lengths])
    blob = data.tobytes()
    for a in range(0, len(starts), ROWS):
        some = range(a, min(a + ROWS, len(starts)))
        terms = [vocabulary[code[starts[i]]].decode() for i in some]
        yield batch(terms, count[a : a + ROWS].tolist(), [blob[bounds[i] : bounds[i + 1]] for i in some], [None] * len(some), [None] * len(some), [None] * len(some))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (shard, term, n, postings, words, ids, lengths): all terms of all documents, shard by shard.

    A shard is a run of rows of one input partition with about SHARD_TERMS terms, so building shuffles nothing and
    holds one shard at a time. Its row without a term lists the shard's documents in order of id, nulls last, with how many
    terms each has; n counts those with a term. In the others n is the number of documents with the term. The index is
    cut into the checkpoint folder, as numbers of shards come from partitions.

    Null texts are empty; such documents are listed, with no postings. Rows that share an id are documents of their own.
    Other columns aren't looked at; an empty table gives an empty index.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = f"{INDEX}, ids array<{d.schema['id'].dataType.simpleString()}>, lengths array<long>"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shards = TaskContext.get().partitionId() << 32, 0
        ids, found, words, kind = [], [], 0, None
        for b in batches:
            if kind is None:
                id_type = b.schema.field("id").type
                types = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64())]
                kind = pa.schema(list(zip(["shard", "term", "n", "postings", "words", "ids", "lengths"], types, strict=True)))
            for i, t in zip(b.column("id"), b.column("text"), strict=True):
                ids.append(i.as_py())
                found.append(terms_of(t.as_py()))
                words += len(found[-1])
                if words + len(found) >= SHARD_TERMS:
                    yield from _shard(part + shards, pa.array(ids, id_type), found, kind)
                    ids, found, words, shards = [], [], 0, shards + 1
        if found:
            yield from _shard(part + shards, pa.array(ids, id_type), found, kind)

    return cut(d.mapInArrow(build, out))


def _merged(rows: list[dict], docs: dict, k: int, n_docs: int, n_terms: int) -> Iterator[tuple]:
    """(item, document's number in the shard, score): the k best of a shard for each item of a block.

    One cursor for each term that an item of the block has; a heap of the cursors gives the documents in order, each with all its
    postings at once. What a document scores is kept, for each item, in a heap of the k best so far, of which the worst is the lower
    score or the later document.
    """
    n = np.array([r["n"] for r in rows], np.int64)
    pairs = unpacked(np.frombuffer(b"".join(r["postings"] for r in rows), np.uint8))
    term = np.repeat(np.arange(len(rows)), n)
    first = np.cumsum(n) - n
    steps, times = pairs[0::2], pairs[1::2]
    total = np.cumsum(steps)
    doc = total - np.repeat(total[first] - steps[first], n)
    m = 10 + 90 * np.array(docs["lengths"], np.int64) * n_docs // n_terms
    gain = np.array([r["w"] for r in rows], np.int64)[term] * (1_000_000_000 * times // (1_000 * times + 8 * m[doc]))
    slot: dict = {}
    asking = [np.array([slot.setdefault(i["item_id"], len(slot)) for i in r["items"]], np.int64) for r in rows]
    askers = np.array([len(a) for a in asking])
    # an end mark after each term's postings
    at = np.arange(len(doc)) + term
    keys = np.full(len(doc) + len(rows), _END, np.int64)
    keys[at] = doc << 32 | at
    values, owner = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    values[at], owner[at] = gain, term
    cursors = keys[first + np.arange(len(rows))].tolist()
    keys = keys.tolist()
    heapq.heapify(cursors)
    best: list[list] = [[] for _ in slot]
    least = np.zeros(len(slot), np.int64)
    current, here = -1, []
    while True:
        key = cursors[0]
        if key >> 32 != current:
            if here:
                terms = owner[here]
                score = np.zeros(len(slot), np.int64)
                np.add.at(score, np.concatenate([asking[t] for t in terms]), np.repeat(values[here], askers[terms]))
                for i in np.flatnonzero(score > least).tolist():
                    (heapq.heapreplace if len(best[i]) == k else heapq.heappush)(best[i], (int(score[i]), -current))
                    if len(best[i]) == k:
                        least[i] = best[i][0][0]
            if key == _END:
                break
            current, here = key >> 32, []
        place = key & 0xFFFFFFFF
        here.append(place)
        heapq.heapreplace(cursors, keys[place + 1])
    for item, i in slot.items():
        for score, number in best[i]:
            yield item, -number, score


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", k: int = 10) -> DataFrame:
    """Rows (item_id, rank, id, score): the k documents of an index that score highest for each item, and above 0.

    A document's score is the sum, over the item's distinct terms, of w * ((10^9 * tf) div (1000 * tf + 8 * m)), with w and m
    as the weights by document frequency and length below. Equal scores go by ascending id, nulls last.

    Each shard meets blocks of BLOCK items. Items are joined to the index by their terms, so only postings of terms that are asked for
    leave the index's scan; where that table of terms is small it is broadcast and nothing is shuffled but each shard's k best. These
    are cut to k for each item before the last shuffle as well.

    Rows that share an item id are one item with the terms of all. Null texts and those without terms have no result; a null item id is an
    item. Other columns aren't looked at; an empty index or an empty table of items gives an empty result.
    """
    id_type = index.schema["ids"].dataType.elementType
    asked = items.select(F.col(item_col).alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(TERM), F.lit(0)))).alias("term")).distinct()
    asked = cut(asked)
    pairs, n_items = asked.agg(F.count("*"), F.count_distinct(F.struct("item_id"))).first()
    n_docs, n_terms = index.filter("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    small = pairs <= BROADCAST_PAIRS
    near = F.broadcast if small else lambda d: d

    listed = index.filter("term is not null").select("shard", "term", "n", "postings")
    df = listed.select("term", "n").join(near(asked.select("term").distinct()), "term").groupBy("term").agg(F.sum("n").alias("df"))
    w = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("long")
    block = F.pmod(F.xxhash64("item_id"), F.lit(1 + n_items // BLOCK))
    asked = asked.join(df, "term").select("term", "item_id", w.alias("w"), block.alias("block"))
    asked = cut(asked.groupBy("term", "w", "block").agg(F.collect_list(F.struct("item_id")).alias("items")))

    if small:  # rows of a shard stay together
        found = index.select("shard", "term", "n", "postings", "ids", "lengths").join(F.broadcast(asked), "term", "left").filter("term is null or w is not null")
    else:
        heads = index.filter("term is null").select("shard", "n", "postings", "ids", "lengths")
        found = listed.join(asked, "term").unionByName(heads, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard")
    found = found.select("shard", "n", "postings", "ids", "lengths", "w", "block", "items")
    item_type = asked.schema["items"].dataType.elementType["item_id"].dataType

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(docs: dict | None, blocks: dict) -> Iterator[pa.RecordBatch]:
            for rows in blocks.values() if docs else ():
                best = list(_merged(rows, docs, k, n_docs, n_terms))
                yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in best], types[0]), pa.array([docs["ids"][b[1]] for b in best], types[1]), pa.array([b[2] for b in best], pa.int64())], names=["item_id", "id", "score"])

        shard, docs, blocks = None, None, {}
        for b in batches:
            types = b.schema.field("items").type.value_type.field("item_id").type, b.schema.field("ids").type.value_type
            for r in b.to_pylist():
                if r["shard"] != shard:
                    yield from done(docs, blocks)
                    shard, docs, blocks = r["shard"], None, {}
                if r["ids"] is not None:
                    docs = r
                else:
                    blocks.setdefault(r["block"], []).append(r)
        yield from done(docs, blocks)

    best = found.mapInArrow(merge, f"item_id {item_type.simpleString()}, id {id_type.simpleString()}, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ten best documents for each benchmark item; null and empty texts on either side have no rows."""
    found = search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")
