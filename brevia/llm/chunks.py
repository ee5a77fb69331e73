"""Substring deduplication by content-defined chunking with a gear rolling hash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brevia.llm.common import cut, table
from brevia.llm.shingles import mixed

#: Bytes of a chunk at least and at most, and bits of the hash that are zero where a chunk may end.
LEAST, MOST, BITS = 16, 128, 4
#: Runs of repeated chunks of fewer bytes stay, unless they are the whole text.
LEAST_RUN = 100

#: A random 32-bit number for each byte, from a rule.
_GEAR = (mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(b: np.ndarray) -> np.ndarray:
    """At each byte the gear hash h = (h << 1) + gear[byte] in 32 bits, so of the last 32 bytes: all of them by doubling."""
    h = _GEAR[b]
    with np.errstate(over="ignore"):
        for shift in (1, 2, 4, 8, 16):
            ahead = np.zeros_like(h)
            ahead[shift:] = h[:-shift]
            h = h + (ahead << np.uint32(shift))
    return h


def chunk_ends(b: np.ndarray) -> list[int]:
    """Ends of the chunks: where the hash's top BITS bits are zero, LEAST bytes on at least, MOST bytes on at most."""
    n = len(b)
    out, last = [], 0
    for c in (np.flatnonzero(gear_hashes(b) >> np.uint32(32 - BITS) == 0) + 1).tolist():
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST:
            last = c
            out.append(c)
    while n - last > MOST:
        last += MOST
        out.append(last)
    if n > last:
        out.append(n)
    return out


def chunks(data: bytes) -> tuple[list[int], list[int]]:
    """(ends, digests) of the chunks of a text."""
    ends = chunk_ends(np.frombuffer(data, np.uint8))
    digests = [xxhash.xxh3_64_intdigest(data[s:e]) - (1 << 63) for s, e in zip([0, *ends], ends)]
    return ends, digests


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_run: int = LEAST_RUN, out: str = "spans") -> DataFrame:
    """Rows (id, text, n_chunks, n_repeated, ``out``): the byte spans of each text that documents with smaller ids hold too.

    Texts are cut where their content says so, so that an insertion moves few cuts, and chunks are known by a digest. Of
    each digest the document with the smallest id keeps its chunks, and in all others they are repeated. Runs of
    neighbouring repeated chunks with ``least_run`` bytes or more are spans to remove: shorter ones may be chance.

    A document sends each digest once. First documents come from an aggregation with partial sums, and the digests that
    several documents share are then joined with all again, where the engine splits hot keys.

    A null text is empty and has no chunks. Rows with a null id neither lose nor cause anything. An id on several rows stands
    for documents of equal rank. Other columns aren't looked at; an empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = d.schema["id"].dataType.simpleString()

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "keys": pd.Series([list(dict.fromkeys(chunks(t.encode())[1])) for t in b["text"]], dtype=object)})

    keyed = d.filter("id is not null").mapInPandas(digests, f"id {id_type}, keys array<long>").select("id", F.explode("keys").alias("key"))
    several = cut(keyed.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("key", "first"))
    later = keyed.join(several, "key").filter("id > first").groupBy("id").agg(F.collect_set("key").alias("repeated"))

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, repeated in zip(b["text"], b["repeated"], strict=True):
                ends, keys = chunks(text.encode())
                known = set() if repeated is None else set(repeated)
                spans, hits, at = [], 0, 0
                for end, key in zip(ends, keys, strict=True):
                    if key in known:
                        hits += 1
                        if spans and spans[-1][1] == at:
                            spans[-1][1] = end
                        else:
                            spans.append([at, end])
                    at = end
                rows.append((len(ends), hits, [{"start": s, "end": e} for s, e in spans if e - s >= least_run]))
            yield pd.DataFrame({"id": b["id"], "text": b["text"], **{c: pd.Series([r[i] for r in rows], dtype=t) for i, (c, t) in enumerate((("n_chunks", "int64"), ("n_repeated", "int64"), (out, object)))}})

    schema = f"id {id_type}, text string, n_chunks long, n_repeated long, {out} array<struct<start:long,`end`:long>>"
    done = d.filter("id is not null").join(later, "id", "left").select("id", "text", "repeated").mapInPandas(marked, schema)
    # rows without an id don't meet on their null
    return done.union(d.filter("id is null").select("id", "text", F.lit(None).cast("array<long>").alias("repeated")).mapInPandas(marked, schema))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_run: int = LEAST_RUN, out: str = "spans") -> DataFrame:
    """``repeated_chunks``, where a text whose chunks are all repeated is a span as a whole, however short."""
    d = repeated_chunks(docs, id_col, text_col, least_run, out)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end")))
    return d.withColumn(out, F.when((F.col("n_chunks") > 0) & (F.col("n_repeated") == F.col("n_chunks")), whole).otherwise(F.col(out)))


def kept_bytes(data: bytes, spans) -> bytes:
    out, at = [], 0
    for x in spans:
        out.append(data[at : x["start"]])
        at = x["end"]
    return b"".join([*out, data[at:]])


def without_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_run: int = LEAST_RUN) -> DataFrame:
    """Rows (id, text) less the spans; a character cut in part becomes U+FFFD."""

    @F.pandas_udf("string")
    def rest(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([kept_bytes(t.encode(), x).decode("utf-8", "replace") if len(x) else t for t, x in zip(texts, spans, strict=True)], dtype=object)

    return repeated_passages(docs, id_col, text_col, least_run).select("id", rest("text", "spans").alias("text"))


def _digest(text: str, spans: str) -> Column:
    @F.pandas_udf("n_bytes long, n_removed long, kept_sha256 string")
    def of(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for t, x in zip(texts, found, strict=True):
            data = t.encode()
            kept = kept_bytes(data, x)
            rows.append((len(data), len(data) - len(kept), hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "kept_sha256"])

    return of(text, spans)


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, n_chunks, n_repeated, kept_sha256) of each row; a null text is empty, a row with a null id loses nothing, rows of one id are of equal rank and keep what they share."""
    d = repeated_passages(table(spark, sf_dir, "documents"))
    d = d.select(F.col("id").alias("doc_id"), "n_chunks", "n_repeated", F.size("spans").cast("long").alias("n_spans"), _digest("text", "spans").alias("x"))
    return d.select("doc_id", "x.n_bytes", "x.n_removed", "n_spans", "n_chunks", "n_repeated", "x.kept_sha256")
