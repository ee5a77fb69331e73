"""Byte-level BPE encoding and decoding with a given vocabulary."""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brevia.llm.common import slices, small_batches, table

#: The split into words that byte-level vocabularies of this kind are made for.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of more bytes are merged with a heap, for which time is no square of the length.
SHORT = 128
#: Encoded words that a task remembers at most.
REMEMBERED = 200_000
_NEVER = 1 << 30


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges and tokens of a tokenizer file (JSON with ``model.vocab``, ``model.merges`` and ``added_tokens``)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, letters = spec["model"], _byte_letters()
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {ids[a] << 32 | ids[b]: i for i, (a, b) in reversed(list(enumerate(pairs)))}
        self.merged = [ids[a + b] for a, b in pairs]
        self.of_byte = [0] * 256
        for letter, byte in letters.items():
            self.of_byte[byte] = ids[letter]
        self.bytes = [b""] * (1 + max(*ids.values(), *(t["id"] for t in spec["added_tokens"])))
        for token, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.bytes[i] = content.encode()
        alternatives = "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))
        self.split_added = regex.compile(f"({alternatives})") if alternatives else None
        self.words = regex.compile(WORDS)
        self.known: dict[str, bytes] = {}

    def _short(self, ids: list[int]) -> list[int]:
        """Parts and the ranks of adjacent pairs lie in two arrays; the least rank, leftmost of equals, goes first."""
        rank, merged = self.rank, self.merged
        ranks = [rank.get(a << 32 | b, _NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == _NEVER:
                break
            i = ranks.index(least)
            ids[i] = merged[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank.get(ids[i - 1] << 32 | ids[i], _NEVER)
            if i < len(ranks):
                ranks[i] = rank.get(ids[i] << 32 | ids[i + 1], _NEVER)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same merges in the same order, found with a heap over linked parts."""
        rank, merged = self.rank, self.merged
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merged[r], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (r := rank.get(ids[left] << 32 | ids[right])) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> bytes:
        ids = [self.of_byte[b] for b in word.encode()]
        found = array("I", self._short(ids) if len(ids) <= SHORT else self._long(ids)).tobytes()
        if len(word) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, word = self.known.get, self._word
        parts = self.split_added.split(text) if self.split_added and self.split_added.search(text) else [text]
        out = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(array("I", [self.added[part]]).tobytes())
            else:
                out += [known(w) or word(w) for w in self.words.findall(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        held = array("I")
        held.frombytes(ids)
        return b"".join(map(self.bytes.__getitem__, held)).decode("utf-8", "replace")


class BpeTokenizer:
    """Column functions for a vocabulary file.

    The driver reads the file, whose size doesn't depend on the data, and sends it to the executors, which need no path.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._sent = spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    def encode(self, text: Column) -> Column:
        """Binary column: the ids of the whole text, as little-endian unsigned 32-bit integers; null for a null text.

        Texts in which an added token is written out get its id there. An empty text has no ids.
        """
        sent = self._sent

        @F.pandas_udf("binary")
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            vocabulary = Vocabulary(sent.value)
            for texts in slices(batches):
                yield pd.Series([None if t is None else vocabulary.encode(t) for t in texts], dtype=object)

        return of(text)

    def decode(self, ids: Column) -> Column:
        """The text of such a binary column, added tokens written out; bytes that are no UTF-8 become U+FFFD."""
        sent = self._sent

        @F.pandas_udf("string")
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            vocabulary = Vocabulary(sent.value)
            for rows in slices(batches):
                yield pd.Series([None if x is None else vocabulary.decode(x) for x in rows], dtype=object)

        return of(ids)


    def round_trip(self, text: Column) -> Column:
        """Struct (ids, text) of encoding and decoding in one step, so that a task has one Python worker."""
        sent = self._sent

        @F.pandas_udf("ids binary, text string")
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            vocabulary = Vocabulary(sent.value)
            for texts in slices(batches):
                ids = [None if t is None else vocabulary.encode(t) for t in texts]
                yield pd.DataFrame({"ids": ids, "text": [None if x is None else vocabulary.decode(x) for x in ids]}, dtype=object)

        return of(text)


def ids_array(ids: Column) -> Column:
    """The ids as an array of long, without Python."""
    at = F.sequence(F.lit(1), F.greatest(F.octet_length(ids) - 3, F.lit(1)), F.lit(4))
    byte = lambda i, k: F.conv(F.hex(F.substring(ids, i + k, 1)), 16, 10).cast("long")
    number = lambda i: byte(i, 0) + 256 * byte(i, 1) + 65536 * byte(i, 2) + 16777216 * byte(i, 3)
    return F.when(F.octet_length(ids) > 0, F.transform(at, number)).otherwise(F.array().cast("array<bigint>"))


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids", check: str | None = None) -> DataFrame:
    """Add column ``out`` with the ids of each whole text and, if named, column ``check`` with their decoded text.

    A null text counts as empty. Rows, repeated ones too, are encoded alone; other columns may have any names but these.
    """
    small_batches(docs.sparkSession)
    tokenizer = BpeTokenizer(docs.sparkSession, path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    if check is None:
        return docs.withColumn(out, tokenizer.encode(text))
    d = docs.select(F.struct("*").alias("__row"), tokenizer.round_trip(text).alias("__both"))
    return d.select("__row.*", F.col("__both.ids").alias(out), F.col("__both.text").alias(check))


def digests(docs: DataFrame, id_col: str = "doc_id", ids: str = "__ids", decoded: str = "__decoded") -> DataFrame:
    return docs.select(
        id_col, (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.encode(decoded, "UTF-8"), 256).alias("decoded_sha256"),
    )


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, repeated ones and null ids too; a null text is empty, with no tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode_documents(docs, default_path(), out="__ids", check="__decoded"))
