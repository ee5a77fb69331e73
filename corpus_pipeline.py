"""A training corpus from raw documents, in five stages, each a DataFrame in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brevia.llm import bpe, jaccard, mixing, secrets, toxicity
from brevia.llm.common import table

#: Documents with this score or more are rejected as toxic.
TOXIC = 0.7


def _counted(before: DataFrame, after: DataFrame) -> DataFrame:
    """``n_chars`` follows the text where there is one."""
    return after.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*before.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC, by a classifier fitted on labelled ones among them; null texts score as empty."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return model.score(docs, out="__score").filter(F.col("__score") < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group whose five-word shingle sets are linked by similarities of 0.8 or more.

    Null texts and those without words have no shingles and stay; so do rows with a null id, and all rows of an id that stays.
    """
    return jaccard.without_near_copies(docs, words=5, num=80, den=100)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with a mark in place of each secret."""
    return _counted(docs, secrets.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one per source may be cut short, and documents without words go."""
    return _counted(docs, mixing.mixed_documents(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, round_trip) of each document of the mix; ids are little-endian 32-bit integers. A null text is empty, and repeated rows are encoded alone."""
    d = bpe.encode_documents(docs, bpe.default_path(), out="__ids", check="__decoded")
    same: Column = F.coalesce(F.col("text"), F.lit("")) == F.col("__decoded")
    return d.select("doc_id", "lang", "source", (F.octet_length("__ids") / 4).cast("long").alias("n_tokens"), F.col("__ids").alias("ids"), same.alias("round_trip"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("encode", encode_tokens),
]

#: The classifier and the tokenizer have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, from the table of documents. An empty table gives no rows; what nulls and repeated rows give is said at each stage."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
