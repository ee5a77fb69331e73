"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brevia.llm.common import cut, slices, small_batches, table

#: Labelled rows that a model is fitted on at most, by order of a hash; a lexicon has so many entries at most.
TRAIN_ROWS = 12_000
LEXICON_ENTRIES = 5_000
#: A lexicon entry occurs in so many toxic documents at least, and so much of its documents are toxic.
LEAST_TOXIC, LEAST_SHARE = 4, 0.75

#: Pronouns of the second person in the corpus's languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros".split())
FEATURES = (
    "lexicon_density", "lexicon_words", "lexicon_most", "stem_density", "stem_words", "near_second_person", "second_person",
    "capitals", "capital_words", "exclamations", "punctuation", "symbols", "obfuscated", "log_words",
)

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TRIM = "\"'.,;:!?()[]{}<>*#%&|~`-_"
_LEET = str.maketrans("013457@$!", "oieastasi")
_MIXED = re.compile(r"(?=.*[A-Za-z])(?=.*[0-9@$!*])[A-Za-z0-9@$!*]{3,}$")
_SYMBOL, _PUNCT = re.compile(r"[#*$%&|<>]"), re.compile(r"[^\w\s]")
#: Words at most so far from a pronoun are near it.
_NEAR = 3


def _plain(word: str) -> tuple[str, bool]:
    """The word in lower case without punctuation around it and with look-alikes as letters; whether it had some."""
    w = word.strip(_TRIM)
    if _MIXED.match(w):
        return w.translate(_LEET).replace("*", "").lower(), True
    return w.lower(), False


def _stems(word: str) -> tuple[str, ...]:
    return (word[:4] + "+", word[:5] + "+") if len(word) > 5 else (word[:4] + "+",) if len(word) > 4 else ()


def entries(texts: pd.Series) -> pd.Series:
    """The distinct words and stems of each text that a lexicon could hold."""
    out = []
    for text in texts:
        words = {_plain(w)[0] for w in set(_WORD.findall(text or ""))}
        out.append(sorted({x for w in words if len(w) > 2 for x in (w, *_stems(w))}))
    return pd.Series(out)


def dense_features(text: str | None, lexicon: dict[str, float], cache: dict) -> list[float]:
    text = text or ""
    words = _WORD.findall(text)
    n = len(words) or 1
    hits, stems, second, obfuscated, capitals = [], [], [], 0, 0
    total = stem_total = most = 0.0
    get = cache.get
    for i, word in enumerate(words):
        known = get(word)
        if known is None:
            plain, mixed = _plain(word)
            stem = max((lexicon.get(s, 0.0) for s in _stems(plain)), default=0.0)
            known = (lexicon.get(plain, 0.0), stem, plain in SECOND_PERSON, mixed, len(word) > 2 and word.isupper())
            known = None if not any(known) else known
            if len(cache) < 200_000:
                cache[word] = known or False
        if known:
            weight, stem, person, mixed, capital = known
            if weight:
                hits.append(i)
                total, most = total + weight, max(most, weight)
            if stem:
                stems.append(i)
                stem_total += stem
            if person:
                second.append(i)
            obfuscated += mixed
            capitals += capital
    at = {j for i in second for j in range(i - _NEAR, i + _NEAR + 1)}
    near = sum(i in at for i in hits) + sum(i in at for i in stems)
    letters = sum(map(str.isalpha, text)) or 1
    upper = sum(map(str.isupper, text))
    size = len(text) or 1
    return [
        total / n, float(len(hits)), most, stem_total / n, float(len(stems)), near / n, len(second) / n,
        upper / letters, capitals / n, text.count("!") / n, len(_PUNCT.findall(text)) / size, len(_SYMBOL.findall(text)) / size,
        obfuscated / n, float(n) ** 0.25,
    ]


@dataclass
class ToxicityModel:
    """What ``fit`` learned; ``trees`` is None where the labels had one class only, and all scores are ``prior``."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    prior: float

    def features(self, text: Column) -> Column:
        lexicon = self.lexicon

        @F.pandas_udf("array<double>")
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            cache: dict = {}
            for texts in slices(batches):
                yield pd.Series([dense_features(t, lexicon, cache) for t in texts])

        return of(text)

    def score(self, docs: DataFrame, text_col: str = "text", out: str = "score") -> DataFrame:
        """Add column ``out``, from 0 to 1: the calibrated share of such texts that are toxic.

        A null text scores as an empty one. Rows and other columns stay and may have any names.
        """
        small_batches(docs.sparkSession)
        if self.trees is None:
            return docs.withColumn(out, F.lit(self.prior))
        d = docs.select(F.struct("*").alias("__row"), array_to_vector(self.features(F.col(text_col))).alias("__features"))
        trees = self.trees.copy()
        trees.setFeaturesCol("__features").setRawPredictionCol("__raw").setProbabilityCol("__p").setPredictionCol("__c")
        d = trees.transform(d).withColumn("__margin", vector_to_array("__p")[1])
        if self.calibration is None:
            return d.select("__row.*", F.col("__margin").alias(out))
        d = self.calibration.setFeaturesCol("__margin").setPredictionCol("__y").transform(d)
        return d.select("__row.*", F.greatest(F.least("__y", F.lit(1.0)), F.lit(0.0)).alias(out))


def fold_of(id_col: Column) -> Column:
    """0, 1 or 2; 1 is held out of training. A null id is as an empty one."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(3)).cast("int")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = TRAIN_ROWS, seed: int = 0) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled rows whose fold isn't 1, the first by a hash of the id.

    Fold 0 gives the lexicon and the trees, fold 2, which they haven't seen, the isotonic calibration. The lexicon is
    of words and word beginnings (four and five letters, written with a plus) that are in far more toxic documents
    than others; its weights are log odds. Labels of one id are combined by their maximum; null labels and ids are
    left out. Without rows the prior is 0.
    """
    small_batches(docs.sparkSession)
    sample = (
        labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__label"))
        .filter("__id is not null and __label is not null")
        .filter(fold_of(F.col("__id")) != 1)
        .groupBy("__id").agg(F.max("__label").alias("__label"))
        .orderBy(F.xxhash64("__id", F.lit(seed)), "__id").limit(max_rows)
    )
    # max_rows bounds what is broadcast, so that the texts aren't shuffled
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(sample), "__id")
    rows = cut(rows.withColumn("__fold", fold_of(F.col("__id"))).repartition(12, "__id"))
    counts = {(r["__fold"], r["__label"]): r["count"] for r in rows.groupBy("__fold", "__label").count().collect()}
    total = sum(counts.values())
    prior = sum(n * y for (_, y), n in counts.items()) / total if total else 0.0
    n1, n0 = (sum(n for (f, y), n in counts.items() if f == 0 and (y > 0) == t) for t in (True, False))
    if not n1 or not n0:
        return ToxicityModel({}, None, None, float(prior))
    train = rows.filter("__fold = 0")
    words = train.select("__label", F.explode(F.pandas_udf(entries, "array<string>")("__text")).alias("entry"))
    words = words.groupBy("entry").agg(F.sum("__label").alias("a"), F.sum(1 - F.col("__label")).alias("b"))
    words = words.withColumn("weight", F.log((F.col("a") + 0.5) / n1) - F.log((F.col("b") + 0.5) / n0))
    words = words.filter((F.col("a") >= LEAST_TOXIC) & (F.col("a") >= LEAST_SHARE * (F.col("a") + F.col("b"))) & (F.col("weight") > 0))
    lexicon = {r["entry"]: r["weight"] for r in words.orderBy(F.desc(F.col("a") * F.col("weight")), "entry").limit(LEXICON_ENTRIES).collect()}
    model = ToxicityModel(lexicon, None, None, float(prior))
    dense = cut(rows.select("__fold", "__label", array_to_vector(model.features(F.col("__text"))).alias("__features")).coalesce(6))
    trees = GBTClassifier(featuresCol="__features", labelCol="__label", maxIter=24, maxDepth=3, stepSize=0.2, subsamplingRate=0.8, minInstancesPerNode=8, seed=seed)
    model.trees = trees.fit(dense.filter("__fold = 0"))
    held = dense.filter("__fold = 2")
    if counts.get((2, 1.0)) and counts.get((2, 0.0)):
        scored = model.trees.setFeaturesCol("__features").setRawPredictionCol("__raw").setProbabilityCol("__p").setPredictionCol("__c").transform(held)
        scored = scored.select("__label", vector_to_array("__p")[1].alias("__margin"))
        model.calibration = IsotonicRegression(featuresCol="__margin", labelCol="__label", predictionCol="__y").fit(scored)
    return model


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; a null text scores as an empty one, and a null id is in the fold of an empty one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    d = model.score(docs)
    held_out = fold_of(F.col("doc_id")) == 1
    return d.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
