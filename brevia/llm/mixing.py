"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brevia.llm.common import cut, join_small, table, word_count

#: Weights of sources in order of name, repeating.
SOURCE_WEIGHTS = (3.0, 1.0, 2.0)
#: Parts into which a source's keys are cut at each of two levels.
PARTS = 1024


def quality_weight(text: Column) -> Column:
    """A document's quality in 0.1 to 1: the share of its characters that aren't table or markup symbols, squared."""
    n = F.greatest(F.char_length(text), F.lit(1))
    clean = F.char_length(F.translate(text, "#*$%&|<>", "")) / n
    return F.coalesce(F.greatest(F.pow(clean, F.lit(2.0)), F.lit(0.1)), F.lit(0.1))


def source_targets(sizes: DataFrame, total: float = 1.5, most: float = 2.0, weights: tuple = SOURCE_WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``total`` times all sizes.
    No target is above ``most`` times its source's size; what that cuts off is shared again by weight. Shares
    are a water level times the weight, so sources fill up in order of size over weight, and the level is found
    from running sums in that order. The window holds one row per source, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    d = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn)).withColumn("cap", most * F.col("source_size"))
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    left = total * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    d = d.withColumn("level", left / F.sum("w").over(after))
    d = d.withColumn("level", F.max(F.when(F.col("level") < F.col("cap") / F.col("w"), F.col("level"))).over(every))
    target = F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return d.select("source", "source_size", target.cast("double").alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    total: float = 1.5, most: float = 2.0, weights: tuple = SOURCE_WEIGHTS, seed: int = 0, weight: Column | None = None,
) -> DataFrame:
    """Rows (id, size, source_size, target, taken, text, source): how many words the mix takes of each document.

    A source that is to give more than it holds is taken whole as often as that fits (complete epochs). The
    rest is a fractional selection by Efraimidis and Spirakis: each document draws the key u^(1/w), with w its
    quality weight and u from a hash of its id and the seed, and documents are taken in falling order of keys
    until the running sum of sizes reaches the rest. The last one is taken in part, so that the words of a source
    are its target to the word.

    No task holds a source. Its keys are cut into PARTS parts, of which all but one lie wholly on one side of the
    cut; the one part is cut again, and only what lies in that is sorted: about a millionth of the source.

    A null text has size 0 and is taken 0 times; a null source is a source of its own, named last; null ids draw
    as one id. Ties (repeated rows) go by text, and between equal rows it doesn't matter which is taken. An empty table
    gives an empty result. Input columns other than the three named aren't looked at.
    """
    text = F.col("text")
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
    d = d.withColumns({"size": word_count(text), "key": F.pow(u, 1 / (quality_weight(text) if weight is None else weight)), "tie": F.xxhash64("text")})
    place = (1 - F.col("key")) * PARTS
    d = d.withColumns({"p1": F.floor(place).cast("int"), "p2": F.floor((place - F.floor(place)) * PARTS).cast("int")})
    d = cut(d.select("id", "size", "source", "key", "tie", "p1", "p2"))

    first = d.groupBy("source", "p1").agg(F.sum("size").alias("words"))
    first = cut(first)
    goals = source_targets(first.groupBy("source").agg(F.sum("words").alias("source_size")), total, most, weights)
    goals = goals.withColumn("goal", F.round("target").cast("long"))  # rounded before it is divided, so that the rest is below the size
    goals = goals.withColumn("epochs", F.expr("if(source_size > 0, goal div source_size, 0L)"))
    goals = cut(goals.withColumn("rest", F.expr("if(source_size > 0, goal % source_size, 0L)")).drop("goal"))
    n = goals.count()

    def crossing(parts: DataFrame, part: str, goal: str) -> DataFrame:
        """Per source the part in which the running sum passes the goal, and the sum before it; no row if none does."""
        w = Window.partitionBy("source").orderBy(part)
        upto = parts.withColumn("upto", F.sum("words").over(w)).filter(f"upto > {goal}")
        return upto.groupBy("source").agg(F.min_by(F.struct(F.col(part).alias("part"), (F.col("upto") - F.col("words")).alias("before")), F.col(part)).alias("x")).select("source", "x.*")

    at1 = crossing(join_small(first, goals.select("source", "rest"), ["source"], rows=n), "p1", "rest")
    at1 = cut(join_small(at1, goals.select("source", "rest"), ["source"], rows=n).select("source", F.col("part").alias("c1"), F.col("before").alias("b1"), (F.col("rest") - F.col("before")).alias("rest1")))
    d = join_small(join_small(d, goals, ["source"], rows=n), at1, ["source"], rows=n)
    inside = d.filter("p1 = c1").groupBy("source", "p2").agg(F.sum("size").alias("words"), F.first("rest1").alias("rest1"))
    at2 = cut(crossing(inside, "p2", "rest1").select("source", F.col("part").alias("c2"), F.col("before").alias("b2")))
    d = join_small(d, at2, ["source"], rows=n)
    sorted_part = d.filter("p1 = c1 and p2 = c2")
    w = Window.partitionBy("source").orderBy(F.desc("key"), "id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum("size").over(w), F.lit(0))
    sorted_part = sorted_part.withColumn("part_taken", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest1") - F.col("b2") - upto)))
    whole = F.coalesce((F.col("p1") < F.col("c1")) | ((F.col("p1") == F.col("c1")) & (F.col("p2") < F.col("c2"))), F.lit(False))
    others = d.filter("not coalesce(p1 = c1 and p2 = c2, false)").withColumn("part_taken", F.when(whole, F.col("size")).otherwise(F.lit(0)))
    out = others.unionByName(sorted_part)
    taken = F.col("epochs") * F.col("size") + F.col("part_taken")
    return out.select("id", "tie", "size", "source_size", "target", taken.cast("long").alias("taken"), "epochs", "source")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix, with the columns they had: each as often as it is taken.

    The one document of a source that is taken in part gives its first words, up to the end of the last one
    taken. Documents of size 0 are in no mix. Rows that are equal in id, text and source share what they are given
    evenly, rounded up to words.
    """
    taken = mix(docs, id_col, text_col, source_col, **options).groupBy("id", "tie", "source").agg(F.sum("taken").alias("__taken"), F.count("*").alias("__rows"), F.max("size").alias("__size"))
    taken = taken.filter("__taken > 0").select(F.col("id").alias("__id"), F.col("tie").alias("__tie"), F.col("source").alias("__source"), "__taken", "__rows", "__size")
    d = docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("__i"), F.col(text_col).alias("__t"), F.col(source_col).alias("__s"))
    on = F.col("__i").eqNullSafe(F.col("__id")) & (F.xxhash64("__t") == F.col("__tie")) & F.col("__s").eqNullSafe(F.col("__source"))
    d = d.join(taken, on).withColumn("__each", F.ceil(F.col("__taken") / F.col("__rows")).cast("long"))
    times = F.ceil(F.col("__each") / F.col("__size")).cast("int")
    d = d.withColumn("__time", F.explode(F.sequence(F.lit(1), times)))
    words = F.least(F.col("__each") - (F.col("__time") - 1) * F.col("__size"), F.col("__size"))
    part = F.array_join(F.slice(F.split("__t", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), words.cast("int")), "")
    text = F.when(words < F.col("__size"), part).otherwise(F.col("__t"))
    return d.select(*[text.alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in docs.columns])


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row; a null text has size 0, a null source comes last, and of equal rows it doesn't matter which is taken."""
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
