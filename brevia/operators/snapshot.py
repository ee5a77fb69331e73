"""Statistics that are kept: partial sums of all facts so far, to which only new facts are added, with a time limit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Seconds for which a snapshot is good.
TTL_S = 60
_STATE = "version long, mark long, made_at double, read_rows long"


class Snapshot:
    """Sums of ``sums`` by ``keys`` over a table of facts that only grows, kept below ``path``.

    ``mark`` is a column of longs by which facts come in: later ones have greater values, and those of one value come at once. A refresh within ``ttl_s``
    seconds of the last one reads nothing. Any other one filters facts by the mark, which reaches the scan as a pushed filter or, if facts are
    partitioned by it, prunes partitions; adds up what is new; and merges that with the sums before, a row for each key. So its work grows with
    what is new and with the keys. A version is written before it is named, so a lost job leaves the one before in place, and a refresh that is run again
    gives the same version. Null marks are never read. A null key is a key.
    """

    def __init__(self, path: str, keys: list[str], sums: list[str], mark: str, ttl_s: float = TTL_S):
        self.path, self.keys, self.sums, self.mark, self.ttl_s = path.rstrip("/"), keys, sums, mark, ttl_s

    def state(self, spark: SparkSession) -> Row | None:
        """(version, mark, made_at, read_rows) of the newest version; None before the first."""
        try:
            found = spark.read.schema(_STATE).parquet(f"{self.path}/state")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in (e.getCondition() or ""):
                return None
            raise
        return found.orderBy(F.desc("version")).first()

    def read(self, spark: SparkSession, version: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/version={version}")

    def refresh(self, facts: DataFrame, now: float) -> DataFrame:
        """The sums, made anew from new facts where the time limit has passed; ``now`` is in seconds."""
        spark = facts.sparkSession
        last = self.state(spark)
        if last is not None and now - last["made_at"] < self.ttl_s:
            return self.read(spark, last["version"])
        since = F.lit(True) if last is None else F.col(self.mark) > last["mark"]
        high, n = facts.filter(since).agg(F.max(self.mark), F.count(self.mark)).first()
        number = 0 if last is None else last["version"] + 1
        # facts that come in meanwhile are left to the next refresh
        new = facts.filter(since & (F.col(self.mark) <= high)) if high is not None else facts.limit(0)
        parts = new.groupBy(*self.keys).agg(F.count("*").alias("facts"), *[F.sum(c).alias(c) for c in self.sums])
        if last is not None:
            parts = parts.unionByName(self.read(spark, last["version"])).groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in ("facts", *self.sums)])
        parts.write.mode("overwrite").parquet(f"{self.path}/version={number}")
        mark = high if high is not None else last["mark"] if last is not None else -(2**63)
        spark.createDataFrame([(number, mark, float(now), n)], _STATE).coalesce(1).write.mode("append").parquet(f"{self.path}/state")
        return self.read(spark, number)


def cached(spark: SparkSession, path: str, now: float, make: Callable[[], DataFrame], ttl_s: float = TTL_S) -> DataFrame:
    """What ``make`` gives, at most ``ttl_s`` seconds old: kept below ``path``, and made and kept again after that. ``now`` is in seconds.

    A result is written before it is named, as in ``Snapshot``.
    """
    path = path.rstrip("/")
    try:
        last = spark.read.schema("made_at double").parquet(f"{path}/made").agg(F.max("made_at")).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        last = None
    if last is None or now - last >= ttl_s:
        make().write.mode("overwrite").parquet(f"{path}/result={float(now)}")
        spark.createDataFrame([(float(now),)], "made_at double").coalesce(1).write.mode("append").parquet(f"{path}/made")
        last = float(now)
    return spark.read.parquet(f"{path}/result={last}")


def index_files(facts: DataFrame, column: str) -> DataFrame:
    """(file, low, high, n) of a table read from files: the least and greatest value of a column in each."""
    d = facts.select(F.col("_metadata.file_path").alias("file"), F.col(column).alias("v"))
    return d.groupBy("file").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))


def write_clustered(facts: DataFrame, path: str, column: str, files: int) -> DataFrame:
    """Write facts as Parquet in ranges of a column, sorted within, and an index of the files beside them; gives the index.

    Ranges overlap at most in one value, so a report over a time reads few files.
    """
    facts.repartitionByRange(files, column).sortWithinPartitions(column).write.mode("overwrite").parquet(f"{path}/facts")
    index = index_files(facts.sparkSession.read.parquet(f"{path}/facts"), column)
    index.coalesce(1).write.mode("overwrite").parquet(f"{path}/index")
    return facts.sparkSession.read.parquet(f"{path}/index")


def read_between(spark: SparkSession, path: str, column: str, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Facts with values from ``low`` and below ``high``, from those files only that the index says may hold some. The list of these files goes through the driver, as any list of files to read does."""
    index, fits = spark.read.parquet(f"{path}/index"), F.lit(True)
    wanted = F.lit(True)
    if low is not None:
        fits, wanted = fits & (F.col("high") >= low), wanted & (F.col(column) >= low)
    if high is not None:
        fits, wanted = fits & (F.col("low") < high), wanted & (F.col(column) < high)
    files = [r["file"] for r in index.filter(fits).select("file").toLocalIterator()]
    if not files:
        return spark.read.parquet(f"{path}/facts").limit(0)
    return spark.read.parquet(*files).filter(wanted)


def retention(index: DataFrame, oldest: Column) -> DataFrame:
    """(file, action) of the files that hold facts older than ``oldest``: ``delete`` those without others, ``rewrite`` the rest."""
    return index.filter(F.col("low") < oldest).select("file", F.when(F.col("high") < oldest, "delete").otherwise("rewrite").alias("action"))
