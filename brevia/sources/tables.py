"""Reading tables, and dealing out what comes in too few pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(d: DataFrame, key: str) -> DataFrame:
    """The rows in as many partitions as there are cores, if they come in fewer than half of that, as from one file with one row group.

    For work that takes long for each byte, as on texts, where a shuffle costs less than idle cores. Large tables have partitions enough and
    stay as they are, so this shuffle doesn't grow with the data.
    """
    cores = d.sparkSession.sparkContext.defaultParallelism
    return d if 2 * d.rdd.getNumPartitions() >= cores else d.repartition(cores, key)
