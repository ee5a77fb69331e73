"""Where jobs may write what they need again: a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name below the session's checkpoint folder. A local session that names none gets a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-checkpoint-")
    return f"{root.rstrip('/')}/brevia-{uuid.uuid4().hex}"
