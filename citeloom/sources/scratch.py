"""Where intermediate tables go that cut lineage, and how rows are dealt over cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows of df from a table written to the folder in spark.checkpoint.dir, which driver and executors share; only in local mode is one made up."""
    spark = df.sparkSession
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="citeloom-"))
        root = sc.getCheckpointDir()
    path = f"{str(root).rstrip('/')}/citeloom/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows of df dealt over all cores by keys that repeat little. For small rows of which much is made: their files are read by a few tasks, and small shuffles are joined into one."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)
