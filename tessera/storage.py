"""Working tables in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a temporary one where a local session names none."""
    root = spark.conf.get(CONF, None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"executors share no folder: set {CONF}")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set(CONF, root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Rounds:
    """A loop's stored tables of one kind: the last two stay, those before them are deleted."""

    def __init__(self, name: str):
        self.name, self.paths = name, []

    def store(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        path = scratch(spark, self.name)
        df.write.parquet(path)
        self.paths.append(path)
        while len(self.paths) > 2:
            drop(spark, self.paths.pop(0))
        return spark.read.schema(df.schema).parquet(path)
