"""Shared-folder tables: how operators cut lineage and hand data from job to job.

Every intermediate goes to the folder named by ``spark.checkpoint.dir`` through Spark's own
committed Parquet writer, so it survives a lost executor and needs no local disk.
"""

from __future__ import annotations

import contextlib
import itertools
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one where a local session names none (tests)."""
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"executors share no folder: set {CHECKPOINT_CONF}")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set(CHECKPOINT_CONF, root)
    return root.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"


#: Paths given out and not deleted yet.
_GIVEN: dict[str, None] = {}


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _GIVEN[path] = None
    return path


@contextlib.contextmanager
def swept(spark: SparkSession):
    """Deletes, at its end, what was put into the shared folder meanwhile, but for the paths it has been told to keep
    (it gives the function that does so). For work whose result has been written by then."""
    before, kept = set(_GIVEN), set()
    try:
        yield kept.add
    finally:
        for path in [p for p in _GIVEN if p not in before and p not in kept]:
            drop_path(spark, path)


def clear(spark: SparkSession) -> None:
    """Delete everything this application has put there; results not yet written elsewhere go with it."""
    drop_path(spark, own_dir(spark))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    _GIVEN.pop(path, None)
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def keep(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: (frame, its path)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Keys that hold a larger share of all rows than one in HEAVY are joined apart; there are HEAVY of them at most.
HEAVY = 50_000


def join_heavy(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` left-joined to ``groups`` (stored; one row a key, ``size`` the rows it stands for of ``total``): heavy keys
    by broadcast, so that no task gets all rows of one, and the others by shuffle."""
    heavy = groups.where(F.col(size) > total // HEAVY + 1000)
    if heavy.isEmpty():
        return rows.join(groups, keys, "left")
    seen = rows.join(F.broadcast(heavy.select(*keys, F.lit(True).alias("_heavy"))), keys, "left")
    light = seen.where("_heavy IS NULL").drop("_heavy").join(groups, keys, "left")
    return light.unionByName(rows.join(F.broadcast(heavy), keys))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids up to this number (16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_IDS = 2_000_000


def small_ids(ids: DataFrame) -> DataFrame:
    """``ids`` with a broadcast hint if they are few enough, so that wide rows stay where they are."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def row_key(id_col: str, text: str) -> Column:
    """A row's number by its id and text (or a digest that stands for it), null or not: 64 bits of hash."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("bigint"), F.col(text).isNull(), F.col(text).cast("string"))


def without(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is not in column ``row`` of ``gone``."""
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in (f"_gone_{k}" for k in itertools.count()) if n not in taken)
    keys, _ = keep(gone.select(F.col("row").alias(name)).distinct(), "dropped-rows")
    return docs.join(small_ids(keys), key == F.col(name), "left_anti")
