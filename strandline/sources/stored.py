"""Tables that are made once and read many times, in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only where the session names no shared folder and runs on one machine, as in tests.
LOCAL_SHARED = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_SHARED)
        named = LOCAL_SHARED
    return named.rstrip("/")


def stored(df: DataFrame, name: str, *cluster_by: str) -> DataFrame:
    """df as a table of its own: what reads it has a plan of one scan, and lost executors cost no more than their tasks.

    With cluster_by the rows of a key lie together in a file, sorted.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if cluster_by:
        df = df.repartition(*cluster_by).sortWithinPartitions(*cluster_by)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, *paths: str) -> int:
    """Changes with the names, sizes and times of the files under the paths; their contents are not read."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "length", "modificationTime")
    return files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("h")).first()["h"]


_held: dict[tuple, object] = {}


def once(spark: SparkSession, key: tuple, sources: tuple[str, ...], make: Callable):
    """What make() returns, made once for a session, key and state of the source files; what stood for an older state is let go."""
    place = (spark.sparkContext.applicationId, *key, *sources)
    state = fingerprint(spark, *sources)
    if (found := _held.get(place)) is None or found[0] != state:
        found = _held[place] = (state, make())
    return found[1]
