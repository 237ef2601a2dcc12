"""What several operators need: the shared folder, tables by name, word rules."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only where the session names no shared folder and runs on one machine, as in tests.
LOCAL_SHARED = "/tmp/checkpoints"

#: White space that ends a word: space and \t \n \v \f \r.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_SHARED)
        named = LOCAL_SHARED
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df as a table in the shared folder; cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


#: Bytes of the Arrow batches that carry whole texts to Python, where the session names no limit of its own.
BATCH_BYTES = "8m"


def bounded_batches(spark: SparkSession) -> None:
    """Keeps batches small: an executor holds several outside its heap, and long texts make 10,000 rows of them large."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def trimmed(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f over a task's batches; at the end of the task, freed memory goes back to the system.

    Python workers stay alive between stages, and what they keep counts
    against the executor's memory while others work.
    """

    @wraps(f)
    def run(parts: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        try:
            yield from f(parts)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


#: Rows of ids and hashes (16 bytes each) that are broadcast at most.
BROADCAST_ROWS = 400_000
#: Shares that the rows of one key are cut in where they meet what is known of the key.
SALTS = 512


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def salted(rows: DataFrame, spread_by: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))


def looked_up(rows: DataFrame, key: str, spread_by: str, table: DataFrame, asking: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row per key, when one key may hold a great part of the rows.

    Each key asks once for every salt of its rows, at most SALTS times; rows
    meet the answer by key and salt. rows must have no column salt. asking has
    the same keys and spread_by where rows are costly to make twice.
    """
    asked = salted(rows if asking is None else asking, spread_by).select(key, "salt").distinct()
    rows = salted(rows, spread_by)
    return rows.join(asked.join(table, key), [key, "salt"], how).drop("salt")


def split_join(rows: DataFrame, key: str, spread_by: Column, table: DataFrame, most: int, splits: int = 64, how: str = "inner") -> DataFrame:
    """rows joined with table on key: broadcast up to `most` rows, else with every key of the table in `splits` places."""
    if table.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(table), key, how)
    placed = table.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    return rows.withColumn("split", F.pmod(spread_by, F.lit(splits)).cast("int")).join(placed, [key, "split"], how).drop("split")


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, broadcast if a count shows that it has no more rows than that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def keyed(docs: DataFrame, keys: DataFrame, how: str, id_col: str, text_col: str) -> DataFrame:
    """docs joined (left_semi or left_anti) on id and text with stored keys (doc_id, text_hash); shuffles texts only if the keys are many."""
    names = [unused(docs, "key_id"), unused(docs, "key_hash")]
    keys = keys.select(F.col("doc_id").alias(names[0]), F.col("text_hash").alias(names[1]))
    same = F.col(id_col).eqNullSafe(F.col(names[0])) & (F.xxhash64(text_col) == F.col(names[1]))
    return docs.join(maybe_broadcast(keys), same, how)


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id and text are in gone (doc_id, text_hash)."""
    return keyed(docs, written(gone.select("doc_id", "text_hash").distinct(), "gone"), "left_anti", id_col, text_col)


def one_of_repeats(docs: DataFrame, repeats: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each id and text in repeats (doc_id, text_hash); only such rows move."""
    repeats = written(repeats.select("doc_id", "text_hash"), "repeats")
    if repeats.isEmpty():
        return docs
    again, name = keyed(docs, repeats, "left_semi", id_col, text_col), unused(docs, "text_hash")
    first = again.withColumn(name, F.xxhash64(text_col)).dropDuplicates([id_col, name]).drop(name)
    return keyed(docs, repeats, "left_anti", id_col, text_col).unionByName(first)
