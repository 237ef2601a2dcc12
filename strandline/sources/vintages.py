"""Vintages of a panel: whole states of it, of which none changes once it is there.

A store has two folders. `data` holds rows of returns in a folder for each month, under
a name that is used once; `manifest` holds, for each vintage, a file that lists the
month folders it is made of, with their row counts, and is written last. A write
that stops half-way leaves folders that no manifest lists, so readers never see it,
and the name stays free. A vintage that changes some months lists the other
months' folders of the one before: only what changed is written.

Readers take the last vintage, by name, or any earlier one. Only manifests pass the
driver: a row per month.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTED = "name string, month string, folder string, rows long"
#: Columns of a vintage's rows.
ROWS = ("series_id", "kind", "date", "r")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """name, month, folder (under root), rows of all vintages; none in a new store."""
    try:
        return spark.read.schema(LISTED).option("recursiveFileLookup", "true").json(f"{root}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LISTED)


def names(spark: SparkSession, root: str) -> list[str]:
    """The vintages, the earliest first."""
    return [r[0] for r in manifests(spark, root).select("name").distinct().orderBy("name").collect()]


def month_of(date: str = "date") -> F.Column:
    return F.date_format(date, "yyyy-MM")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "series_id string, kind string, date date, r double")


def read(spark: SparkSession, root: str, name: str | None = None, back: int = 0, months: list[str] | None = None) -> DataFrame:
    """Rows of the vintage of that name, or of the last but `back`; of some months only, if given. An empty table if there is none."""
    every = manifests(spark, root)
    if name is None:
        known = [r[0] for r in every.select("name").distinct().orderBy(F.desc("name")).limit(back + 1).collect()]
        if len(known) <= back:
            return empty(spark)
        name = known[back]
    held = every.where(F.col("name") == name).collect()
    if not held:
        raise ValueError(f"no vintage {name}")
    folders = [f"{root}/{r.folder}" for r in held if r.folder and (months is None or r.month in months)]
    return spark.read.schema(empty(spark).schema).parquet(*folders) if folders else empty(spark)


def verified(spark: SparkSession, root: str, name: str) -> DataFrame:
    """month, rows, found of the months whose folders don't hold what the manifest says."""
    held = manifests(spark, root).where((F.col("name") == name) & F.col("folder").isNotNull())
    found = read(spark, root, name).groupBy(month_of().alias("month")).agg(F.count("*").alias("found"))
    return held.select("month", "rows").join(found, "month", "left").na.fill(0, ["found"]).where("rows <> found")


def write(rows: DataFrame, root: str, name: str, replacing: str | None = None) -> None:
    """A vintage of these rows; with `replacing`, of that vintage's months but for those that rows have. Refuses a name that is taken."""
    spark = rows.sparkSession
    before = manifests(spark, root)
    if not before.where(F.col("name") == name).isEmpty():
        raise ValueError(f"there is a vintage {name}")
    folder = f"data/{name}-{uuid.uuid4().hex}"
    rows.select(*ROWS, month_of().alias("month")).repartition("month").write.partitionBy("month").parquet(f"{root}/{folder}")
    there = spark.read.schema(empty(spark).schema.add("month", "string")).parquet(f"{root}/{folder}")
    fresh = there.groupBy("month").agg(F.count("*").alias("rows"))
    listed = fresh.select(F.lit(name).alias("name"), "month", F.concat(F.lit(f"{folder}/month="), "month").alias("folder"), "rows")
    if replacing is not None:
        kept = before.where(F.col("name") == replacing).where("folder is not null").join(fresh.select("month"), "month", "left_anti")
        listed = listed.unionByName(kept.select(F.lit(name).alias("name"), "month", "folder", "rows"))
    if listed.isEmpty():  # a vintage without rows is one too
        listed = spark.createDataFrame([(name, None, None, 0)], LISTED)
    listed.coalesce(1).write.json(f"{root}/manifest/{name}")


def upserted(held: DataFrame, changes: DataFrame) -> DataFrame:
    """held with the rows of changes (a row per series and date) in place of its own of the same series and date."""
    keys = ["series_id", "date"]
    return held.join(changes.select(*keys), keys, "left_anti").select(*ROWS).unionByName(changes.select(*ROWS))


def last_of_each(changes: DataFrame, order: str) -> DataFrame:
    """The change of the greatest `order` for each series and date; of equals the greatest return."""
    newest = F.max_by(F.struct("kind", "r"), F.struct(F.col(order), F.col("r"), F.col("kind")))
    return changes.groupBy("series_id", "date").agg(newest.alias("x")).select("series_id", "x.kind", "date", "x.r")
