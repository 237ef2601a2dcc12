"""As-of joins on calendars with gaps: for each row, the last one of another table at or before it.

Both tables are put in one order of time and cut into blocks. Within a block the last
right row before each left row is a window; what a block hands on is its last
right row, carried over blocks that have none. A long series is many tasks, and
what one task sees of it whole is a row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days or seconds of a block, by the type of time; about the square root of a long series.
SIZE = {"date": 64, "timestamp": 86_400, "timestamp_ntz": 86_400}


def block_of(at: str, kind: str, size: int | None) -> Column:
    number = F.unix_date(at) if kind == "date" else F.unix_seconds(F.col(at).cast("timestamp")) if kind.startswith("timestamp") else F.col(at)
    return F.floor(number / (size or SIZE.get(kind, 256)))


def as_of(left: DataFrame, right: DataFrame, *by: str, at: str, values: list[str], since: str | None = None, strict: bool = False, size: int | None = None) -> DataFrame:
    """left with values of the right row of the same key whose `at` is the greatest not after its own (strict: before it); null if there is none.

    since names a column for that row's own time. Of right rows at one time the
    greatest values count; a left row keeps its columns and repeats.
    """
    kind = dict(left.dtypes)[at]
    own = [c for c in left.columns if c not in (*by, at)]
    found = right.groupBy(*by, at).agg(F.max(F.struct(*values)).alias("_v")).select(*by, at, F.struct(F.col(at).alias("_at"), "_v").alias("_right"))
    rows = left.select(*by, at, F.struct(*[F.col(c) for c in own], F.lit(1).alias("_")).alias("_left"), F.lit(None).cast(found.schema["_right"].dataType).alias("_right"))
    empty = F.lit(None).cast(rows.schema["_left"].dataType)
    # at one time a right row stands first, so that it counts for left rows of that time, unless they ask for earlier ones
    both = rows.withColumn("_turn", F.lit(0 if strict else 1)).unionByName(found.select(*by, at, empty.alias("_left"), "_right", F.lit(1 if strict else 0).alias("_turn")))
    both = both.withColumn("_block", block_of(at, kind, size))
    inside = Window.partitionBy(*by, "_block").orderBy(at, "_turn").rowsBetween(Window.unboundedPreceding, 0)
    own_last = both.withColumn("_near", F.last("_right", ignorenulls=True).over(inside))
    ends = both.groupBy(*by, "_block").agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.col(at))).alias("_end"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    carried = ends.select(*by, "_block", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_block")]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    joined = own_last.where("_left is not null").alias("a").join(carried.alias("b"), condition, "left").withColumn("_hit", F.coalesce("_near", "_carried"))
    out = [F.col(f"a.{c}").alias(c) for c in (*by, at)] + [F.col(f"_left.{c}").alias(c) for c in own] + [F.col(f"_hit._v.{v}").alias(v) for v in values]
    return joined.select(*out, *([F.col("_hit._at").alias(since)] if since else []))
