"""Order statistics of series that fit no array: exact selection in a few passes.

The place of a value among a key's sorted values is found by cutting the key's range
into BINS parts of equal width and counting them. The part that holds the place
is cut again, between its own least and greatest value; what is below it is known
by count and sum. After PASSES cuts the distinct values of the last part are
counted and summed in order. Any distribution gives the exact value: where values
lie so unevenly that cuts don't part them, more is left for that last step.

Counts and sums are added within each task before they are shuffled, so a pass
shuffles at most BINS rows for each key and task, and no task sees a key's rows:
the places, one row a key, are broadcast.
Rows are read once a pass; store them if they are dear to make. Nulls are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.config import DEFAULT
from strandline.functions.stats import order_index

BINS, PASSES = 1024, 2


def within(rows: DataFrame, places: DataFrame, *by: str) -> DataFrame:
    """rows between lo and hi of their key's place; places has a row per key, each of many rows, and goes to the rows, which stay in their tasks."""
    held = rows.join(F.broadcast(places), list(by)) if by else rows.crossJoin(F.broadcast(places))  # one row of places without keys
    return held.where("value between lo and hi")


def cut(rows: DataFrame, places: DataFrame, *by: str, bins: int) -> DataFrame:
    """places (keys, rank, n, lo, hi, below, sum_below) narrowed to the part that holds the rank, counted from 0."""
    width = F.col("hi") - F.col("lo")
    at = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / width * bins))).otherwise(0).cast("int")
    keep = [*by, "rank", "n", "below", "sum_below"]
    counted = within(rows, places, *by).groupBy(*keep, at.alias("bin")).agg(F.count("*").alias("held"), F.sum("value").alias("sum"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return up_to_rank(counted, "bin", *by)


def up_to_rank(counted: DataFrame, order: str, *by: str) -> DataFrame:
    """Of groups in order (held, sum, lo, hi), the one that holds the rank, with what is below it added up."""
    so_far = Window.partitionBy(*by).orderBy(order)
    earlier = so_far.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    rows = counted.withColumns({"under": F.col("below") + F.coalesce(F.sum("held").over(earlier), zero), "sum_under": F.col("sum_below") + F.coalesce(F.sum("sum").over(earlier), zero)})
    found = rows.where((F.col("under") <= F.col("rank")) & (F.col("rank") < F.col("under") + F.col("held")))
    return found.select(*by, "rank", "n", "lo", "hi", F.col("under").alias("below"), F.col("sum_under").alias("sum_below"))


def selected(rows: DataFrame, *by: str, rank: Column, value: str = "r", bins: int = BINS, passes: int = PASSES) -> DataFrame:
    """keys, rank, n, value, below (values that stand before it), sum_below: the value at `rank` (from 0, of n) of each key's sorted values."""
    rows = rows.select(*by, F.col(value).cast("double").alias("value")).where("value is not null")
    ends = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).where("n > 0")
    places = ends.withColumns({"rank": rank.cast("long"), "below": F.lit(0).cast("long"), "sum_below": F.lit(0.0)})
    for _ in range(passes):
        places = cut(rows, places, *by, bins=bins)
    keep = [*by, "rank", "n", "below", "sum_below", "value"]
    left = within(rows, places, *by).groupBy(*keep).agg(F.count("*").alias("held")).withColumn("sum", F.col("value") * F.col("held"))
    last = up_to_rank(left.withColumns({"lo": F.col("value"), "hi": F.col("value")}), "value", *by)
    # equal values stand in any order: those before the rank are below it too
    equal = F.col("rank") - F.col("below")
    return last.select(*by, "rank", "n", F.col("lo").alias("value"), F.col("rank").alias("below"), (F.col("sum_below") + F.col("lo") * equal).alias("sum_below"))


def tail(returns: DataFrame, *by: str, confidence: float = DEFAULT.var_confidence, bins: int = BINS, passes: int = PASSES) -> DataFrame:
    """keys, n, var, es: historical value at risk and expected shortfall, as metrics.risk_table has them."""
    found = selected(returns, *by, rank=order_index(F.col("n"), confidence), bins=bins, passes=passes)
    total = F.col("sum_below") + F.col("value")
    return found.select(*by, "n", (-F.col("value")).alias("var"), (-total / (F.col("rank") + 1)).alias("es"))
