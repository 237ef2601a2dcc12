"""Joins of days with closed intervals of days, for any number of intervals.

The calendar is cut into bins. An interval has a copy for each bin that it touches, a
day lies in one bin: they meet by bin, an equality that Spark can hash, and the
exact bounds are checked there. A day and an interval share one bin at most, so no
pair is found twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days of a bin: intervals of a few months have a few copies.
BIN = 32


def bin_of(day: str | Column, days: int) -> Column:
    return F.floor(F.unix_date(F.col(day) if isinstance(day, str) else day) / days)


def binned(intervals: DataFrame, start: str, end: str, days: int = BIN) -> DataFrame:
    """intervals with a row (_bin) for each bin they touch; none for an interval that ends before it starts."""
    return intervals.where(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(bin_of(start, days), bin_of(end, days))))


def inside(rows: DataFrame, intervals: DataFrame, date: str = "date", start: str = "start", end: str = "end", how: str = "inner", days: int = BIN) -> DataFrame:
    """rows with each interval that holds their day; how: inner, left, left_semi or left_anti."""
    held = binned(intervals, start, end, days)
    marked = rows.withColumn("_bin", bin_of(date, days)).alias("rows")
    near = (F.col("rows._bin") == F.col("near._bin")) & F.col(f"rows.{date}").between(F.col(f"near.{start}"), F.col(f"near.{end}"))
    joined = marked.join(held.alias("near"), near, how)
    more = [] if how in ("left_semi", "left_anti") else [F.col(f"near.{c}").alias(c) for c in intervals.columns]
    return joined.select(*[F.col(f"rows.{c}").alias(c) for c in rows.columns], *more)
