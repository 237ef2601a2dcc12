"""Sums of products of all pairs of series, from each day's vector.

Covariances and correlations of k series over many days need k x k sums. Joining
the panel with itself makes k x k rows for every day. Here the rows of a day meet
once as a vector, every task multiplies the matrix of its days with itself and adds
up, and only the k x k sums of each task are shuffled.

Products are of whole millionths of returns where they fit (panels have 6 digits),
so sums up to 2^53 are exact and don't depend on tasks; other values are added as
doubles. Up to MOST series a task's sums (five k x k matrices) fit its memory;
more are summed by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Series whose k x k sums a task can hold: 5 x 8 bytes x 1,500^2 are 90 MB.
MOST = 1500
#: Scale of returns before they are multiplied.
UNIT = 1e6
MOMENTS = ("sx", "sy", "sxx", "syy", "sxy")


def day_vectors(returns: DataFrame, *by: str) -> DataFrame:
    """keys, ids and x: the series that have a row that day and their returns, null or not."""
    days = returns.groupBy(*by, "pos").agg(F.collect_list(F.struct("series_id", "r")).alias("v"))
    return days.select(*by, F.col("v.series_id").alias("ids"), F.col("v.r").alias("x"))


def fit(m: np.ndarray, k: int) -> np.ndarray:
    """m with room for k series."""
    return np.pad(m, ((0, 0), (0, k - m.shape[1]), (0, k - m.shape[2])))


def sums(returns: DataFrame, *by: str, complete: bool = False) -> DataFrame:
    """keys, a, b, n, sx, sy, sxx, syy, sxy over days that have both returns, for all ordered pairs that have rows on a common day; complete: over days on which no series lacks one."""
    if returns.select("series_id").distinct().limit(MOST + 1).count() > MOST:
        return joined(returns, *by, complete=complete)
    days = day_vectors(returns, *by)
    if complete:
        days = days.where(~F.exists("x", lambda v: v.isNull()))
    fields = [days.schema[c] for c in by]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "a string, b string, n long", *(f"{m} double" for m in MOMENTS)])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[str, int] = {}
        held: dict[tuple, np.ndarray] = {}
        for part in parts:
            keys = list(zip(*(part.column(i).to_pylist() for i in range(len(by))), strict=True)) if by else [()] * part.num_rows
            ids, x = part.column(len(by)), part.column(len(by) + 1)
            at = np.array([index.setdefault(i, len(index)) for i in ids.flatten().to_pylist()], dtype=np.int64)
            row = np.repeat(np.arange(part.num_rows), np.asarray(ids.value_lengths()))
            value = x.flatten().to_numpy(zero_copy_only=False) * UNIT
            whole = np.rint(value)
            there, dense, has = (np.zeros((part.num_rows, len(index))) for _ in range(3))
            there[row, at], has[row, at] = 1, ~np.isnan(value)
            dense[row, at] = np.nan_to_num(np.where(np.abs(value - whole) < 1e-4, whole, value))
            for key in set(keys):
                mine = np.fromiter((y == key for y in keys), dtype=bool, count=len(keys))
                t, d, h = there[mine], dense[mine], has[mine]
                new = np.stack([t.T @ t, h.T @ h, d.T @ h, (d * d).T @ h, d.T @ d])
                held[key] = new + fit(held[key], len(index)) if key in held else new
        names = np.array(list(index), dtype=object)
        for key, m in held.items():
            a, b = np.nonzero(m[0])
            n, sx, sxx, sxy = (y[a, b] for y in m[1:])
            arrays = [pa.array([v] * len(a), to_arrow_type(f.dataType)) for v, f in zip(key, fields, strict=True)]
            arrays += [pa.array(names[a], pa.string()), pa.array(names[b], pa.string()), pa.array(n.astype(np.int64)), *(pa.array(y) for y in (sx, m[2][b, a], sxx, m[3][b, a], sxy))]
            yield pa.RecordBatch.from_arrays(arrays, [*by, "a", "b", "n", *MOMENTS])

    added = days.mapInArrow(add, schema).groupBy(*by, "a", "b").agg(F.sum("n").alias("n"), *[F.sum(m).alias(m) for m in MOMENTS])
    return added.select(*by, "a", "b", "n", *[(F.col(m) / (UNIT if len(m) == 2 else UNIT * UNIT)).alias(m) for m in MOMENTS])


def joined(returns: DataFrame, *by: str, complete: bool = False) -> DataFrame:
    """The same sums by a join of the days' rows, for any number of series."""
    from strandline.operators.metrics import complete_days

    held = complete_days(returns, *by) if complete else returns
    left = held.select(*by, "pos", F.col("series_id").alias("a"), F.col("r").alias("x"))
    right = held.select(*by, "pos", F.col("series_id").alias("b"), F.col("r").alias("y"))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    x, y = (F.coalesce(F.when(both, F.col(c)), F.lit(0.0)) for c in "xy")
    added = dict(zip(MOMENTS, (x, y, x * x, y * y, x * y), strict=True))
    return left.join(right, [*by, "pos"]).groupBy(*by, "a", "b").agg(F.sum(both.cast("long")).alias("n"), *[F.sum(v).alias(k) for k, v in added.items()])


def centred(product: str, one: str, two: str) -> Column:
    """Sum of products of deviations from the means; null without days."""
    return F.col(product) - F.try_divide(F.col(one) * F.col(two), F.col("n"))


def covariances(returns: DataFrame, *by: str) -> DataFrame:
    """keys, a, b, cov, n over complete days, for all ordered pairs; no rows with fewer than two days."""
    return sums(returns, *by, complete=True).where("n > 1").select(*by, "a", "b", (centred("sxy", "sx", "sy") / (F.col("n") - 1)).alias("cov"), "n")


def correlations(returns: DataFrame, *by: str) -> DataFrame:
    """keys, a, b, corr, n over the days that both have, for all ordered pairs of different series that have rows on a common day; null with fewer than two days or if either is constant."""
    spread = lambda p, s: F.greatest(F.lit(0.0), centred(p, s, s))
    # what rounding leaves of a constant series is no spread
    flat = lambda p, s: spread(p, s) <= F.col(p) * 1e-14
    both = F.sqrt(spread("sxx", "sx") * spread("syy", "sy"))
    corr = F.when((F.col("n") > 1) & ~flat("sxx", "sx") & ~flat("syy", "sy"), centred("sxy", "sx", "sy") / both)
    return sums(returns, *by).where("a <> b").select(*by, "a", "b", corr.alias("corr"), "n")
