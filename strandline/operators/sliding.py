"""Order statistics of the rows before each row, kept up as the window slides.

A window of a few hundred rows differs from the next by one value that enters and
one that leaves. Rows are numbered, cut into blocks, and each block gets the rows
before it that its first windows reach back to; a block's task keeps the window's
values in order, takes one out and puts one in for each row, and reads the wanted
places. A long series is many tasks, and no row carries its window.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block; a block also reads as many rows as a window has.
BLOCK = 2048
#: Values of windows that are summed at once.
CHUNK = 1 << 18


def numbered(rows: DataFrame, *by: str, name: str, size: int = BLOCK) -> DataFrame:
    """rows with their place (from 0) by pos within their key: places within ranges of pos, and the counts of earlier ranges."""
    part = F.floor(F.col("pos") / size).alias("_part")
    counts = rows.groupBy(*by, part).agg(F.count("*").alias("_count"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = counts.select(*by, "_part", F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("pos")) - 1
    return rows.withColumn("_part", part).withColumn("_in", inside).join(before, [*by, "_part"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def windows(values: np.ndarray, days: int, shares: list[float], first: int) -> tuple[np.ndarray, ...]:
    """For each place from `first` on: n, mean and deviation of the values (but NaN) of the `days` rows before it, and for each share p the value at place floor(p n) of them in order."""
    has = ~np.isnan(values)
    ends = np.arange(first, len(values))
    starts = np.maximum(0, ends - days)
    n, mean, deviation = (np.full(len(ends), np.nan) for _ in range(3))
    # each row's sums are of its own window's values and of no other, so nothing from outside is in their last bits
    views = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(days, np.nan), values]), days)[first : len(values)]
    step = max(1, CHUNK // days)
    with np.errstate(divide="ignore", invalid="ignore"):
        for i in range(0, len(ends), step):
            at, view = slice(i, i + step), views[i : i + step]
            there = ~np.isnan(view)
            n[at] = there.sum(axis=1)
            mean[at] = np.where(there, view, 0).sum(axis=1) / n[at]
            apart = np.where(there, view - mean[at, None], 0)
            deviation[at] = np.sqrt((apart * apart).sum(axis=1) / (n[at] - 1))
    mean[n < 1] = deviation[n < 2] = np.nan
    found = np.full((len(shares), len(ends)), np.nan)
    start = int(starts[0]) if len(ends) else 0
    ordered = sorted(values[start:first][has[start:first]].tolist())
    for i in range(len(ends)):
        if i:
            end = int(ends[i])
            if has[end - 1]:
                insort(ordered, values[end - 1])
            if end - days - 1 >= 0 and has[end - days - 1]:
                del ordered[bisect_left(ordered, values[end - days - 1])]
        if ordered:
            for j, share in enumerate(shares):
                found[j, i] = ordered[min(len(ordered) - 1, math.floor(share * len(ordered)))]
    return n, mean, deviation, *found


def before_each(rows: DataFrame, *by: str, days: int, shares: list[float], value: str = "r", block: int = BLOCK) -> DataFrame:
    """rows (keys, pos, ...) with place, n, mean, deviation and q0, q1 ... of the `days` rows before each; null where there are none."""
    places = numbered(rows, *by, name="place", size=block)
    own = F.floor(F.col("place") / block)
    reach = F.floor((F.col("place") + days) / block)
    spread = places.withColumn("block", F.explode(F.sequence(own, reach)))
    names = ["n", "mean", "deviation", *(f"q{i}" for i in range(len(shares)))]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in places.schema), "n long", *(f"{x} double" for x in names[1:])])
    columns = places.columns

    def slide(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place", kind="stable")
        mine = (group["place"] // block == group["block"]).to_numpy()
        first = int(mine.argmax()) if mine.any() else len(group)
        found = windows(group[value].to_numpy(dtype=float), days, shares, first)
        out = group.iloc[first:][columns].reset_index(drop=True)
        for name, x in zip(names, found, strict=True):
            out[name] = x.astype("int64") if name == "n" else x
        return out

    made = spread.groupBy(*by, "block").applyInPandas(slide, schema)
    absent = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    values = [F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" and c == value else F.col(c) for c, t in places.dtypes]
    return made.select(*values, "n", *[absent(c) for c in names[1:]])
