"""Paths of a portfolio's value, with draws from a counter: (seed, path, day) decide a draw, so paths don't depend on tasks.

The generator mixes 32-bit words with products that fit 64 bits, so other engines
can repeat it in whole numbers. A path is the product of its days' steps and is made
where its row lies: an Arrow batch of paths at a time, without a row per day and
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.config import DEFAULT, Config

#: Fixed values of the mixing step, published for 32-bit integer hashing; and one that sets the second word apart.
FACTOR, MASK, SECOND = 0x45D9F3B, 0xFFFFFFFF, 0x5BD1E995
#: Draws made at once: a few arrays of 8 MB.
CHUNK = 1 << 20
#: A day takes no more than all but this share.
LEAST_STEP = 1e-6


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit words that spreads every bit; x as uint64."""
    factor, mask, half = np.uint64(FACTOR), np.uint64(MASK), np.uint64(16)
    for _ in range(2):
        x = (((x >> half) ^ x) * factor) & mask
    return (x >> half) ^ x


def uniforms(seed: int, path: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each path (rows) and counter (columns)."""
    path, mask = path.astype(np.uint64), np.uint64(MASK)
    one = mixed((path & mask) ^ mixed(np.array([seed], dtype=np.uint64) & mask))
    two = mixed(one ^ (path >> np.uint64(32)) ^ np.uint64(SECOND))
    word = mixed(mixed((one[:, None] + counter.astype(np.uint64)[None, :]) & mask) ^ two[:, None])
    return (word + 0.5) / 2.0**32


def normals(seed: int, path: np.ndarray, days: int) -> np.ndarray:
    """Standard normal draws, a row per path: two days from each pair of numbers."""
    pairs = np.arange(1, (days + 1) // 2 + 1)
    radius = np.sqrt(-2 * np.log(uniforms(seed, path, 2 * pairs)))
    angle = 2 * np.pi * uniforms(seed, path, 2 * pairs + 1)
    z = np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=2)
    return z.reshape(len(path), -1)[:, :days]


def terminal_values(moments: DataFrame, days: int, paths: int | None = None, seed: int = 7, cfg: Config = DEFAULT) -> DataFrame:
    """path, value after `days` days of mu + sigma z; moments is one row (mu, sigma)."""
    rows = moments.sparkSession.range(paths or cfg.paths).select(F.col("id").alias("path")).crossJoin(moments.select("mu", "sigma"))  # one row of moments
    held = max(1, CHUNK // max(1, days))

    def walk(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            path, mu, sigma = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            value = np.empty(len(path))
            for i in range(0, len(path), held):
                z = normals(seed, path[i : i + held], days)
                step = np.maximum(1 + mu[i : i + held, None] + sigma[i : i + held, None] * z, LEAST_STEP)
                value[i : i + held] = cfg.capital * step.prod(axis=1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(value)], ["path", "value"])

    return rows.mapInArrow(walk, "path long, value double").withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def summary(values: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """p5, p50, p95 (linear), prob_loss, mean."""
    return values.agg(
        *[F.percentile("value", F.lit(p / 100)).alias(f"p{p}") for p in (5, 50, 95)],
        F.avg((F.col("value") < cfg.capital).cast("double")).alias("prob_loss"), F.avg("value").alias("mean"),
    )


def histogram(values: DataFrame, bins: int = DEFAULT.bins) -> DataFrame:
    """bin, lo, hi, n: equal widths, the last closed; a single bin if all values are equal."""
    ends = values.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    n = F.when(F.col("hi") > F.col("lo"), bins).otherwise(1)
    grid = ends.where("lo is not null").withColumn("bins", n).select(
        F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"), F.col("lo").alias("min"), ((F.col("hi") - F.col("lo")) / F.col("bins")).alias("width"), "bins"
    )
    at = F.when(F.col("width") > 0, F.least(F.col("bins") - 1, F.floor((F.col("value") - F.col("min")) / F.col("width")))).otherwise(0).cast("int")
    shape = grid.where("bin = 0").select("min", "width", "bins")
    counted = values.crossJoin(shape).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # one row of shape
    lo = F.col("min") + F.col("bin") * F.col("width")
    return grid.join(counted, "bin", "left").select("bin", lo.alias("lo"), (lo + F.col("width")).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def marked(bins: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The bins with their mid and marker: whether it is the one whose mid is nearest to the capital, the first of equals."""
    mid = (F.col("lo") + F.col("hi")) / 2
    near = Window.orderBy(F.abs(F.col("mid") - cfg.capital), "bin")  # a few dozen bins
    return bins.withColumn("mid", mid).withColumn("marker", F.row_number().over(near) == 1)
