"""Stress windows: closed date intervals, each with a half-open estimation period before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.config import DEFAULT, Config
from strandline.operators import intervals, metrics, optimize


def windows_table(spark: SparkSession, cfg: Config = DEFAULT) -> DataFrame:
    rows = [(w.key, w.label, w.start, w.end, w.lookback_start) for w in cfg.windows]
    return spark.createDataFrame(rows, "window_key string, label string, start date, end date, lookback_start date")


def in_windows(returns: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows inside each window, with its key."""
    return intervals.inside(returns, windows.select("window_key", "start", "end")).drop("start", "end")


def before_windows(returns: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows from lookback_start up to, but without, the window's start."""
    past = windows.select("window_key", F.col("lookback_start").alias("start"), F.date_sub("start", 1).alias("end"))
    return intervals.inside(returns, past).drop("start", "end")


def outside_windows(returns: DataFrame, windows: DataFrame) -> DataFrame:
    return intervals.inside(returns, windows, how="left_anti")


def coverage(rows: DataFrame, least: float) -> DataFrame:
    """window_key, series_id, coverage, covered."""
    share = F.coalesce(F.count("r") / F.count("*"), F.lit(0.0))
    return rows.groupBy("window_key", "series_id").agg(share.alias("coverage")).withColumn("covered", F.col("coverage") >= least)


def uncovered(stocks: DataFrame, windows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """window_key, series_id, coverage of the stocks that a window's figures leave out."""
    return coverage(in_windows(stocks, windows), cfg.min_coverage).where("not covered").drop("covered")


def window_stats(rows: DataFrame, *by: str) -> DataFrame:
    """total_return, max_drawdown, volatility, worst_day, n, coverage; null figures of risk count as 0."""
    basic = rows.groupBy(*by).agg(
        (F.product(1 + F.col("r")) - 1).alias("total_return"), F.coalesce(metrics.volatility(), F.lit(0.0)).alias("volatility"),
        F.min("r").alias("worst_day"), F.count("r").alias("n"), (F.count("r") / F.count("*")).alias("coverage"),
    ).where("n > 0")
    falls = metrics.max_drawdown(rows, *by).withColumn("max_drawdown", F.coalesce("max_drawdown", F.lit(0.0)))
    return basic.join(falls, list(by))


def optimized_weights(stocks: DataFrame, windows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """window_key, kind, series_id, w estimated on the lookback of series covered there."""
    past = before_windows(stocks, windows)
    held = coverage(past, cfg.min_coverage).where("covered").select("window_key", "series_id")
    found = optimize.portfolios(past.join(held, ["window_key", "series_id"]), "window_key", cfg=cfg, kinds=("min_variance", "max_sharpe"))
    return found.select("window_key", "kind", "series_id", "w")


def shown_weights(weights: DataFrame, *by: str, least: float = 0.005) -> DataFrame:
    """keys, place, series_id, share (a whole percentage as text) of the weights of at least half a percent, the largest first; a half goes up, so none is shown as 0%."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("w"), "series_id"))
    return weights.where(F.col("w") >= least).select(*by, place.alias("place"), "series_id", F.format_string("%.0f%%", F.col("w") * 100).alias("share"))


def out_of_sample(stocks: DataFrame, weights: DataFrame, windows: DataFrame) -> DataFrame:
    """window_key, kind and the window statistics of fixed weights over each window."""
    rows = in_windows(stocks, windows).join(weights, ["window_key", "series_id"])
    present = F.sum(F.when(F.col("r").isNotNull(), F.col("w")))
    blend = rows.groupBy("window_key", "kind", "pos", "date").agg(F.when(present > 0, F.sum(F.col("r") * F.col("w")) / present).alias("r"))
    return window_stats(blend, "window_key", "kind")


def report(stocks: DataFrame, market: DataFrame, windows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """window_key, entity_kind, entity and its statistics: covered stocks, their equal-weight blend, the benchmark."""
    inside = in_windows(stocks, windows)
    held = coverage(inside, cfg.min_coverage).where("covered").select("window_key", "series_id")
    covered = inside.join(held, ["window_key", "series_id"])
    one = window_stats(covered, "window_key", "series_id").select("window_key", F.lit("stock").alias("entity_kind"), F.col("series_id").alias("entity"), "total_return", "max_drawdown", "volatility", "worst_day", "n", "coverage")
    blend = metrics.blend(covered, "window_key")
    bench = in_windows(market.withColumnRenamed("m", "r"), windows)
    for rows, kind in ((blend, "equal_weight"), (bench, "benchmark")):
        more = window_stats(rows, "window_key").select("window_key", F.lit(kind).alias("entity_kind"), F.lit(kind).alias("entity"), "total_return", "max_drawdown", "volatility", "worst_day", "n", "coverage")
        one = one.unionByName(more)
    return one


def correlations(stocks: DataFrame, windows: DataFrame) -> DataFrame:
    """window_key, stress, baseline (days in no window), pair counts, delta."""
    calm = metrics.average_correlation(outside_windows(stocks, windows)).select(F.col("avg_corr").alias("baseline"), F.col("n_pairs").alias("n_pairs_baseline"))
    bad = metrics.average_correlation(in_windows(stocks, windows), "window_key").select("window_key", F.col("avg_corr").alias("stress"), F.col("n_pairs").alias("n_pairs_stress"))
    return bad.crossJoin(calm).withColumn("delta", F.col("stress") - F.col("baseline"))  # one calm row


def underperformance(report_rows: DataFrame, optimized: DataFrame) -> DataFrame:
    """kind, n_windows (comparable with equal weights), n_worse."""
    equal = report_rows.where("entity_kind = 'equal_weight'").select("window_key", F.col("total_return").alias("base"))
    both = optimized.join(equal, "window_key")
    return both.groupBy("kind").agg(F.count("*").alias("n_windows"), F.sum((F.col("total_return") < F.col("base")).cast("int")).alias("n_worse"))


def clusters(exceptions: DataFrame) -> DataFrame:
    """longest run of consecutive exceptions per method and confidence."""
    order = Window.partitionBy("method", "confidence").orderBy("pos")
    run = exceptions.withColumn("g", F.row_number().over(order) - F.sum("exc").over(order)).where("exc = 1")
    return run.groupBy("method", "confidence", "g").agg(F.count("*").alias("len")).groupBy("method", "confidence").agg(F.max("len").alias("longest"))
