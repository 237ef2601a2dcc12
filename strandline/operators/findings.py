"""Headline findings: what the tests, correlations and portfolios say, as verdicts with their figures.

Each finding is one row: finding, verdict, tone, observed, reference, p, label.
A verdict states only what its tests say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.config import DEFAULT, Config


def finding(rows: DataFrame, name: str, verdict: Column, tone: Column, observed: Column, reference: Column, p: Column | None = None, label: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return rows.select(
        F.lit(name).alias("finding"), verdict.alias("verdict"), tone.alias("tone"), observed.cast("double").alias("observed"), reference.cast("double").alias("reference"),
        (none if p is None else p).cast("double").alias("p"), (none if label is None else label).cast("string").alias("label"),
    )


def clustering(tests: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Does historical VaR break as often as it should, and at independent times? p is that of independence."""
    one = tests.where((F.col("method") == "hist") & (F.col("confidence") == confidence))
    count, timing = F.col("reject_uc"), F.col("reject_ind")
    verdict = F.when(count & timing, "count_and_timing_off").when(count, "count_off").when(timing, "timing_off").otherwise("passes")
    return finding(one, "clustering", verdict, F.when(count | timing, "negative").otherwise("positive"), F.col("rate"), 1 - F.col("confidence"), F.col("p_ind"))


def fat_tails(tests: DataFrame, kurtosis: DataFrame, confidence: float = 0.99) -> DataFrame:
    """Does normal VaR break more or less often than it should? kurtosis: one row (excess_kurtosis); label tells its sign."""
    one = tests.where((F.col("method") == "param") & (F.col("confidence") == confidence)).crossJoin(kurtosis.select("excess_kurtosis"))  # one row each
    nominal = 1 - F.col("confidence")
    more, less = F.col("reject_uc") & (F.col("rate") > nominal), F.col("reject_uc") & (F.col("rate") < nominal)
    verdict = F.when(more, "too_often").when(less, "too_seldom").otherwise("not_rejected")
    k = F.col("excess_kurtosis")
    label = F.when(k.isNull(), "kurtosis_unknown").when(k > 0, "fat_tails").otherwise("no_fat_tails")
    return finding(one, "fat_tails", verdict, F.when(more | less, "negative").otherwise("neutral"), F.col("rate"), nominal, F.col("p_uc"), label)


def correlation(stress: DataFrame, windows: DataFrame) -> DataFrame:
    """Did correlations rise in stress? The window of the highest one (the first of equals) against calm days."""
    rows = windows.select("window_key", "label", "start").join(stress, "window_key", "left")
    worst = rows.agg(F.max_by(F.struct("stress", "label"), F.when(F.col("stress").isNotNull(), F.struct("stress", -F.unix_date("start")))).alias("w"), F.max("baseline").alias("baseline"))
    high, base = F.col("w.stress"), F.col("baseline")
    verdict = F.when(high.isNull() | base.isNull(), "unavailable").when(high > base, "rose").otherwise("did_not_rise")
    return finding(worst, "correlation", verdict, F.when(high > base, "negative").otherwise("neutral"), high, base, label=F.col("w.label"))


def optimizer(report: DataFrame, optimized: DataFrame, windows: DataFrame) -> DataFrame:
    """In how many windows (observed, of reference comparable ones) did the best Sharpe ratio's weights lose to equal weights?"""
    equal = report.where("entity_kind = 'equal_weight'").select("window_key", F.col("total_return").alias("base"))
    both = optimized.where("kind = 'max_sharpe'").select("window_key", "total_return").join(equal, "window_key").join(windows.select("window_key", "label", "start"), "window_key")
    lost = F.col("total_return") < F.col("base")
    names = F.transform(F.array_sort(F.collect_list(F.when(lost, F.struct("start", "label")))), lambda x: x["label"])
    one = both.agg(F.count("*").alias("n"), F.coalesce(F.sum(lost.cast("int")), F.lit(0)).alias("k"), F.array_join(names, ", ").alias("names"))
    n, k = F.col("n"), F.col("k")
    verdict = F.when(n == 0, "unavailable").when(k == 0, "held").otherwise("lost")
    return finding(one, "optimizer", verdict, F.when(n == 0, "neutral").when(k == 0, "positive").otherwise("negative"), k, n, label=F.col("names"))


def earliest_day(calendar: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """pos, date of the first day with a whole VaR window before it, or the last day of a shorter calendar."""
    n = F.count("*").over(Window.partitionBy())  # a row per day
    return calendar.withColumn("n", n).where(F.col("pos") == F.least(F.lit(cfg.var_window), F.col("n") - 1)).select("pos", "date")
