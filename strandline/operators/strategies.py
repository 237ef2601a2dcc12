"""Rule-based strategies over a panel, with turnover and its cost.

Ties in a ranking go to the smaller series_id. Results are series of
(strategy_id, pos, date, r, turnover) over the whole calendar; r is null on
days without a position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.config import DEFAULT, Config
from strandline.functions.stats import rounded

ORDER = ["momentum_1d", "mean_reversion", "momentum_12m", "low_volatility", "buy_and_hold"]


def rebalance_turnover(basket: Column, before: Column, top_n: int) -> Column:
    """(sold + bought) / size; the first basket is bought from cash, an empty one costs nothing."""
    if top_n == 0:
        return F.lit(0.0)
    traded = F.size(F.array_except(before, basket)) + F.size(F.array_except(basket, before))
    return F.when(before.isNull(), F.lit(1.0)).otherwise(traded / F.lit(float(top_n)))


def ranked(rows: DataFrame, score: Column, top_n: int, *by: str) -> DataFrame:
    """The top_n rows of each group that has so many scores, best first."""
    order = Window.partitionBy(*by).orderBy(score, "series_id")
    whole = Window.partitionBy(*by)
    scored = rows.withColumns({"_k": F.row_number().over(order), "_n": F.count("*").over(whole)})
    return scored.where((F.col("_n") >= top_n) & (F.col("_k") <= top_n)).drop("_k", "_n")


def daily_rank(returns: DataFrame, calendar: DataFrame, best: bool, cfg: Config = DEFAULT) -> DataFrame:
    """Day N's best (or worst) returns, held on day N + 1; the basket before is that of the last day that traded."""
    today = returns.where("r is not null and pos >= 1")
    picks = ranked(today, F.desc("r") if best else F.asc("r"), cfg.top_n, "pos").select("pos", "series_id")
    tomorrow = returns.select((F.col("pos") - 1).alias("pos"), "series_id", F.col("r").alias("next"))
    held = picks.join(tomorrow, ["pos", "series_id"], "left").groupBy("pos").agg(F.avg("next").alias("gross"), F.sort_array(F.collect_list("series_id")).alias("basket"))
    held = held.where("gross is not null")
    before = F.lag("basket").over(Window.orderBy("pos"))  # one row per day
    held = held.withColumn("turnover", rebalance_turnover(F.col("basket"), before, cfg.top_n))
    r = F.col("gross") - F.col("turnover") * cfg.cost_bps / 10_000
    return calendar.join(held.select((F.col("pos") + 1).alias("pos"), r.alias("r"), "turnover", "basket"), "pos", "left")


def month_starts(calendar: DataFrame) -> DataFrame:
    """month, first_pos of each month that has a day before it."""
    return calendar.groupBy(F.trunc("date", "MM").alias("month")).agg(F.min("pos").alias("first_pos")).where("first_pos > 0")


def momentum_baskets(prices: DataFrame, calendar: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """month, first_pos, series_id, seen (the last day that the choice is made from): the best returns over momentum_days up to the day before the month."""
    past = F.lag("price", cfg.momentum_days).over(Window.partitionBy("series_id").orderBy("pos"))
    scores = prices.withColumn("score", rounded(F.try_divide("price", past) - 1, 10)).where("score is not null")
    at = scores.withColumn("first_pos", F.col("pos") + 1).join(month_starts(calendar), "first_pos")
    return ranked(at, F.desc("score"), cfg.top_n, "month").select("month", "first_pos", "series_id", F.col("pos").alias("seen"))


def low_vol_baskets(returns: DataFrame, calendar: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """month, first_pos, series_id, seen: the least deviation over the low_vol_days rows before the month."""
    before = Window.partitionBy("series_id").orderBy("pos").rowsBetween(-cfg.low_vol_days, -1)
    scores = returns.withColumns({"score": rounded(F.stddev_samp("r").over(before), 10), "n": F.count("r").over(before), "seen": F.max("pos").over(before)})
    scores = scores.where((F.col("pos") >= cfg.low_vol_days) & (F.col("n") >= int(cfg.low_vol_days * cfg.low_vol_coverage)) & F.col("score").isNotNull())
    at = scores.withColumnRenamed("pos", "first_pos").join(month_starts(calendar), "first_pos")
    return ranked(at, F.asc("score"), cfg.top_n, "month").select("month", "first_pos", "series_id", "seen")


def look_ahead(baskets: DataFrame, calendar: DataFrame) -> DataFrame:
    """rebalances, violations: months whose choice was made from a day that is not before the month's first."""
    days = calendar.select(F.col("pos").alias("seen"), F.col("date").alias("seen_on"))
    last = baskets.groupBy("month").agg(F.max("seen").alias("seen")).join(days, "seen", "left")
    return last.agg(F.count("*").alias("rebalances"), F.sum((~F.coalesce(F.col("seen_on") < F.col("month"), F.lit(False))).cast("int")).alias("violations"))


def monthly_hold(baskets: DataFrame, returns: DataFrame, calendar: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The basket of each month over its days; turnover and cost on the month's first day with data."""
    by_month = baskets.groupBy("month").agg(F.sort_array(F.collect_list("series_id")).alias("basket"))
    before = F.lag("basket").over(Window.orderBy("month"))  # one row per month
    by_month = by_month.withColumn("paid", rebalance_turnover(F.col("basket"), before, cfg.top_n))
    dated = returns.withColumn("month", F.trunc("date", "MM")).join(baskets.select("month", "series_id"), ["month", "series_id"])
    days = dated.groupBy("month", "pos").agg(F.avg("r").alias("gross")).where("gross is not null").join(by_month, "month")
    first = F.col("pos") == F.min("pos").over(Window.partitionBy("month"))
    days = days.withColumn("turnover", F.when(first, F.col("paid")).otherwise(0.0))
    r = F.col("gross") - F.col("turnover") * cfg.cost_bps / 10_000
    return calendar.join(days.select("pos", r.alias("r"), "turnover", "basket"), "pos", "left")


def buy_and_hold(returns: DataFrame, calendar: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    days = returns.groupBy("pos").agg(F.avg("r").alias("gross"), F.sort_array(F.collect_list("series_id")).alias("basket"))
    first = F.min(F.when(F.col("gross").isNotNull(), F.col("pos"))).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # one row per day
    days = days.withColumn("turnover", F.when(F.col("pos") == first, 1.0).otherwise(0.0))
    r = F.col("gross") - F.col("turnover") * cfg.cost_bps / 10_000
    return calendar.join(days.select("pos", r.alias("r"), "turnover", "basket"), "pos", "left")


def both_daily_ranks(returns: DataFrame, calendar: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """daily_rank of the best and of the worst returns (best), from one ranking of each day."""
    today = returns.where("r is not null and pos >= 1")
    whole = Window.partitionBy("pos")
    ends = {"_n": F.count("*").over(whole), "_best": F.row_number().over(whole.orderBy(F.desc("r"), "series_id")), "_worst": F.row_number().over(whole.orderBy("r", "series_id"))}
    ways = F.explode(F.array(F.struct(F.lit(True).alias("best"), F.col("_best").alias("k")), F.struct(F.lit(False).alias("best"), F.col("_worst").alias("k")))).alias("x")
    picks = today.withColumns(ends).where(F.col("_n") >= cfg.top_n).where((F.col("_best") <= cfg.top_n) | (F.col("_worst") <= cfg.top_n)).select("pos", "series_id", ways)
    picks = picks.where(F.col("x.k") <= cfg.top_n).select("pos", "series_id", "x.best")
    tomorrow = returns.select((F.col("pos") - 1).alias("pos"), "series_id", F.col("r").alias("next"))
    held = picks.join(tomorrow, ["pos", "series_id"], "left").groupBy("best", "pos").agg(F.avg("next").alias("gross"), F.sort_array(F.collect_list("series_id")).alias("basket"))
    held = held.where("gross is not null")
    before = F.lag("basket").over(Window.partitionBy("best").orderBy("pos"))
    held = held.withColumn("turnover", rebalance_turnover(F.col("basket"), before, cfg.top_n))
    r = F.col("gross") - F.col("turnover") * cfg.cost_bps / 10_000
    return held.select("best", (F.col("pos") + 1).alias("pos"), r.alias("r"), "turnover", "basket")


def raw_strategies(returns: DataFrame, prices: DataFrame, calendar: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """strategy_id, pos, date, r, turnover of the five strategies, not rounded; both null without a position."""
    daily = both_daily_ranks(returns, calendar, cfg)
    name = F.when(F.col("best"), ORDER[0]).otherwise(ORDER[1])
    traded = daily.select(name.alias("strategy_id"), "pos", "r", "turnover")
    every = calendar.crossJoin(returns.sparkSession.createDataFrame([(x,) for x in ORDER[:2]], "strategy_id string"))  # two names
    rows = every.join(traded, ["strategy_id", "pos"], "left").select("strategy_id", "pos", "date", "r", "turnover")
    made = {
        "momentum_12m": monthly_hold(momentum_baskets(prices, calendar, cfg), returns, calendar, cfg),
        "low_volatility": monthly_hold(low_vol_baskets(returns, calendar, cfg), returns, calendar, cfg),
        "buy_and_hold": buy_and_hold(returns, calendar, cfg),
    }
    for name, one in made.items():
        rows = rows.unionByName(one.select(F.lit(name).alias("strategy_id"), "pos", "date", "r", "turnover"))
    return rows


def all_strategies(returns: DataFrame, prices: DataFrame, calendar: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """strategy_id, pos, date, r (6 decimals), turnover (4) of the five strategies; both null without a position."""
    # means of 6-digit returns often end in exactly half a step: those go up, whatever the last bit of the sum
    stepped = F.floor(F.col("r") * 1e6 + 0.500001) / 1e6
    rows = raw_strategies(returns, prices, calendar, cfg)
    return rows.select("strategy_id", "pos", "date", stepped.alias("r"), F.when(F.col("r").isNotNull(), rounded(F.col("turnover"), 4)).alias("turnover"))


def holdings(baskets: DataFrame, most: int = DEFAULT.holdings) -> DataFrame:
    """series_id, months_held, fraction of months, of the most often held."""
    months = baskets.agg(F.countDistinct("month").alias("months"))
    counted = baskets.groupBy("series_id").agg(F.count("*").alias("months_held")).crossJoin(months)
    return counted.orderBy(F.desc("months_held"), "series_id").limit(most).select("series_id", "months_held", rounded(F.col("months_held") / F.col("months"), 4).alias("fraction"))
