"""Risk metrics of return series: (keys..., pos, r) in, one row per key out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.config import DEFAULT
from strandline.functions.stats import cagr, cents, order_index, rounded, years_between
from strandline.operators import gram


def blend(returns: DataFrame, *by: str) -> DataFrame:
    """Equal weights over the series present that day; rounded at 10 decimals, null when none is."""
    return returns.groupBy(*by, "pos", "date").agg(rounded(F.avg("r"), 10).alias("r"))


def weighted_blend(returns: DataFrame, weights: DataFrame, *by: str) -> DataFrame:
    """Weights (series_id, w) renormalised over the series present; null unless their sum is positive.

    Returns at 10 decimals and weights at 8 are added exactly, so that half
    steps don't hang on the order of the rows; the blend has 10 decimals.
    """
    joined = returns.join(weights, "series_id")
    r, w = F.col("r").try_cast("decimal(16,10)"), F.col("w").try_cast("decimal(12,8)")
    present = F.sum(F.when(r.isNotNull(), w)).cast("decimal(16,8)")
    total = F.sum(r * w).cast("decimal(30,18)")
    return joined.groupBy(*by, "pos", "date").agg(F.when(present > 0, F.round(total / present, 10)).cast("double").alias("r"))


def volatility(r: Column | str = "r", days: int = DEFAULT.trading_days) -> Column:
    return F.stddev_samp(r) * F.sqrt(F.lit(float(days)))


def sharpe(r: Column | str = "r", days: int = DEFAULT.trading_days, risk_free: float = DEFAULT.risk_free) -> Column:
    vol = volatility(r, days)
    return F.when(vol > 0, (F.avg(r) * days - risk_free) / vol)


def sorted_returns(r: Column | str = "r") -> Column:
    return F.sort_array(F.collect_list(r))


def value_at_risk(ordered: Column, confidence: float) -> Column:
    return -F.get(ordered, order_index(F.size(ordered), confidence))


def expected_shortfall(ordered: Column, confidence: float) -> Column:
    n = order_index(F.size(ordered), confidence) + 1
    tail = F.aggregate(F.slice(ordered, 1, n), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(ordered) > 0, -tail / n)


def with_wealth(returns: DataFrame, *by: str) -> DataFrame:
    """wealth: product of 1 + r so far, from 1; nulls are skipped."""
    so_far = Window.partitionBy(*by).orderBy("pos")
    return returns.withColumn("wealth", F.coalesce(F.product(1 + F.col("r")).over(so_far), F.lit(1.0)))


def max_drawdown(returns: DataFrame, *by: str) -> DataFrame:
    """keys, max_drawdown: the deepest fall from a peak that starts at 1; null without returns."""
    so_far = Window.partitionBy(*by).orderBy("pos")
    falls = with_wealth(returns, *by).withColumn("peak", F.greatest(F.lit(1.0), F.max("wealth").over(so_far)))
    return falls.groupBy(*by).agg(F.when(F.count("r") > 0, F.least(F.lit(0.0), F.min(F.col("wealth") / F.col("peak") - 1))).alias("max_drawdown"))


def beta_alpha(returns: DataFrame, market: DataFrame, *by: str, days: int = DEFAULT.trading_days, risk_free: float = DEFAULT.risk_free) -> DataFrame:
    """keys, beta, alpha over days that have both returns."""
    both = returns.join(market.select("pos", "m"), "pos").where("r is not null and m is not null")
    beta = F.when(F.count("*") > 1, F.regr_slope("r", "m"))
    return both.groupBy(*by).agg(beta.alias("beta"), F.avg("r").alias("own"), F.avg("m").alias("all")).select(
        *by, "beta", (F.col("own") * days - (risk_free + F.col("beta") * (F.col("all") * days - risk_free))).alias("alpha")
    )


def risk_table(returns: DataFrame, market: DataFrame, *by: str, confidence: float = DEFAULT.var_confidence) -> DataFrame:
    """n, volatility, sharpe, max_drawdown, var, es, beta, alpha of each key, whose returns fit an array; segments and selection do without."""
    basic = returns.groupBy(*by).agg(F.count("r").alias("n"), volatility().alias("volatility"), sharpe().alias("sharpe"), sorted_returns().alias("x"))
    basic = basic.withColumns({"var": value_at_risk(F.col("x"), confidence), "es": expected_shortfall(F.col("x"), confidence)}).drop("x")
    return basic.join(max_drawdown(returns, *by), list(by)).join(beta_alpha(returns, market, *by), list(by), "left")


def pair_correlations(returns: DataFrame, *by: str) -> DataFrame:
    """keys, a, b, corr, n of every unordered pair over the days that both have."""
    return gram.correlations(returns, *by).where("a < b")


def correlation_matrix(returns: DataFrame) -> DataFrame:
    """a, b, corr for all ordered pairs, 1 on the diagonal."""
    one = returns.select(F.col("series_id").alias("a"), F.col("series_id").alias("b")).distinct().withColumn("corr", F.lit(1.0))
    return gram.correlations(returns).select("a", "b", "corr").unionByName(one)


def average_correlation(returns: DataFrame, *by: str) -> DataFrame:
    return pair_correlations(returns, *by).groupBy(*by).agg(F.avg("corr").alias("avg_corr"), F.count("corr").alias("n_pairs"))


def complete_days(returns: DataFrame, *by: str) -> DataFrame:
    """Rows of the days on which every series has a return (listwise)."""
    over = Window.partitionBy(*by, "pos")
    marked = returns.withColumns({"_n": F.count("r").over(over), "_k": F.count("*").over(over)})
    return marked.where("_n = _k").drop("_n", "_k")


def covariance(returns: DataFrame, *by: str) -> DataFrame:
    """keys, a, b, cov, n over complete days, for all ordered pairs; no rows with fewer than two days."""
    return gram.covariances(returns, *by)


def means(returns: DataFrame, *by: str) -> DataFrame:
    return complete_days(returns, *by).groupBy(*by, "series_id").agg(F.avg("r").alias("mu"), F.count("*").alias("n")).where("n > 1")


def portfolio_moments(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """mu, sigma (daily), n of weights (series_id, w) over complete days."""
    cov = covariance(returns)
    wa, wb = weights.select(F.col("series_id").alias("a"), F.col("w").alias("wa")), weights.select(F.col("series_id").alias("b"), F.col("w").alias("wb"))
    spread = cov.join(wa, "a").join(wb, "b").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("wa") * F.col("wb") * F.col("cov")))).alias("sigma"))
    level = means(returns).join(weights, "series_id").agg(F.sum(F.col("mu") * F.col("w")).alias("mu"), F.max("n").alias("n"))
    return level.crossJoin(spread).select("mu", "sigma", "n")  # one row each


def shape(*by: str, returns: DataFrame) -> DataFrame:
    """Population skewness and excess kurtosis; null under three returns, 0 for a constant series."""
    n, flat = F.count("r"), F.coalesce(F.var_pop("r"), F.lit(0.0)) == 0
    value = lambda f: F.when(n >= 3, F.when(flat, 0.0).otherwise(f("r")))
    return returns.groupBy(*by).agg(n.alias("n"), value(F.skewness).alias("skewness"), value(F.kurtosis).alias("excess_kurtosis"))


def equity_curve(returns: DataFrame, *by: str, capital: float = DEFAULT.capital) -> DataFrame:
    """keys, pos, date, value: the first row is the capital, its own return ignored; a null return is a flat day."""
    order = Window.partitionBy(*by).orderBy("pos")
    step = F.when(F.row_number().over(order) == 1, F.lit(1.0)).otherwise(1 + F.coalesce(F.col("r"), F.lit(0.0)))
    steps = returns.withColumn("step", step)
    return steps.select(*by, "pos", "date", cents(capital * F.product("step").over(order)).alias("value"))


def anchored_curve(returns: DataFrame, *by: str, capital: float = DEFAULT.capital) -> DataFrame:
    """The batch form: starts the day before the first valid return, and drops what is earlier."""
    first = returns.where("r is not null").groupBy(*by).agg(F.greatest(F.lit(0), F.min("pos") - 1).alias("start"))
    held = returns.join(first, list(by)).where("pos >= start")
    order = Window.partitionBy(*by).orderBy("pos")
    steps = held.withColumn("step", F.when(F.col("pos") == F.col("start"), F.lit(1.0)).otherwise(1 + F.coalesce(F.col("r"), F.lit(0.0))))
    return steps.select(*by, "pos", "date", cents(capital * F.product("step").over(order)).alias("value"))


def curve_summary(curve: DataFrame, *by: str, capital: float = DEFAULT.capital) -> DataFrame:
    """total_return, final_value, years, cagr; no row with fewer than two points."""
    ends = curve.groupBy(*by).agg(F.max_by("value", "pos").alias("final_value"), F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("points")).where("points > 1")
    years = years_between(F.col("first"), F.col("last"))
    return ends.select(*by, (F.col("final_value") / capital - 1).alias("total_return"), "final_value", years.alias("years"), cagr(F.lit(capital), F.col("final_value"), years).alias("cagr"))


def period_stats(returns: DataFrame, *by: str) -> DataFrame:
    return returns.where("r is not null").groupBy(*by).agg(F.avg((F.col("r") > 0).cast("double")).alias("up_rate"), F.avg("r").alias("avg_return"), F.count("*").alias("n_periods"))


def derived_stats(returns: DataFrame, *by: str, capital: float = DEFAULT.capital) -> DataFrame:
    return curve_summary(equity_curve(returns, *by, capital=capital), *by, capital=capital).join(period_stats(returns, *by), list(by), "left")


def scaled_curve(curve: DataFrame, target: int, width: float = 600.0, height: float = 200.0, margin: float = 0.1) -> DataFrame:
    """pos, x, y (1 decimal) of one sampled curve drawn in a box: x by place among all rows, y down from the top, with a margin."""
    whole = Window.partitionBy()  # one curve, as long as the calendar
    at = F.row_number().over(Window.orderBy("pos")) - 1
    lo, hi = F.min("value").over(whole), F.max("value").over(whole)
    pad = margin * height
    tenth = lambda c: F.floor(c * 10 + 0.5) / 10
    x = at / F.nullif(F.count("*").over(whole) - 1, F.lit(0)) * width
    y = height - pad - (F.col("value") - lo) / F.coalesce(F.nullif(hi - lo, F.lit(0.0)), F.lit(1.0)) * (height - 2 * pad)
    return sampled(curve.withColumns({"x": tenth(x), "y": tenth(y)}), target=target).select("pos", "x", "y")


def best_of_columns(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, metric, value, is_best (equals the column's greatest value; nulls never do)."""
    long = rows.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select(key, "x.*")
    best = F.max("value").over(Window.partitionBy("metric"))
    return long.withColumn("is_best", F.coalesce(F.col("value") == best, F.lit(False)))


def sampled(curve: DataFrame, *by: str, target: int) -> DataFrame:
    """Every ceil(n / target)-th row and the last, if there are more than target."""
    order = Window.partitionBy(*by).orderBy("pos")
    whole = Window.partitionBy(*by)
    numbered = curve.withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count("*").over(whole)})
    keep = (F.col("_n") <= target) | (F.col("_i") % F.ceil(F.col("_n") / target) == 0) | (F.col("_i") == F.col("_n") - 1)
    return numbered.where(keep).drop("_i", "_n")


def every_step(curve: DataFrame, *by: str, step: int) -> DataFrame:
    """Every step-th row from the first, and the last."""
    numbered = curve.withColumns({"_i": F.row_number().over(Window.partitionBy(*by).orderBy("pos")) - 1, "_n": F.count("*").over(Window.partitionBy(*by))})
    return numbered.where((F.col("_i") % step == 0) | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")


def hero_stats(calendars: DataFrame, ids: DataFrame, tests: DataFrame, windows: DataFrame) -> DataFrame:
    """stocks, years (from the earliest to the latest day of all calendars), var_days (evaluable days of the backtest; null without one), crises. Each side is one row."""
    span = calendars.agg(years_between(F.min("date"), F.max("date"), 365.2425).alias("years"))
    held = ids.agg(F.countDistinct("series_id").alias("stocks"))
    days = tests.where("method = 'hist' and confidence = 0.95").agg(F.max("n").alias("var_days"))
    return held.crossJoin(span).crossJoin(days).crossJoin(windows.agg(F.count("*").alias("crises")))


def monthly(returns: DataFrame, *by: str) -> DataFrame:
    return returns.where("r is not null").groupBy(*by, F.trunc("date", "MM").alias("month")).agg((F.product(1 + F.col("r")) - 1).alias("r"))
