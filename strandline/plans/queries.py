"""Named queries over the test tables: each takes (spark, sf_dir) and returns a DataFrame.

Doubles are rounded here, at the edge, so that other engines can be compared
value by value.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.config import DEFAULT
from strandline.functions import stats
from strandline.operators import asof, costs, findings, gate, intervals, metrics, montecarlo, optimize, rolling, segments, selection, strategies, stress
from strandline.sources import json_payload, vintages
from strandline.sources.panel import Panel, benchmark_options, clean, default_selection, enough_history, is_preset, matching, named, panel
from strandline.sources.stored import once, shared_folder, stored
from strandline.streaming import bars

START = date(1997, 1, 1)
DIGITS = 6
OLD_END = date(2001, 9, 30)
GAPPED = replace(DEFAULT, top_n=2)
SOME_STOCKS = ("Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#99")
NAMES = [("Brand#11", "First Brand"), ("Brand#12", "Second Brand")]
INDEX_LABELS = {"index:F": "Fulfilled", "index:O": "Open"}
ASKED = (date(1980, 1, 1), date(1995, 2, 28), START, date(1999, 12, 25), date(2001, 6, 17), date(2030, 1, 1))
LONG_FIRST, LONG_LAST = date(1995, 6, 1), date(2000, 3, 31)

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*[(stats.rounded(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def dense(spark: SparkSession, sf_dir: str) -> Panel:
    return panel(spark, sf_dir)


def gapped(spark: SparkSession, sf_dir: str) -> Panel:
    return panel(spark, sf_dir, gapped=True)


def strategy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all strategies, made once like the panel."""

    def make() -> DataFrame:
        p = dense(spark, sf_dir)
        return stored(strategies.all_strategies(p.stocks(), p.prices.where("kind = 'stock'"), p.calendar), "strategies")

    return once(spark, ("strategies",), (f"{sf_dir}/lineitem.parquet", f"{sf_dir}/part.parquet"), make)


def market_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.blend(dense(spark, sf_dir).stocks())


# --- sources and sinks


@query
def s1_prices(spark, sf_dir):
    p = dense(spark, sf_dir).prices.where("kind = 'stock'").where(F.col("date").between(F.lit(START), F.lit(date(1998, 12, 31))))
    return rounded(p.select("series_id", "pos", "date", "price"), 4)


@query
def s1_prices_full(spark, sf_dir):
    """All dates; s1_prices is the part of it that SQL repeats."""
    return rounded(dense(spark, sf_dir).prices.where("kind = 'stock'").select("series_id", "pos", "date", "price"), 4)


@query
def s2_enough_history(spark, sf_dir):
    return enough_history(gapped(spark, sf_dir).prices.where("kind = 'stock'"), 0.98)


@query
def s3_universe(spark, sf_dir):
    r = dense(spark, sf_dir).returns
    return r.groupBy("kind").agg(F.countDistinct("series_id").alias("n_series"), F.count("r").alias("n_returns"), F.min("date").alias("first"), F.max("date").alias("last"))


@query
def s5_names(spark, sf_dir):
    return named(dense(spark, sf_dir).stocks(), spark.createDataFrame(NAMES, "series_id string, name string"))


@query
def s4_long_history(spark, sf_dir):
    r = panel(spark, sf_dir, first=LONG_FIRST, last=LONG_LAST).returns
    return r.groupBy("series_id").agg(F.min("date").alias("first"), F.max("pos").alias("last_pos"), F.count("r").alias("n"), stats.rounded(F.sum("r"), 6).alias("total"))


@query
def s7_results_round_trip(spark, sf_dir):
    rows = strategy_rows(spark, sf_dir)
    return json_payload.parsed_results(json_payload.results(rows, dense(spark, sf_dir).calendar, strategies.ORDER))


@query
def s7_windows(spark, sf_dir):
    import json

    return json_payload.windows_of(spark.createDataFrame([(json.dumps(json_payload.parameters()["validation"]),)], "value string"))


@query
def s6_json_round_trip(spark, sf_dir):
    p = gapped(spark, sf_dir)
    return json_payload.parsed(json_payload.payload(p.returns, p.calendar)).where("kind = 'stock'")


@query
def s8_wide(spark, sf_dir):
    r = gapped(spark, sf_dir).stocks().withColumn("c", F.regexp_replace("series_id", "[^A-Za-z0-9]", "_"))
    return r.groupBy("date").pivot("c").agg(F.first("r", ignorenulls=True))


@query
def s10_by_date(spark, sf_dir):
    return json_payload.by_date(gapped(spark, sf_dir).stocks())


# --- projections and filters


@query
def f1_returns(spark, sf_dir):
    return dense(spark, sf_dir).returns.select("series_id", "kind", "pos", "date", "r")


@query
def f1_returns_gapped(spark, sf_dir):
    return gapped(spark, sf_dir).returns.select("series_id", "kind", "pos", "date", "r")


@query
def f2_trailing_return(spark, sf_dir):
    p = dense(spark, sf_dir).prices.where("kind = 'stock'")
    past = F.lag("price", DEFAULT.momentum_days).over(Window.partitionBy("series_id").orderBy("pos"))
    return rounded(p.select("series_id", "pos", (F.col("price") / past - 1).alias("trailing")).where("trailing is not null"))


@query
def f3_slice_from(spark, sf_dir):
    r = dense(spark, sf_dir).stocks().where(F.col("date") >= F.lit(START))
    return r.groupBy("series_id").agg(F.min("pos").alias("first_pos"), F.count("*").alias("days"), F.count("r").alias("n"))


def suffix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suffix summaries of all stocks, made once like the panel: any start date is a lookup."""

    def make() -> DataFrame:
        p = dense(spark, sf_dir)
        both = p.stocks().join(p.market().select("pos", "m"), "pos", "left")
        return stored(segments.suffixes(both, "series_id", market=True), "suffixes")

    return once(spark, ("suffixes",), (f"{sf_dir}/lineitem.parquet", f"{sf_dir}/part.parquet"), make)


@query
def f3_any_start(spark, sf_dir):
    """Every metric of every stock from every date on."""
    return rounded(segments.metrics_of(suffix_table(spark, sf_dir), "series_id", "pos"))


@query
def f3_from_dates(spark, sf_dir):
    """The same for dates that a user may ask: before the first, between two, the last and after it."""
    starts = spark.createDataFrame([(x,) for x in ASKED], "start date")
    return rounded(segments.from_dates(suffix_table(spark, sf_dir), dense(spark, sf_dir).calendar, starts, "series_id"))


@query
def f7_clean(spark, sf_dir):
    r = dense(spark, sf_dir).stocks()
    broken = F.when(F.col("pos") % 97 == 13, float("nan")).when(F.col("pos") % 89 == 5, float("-inf")).otherwise(F.col("r"))
    kept = r.withColumn("r", clean(broken))
    return rounded(kept.groupBy("series_id").agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.max("r").alias("top")))


@query
def f13_default_selection(spark, sf_dir):
    ids = dense(spark, sf_dir).stocks()
    one = lambda preset, name: default_selection(ids, preset).withColumn("asked", F.lit(name))
    return one(SOME_STOCKS, "known").unionByName(one(("Brand#11", "x", "y"), "one_known"))


@query
def f14_benchmark_options(spark, sf_dir):
    return benchmark_options(dense(spark, sf_dir).returns, INDEX_LABELS).withColumn("keys", F.array_join("keys", ","))


@query
def f15_search_names(spark, sf_dir):
    return matching(s5_names(spark, sf_dir), " second b ").unionByName(matching(s5_names(spark, sf_dir), "#13"))


@query
def k2_preset_active(spark, sf_dir):
    return is_preset(f13_preset(spark, sf_dir), SOME_STOCKS[:4])


@query
def f9_repriced(spark, sf_dir):
    rows = strategy_rows(spark, sf_dir)
    return rounded(rows.select("strategy_id", "pos", costs.repriced(F.col("r"), F.col("turnover"), DEFAULT.cost_bps, F.lit(50.0)).alias("r50")), 8)


@query
def f12_earliest_backtest(spark, sf_dir):
    c = dense(spark, sf_dir).calendar
    n = c.agg(F.count("*").alias("n"))
    return c.crossJoin(n).where(F.col("pos") == F.least(F.lit(DEFAULT.var_window), F.col("n") - 1)).select("pos", "date")


@query
def f13_preset(spark, sf_dir):
    ids = dense(spark, sf_dir).stocks().select("series_id").distinct()
    preset = spark.createDataFrame([(x,) for x in SOME_STOCKS], "series_id string")
    return preset.join(ids, "series_id", "left_semi")


@query
def f15_search(spark, sf_dir):
    ids = dense(spark, sf_dir).stocks().select("series_id").distinct()
    return ids.where(F.lower("series_id").contains(F.lower(F.trim(F.lit(" BRAND#2 ")))))


@query
def f16_every_step(spark, sf_dir):
    curve = metrics.equity_curve(strategy_rows(spark, sf_dir), "strategy_id")
    return metrics.every_step(curve, "strategy_id", step=5)


@query
def f16_sampled_curve(spark, sf_dir):
    curve = metrics.equity_curve(strategy_rows(spark, sf_dir), "strategy_id")
    return metrics.sampled(curve, "strategy_id", target=DEFAULT.chart_points)


# --- joins


@query
def j1_calendars(spark, sf_dir):
    r = dense(spark, sf_dir).returns.where("r is not null")
    days = lambda k: r.where(F.col("series_id") == k).select("date").distinct()
    a, b = days("index:F"), days("index:O")
    both, either = a.intersect(b), a.union(b).distinct()
    return both.agg(F.count("*").alias("shared")).crossJoin(either.agg(F.count("*").alias("together"))).withColumn("dropped", F.col("together") - F.col("shared"))


@query
def j2_index_on_calendar(spark, sf_dir):
    p = dense(spark, sf_dir)
    return p.calendar.join(p.returns.where("kind = 'index'").select("pos", "series_id", "r"), "pos", "left").select("series_id", "pos", "date", "r")


@query
def j8_window_rows(spark, sf_dir):
    rows = stress.in_windows(dense(spark, sf_dir).stocks(), stress.windows_table(spark))
    return rounded(rows.groupBy("window_key", "series_id").agg(F.count("*").alias("days"), F.sum("r").alias("total")))


@query
def j9_calm_days(spark, sf_dir):
    rows = stress.outside_windows(dense(spark, sf_dir).stocks(), stress.windows_table(spark))
    return rounded(rows.groupBy("series_id").agg(F.count("*").alias("days"), F.sum("r").alias("total")))


@query
def j8_order_windows(spark, sf_dir):
    """Market days and their returns within a window of each order: as many windows as orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    spans = orders.select(F.col("o_orderkey").alias("window_key"), F.to_date("o_orderdate").alias("start"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 90 - 3).cast("int")).alias("end"))
    rows = intervals.inside(dense(spark, sf_dir).market(), spans)
    return rounded(rows.groupBy("window_key").agg(F.count("*").alias("days"), F.sum("m").alias("total")))


@query
def j9_order_gaps(spark, sf_dir):
    """Market days in no order's two days."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 101 = 0")
    spans = orders.select(F.to_date("o_orderdate").alias("start"), F.date_add(F.to_date("o_orderdate"), 1).alias("end"))
    return intervals.inside(dense(spark, sf_dir).market(), spans, how="left_anti").select("pos", "date")


@query
def j14_as_of(spark, sf_dir):
    """The last price before each month of series that have none on many days, and its date."""
    p = gapped(spark, sf_dir)
    months = p.calendar.groupBy(F.trunc("date", "MM").alias("date")).agg(F.count("*").alias("days"))
    ids = p.prices.select("series_id").distinct()
    prices = p.prices.where("price is not null and pos % 7 <> 3").select("series_id", "date", "price")
    found = asof.as_of(months.crossJoin(ids), prices, "series_id", at="date", values=["price"], since="priced_on", strict=True)  # months x series
    return rounded(found, 4)


@query
def j12_uncovered_dates(spark, sf_dir):
    p = gapped(spark, sf_dir)
    has = p.stocks().where("r is not null").select("series_id", "date")
    every = p.stocks().select("series_id", "date")
    return every.join(has, ["series_id", "date"], "left_anti")


@query
def j15_curves_wide(spark, sf_dir):
    curve = metrics.equity_curve(strategy_rows(spark, sf_dir), "strategy_id")
    return curve.groupBy("date").pivot("strategy_id", strategies.ORDER).agg(F.first("value"))


@query
def j16_rolling_chart(spark, sf_dir):
    p = dense(spark, sf_dir)
    return rounded(rolling.rolling_chart(rolling.rolling_metrics(p.stocks(), p.market(), "series_id"), "volatility", list(SOME_STOCKS[:3])), 5)


# --- aggregates


@query
def a1_equal_weight(spark, sf_dir):
    return rounded(metrics.blend(gapped(spark, sf_dir).stocks()), 8)


@query
def a2_weighted(spark, sf_dir):
    p = gapped(spark, sf_dir)
    weights = p.stocks().select("series_id").distinct().withColumn("w", F.length("series_id") / 10)
    return rounded(metrics.weighted_blend(p.stocks(), weights), 8)


@query
def a3_risk_table(spark, sf_dir):
    p = dense(spark, sf_dir)
    later = lambda df: df.where(F.col("date") >= F.lit(START))
    return rounded(metrics.risk_table(later(p.stocks()), later(p.market()), "series_id"))


@query
def a5_portfolio_summary(spark, sf_dir):
    blend = market_blend(spark, sf_dir).withColumn("series_id", F.lit("portfolio"))
    return rounded(metrics.risk_table(blend, dense(spark, sf_dir).market(), "series_id"))


@query
def a6_tail_selected(spark, sf_dir):
    """Value at risk and expected shortfall without an array of returns."""
    return rounded(selection.tail(dense(spark, sf_dir).stocks(), "series_id"))


@query
def a6_tail_lines(spark, sf_dir):
    """The same selection over all order lines by status: millions of prices in two keys."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_linestatus").alias("status"), (F.col("l_discount") - F.col("l_tax")).alias("r"), F.col("l_extendedprice").cast("double").alias("price"))
    by_price = selection.selected(lines, "status", rank=F.floor(F.col("n") / 2), value="price").select("status", "n", F.col("value").alias("upper_median"))
    return rounded(by_price.join(selection.tail(lines, "status").drop("n"), "status"), 4)


@query
def a9_correlations(spark, sf_dir):
    return rounded(metrics.correlation_matrix(gapped(spark, sf_dir).stocks()))


@query
def a10_average_correlation(spark, sf_dir):
    return rounded(metrics.average_correlation(gapped(spark, sf_dir).stocks()))


@query
def a11_covariance(spark, sf_dir):
    return rounded(metrics.covariance(gapped(spark, sf_dir).stocks()), 9)


@query
def a13_portfolio_moments(spark, sf_dir):
    p = gapped(spark, sf_dir)
    ids = p.stocks().select("series_id").distinct()
    n = ids.agg(F.count("*").alias("k"))
    return rounded(metrics.portfolio_moments(p.stocks(), ids.crossJoin(n).select("series_id", (1 / F.col("k")).alias("w"))), 8)


@query
def a14_shape(spark, sf_dir):
    return rounded(metrics.shape("series_id", returns=dense(spark, sf_dir).stocks()), 5)


@query
def a15_derived_stats(spark, sf_dir):
    rows = strategy_rows(spark, sf_dir).where(F.col("date") >= F.lit(START))
    return rounded(metrics.derived_stats(rows, "strategy_id"))


@query
def a23_monthly(spark, sf_dir):
    return rounded(metrics.monthly(dense(spark, sf_dir).stocks(), "series_id"))


@query
def a24_holdings(spark, sf_dir):
    p = dense(spark, sf_dir)
    return strategies.holdings(strategies.low_vol_baskets(p.stocks(), p.calendar))


@query
def a28_best_columns(spark, sf_dir):
    rows = metrics.best_of_columns(a15_derived_stats(spark, sf_dir), "strategy_id", ["up_rate", "avg_return", "total_return", "final_value"])
    return rounded(rows)


@query
def a29_any_data(spark, sf_dir):
    rows = stress.before_windows(gapped(spark, sf_dir).stocks(), stress.windows_table(spark))
    return rows.groupBy("window_key").agg(F.countDistinct(F.when(F.col("r").isNotNull(), F.col("series_id"))).alias("n"))


@query
def a30_coverage(spark, sf_dir):
    return gapped(spark, sf_dir).prices.groupBy("series_id").agg(F.count("price").alias("days"))


@query
def a31_hero(spark, sf_dir):
    p = dense(spark, sf_dir)
    span = p.calendar.agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("days"))
    ids = p.stocks().agg(F.countDistinct("series_id").alias("stocks"))
    return rounded(span.crossJoin(ids).withColumn("years", stats.years_between(F.col("first"), F.col("last"), 365.2425)))


@query
def a31_hero_union(spark, sf_dir):
    """Over both calendars, with the days of the VaR backtest and the number of crises."""
    p, long = dense(spark, sf_dir), panel(spark, sf_dir, first=LONG_FIRST, last=LONG_LAST)
    tests = w8_var_backtest(spark, sf_dir)
    return rounded(metrics.hero_stats(p.calendar.unionByName(long.calendar), p.stocks(), tests, stress.windows_table(spark)))


# --- windows


@query
def w1_equity(spark, sf_dir):
    return metrics.equity_curve(dense(spark, sf_dir).stocks(), "series_id").select("series_id", "pos", "value")


@query
def w1_equity_blocks(spark, sf_dir):
    """The same curves from a scan of two levels."""
    return segments.equity_curve(dense(spark, sf_dir).stocks(), "series_id").select("series_id", "pos", "value")


@query
def a5_drawdown_blocks(spark, sf_dir):
    """The falls of the equal-weight portfolio and of each stock, block by block."""
    p = dense(spark, sf_dir)
    every = p.stocks().unionByName(market_blend(spark, sf_dir).withColumn("series_id", F.lit("portfolio")))
    return rounded(segments.max_drawdown(every, "series_id"))


@query
def w2_anchored_equity(spark, sf_dir):
    return metrics.anchored_curve(dense(spark, sf_dir).stocks(), "series_id").select("series_id", "pos", "value")


@query
def w4_rolling(spark, sf_dir):
    p = dense(spark, sf_dir)
    rows = rolling.rolling_metrics(p.stocks(), p.market(), "series_id").drop("date")
    return rounded(rows, 5)


@query
def w6_var_lines(spark, sf_dir):
    return rounded(rolling.var_lines(market_blend(spark, sf_dir)), 8)


@query
def w8_var_backtest(spark, sf_dir):
    lines = rolling.var_lines(market_blend(spark, sf_dir)).where(F.col("date") >= F.lit(START))
    return rounded(rolling.coverage_tests(rolling.exceptions(lines)), 5)


@query
def w8_var_backtest_by_stock(spark, sf_dir):
    lines = rolling.var_lines(dense(spark, sf_dir).stocks(), "series_id").where(F.col("date") >= F.lit(START))
    return rounded(rolling.coverage_tests(rolling.exceptions(lines, "series_id"), "series_id"), 5)


@query
def w10_basel_windows(spark, sf_dir):
    exc = rolling.exceptions(rolling.var_lines(market_blend(spark, sf_dir))).where("method = 'hist' and confidence = 0.99")
    return rolling.basel_windows(exc, "method")


@query
def w11_basel_summary(spark, sf_dir):
    return rolling.basel_summary(w10_basel_windows(spark, sf_dir), "method")


@query
def w12_momentum_1d(spark, sf_dir):
    p = dense(spark, sf_dir)
    return rounded(strategies.daily_rank(p.stocks(), p.calendar, True).select("pos", "r", "turnover"), 8)


@query
def w12_mean_reversion_gapped(spark, sf_dir):
    p = gapped(spark, sf_dir)
    return rounded(strategies.daily_rank(p.stocks(), p.calendar, False, GAPPED).select("pos", "r", "turnover"), 8)


@query
def w14_momentum_baskets(spark, sf_dir):
    p = dense(spark, sf_dir)
    return strategies.momentum_baskets(p.prices.where("kind = 'stock'"), p.calendar).drop("seen")


@query
def w15_low_vol_baskets(spark, sf_dir):
    p = dense(spark, sf_dir)
    return strategies.low_vol_baskets(p.stocks(), p.calendar).drop("seen")


@query
def w16_strategies(spark, sf_dir):
    return strategy_rows(spark, sf_dir).select("strategy_id", "pos", "r", "turnover")


@query
def w17_look_ahead(spark, sf_dir):
    """Both selectors, by the last day that each choice is made from."""
    p = dense(spark, sf_dir)
    made = {"momentum": strategies.momentum_baskets(p.prices.where("kind = 'stock'"), p.calendar), "low_volatility": strategies.low_vol_baskets(p.stocks(), p.calendar)}
    one = lambda name: strategies.look_ahead(made[name], p.calendar).withColumn("selector", F.lit(name))
    return one("momentum").unionByName(one("low_volatility"))


@query
def v1_var_chart(spark, sf_dir):
    return rounded(rolling.var_chart(rolling.var_lines(market_blend(spark, sf_dir)), "hist_95"), 8)


# --- costs


@query
def n10_break_even(spark, sf_dir):
    return rounded(costs.break_even(strategy_rows(spark, sf_dir)), 4)


@query
def n11_cost_sensitivity(spark, sf_dir):
    return rounded(costs.sensitivity(strategy_rows(spark, sf_dir)))


@query
def n12_linearity(spark, sf_dir):
    """All five strategies, run anew at another cost."""
    p = dense(spark, sf_dir)
    run = lambda cfg: strategies.raw_strategies(p.stocks(), p.prices.where("kind = 'stock'"), p.calendar, cfg)
    out = costs.linearity(run(DEFAULT), run(replace(DEFAULT, cost_bps=100.0)), DEFAULT.cost_bps, 100.0)
    return out.select("strategy_id", (F.col("max_error") <= 1e-12).alias("linear"), "n_turnover_changes")


@query
def n10_break_even_label(spark, sf_dir):
    rows = costs.break_even(strategy_rows(spark, sf_dir))
    return rows.select("strategy_id", costs.break_even_label(F.col("kind"), F.col("bps")).alias("label"))


@query
def v1_best_active(spark, sf_dir):
    return rounded(costs.best_active(c7_verdict(spark, sf_dir), strategies.ORDER), 4)


@query
def c3_comparison(spark, sf_dir):
    return rounded(costs.comparison(strategy_rows(spark, sf_dir)))


@query
def c7_verdict(spark, sf_dir):
    return rounded(costs.verdict(strategy_rows(spark, sf_dir), strategies.ORDER), 4)


@query
def c13_low_volatility(spark, sf_dir):
    return costs.low_volatility_verdict(c3_comparison(spark, sf_dir))


@query
def w18_verdict_order(spark, sf_dir):
    return costs.winners(c7_verdict(spark, sf_dir))


@query
def k12_formats(spark, sf_dir):
    rows = c3_comparison(spark, sf_dir)
    share = F.col("total_return")
    return rows.select("strategy_id", stats.tone(share).alias("tone"), stats.percent(share).alias("pct"), stats.signed_percent(share).alias("signed"), stats.signed_points(share).alias("points"))


# --- stress


@query
def c9_stress_report(spark, sf_dir):
    p = gapped(spark, sf_dir)
    return rounded(stress.report(p.stocks(), p.market(), stress.windows_table(spark)))


@query
def c9_stress_correlations(spark, sf_dir):
    return rounded(stress.correlations(gapped(spark, sf_dir).stocks(), stress.windows_table(spark)))


@query
def c8_optimized_out_of_sample(spark, sf_dir):
    p, windows = dense(spark, sf_dir), stress.windows_table(spark)
    return rounded(stress.out_of_sample(p.stocks(), stress.optimized_weights(p.stocks(), windows), windows))


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stocks of the gapped panel, of which those in S miss two days of seven."""
    missing = F.col("series_id").startswith("S") & (F.col("pos") % 7 < 2)
    return gapped(spark, sf_dir).stocks().withColumn("r", F.when(~missing, F.col("r")))


@query
def v1_uncovered(spark, sf_dir):
    return rounded(stress.uncovered(holed(spark, sf_dir), stress.windows_table(spark)))


def fixed_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights that SQL can repeat in place of solved ones: 1 : 2 : 4 ... by name, and the other way round."""
    place = Window.partitionBy(F.lit(1)).orderBy("series_id")  # a few series
    ids = gapped(spark, sf_dir).stocks().select("series_id").distinct().withColumns({"i": F.row_number().over(place), "k": F.count("*").over(Window.partitionBy(F.lit(1)))})
    way = F.explode(F.array(F.struct(F.lit("min_variance").alias("kind"), F.pow(2.0, F.col("i") - 1).alias("v")), F.struct(F.lit("max_sharpe").alias("kind"), F.pow(2.0, F.col("k") - F.col("i")).alias("v")))).alias("x")
    rows = ids.select("series_id", "k", way).select("x.kind", "series_id", (F.col("x.v") / (F.pow(2.0, F.col("k")) - 1)).alias("w"))
    return rows.crossJoin(stress.windows_table(spark).select("window_key"))  # a few windows


@query
def k1_shown_weights(spark, sf_dir):
    rows = fixed_weights(spark, sf_dir).withColumn("w", F.col("w") * F.col("w"))
    return stress.shown_weights(rows, "window_key", "kind", least=0.005)


@query
def c8_fixed_weights(spark, sf_dir):
    """The out-of-sample figures of fixed weights."""
    windows = stress.windows_table(spark)
    return rounded(stress.out_of_sample(gapped(spark, sf_dir).stocks(), fixed_weights(spark, sf_dir), windows))


@query
def v1_underperformance_fixed(spark, sf_dir):
    p, windows = gapped(spark, sf_dir), stress.windows_table(spark)
    return stress.underperformance(stress.report(p.stocks(), p.market(), windows), c8_fixed_weights(spark, sf_dir))


@query
def v1_underperformance(spark, sf_dir):
    p, windows = dense(spark, sf_dir), stress.windows_table(spark)
    return stress.underperformance(stress.report(p.stocks(), p.market(), windows), c8_optimized_out_of_sample(spark, sf_dir))


@query
def c11_findings(spark, sf_dir):
    """From the first day with a whole VaR window before it, and the stress windows."""
    p, windows = dense(spark, sf_dir), stress.windows_table(spark)
    blend = market_blend(spark, sf_dir)
    first = findings.earliest_day(p.calendar).select(F.col("pos").alias("first"))
    lines = rolling.var_lines(blend).crossJoin(first).where("pos >= first").drop("first")  # one row
    tests = rolling.coverage_tests(rolling.exceptions(lines))
    kurtosis = metrics.shape(returns=blend.crossJoin(first).where("pos >= first"))
    out = findings.clustering(tests).unionByName(findings.fat_tails(tests, kurtosis))
    return rounded(out.unionByName(findings.correlation(stress.correlations(p.stocks(), windows), windows)), 5)


@query
def c11_optimizer(spark, sf_dir):
    p, windows = dense(spark, sf_dir), stress.windows_table(spark)
    return findings.optimizer(stress.report(p.stocks(), p.market(), windows), c8_optimized_out_of_sample(spark, sf_dir), windows)


@query
def c11_exception_clusters(spark, sf_dir):
    return stress.clusters(rolling.exceptions(rolling.var_lines(market_blend(spark, sf_dir))))


@query
def c12_worst_exceptions(spark, sf_dir):
    exc = rolling.exceptions(rolling.var_lines(market_blend(spark, sf_dir))).where("method = 'hist' and confidence = 0.99 and exc = 1")
    return rounded(exc.orderBy("r", "pos").limit(5).select("pos", "date", "r"))


@query
def c12_hero_curve(spark, sf_dir):
    held = strategy_rows(spark, sf_dir).where(F.col("strategy_id") == costs.PASSIVE)
    return metrics.scaled_curve(metrics.equity_curve(held, "strategy_id"), 150)


# --- portfolios


@query
def n2_two_asset_min_variance(spark, sf_dir):
    stocks = gapped(spark, sf_dir).stocks()
    two = stocks.join(stocks.select("series_id").distinct().orderBy("series_id").limit(2), "series_id", "left_semi")
    return optimize.portfolios(two, kinds=("min_variance",)).select("series_id", (stats.rounded(F.col("w"), 5) + 0.0).alias("w"))


@query
def n8_frontier(spark, sf_dir):
    return optimize.portfolios(gapped(spark, sf_dir).stocks())


@query
def n7_cloud(spark, sf_dir):
    return rounded(optimize.cloud(gapped(spark, sf_dir).stocks(), replace(DEFAULT, cloud_points=500)))


@query
def n7_cloud_full(spark, sf_dir):
    """With the usual number of points; n7_cloud has the first 500 for SQL."""
    return rounded(optimize.cloud(gapped(spark, sf_dir).stocks()))


@query
def n9_monte_carlo(spark, sf_dir):
    return rounded(montecarlo.summary(_values(spark, sf_dir)), 3)


@query
def n9_monte_carlo_full(spark, sf_dir):
    """With the usual number of paths; n9_monte_carlo has the first 2000 for SQL."""
    return rounded(montecarlo.summary(_values(spark, sf_dir, None)), 3)


@query
def n9_monte_carlo_5y(spark, sf_dir):
    """With the usual number of paths over five years of days."""
    return rounded(montecarlo.summary(_values(spark, sf_dir, None, 5 * DEFAULT.trading_days)), 3)


def _values(spark: SparkSession, sf_dir: str, paths: int | None = 2000, days: int = 63) -> DataFrame:
    moments = market_blend(spark, sf_dir).agg(F.avg("r").alias("mu"), F.stddev_samp("r").alias("sigma"))
    return montecarlo.terminal_values(moments, days, paths)


@query
def a25_histogram(spark, sf_dir):
    return rounded(montecarlo.histogram(_values(spark, sf_dir)), 3)


@query
def v1_histogram_marker(spark, sf_dir):
    return rounded(montecarlo.marked(montecarlo.histogram(_values(spark, sf_dir))), 3)


@query
def a25_histogram_full(spark, sf_dir):
    return rounded(montecarlo.histogram(_values(spark, sf_dir, None)), 3)


# --- vintages


def _vintages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = dense(spark, sf_dir).returns
    old = r.where(F.col("date") <= F.lit(OLD_END)).where("series_id <> 'Brand#55'")
    shift = F.when(F.col("pos") % 97 == 13, 0.01).otherwise(0.0) + F.when((F.col("pos") % 53 == 7) & (F.col("date") > F.lit(OLD_END)), 0.5).otherwise(0.0)
    new = r.where("series_id <> 'Brand#11'").withColumn("r", stats.rounded(F.col("r") + shift, 6))
    return old, new.where("not (series_id = 'index:F' and pos % 61 = 5)")


@query
def c14_gate(spark, sf_dir):
    old, new = _vintages(spark, sf_dir)
    return gate.checks(old, new, date(2001, 11, 20), ["F", "O"])


def stored_vintages(spark: SparkSession, sf_dir: str) -> str:
    """A store of two vintages of the panel, made once like the panel; its folder."""

    def make() -> str:
        import uuid

        root = f"{shared_folder(spark)}/vintages-{uuid.uuid4().hex}"
        old, new = _vintages(spark, sf_dir)
        vintages.write(old, root, "2001-09-30")
        vintages.write(new, root, "2001-11-20")
        return root

    return once(spark, ("vintages",), (f"{sf_dir}/lineitem.parquet", f"{sf_dir}/part.parquet"), make)


@query
def c14_gate_stored(spark, sf_dir):
    """The gate between the last vintage of a store and the one before."""
    root = stored_vintages(spark, sf_dir)
    return gate.checks(vintages.read(spark, root, back=1), vintages.read(spark, root), date(2001, 11, 20), ["F", "O"])


@query
def s9_previous_vintage(spark, sf_dir):
    """Each vintage of a store by month, as its rows are read back."""
    root = stored_vintages(spark, sf_dir)
    each = [vintages.read(spark, root, name).withColumn("vintage", F.lit(name)) for name in vintages.names(spark, root)]
    rows = each[0]
    for more in each[1:]:
        rows = rows.unionByName(more)
    return rounded(rows.groupBy("vintage", "kind", F.trunc("date", "MM").alias("month")).agg(F.count("*").alias("days"), F.count("r").alias("n"), F.sum("r").alias("total")))


@query
def c14_restated(spark, sf_dir):
    return rounded(gate.restated(*_vintages(spark, sf_dir)))


@query
def c14_extremes(spark, sf_dir):
    return rounded(gate.extremes(*_vintages(spark, sf_dir)))


@query
def c14_missing_keys(spark, sf_dir):
    p = gapped(spark, sf_dir)
    return json_payload.missing_keys(json_payload.payload(p.returns, p.calendar), ["meta", "series", "benchmark", "indexes"])


@query
def k11_is_stale(spark, sf_dir):
    """Whether each day was stale on one of three later days."""
    asked = spark.createDataFrame([(date(2001, 11, 20),), (date(1998, 7, 6),), (date(1996, 1, 2),)], "today date")
    rows = dense(spark, sf_dir).calendar.crossJoin(asked)  # three days
    return rows.select("pos", "today", stats.is_stale(F.col("date"), F.col("today"), DEFAULT.stale_days, DEFAULT.max_lookback).alias("stale"))


@query
def k12_ticker_labels(spark, sf_dir):
    return s5_names(spark, sf_dir).select("series_id", stats.ticker_label(F.col("series_id"), F.col("name")).alias("label"))


@query
def business_days(spark, sf_dir):
    c = dense(spark, sf_dir).calendar
    return c.select("pos", stats.business_days(F.col("date"), F.lit(date(2001, 11, 20))).alias("n"))


# --- bars of events


@query
def daily_event_bars(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rounded(bars.daily_bars(events), 4)
