"""Trading costs: re-pricing, cost levels, break-even and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.config import DEFAULT, Config
from strandline.functions.stats import cents, fixed, years_between
from strandline.operators import metrics, segments

PASSIVE = "buy_and_hold"


def repriced(r: Column, turnover: Column, base_bps: float, new_bps: Column) -> Column:
    """A net return at another cost: linear in the turnover; a null return stays null."""
    return r + F.coalesce(turnover, F.lit(0.0)) * (F.lit(base_bps) - new_bps) / 10_000


def levels(cfg: Config = DEFAULT) -> list[float]:
    return sorted({*cfg.cost_levels, cfg.cost_bps})


def at_levels(strategies: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """strategies at every cost level: strategy_id, bps, pos, date, r, turnover."""
    each = F.explode(F.array(*[F.lit(float(x)) for x in levels(cfg)])).alias("bps")
    rows = strategies.select("strategy_id", "pos", "date", "r", "turnover", each)
    return rows.withColumn("r", repriced(F.col("r"), F.col("turnover"), cfg.cost_bps, F.col("bps")))


def sensitivity(strategies: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """strategy_id, bps, total_return, edge over the passive strategy at that cost."""
    curve = metrics.equity_curve(at_levels(strategies, cfg), "strategy_id", "bps", capital=cfg.capital)
    total = metrics.curve_summary(curve, "strategy_id", "bps", capital=cfg.capital).select("strategy_id", "bps", "total_return")
    passive = total.where(F.col("strategy_id") == PASSIVE).select("bps", F.col("total_return").alias("passive"))
    return total.join(passive, "bps", "left").select("strategy_id", "bps", "total_return", (F.col("total_return") - F.col("passive")).alias("edge"))


def break_even(strategies: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """strategy_id, kind, bps: the cost at which each active strategy's edge over the passive one ends.

    A fixed number of halvings of (0, max_cost_bps), both sides re-priced; the
    arrays folded here are one series each, as long as the calendar.
    """
    row = F.struct("pos", F.col("r"), F.coalesce("turnover", F.lit(0.0)).alias("t"))
    series = strategies.groupBy("strategy_id").agg(F.array_sort(F.collect_list(row)).alias("days"))
    passive = series.where(F.col("strategy_id") == PASSIVE).select(F.col("days").alias("base"))
    both = series.where(F.col("strategy_id") != PASSIVE).crossJoin(passive)  # one passive row

    def total(days: Column, bps: Column) -> Column:
        """Total return at a cost; the first day is the capital itself."""
        after = F.slice(days, 2, F.size(days) - 1)
        growth = F.aggregate(after, F.lit(1.0), lambda a, x: a * (1 + F.coalesce(repriced(x["r"], x["t"], cfg.cost_bps, bps), F.lit(0.0))))
        return cents(cfg.capital * growth) / cfg.capital - 1

    def edge(bps: Column) -> Column:
        return total(F.col("days"), bps) - total(F.col("base"), bps)

    ends = both.withColumns({"at_zero": edge(F.lit(0.0)), "at_max": edge(F.lit(cfg.max_cost_bps)), "lo": F.lit(0.0), "hi": F.lit(cfg.max_cost_bps)})
    halves = F.aggregate(
        F.sequence(F.lit(1), F.lit(cfg.cost_halvings)),
        F.struct(F.lit(0.0).alias("lo"), F.lit(float(cfg.max_cost_bps)).alias("hi")),
        lambda s, _: F.when(
            edge((s["lo"] + s["hi"]) / 2) > 0, F.struct(((s["lo"] + s["hi"]) / 2).alias("lo"), s["hi"].alias("hi"))
        ).otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).alias("hi"))),
    )
    short = F.size("days") < 2
    kind = F.when(short, "unavailable").when(F.col("at_zero") <= 0, "loses_at_zero").when(F.col("at_max") > 0, "beyond_range").otherwise("solved")
    solved = ends.withColumn("kind", kind).withColumn("s", F.when(F.col("kind") == "solved", halves))
    return solved.select("strategy_id", "kind", ((F.col("s.lo") + F.col("s.hi")) / 2).alias("bps"))


def break_even_label(kind: Column, bps: Column, cfg: Config = DEFAULT) -> Column:
    """What a break-even says, and its tone after a colon."""
    beyond = f"Still ahead at {cfg.max_cost_bps:g} bps:positive"
    return (
        F.when(kind == "solved", F.concat(fixed(bps, 1), F.lit(" bps:neutral")))
        .when(kind == "loses_at_zero", "Underperforms Buy & Hold even with zero costs:negative")
        .when(kind == "beyond_range", beyond)
        .otherwise("n/a:unknown")
    )


def best_active(verdicts: DataFrame, order: list[str]) -> DataFrame:
    """strategy_id, total_return, edge (over the passive strategy; null without it) of the best active strategy, the first of equals."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("strategy_id"))
    best = verdicts.where((F.col("strategy_id") != PASSIVE) & F.col("total_return").isNotNull()).agg(F.max_by(F.struct("strategy_id", "total_return"), F.struct("total_return", -place)).alias("x"))
    base = verdicts.where(F.col("strategy_id") == PASSIVE).agg(F.max("total_return").alias("base"))
    return best.crossJoin(base).where("x is not null").select("x.strategy_id", "x.total_return", (F.col("x.total_return") - F.col("base")).alias("edge"))  # one row each


def linearity(base: DataFrame, again: DataFrame, base_bps: float, new_bps: float) -> DataFrame:
    """strategy_id, max_error of re-pricing against a real re-run at another cost, n_turnover_changes."""
    b = again.select("strategy_id", "pos", F.col("r").alias("r2"), F.col("turnover").alias("t2"))
    both = base.join(b, ["strategy_id", "pos"])
    error = F.abs(repriced(F.col("r"), F.col("turnover"), base_bps, F.lit(new_bps)) - F.col("r2"))
    changed = ~F.col("turnover").eqNullSafe(F.col("t2"))
    return both.groupBy("strategy_id").agg(F.max(error).alias("max_error"), F.sum(changed.cast("int")).alias("n_turnover_changes"))


def comparison(strategies: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """strategy_id, cagr, volatility, sharpe, max_drawdown, total_return, annual_turnover, from one summary of each strategy's blocks."""
    parts = segments.summaries(strategies, "strategy_id", also=("turnover",))
    whole = segments.merged(parts, "strategy_id", also=("turnover",)).where("rows > 1").withColumn("growth", cents(cfg.capital * F.col("curve")) / cfg.capital)
    years = years_between(F.col("first"), F.col("last"))
    traded = F.when((years > 0) & (F.col("strategy_id") != PASSIVE), F.col("turnover") / years)
    risk = segments.metrics_of(whole.withColumn("annual_turnover", traded), "strategy_id", "annual_turnover", growth="growth")
    return risk.select("strategy_id", "cagr", "volatility", "sharpe", "max_drawdown", "total_return", "annual_turnover")


def verdict(strategies: DataFrame, order: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """strategy_id, total_return, diff_pts, beats, tone (of all together), is_best (the first of equals)."""
    total = metrics.curve_summary(metrics.equity_curve(strategies, "strategy_id", capital=cfg.capital), "strategy_id", capital=cfg.capital)
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("strategy_id"))
    passive = total.where(F.col("strategy_id") == PASSIVE).select(F.col("total_return").alias("base"))
    rows = total.crossJoin(passive).withColumn("diff_pts", (F.col("total_return") - F.col("base")) * 100)  # one passive row
    active = rows.where(F.col("strategy_id") != PASSIVE)
    tally = active.agg(F.count("*").alias("n"), F.sum((F.col("diff_pts") > 0).cast("int")).alias("won"))
    best = total.agg(F.max_by("strategy_id", F.struct("total_return", -place)).alias("best"))
    tone = F.when(F.col("won") == 0, "negative").when(F.col("won") == F.col("n"), "positive").otherwise("neutral")
    return rows.crossJoin(tally).crossJoin(best).select(
        "strategy_id", "total_return", "diff_pts", (F.col("diff_pts") > 0).alias("beats"), tone.alias("tone"), (F.col("strategy_id") == F.col("best")).alias("is_best")
    )


def winners(verdicts: DataFrame) -> DataFrame:
    """place, strategy_id, diff_pts of the active strategies that beat the passive one, the largest edge first."""
    won = verdicts.where((F.col("strategy_id") != PASSIVE) & F.col("beats"))
    place = F.row_number().over(Window.orderBy(F.desc("diff_pts"), "strategy_id"))  # a row per strategy
    return won.select(place.alias("place"), "strategy_id", "diff_pts")


def low_volatility_verdict(rows: DataFrame, low: str = "low_volatility") -> DataFrame:
    """One row from comparison rows: volatility and Sharpe ratio of the low-volatility and the passive strategy, calmer, better; none if one is absent."""
    of = lambda name, end: rows.where(F.col("strategy_id") == name).select(F.col("volatility").alias(f"volatility_{end}"), F.col("sharpe").alias(f"sharpe_{end}"))
    both = of(low, "low").crossJoin(of(PASSIVE, "passive"))  # one row each
    return both.withColumns({"calmer": F.col("volatility_low") < F.col("volatility_passive"), "better": F.col("sharpe_low") > F.col("sharpe_passive")})
