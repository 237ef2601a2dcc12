"""Summaries of stretches of a series that can be merged, and two-level scans over them.

A series (keys, pos, date, r) is cut into blocks of `size` positions. What a block
says of itself is enough to merge it with its neighbours, in order:

- exact sums: rows, n, total, squares, ups and, over days that the market has
  too, both, own, others, other_squares, cross. Returns are taken at 10 decimals
  (panels have 6, blends 10), so a constant series has the variance 0 whatever the
  order of addition;
- growth, the product of 1 + r; peak and trough, the highest and lowest wealth on
  the way from 1, both counting that 1; fall, the deepest fall below an earlier
  peak. Two stretches a, b make one of growth g_a g_b, peak max(p_a, g_a p_b), trough
  min(t_a, g_a t_b) and fall min(f_a, f_b, g_a t_b / p_a - 1);
- later_growth, the growth without the first row, as an equity curve's first row is
  the capital.

Rows are read by (keys, block), so a long series is many tasks, and what one task
sees of a whole series is one row per block. A wealth of 0 (r = -1) ends a stretch
early: what comes after it is a block of its own, so no ratio divides by 0. Null
returns count as rows and leave wealth as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.config import DEFAULT
from strandline.functions.stats import cagr, cents, years_between

#: Positions of a block: about the square root of the rows that a series may have.
SIZE = 256

#: Sums over a stretch; the second line only with a market.
SUMS = ("rows", "n", "total", "squares", "ups")
MARKET_SUMS = ("both", "own", "others", "other_squares", "cross")
PARTS = ("block", "life")


def exact(r: str | Column) -> Column:
    return (F.col(r) if isinstance(r, str) else r).cast("decimal(14,10)")


def square(a: Column, b: Column) -> Column:
    return (a * b).cast("decimal(27,20)")


def sums(market: bool) -> dict[str, Column]:
    """What each row adds to the sums."""
    r, m = exact("r"), exact("m") if market else None
    each = {
        "rows": F.lit(1).cast("long"), "n": F.col("r").isNotNull().cast("long"), "total": r, "squares": square(r, r), "ups": (F.col("r") > 0).cast("long"),
    }
    if market:
        shared = F.col("r").isNotNull() & F.col("m").isNotNull()
        when = lambda c: F.when(shared, c)
        each |= {"both": shared.cast("long"), "own": when(r), "others": when(m), "other_squares": when(square(m, m)), "cross": when(square(r, m))}
    return {k: F.coalesce(v, F.lit(0).cast("decimal(27,20)" if k in ("squares", "other_squares", "cross") else "decimal(14,10)" if k in ("total", "own", "others") else "long")) for k, v in each.items()}


def in_blocks(returns: DataFrame, *by: str, size: int = SIZE) -> DataFrame:
    """block, life and, within these, wealth (so far, from 1) and at (the row's number)."""
    inside = Window.partitionBy(*by, "block").orderBy("pos")
    lost = F.sum((F.col("r") <= -1).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = returns.withColumn("block", F.floor(F.col("pos") / size).cast("int")).withColumn("life", F.coalesce(lost, F.lit(0)).cast("int"))
    so_far = Window.partitionBy(*by, *PARTS).orderBy("pos")
    return rows.withColumns({"wealth": F.coalesce(F.product(1 + F.col("r")).over(so_far), F.lit(1.0)), "at": F.row_number().over(so_far)})


def summaries(returns: DataFrame, *by: str, market: bool = False, size: int = SIZE, also: tuple[str, ...] = ()) -> DataFrame:
    """keys, block, life and the summary of each stretch; market: rows have the market's return m beside r; also: columns to add up."""
    rows = in_blocks(returns, *by, size=size)
    so_far = Window.partitionBy(*by, *PARTS).orderBy("pos")
    rows = rows.withColumn("top", F.greatest(F.lit(1.0), F.max("wealth").over(so_far)))
    added = [F.sum(c).alias(k) for k, c in sums(market).items()] + [F.sum(c).alias(c) for c in also]
    later = F.coalesce(F.product(F.when(F.col("at") > 1, 1 + F.col("r"))), F.lit(1.0))
    return rows.groupBy(*by, *PARTS).agg(
        F.min("pos").alias("first_pos"), F.min("date").alias("first"), F.max("date").alias("last"), *added,
        F.max_by("wealth", "pos").alias("growth"), later.alias("later_growth"), F.greatest(F.lit(1.0), F.max("wealth")).alias("peak"),
        F.least(F.lit(1.0), F.min("wealth")).alias("trough"), F.least(F.lit(0.0), F.min(F.col("wealth") / F.col("top") - 1)).alias("fall"),
    )


def carried(parts: DataFrame, *by: str) -> DataFrame:
    """Summaries with what earlier stretches hand on: before (growth), top_before (peak), curve_before (growth but for the first row), opens (is the first)."""
    earlier = Window.partitionBy(*by).orderBy(*PARTS).rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(*by).orderBy(*PARTS)
    one = lambda c: F.coalesce(c, F.lit(1.0))
    rows = parts.withColumns({"opens": F.row_number().over(order) == 1, "before": one(F.product("growth").over(earlier))})
    step = F.when(F.col("opens"), F.col("later_growth")).otherwise(F.col("growth"))
    return rows.withColumns({"top_before": one(F.max(F.col("before") * F.col("peak")).over(earlier)), "curve_before": one(F.product(step).over(earlier))})


def merged(parts: DataFrame, *by: str, also: tuple[str, ...] = ()) -> DataFrame:
    """keys, first, last, sums, growth, curve (growth but for the first row) and fall of the whole series."""
    rows = carried(parts, *by)
    fall = F.least(F.col("fall"), F.col("before") * F.col("trough") / F.greatest(F.lit(1.0), F.col("top_before")) - 1)
    added = [F.sum(c).alias(c) for c in (*SUMS, *MARKET_SUMS, *also) if c in parts.columns]
    curve = F.product(F.when(F.col("opens"), F.col("later_growth")).otherwise(F.col("growth")))
    return rows.groupBy(*by).agg(F.min("first").alias("first"), F.max("last").alias("last"), *added, F.product("growth").alias("growth"), curve.alias("curve"), F.min(fall).alias("fall"))


def max_drawdown(returns: DataFrame, *by: str, size: int = SIZE) -> DataFrame:
    """keys, max_drawdown: the deepest fall from a peak that starts at 1; null without returns."""
    whole = merged(summaries(returns, *by, size=size), *by)
    return whole.select(*by, F.when(F.col("n") > 0, F.col("fall")).alias("max_drawdown"))


def equity_curve(returns: DataFrame, *by: str, capital: float = DEFAULT.capital, size: int = SIZE) -> DataFrame:
    """keys, pos, date, value: the first row is the capital, its own return ignored; a null return is a flat day."""
    rows = in_blocks(returns, *by, size=size)
    handed = carried(summaries(returns, *by, size=size), *by).select(*by, *PARTS, "opens", "curve_before")
    so_far = Window.partitionBy(*by, *PARTS).orderBy("pos")
    later = F.coalesce(F.product(F.when(F.col("at") > 1, 1 + F.col("r"))).over(so_far), F.lit(1.0))
    both = rows.withColumn("later", later).join(handed, [*by, *PARTS])
    growth = F.col("curve_before") * F.when(F.col("opens"), F.col("later")).otherwise(F.col("wealth"))
    return both.select(*by, "pos", "date", cents(capital * growth).alias("value"))


# --- every start date at once


def suffixes(returns: DataFrame, *by: str, market: bool = False, size: int = SIZE) -> DataFrame:
    """For each row, the summary of the series from it to its end: keys, pos, first (its date), last, sums, after (growth of the later rows), fall.

    One row answers for one start date; store the table and look it up.
    """
    each = sums(market)
    rows = in_blocks(returns, *by, size=size)
    inside = Window.partitionBy(*by, *PARTS).orderBy(F.desc("pos"))
    base = F.coalesce(F.lag("wealth").over(Window.partitionBy(*by, *PARTS).orderBy("pos")), F.lit(1.0))
    rows = rows.withColumns({"base": base, "low": F.min("wealth").over(inside), "high": F.max("wealth").over(inside), "end": F.first("wealth").over(inside)})
    # from each later row as a peak, and from the start itself; the last row of a lost life has nothing after it
    own_fall = F.least(F.lit(0.0), F.min(F.try_divide("low", "wealth") - 1).over(inside), F.col("low") / F.col("base") - 1)
    tail = F.when(F.col("wealth") > 0, F.col("end") / F.col("wealth")).otherwise(1.0)
    rows = rows.withColumns({**{k: F.sum(c).over(inside) for k, c in each.items()}, "own_fall": own_fall, "tail": tail, "end_of_top": F.col("end") / F.greatest("base", "high")})

    def joined(a: Column, b: Column) -> Column:
        """The stretch b after the stretch a."""
        fields = {
            "growth": a["growth"] * b["growth"], "peak": F.greatest(a["peak"], a["growth"] * b["peak"]), "trough": F.least(a["trough"], a["growth"] * b["trough"]),
            "fall": F.least(a["fall"], b["fall"], a["growth"] * b["trough"] / a["peak"] - 1),
        }
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    parts = summaries(returns, *by, market=market, size=size)
    later = Window.partitionBy(*by).orderBy(F.desc("block"), F.desc("life")).rowsBetween(Window.unboundedPreceding, -1)
    listed = F.sort_array(F.collect_list(F.struct(*PARTS, "growth", "peak", "trough", "fall")).over(later))  # a struct per later block
    nothing = F.struct(F.lit(1.0).alias("growth"), F.lit(1.0).alias("peak"), F.lit(1.0).alias("trough"), F.lit(0.0).alias("fall"))
    handed = parts.select(*by, *PARTS, *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_on") for c in each], F.max("last").over(Window.partitionBy(*by)).alias("last"), F.aggregate(listed, nothing, joined).alias("on"))
    both = rows.join(handed, [*by, *PARTS])
    fall = F.least(F.col("own_fall"), F.col("on.fall"), F.col("end_of_top") * F.col("on.trough") - 1)
    return both.select(
        *by, "pos", F.col("date").alias("first"), "last", *[(F.col(c) + F.col(f"{c}_on")).alias(c) for c in each], (F.col("tail") * F.col("on.growth")).alias("after"), fall.alias("fall"),
    )


def variance(n: str, total: str, squares: str) -> Column:
    """Of a sample, from exact sums: n squares - total^2 is 0 for equal values."""
    total_ = F.col(total).cast("decimal(18,10)")
    spread = F.col(n).cast("decimal(10,0)") * F.col(squares).cast("decimal(27,20)") - total_ * total_
    return F.when(F.col(n) > 1, spread.cast("double") / (F.col(n).cast("double") * (F.col(n) - 1)))


def metrics_of(summary: DataFrame, *keys: str, days: int = DEFAULT.trading_days, risk_free: float = DEFAULT.risk_free, growth: str = "after") -> DataFrame:
    """keys, n, volatility, sharpe, max_drawdown, total_return, cagr, up_rate and, with a market's sums, beta and alpha, from summaries."""
    mean = F.col("total").cast("double") / F.col("n")
    year = F.lit(float(days))
    rows = summary.withColumn("volatility", F.sqrt(variance("n", "total", "squares")) * F.sqrt(year))
    span = years_between(F.col("first"), F.col("last"))
    shown = [
        F.col("n"), F.col("volatility"), F.when(F.col("volatility") > 0, (mean * days - risk_free) / F.col("volatility")).alias("sharpe"),
        F.when(F.col("n") > 0, F.col("fall")).alias("max_drawdown"), (F.col(growth) - 1).alias("total_return"), cagr(F.lit(1.0), F.col(growth), span).alias("cagr"),
        F.try_divide("ups", "n").alias("up_rate"),
    ]
    if "both" in summary.columns:
        own, others = F.col("own").cast("decimal(18,10)"), F.col("others").cast("decimal(18,10)")
        count = F.col("both").cast("decimal(10,0)")
        spread = (count * F.col("other_squares").cast("decimal(27,20)") - others * others).cast("double")
        shared = (count * F.col("cross").cast("decimal(27,20)") - own * others).cast("double")
        rows = rows.withColumn("beta", F.when(F.col("both") > 1, F.try_divide(shared, F.nullif(spread, F.lit(0.0)))))
        alpha = own.cast("double") / F.col("both") * days - (risk_free + F.col("beta") * (others.cast("double") / F.col("both") * days - risk_free))
        shown += [F.col("beta"), F.when(F.col("both") > 0, alpha).alias("alpha")]
    return rows.select(*keys, *shown)


def from_dates(table: DataFrame, calendar: DataFrame, starts: DataFrame, *by: str) -> DataFrame:
    """start, keys and metrics of the series from each of the asked dates (start): the stored suffixes at the first day that is not earlier; none past the end."""
    days = calendar.select(F.col("pos").alias("at"), F.col("date").alias("day"))
    first = starts.select("start").distinct().join(days, F.col("day") >= F.col("start")).groupBy("start").agg(F.min("at").alias("pos"))
    return metrics_of(table.join(F.broadcast(first), "pos"), "start", *by)  # asked dates
