"""Rolling metrics and value-at-risk backtests over positional windows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.config import DEFAULT, Config
from strandline.functions import stats
from strandline.operators import sliding


def inclusive(days: int, *by: str):
    return Window.partitionBy(*by).orderBy("pos").rowsBetween(-(days - 1), 0)


def place(*by: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy("pos"))


def rolling_metrics(returns: DataFrame, market: DataFrame, *by: str, cfg: Config = DEFAULT) -> DataFrame:
    """volatility, sharpe and beta of the last rolling_days rows, today included; null before there are so many."""
    days, w = cfg.rolling_days, inclusive(cfg.rolling_days, *by)
    both = F.col("m").isNotNull() & F.col("r").isNotNull()
    vol = F.stddev_samp(F.col("r")).over(w) * F.sqrt(F.lit(float(cfg.trading_days)))
    level = F.avg(F.col("r")).over(w) * cfg.trading_days - cfg.risk_free
    beta = F.when(F.sum(both.cast("int")).over(w) > 1, F.regr_slope(F.when(both, F.col("r")), F.when(both, F.col("m"))).over(w))
    rows = returns.join(market.select("pos", "m"), "pos", "left").withColumns({"_i": place(*by), "_v": vol, "_l": level, "_b": beta})
    ready = F.col("_i") >= days
    return rows.select(
        *by, "pos", "date", F.when(ready, F.col("_v")).alias("volatility"), F.when(ready & (F.col("_v") > 0), F.col("_l") / F.col("_v")).alias("sharpe"),
        F.when(ready, F.col("_b")).alias("beta"),
    )


def var_lines(returns: DataFrame, *by: str, cfg: Config = DEFAULT) -> DataFrame:
    """keys, pos, date, r and, from the var_window rows before today: hist_95, hist_99, param_95, param_99.

    The windows run over the whole history; filter by date afterwards.
    """
    shares = [1 - confidence for confidence, _ in cfg.z_scores]
    rows = sliding.before_each(returns.select(*by, "pos", "date", "r"), *by, days=cfg.var_window, shares=shares)
    ready = F.col("place") >= cfg.var_window
    out = {}
    for i, (confidence, z) in enumerate(cfg.z_scores):
        name = round(confidence * 100)
        out[f"hist_{name}"] = F.when(ready, -F.col(f"q{i}"))
        out[f"param_{name}"] = F.when(ready, -(F.col("mean") + z * F.col("deviation")))
    return rows.withColumns(out).select(*by, "pos", "date", "r", *sorted(out))


def exceptions(lines: DataFrame, *by: str, cfg: Config = DEFAULT) -> DataFrame:
    """keys, method, confidence, pos, date, exc for the days that have a return and an estimate: exc if r < -VaR."""
    names = [(f"{m}_{round(c * 100)}", m, c) for m in ("hist", "param") for c, _ in cfg.z_scores]
    packed = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(c).alias("confidence"), F.col(n).alias("var")) for n, m, c in names]))
    rows = lines.select(*by, "pos", "date", "r", packed.alias("v")).select(*by, "pos", "date", "r", "v.*")
    return rows.where("r is not null and var is not null").withColumn("exc", (F.col("r") < -F.col("var")).cast("int"))


def coverage_tests(exc: DataFrame, *by: str, cfg: Config = DEFAULT) -> DataFrame:
    """Unconditional coverage, independence and conditional coverage of each method and confidence."""
    keys = [*by, "method", "confidence"]
    before = F.lag("exc").over(Window.partitionBy(*keys).orderBy("pos"))
    rows = exc.withColumn("was", before)
    moves = {f"n{a}{b}": F.sum(((F.col("was") == a) & (F.col("exc") == b)).cast("int")) for a in (0, 1) for b in (0, 1)}
    c = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("exc").alias("x"), *[F.coalesce(v, F.lit(0)).alias(k) for k, v in moves.items()])
    p = 1 - F.col("confidence")
    c = c.withColumns({"expected": F.col("n") * p, "rate": F.col("x") / F.col("n"), "lr_uc": stats.kupiec(F.col("n"), F.col("x"), p), "lr_ind": stats.christoffersen(*[F.col(k) for k in moves])})
    c = c.withColumn("lr_cc", F.col("lr_uc") + F.col("lr_ind"))
    one, two = cfg.chi2_critical
    return c.withColumns(
        {
            "p_uc": stats.chi2_tail(F.col("lr_uc"), 1), "p_ind": stats.chi2_tail(F.col("lr_ind"), 1), "p_cc": stats.chi2_tail(F.col("lr_cc"), 2),
            "reject_uc": F.col("lr_uc") > one, "reject_ind": F.col("lr_ind") > one, "reject_cc": F.col("lr_cc") > two,
        }
    )


def basel_windows(exc: DataFrame, *by: str, cfg: Config = DEFAULT) -> DataFrame:
    """keys, start, end, exceptions, zone for each run of var_window evaluable days (fewer days: one run of all)."""
    order = Window.partitionBy(*by).orderBy("pos")
    rows = exc.withColumns({"_i": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy(*by))})
    size = cfg.var_window
    trailing = order.rowsBetween(-(size - 1), 0)
    rows = rows.withColumns({"exceptions": F.sum("exc").over(trailing), "start": F.min("date").over(trailing)})
    kept = rows.where((F.col("_i") >= size) | ((F.col("_n") < size) & (F.col("_i") == F.col("_n"))))
    return kept.select(*by, "start", F.col("date").alias("end"), "exceptions", stats.basel_zone(F.col("exceptions"), cfg.basel_limits).alias("zone"))


def basel_summary(windows: DataFrame, *by: str) -> DataFrame:
    """The trailing window and the worst one (the earliest of equals)."""
    last = F.max_by(F.struct("start", "end", "exceptions", "zone"), "end").alias("last")
    worst = F.min_by(F.struct("start", "end", "exceptions", "zone"), F.struct(-F.col("exceptions"), F.col("end"))).alias("worst")
    both = windows.groupBy(*by).agg(last, worst)
    fields = [F.col(f"{w}.{f}").alias(f"{w}_{f}") for w in ("last", "worst") for f in ("start", "end", "exceptions", "zone")]
    return both.select(*by, *fields, (F.col("last.zone") != F.col("worst.zone")).alias("zones_differ"))


def var_chart(lines: DataFrame, name: str) -> DataFrame:
    """pos, date, r, lower (the loss line), exception_r (the return where it breaks the line) of one VaR column."""
    broken = F.col("r") < -F.col(name)
    return lines.select("pos", "date", "r", (-F.col(name)).alias("lower"), F.when(broken, F.col("r")).alias("exception_r"))


def rolling_chart(rows: DataFrame, value: str, ids: list[str], target: int = DEFAULT.rolling_points) -> DataFrame:
    """One row per date with a column for each id (names made plain), sampled to about `target` rows; the last always stays."""
    from strandline.operators.metrics import sampled

    plain = F.regexp_replace("series_id", "[^A-Za-z0-9]", "_")
    names = [re.sub("[^A-Za-z0-9]", "_", x) for x in ids]
    wide = rows.where(F.col("series_id").isin(*ids)).withColumn("c", plain).groupBy("pos", "date").pivot("c", names).agg(F.first(value, ignorenulls=True))
    return sampled(wide, target=target)
