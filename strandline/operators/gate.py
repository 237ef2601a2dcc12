"""The gate between two vintages of a panel: all checks run, all failures are kept."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.config import DEFAULT, Config
from strandline.functions.stats import business_days, rounded
from strandline.sources.panel import INDEX, MARKET


def counted(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


def figures(old: DataFrame, new: DataFrame, indexes: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """One row of all that the checks count: one aggregation by series, one by date, and one over the new rows beside the old."""
    columns = ["series_id", "kind", "date", "r"]
    rows = old.select(*columns, F.lit(False).alias("new")).unionByName(new.select(*columns, F.lit(True).alias("new")))
    stock, index, wanted = F.col("kind") == "stock", F.col("kind") == "index", F.col("series_id").isin([f"{INDEX}{k}" for k in indexes])
    had, has = F.col("had"), F.col("has")
    by_series = rows.groupBy("series_id", "kind").agg(F.max(~F.col("new")).alias("had"), F.max("new").alias("has")).agg(
        counted(stock & had & ~has).alias("gone"), counted(stock & had).alias("was"), counted(stock & has).alias("stocks"),
        counted((F.col("series_id") == MARKET) & has).alias("market"), counted(index & wanted & has).alias("wanted"), counted(index & had & ~has).alias("dropped"),
    )
    names = [MARKET, *[f"{INDEX}{k}" for k in indexes]]
    covered = [F.max(F.col("new") & (F.col("series_id") == n) & F.col("r").isNotNull()).alias(f"c{i}") for i, n in enumerate(names)]
    days = rows.groupBy("date").agg(F.max(~F.col("new")).alias("had"), F.max("new").alias("has"), *covered)
    ends = days.agg(F.max(F.when(had, F.col("date"))).alias("old_end"), F.max(F.when(has, F.col("date"))).alias("new_end"))
    added = has & (F.col("date") > F.col("old_end"))
    by_day = days.crossJoin(ends).agg(*[counted(added & ~F.col(f"c{i}")).alias(f"gaps{i}") for i in range(len(names))])  # one row of ends
    before = old.where("r is not null").select("series_id", "date", F.col("r").alias("r_old"))
    beside = new.where("r is not null").select("series_id", "date", "r").join(before, ["series_id", "date"], "left").crossJoin(ends)
    changed = F.abs(F.col("r") - F.col("r_old")) > cfg.restate_tolerance
    by_row = beside.agg(
        counted((F.col("date") > F.col("old_end")) & (F.abs("r") > cfg.max_move)).alias("wild"), F.count("r_old").alias("both"), counted(changed).alias("restated"),
    )
    return by_series.crossJoin(ends).crossJoin(by_day).crossJoin(by_row)  # one row each


def checks(old: DataFrame, new: DataFrame, today: date, indexes: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """check_name, passed, n (what was counted). old, new: series_id, kind, date, r, a row per series and date."""
    late, c = business_days(F.col("new_end"), F.lit(today)), F.col
    absent = F.lit(len(set(indexes))) - c("wanted")
    found = {
        "end_not_earlier": (c("new_end") < c("old_end"), F.datediff("new_end", "old_end")), "fresh": (late > cfg.stale_days, late),
        "no_stock_missing": (c("gone") > 0, c("gone")), "stock_count": (c("stocks") < c("was"), c("stocks")), "benchmark_present": (c("market") == 0, c("market")),
        "indexes_present": (absent > 0, absent), "no_index_dropped": (c("dropped") > 0, c("dropped")),
    }
    found |= {f"covers_new_dates:{n}": (c(f"gaps{i}") > 0, c(f"gaps{i}")) for i, n in enumerate([MARKET, *[f"{INDEX}{k}" for k in indexes]])}
    found["no_wild_move"] = (c("wild") > 0, c("wild"))
    found["history_unchanged"] = ((c("both") == 0) | (c("restated") > c("both") * cfg.restate_share), c("restated"))
    each = [F.struct(F.lit(k).alias("check_name"), (~F.coalesce(failed, F.lit(True))).alias("passed"), n.cast("long").alias("n")) for k, (failed, n) in found.items()]
    return figures(old, new, indexes, cfg).select(F.inline(F.array(*each)))


def extremes(old: DataFrame, new: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """series_id, date, r of new returns beyond max_move."""
    end = old.agg(F.max("date").alias("old_end"))
    return new.crossJoin(end).where((F.col("date") > F.col("old_end")) & (F.abs("r") > cfg.max_move)).select("series_id", "date", "r")  # one end


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """series_id, date, r_old, r_new where both vintages have a return."""
    before = old.where("r is not null").select("series_id", "date", F.col("r").alias("r_old"))
    return new.where("r is not null").select("series_id", "date", F.col("r").alias("r_new")).join(before, ["series_id", "date"])


def restated(old: DataFrame, new: DataFrame, most: int = 10, cfg: Config = DEFAULT) -> DataFrame:
    """The largest changes of history beyond the tolerance."""
    change = rounded(F.abs(F.col("r_new") - F.col("r_old")), 10)
    rows = compared(old, new).withColumn("change", change).where(F.abs(F.col("r_new") - F.col("r_old")) > cfg.restate_tolerance)
    return rows.orderBy(F.desc("change"), "series_id", "date").limit(most)
