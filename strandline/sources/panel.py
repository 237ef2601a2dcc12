"""Dense panels of prices and returns.

A panel has a row for every series on every date of a shared calendar; a null
return means that there is none that day. Returns are rounded to 6 decimals as
soon as they are made, so every engine ranks the same values.

`from_tables` derives panels from order lines: the mean discount of a day's
lines, centred, is the day's move of an asset. Lines are read once. Where parts
are too many to broadcast, lines are shuffled once to meet their part; what is
shuffled after that are each task's sums, one per asset, status and date at most.
These exact sums add up to those of assets, market and indexes. Only this grows
with the input; the calendar has a row per date and the panel one per date and
series, whatever the number of lines. Sums and panel are stored, so plans over a
panel begin with a scan of it.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.config import DEFAULT
from strandline.functions.stats import rounded
from strandline.sources.stored import once, stored

MARKET = "market"
INDEX = "index:"


@dataclass(frozen=True)
class Panel:
    calendar: DataFrame  # pos, date
    prices: DataFrame  # series_id, kind, pos, date, price
    returns: DataFrame  # series_id, kind, pos, date, r

    def stocks(self) -> DataFrame:
        return self.returns.where("kind = 'stock'").drop("kind")

    def market(self) -> DataFrame:
        return self.returns.where("kind = 'benchmark'").select("pos", "date", F.col("r").alias("m"))


def calendar_of(dates: DataFrame) -> DataFrame:
    """pos (from 0), date: one row per distinct date, so few that one task numbers them."""
    order = Window.orderBy("date")
    return dates.select("date").distinct().select((F.row_number().over(order) - 1).alias("pos"), "date")


def dense(calendar: DataFrame, series: DataFrame, observed: DataFrame) -> DataFrame:
    """Every series on every date; values of observed (series_id, date, ...) or null."""
    return calendar.crossJoin(series).join(observed, ["series_id", "date"], "left")  # dates x series is the panel itself


def clean(value: Column) -> Column:
    """null for NaN and infinities: one of them would spoil every product, mean and order it meets."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def simple_returns(prices: DataFrame) -> DataFrame:
    """r = price / price of the row before - 1; null if either is."""
    return with_returns(prices).drop("price")


def with_returns(prices: DataFrame) -> DataFrame:
    before = F.lag("price").over(Window.partitionBy("series_id").orderBy("pos"))
    return prices.withColumn("r", rounded(clean(F.try_divide("price", before) - 1), 6) + F.lit(0.0))


def enough_history(prices: DataFrame, share: float = DEFAULT.min_history) -> DataFrame:
    """series_id, n of the series that have prices on at least that share of all dates; 0 keeps all."""
    days = prices.agg(F.countDistinct("pos").alias("days"))
    counted = prices.groupBy("series_id").agg(F.count("price").alias("n"))
    return counted.crossJoin(days).where((F.lit(share) == 0) | (F.col("n") >= F.floor(F.col("days") * share))).select("series_id", "n")


def daily_sums(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """asset (null without a part), status, date, total (exact), n: the one aggregation over all lines."""
    total = F.sum(F.col("l_discount").cast("decimal(4,2)"))
    by = [F.col("series_id").alias("asset"), F.col("l_linestatus").alias("status"), F.to_date("l_shipdate").alias("date")]
    return lines.join(parts, "l_partkey", "left").groupBy(*by).agg(total.alias("total"), F.count("*").alias("n"))


def daily_moves(sums: DataFrame, series: Column, kind: str) -> DataFrame:
    """series_id, kind, date, m: sums of sums, one division after."""
    by_day = sums.groupBy(series.alias("series_id"), "date").agg(F.sum("total").cast("double").alias("total"), F.sum("n").alias("n"))
    return by_day.select("series_id", F.lit(kind).alias("kind"), "date", ((F.col("total") / F.col("n") - F.lit(0.05)) * F.lit(0.4)).alias("m"))


def from_tables(spark: SparkSession, sf_dir: str, gapped: bool = False, first: date | None = None, last: date | None = None) -> Panel:
    """gapped False: brands, carried forward over days without a line. True: types, null on such days.

    With first and last the panel covers that fixed range only and has a calendar of its own.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_discount", "l_linestatus", "l_shipdate")
    day = F.to_date("l_shipdate")
    for bound, inside in ((first, lambda d: day >= F.lit(d)), (last, lambda d: day <= F.lit(d))):
        lines = lines.where(inside(bound)) if bound else lines
    asset = "p_type" if gapped else "p_brand"
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.col(asset).alias("series_id"))
    sums = stored(daily_sums(lines, parts), "daily-sums")
    moves = daily_moves(sums.where("asset is not null"), F.col("asset"), "stock")
    moves = moves.unionByName(daily_moves(sums, F.lit(MARKET), "benchmark")).unionByName(daily_moves(sums, F.concat(F.lit(INDEX), F.col("status")), "index"))
    observed = stored(moves, "moves")
    calendar = stored(calendar_of(observed).coalesce(1), "calendar")
    every = dense(calendar, observed.select("series_id", "kind").distinct(), observed.select("series_id", "date", "m"))
    so_far = Window.partitionBy("series_id").orderBy("pos")
    level = F.when(F.count("m").over(so_far) > 0, 100 * F.product(1 + F.col("m")).over(so_far))
    carried = F.lit(not gapped) & (F.col("kind") == "stock")
    prices = every.withColumn("price", level).select("series_id", "kind", "pos", "date", F.when(carried | F.col("m").isNotNull(), F.col("price")).alias("price"))
    held = stored(with_returns(prices), "panel")
    return Panel(calendar, held.drop("r"), held.drop("price"))


def panel(spark: SparkSession, sf_dir: str, gapped: bool = False, first: date | None = None, last: date | None = None) -> Panel:
    """The panel of a folder, made once for a session and anew when its files change."""
    sources = (f"{sf_dir}/lineitem.parquet", f"{sf_dir}/part.parquet")
    return once(spark, ("panel", gapped, first, last), sources, lambda: from_tables(spark, sf_dir, gapped, first, last))


def named(ids: DataFrame, names: DataFrame) -> DataFrame:
    """series_id, name of distinct ids: what names (series_id, name) has, or else the id."""
    return ids.select("series_id").distinct().join(names, "series_id", "left").select("series_id", F.coalesce("name", "series_id").alias("name"))


def matching(names: DataFrame, text: str) -> DataFrame:
    """Rows of names (series_id, name) whose id or name holds the text, whatever its case; all for a blank text."""
    wanted = F.lower(F.trim(F.lit(text)))
    return names.where(F.lower("series_id").contains(wanted) | F.lower("name").contains(wanted))


def default_selection(ids: DataFrame, preset: tuple[str, ...], fallback: int = 5) -> DataFrame:
    """series_id: the preset's ids that exist, if there are two or more; else the first few of all."""
    every = ids.select("series_id").distinct()
    held = every.where(F.col("series_id").isin(*preset))
    enough = held.agg((F.count("*") >= 2).alias("enough"))
    first = every.orderBy("series_id").limit(fallback)
    return held.crossJoin(enough).where("enough").unionByName(first.crossJoin(enough).where("not enough")).select("series_id")  # one row


def is_preset(selected: DataFrame, preset: tuple[str, ...]) -> DataFrame:
    """active: whether the selected ids are exactly the preset's, in any order."""
    held = F.collect_set("series_id")
    return selected.agg(((F.count("*") == len(preset)) & (F.size(F.array_intersect(held, F.array(*map(F.lit, preset)))) == len(set(preset)))).alias("active"))


def benchmark_options(returns: DataFrame, labels: dict[str, str]) -> DataFrame:
    """place, value, label, keys of a picker: none, each index in the order of labels and, if there are several, all together."""
    order = F.array(*map(F.lit, labels))
    at = F.array_position(order, F.col("series_id")).cast("int")
    named_ = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    have = returns.where("kind = 'index'").select("series_id").distinct().where(at > 0).select(at.alias("at"), "series_id", named_[F.col("series_id")].alias("label"))
    held = have.agg(F.array_sort(F.collect_list(F.struct("at", "series_id", "label"))).alias("x"))  # a few indexes
    option = lambda value, label, keys: F.struct(value.alias("value"), label.alias("label"), keys.alias("keys"))
    none = option(F.lit("none"), F.lit("None"), F.array().cast("array<string>"))
    each = F.transform("x", lambda i: option(i["series_id"], i["label"], F.array(i["series_id"])))
    all_ = option(F.lit("all"), F.when(F.size("x") == 2, "Both").otherwise("All"), F.transform("x", lambda i: i["series_id"]))
    options = F.concat(F.array(none), each, F.when(F.size("x") > 1, F.array(all_)).otherwise(F.slice(F.array(all_), 1, 0)))
    return held.select(F.posexplode(options).alias("place", "o")).select("place", "o.value", "o.label", "o.keys")
