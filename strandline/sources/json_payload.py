"""Panels as one JSON document: positional arrays over a shared list of dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.config import DEFAULT, Config

SCHEMA = "meta STRUCT<dates: ARRAY<STRING>>, series MAP<STRING, STRUCT<kind: STRING, returns: ARRAY<DOUBLE>>>"


def in_order(value: str):
    """The values of a series as an array by position, nulls kept."""
    return F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(value)))), lambda x: x[value])


def payload(returns: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row, one column `value`: the JSON document of a panel (dates x series, whatever its source's size)."""
    dates = calendar.select("pos", F.date_format("date", "yyyy-MM-dd").alias("date")).agg(in_order("date").alias("dates"))
    arrays = returns.groupBy("series_id", "kind").agg(in_order("r").alias("returns"))
    series = arrays.agg(F.map_from_entries(F.collect_list(F.struct("series_id", F.struct("kind", "returns")))).alias("series"))
    whole = dates.crossJoin(series).select(F.struct(F.struct("dates").alias("meta"), "series").alias("x"))  # one row each
    return whole.select(F.to_json("x", {"ignoreNullFields": "false"}).alias("value"))


def parsed(documents: DataFrame) -> DataFrame:
    """series_id, kind, pos, date, r of documents (column value); lengths that differ from the dates' raise an error."""
    doc = documents.select(F.from_json("value", SCHEMA).alias("x")).select(F.col("x.meta.dates").alias("dates"), F.explode("x.series").alias("series_id", "s"))
    length = F.when(F.size("s.returns") != F.size("dates"), F.raise_error(F.concat(F.lit("length of "), "series_id"))).otherwise(F.lit(True))
    rows = doc.where(length).select("series_id", F.col("s.kind").alias("kind"), "dates", F.posexplode("s.returns").alias("pos", "r"))
    return rows.select("series_id", "kind", "pos", F.to_date(F.get("dates", F.col("pos"))).alias("date"), "r")


def read(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path, wholetext=True))


def write(returns: DataFrame, calendar: DataFrame, path: str) -> None:
    payload(returns, calendar).write.mode("overwrite").text(path)


def by_date(returns: DataFrame) -> DataFrame:
    """series_id, date, r without the days that have none."""
    return returns.where("r is not null").select("series_id", "date", "r")


RESULTS = (
    "meta STRUCT<dates: ARRAY<STRING>, initial_capital: DOUBLE, cost_bps: DOUBLE, top_n: INT, strategy_order: ARRAY<STRING>>, "
    "strategies MAP<STRING, STRUCT<id: STRING, daily_returns: ARRAY<DOUBLE>, daily_turnover: ARRAY<DOUBLE>>>"
)


def results(strategies: DataFrame, calendar: DataFrame, order: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """One row, one column `value`: strategies (strategy_id, pos, r, turnover) over the calendar, with their parameters."""
    dates = calendar.select("pos", F.date_format("date", "yyyy-MM-dd").alias("date")).agg(in_order("date").alias("dates"))
    arrays = strategies.groupBy("strategy_id").agg(in_order("r").alias("daily_returns"), in_order("turnover").alias("daily_turnover"))
    held = arrays.agg(F.map_from_entries(F.collect_list(F.struct("strategy_id", F.struct(F.col("strategy_id").alias("id"), "daily_returns", "daily_turnover")))).alias("strategies"))
    meta = F.struct("dates", F.lit(cfg.capital).alias("initial_capital"), F.lit(cfg.cost_bps).alias("cost_bps"), F.lit(cfg.top_n).alias("top_n"), F.array(*map(F.lit, order)).alias("strategy_order"))
    whole = dates.crossJoin(held).select(F.struct(meta.alias("meta"), "strategies").alias("x"))  # one row each
    return whole.select(F.to_json("x", {"ignoreNullFields": "false"}).alias("value"))


def parsed_results(documents: DataFrame) -> DataFrame:
    """strategy_id, pos, date, r, turnover of results documents (column value); lengths that differ from the dates' raise an error."""
    doc = documents.select(F.from_json("value", RESULTS).alias("x")).select(F.col("x.meta.dates").alias("dates"), F.explode("x.strategies").alias("strategy_id", "s"))
    wrong = (F.size("s.daily_returns") != F.size("dates")) | (F.size("s.daily_turnover") != F.size("dates"))
    length = F.when(wrong, F.raise_error(F.concat(F.lit("length of "), "strategy_id"))).otherwise(F.lit(True))
    rows = doc.where(length).select("strategy_id", F.posexplode(F.arrays_zip("dates", "s.daily_returns", "s.daily_turnover")).alias("pos", "z"))
    return rows.select("strategy_id", "pos", F.to_date("z.dates").alias("date"), F.col("z.daily_returns").alias("r"), F.col("z.daily_turnover").alias("turnover"))


def parameters(cfg: Config = DEFAULT) -> dict[str, dict]:
    """The documents of parameters: risk, validation."""
    risk = {"trading_days_per_year": cfg.trading_days, "risk_free_rate_annual": cfg.risk_free, "var_confidence": cfg.var_confidence}
    zones = [{"zone": z, "max_exceptions": n} for z, n in zip(("green", "yellow"), cfg.basel_limits, strict=True)] + [{"zone": "red", "max_exceptions": None}]
    validation = {
        "var_window_days": cfg.var_window, "confidence_levels": [c for c, _ in cfg.z_scores], "z_scores": {str(c): z for c, z in cfg.z_scores},
        "chi2_critical_95": dict(zip(("df1", "df2"), cfg.chi2_critical, strict=True)), "basel_zones": zones,
    }
    windows = [{"key": w.key, "label": w.label, "start": str(w.start), "end": str(w.end), "lookback_start": str(w.lookback_start)} for w in cfg.windows]
    return {"risk": {"meta": risk}, "validation": {"meta": validation, "stress": {"windows": windows, "min_coverage_fraction": cfg.min_coverage}}}


def windows_of(documents: DataFrame) -> DataFrame:
    """window_key, label, start, end, lookback_start of validation documents (column value)."""
    schema = "stress STRUCT<windows: ARRAY<STRUCT<key: STRING, label: STRING, start: STRING, end: STRING, lookback_start: STRING>>>"
    rows = documents.select(F.from_json("value", schema).alias("x")).select(F.inline("x.stress.windows"))
    return rows.select(F.col("key").alias("window_key"), "label", *[F.to_date(c).alias(c) for c in ("start", "end", "lookback_start")])


def missing_keys(documents: DataFrame, keys: list[str]) -> DataFrame:
    """key: the top-level keys that a document (column value) lacks."""
    return documents.select(F.explode(F.array_except(F.array(*map(F.lit, keys)), F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")))).alias("key"))
