"""Stateful monitors of streams: a sliding count of VaR exceptions, and an alarm when a series falls silent.

Both keep a small state per key and need a state store that can: set
`spark.sql.streaming.stateStore.providerClass` to Spark's RocksDB provider
(`state_store` does it).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from strandline.config import DEFAULT, Config
from strandline.functions import stats

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Ring(StatefulProcessor):
    """The last `size` days of a key: their dates, their exceptions as 0 and 1, and the last pos that was taken."""

    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ring", "last long, count int, dates array<date>, exceptions array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, count, dates, exceptions = self.state.get() if self.state.exists() else (-1, 0, [], [])
        dates, exceptions = list(dates), list(exceptions)
        fresh = pd.concat(list(rows)).sort_values("pos", kind="stable")
        out = []
        for pos, day, exc in zip(fresh["pos"].tolist(), fresh["date"].tolist(), fresh["exc"].tolist(), strict=True):
            if pos <= last:
                continue
            last = pos
            dates.append(day)
            exceptions.append(exc)
            count += exc
            if len(dates) > self.size:
                count -= exceptions.pop(0)
                dates.pop(0)
            if len(dates) == self.size:
                out.append((key[0], pos, dates[0], day, count))
        self.state.update((last, count, dates, exceptions))
        yield pd.DataFrame(out, columns=["key", "pos", "start", "end", "exceptions"])

    def close(self) -> None:
        pass


def basel_stream(exceptions: DataFrame, key: str = "method", cfg: Config = DEFAULT) -> DataFrame:
    """key, pos, start, end, exceptions, zone of each run of var_window days, as days come in.

    exceptions: key, pos, date, exc, each key's days in order of pos from batch to
    batch; days that came before are passed over, so a batch may come twice. A day
    changes the count by what enters and what leaves.
    """
    kind = dict(exceptions.dtypes)[key]
    rows = exceptions.select(F.col(key).alias("key"), F.col("pos").cast("long"), "date", F.col("exc").cast("int"))
    made = rows.groupBy("key").transformWithStateInPandas(
        Ring(cfg.var_window), f"key {kind}, pos long, start date, end date, exceptions int", outputMode="Append", timeMode="None"
    )
    return made.select(F.col("key").alias(key), "pos", "start", "end", "exceptions", stats.basel_zone(F.col("exceptions"), cfg.basel_limits).alias("zone"))


def stale_on(last: date, budget: int, cap: int) -> date:
    """The first day on which `last` is stale: more than `budget` weekdays after it, or more than `cap` days."""
    day, weekdays = last, 0
    while weekdays <= budget and (day - last).days <= cap:
        day += timedelta(1)
        weekdays += day.weekday() < 5
    return day


class Silence(StatefulProcessor):
    """The newest date of a key, with a timer for the day it gets stale; a newer date sets the timer anew, the alarm sounds once."""

    def __init__(self, budget: int, cap: int, day_ms: int) -> None:
        self.budget, self.cap, self.day_ms = budget, cap, day_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("newest", "date date, alarm long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(x for part in rows for x in part["date"])
        before = self.state.get() if self.state.exists() else None
        if before is None or newest > before[0]:
            if before is not None and before[1] > 0:
                self.handle.deleteTimer(before[1])
            # a date that is stale already sounds at once: timers must lie ahead
            alarm = max(self.moment(newest), timerValues.getCurrentProcessingTimeInMs() + 1)
            self.handle.registerTimer(alarm)
            self.state.update((newest, alarm))
        yield pd.DataFrame({"key": [], "newest": [], "stale_since": []}, dtype=object)

    def moment(self, newest: date) -> int:
        """Milliseconds of the clock; a day of it may be set shorter."""
        return (stale_on(newest, self.budget, self.cap) - date(1970, 1, 1)).days * self.day_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, _ = self.state.get()
        self.state.update((newest, 0))
        yield pd.DataFrame([(key[0], newest, stale_on(newest, self.budget, self.cap))], columns=["key", "newest", "stale_since"])

    def close(self) -> None:
        pass


def staleness(rows: DataFrame, key: str = "series_id", cfg: Config = DEFAULT, day_ms: int = DAY_MS) -> DataFrame:
    """key, newest, stale_since: one alarm for each key whose newest date gets stale by the clock, and again only after a newer one.

    rows: key, date. Stale is what is more than stale_days weekdays old, or older
    than max_lookback days, in UTC. day_ms is the length of a day on the clock.
    """
    kind = dict(rows.dtypes)[key]
    held = rows.where(F.col("date").isNotNull()).select(F.col(key).alias("key"), "date")
    made = held.groupBy("key").transformWithStateInPandas(
        Silence(cfg.stale_days, cfg.max_lookback, day_ms), f"key {kind}, newest date, stale_since date", outputMode="Append", timeMode="ProcessingTime"
    )
    return made.withColumnRenamed("key", key)

