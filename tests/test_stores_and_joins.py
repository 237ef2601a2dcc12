"""Vintages, upserts from a stream, as-of and interval joins, sliding statistics, draws and monitors against plain loops."""

import math
import random
import statistics
import time
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.config import Config
from strandline.operators import asof, gate, intervals, montecarlo, rolling, sliding, stress
from strandline.sources import stored, vintages
from strandline.streaming import monitors, restatements

FIRST = date(2020, 1, 1)


def rows_of(days, ids=("a", "b", "market", "index:F"), shift=0.0, start=0):
    kinds = {"market": "benchmark", "index:F": "index"}
    return [(s, kinds.get(s, "stock"), FIRST + timedelta(i), round(0.001 * (i % 7) + shift, 6)) for s in ids for i in range(start, days)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "series_id string, kind string, date date, r double")


def as_set(df):
    return sorted(map(tuple, df.select(*vintages.ROWS).collect()), key=str)


# --- vintages


def test_vintages_are_read_by_name_and_from_the_end(spark, tmp_path):
    root = str(tmp_path / "store")
    assert vintages.names(spark, root) == [] and vintages.read(spark, root).count() == 0
    one, two = rows_of(70), rows_of(80, shift=0.0001)
    vintages.write(frame(spark, one), root, "2020-03-10")
    vintages.write(frame(spark, two), root, "2020-03-20")
    assert vintages.names(spark, root) == ["2020-03-10", "2020-03-20"]
    assert as_set(vintages.read(spark, root)) == sorted(two, key=str)
    assert as_set(vintages.read(spark, root, back=1)) == as_set(vintages.read(spark, root, "2020-03-10")) == sorted(one, key=str)
    assert vintages.read(spark, root, back=2).count() == 0
    assert as_set(vintages.read(spark, root, months=["2020-02"])) == sorted((r for r in two if r[2].month == 2), key=str)
    with pytest.raises(ValueError, match="there is a vintage"):
        vintages.write(frame(spark, one), root, "2020-03-10")
    with pytest.raises(ValueError, match="no vintage"):
        vintages.read(spark, root, "x")
    vintages.write(frame(spark, []), root, "2020-04-01")
    assert vintages.names(spark, root)[-1] == "2020-04-01" and vintages.read(spark, root).count() == 0


def test_a_torn_write_is_not_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    vintages.write(frame(spark, rows_of(40)), root, "1")

    class Stopped(Exception):
        pass

    real = vintages.manifests

    def stop(*args):
        raise Stopped

    # the data folder is there, the manifest is not
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    monkeypatch.setattr(Frame, "coalesce", stop)
    with pytest.raises(Stopped):
        vintages.write(frame(spark, rows_of(50)), root, "2")
    monkeypatch.undo()
    assert len(list((tmp_path / "store/data").iterdir())) == 2
    assert vintages.names(spark, root) == ["1"] and as_set(vintages.read(spark, root)) == sorted(rows_of(40), key=str)
    # a manifest that a writer has not committed yet
    (tmp_path / "store/manifest/3/_temporary/0").mkdir(parents=True)
    (tmp_path / "store/manifest/3/_temporary/0/part-0.json").write_text('{"name":"3","month":"2020-01","folder":"x","rows":1}')
    assert vintages.names(spark, root) == ["1"]
    vintages.write(frame(spark, rows_of(50)), root, "2")
    assert as_set(vintages.read(spark, root)) == sorted(rows_of(50), key=str) and real(spark, root).count() == 4


def test_a_vintage_shares_unchanged_months_and_lost_rows_are_told(spark, tmp_path):
    root = str(tmp_path / "store")
    vintages.write(frame(spark, rows_of(100)), root, "1")
    changed = [(s, k, d, r + 0.5) for s, k, d, r in rows_of(100) if d.month == 2]
    vintages.write(frame(spark, changed), root, "2", replacing="1")
    want = [(s, k, d, r + 0.5 * (d.month == 2)) for s, k, d, r in rows_of(100)]
    assert as_set(vintages.read(spark, root)) == sorted(want, key=str)
    listed = {(r.name, r.month): r.folder for r in vintages.manifests(spark, root).collect()}
    assert listed["1", "2020-01"] == listed["2", "2020-01"] and listed["1", "2020-02"] != listed["2", "2020-02"]
    assert vintages.verified(spark, root, "2").count() == 0
    folder = tmp_path / "store" / listed["2", "2020-03"]
    for f in folder.iterdir():
        f.unlink()
    assert [tuple(r) for r in vintages.verified(spark, root, "2").collect()] == [("2020-03", 4 * 31, 0)]


def test_upserts(spark):
    held = frame(spark, rows_of(5))
    changes = spark.createDataFrame([("a", "stock", FIRST, 0.1, 1), ("a", "stock", FIRST, 0.2, 3), ("a", "stock", FIRST, 0.3, 2), ("c", "stock", FIRST, None, 1)], "series_id string, kind string, date date, r double, seq int")
    last = vintages.last_of_each(changes, "seq")
    assert as_set(last) == [("a", "stock", FIRST, 0.2), ("c", "stock", FIRST, None)]
    want = [("a", "stock", FIRST, 0.2), ("c", "stock", FIRST, None), *[r for r in rows_of(5) if (r[0], r[2]) != ("a", FIRST)]]
    assert as_set(vintages.upserted(held, last)) == sorted(want, key=str)


def test_gated_upserts_from_a_stream(spark, tmp_path):
    """Good batches become vintages, a replay changes nothing, a bad batch is kept aside with its reasons."""
    root, source = str(tmp_path / "store"), tmp_path / "in"
    source.mkdir()
    days = 40
    today = lambda: FIRST + timedelta(41)
    take = restatements.gated_upsert(root, today, ["F"])
    batches = [
        [(*r, 0) for r in rows_of(days)],
        [("a", "stock", FIRST + timedelta(3), 0.0031, 5), ("a", "stock", FIRST + timedelta(3), 0.9, 4), *[(*r, 0) for r in rows_of(days + 1, start=days)]],
        [(s, k, d, 0.9, 0) for s, k, d, _ in rows_of(days + 2, start=days + 1)],  # a wild move
        [(*r, 9) for r in rows_of(days + 2, start=days + 1)],
    ]
    schema = "series_id string, kind string, date date, r double, seq int"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(source / f"{i}"))
        query = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source / "*")).writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    names = vintages.names(spark, root)
    assert len(names) == 3
    want = {(s, d): r for s, _, d, r in rows_of(days + 2)}
    want["a", FIRST + timedelta(3)] = 0.0031
    state = {(r.series_id, r.date): r.r for r in vintages.read(spark, root).collect()}
    assert state == want
    refused = list((tmp_path / "store/refused").iterdir())
    assert len(refused) == 1
    aside = spark.read.parquet(str(refused[0])).collect()
    assert len(aside) == 4 and all("no_wild_move" in r.failed for r in aside)
    # the stream replays batches: good and bad ones change nothing
    for i in (1, 2):
        take(spark.createDataFrame(batches[i], schema), i)
    assert vintages.names(spark, root) == names and len(list((tmp_path / "store/refused").iterdir())) == 1
    assert {(r.series_id, r.date): r.r for r in vintages.read(spark, root).collect()} == want
    assert vintages.verified(spark, root, names[-1]).count() == 0


def test_the_gate_over_stored_vintages(spark, tmp_path):
    root = str(tmp_path / "store")
    old, new = frame(spark, rows_of(40)), frame(spark, rows_of(44, ids=("a", "market", "index:F")))
    vintages.write(old, root, "1")
    vintages.write(new, root, "2")
    today = FIRST + timedelta(45)
    plain = {tuple(r) for r in gate.checks(old, new, today, ["F"]).collect()}
    assert {tuple(r) for r in gate.checks(vintages.read(spark, root, back=1), vintages.read(spark, root), today, ["F"]).collect()} == plain
    assert ("no_stock_missing", False, 1) in plain


def test_stored_tables_follow_their_sources(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(5).write.parquet(path)
    made = []
    make = lambda: made.append(1) or stored.stored(spark.read.parquet(path), "test")
    assert stored.once(spark, ("t",), (path,), make).count() == stored.once(spark, ("t",), (path,), make).count() == 5 and len(made) == 1
    spark.range(7).write.mode("overwrite").parquet(path)
    assert stored.once(spark, ("t",), (path,), make).count() == 7 and len(made) == 2
    plan = stored.once(spark, ("t",), (path,), make)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan.splitlines()) == 1


# --- as-of and intervals


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("size", [1, 5, 1000])
def test_as_of_by_search(spark, strict, size):
    rng = random.Random(size + strict)
    day = lambda n: FIRST + timedelta(n)
    left = [(k, day(rng.randrange(200)), i) for k in ("a", "b", None, "only left") for i in range(60)] + [("a", day(7), 99)] * 2
    right = [(k, day(rng.randrange(200)), round(rng.random(), 6), rng.choice(["x", None])) for k in ("a", "b", None, "only right") for _ in range(25)]
    right += [("a", day(50), 0.5, "p"), ("a", day(50), 0.7, "q"), ("a", day(50), 0.7, None)]
    a = spark.createDataFrame(left, "k string, at date, i int").repartition(3)
    b = spark.createDataFrame(right, "k string, at date, v double, w string").repartition(4)
    got = asof.as_of(a, b, "k", at="at", values=["v", "w"], since="since", strict=strict, size=size).collect()

    def find(k, at):
        held = [r for r in right if r[0] == k and (r[1] < at if strict else r[1] <= at)]
        if not held:
            return None, None, None
        newest = max(r[1] for r in held)
        v, _, w = max((r[2], r[3] is not None, r[3] or "") for r in held if r[1] == newest)
        return v, w or None, newest

    want = [(k, at, i, *find(k, at)) for k, at, i in left]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_as_of_without_keys_numbers_and_empty_sides(spark):
    a = spark.createDataFrame([(i * 10, "l") for i in range(50)], "at long, name string")
    b = spark.createDataFrame([(95, 1.0), (300, 2.0)], "at long, v double")
    got = {r.at: r.v for r in asof.as_of(a, b, at="at", values=["v"], size=7).collect()}
    assert got == {i * 10: None if i * 10 < 95 else 1.0 if i * 10 < 300 else 2.0 for i in range(50)}
    assert asof.as_of(a.where("false"), b, at="at", values=["v"]).count() == 0
    assert {r.v for r in asof.as_of(a, b.where("false"), at="at", values=["v"]).collect()} == {None}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_intervals_by_loops(spark, how):
    rng = random.Random(3)
    spans = [(i, FIRST + timedelta(s := rng.randrange(300)), FIRST + timedelta(s + rng.choice([-2, 0, 1, 31, 32, 150]))) for i in range(60)]
    days = [(i, FIRST + timedelta(rng.randrange(-50, 600))) for i in range(300)] + [(999, None)]
    rows = spark.createDataFrame(days, "n int, date date")
    table = spark.createDataFrame(spans, "key int, start date, end date")
    got = intervals.inside(rows, table, how=how)
    hits = {n: [s for s in spans if d is not None and s[1] <= d <= s[2]] for n, d in days}
    if how == "inner":
        want = [(n, d, *s) for n, d in days for s in hits[n]]
    elif how == "left":
        want = [(n, d, *s) for n, d in days for s in hits[n] or [(None, None, None)]]
    else:
        want = [(n, d) for n, d in days if bool(hits[n]) == (how == "left_semi")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_many_windows_without_a_nested_loop(spark):
    windows = spark.range(10_000).selectExpr("cast(id as string) as window_key", "date_add(date'2000-01-01', cast(id % 7000 as int)) as start", "date_add(date'2000-01-01', cast(id % 7000 + id % 40 as int)) as end")
    rows = spark.range(3000).selectExpr("date_add(date'2001-01-01', cast(id as int)) as date", "cast(id as int) as pos", "0.1D as r", "'a' as series_id")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in (threshold, "-1"):
        try:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            found = stress.in_windows(rows, windows)
            plan = found._jdf.queryExecution().executedPlan().toString() + stress.outside_windows(rows, windows)._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    inside = lambda d: sum(1 for i in range(10_000) if i % 7000 <= d <= i % 7000 + i % 40)
    assert found.where("pos = 500").count() == inside(366 + 500)


# --- sliding statistics


def test_sliding_windows_by_sorting():
    rng = random.Random(5)
    for days, n in ((1, 9), (4, 30), (250, 600), (7, 3)):
        values = np.array([math.nan if rng.random() < 0.15 else round(rng.gauss(0, 1), 1) for _ in range(n)])
        for first in {0, n // 3, n}:
            count, mean, deviation, low, mid = sliding.windows(values, days, [0.05, 0.5], first)
            for j, i in enumerate(range(first, n)):
                held = sorted(v for v in values[max(0, i - days) : i] if not math.isnan(v))
                assert count[j] == len(held)
                if held:
                    assert abs(mean[j] - statistics.fmean(held)) < 1e-12
                    assert low[j] == held[min(len(held) - 1, math.floor(0.05 * len(held)))] and mid[j] == held[min(len(held) - 1, math.floor(0.5 * len(held)))]
                else:
                    assert math.isnan(mean[j]) and math.isnan(low[j])
                assert math.isnan(deviation[j]) if len(held) < 2 else abs(deviation[j] - statistics.stdev(held)) < 1e-9


@pytest.mark.parametrize("block", [3, 64, 2048])
def test_blocks_of_windows(spark, block):
    rng = random.Random(block)
    series = {k: [None if rng.random() < 0.1 else round(rng.gauss(0, 0.01), 6) for _ in range(n)] for k, n in (("a", 300), ("b", 41), ("c", 1))}
    rows = [(k, 5 * i + i % 3, FIRST + timedelta(i), r) for k, v in series.items() for i, r in enumerate(v)]  # pos with gaps
    df = spark.createDataFrame(rows, "series_id string, pos int, date date, r double").repartition(4)
    got = {(r.series_id, r.pos): r for r in sliding.before_each(df, "series_id", days=20, shares=[0.05], block=block).collect()}
    assert len(got) == len(rows)
    for k, v in series.items():
        for i in range(len(v)):
            row, held = got[k, 5 * i + i % 3], sorted(x for x in v[max(0, i - 20) : i] if x is not None)
            assert row.place == i and row.n == len(held) and row.r == v[i]
            assert row.q0 == (held[math.floor(0.05 * len(held))] if held else None)
            assert row.deviation is None if len(held) < 2 else abs(row.deviation - statistics.stdev(held)) < 1e-12
    assert sliding.before_each(df.where("false"), "series_id", days=20, shares=[0.05]).count() == 0


def test_no_window_is_carried_by_a_row(spark):
    df = spark.range(600).selectExpr("cast(id as int) as pos", "date_add(date'2020-01-01', cast(id as int)) as date", "sin(id) / 100 as r")
    lines = rolling.var_lines(df, cfg=Config(var_window=50))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "sort_array" not in plan
    values = [math.sin(i) / 100 for i in range(600)]
    for r in lines.where("pos in (49, 50, 300)").collect():
        held = sorted(values[r.pos - 50 : r.pos]) if r.pos >= 50 else None
        assert r.hist_95 is None if held is None else r.hist_95 == -held[2]


# --- draws


def test_draws_are_spread_and_don_t_depend_on_tasks(spark):
    u = montecarlo.uniforms(7, np.arange(400), np.arange(2, 1000))
    assert abs(u.mean() - 0.5) < 2e-3 and abs(u.var() - 1 / 12) < 1e-3
    counts = np.histogram(u, 100, (0, 1))[0]
    assert ((counts - counts.mean()) ** 2 / counts.mean()).sum() < 160  # chi-squared of 99 degrees
    for a, b in ((u[:, :-1], u[:, 1:]), (u[:-1], u[1:]), (u[:, ::2], u[:, 1::2])):
        assert abs(np.corrcoef(a.ravel(), b.ravel())[0, 1]) < 0.01
    z = montecarlo.normals(7, np.arange(2000), 63)
    assert z.shape == (2000, 63) and abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01
    assert abs((z**3).mean()) < 0.03 and abs((z**4).mean() - 3) < 0.08
    assert len(np.unique(montecarlo.uniforms(1, np.array([0, 2**32, 2**33, 5]), np.array([1])))) == 4
    moments = spark.createDataFrame([(0.0004, 0.01)], "mu double, sigma double")
    values = {r.path: r.value for r in montecarlo.terminal_values(moments, 21, 500).collect()}
    again = {r.path: r.value for r in montecarlo.terminal_values(moments, 21, 500).repartition(3).collect()}
    assert values == again and len(values) == 500
    want = 10_000 * np.maximum(1 + 0.0004 + 0.01 * montecarlo.normals(7, np.arange(500), 21), 1e-6).prod(axis=1)
    assert max(abs(values[i] - want[i]) for i in range(500)) < 1e-8
    expected, spread = 10_000 * 1.0004**21, 10_000 * 0.01 * math.sqrt(21)
    assert abs(np.mean(list(values.values())) - expected) < 4 * spread / math.sqrt(500)
    assert "Exchange hash" not in montecarlo.terminal_values(moments, 21, 500)._jdf.queryExecution().executedPlan().toString()


# --- monitors


@pytest.fixture
def rocks(spark):
    monitors.state_store(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_basel_stream_equals_the_batch(spark, rocks, tmp_path):
    rng = random.Random(8)
    rows = [(m, i, FIRST + timedelta(i), int(rng.random() < p)) for m, p in (("hist", 0.2), ("param", 0.02)) for i in range(130)]
    schema = "method string, pos long, date date, exc int"
    cfg = Config(var_window=25)
    source = tmp_path / "in"
    cuts = [0, 10, 11, 60, 130]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = [r for r in rows if a <= r[1] < b or n == 2 and r[1] == 5]  # an old day comes again
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(source / str(n)))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
        query = monitors.basel_stream(stream, cfg=cfg).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select("method", "start", "end", "exceptions", "zone").collect()))
    want = rolling.basel_windows(spark.createDataFrame(rows, schema), "method", cfg=cfg).select("method", "start", "end", "exceptions", "zone")
    assert got == sorted(map(str, want.collect())) and len(got) == 2 * 106


def test_stale_days():
    friday = date(2024, 5, 3)
    assert monitors.stale_on(friday, 4, 45) == date(2024, 5, 10)  # the fifth weekday after it
    assert monitors.stale_on(friday, 400, 45) == friday + timedelta(46)


def test_silence_sounds_once(spark, rocks, tmp_path):
    """Old dates sound at once, and once; a series sounds again only after something newer; a fresh one is silent."""
    cfg, day_ms = Config(stale_days=4, max_lookback=45), monitors.DAY_MS
    schema = "series_id string, date date"
    source = tmp_path / "in"
    source.mkdir()
    put = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / str(n)))
    old, older, fresh = date.today() - timedelta(60), date.today() - timedelta(90), date.today()
    put(0, [("a", old), ("a", older), ("b", old), ("c", fresh), ("d", None)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    query = monitors.staleness(stream, cfg=cfg, day_ms=day_ms).writeStream.format("memory").queryName("alarms").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()

    def wait(n):
        for _ in range(120):
            if spark.table("alarms").count() >= n:
                break
            time.sleep(0.5)

    try:
        wait(2)
        put(1, [("a", old), ("b", old + timedelta(1)), ("c", old)])  # b has something newer, though stale itself
        wait(3)
        time.sleep(4)
        assert query.exception() is None
        got = sorted((r.series_id, r.newest) for r in spark.table("alarms").collect())
        assert got == [("a", old), ("b", old), ("b", old + timedelta(1))]
    finally:
        query.stop()
