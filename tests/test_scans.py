"""Segments, selection and Gram sums against plain loops and against the one-window forms."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import gram, metrics, segments, selection

FIRST = date(2020, 1, 1)


def series(n, seed, gaps=0.1, lost=()):
    rng = random.Random(seed)
    return [None if rng.random() < gaps else -1.0 if i in lost else round(rng.gauss(0.0005, 0.02), 6) for i in range(n)]


SERIES = {
    "plain": series(300, 1), "dense": series(300, 2, 0), "short": series(1, 3, 0), "none": [None] * 40, "flat": [0.001] * 300, "falls": [-0.01] * 90,
    "lost": series(120, 4, 0.1, (17, 64)), "lost_first": [-1.0, 0.1, -0.2, 0.3], "late": [None] * 50 + series(100, 5), "rises": [0.01] * 70,
}


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(k, i, FIRST + timedelta(i), r, None if i % 11 == 3 else round(math.sin(i) / 50, 6)) for k, v in SERIES.items() for i, r in enumerate(v)]
    return spark.createDataFrame(rows, "series_id string, pos int, date date, r double, m double").repartition(5).cache()


def fall_of(returns):
    wealth, peak, fall = 1.0, 1.0, 0.0
    for r in returns:
        if r is not None:
            wealth *= 1 + r
            peak = max(peak, wealth)
            fall = min(fall, wealth / peak - 1)
    return fall if any(r is not None for r in returns) else None


@pytest.mark.parametrize("size", [1, 7, 250])
def test_blocks_of_any_size(panel, size):
    got = {r[0]: r[1] for r in segments.max_drawdown(panel, "series_id", size=size).collect()}
    for k, v in SERIES.items():
        want = fall_of(v)
        assert got[k] is None if want is None else abs(got[k] - want) < 1e-12, k
    plain = {(r[0], r[1]): r[3] for r in metrics.equity_curve(panel.drop("m"), "series_id").collect()}
    cut = {(r[0], r[1]): r[3] for r in segments.equity_curve(panel.drop("m"), "series_id", size=size).collect()}
    assert plain == cut
    one = {r[0]: r[1] for r in metrics.max_drawdown(panel, "series_id").collect()}
    assert {k for k, v in one.items() if v is None} == {k for k, v in got.items() if v is None}


@pytest.mark.parametrize("size", [1, 9, 250])
def test_every_start_date_by_plain_loops(panel, size):
    table = segments.suffixes(panel, "series_id", market=True, size=size)
    got = {(r.series_id, r.pos): r for r in segments.metrics_of(table, "series_id", "pos").collect()}
    market = [None if i % 11 == 3 else round(math.sin(i) / 50, 6) for i in range(400)]
    for k, v in SERIES.items():
        for i in range(0, len(v), 1 if len(v) < 130 else 17):
            row, held = got[k, i], [r for r in v[i:] if r is not None]
            assert row.n == len(held), (k, i)
            fall = fall_of(v[i:])
            assert row.max_drawdown is None if fall is None else abs(row.max_drawdown - fall) < 1e-12, (k, i)
            after = math.prod(1 + r for r in v[i + 1 :] if r is not None)
            assert abs(row.total_return - (after - 1)) < 1e-12, (k, i)
            if len(held) < 2:
                assert row.volatility is None
                continue
            vol = np.std(held, ddof=1) * math.sqrt(252)
            if len(set(held)) == 1:
                assert row.volatility == 0 and row.sharpe is None
            else:
                assert abs(row.volatility - vol) < 1e-9 and abs(row.sharpe - (np.mean(held) * 252 - 0.0275) / vol) < 1e-9 * (1 + abs(row.sharpe))
            both = [(r, m) for r, m in zip(v[i:], market[i:], strict=False) if r is not None and m is not None]
            x, y = (np.array(c) for c in zip(*both, strict=True)) if both else (np.array([]), np.array([]))
            if len(both) > 1 and len(set(y)) > 1:
                beta = ((x - x.mean()) * (y - y.mean())).sum() / ((y - y.mean()) ** 2).sum()
                assert abs(row.beta - beta) < 1e-7 * (1 + abs(beta)), (k, i)


def test_dates_that_are_asked(spark, panel):
    table = segments.suffixes(panel.where("series_id in ('plain', 'dense')"), "series_id")
    calendar = panel.where("series_id = 'dense' and pos % 3 <> 1").select("pos", "date").distinct()  # a calendar with gaps
    asked = [FIRST - timedelta(9), FIRST + timedelta(1), FIRST + timedelta(1), FIRST + timedelta(298), FIRST + timedelta(900)]
    got = segments.from_dates(table, calendar, spark.createDataFrame([(x,) for x in asked], "start date"), "series_id").collect()
    assert sorted((r.start, r.series_id) for r in got) == sorted((x, k) for x in {*asked[:4]} for k in ("plain", "dense"))
    assert {r.n for r in got if r.series_id == "dense"} == {300, 298, 1}  # days 1 and 298 are not in the calendar


def test_windows_of_one_task_hold_blocks_only(panel):
    plan = segments.max_drawdown(panel, size=16)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line and "[pos" in line:
            assert "block" in line, line


# --- selection


def tail_of(values, confidence=0.95):
    x = sorted(v for v in values if v is not None)
    k = min(len(x) - 1, math.floor((1 - confidence) * len(x)))
    return (len(x), -x[k], -sum(x[: k + 1]) / (k + 1)) if x else None


def odd_values():
    rng = random.Random(9)
    return {
        "normal": [rng.gauss(0, 1) for _ in range(3000)], "ties": [round(rng.gauss(0, 1)) / 1.0 for _ in range(2000)], "one": [0.25], "equal": [1.5] * 500,
        "uneven": [10.0**-i for i in range(300)] + [-(10.0**-i) for i in range(300)], "far": [1e300, -1e300, 1e-300, 5.0] * 9, "none": [None, None], "gaps": [None, 3.0, None, -2.0],
    }


@pytest.mark.parametrize(("bins", "passes"), [(1024, 2), (3, 0), (2, 1), (16, 4)])
@pytest.mark.parametrize("parts", [1, 6])
def test_selection_by_sorting(spark, bins, passes, parts):
    rows = spark.createDataFrame([(k, v) for k, vs in odd_values().items() for v in vs], "k string, r double").repartition(parts)
    got = {r.k: r for r in selection.tail(rows, "k", bins=bins, passes=passes).collect()}
    assert "none" not in got
    for k, vs in odd_values().items():
        if k != "none":
            n, var, es = tail_of(vs)
            assert got[k].n == n and got[k].var == var and math.isclose(got[k].es, es, rel_tol=1e-12, abs_tol=1e-12), k


def test_selection_of_every_rank_and_without_keys(spark):
    values = [3.0, 1.0, 1.0, 2.0, 1.0, 7.0, 2.0]
    rows = spark.createDataFrame([(v,) for v in values], "r double")
    for rank in range(7):
        found = selection.selected(rows, rank=F.lit(rank), bins=2, passes=1).collect()
        assert [(r.value, r.n, r.sum_below) for r in found] == [(sorted(values)[rank], 7, sum(sorted(values)[:rank]))]
    assert selection.selected(rows, rank=F.lit(7)).count() == 0
    assert selection.tail(rows.where("false")).count() == 0
    assert selection.tail(rows.where("false").withColumn("k", F.lit(1)), "k").count() == 0


@pytest.mark.parametrize("by", [("k",), ()])
def test_selection_leaves_rows_in_their_tasks(spark, by):
    rows = spark.createDataFrame([(i % 2, float(i)) for i in range(50)], "k int, r double")
    plan = selection.tail(rows, *by)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin" if by else "BroadcastNestedLoopJoin") >= selection.PASSES + 1
    assert not any(x in plan for x in ("SortMergeJoin", "ShuffledHashJoin", "CartesianProduct"))


def test_selection_equals_the_risk_table(panel):
    market = panel.select("pos", "m").distinct()
    want = {r.series_id: (r.n, r["var"], r.es) for r in metrics.risk_table(panel.drop("m"), market, "series_id").collect() if r.n}
    got = {r.series_id: (r.n, r["var"], r.es) for r in selection.tail(panel, "series_id").collect()}
    assert got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-15 for k in want)


# --- Gram sums


@pytest.mark.parametrize("way", ["vectors", "join"])
@pytest.mark.parametrize("parts", [1, 7])
def test_gram_sums_by_numpy(panel, way, parts, monkeypatch):
    if way == "join":
        monkeypatch.setattr(gram, "MOST", 2)
    rows = panel.repartition(parts).withColumn("g", F.col("pos") % 2)
    corr = {(r.g, r.a, r.b): (r.corr, r.n) for r in gram.correlations(rows, "g").collect()}
    cov = {(r.g, r.a, r.b): (r.cov, r.n) for r in gram.covariances(rows.where("series_id in ('plain', 'dense', 'flat')"), "g").collect()}
    three = ("plain", "dense", "flat")
    for g in (0, 1):
        for a in SERIES:
            for b in SERIES:
                days = [i for i in range(g, min(len(SERIES[a]), len(SERIES[b])), 2)]
                x, y = (np.array([SERIES[k][i] for i in days if SERIES[a][i] is not None and SERIES[b][i] is not None], dtype=float) for k in (a, b))
                if a != b and days:
                    found, n = corr[g, a, b]
                    assert n == len(x), (a, b)
                    if n > 1 and x.std() > 1e-12 and y.std() > 1e-12:
                        assert abs(found - np.corrcoef(x, y)[0, 1]) < 1e-9, (a, b)
                    else:
                        assert found is None, (a, b, found)
                else:
                    assert (g, a, b) not in corr
        days = [i for i in range(g, 300, 2) if all(SERIES[k][i] is not None for k in three)]
        for a in three:
            for b in three:
                x, y = (np.array([SERIES[k][i] for i in days]) for k in (a, b))
                found, n = cov[g, a, b]
                assert n == len(days) and abs(found - np.cov(x, y)[0, 1]) < 1e-12


def test_gram_shuffles_vectors_once(panel):
    plan = gram.covariances(panel)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1
    assert gram.covariances(panel.where("false")).count() == 0
