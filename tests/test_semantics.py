"""Small panels with results worked out by hand."""

import math
from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from strandline.config import DEFAULT
from strandline.functions import stats
from strandline.functions import portfolio
from strandline.operators import costs, findings, gate, metrics, montecarlo, optimize, rolling, strategies, stress
from strandline.plans import queries
from strandline.sources import json_payload
from strandline.sources import panel as panels
from strandline.sources.panel import calendar_of, enough_history, simple_returns
from strandline.streaming import bars

DAY = date(2020, 1, 1)


def frame(spark, columns):
    """series -> list of returns, as rows."""
    rows = [(s, "stock", i, DAY + timedelta(i), v) for s, values in columns.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, kind string, pos int, date date, r double")


def one(df, *columns):
    row = df.select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_gaps_are_not_bridged(spark):
    prices = frame(spark, {"a": [1.0, None, 1.1, 1.21]}).withColumnRenamed("r", "price")
    assert [x.r for x in simple_returns(prices).orderBy("pos").collect()] == [None, None, None, 0.1]


def test_enough_history(spark):
    prices = frame(spark, {"a": [1.0] * 10, "b": [1.0] * 5 + [None] * 5}).withColumnRenamed("r", "price")
    assert [x.series_id for x in enough_history(prices, 0.95).collect()] == ["a"]
    assert enough_history(prices, 0).count() == 2


def test_var_index_and_shortfall(spark):
    r = frame(spark, {"a": [x / 100 for x in range(-10, 10)]})
    got = r.groupBy("series_id").agg(metrics.sorted_returns().alias("x"))
    assert one(got, metrics.value_at_risk(F.col("x"), 0.95)) == pytest.approx(0.09)
    assert one(got, metrics.expected_shortfall(F.col("x"), 0.95)) == pytest.approx(0.095)


def test_drawdown_starts_at_one(spark):
    got = metrics.max_drawdown(frame(spark, {"a": [-0.1, 0.05], "b": [0.1, None], "c": [None, None]}), "series_id")
    assert {x.series_id: x.max_drawdown and round(x.max_drawdown, 9) for x in got.collect()} == {"a": -0.1, "b": 0.0, "c": None}


def test_equity_ignores_its_first_return(spark):
    got = metrics.equity_curve(frame(spark, {"a": [0.5, 0.1, None]}), "series_id").orderBy("pos").collect()
    assert [x.value for x in got] == [10000.0, 11000.0, 11000.0]


def test_blends(spark):
    r = frame(spark, {"a": [0.02, None, None], "b": [None, 0.04, None]})
    assert [x.r for x in metrics.blend(r).orderBy("pos").collect()] == [0.02, 0.04, None]
    w = spark.createDataFrame([("a", 0.0), ("b", 1.0)], "series_id string, w double")
    assert [x.r for x in metrics.weighted_blend(r, w).orderBy("pos").collect()] == [None, 0.04, None]


def test_pairwise_and_listwise(spark):
    r = frame(spark, {"a": [0.1, 0.2, 0.3, None], "b": [0.1, 0.3, None, 0.2], "c": [0.2, 0.1, 0.4, 0.3]})
    assert {x.n for x in metrics.pair_correlations(r).collect()} == {2, 3}
    assert {x.n for x in metrics.covariance(r).collect()} == {2}


def test_constant_series(spark):
    r = frame(spark, {"a": [0.01] * 5, "b": [0.01, 0.02, 0.0, 0.03, 0.01]})
    assert one(metrics.pair_correlations(r), "corr") is None
    shape = metrics.shape("series_id", returns=r).where("series_id = 'a'")
    assert one(shape, "skewness", "excess_kurtosis") == (0.0, 0.0)
    market = r.where("series_id = 'a'").select("pos", "date", F.col("r").alias("m"))
    assert one(metrics.beta_alpha(r.where("series_id = 'b'"), market, "series_id"), "beta") is None
    assert one(r.where("series_id = 'a'").groupBy("series_id").agg(metrics.sharpe().alias("s")), "s") is None


GOLDEN = [(1005, 44, 0.05, 0.3558), (1005, 7, 0.01, 0.3064), (1005, 43, 0.05, 0.2825), (1005, 12, 0.01, 0.5486),
          (1005, 47, 0.05, 0.6346), (1005, 21, 0.01, 0.0025), (1005, 58, 0.05, 0.2731), (1005, 19, 0.01, 0.0115)]


def test_kupiec_golden(spark):
    rows = spark.createDataFrame(GOLDEN, "n int, x int, p double, wanted double")
    got = rows.withColumn("p_value", stats.chi2_tail(stats.kupiec(F.col("n"), F.col("x"), F.col("p")), 1)).collect()
    assert all(abs(x.p_value - x.wanted) < 1e-4 for x in got)


def test_chi2(spark):
    rows = spark.createDataFrame([(3.841, 0.05), (6.635, 0.01)], "x double, p double")
    assert all(abs(r[0] - r[1]) < 1e-4 for r in rows.select(stats.chi2_tail(F.col("x"), 1), "p").collect())
    assert one(spark.range(1), stats.chi2_tail(F.lit(5.991), 2)) == pytest.approx(0.05, abs=1e-4)
    assert one(spark.range(1), stats.erfc(F.lit(0.7))) == pytest.approx(math.erfc(0.7), abs=2e-7)


def test_no_exceptions(spark):
    zero = [F.lit(x) for x in (10, 0, 0, 0)]
    assert one(spark.range(1), stats.christoffersen(*zero)) == 0.0
    assert one(spark.range(1), stats.kupiec(F.lit(10), F.lit(0), F.lit(0.05))) > 0


def test_business_days(spark):
    at = lambda a, b: one(spark.range(1), stats.business_days(F.lit(a), F.lit(b)))
    assert at(date(2024, 1, 5), date(2024, 1, 8)) == 1
    assert at(date(2024, 1, 8), date(2024, 1, 5)) == 0


SMALL = replace(DEFAULT, var_window=10)


def noise(n, seed=1):
    return [round(math.sin(seed * 12.9898 + i * 78.233) * 0.01, 6) for i in range(n)]


@pytest.mark.parametrize(("at", "changes"), [(20, False), (19, True), (10, True), (9, False)])
def test_var_uses_only_the_window_before(spark, at, changes):
    values = noise(30)
    moved = list(values)
    moved[at] = -0.5
    line = lambda v: one(rolling.var_lines(frame(spark, {"a": v}), cfg=SMALL).where("pos = 20"), "param_95")
    assert (line(values) != line(moved)) is changes


def test_basel_tie_and_short_sample(spark):
    rows = [("hist", 0.99, i, DAY + timedelta(i), -0.1, 0.05, int(i in (2, 15))) for i in range(25)]
    exc = spark.createDataFrame(rows, "method string, confidence double, pos int, date date, r double, var double, exc int")
    got = rolling.basel_summary(rolling.basel_windows(exc, "method", cfg=SMALL), "method").first()
    assert got.worst_exceptions == 1 and got.worst_end == DAY + timedelta(9)
    short = rolling.basel_windows(exc.where("pos < 5"), "method", cfg=SMALL).collect()
    assert len(short) == 1 and short[0].exceptions == 1


def test_daily_rank_turnover_and_skipped_day(spark):
    r = frame(spark, {"a": [None, 0.3, None, 0.3, 0.1], "b": [None, 0.2, 0.1, 0.2, 0.1], "c": [None, 0.1, None, 0.25, 0.1]})
    cfg = replace(DEFAULT, top_n=2, cost_bps=100.0)
    got = strategies.daily_rank(r, calendar_of(r), True, cfg).orderBy("pos").collect()
    # day 1 picks a and b; day 2 has one return only and is skipped; day 3 picks a and c: half the basket goes
    assert [x.turnover for x in got] == [None, None, 1.0, None, 1.0]
    assert got[2].r == pytest.approx(0.1 - 0.01) and got[4].r == pytest.approx(0.1 - 0.01)


def test_monthly_cost_on_first_day_with_data(spark):
    r = frame(spark, {"a": [0.01] * 40, "b": [0.01] * 40})
    first = (date(2020, 2, 1) - DAY).days
    r = r.withColumn("r", F.when(F.col("pos") != first, F.col("r")))
    baskets = spark.createDataFrame([(date(2020, 2, 1), first, x) for x in "ab"], "month date, first_pos int, series_id string")
    got = strategies.monthly_hold(baskets, r, calendar_of(r), replace(DEFAULT, top_n=2)).where(f"pos >= {first}").orderBy("pos").limit(3).collect()
    assert [x.turnover for x in got] == [None, 1.0, 0.0]


def strategy(spark, name, r, t):
    rows = [(name, i, DAY + timedelta(i), a, b) for i, (a, b) in enumerate(zip(r, t, strict=True))]
    return spark.createDataFrame(rows, "strategy_id string, pos int, date date, r double, turnover double")


def test_break_even_kinds(spark):
    flat = strategy(spark, costs.PASSIVE, [0.0, 0.0, 0.0], [0.0, 0.0, 0.0])
    cases = {"solved": ([0.0, 0.01, 0.01], [0.0, 1.0, 1.0]), "loses_at_zero": ([0.0, -0.01, 0.0], [0.0, 0.0, 0.0]), "beyond_range": ([0.0, 0.5, 0.5], [0.0, 1.0, 1.0])}
    rows = flat
    for name, (r, t) in cases.items():
        rows = rows.unionByName(strategy(spark, name, r, t))
    got = {x.strategy_id: x for x in costs.break_even(rows).collect()}
    assert {k: v.kind for k, v in got.items()} == {k: k for k in cases}
    assert got["solved"].bps == pytest.approx(110, abs=1.0) and got["beyond_range"].bps is None
    short = strategy(spark, costs.PASSIVE, [0.0], [0.0]).unionByName(strategy(spark, "x", [0.0], [0.0]))
    assert costs.break_even(short).first().kind == "unavailable"


def test_repricing_is_linear(spark, sf_dir):
    from strandline.plans.queries import n12_linearity

    assert n12_linearity(spark, sf_dir).first().linear


def test_two_assets(spark):
    r = frame(spark, {"a": noise(60, 1), "b": [2 * x for x in noise(60, 2)]})
    cov = {(x.a, x.b): x["cov"] for x in metrics.covariance(r).collect()}
    va, vb, c = cov["a", "a"], cov["b", "b"], cov["a", "b"]
    got = {x.series_id: x.w for x in optimize.portfolios(r, kinds=("min_variance",)).collect()}
    assert got["a"] == pytest.approx(min(1, max(0, (vb - c) / (va + vb - 2 * c))), abs=1e-6)
    best = optimize.portfolios(r, cfg=replace(DEFAULT, frontier_points=5, frontier_steps=50))
    top = best.where("kind = 'max_sharpe'").first().sharpe
    assert top >= best.where("kind = 'frontier'").agg(F.max("sharpe")).first()[0] - 1e-9


def test_too_few_days_have_no_frontier(spark):
    assert optimize.portfolios(frame(spark, {"a": noise(10), "b": noise(10, 2)})).count() == 0


def test_lookback_excludes_the_window(spark):
    w = stress.windows_table(spark)
    first = DEFAULT.windows[0].start
    rows = spark.createDataFrame([("a", first - timedelta(1), 1), ("a", first, 2)], "series_id string, date date, v int")
    assert [x.v for x in stress.before_windows(rows, w.where("window_key = 'w1998'")).collect()] == [1]
    assert [x.v for x in stress.in_windows(rows, w).where("window_key = 'w1998'").collect()] == [2]


def test_histogram(spark):
    values = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 10)], "value double")
    got = montecarlo.histogram(values, 5).orderBy("bin").collect()
    assert [x.n for x in got] == [2, 1, 0, 0, 1]
    assert montecarlo.histogram(values.where("value = 1"), 5).count() == 1


def test_sampling_keeps_the_last(spark):
    r = frame(spark, {"a": [0.0] * 10})
    assert [x.pos for x in metrics.sampled(r, "series_id", target=4).orderBy("pos").collect()] == [0, 3, 6, 9]


def test_json_round_trip(spark, tmp_path):
    r = frame(spark, {"a": [None, 0.1], "b": [0.2, None]})
    json_payload.write(r, calendar_of(r), str(tmp_path / "x"))
    back = json_payload.read(spark, str(tmp_path / "x"))
    assert {tuple(x) for x in back.select("series_id", "pos", "date", "r").collect()} == {tuple(x) for x in r.select("series_id", "pos", "date", "r").collect()}


def test_json_length_mismatch(spark):
    bad = spark.createDataFrame([('{"meta":{"dates":["2020-01-01"]},"series":{"a":{"kind":"stock","returns":[1.0,2.0]}}}',)], "value string")
    with pytest.raises(Exception, match="length of a"):
        json_payload.parsed(bad).collect()


def vintages(spark):
    n = 30
    cols = {"a": noise(n, 1), "b": noise(n, 2)}
    rows = frame(spark, cols)
    for name, kind in (("market", "benchmark"), ("index:F", "index"), ("index:O", "index")):
        rows = rows.unionByName(frame(spark, {name: noise(n, 5)}).withColumn("kind", F.lit(kind)))
    return rows.where("pos < 25"), rows, DAY + timedelta(n)


FAULTS = {
    "end_not_earlier": lambda o, n: (o, n.where("pos < 20")),
    "no_stock_missing": lambda o, n: (o, n.where("series_id <> 'a'").unionByName(n.where("series_id = 'a'").withColumn("series_id", F.lit("z")))),
    "indexes_present": lambda o, n: (o.where("series_id <> 'index:F'"), n.where("series_id <> 'index:F'")),
    "covers_new_dates:market": lambda o, n: (o, n.withColumn("r", F.when(~((F.col("series_id") == "market") & (F.col("pos") == 27)), F.col("r")))),
    "no_wild_move": lambda o, n: (o, n.withColumn("r", F.when((F.col("series_id") == "a") & (F.col("pos") == 28), 0.9).otherwise(F.col("r")))),
    "history_unchanged": lambda o, n: (o, n.withColumn("r", F.when(F.col("pos") < 5, F.col("r") + 0.01).otherwise(F.col("r")))),
}


def failed(old, new, today):
    return {x.check_name for x in gate.checks(old, new, today, ["F", "O"]).where("not passed").collect()}


def test_gate_passes_a_clean_vintage(spark):
    assert failed(*vintages(spark)) == set()


@pytest.mark.parametrize("name", sorted(FAULTS))
def test_gate_names_the_fault(spark, name):
    old, new, today = vintages(spark)
    found = failed(*FAULTS[name](old, new), today)
    assert name in found
    assert found <= {name, "fresh", "covers_new_dates:index:F"}


def test_stale_vintage(spark):
    old, new, today = vintages(spark)
    assert failed(old, new, today + timedelta(10)) == {"fresh"}


def test_streamed_bars(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = bars.gated_append(bars.daily_bars(stream, "0 seconds"), lambda b: True, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    closed = spark.read.parquet(str(tmp_path / "out"))
    whole = bars.daily_bars(events)
    assert 0 < closed.count() <= whole.count()
    assert closed.select("event_type", "day", "n").exceptAll(whole.select("event_type", "day", "n")).count() == 0


def test_whole_jobs(spark, sf_dir):
    import numpy as np

    def mixed(x):
        for _ in range(2):
            x = ((x >> 16 ^ x) * 0x45D9F3B) % 2**32
        return x >> 16 ^ x

    def draws(path, days):
        """Two days from each pair of words of the path's counter, in plain whole numbers."""
        one = mixed(path % 2**32 ^ mixed(7))
        two = mixed(one ^ path >> 32 ^ 0x5BD1E995)
        number = lambda k: (mixed(mixed((one + k) % 2**32) ^ two) + 0.5) / 2**32
        out = []
        for j in range(1, (days + 1) // 2 + 1):
            r, a = math.sqrt(-2 * math.log(number(2 * j))), 2 * math.pi * number(2 * j + 1)
            out += [r * math.cos(a), r * math.sin(a)]
        return out[:days]

    mu, sigma = one(queries.market_blend(spark, sf_dir).agg(F.avg("r").alias("mu"), F.stddev_samp("r").alias("sigma")), "mu", "sigma")
    z = np.array([draws(p, 63) for p in range(DEFAULT.paths)])
    values = DEFAULT.capital * np.maximum(1 + mu + sigma * z, 1e-6).prod(axis=1)
    found = queries.QUERIES["n9_monte_carlo_full"](spark, sf_dir).first()
    want = [*np.percentile(values, [5, 50, 95]), np.mean(values < DEFAULT.capital), np.mean(values)]
    assert [found[c] for c in ("p5", "p50", "p95", "prob_loss", "mean")] == pytest.approx(want, abs=1e-3)
    bins = queries.QUERIES["a25_histogram_full"](spark, sf_dir).orderBy("bin").collect()
    assert [x.n for x in bins] == np.histogram(values, DEFAULT.bins)[0].tolist()
    more = "/root/testdata/sf0.01"  # the smallest tables have no complete days
    points = {x.point: x for x in queries.QUERIES["n7_cloud_full"](spark, more).collect()}
    assert sorted(points) == list(range(DEFAULT.cloud_points))
    assert all(points[x.point] == x for x in queries.QUERIES["n7_cloud"](spark, more).collect())
    prices = queries.QUERIES["s1_prices_full"](spark, sf_dir)
    calendar = queries.dense(spark, sf_dir).calendar
    assert one(prices, F.min("date"), F.max("date"), F.count_distinct("date")) == one(calendar, F.min("date"), F.max("date"), F.count("*"))


def test_clean_returns(spark):
    prices = frame(spark, {"a": [1.0, float("nan"), float("inf"), 1.0, 1.1]}).withColumnRenamed("r", "price")
    assert [x.r for x in simple_returns(prices).orderBy("pos").collect()] == [None, None, None, -1.0, 0.1]


def test_half_steps_of_a_weighted_blend(spark):
    for rows in ([("a", -0.0036), ("b", -0.0039), ("c", -0.00375)], [("c", -0.00375), ("b", -0.0039), ("a", -0.0036)]):
        r = spark.createDataFrame([(i, "stock", 0, DAY, v) for i, v in rows], "series_id string, kind string, pos int, date date, r double")
        w = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.7)], "series_id string, w double")
        assert one(metrics.weighted_blend(r, w), "r") == pytest.approx(-0.00375, abs=1e-12)


def plain_frontier(mu, cov, rf, days, points, steps, golden):
    """The solver once more, with plain lists: sweep from the least variance, then a golden section over the whole range."""
    n = len(mu)

    def project(v):
        u, total, theta = sorted(v, reverse=True), 0.0, 0.0
        for i, x in enumerate(u):
            total += x
            if x + (1 - total) / (i + 1) > 0:
                theta = (total - 1) / (i + 1)
        return [max(x - theta, 0.0) for x in v]

    dot = lambda w: [sum(cov[i][j] * w[j] for j in range(n)) for i in range(n)]
    trace = sum(cov[i][i] for i in range(n)) or 1e-12

    def utility(lam, w):
        step = 0.5 / max(lam * trace, 1e-9)
        for _ in range(steps):
            g = dot(w)
            w = project([w[i] + step * (mu[i] - lam * g[i]) for i in range(n)])
        return w

    def value(w):
        vol = math.sqrt(max(0.0, sum(a * b for a, b in zip(w, dot(w), strict=True))) * days)
        back = sum(a * b for a, b in zip(w, mu, strict=True)) * days
        return vol, (back - rf) / vol if vol > 0 else 0.0

    low = [1 / n] * n
    for _ in range(steps):
        g = dot(low)
        low = project([low[i] - 0.5 / trace * g[i] for i in range(n)])
    natural = ((max(mu) - min(mu)) or 1e-9) / (sum(cov[i][i] for i in range(n)) / n or 1e-9)
    grid = [math.exp(math.log(1e-4) + math.log(1e8) * i / (points - 1)) * natural for i in range(points)]
    swept, w = [], low
    for lam in reversed(grid):
        w = utility(lam, w)
        swept.append(w)
    swept.sort(key=lambda x: value(x)[0])
    best = max([low, *swept], key=lambda x: value(x)[1])
    lo, hi, gr = math.log(grid[0] / 10), math.log(grid[-1] * 10), (math.sqrt(5) - 1) / 2
    at = lambda x: utility(math.exp(x), low)
    c, d = hi - gr * (hi - lo), lo + gr * (hi - lo)
    fc, fd = at(c), at(d)
    for _ in range(golden):
        if value(fc)[1] > value(fd)[1]:
            hi, d, fd = d, c, fc
            c = hi - gr * (hi - lo)
            fc = at(c)
        else:
            lo, c, fc = c, d, fd
            d = lo + gr * (hi - lo)
            fd = at(d)
    refined = fc if value(fc)[1] > value(fd)[1] else fd
    return [*swept, low, refined if value(refined)[1] > value(best)[1] else best]


def test_frontier_against_plain_lists():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(0.0004, 0.01, (200, 4))
    cfg = replace(DEFAULT, frontier_points=7, frontier_steps=60, golden_steps=12)
    found = portfolio.frontier_of(x.mean(axis=0), np.cov(x.T), cfg)
    want = plain_frontier(x.mean(axis=0).tolist(), np.cov(x.T).tolist(), cfg.risk_free, cfg.trading_days, 7, 60, 12)
    assert [k for k, _ in found] == ["frontier"] * 7 + ["min_variance", "max_sharpe"]
    for (_, w), v in zip(found, want, strict=True):
        assert w.tolist() == pytest.approx(v, abs=1e-9)


def coverage(spark, **more):
    row = {"method": "hist", "confidence": 0.95, "rate": 0.06, "reject_uc": False, "reject_ind": False, "p_uc": 0.3, "p_ind": 0.4} | more
    return spark.createDataFrame([tuple(row.values())], "method string, confidence double, rate double, reject_uc boolean, reject_ind boolean, p_uc double, p_ind double")


def test_findings(spark):
    for uc, ind, want in ((False, False, "passes"), (False, True, "timing_off"), (True, False, "count_off"), (True, True, "count_and_timing_off")):
        got = findings.clustering(coverage(spark, reject_uc=uc, reject_ind=ind)).first()
        assert (got.verdict, got.tone) == (want, "positive" if want == "passes" else "negative")
    kurtosis = spark.createDataFrame([(1.5,)], "excess_kurtosis double")
    for rate, reject, want in ((0.02, True, "too_often"), (0.005, True, "too_seldom"), (0.02, False, "not_rejected")):
        got = findings.fat_tails(coverage(spark, method="param", confidence=0.99, rate=rate, reject_uc=reject), kurtosis).first()
        assert (got.verdict, got.label) == (want, "fat_tails")
    windows = stress.windows_table(spark)
    rows = "window_key string, stress double, baseline double"
    got = findings.correlation(spark.createDataFrame([("w1998", 0.5, 0.2), ("w2000", 0.5, 0.2), ("w1999", None, 0.2)], rows), windows).first()
    assert (got.verdict, got.label, got.observed) == ("rose", "1998-99", 0.5)
    assert findings.correlation(spark.createDataFrame([], rows), windows).first().verdict == "unavailable"
    report = spark.createDataFrame([("w1998", "equal_weight", 0.1), ("w1999", "equal_weight", -0.1)], "window_key string, entity_kind string, total_return double")
    best = spark.createDataFrame([("w1998", "max_sharpe", 0.0), ("w1999", "max_sharpe", 0.0), ("w2000", "max_sharpe", 0.0)], "window_key string, kind string, total_return double")
    got = findings.optimizer(report, best, windows).first()
    assert (got.verdict, got.observed, got.reference, got.label) == ("lost", 1.0, 2.0, "1998-99")
    assert findings.optimizer(report, best.where("false"), windows).first().verdict == "unavailable"


def test_pickers(spark):
    ids = spark.createDataFrame([("b",), ("a",), ("c",)], "series_id string")
    assert [x[0] for x in panels.default_selection(ids, ("c", "b", "z")).orderBy("series_id").collect()] == ["b", "c"]
    assert [x[0] for x in panels.default_selection(ids, ("c", "z"), 2).orderBy("series_id").collect()] == ["a", "b"]
    assert one(panels.is_preset(ids, ("c", "b", "a")), "active") and not one(panels.is_preset(ids, ("c", "b")), "active")
    none = spark.createDataFrame([], "series_id string, kind string")
    assert [x.value for x in panels.benchmark_options(none, {"i": "I"}).collect()] == ["none"]
    one_ = spark.createDataFrame([("i", "index")], "series_id string, kind string")
    assert [x.value for x in panels.benchmark_options(one_, {"i": "I", "j": "J"}).orderBy("place").collect()] == ["none", "i"]


def test_a_fixed_range_has_its_own_calendar(spark, sf_dir):
    p = panels.panel(spark, sf_dir, first=date(1996, 1, 1), last=date(1996, 3, 31))
    assert one(p.calendar, F.min("pos"), F.min("date") >= date(1996, 1, 1), F.max("date") <= date(1996, 3, 31)) == (0, True, True)


def test_formats(spark):
    rows = spark.createDataFrame([(0.5248,), (-0.0027,), (0.0,)], "x double").select(stats.percent(F.col("x")), stats.signed_percent(F.col("x")), stats.signed_points(F.col("x")), stats.tone(F.col("x")))
    assert [tuple(r) for r in rows.collect()] == [("52.5%", "+52.480%", "+52.5 pts", "positive"), ("-0.3%", "-0.270%", "-0.3 pts", "negative"), ("0.0%", "0.000%", "0.0 pts", "neutral")]


def test_formats_round_by_the_value_itself(spark):
    values = [-0.05181500000000001, -0.051815, 0.00125, 12345.678, -0.00001, None]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    shown = rows.select("x", stats.percent(F.col("x"), 0), stats.percent(F.col("x"), 3), stats.signed_percent(F.col("x")), stats.signed_points(F.col("x"), 2)).collect()
    for x, *got in shown:
        at, plus = (x or 0) * 100, "+" if x and x > 0 else ""
        assert got == ([None] * 4 if x is None else [f"{at:.0f}%", f"{at:.3f}%", f"{plus}{at:.3f}%", f"{plus}{at:.2f} pts"])
    assert shown[1][2] == "-5.181%"  # 5.1815 is 5.18149999... as a double
    assert [r[0] for r in spark.createDataFrame([(float("nan"),), (float("inf"),)], "x double").select(stats.percent(F.col("x"))).collect()] == ["NaN%", "Infinity%"]


def test_empty_basket_costs_nothing(spark):
    rows = spark.createDataFrame([(["a"], ["b"]), (["a"], None)], "basket array<string>, before array<string>")
    assert [r[0] for r in rows.select(strategies.rebalance_turnover(F.col("basket"), F.col("before"), 0)).collect()] == [0.0, 0.0]


def test_look_ahead_sees_a_late_choice(spark):
    calendar = spark.createDataFrame([(i, date(2020, 1, 20) + timedelta(i)) for i in range(50)], "pos int, date date")
    months = [(date(2020, 2, 1), 12, "a", 11), (date(2020, 2, 1), 12, "b", 10), (date(2020, 3, 1), 41, "a", 40)]
    schema = "month date, first_pos int, series_id string, seen int"
    assert tuple(strategies.look_ahead(spark.createDataFrame(months, schema), calendar).first()) == (2, 0)
    late = [*months[:1], (date(2020, 2, 1), 12, "b", 12), (date(2020, 3, 1), 41, "a", 99)]  # its own first day; a day that is not known
    assert tuple(strategies.look_ahead(spark.createDataFrame(late, schema), calendar).first()) == (2, 2)


def test_both_ranks_equal_one_rank_each(spark, sf_dir):
    p = panels.panel(spark, sf_dir)
    both = strategies.both_daily_ranks(p.stocks(), p.calendar)
    for best in (True, False):
        one = strategies.daily_rank(p.stocks(), p.calendar, best).where("r is not null").select("pos", F.round("r", 12).alias("r"), "turnover", "basket")
        two = both.where(F.col("best") == best).select("pos", F.round("r", 12).alias("r"), "turnover", "basket")
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_small_views(spark):
    curve = spark.createDataFrame([("a", i, float(i)) for i in range(12)] + [("b", 0, 1.0)], "k string, pos int, value double")
    assert sorted((r.k, r.pos) for r in metrics.every_step(curve, "k", step=5).collect()) == [("a", 0), ("a", 5), ("a", 10), ("a", 11), ("b", 0)]
    bins = spark.createDataFrame([(0, 8000.0, 9000.0, 1), (1, 9000.0, 10_000.0, 2), (2, 10_000.0, 11_000.0, 3)], "bin int, lo double, hi double, n long")
    assert [(r.bin, r.mid) for r in montecarlo.marked(bins).where("marker").collect()] == [(1, 9500.0)]
    kinds = spark.createDataFrame([("solved", 12.34), ("loses_at_zero", None), ("beyond_range", None), ("unavailable", None)], "kind string, bps double")
    labels = [r[0] for r in kinds.select(costs.break_even_label(F.col("kind"), F.col("bps"))).collect()]
    assert labels == ["12.3 bps:neutral", "Underperforms Buy & Hold even with zero costs:negative", "Still ahead at 500 bps:positive", "n/a:unknown"]
    verdicts = spark.createDataFrame([("momentum_12m", 0.2), ("momentum_1d", 0.2), ("buy_and_hold", 0.5), ("low_volatility", None)], "strategy_id string, total_return double")
    assert [(r.strategy_id, round(r.edge, 9)) for r in costs.best_active(verdicts, strategies.ORDER).collect()] == [("momentum_1d", -0.3)]
    assert costs.best_active(verdicts.where("strategy_id = 'buy_and_hold'"), strategies.ORDER).count() == 0
    weights = spark.createDataFrame([("a", 0.004), ("b", 0.5), ("c", 0.491), ("d", 0.005), ("e", 0.5)], "series_id string, w double")
    assert [(r.series_id, r.share) for r in stress.shown_weights(weights).orderBy("place").collect()] == [("b", "50%"), ("e", "50%"), ("c", "49%"), ("d", "1%")]
    names = spark.createDataFrame([("A", "Alpha"), ("B", "B"), ("C", None), ("D", "")], "t string, n string")
    assert [r[0] for r in names.select(stats.ticker_label(F.col("t"), F.col("n"))).collect()] == ["A - Alpha", "B", "C", "D"]
    days = spark.createDataFrame([(date(2024, 5, 3), date(2024, 5, 9)), (date(2024, 5, 3), date(2024, 5, 10)), (date(2024, 1, 1), date(2024, 5, 3)), (date(2024, 5, 3), date(2024, 5, 1))], "a date, b date")
    assert [r[0] for r in days.select(stats.is_stale(F.col("a"), F.col("b"))).collect()] == [False, True, True, False]
