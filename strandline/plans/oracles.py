"""The same queries as SQL, for a second engine over the same tables."""

from __future__ import annotations

from strandline.config import DEFAULT
from strandline.functions.stats import ERF_A, ERF_P
from strandline.plans.queries import ASKED, LONG_FIRST, LONG_LAST, OLD_END, START

D = DEFAULT


def panel(gapped: bool = False) -> str:
    asset = "p_type" if gapped else "p_brand"
    move = "(sum(l_discount::DECIMAL(4,2))::DOUBLE / count(*) - 0.05::DOUBLE) * 0.4::DOUBLE"
    kept = "m IS NOT NULL" if gapped else "(kind = 'stock' OR m IS NOT NULL)"
    return f"""
    WITH RECURSIVE days AS (
        SELECT {asset} AS series_id, 'stock' AS kind, l_shipdate::DATE AS date, {move} AS m FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
        UNION ALL SELECT 'market', 'benchmark', l_shipdate::DATE, {move} FROM lineitem GROUP BY ALL
        UNION ALL SELECT 'index:' || l_linestatus, 'index', l_shipdate::DATE, {move} FROM lineitem GROUP BY ALL),
    cal AS MATERIALIZED (SELECT row_number() OVER (ORDER BY date)::INT - 1 AS pos, date FROM (SELECT DISTINCT date FROM days)),
    every AS (SELECT s.series_id, s.kind, c.pos, c.date, d.m FROM cal c CROSS JOIN (SELECT DISTINCT series_id, kind FROM days) s
              LEFT JOIN days d ON d.series_id = s.series_id AND d.date = c.date),
    lev AS (SELECT *, CASE WHEN count(m) OVER w > 0 THEN 100 * product(1 + m) OVER w END AS v FROM every WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
    px AS MATERIALIZED (SELECT series_id, kind, pos, date, CASE WHEN {kept} THEN v END AS price FROM lev),
    ret AS MATERIALIZED (SELECT series_id, kind, pos, date, round(price / lag(price) OVER (PARTITION BY series_id ORDER BY pos) - 1, 6) + 0.0::DOUBLE AS r FROM px),
    st AS (SELECT series_id, pos, date, r FROM ret WHERE kind = 'stock'),
    mk AS (SELECT pos, date, r AS m FROM ret WHERE kind = 'benchmark'),
    bl AS MATERIALIZED (SELECT pos, date, round(avg(r), 10) AS r FROM st GROUP BY pos, date)"""


G, P = panel(True), panel()


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0::DOUBLE"


def double(x: float) -> str:
    return f"{x!r}::DOUBLE"


def var_at(ordered: str, n: str, confidence: float) -> str:
    return f"-{ordered}[least({n} - 1, floor({double(1 - confidence)} * {n}))::INT + 1]"


def risk(source: str, market: str) -> str:
    """Risk table of (series_id, pos, r) rows."""
    vol = f"stddev_samp(r) * sqrt({D.trading_days}.0::DOUBLE)"
    idx = f"least(len(x) - 1, floor({double(1 - D.var_confidence)} * len(x)))::INT + 1"
    return f""",
    src AS ({source}), mkt AS ({market}),
    basic AS (SELECT series_id, count(r) AS n, {vol} AS volatility, CASE WHEN {vol} > 0 THEN (avg(r) * {D.trading_days} - {double(D.risk_free)}) / ({vol}) END AS sharpe,
                     list(r ORDER BY r) FILTER (r IS NOT NULL) AS x FROM src GROUP BY series_id),
    tail AS (SELECT *, -x[{idx}] AS var, -list_sum(x[1:{idx}]) / ({idx}) AS es FROM basic),
    wl AS (SELECT series_id, pos, r, coalesce(product(1 + r) OVER (PARTITION BY series_id ORDER BY pos), 1) AS w FROM src),
    pk AS (SELECT *, greatest(1, max(w) OVER (PARTITION BY series_id ORDER BY pos)) AS p FROM wl),
    dd AS (SELECT series_id, CASE WHEN count(r) > 0 THEN least(0, min(w / p - 1)) END AS max_drawdown FROM pk GROUP BY series_id),
    ba AS (SELECT series_id, CASE WHEN count(*) > 1 THEN regr_slope(r, m) END AS beta, avg(r) AS own, avg(m) AS al
           FROM src JOIN mkt USING (pos) WHERE r IS NOT NULL AND m IS NOT NULL GROUP BY series_id)
    SELECT series_id, n, {r('volatility')} AS volatility, {r('sharpe')} AS sharpe, {r('var')} AS var, {r('es')} AS es, {r('max_drawdown')} AS max_drawdown,
           {r('beta')} AS beta, {r(f'own * {D.trading_days} - ({double(D.risk_free)} + beta * (al * {D.trading_days} - {double(D.risk_free)}))')} AS alpha
    FROM tail JOIN dd USING (series_id) LEFT JOIN ba USING (series_id)"""


def lines(source: str, by: str = "") -> str:
    """VaR lines of (by, pos, date, r) rows as the table vl."""
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}," if by else ""
    out = []
    for c, z in D.z_scores:
        name = round(c * 100)
        out.append(f"CASE WHEN i > {D.var_window} AND n > 0 THEN {var_at('x', 'n', c)} END AS hist_{name}")
        out.append(f"CASE WHEN i > {D.var_window} AND n > 1 THEN -(mean + {double(z)} * dev) END AS param_{name}")
    return f""",
    lw AS (SELECT {keys} pos, date, r, row_number() OVER ({part} ORDER BY pos) AS i, list_sort(list(r) FILTER (r IS NOT NULL) OVER w) AS x,
                  count(r) OVER w AS n, avg(r) OVER w AS mean, stddev_samp(r) OVER w AS dev
           FROM ({source}) WINDOW w AS ({part} ORDER BY pos ROWS BETWEEN {D.var_window} PRECEDING AND 1 PRECEDING)),
    vl AS MATERIALIZED (SELECT {keys} pos, date, r, {', '.join(out)} FROM lw)"""


def exc(by: str = "", where: str = "true") -> str:
    keys = f"{by}," if by else ""
    each = " UNION ALL ".join(
        f"SELECT {keys} '{m}' AS method, {double(c)} AS confidence, pos, date, r, {m}_{round(c * 100)} AS var FROM vl WHERE {where}" for m in ("hist", "param") for c, _ in D.z_scores
    )
    return f", ex AS MATERIALIZED (SELECT *, (r < -var)::INT AS exc FROM ({each}) WHERE r IS NOT NULL AND var IS NOT NULL)"


def daily(source: str, top: int, best: bool, name: str, bps: float = D.cost_bps) -> str:
    way = "DESC" if best else "ASC"
    return f""",
    {name}_k AS (SELECT pos, series_id, row_number() OVER (PARTITION BY pos ORDER BY r {way}, series_id) AS k, count(*) OVER (PARTITION BY pos) AS c FROM {source} WHERE r IS NOT NULL AND pos >= 1),
    {name}_h AS (SELECT k.pos, avg(n.r) AS gross, list(k.series_id) AS basket FROM {name}_k k LEFT JOIN {source} n ON n.pos = k.pos + 1 AND n.series_id = k.series_id
                 WHERE c >= {top} AND k <= {top} GROUP BY k.pos HAVING avg(n.r) IS NOT NULL),
    {name}_p AS (SELECT *, lag(basket) OVER (ORDER BY pos) AS was FROM {name}_h),
    {name}_t AS (SELECT pos + 1 AS pos, gross, CASE WHEN was IS NULL THEN 1.0 ELSE 2 * len(list_filter(basket, lambda x: NOT list_contains(was, x))) / {top}::DOUBLE END::DOUBLE AS turnover FROM {name}_p),
    {name} AS (SELECT c.pos, c.date, gross - turnover * {double(bps)} / 10000 AS r, turnover FROM cal c LEFT JOIN {name}_t t USING (pos))"""


def baskets(name: str) -> str:
    """mom_b and low_b: month, first_pos, series_id."""
    score, table, need = {
        "mom": (f"round(price / lag(price, {D.momentum_days}) OVER (PARTITION BY series_id ORDER BY pos) - 1, 10)", "px", "true"),
        "low": ("round(stddev_samp(r) OVER w, 10)", "ret", f"n >= {int(D.low_vol_days * D.low_vol_coverage)} AND pos >= {D.low_vol_days}"),
    }[name]
    counted = "count(r) OVER w" if name == "low" else "1"
    frame = f"WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {D.low_vol_days} PRECEDING AND 1 PRECEDING)" if name == "low" else ""
    at = "s.pos + 1" if name == "mom" else "s.pos"
    way = "DESC" if name == "mom" else "ASC"
    return f""",
    {name}_s AS (SELECT series_id, pos, {score} AS score, {counted} AS n FROM {table} WHERE kind = 'stock' {frame}),
    {name}_m AS (SELECT date_trunc('month', date)::DATE AS month, min(pos) AS first_pos FROM cal GROUP BY 1 HAVING min(pos) > 0),
    {name}_r AS (SELECT month, first_pos, series_id, row_number() OVER (PARTITION BY month ORDER BY score {way}, series_id) AS k, count(*) OVER (PARTITION BY month) AS c
                 FROM {name}_s s JOIN {name}_m m ON m.first_pos = {at} WHERE score IS NOT NULL AND {need}),
    {name}_b AS MATERIALIZED (SELECT month, first_pos, series_id FROM {name}_r WHERE c >= {D.top_n} AND k <= {D.top_n})"""


def monthly(name: str, out: str, bps: float = D.cost_bps, chosen: str | None = None) -> str:
    return f"""{baskets(name) if chosen is None else chosen},
    {out}_g AS (SELECT month, list(series_id) AS basket FROM {name}_b GROUP BY month),
    {out}_p AS (SELECT month, basket, lag(basket) OVER (ORDER BY month) AS was FROM {out}_g),
    {out}_d AS (SELECT b.month, s.pos, avg(r) AS gross FROM st s JOIN {name}_b b ON date_trunc('month', s.date)::DATE = b.month AND b.series_id = s.series_id GROUP BY ALL HAVING avg(r) IS NOT NULL),
    {out}_t AS (SELECT d.pos, gross, CASE WHEN d.pos <> min(d.pos) OVER (PARTITION BY month) THEN 0.0 WHEN was IS NULL THEN 1.0
                       ELSE 2 * len(list_filter(basket, lambda x: NOT list_contains(was, x))) / {D.top_n}::DOUBLE END::DOUBLE AS turnover FROM {out}_d d JOIN {out}_p USING (month)),
    {out} AS (SELECT c.pos, c.date, gross - turnover * {double(bps)} / 10000 AS r, turnover FROM cal c LEFT JOIN {out}_t USING (pos))"""


def five() -> str:
    names = ["momentum_1d", "mean_reversion", "momentum_12m", "low_volatility", "buy_and_hold"]
    each = " UNION ALL ".join(f"SELECT '{n}' AS strategy_id, pos, date, floor(r * 1000000 + 0.500001::DOUBLE) / 1000000 AS r, CASE WHEN r IS NOT NULL THEN round(turnover, 4) END AS turnover FROM {n}" for n in names)
    return (
        P + daily("st", D.top_n, True, "momentum_1d") + daily("st", D.top_n, False, "mean_reversion") + monthly("mom", "momentum_12m") + monthly("low", "low_volatility")
        + f""", bh AS (SELECT pos, date, avg(r) AS gross FROM st GROUP BY pos, date),
    bt AS (SELECT *, CASE WHEN pos = (SELECT min(pos) FROM bh WHERE gross IS NOT NULL) THEN 1.0 ELSE 0.0 END::DOUBLE AS turnover FROM bh),
    buy_and_hold AS (SELECT pos, date, gross - turnover * {double(D.cost_bps)} / 10000 AS r, turnover FROM bt),
    sr AS MATERIALIZED ({each})"""
    )


S5 = five()


def curve(source: str, by: str, name: str = "cv") -> str:
    return f""", {name} AS (SELECT {by}, pos, date, floor({D.capital} * product(step) OVER (PARTITION BY {by} ORDER BY pos) * 100 + 0.5) / 100 AS value FROM
        (SELECT *, CASE WHEN row_number() OVER (PARTITION BY {by} ORDER BY pos) = 1 THEN 1 ELSE 1 + coalesce(r, 0) END AS step FROM {source}))"""


def totals(by: str, name: str = "tt") -> str:
    years = f"date_diff('day', min(date), max(date)) / 365.25::DOUBLE"
    return f""", {name} AS (SELECT *, final_value / {D.capital} - 1 AS total_return, CASE WHEN final_value > 0 AND years > 0 THEN pow(final_value / {D.capital}, 1 / years) - 1 END AS cagr
        FROM (SELECT {by}, arg_max(value, pos) AS final_value, {years} AS years, count(*) AS pts FROM cv GROUP BY {by}) WHERE pts > 1)"""


def window_rows() -> str:
    each = ", ".join(f"('{w.key}', DATE '{w.start}', DATE '{w.end}', DATE '{w.lookback_start}')" for w in D.windows)
    return f", win AS (SELECT * FROM (VALUES {each}) AS v(window_key, s, e, lb))"


def pair_corr(source: str, by: str = "") -> str:
    keys, on = (f"a.{by},", f"AND a.{by} = b.{by}") if by else ("", "")
    return f"""(SELECT {keys} a.series_id AS a, b.series_id AS b, CASE WHEN count(*) > 1 AND stddev_samp(a.r) * stddev_samp(b.r) > 0 THEN covar_samp(a.r, b.r) / (stddev_samp(a.r) * stddev_samp(b.r)) END AS corr
        FROM {source} a JOIN {source} b ON a.pos = b.pos AND a.series_id < b.series_id {on} WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY ALL)"""


LISTWISE = ", cd AS (SELECT * FROM (SELECT *, count(r) OVER (PARTITION BY pos) AS n, count(*) OVER (PARTITION BY pos) AS k FROM st) WHERE n = k)"
COV = LISTWISE + ", cov AS (SELECT a.series_id AS a, b.series_id AS b, covar_samp(a.r, b.r) AS cov, count(*) AS n FROM cd a JOIN cd b USING (pos) GROUP BY ALL HAVING count(*) > 1)"
_poly = "0.0"
for _a in reversed(ERF_A):
    _poly = f"(({_poly} + {double(_a)}) * t)"


def tail1(x: str) -> str:
    z = f"sqrt(greatest({x}, 0) / 2)"
    t = f"(1 / (1 + {double(ERF_P)} * {z}))"
    return "(" + _poly.replace("t)", f"{t})") + f" * exp(-{z} * {z}))"


def lt(count: str, p: str) -> str:
    return f"(CASE WHEN {count} = 0 THEN 0 ELSE {count} * ln({p}) END)"


def q(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif(({b})::DOUBLE, 0), 0)"


def tests(by: str = "") -> str:
    uc = f"greatest(0, -2 * ({lt('(n - x)', '1 - p')} + {lt('x', 'p')} - {lt('(n - x)', '1 - rate')} - {lt('x', 'rate')}))"
    ind = f"greatest(0, -2 * ({lt('(n00 + n10)', '1 - pp')} + {lt('(n01 + n11)', 'pp')} - {lt('n00', '1 - p0')} - {lt('n01', 'p0')} - {lt('n10', '1 - p1')} - {lt('n11', 'p1')}))"
    one, two = D.chi2_critical
    k = f"{by}, " if by else ""
    n = lambda a, b: f"coalesce(sum((was = {a} AND exc = {b})::INT), 0) AS n{a}{b}"
    return f""", lg AS (SELECT *, lag(exc) OVER (PARTITION BY {k}method, confidence ORDER BY pos) AS was FROM ex),
    ct AS (SELECT {k}method, confidence, 1 - confidence AS p, count(*) AS n, sum(exc) AS x, {n(0, 0)}, {n(0, 1)}, {n(1, 0)}, {n(1, 1)} FROM lg GROUP BY ALL),
    rt AS (SELECT *, x / n AS rate, {q('n01', 'n00 + n01')} AS p0, {q('n11', 'n10 + n11')} AS p1, {q('n01 + n11', 'n00 + n01 + n10 + n11')} AS pp FROM ct),
    lr AS (SELECT *, {uc} AS lr_uc, {ind} AS lr_ind FROM rt)
    SELECT {k}method, {r('confidence', 5)} AS confidence, n, x, n00, n01, n10, n11, {r('n * p', 5)} AS expected, {r('rate', 5)} AS rate, {r('lr_uc', 5)} AS lr_uc, {r('lr_ind', 5)} AS lr_ind,
           {r('lr_uc + lr_ind', 5)} AS lr_cc, {r(tail1('lr_uc'), 5)} AS p_uc, {r(tail1('lr_ind'), 5)} AS p_ind, {r('exp(-(lr_uc + lr_ind) / 2)', 5)} AS p_cc,
           lr_uc > {one} AS reject_uc, lr_ind > {one} AS reject_ind, lr_uc + lr_ind > {two} AS reject_cc FROM lr"""


BASEL = lines("SELECT * FROM bl") + exc() + f""", hx AS (SELECT *, row_number() OVER (ORDER BY pos) AS i, count(*) OVER () AS n FROM ex WHERE method = 'hist' AND confidence = 0.99::DOUBLE),
    bw AS (SELECT * FROM (SELECT method, i, n, min(date) OVER w AS start, date AS "end", sum(exc) OVER w AS exceptions FROM hx
                          WINDOW w AS (ORDER BY pos ROWS BETWEEN {D.var_window - 1} PRECEDING AND CURRENT ROW)) WHERE i >= {D.var_window} OR (n < {D.var_window} AND i = n)),
    bz AS (SELECT method, start, "end", exceptions, CASE WHEN exceptions <= {D.basel_limits[0]} THEN 'green' WHEN exceptions <= {D.basel_limits[1]} THEN 'yellow' ELSE 'red' END AS zone FROM bw)"""


def u(*parts: str) -> str:
    return f"((('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def mix(x: str, out: str) -> str:
    """Columns that end in `out`, the mixed word of x."""
    step = lambda v, o: f"(xor({v} >> 16, {v}) * 73244475) & 4294967295 AS {o}"
    return f"{step(x, out + '_a')}, {step(out + '_a', out + '_b')}, xor({out}_b >> 16, {out}_b) AS {out}"


def paths(n: int, days: int) -> str:
    """vals: path, value; a row per path and pair of days."""
    word = lambda k, o: f"(one + {k}) & 4294967295 AS {o}0, {mix(o + '0', o + '1')}, xor({o}1, two) AS {o}2, {mix(o + '2', o + '3')}, ({o}3 + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS {o}"
    step = lambda f: f"greatest(1 + mu + sigma * sqrt(-2 * ln(u)) * {f}(2 * pi() * v), 0.000001::DOUBLE)"
    return f""", mo AS (SELECT avg(r) AS mu, stddev_samp(r) AS sigma FROM bl),
    ky AS (SELECT path, 7::BIGINT AS seed, {mix('seed', 'sd')}, xor(path & 4294967295, sd) AS k1, {mix('k1', 'one')}, xor(xor(one, path >> 32), 1540483477) AS k2, {mix('k2', 'two')} FROM range({n}) p(path)),
    dr AS (SELECT path, j, {word('2 * j', 'u')}, {word('2 * j + 1', 'v')} FROM (SELECT path, one::BIGINT AS one, two::BIGINT AS two FROM ky), range(1, {(days + 1) // 2 + 1}) d(j)),
    vals AS MATERIALIZED (SELECT path, {D.capital} * product({step('cos')} * CASE WHEN 2 * j <= {days} THEN {step('sin')} ELSE 1 END) AS value FROM dr, mo GROUP BY path)"""


PATHS = paths(2000, 63)
FULL_PATHS = paths(D.paths, 63)

VINTAGES = f""", old AS (SELECT * FROM ret WHERE date <= DATE '{OLD_END}' AND series_id <> 'Brand#55'),
    new AS (SELECT series_id, kind, pos, date, round(r + (CASE WHEN pos % 97 = 13 THEN 0.01::DOUBLE ELSE 0 END + CASE WHEN pos % 53 = 7 AND date > DATE '{OLD_END}' THEN 0.5::DOUBLE ELSE 0 END), 6) AS r
            FROM ret WHERE series_id <> 'Brand#11' AND NOT (series_id = 'index:F' AND pos % 61 = 5)),
    ext AS (SELECT series_id, date, r FROM new WHERE date > (SELECT max(date) FROM old) AND abs(r) > {D.max_move}),
    cmp AS (SELECT n.series_id, n.date, n.r AS r_new, o.r AS r_old FROM new n JOIN old o USING (series_id, date) WHERE n.r IS NOT NULL AND o.r IS NOT NULL)"""


def weekdays(start: str, end: str) -> str:
    return f"(CASE WHEN {end} > {start} THEN (SELECT count(*) FROM range({start} + 1, {end} + 1, INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6) ELSE 0 END)"


def check(name: str, passed: str, n: str, source: str = "") -> str:
    return f"SELECT '{name}' AS check_name, {passed} AS passed, ({n})::BIGINT AS n {source}"


def covers(name: str) -> str:
    gaps = f"(SELECT count(*) FROM (SELECT DISTINCT date FROM new WHERE date > (SELECT max(date) FROM old)) WHERE date NOT IN (SELECT date FROM new WHERE series_id = '{name}' AND r IS NOT NULL))"
    return check(f"covers_new_dates:{name}", f"{gaps} = 0", gaps)


def gate() -> str:
    gone = "(SELECT count(*) FROM (SELECT DISTINCT series_id FROM old WHERE kind = 'stock' EXCEPT SELECT series_id FROM new WHERE kind = 'stock'))"
    k = lambda t: f"(SELECT count(DISTINCT series_id) FROM {t} WHERE kind = 'stock')"
    dropped = "(SELECT count(*) FROM (SELECT DISTINCT series_id FROM old WHERE kind = 'index' EXCEPT SELECT series_id FROM new WHERE kind = 'index'))"
    absent = "(SELECT count(*) FROM (VALUES ('index:F'), ('index:O')) v(s) WHERE s NOT IN (SELECT series_id FROM new WHERE kind = 'index'))"
    late = weekdays("(SELECT max(date) FROM new)", "DATE '2001-11-20'")
    bad = f"(SELECT count(*) FROM cmp WHERE abs(r_new - r_old) > {double(D.restate_tolerance)})"
    return P + VINTAGES + "\n" + " UNION ALL ".join(
        [
            check("end_not_earlier", "(SELECT max(date) FROM new) >= (SELECT max(date) FROM old)", "date_diff('day', (SELECT max(date) FROM old), (SELECT max(date) FROM new))"),
            check("fresh", f"{late} <= {D.stale_days}", late), check("no_stock_missing", f"{gone} = 0", gone), check("stock_count", f"{k('new')} >= {k('old')}", k("new")),
            check("benchmark_present", "(SELECT count(*) FROM new WHERE series_id = 'market') > 0", "SELECT count(DISTINCT series_id) FROM new WHERE series_id = 'market'"),
            check("indexes_present", f"{absent} = 0", absent), check("no_index_dropped", f"{dropped} = 0", dropped), covers("market"), covers("index:F"), covers("index:O"),
            check("no_wild_move", "(SELECT count(*) FROM ext) = 0", "SELECT count(*) FROM ext"),
            check("history_unchanged", f"(SELECT count(*) FROM cmp) > 0 AND {bad} / (SELECT count(*) FROM cmp) <= {double(D.restate_share)}", bad),
        ]
    )


def stress_stats(source: str, by: str) -> str:
    vol = f"coalesce(stddev_samp(r) * sqrt({D.trading_days}.0::DOUBLE), 0)"
    keys = by.split(", ")
    return f"""SELECT {by}, {r('total_return')} AS total_return, {r('coalesce(max_drawdown, 0)')} AS max_drawdown, {r('volatility')} AS volatility, {r('worst_day')} AS worst_day, n, {r('coverage')} AS coverage
        FROM (SELECT {by}, product(1 + r) - 1 AS total_return, {vol} AS volatility, min(r) AS worst_day, count(r) AS n, count(r) / count(*) AS coverage FROM {source} GROUP BY {by} HAVING count(r) > 0)
        JOIN (SELECT {by}, least(0, min(w / greatest(1, p) - 1)) AS max_drawdown FROM (SELECT *, max(w) OVER (PARTITION BY {by} ORDER BY pos) AS p FROM
              (SELECT {by}, pos, coalesce(product(1 + r) OVER (PARTITION BY {by} ORDER BY pos), 1) AS w FROM {source})) GROUP BY {by}) USING ({', '.join(keys)})"""


TESTS = tests().rsplit("SELECT method,", 1)[0].rstrip()


def findings() -> str:
    one, two = D.chi2_critical
    uc, ind = f"lr_uc > {one}", f"lr_ind > {one}"
    return f""", k AS (SELECT count(r) AS n, avg(r) AS mu FROM bl WHERE pos >= least({D.var_window}, (SELECT count(*) FROM cal) - 1)),
    ku AS (SELECT CASE WHEN any_value(n) >= 3 THEN CASE WHEN avg((r - mu) ** 2) = 0 THEN 0 ELSE avg((r - mu) ** 4) / avg((r - mu) ** 2) ** 2 - 3 END END AS k
           FROM bl, k WHERE r IS NOT NULL AND pos >= least({D.var_window}, (SELECT count(*) FROM cal) - 1)),
    cb AS (SELECT avg(corr) AS base FROM {pair_corr('(SELECT * FROM st WHERE NOT EXISTS (SELECT 1 FROM win WHERE date BETWEEN s AND e))')}),
    iw AS (SELECT window_key, series_id, pos, r FROM st JOIN win ON date BETWEEN s AND e),
    cw AS (SELECT window_key, avg(corr) AS high FROM {pair_corr('iw', 'window_key')} GROUP BY 1),
    cx AS (SELECT high, label, base FROM cb LEFT JOIN (SELECT high, label FROM cw JOIN names USING (window_key) JOIN win USING (window_key) WHERE high IS NOT NULL ORDER BY high DESC, s LIMIT 1) ON true)
    SELECT 'clustering' AS finding, CASE WHEN {uc} AND {ind} THEN 'count_and_timing_off' WHEN {uc} THEN 'count_off' WHEN {ind} THEN 'timing_off' ELSE 'passes' END AS verdict,
           CASE WHEN {uc} OR {ind} THEN 'negative' ELSE 'positive' END AS tone, {r('rate', 5)} AS observed, {r('1 - confidence', 5)} AS reference, {r(tail1('lr_ind'), 5)} AS p, NULL::VARCHAR AS label
    FROM lr WHERE method = 'hist' AND confidence = 0.95::DOUBLE
    UNION ALL SELECT 'fat_tails', CASE WHEN {uc} AND rate > 1 - confidence THEN 'too_often' WHEN {uc} AND rate < 1 - confidence THEN 'too_seldom' ELSE 'not_rejected' END,
           CASE WHEN {uc} AND rate <> 1 - confidence THEN 'negative' ELSE 'neutral' END, {r('rate', 5)}, {r('1 - confidence', 5)}, {r(tail1('lr_uc'), 5)},
           CASE WHEN k IS NULL THEN 'kurtosis_unknown' WHEN k > 0 THEN 'fat_tails' ELSE 'no_fat_tails' END
    FROM lr, ku WHERE method = 'param' AND confidence = 0.99::DOUBLE
    UNION ALL SELECT 'correlation', CASE WHEN high IS NULL OR base IS NULL THEN 'unavailable' WHEN high > base THEN 'rose' ELSE 'did_not_rise' END,
           CASE WHEN high > base THEN 'negative' ELSE 'neutral' END, {r('high', 5)}, {r('base', 5)}, NULL, label FROM cx"""


def window_names() -> str:
    return ", names AS (SELECT * FROM (VALUES " + ", ".join(f"('{w.key}', '{w.label}')" for w in D.windows) + ") AS v(window_key, label))"


def break_even() -> str:
    total = lambda who, bps: f"floor({D.capital} * product(1 + coalesce(be.r + be.t * ({double(D.cost_bps)} - {bps}) / 10000, 0)) FILTER (be.strategy_id = {who}) * 100 + 0.5) / 100 / {D.capital}"
    edge = lambda bps: f"{total('s.strategy_id', bps)} - {total(chr(39) + 'buy_and_hold' + chr(39), bps)}"
    return f""", be AS MATERIALIZED (SELECT strategy_id, r, coalesce(turnover, 0) AS t FROM sr QUALIFY row_number() OVER (PARTITION BY strategy_id ORDER BY pos) > 1),
    bs AS (SELECT DISTINCT strategy_id, 0 AS k, 0.0::DOUBLE AS lo, {D.max_cost_bps}::DOUBLE AS hi FROM sr WHERE strategy_id <> 'buy_and_hold'
        UNION ALL SELECT strategy_id, k + 1, CASE WHEN e > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN e > 0 THEN hi ELSE (lo + hi) / 2 END
        FROM (SELECT s.strategy_id, s.k, s.lo, s.hi, {edge('(s.lo + s.hi) / 2')} AS e FROM bs s JOIN be ON be.strategy_id IN (s.strategy_id, 'buy_and_hold') WHERE s.k < {D.cost_halvings} GROUP BY ALL)),
    ed AS (SELECT s.strategy_id, {edge('0')} AS at_zero, {edge(str(D.max_cost_bps))} AS at_max FROM (SELECT DISTINCT strategy_id FROM bs) s JOIN be ON be.strategy_id IN (s.strategy_id, 'buy_and_hold') GROUP BY s.strategy_id),
    kd AS (SELECT s.strategy_id, lo, hi, CASE WHEN at_zero IS NULL THEN 'unavailable' WHEN at_zero <= 0 THEN 'loses_at_zero' WHEN at_max > 0 THEN 'beyond_range' ELSE 'solved' END AS kind
           FROM bs s LEFT JOIN ed USING (strategy_id) WHERE k = {D.cost_halvings})
    SELECT strategy_id, kind, CASE WHEN kind = 'solved' THEN {r('(lo + hi) / 2', 4)} END AS bps FROM kd"""


def suffixes() -> str:
    """sx: every stock from every date on; moments in whole millionths, so both engines have the same sums."""
    own, cross = "(n * q - t * t)::DOUBLE / (n * (n - 1))", "(b * rm - o * mm)::DOUBLE / nullif(b * mq - mm * mm, 0)::DOUBLE"
    return f""", mi AS (SELECT series_id, pos, date, r, round(r * 1000000)::HUGEINT AS x, CASE WHEN r IS NOT NULL THEN round(m * 1000000)::HUGEINT END AS y FROM st JOIN (SELECT pos, m FROM mk) USING (pos)),
    we AS (SELECT *, CASE WHEN y IS NOT NULL THEN x END AS xb, coalesce(product(1 + r) OVER (PARTITION BY series_id ORDER BY pos), 1) AS w FROM mi),
    lo AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY series_id ORDER BY pos), 1) AS base, min(w) OVER f AS low FROM we WINDOW f AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    su AS (SELECT series_id, pos, date, count(x) OVER f AS n, sum(x) OVER f AS t, sum(x * x) OVER f AS q, count(y) OVER f AS b, sum(xb) OVER f AS o, sum(y) OVER f AS mm, sum(y * y) OVER f AS mq, sum(xb * y) OVER f AS rm,
                  sum((x > 0)::INT) OVER f AS ups, least(0, min(low / w - 1) OVER f, low / base - 1) AS fall, last_value(w) OVER f / w AS after, max(date) OVER f AS last
           FROM lo WINDOW f AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    sv AS (SELECT *, CASE WHEN n > 1 THEN sqrt({own}) / 1000000 * sqrt({D.trading_days}.0::DOUBLE) END AS vol, CASE WHEN b > 1 THEN {cross} END AS beta, date_diff('day', date, last) / 365.25::DOUBLE AS years FROM su),
    sx AS (SELECT series_id, pos, date, n, {r('vol')} AS volatility, {r(f"CASE WHEN vol > 0 THEN (t::DOUBLE / 1000000 / n * {D.trading_days} - {double(D.risk_free)}) / vol END")} AS sharpe, {r('CASE WHEN n > 0 THEN fall END')} AS max_drawdown,
                  {r('after - 1')} AS total_return, {r('CASE WHEN after > 0 AND years > 0 THEN pow(after, 1 / years) - 1 END')} AS cagr, {r('ups / nullif(n, 0)')} AS up_rate, {r('beta')} AS beta,
                  {r(f"CASE WHEN b > 0 THEN o::DOUBLE / 1000000 / b * {D.trading_days} - ({double(D.risk_free)} + beta * (mm::DOUBLE / 1000000 / b * {D.trading_days} - {double(D.risk_free)})) END")} AS alpha FROM sv)"""


LONG = P.replace("FROM lineitem", f"FROM (SELECT * FROM lineitem WHERE l_shipdate::DATE BETWEEN DATE '{LONG_FIRST}' AND DATE '{LONG_LAST}') AS lineitem")

FIXED = """, fi AS (SELECT series_id, row_number() OVER (ORDER BY series_id) AS i, count(*) OVER () AS k FROM (SELECT DISTINCT series_id FROM st)),
    fw AS (SELECT window_key, 'min_variance' AS kind, series_id, pow(2, i - 1)::DOUBLE / (pow(2, k) - 1)::DOUBLE AS w FROM fi, win UNION ALL SELECT window_key, 'max_sharpe', series_id, pow(2, k - i)::DOUBLE / (pow(2, k) - 1)::DOUBLE FROM fi, win)"""
FIXED_BLEND = G + window_rows() + FIXED + """, fb AS MATERIALIZED (SELECT w.window_key, w.kind, pos, date, CASE WHEN sum(w.w) FILTER (r IS NOT NULL) > 0 THEN sum(r * w.w) / sum(w.w) FILTER (r IS NOT NULL) END AS r
    FROM (SELECT window_key, series_id, pos, date, r FROM st JOIN win ON date BETWEEN s AND e) x JOIN fw w ON w.window_key = x.window_key AND w.series_id = x.series_id GROUP BY ALL) """

SQL = {
    "s1_prices": P + f" SELECT series_id, pos, date, {r('price', 4)} AS price FROM px WHERE kind = 'stock' AND date BETWEEN DATE '{START}' AND DATE '1998-12-31'",
    "s1_prices_full": P + f" SELECT series_id, pos, date, {r('price', 4)} AS price FROM px WHERE kind = 'stock'",
    "s2_enough_history": G + " SELECT series_id, count(price) AS n FROM px WHERE kind = 'stock' GROUP BY series_id HAVING count(price) >= floor((SELECT count(*) FROM cal) * 0.98::DOUBLE)",
    "s3_universe": P + " SELECT kind, count(DISTINCT series_id) AS n_series, count(r) AS n_returns, min(date) AS first, max(date) AS last FROM ret GROUP BY kind",
    "s5_names": P + " SELECT DISTINCT series_id, CASE series_id WHEN 'Brand#11' THEN 'First Brand' WHEN 'Brand#12' THEN 'Second Brand' ELSE series_id END AS name FROM st",
    "s4_long_history": LONG + f" SELECT series_id, min(date) AS first, max(pos) AS last_pos, count(r) AS n, {r('sum(r)')} AS total FROM ret GROUP BY 1",
    "s7_results_round_trip": S5 + " SELECT strategy_id, pos, date, r, turnover FROM sr",
    "s7_windows": "SELECT * FROM (VALUES " + ", ".join(f"('{w.key}', '{w.label}', DATE '{w.start}', DATE '{w.end}', DATE '{w.lookback_start}')" for w in D.windows) + ") AS v(window_key, label, start, \"end\", lookback_start)",
    "s6_json_round_trip": G + " SELECT series_id, kind, pos, date, r FROM ret WHERE kind = 'stock'",
    "s8_wide": G + " SELECT date, " + ", ".join(f"max(r) FILTER (series_id = '{x}') AS \"{x}\"" for x in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " FROM st GROUP BY date",
    "s10_by_date": G + " SELECT series_id, date, r FROM st WHERE r IS NOT NULL",
    "f1_returns": P + " SELECT series_id, kind, pos, date, r FROM ret",
    "f1_returns_gapped": G + " SELECT series_id, kind, pos, date, r FROM ret",
    "f2_trailing_return": P + f" SELECT series_id, pos, {r('t')} AS trailing FROM (SELECT series_id, pos, price / lag(price, {D.momentum_days}) OVER (PARTITION BY series_id ORDER BY pos) - 1 AS t FROM px WHERE kind = 'stock') WHERE t IS NOT NULL",
    "f3_slice_from": P + f" SELECT series_id, min(pos) AS first_pos, count(*) AS days, count(r) AS n FROM st WHERE date >= DATE '{START}' GROUP BY series_id",
    "f3_any_start": P + suffixes() + " SELECT * EXCLUDE (date) FROM sx",
    "f3_from_dates": P + suffixes() + ", ask AS (SELECT start, (SELECT min(pos) FROM cal WHERE date >= start) AS pos FROM (VALUES " + ", ".join(f"(DATE '{x}')" for x in ASKED) + ") v(start)) SELECT start, sx.* EXCLUDE (date, pos) FROM sx JOIN ask USING (pos)",
    "f7_clean": P + f", cl AS (SELECT series_id, CASE WHEN pos % 97 = 13 OR pos % 89 = 5 THEN NULL ELSE r END AS r FROM st) SELECT series_id, count(r) AS n, {r('avg(r)')} AS mean, {r('max(r)')} AS top FROM cl GROUP BY 1",
    "f13_default_selection": P + ", ids AS (SELECT DISTINCT series_id FROM st) SELECT series_id, 'known' AS asked FROM ids WHERE series_id IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#99') UNION ALL SELECT * FROM (SELECT series_id, 'one_known' FROM ids ORDER BY 1 LIMIT 5)",
    "f14_benchmark_options": P + ", ix AS (SELECT DISTINCT series_id FROM ret WHERE kind = 'index') SELECT 0 AS place, 'none' AS value, 'None' AS label, '' AS keys UNION ALL SELECT 1, 'index:F', 'Fulfilled', 'index:F' FROM ix WHERE series_id = 'index:F' UNION ALL SELECT 2, 'index:O', 'Open', 'index:O' FROM ix WHERE series_id = 'index:O' UNION ALL SELECT 3, 'all', 'Both', 'index:F,index:O' FROM ix HAVING count(*) = 2",
    "f15_search_names": P + " SELECT DISTINCT 'Brand#12' AS series_id, 'Second Brand' AS name FROM st WHERE series_id = 'Brand#12' UNION ALL SELECT DISTINCT series_id, series_id FROM st WHERE contains(series_id, '#13')",
    "k2_preset_active": P + " SELECT count(*) = 4 AS active FROM (SELECT DISTINCT series_id FROM st WHERE series_id IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#99'))",
    "f9_repriced": S5 + f" SELECT strategy_id, pos, {r(f'r + coalesce(turnover, 0) * ({double(D.cost_bps)} - 50) / 10000', 8)} AS r50 FROM sr",
    "f12_earliest_backtest": P + f" SELECT pos, date FROM cal WHERE pos = least({D.var_window}, (SELECT count(*) FROM cal) - 1)",
    "f13_preset": P + " SELECT DISTINCT series_id FROM st WHERE series_id IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#99')",
    "f15_search": P + " SELECT DISTINCT series_id FROM st WHERE contains(lower(series_id), 'brand#2')",
    "f16_every_step": S5 + curve("sr", "strategy_id") + " SELECT strategy_id, pos, date, value FROM (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY strategy_id) AS n FROM cv) WHERE i % 5 = 0 OR i = n - 1",
    "f16_sampled_curve": S5 + curve("sr", "strategy_id") + f""" SELECT strategy_id, pos, date, value FROM (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY strategy_id) AS n FROM cv)
        WHERE n <= {D.chart_points} OR i % ceil(n / {D.chart_points}) = 0 OR i = n - 1""",
    "j1_calendars": P + """, f AS (SELECT DISTINCT date FROM ret WHERE series_id = 'index:F' AND r IS NOT NULL), o AS (SELECT DISTINCT date FROM ret WHERE series_id = 'index:O' AND r IS NOT NULL)
        SELECT b AS shared, e AS together, e - b AS dropped FROM (SELECT (SELECT count(*) FROM (FROM f INTERSECT FROM o)) AS b, (SELECT count(*) FROM (FROM f UNION FROM o)) AS e)""",
    "j2_index_on_calendar": P + " SELECT series_id, pos, date, r FROM ret WHERE kind = 'index'",
    "j8_window_rows": P + window_rows() + f" SELECT window_key, series_id, count(*) AS days, {r('sum(r)')} AS total FROM st JOIN win ON date BETWEEN s AND e GROUP BY ALL",
    "j9_calm_days": P + window_rows() + f" SELECT series_id, count(*) AS days, {r('sum(r)')} AS total FROM st WHERE NOT EXISTS (SELECT 1 FROM win WHERE date BETWEEN s AND e) GROUP BY ALL",
    "j8_order_windows": P + f" SELECT o_orderkey AS window_key, count(*) AS days, {r('sum(m)')} AS total FROM orders JOIN mk ON date BETWEEN o_orderdate::DATE AND o_orderdate::DATE + (o_orderkey % 90 - 3)::INT GROUP BY 1",
    "j9_order_gaps": P + " SELECT pos, date FROM mk WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 101 = 0 AND date BETWEEN o_orderdate::DATE AND o_orderdate::DATE + 1)",
    "j14_as_of": G + f""", mo AS (SELECT date_trunc('month', date)::DATE AS date, count(*) AS days FROM cal GROUP BY 1), se AS (SELECT DISTINCT series_id FROM px), pr AS (SELECT series_id, date, price FROM px WHERE price IS NOT NULL AND pos % 7 <> 3)
        SELECT series_id, m.date, days, {r('price', 4)} AS price, p.date AS priced_on FROM (SELECT * FROM mo, se) m ASOF LEFT JOIN pr p USING (series_id, date)""".replace("USING (series_id, date)", "ON m.series_id = p.series_id AND m.date > p.date").replace("SELECT series_id, m.date", "SELECT m.series_id, m.date"),
    "c14_gate_stored": gate(),
    "s9_previous_vintage": P + VINTAGES + f""" SELECT vintage, kind, date_trunc('month', date)::DATE AS month, count(*) AS days, count(r) AS n, {r('sum(r)')} AS total
        FROM (SELECT '2001-09-30' AS vintage, kind, date, r FROM old UNION ALL SELECT '2001-11-20', kind, date, r FROM new) GROUP BY ALL""",
    "j12_uncovered_dates": G + " SELECT series_id, date FROM st WHERE r IS NULL",
    "j15_curves_wide": S5 + curve("sr", "strategy_id") + " SELECT date, " + ", ".join(f"max(value) FILTER (strategy_id = '{x}') AS {x}" for x in ("momentum_1d", "mean_reversion", "momentum_12m", "low_volatility", "buy_and_hold")) + " FROM cv GROUP BY date",
    "a1_equal_weight": G + f" SELECT pos, date, {r('r', 8)} AS r FROM bl",
    "a2_weighted": G + f" SELECT pos, date, {r('CASE WHEN sum(w) FILTER (r IS NOT NULL) > 0 THEN sum(r * w) / sum(w) FILTER (r IS NOT NULL) END', 8)} AS r FROM (SELECT *, length(series_id) / 10 AS w FROM st) GROUP BY pos, date",
    "a3_risk_table": P + risk(f"SELECT series_id, pos, r FROM st WHERE date >= DATE '{START}'", f"SELECT pos, m FROM mk WHERE date >= DATE '{START}'"),
    "a5_portfolio_summary": P + risk("SELECT 'portfolio' AS series_id, pos, r FROM bl", "SELECT pos, m FROM mk"),
    "a6_tail_selected": P + risk("SELECT series_id, pos, r FROM st", "SELECT pos, m FROM mk").rsplit("SELECT series_id, n,", 1)[0] + f" SELECT series_id, n, {r('var')} AS var, {r('es')} AS es FROM tail",
    "a6_tail_lines": f"""WITH s AS (SELECT l_linestatus AS status, list(l_discount::DOUBLE - l_tax::DOUBLE ORDER BY l_discount::DOUBLE - l_tax::DOUBLE) AS x, list(l_extendedprice::DOUBLE ORDER BY l_extendedprice) AS p, count(*) AS n FROM lineitem GROUP BY 1),
        i AS (SELECT *, least(n - 1, floor({double(1 - D.var_confidence)} * n))::BIGINT + 1 AS k FROM s)
        SELECT status, n, {r('p[n // 2 + 1]', 4)} AS upper_median, {r('-x[k]', 4)} AS var, {r('-list_sum(x[1:k]) / k', 4)} AS es FROM i""",
    "a9_correlations": G + f", pc AS {pair_corr('st')} SELECT a, b, {r('corr')} AS corr FROM (SELECT a, b, corr FROM pc UNION ALL SELECT b, a, corr FROM pc UNION ALL SELECT DISTINCT series_id, series_id, 1.0 FROM st)",
    "a10_average_correlation": G + f" SELECT {r('avg(corr)')} AS avg_corr, count(corr) AS n_pairs FROM {pair_corr('st')}",
    "a11_covariance": G + COV + f" SELECT a, b, {r('cov', 9)} AS cov, n FROM cov",
    "a13_portfolio_moments": G + COV + f""" SELECT {r('(SELECT avg(mu) FROM (SELECT avg(r) AS mu FROM cd GROUP BY series_id))', 8)} AS mu,
        {r('(SELECT sqrt(greatest(0, sum(cov) / (SELECT count(DISTINCT series_id) FROM st) ** 2)) FROM cov)', 8)} AS sigma, (SELECT max(n) FROM cov) AS n""",
    "a14_shape": P + f""", dm AS (SELECT s.series_id, r - mu AS d FROM st s JOIN (SELECT series_id, avg(r) AS mu FROM st GROUP BY 1) m USING (series_id) WHERE r IS NOT NULL),
        m2 AS (SELECT series_id, count(*) AS n, avg(d * d) AS v2, avg(d * d * d) AS v3, avg(d * d * d * d) AS v4 FROM dm GROUP BY 1)
        SELECT series_id, n, {r('CASE WHEN n >= 3 THEN CASE WHEN v2 = 0 THEN 0 ELSE v3 / pow(v2, 1.5) END END', 5)} AS skewness, {r('CASE WHEN n >= 3 THEN CASE WHEN v2 = 0 THEN 0 ELSE v4 / (v2 * v2) - 3 END END', 5)} AS excess_kurtosis FROM m2""",
    "a15_derived_stats": S5 + f", sl AS (SELECT * FROM sr WHERE date >= DATE '{START}')" + curve("sl", "strategy_id") + totals("strategy_id") + f"""
        SELECT strategy_id, {r('total_return')} AS total_return, {r('final_value')} AS final_value, {r('years')} AS years, {r('cagr')} AS cagr, {r('up_rate')} AS up_rate, {r('avg_return')} AS avg_return, n_periods FROM tt
        LEFT JOIN (SELECT strategy_id, avg((r > 0)::INT) AS up_rate, avg(r) AS avg_return, count(*) AS n_periods FROM sl WHERE r IS NOT NULL GROUP BY 1) USING (strategy_id)""",
    "a23_monthly": P + f" SELECT series_id, date_trunc('month', date)::DATE AS month, {r('product(1 + r) - 1')} AS r FROM st WHERE r IS NOT NULL GROUP BY ALL",
    "a24_holdings": P + baskets("low") + f" SELECT series_id, count(*) AS months_held, round(count(*) / (SELECT count(DISTINCT month) FROM low_b), 4) AS fraction FROM low_b GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {D.holdings}",
    "a29_any_data": G + window_rows() + " SELECT window_key, count(DISTINCT series_id) FILTER (r IS NOT NULL) AS n FROM st JOIN win ON date >= lb AND date < s GROUP BY 1",
    "a30_coverage": G + " SELECT series_id, count(price) AS days FROM px GROUP BY 1",
    "a31_hero": P + f" SELECT min(date) AS first, max(date) AS last, count(*) AS days, (SELECT count(DISTINCT series_id) FROM st) AS stocks, {r('''date_diff('day', min(date), max(date)) / 365.2425::DOUBLE''')} AS years FROM cal",
    "a31_hero_union": P + lines("SELECT * FROM bl") + exc(where=f"date >= DATE '{START}'") + f""", al AS (SELECT date FROM cal UNION ALL SELECT l_shipdate::DATE FROM lineitem WHERE l_shipdate::DATE BETWEEN DATE '{LONG_FIRST}' AND DATE '{LONG_LAST}')
        SELECT (SELECT count(DISTINCT series_id) FROM st) AS stocks, {r("date_diff('day', min(date), max(date)) / 365.2425::DOUBLE")} AS years, (SELECT count(*) FROM ex WHERE method = 'hist' AND confidence = 0.95::DOUBLE) AS var_days, {len(D.windows)} AS crises FROM al""",
    "w1_equity": P + curve("st", "series_id") + " SELECT series_id, pos, value FROM cv",
    "w1_equity_blocks": P + curve("st", "series_id") + " SELECT series_id, pos, value FROM cv",
    "a5_drawdown_blocks": P + risk("SELECT series_id, pos, r FROM st UNION ALL SELECT 'portfolio', pos, r FROM bl", "SELECT pos, m FROM mk").rsplit("SELECT series_id, n,", 1)[0] + f" SELECT series_id, {r('max_drawdown')} AS max_drawdown FROM dd",
    "w2_anchored_equity": P + ", fs AS (SELECT series_id, greatest(0, min(pos) - 1) AS b FROM st WHERE r IS NOT NULL GROUP BY 1), an AS (SELECT series_id, pos, date, r FROM st JOIN fs USING (series_id) WHERE pos >= b)" + curve("an", "series_id") + " SELECT series_id, pos, value FROM cv",
    "w4_rolling": P + f""", rw AS (SELECT series_id, pos, row_number() OVER (PARTITION BY series_id ORDER BY pos) AS i, stddev_samp(r) OVER w * sqrt({D.trading_days}.0::DOUBLE) AS v,
            avg(r) OVER w * {D.trading_days} - {double(D.risk_free)} AS l, regr_slope(r, m) OVER w AS b, count(*) FILTER (r IS NOT NULL AND m IS NOT NULL) OVER w AS c FROM st JOIN (SELECT pos, m FROM mk) USING (pos)
            WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {D.rolling_days - 1} PRECEDING AND CURRENT ROW))
        SELECT series_id, pos, {r(f'CASE WHEN i >= {D.rolling_days} THEN v END', 5)} AS volatility, {r(f'CASE WHEN i >= {D.rolling_days} AND v > 0 THEN l / v END', 5)} AS sharpe, {r(f'CASE WHEN i >= {D.rolling_days} AND c > 1 THEN b END', 5)} AS beta FROM rw""",
    "w6_var_lines": P + lines("SELECT * FROM bl") + f" SELECT pos, date, {r('r', 8)} AS r, " + ", ".join(f"{r(x, 8)} AS {x}" for x in ("hist_95", "hist_99", "param_95", "param_99")) + " FROM vl",
    "w8_var_backtest": P + lines("SELECT * FROM bl") + exc(where=f"date >= DATE '{START}'") + tests(),
    "w8_var_backtest_by_stock": P + lines("SELECT * FROM st", "series_id") + exc("series_id", f"date >= DATE '{START}'") + tests("series_id"),
    "w10_basel_windows": P + BASEL + " SELECT * FROM bz",
    "w11_basel_summary": P + BASEL + """, la AS (SELECT * FROM bz ORDER BY "end" DESC LIMIT 1), wo AS (SELECT * FROM bz ORDER BY exceptions DESC, "end" LIMIT 1)
        SELECT la.method, la.start AS last_start, la."end" AS last_end, la.exceptions AS last_exceptions, la.zone AS last_zone, wo.start AS worst_start, wo."end" AS worst_end, wo.exceptions AS worst_exceptions, wo.zone AS worst_zone,
               la.zone <> wo.zone AS zones_differ FROM la, wo""",
    "w12_momentum_1d": P + daily("st", D.top_n, True, "x") + f" SELECT pos, {r('r', 8)} AS r, {r('turnover', 8)} AS turnover FROM x",
    "w12_mean_reversion_gapped": G + daily("st", 2, False, "x") + f" SELECT pos, {r('r', 8)} AS r, {r('turnover', 8)} AS turnover FROM x",
    "w14_momentum_baskets": P + baskets("mom") + " SELECT * FROM mom_b",
    "w15_low_vol_baskets": P + baskets("low") + " SELECT * FROM low_b",
    "w16_strategies": S5 + " SELECT strategy_id, pos, r, turnover FROM sr",
    "j16_rolling_chart": P + f""", rw AS (SELECT series_id, pos, date, row_number() OVER w AS i, stddev_samp(r) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {D.rolling_days - 1} PRECEDING AND CURRENT ROW) * sqrt({D.trading_days}.0::DOUBLE) AS v
            FROM st WINDOW w AS (PARTITION BY series_id ORDER BY pos)), wd AS (SELECT pos, date, """ + ", ".join(f"{r(f'any_value(v) FILTER (series_id = {chr(39)}{x}{chr(39)} AND i >= {D.rolling_days})', 5)} AS \"{x.replace('#', '_')}\"" for x in ("Brand#11", "Brand#12", "Brand#13")) + f""" FROM rw GROUP BY pos, date)
        SELECT * EXCLUDE (i, n) FROM (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS i, count(*) OVER () AS n FROM wd) WHERE n <= {D.rolling_points} OR i % ceil(n / {D.rolling_points}) = 0 OR i = n - 1""",
    "v1_var_chart": P + lines("SELECT * FROM bl") + f" SELECT pos, date, {r('r', 8)} AS r, {r('-hist_95', 8)} AS lower, CASE WHEN r < -hist_95 THEN {r('r', 8)} END AS exception_r FROM vl",
    "v1_uncovered": G + window_rows() + f" SELECT window_key, series_id, {r('count(r) / count(*)')} AS coverage FROM (SELECT series_id, date, CASE WHEN NOT (series_id LIKE 'S%' AND pos % 7 < 2) THEN r END AS r FROM st) JOIN win ON date BETWEEN s AND e GROUP BY ALL HAVING count(r) / count(*) < {D.min_coverage}",
    "c11_findings": P + window_rows() + window_names() + lines("SELECT * FROM bl") + exc(where=f"pos >= least({D.var_window}, (SELECT count(*) FROM cal) - 1)") + TESTS + findings(),
    "c14_missing_keys": "SELECT unnest(['benchmark', 'indexes']) AS key",
    "n10_break_even": S5 + break_even(),
    "c12_hero_curve": S5 + ", bb AS (SELECT * FROM sr WHERE strategy_id = 'buy_and_hold')" + curve("bb", "strategy_id") + """ SELECT pos, x, y FROM (SELECT pos, floor(i / (n - 1) * 600 * 10 + 0.5) / 10 AS x, floor((180 - (value - lo) / coalesce(nullif(hi - lo, 0), 1) * 160) * 10 + 0.5) / 10 AS y, i, n
        FROM (SELECT pos, value, row_number() OVER (ORDER BY pos) - 1 AS i, count(*) OVER () AS n, min(value) OVER () AS lo, max(value) OVER () AS hi FROM cv)) WHERE n <= 150 OR i % ceil(n / 150) = 0 OR i = n - 1""",
    "w17_look_ahead": P + baskets("mom") + baskets("low") + " " + " UNION ALL ".join(
        f"SELECT '{name}' AS selector, count(*) AS rebalances, sum((c.date >= month)::INT) AS violations FROM (SELECT DISTINCT month, first_pos FROM {table}) b JOIN cal c ON c.pos = b.first_pos - 1" for name, table in (("momentum", "mom_b"), ("low_volatility", "low_b"))
    ),
    "n11_cost_sensitivity": S5 + f", lv AS (SELECT strategy_id, bps, pos, date, r + coalesce(turnover, 0) * ({double(D.cost_bps)} - bps) / 10000 AS r FROM sr, (VALUES (0.0::DOUBLE), (10.0), (25.0), (50.0), (100.0)) v(bps))" + curve("lv", "strategy_id, bps") + totals("strategy_id, bps") + f"""
        SELECT a.strategy_id, a.bps, {r('a.total_return')} AS total_return, {r('a.total_return - b.total_return')} AS edge FROM tt a LEFT JOIN tt b ON a.bps = b.bps AND b.strategy_id = 'buy_and_hold'""",
    "n12_linearity": P + "".join(
        daily("st", D.top_n, True, f"d1{i}", c) + daily("st", D.top_n, False, f"d2{i}", c) + monthly("mom", f"m1{i}", c, None if i == "a" else "") + monthly("low", f"m2{i}", c, None if i == "a" else "")
        + f", bt{i} AS (SELECT pos, avg(r) AS gross FROM st GROUP BY pos), h1{i} AS (SELECT pos, gross - turnover * {double(c)} / 10000 AS r, turnover FROM (SELECT *, CASE WHEN pos = (SELECT min(pos) FROM bt{i} WHERE gross IS NOT NULL) THEN 1.0 ELSE 0.0 END::DOUBLE AS turnover FROM bt{i}))"
        for i, c in (("a", D.cost_bps), ("b", 100.0))
    ) + " " + " UNION ALL ".join(
        f"SELECT '{name}' AS strategy_id, max(abs(x.r + coalesce(x.turnover, 0) * ({double(D.cost_bps)} - 100) / 10000 - y.r)) <= 1e-12 AS linear, sum((x.turnover IS DISTINCT FROM y.turnover)::INT) AS n_turnover_changes FROM {k}a x JOIN {k}b y USING (pos)"
        for name, k in (("momentum_1d", "d1"), ("mean_reversion", "d2"), ("momentum_12m", "m1"), ("low_volatility", "m2"), ("buy_and_hold", "h1"))
    ),
    "n10_break_even_label": f"""WITH d AS ({S5 + break_even()}) SELECT strategy_id, CASE kind WHEN 'solved' THEN printf('%.1f bps:neutral', bps) WHEN 'loses_at_zero' THEN 'Underperforms Buy & Hold even with zero costs:negative' WHEN 'beyond_range' THEN 'Still ahead at {D.max_cost_bps:g} bps:positive' ELSE 'n/a:unknown' END AS label FROM d""",
    "c3_comparison": S5 + curve("sr", "strategy_id") + totals("strategy_id") + f""", rk AS (SELECT strategy_id, stddev_samp(r) * sqrt({D.trading_days}.0::DOUBLE) AS v, avg(r) * {D.trading_days} - {double(D.risk_free)} AS l, sum(turnover) AS t FROM sr GROUP BY 1),
        wl AS (SELECT strategy_id, pos, coalesce(product(1 + r) OVER (PARTITION BY strategy_id ORDER BY pos), 1) AS w FROM sr),
        dd AS (SELECT strategy_id, least(0, min(w / p - 1)) AS d FROM (SELECT *, greatest(1, max(w) OVER (PARTITION BY strategy_id ORDER BY pos)) AS p FROM wl) GROUP BY 1)
        SELECT strategy_id, {r('cagr')} AS cagr, {r('v')} AS volatility, {r('CASE WHEN v > 0 THEN l / v END')} AS sharpe, {r('d')} AS max_drawdown, {r('total_return')} AS total_return,
               CASE WHEN strategy_id <> 'buy_and_hold' THEN {r('t / years')} END AS annual_turnover FROM tt JOIN rk USING (strategy_id) JOIN dd USING (strategy_id)""",
    "c7_verdict": S5 + curve("sr", "strategy_id") + totals("strategy_id") + f""", df AS (SELECT strategy_id, total_return, (total_return - (SELECT total_return FROM tt WHERE strategy_id = 'buy_and_hold')) * 100 AS d FROM tt),
        tl AS (SELECT count(*) AS n, sum((d > 0)::INT) AS won FROM df WHERE strategy_id <> 'buy_and_hold')
        SELECT strategy_id, {r('total_return', 4)} AS total_return, {r('d', 4)} AS diff_pts, d > 0 AS beats, CASE WHEN won = 0 THEN 'negative' WHEN won = n THEN 'positive' ELSE 'neutral' END AS tone,
               strategy_id = (SELECT strategy_id FROM df ORDER BY total_return DESC, list_position(['momentum_1d', 'mean_reversion', 'momentum_12m', 'low_volatility', 'buy_and_hold'], strategy_id) LIMIT 1) AS is_best FROM df, tl""",
    "c9_stress_report": G + window_rows() + f""", iw AS (SELECT window_key, series_id, pos, date, r FROM st JOIN win ON date BETWEEN s AND e),
        cv2 AS (SELECT iw.* FROM iw JOIN (SELECT window_key, series_id FROM iw GROUP BY ALL HAVING count(r) / count(*) >= {D.min_coverage}) USING (window_key, series_id)),
        en AS MATERIALIZED (SELECT window_key, 'stock' AS entity_kind, series_id AS entity, pos, r FROM cv2
            UNION ALL SELECT window_key, 'equal_weight', 'equal_weight', pos, round(avg(r), 10) FROM cv2 GROUP BY window_key, pos
            UNION ALL SELECT window_key, 'benchmark', 'benchmark', pos, m FROM mk JOIN win ON date BETWEEN s AND e) """ + stress_stats("en", "window_key, entity_kind, entity"),
    "k1_shown_weights": G + window_rows() + FIXED + " SELECT window_key, kind, (row_number() OVER (PARTITION BY window_key, kind ORDER BY w * w DESC, series_id))::INT AS place, series_id, printf('%.0f%%', w * w * 100) AS share FROM fw WHERE w * w >= 0.005::DOUBLE",
    "c8_fixed_weights": FIXED_BLEND + stress_stats("fb", "window_key, kind"),
    "c9_stress_correlations": G + window_rows() + f""", iw AS (SELECT window_key, series_id, pos, r FROM st JOIN win ON date BETWEEN s AND e), ca AS (SELECT series_id, pos, r FROM st WHERE NOT EXISTS (SELECT 1 FROM win WHERE date BETWEEN s AND e)),
        b AS (SELECT avg(corr) AS v, count(corr) AS n FROM {pair_corr('ca')}), x AS (SELECT window_key, avg(corr) AS v, count(corr) AS n FROM {pair_corr('iw', 'window_key')} GROUP BY 1)
        SELECT window_key, {r('x.v')} AS stress, x.n AS n_pairs_stress, {r('b.v')} AS baseline, b.n AS n_pairs_baseline, {r('x.v - b.v')} AS delta FROM x, b""",
    "c11_exception_clusters": P + lines("SELECT * FROM bl") + exc() + """, rn AS (SELECT method, confidence, exc, row_number() OVER w - sum(exc) OVER w AS g FROM ex WINDOW w AS (PARTITION BY method, confidence ORDER BY pos))
        SELECT method, confidence, max(c) AS longest FROM (SELECT method, confidence, g, count(*) AS c FROM rn WHERE exc = 1 GROUP BY ALL) GROUP BY ALL""",
    "c12_worst_exceptions": P + lines("SELECT * FROM bl") + exc() + f" SELECT pos, date, {r('r')} AS r FROM ex WHERE method = 'hist' AND confidence = 0.99::DOUBLE AND exc = 1 ORDER BY ex.r, pos LIMIT 5",
    "n2_two_asset_min_variance": G.replace("SELECT series_id, pos, date, r FROM ret WHERE kind = 'stock'", "SELECT series_id, pos, date, r FROM ret WHERE series_id IN (SELECT DISTINCT series_id FROM ret WHERE kind = 'stock' ORDER BY 1 LIMIT 2)") + COV + f""",
        v AS (SELECT min(a) AS a, max(a) AS b, arg_min(cov, a) FILTER (a = b) AS va, arg_max(cov, a) FILTER (a = b) AS vb, min(cov) FILTER (a <> b) AS c FROM cov),
        w AS (SELECT a, b, greatest(0, least(1, (vb - c) / (va + vb - 2 * c))) AS w FROM v) SELECT a AS series_id, {r('w', 5)} AS w FROM w UNION ALL SELECT b, {r('1 - w', 5)} FROM w""",
    "n7_cloud": G + COV + f""", mu AS (SELECT series_id, avg(r) AS mu FROM cd GROUP BY 1), dr AS (SELECT point, series_id, mu, -ln({u("'1'", 'point', 'series_id')}) AS e FROM range(500) p(point), mu),
        ww AS (SELECT point, series_id, mu, e / sum(e) OVER (PARTITION BY point) AS w FROM dr)
        SELECT point, {r(f'any_value(er) * {D.trading_days}')} AS expected_return, {r(f'sqrt(greatest(0, sum(a.w * b.w * cov)) * {D.trading_days})')} AS volatility
        FROM ww a JOIN ww b USING (point) JOIN cov ON cov.a = a.series_id AND cov.b = b.series_id JOIN (SELECT point, sum(w * mu) AS er FROM ww GROUP BY 1) USING (point) GROUP BY point""",
    "n9_monte_carlo": P + PATHS + f" SELECT {', '.join(r(f'quantile_cont(value, {p / 100})', 3) + f' AS p{p}' for p in (5, 50, 95))}, {r(f'avg((value < {D.capital})::INT)', 3)} AS prob_loss, {r('avg(value)', 3)} AS mean FROM vals",
    "n9_monte_carlo_full": P + FULL_PATHS + f" SELECT {', '.join(r(f'quantile_cont(value, {p / 100})', 3) + f' AS p{p}' for p in (5, 50, 95))}, {r(f'avg((value < {D.capital})::INT)', 3)} AS prob_loss, {r('avg(value)', 3)} AS mean FROM vals",
    "a25_histogram": P + PATHS + f""", e AS (SELECT min(value) AS lo, (max(value) - min(value)) / {D.bins} AS w FROM vals), h AS (SELECT least({D.bins - 1}, floor((value - lo) / w))::INT AS bin, count(*) AS n FROM vals, e GROUP BY 1)
        SELECT b AS bin, {r('lo + b * w', 3)} AS lo, {r('lo + b * w + w', 3)} AS hi, coalesce(n, 0) AS n FROM range({D.bins}) g(b) CROSS JOIN e LEFT JOIN h ON h.bin = b""",
    "v1_histogram_marker": P + PATHS + f""", e AS (SELECT min(value) AS lo, (max(value) - min(value)) / {D.bins} AS w FROM vals), h AS (SELECT least({D.bins - 1}, floor((value - lo) / w))::INT AS bin, count(*) AS n FROM vals, e GROUP BY 1),
        m AS (SELECT b AS bin, lo + b * w AS lo, lo + b * w + w AS hi, coalesce(n, 0) AS n FROM range({D.bins}) g(b) CROSS JOIN e LEFT JOIN h ON h.bin = b)
        SELECT bin, {r('lo', 3)} AS lo, {r('hi', 3)} AS hi, n, {r('(lo + hi) / 2', 3)} AS mid, row_number() OVER (ORDER BY abs((lo + hi) / 2 - {D.capital}), bin) = 1 AS marker FROM m""",
    "a25_histogram_full": P + FULL_PATHS + f""", e AS (SELECT min(value) AS lo, (max(value) - min(value)) / {D.bins} AS w FROM vals), h AS (SELECT least({D.bins - 1}, floor((value - lo) / w))::INT AS bin, count(*) AS n FROM vals, e GROUP BY 1)
        SELECT b AS bin, {r('lo + b * w', 3)} AS lo, {r('lo + b * w + w', 3)} AS hi, coalesce(n, 0) AS n FROM range({D.bins}) g(b) CROSS JOIN e LEFT JOIN h ON h.bin = b""",
    "k11_is_stale": P + f" SELECT pos, today, CASE WHEN date_diff('day', date, today) > {D.max_lookback} THEN true ELSE {weekdays('date', 'today')} > {D.stale_days} END AS stale FROM cal, (VALUES (DATE '2001-11-20'), (DATE '1998-07-06'), (DATE '1996-01-02')) v(today)",
    "k12_ticker_labels": P + " SELECT DISTINCT series_id, CASE series_id WHEN 'Brand#11' THEN 'Brand#11 - First Brand' WHEN 'Brand#12' THEN 'Brand#12 - Second Brand' ELSE series_id END AS label FROM st",
    "c14_gate": gate(),
    "c14_restated": P + VINTAGES + f" SELECT series_id, date, {r('r_new')} AS r_new, {r('r_old')} AS r_old, {r('abs(r_new - r_old)')} AS change FROM cmp WHERE abs(cmp.r_new - cmp.r_old) > {double(D.restate_tolerance)} ORDER BY round(abs(cmp.r_new - cmp.r_old), 10) DESC, series_id, date LIMIT 10",
    "c14_extremes": P + VINTAGES + f" SELECT series_id, date, {r('r')} AS r FROM ext",
    "business_days": P + f" SELECT pos, {weekdays('date', '''DATE '2001-11-20' ''')} AS n FROM cal",
    "daily_event_bars": f"SELECT event_type, ts::DATE AS day, count(*) AS n, {r('sum(value)', 4)} AS total, {r('min(value)', 4)} AS low, {r('max(value)', 4)} AS high FROM events GROUP BY ALL",
}

SQL["a28_best_columns"] = f"""WITH d AS ({SQL['a15_derived_stats']}),
    l AS (UNPIVOT (SELECT strategy_id, up_rate, avg_return, total_return, final_value FROM d) ON up_rate, avg_return, total_return, final_value INTO NAME metric VALUE value)
    SELECT strategy_id, metric, value, value = max(value) OVER (PARTITION BY metric) AS is_best FROM l"""
SQL["c13_low_volatility"] = f"""WITH d AS ({SQL['c3_comparison']})
    SELECT a.volatility AS volatility_low, a.sharpe AS sharpe_low, b.volatility AS volatility_passive, b.sharpe AS sharpe_passive, a.volatility < b.volatility AS calmer, a.sharpe > b.sharpe AS better
    FROM d a, d b WHERE a.strategy_id = 'low_volatility' AND b.strategy_id = 'buy_and_hold'"""
SQL["w18_verdict_order"] = f"""WITH d AS ({SQL['c7_verdict']})
    SELECT row_number() OVER (ORDER BY diff_pts DESC, strategy_id)::INT AS place, strategy_id, diff_pts FROM d WHERE beats AND strategy_id <> 'buy_and_hold'"""
SQL["k12_formats"] = f"""WITH d AS ({SQL['c3_comparison']})
    SELECT strategy_id, CASE WHEN total_return > 0 THEN 'positive' WHEN total_return < 0 THEN 'negative' ELSE 'neutral' END AS tone, printf('%.1f%%', total_return * 100) AS pct,
           CASE WHEN total_return > 0 THEN '+' ELSE '' END || printf('%.3f%%', total_return * 100) AS signed, CASE WHEN total_return > 0 THEN '+' ELSE '' END || printf('%.1f pts', total_return * 100) AS points FROM d"""
SQL["v1_best_active"] = f"""WITH d AS ({SQL['c7_verdict']})
    SELECT strategy_id, total_return, {r("total_return - (SELECT total_return FROM d WHERE strategy_id = 'buy_and_hold')", 4)} AS edge FROM d WHERE strategy_id <> 'buy_and_hold'
    ORDER BY total_return DESC, list_position(['momentum_1d', 'mean_reversion', 'momentum_12m', 'low_volatility'], strategy_id) LIMIT 1"""
SQL["v1_underperformance_fixed"] = f"""WITH o AS ({SQL['c8_fixed_weights']}), q AS ({SQL['c9_stress_report']})
    SELECT kind, count(*) AS n_windows, sum((o.total_return < q.total_return)::INT) AS n_worse FROM o JOIN q ON q.window_key = o.window_key AND q.entity_kind = 'equal_weight' GROUP BY kind"""
SQL["n7_cloud_full"] = SQL["n7_cloud"].replace("range(500)", f"range({D.cloud_points})")
SQL["n9_monte_carlo_5y"] = SQL["n9_monte_carlo_full"].replace(FULL_PATHS, paths(D.paths, 5 * D.trading_days))
