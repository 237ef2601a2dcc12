"""Column expressions of test statistics and small scalar rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the rational approximation 7.1.26 of Abramowitz and Stegun.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    tail = poly * F.exp(-x * x)
    return F.when(x >= 0, tail).otherwise(2 - tail)


def chi2_tail(x: Column, df: int) -> Column:
    at = F.greatest(x, F.lit(0.0))
    return erfc(F.sqrt(at / 2)) if df == 1 else F.exp(-at / 2)


def log_term(count: Column, p: Column) -> Column:
    return F.when(count == 0, F.lit(0.0)).otherwise(count * F.ln(p))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def kupiec(n: Column, x: Column, p: Column) -> Column:
    """Likelihood ratio of x exceptions in n days at rate p; null without days."""
    rate = ratio(x, n)
    value = -2 * (log_term(n - x, 1 - p) + log_term(x, p) - log_term(n - x, 1 - rate) - log_term(x, rate))
    return F.when(n > 0, F.greatest(F.lit(0.0), value))


def christoffersen(n00: Column, n01: Column, n10: Column, n11: Column) -> Column:
    p0, p1, p = ratio(n01, n00 + n01), ratio(n11, n10 + n11), ratio(n01 + n11, n00 + n01 + n10 + n11)
    one = log_term(n00 + n10, 1 - p) + log_term(n01 + n11, p)
    two = log_term(n00, 1 - p0) + log_term(n01, p0) + log_term(n10, 1 - p1) + log_term(n11, p1)
    return F.greatest(F.lit(0.0), -2 * (one - two))


def basel_zone(exceptions: Column, limits: tuple[int, int] = (4, 9)) -> Column:
    return F.when(exceptions <= limits[0], "green").when(exceptions <= limits[1], "yellow").otherwise("red")


def years_between(first: Column, last: Column, days: float = 365.25) -> Column:
    return F.datediff(last, first) / F.lit(days)


def cagr(first: Column, last: Column, years: Column) -> Column:
    return F.when((first > 0) & (last > 0) & (years > 0), F.pow(last / first, 1 / years) - 1)


def business_days(start: Column, end: Column) -> Column:
    """Weekdays after start up to end; 0 unless end is later."""
    days = F.filter(F.sequence(F.date_add(start, 1), end), lambda d: F.weekday(d) < 5)
    return F.when(end > start, F.size(days)).otherwise(0)


def is_stale(newest: Column, today: Column, budget: int = 4, lookback: int = 45) -> Column:
    """More than budget weekdays old; weekdays are counted up to lookback days back, what is older is stale."""
    return F.when(F.datediff(today, newest) > lookback, F.lit(True)).otherwise(business_days(newest, today) > budget)


def cents(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def order_index(n: Column, confidence: float) -> Column:
    """0-based place of the loss quantile among n sorted returns."""
    return F.least(n - 1, F.floor(F.lit(1 - confidence) * n)).cast("int")


def tone(x: Column) -> Column:
    return F.when(x > 0, "positive").when(x < 0, "negative").otherwise("neutral")


def rounded(x: Column, digits: int) -> Column:
    """x with so many decimals, as SQL rounds doubles: half steps are told from x * 10^digits, where round goes by the shortest digits (333 / 640 is 0.5203125, but 520312.49999999994 millionths)."""
    scale = F.lit(10.0**digits)
    there = F.round(x * scale) / scale
    return F.when(F.abs(there) < float("inf"), there).otherwise(x)


def fixed(x: Column, digits: int) -> Column:
    """x with so many decimals, as C's printf rounds: by the double's own value (5.1815 lies below its half step), where format_string goes by its shortest digits."""
    shown = F.call_function("format_number", x, F.lit("0." + "0" * digits if digits else "0"))
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.format_string("%f", x)).otherwise(shown)


def percent(share: Column, digits: int = 1) -> Column:
    """0.5248 as 52.5%."""
    return F.concat(fixed(share * 100, digits), F.lit("%"))


def signed_percent(share: Column, digits: int = 3) -> Column:
    """0.00064 as +0.064%."""
    return F.concat(F.when(share > 0, "+").otherwise(""), percent(share, digits))


def ticker_label(ticker: Column, name: Column) -> Column:
    """TICKER - Name; the ticker alone without a name of its own."""
    return F.when(name.isNull() | (F.trim(name) == "") | (name == ticker), ticker).otherwise(F.concat(ticker, F.lit(" - "), name))


def signed_points(share: Column, digits: int = 1) -> Column:
    """0.711, a difference of shares, as +71.1 pts."""
    return F.concat(F.when(share > 0, "+").otherwise(""), fixed(share * 100, digits), F.lit(" pts"))
