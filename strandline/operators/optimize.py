"""Long-only mean-variance portfolios.

Means and covariances are Spark aggregates; a grouped kernel then iterates on
one small matrix per group (as wide as the group has series).
"""

from __future__ import annotations

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline import config
from strandline.config import DEFAULT, Config
from strandline.functions import portfolio
from strandline.functions.portfolio import frontier_of, least_variance, point
from strandline.operators import metrics

for _module in (config, portfolio):  # their code goes with the job
    cloudpickle.register_pickle_by_value(_module)


def portfolios(returns: DataFrame, *by: str, cfg: Config = DEFAULT, kinds: tuple[str, ...] = ("frontier", "min_variance", "max_sharpe")) -> DataFrame:
    """keys, kind, point, series_id, w, volatility, expected_return, sharpe.

    Groups with fewer than two series or frontier_rows complete days have no rows.
    """
    cov = metrics.covariance(returns, *by)
    mu = metrics.means(returns, *by).select(*by, F.col("series_id").alias("a"), "mu")
    rows = cov.join(mu, [*by, "a"]).where(F.col("n") >= cfg.frontier_rows)
    keys = list(by) or ["_all"]
    rows = rows if by else rows.withColumn("_all", F.lit(0))
    kept = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        cov = group.pivot(index="a", columns="b", values="cov").sort_index().sort_index(axis=1)
        mean = group.drop_duplicates("a").set_index("a")["mu"].sort_index()
        head = {k: group[k].iloc[0] for k in keys}
        out = []
        if len(mean) > 1:
            c, m = cov.to_numpy(), mean.to_numpy()
            found = frontier_of(m, c, cfg) if set(kinds) != {"min_variance"} else [("min_variance", least_variance(c, cfg.frontier_steps))]
            for i, (kind, w) in enumerate(found):
                if kind in kinds:
                    vol, back, ratio = point(w, m, c, cfg)
                    out.append(pd.DataFrame(head | {"kind": kind, "point": i, "series_id": mean.index, "w": w, "volatility": vol, "expected_return": back, "sharpe": ratio}))
        names = [*keys, "kind", "point", "series_id", "w", "volatility", "expected_return", "sharpe"]
        return pd.concat(out) if out else pd.DataFrame({n: [] for n in names})

    schema = ", ".join(f"{k} {kept[k]}" for k in keys) + ", kind string, point int, series_id string, w double, volatility double, expected_return double, sharpe double"
    found = rows.groupBy(*keys).applyInPandas(solve, schema)
    return found if by else found.drop("_all")


def uniform(*parts) -> F.Column:
    """A number in (0, 1) from the MD5 of its parts: the same in every engine and partitioning."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") + 0.5) / F.lit(2.0**32)


def cloud(returns: DataFrame, cfg: Config = DEFAULT, seed: int = 1) -> DataFrame:
    """point, volatility, expected_return of random weights, even over the simplex."""
    spark = returns.sparkSession
    mu = metrics.means(returns)
    draws = spark.range(cfg.cloud_points).select(F.col("id").alias("point")).crossJoin(mu.select("series_id", "mu"))  # points x series
    draws = draws.withColumn("e", -F.ln(uniform(F.lit(seed), F.col("point"), F.col("series_id"))))
    draws = draws.withColumn("w", F.col("e") / F.sum("e").over(Window.partitionBy("point")))
    back = draws.groupBy("point").agg((F.sum(F.col("w") * F.col("mu")) * cfg.trading_days).alias("expected_return"))
    cov = metrics.covariance(returns).select("a", "b", "cov")
    wa = draws.select("point", F.col("series_id").alias("a"), F.col("w").alias("wa"))
    wb = draws.select("point", F.col("series_id").alias("b"), F.col("w").alias("wb"))
    spread = wa.join(cov, "a").join(wb, ["point", "b"]).groupBy("point").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("wa") * F.col("wb") * F.col("cov"))) * cfg.trading_days).alias("volatility"))
    return back.join(spread, "point")
