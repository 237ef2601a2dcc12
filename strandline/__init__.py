"""Analytics over panels of daily returns, as Spark plans."""
