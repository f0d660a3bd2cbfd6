"""Risk and performance measures of price and equity curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import correlation
from .series import by, drawdown, simple_return

YEAR = 252


def risk(prices: DataFrame, keys: list[str], value: str = "close", day: str = "trade_date", free: float = 0.02) -> DataFrame:
    """Per key: rows, geometric annual return, volatility, Sharpe, Sortino, Calmar and worst drawdown."""
    w = by(keys, day)
    rows = prices.where(F.col(value) > 0).select(*keys, day, value).withColumn("r", simple_return(value, w)).withColumn("dd", drawdown(value, w))
    out = rows.groupBy(*keys).agg(
        F.count("r").alias("n"), F.max_by(value, day).alias("last"), F.min_by(value, day).alias("first"), F.stddev_samp("r").alias("sd"),
        F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))).alias("down"), F.min("dd").alias("max_drawdown"),
    )
    out = out.where("n >= 2").withColumn("annual_return", F.pow(F.col("last") / F.col("first"), YEAR / F.col("n")) - 1).withColumn("volatility", F.col("sd") * YEAR**0.5)
    excess = F.col("annual_return") - free
    return out.select(
        *keys, "n", "annual_return", "volatility", F.try_divide(excess, "volatility").alias("sharpe"), F.try_divide(excess, F.col("down") * YEAR**0.5).alias("sortino"),
        F.try_divide(F.col("annual_return"), F.abs("max_drawdown")).alias("calmar"), "max_drawdown",
    )


def against_benchmark(returns: DataFrame, keys: list[str], own: str = "r", other: str = "b", free: float = 0.02) -> DataFrame:
    """Per key beta, annual alpha and R2 against benchmark returns on common days; null below three days or without variance."""
    both = returns.where(F.col(own).isNotNull() & F.col(other).isNotNull())
    out = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.covar_samp(own, other).alias("_c"), F.var_samp(other).alias("_v"), correlation(own, other).alias("_k"), F.avg(own).alias("_a"), F.avg(other).alias("_b")
    )
    able = (F.col("n") >= 3) & (F.col("_v") > 0)
    beta = F.when(able, F.col("_c") / F.col("_v"))
    daily = free / YEAR
    alpha = (F.col("_a") - daily - beta * (F.col("_b") - daily)) * YEAR
    return out.select(*keys, "n", beta.alias("beta"), alpha.alias("alpha"), F.when(able, F.col("_k") * F.col("_k")).alias("r_squared"))


def performance(equity: DataFrame, keys: list[str], value: str = "equity", day: str = "trade_date", target: float = 0.0) -> DataFrame:
    """The back-tester's measures of an equity curve: arithmetic annual return and downside root mean square."""
    w = by(keys, day)
    rows = equity.select(*keys, day, value).withColumn("r", simple_return(value, w)).withColumn("dd", drawdown(value, w))
    out = rows.groupBy(*keys).agg(
        F.count("r").alias("n"), F.max_by(value, day).alias("last"), F.min_by(value, day).alias("first"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"),
        F.sqrt(F.avg(F.pow(F.least(F.col("r") - target, F.lit(0.0)), F.lit(2)))).alias("down"), F.min("dd").alias("max_drawdown"),
    )
    out = out.withColumn("cagr", F.pow(F.try_divide("last", "first"), F.try_divide(F.lit(float(YEAR)), "n")) - 1).withColumn("annual_return", F.col("m") * YEAR).withColumn("volatility", F.col("s") * YEAR**0.5)
    return out.select(
        *keys, "cagr", "annual_return", "volatility", F.try_divide("annual_return", "volatility").alias("sharpe"), F.try_divide("annual_return", F.col("down") * YEAR**0.5).alias("sortino"),
        F.try_divide("cagr", F.abs("max_drawdown")).alias("calmar"), "max_drawdown",
    )


def closed_trades(trades: DataFrame, keys: list[str], pnl: str = "pnl") -> DataFrame:
    won, lost = F.sum(F.when(F.col(pnl) > 0, F.col(pnl))), F.sum(F.when(F.col(pnl) < 0, F.col(pnl)))
    return trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("trades"), F.avg((F.col(pnl) > 0).cast("double")).alias("win_rate"), F.try_divide(won, F.abs(lost)).alias("profit_factor"))


def all_metrics(equity: DataFrame, keys: list[str], trades: DataFrame | None = None, benchmark: DataFrame | None = None, value: str = "equity", day: str = "trade_date") -> DataFrame:
    """The eleven measures of a back-test: performance(), win rate and profit factor of the sales' realised results, turnover (traded amount over the
    mean of a positive equity; 0 without a trade) and the growth rate beyond the benchmark's.

    trades: keys, side, amount, pnl; benchmark: day and value for every key alike.
    """
    out = performance(equity, keys, value, day)
    mean = equity.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    if trades is None:
        out = out.withColumns({"win_rate": F.lit(None).cast("double"), "profit_factor": F.lit(None).cast("double"), "_traded": F.lit(0.0)})
    else:
        sold = closed_trades(trades.where("side = 'SELL' and pnl is not null"), keys).drop("trades")
        out = out.join(sold, keys, "left").join(trades.groupBy(*keys).agg(F.sum("amount").alias("_traded")), keys, "left")
    out = out.join(mean, keys).withColumn("turnover", F.when(F.col("_mean") > 0, F.coalesce("_traded", F.lit(0.0)) / F.col("_mean")))
    if benchmark is None:
        return out.withColumn("excess_return", F.lit(None).cast("double")).drop("_mean", "_traded")
    whole = performance(benchmark.select(F.lit(0).alias("_k"), day, value), ["_k"], value, day).select(F.col("cagr").alias("_b"))
    return out.crossJoin(F.broadcast(whole)).withColumn("excess_return", F.col("cagr") - F.col("_b")).drop("_mean", "_traded", "_b")  # one row
