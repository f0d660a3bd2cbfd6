"""A catalogue of commodities: last price, percentile and changes, and when a percentile would mislead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import seven_levels
from . import series
from .percentiles import percentile, stale

#: Days without a price after which a percentile is withheld, and prices that it needs.
STALE_DAYS, LEAST_SAMPLES = 15, 60


def by_symbol(registry: DataFrame, symbol: str) -> DataFrame:
    """The registry's row of a symbol in any case; none for an unknown one."""
    return registry.where(F.lower("symbol") == symbol.strip().lower())


def catalogue(registry: DataFrame, prices: DataFrame, today, years: int | None = 10) -> DataFrame:
    """A row per registered symbol: price, as_of, lag_days, stale, n, pct and level, changes over 30, 90 and 365 days in percent.

    prices: symbol, trade_date, close.  Prices older than `years` before the symbol's last day stay out.  The percentile is null where the last price is
    stale or the prices are too few (n is 0 then); symbols without a price keep their row.
    """
    last = prices.groupBy("symbol").agg(F.max("trade_date").alias("_last"))
    inside = prices if years is None else prices.join(last, "symbol").where(F.col("trade_date") > F.add_months("_last", -12 * years)).drop("_last")
    found = percentile(inside, ["symbol"], "close").select("symbol", F.col("current").alias("price"), "as_of", "pct", "n", "median", "low", "high")
    counted = inside.groupBy("symbol").agg(F.count("close").alias("_rows"))
    out = registry.join(found.join(counted, "symbol").join(series.changes(inside, ["symbol"], "close"), "symbol"), "symbol", "left")
    lag = F.datediff(F.lit(today).cast("date"), "as_of")
    enough = F.col("_rows") >= LEAST_SAMPLES
    return out.withColumns({
        "lag_days": lag, "stale": stale(F.lit(today).cast("date"), F.col("as_of"), STALE_DAYS), "n": F.when(enough, F.col("n")).otherwise(0),
        "pct": F.when(enough & (lag <= STALE_DAYS), F.col("pct")), **{c: F.when(enough, F.col(c)) for c in ("median", "low", "high")},
    }).withColumn("level", seven_levels("pct")).drop("_rows")
