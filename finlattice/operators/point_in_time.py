"""What was known on a day: universes, cross-sections and anchors without look-ahead."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def alive(as_of, listed="list_date", delisted="delist_date") -> Column:
    """Listed by the day and not delisted by it (the delisting day is out)."""
    return (F.col(listed).isNull() | (F.col(listed) <= as_of)) & (F.col(delisted).isNull() | (F.col(delisted) > as_of))


def universe(securities: DataFrame, as_of) -> DataFrame:
    return securities.where(alive(F.lit(as_of).cast("date")))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`; other columns settle ties, so the row is always the same one."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    newest = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_row"))  # partial maxima: a hot key stays small
    return newest.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in df.columns if c not in keys))


def cross_section(statements: DataFrame, as_of, keys=("ts_code",), order=("report_period", "available_date", "source")) -> DataFrame:
    """Each key's latest statement among those available on the day."""
    return latest(statements.where(F.col("available_date") <= F.lit(as_of).cast("date")), list(keys), list(order))


def with_previous_year(statements: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Adds <measure>_prev from the same period a year before (29 February meets the 28th)."""
    # every statement also stands a year later for its successor, so the statements are made once and meet in one exchange
    places = F.explode(F.array(F.struct(F.col("report_period").alias("at"), F.lit(True).alias("own")), F.struct(F.add_months("report_period", 12).alias("at"), F.lit(False).alias("own"))))
    rows = statements.select("*", places.alias("_place"))
    meet = Window.partitionBy(*keys, "_place.at")
    known = reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.col("_place.at").isNotNull())  # a null meets nothing
    rows = rows.withColumns({f"{m}_prev": F.when(known, F.max(F.when(~F.col("_place.own"), F.col(m))).over(meet)) for m in measures})
    return rows.where("_place.own").select(*keys, "report_period", *(c for c in statements.columns if c not in keys and c != "report_period"), *(f"{m}_prev" for m in measures))


def anchors(prices: DataFrame, as_of, days: dict[str, int], lookback: int = 400) -> DataFrame:
    """Per ts_code the last close and, for each name, its return since the last close at or before as_of - days."""
    end = F.lit(as_of).cast("date")
    window = prices.where((F.col("trade_date") <= end) & (F.col("trade_date") >= F.date_sub(end, lookback)))
    cuts = {n: F.date_sub(end, d) for n, d in days.items()}
    found = window.groupBy("ts_code").agg(
        F.max_by("close", "trade_date").alias("last_close"),
        *(F.max_by(F.when(F.col("trade_date") <= c, F.col("close")), F.when(F.col("trade_date") <= c, F.col("trade_date"))).alias(f"_{n}") for n, c in cuts.items()),
    )
    return found.select("ts_code", "last_close", *((F.try_divide("last_close", f"_{n}") - 1).alias(n) for n in days))


def price_inputs(prices: DataFrame, as_of, lookback: int = 400) -> DataFrame:
    """Per ts_code: returns over 1, 3, 6 and 12 months, volatility of daily returns over 6 and 12 months (not annualised) and the deepest drawdown of 12 months.

    The look-back bounds a code's window; the first return inside a volatility's window is unknown.
    """
    end = F.lit(as_of).cast("date")
    rows = prices.where((F.col("trade_date") <= end) & (F.col("trade_date") >= F.date_sub(end, lookback))).select("ts_code", "trade_date", F.col("close").cast("double").alias("close"))
    w = Window.partitionBy("ts_code").orderBy("trade_date")
    year = F.date_sub(end, 365)
    rows = rows.withColumns({"_before": F.lag("trade_date").over(w), "_r": F.try_divide(F.col("close"), F.lag("close").over(w)) - 1})
    peak = F.max(F.when(F.col("trade_date") >= year, F.col("close"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_dd", F.when(F.col("trade_date") >= year, F.try_divide(F.col("close"), peak) - 1))
    last = F.max_by("close", "trade_date")
    at = lambda d: F.max_by(F.when(F.col("trade_date") <= F.date_sub(end, d), F.col("close")), F.when(F.col("trade_date") <= F.date_sub(end, d), F.col("trade_date")))
    return rows.groupBy("ts_code").agg(
        *((F.try_divide(last, at(d)) - 1).alias(n) for n, d in (("ret_1m", 30), ("ret_3m", 90), ("ret_6m", 180), ("ret_12m", 365))),
        *(F.stddev_samp(F.when(F.col("_before") >= F.date_sub(end, d), F.col("_r"))).alias(n) for n, d in (("vol_6m", 180), ("vol_12m", 365))), F.min("_dd").alias("max_dd_12m"),
    )


def step_factors(prices: DataFrame, events: DataFrame, key="ts_code", day="trade_date", factor="factor") -> DataFrame:
    """Adjustment factors as a step function: each price takes the last factor at or before its day, 1 before the first."""
    both = prices.select("*", F.lit(None).cast("double").alias("_f")).unionByName(events.select(key, day, F.col(factor).cast("double").alias("_f")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(day, F.col("_f").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    stepped = both.withColumn(factor, F.coalesce(F.last("_f", ignorenulls=True).over(w), F.lit(1.0)))
    return stepped.where("_f is null").drop("_f")


def latest_of(df: DataFrame, key: str, value, as_of=None, day: str = "available_date", order: tuple[str, ...] = ()) -> DataFrame:
    """The last row of one key by its day (then `order`) among those at or before as_of; no row where there is none."""
    mine = df.where(F.col(key) == F.lit(value))
    mine = mine if as_of is None else mine.where(F.col(day) <= F.lit(as_of).cast("date"))
    return mine.orderBy(F.desc_nulls_last(day), *(F.desc_nulls_last(c) for c in order)).limit(1)


def adjusted(prices: DataFrame, events: DataFrame, key="ts_code", day="trade_date", close="close", factor="factor", digits: int = 4) -> DataFrame:
    """Prices with `forward` (over the code's last factor) and `backward` (times the factor) adjusted closes, rounded."""
    stepped = step_factors(prices, events, key, day, factor)
    last = stepped.groupBy(key).agg(F.max_by(factor, day).alias("_last"))
    out = stepped.join(last, key)
    return out.withColumns({"forward": F.round(F.try_divide(F.col(close) * F.col(factor), F.col("_last")), digits), "backward": F.round(F.col(close) * F.col(factor), digits)}).drop("_last")
