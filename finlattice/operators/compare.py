"""Several indicators and several securities side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import percentiles


def merge_indicators(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row per key with every indicator that any frame has for it."""
    return reduce(lambda a, b: a.join(b, keys, "full"), frames)


def month_join(prices: DataFrame, other: DataFrame, keys: list[str], day: str = "trade_date") -> DataFrame:
    """prices with the columns of other from the same month, whatever the day; null where the month has none.

    other has one row for a key and month; of several, the last day's counts.
    """
    values = [c for c in other.columns if c not in (*keys, day)]
    month = lambda df: df.withColumn("_month", F.trunc(day, "month"))
    monthly = month(other).groupBy(*keys, "_month").agg(*(F.max_by(c, day).alias(c) for c in values))
    return month(prices).join(monthly, [*keys, "_month"], "left").drop("_month")


def compare_page(history: DataFrame, names: DataFrame, codes: list, indicators: list[str], years: int | None = None, least: int = 2, most: int = 10, least_samples: int = 2) -> DataFrame:
    """ts_code, name, indicator, current, pct, median, low, high, n, level for two to ten codes; codes without history have a row of nulls each."""
    codes = list(dict.fromkeys(codes))
    if not least <= len(codes) <= most:
        raise ValueError(f"{least} to {most} codes can be compared, not {len(codes)}")
    rows = history.where(F.col("ts_code").isin(codes)).select("ts_code", "trade_date", *indicators)
    if years:
        rows = rows.crossJoin(F.broadcast(rows.agg(F.max("trade_date").alias("_last")))).where(F.col("trade_date") >= F.add_months("_last", -12 * years)).drop("_last")  # one row
    found = percentiles.percentile(percentiles.unpivot(rows, ["ts_code", "trade_date"], indicators), ["ts_code", "indicator"], "value")
    asked = history.sparkSession.createDataFrame([(c, i) for c in codes for i in indicators], "ts_code long, indicator string")
    out = asked.join(found, ["ts_code", "indicator"], "left").join(names.select("ts_code", "name"), "ts_code", "left")
    pct = F.when(F.col("n") >= least_samples, F.col("pct"))
    return out.select("ts_code", "name", "indicator", "current", pct.alias("pct"), "median", "low", "high", "n", "level")


def extremes(rows: DataFrame, value: str, key: str, k: int = 10) -> DataFrame:
    """The k lowest and the k highest rows by value (ties by key) with side and place; the rank is the report's, so Spark keeps k rows a task."""
    ends = []
    for side, order in (("lowest", F.asc(value)), ("highest", F.desc(value))):
        top = rows.where(F.col(value).isNotNull()).orderBy(order, key).limit(k)
        ends.append(top.withColumn("side", F.lit(side)).withColumn("place", F.row_number().over(Window.partitionBy("side").orderBy(order, key))))
    return ends[0].unionByName(ends[1])


def ranked(rows: DataFrame, by: list[str], value: str, key: str) -> DataFrame:
    """place of each row in its group by value (ties by key; none without a value) and the number of rows that have one."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last(value), key)
    out = rows.withColumn("_n", F.row_number().over(w)).withColumn("ranked", F.count(value).over(Window.partitionBy(*by)))
    return out.withColumn("place", F.when(F.col(value).isNotNull(), F.col("_n"))).drop("_n")


def watch(watched: DataFrame, values: DataFrame, key: str, value: str, threshold: str = "threshold") -> DataFrame:
    """One row: watched keys, those below their threshold, those without a value, and the median value."""
    rows = watched.join(values.select(key, value), key, "left")
    return rows.agg(F.count(F.lit(1)).alias("watched"), F.count_if(F.col(value) < F.col(threshold)).alias("alerted"), F.count_if(F.col(value).isNull()).alias("missing"), F.median(value).alias(f"median_{value}"))
