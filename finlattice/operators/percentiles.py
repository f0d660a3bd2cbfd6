"""Historical valuation percentiles and market-wide distributions.

A percentile is the share of strictly smaller values among the positive ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import seven_levels

EDGES = (0, 10, 20, 30, 40, 50, 70, 100, 1000)


def _summary(values: str) -> dict:
    """n, below, extremes and median of an array of positive values, against `current`."""
    sorted_ = F.array_sort(values)
    n = F.size(values)
    middle = (F.get(sorted_, F.floor((n - 1) / 2).cast("int")) + F.get(sorted_, F.floor(n / 2).cast("int"))) / 2
    below = F.size(F.filter(values, lambda x: x < F.col("current")))
    return {"below": below.cast("long"), "n": n.cast("long"), "low": F.array_min(values), "median": middle, "high": F.array_max(values)}


def _judged(rows: DataFrame, keys: list[str]) -> DataFrame:
    rows = rows.where(F.size("values") > 0).withColumns(_summary("values"))
    rows = rows.withColumn("pct", F.when(F.col("current") > 0, F.col("below") * 100.0 / F.col("n"))).withColumn("level", seven_levels("pct"))
    return rows.select(*keys, "current", "as_of", "n", "low", "median", "high", "pct", "level")


def percentile(history: DataFrame, keys: list[str], value: str, day: str = "trade_date") -> DataFrame:
    """Per key: current (latest not null, may be not positive: no percentile then), pct, n, min, median, max, level.

    One aggregation: a key's positive values, a day each, are gathered and ranked in place.
    """
    v = F.col(value).cast("double")
    rows = history.where(v.isNotNull()).groupBy(*keys).agg(F.max_by(v, day).alias("current"), F.max(day).alias("as_of"), F.collect_list(F.when(v > 0, v)).alias("values"))
    return _judged(rows, keys)


def unpivot(history: DataFrame, keys: list[str], indicators: list[str]) -> DataFrame:
    return history.unpivot(keys, indicators, "indicator", "value")


def windows(history: DataFrame, keys: list[str], value: str, years: dict[str, int | None], day: str = "trade_date") -> DataFrame:
    """percentile() over several spans back from each key's last day; a key's values are gathered once and filtered by span."""
    v = F.col(value).cast("double")
    spans = F.array(*(F.struct(F.lit(n).alias("span"), F.lit(12 * (y or 1000)).alias("months")) for n, y in years.items()))
    rows = history.groupBy(*keys).agg(F.max(day).alias("_last"), F.collect_list(F.when(v.isNotNull(), F.struct(F.col(day).alias("d"), v.alias("v")))).alias("_all"))
    rows = rows.select(*keys, "_last", "_all", F.explode(spans).alias("_s"))
    rows = rows.select(*keys, F.col("_s.span").alias("span"), F.filter("_all", lambda x: x["d"] > F.add_months("_last", -F.col("_s.months"))).alias("_in"))
    newest = F.array_max("_in")
    positive = F.transform(F.filter("_in", lambda x: x["v"] > 0), lambda x: x["v"])
    rows = rows.select(*keys, "span", newest["v"].alias("current"), newest["d"].alias("as_of"), positive.alias("values"))
    return _judged(rows, [*keys, "span"])


def profile_ratios(profile: DataFrame, buckets: DataFrame, representative: int = 1000) -> DataFrame:
    """bucket, n, ratio of the valid values, with the profile's coverage (valid of all) and whether it is representative."""
    one = profile.select("valid", F.try_divide("valid", "total").alias("coverage"), (F.col("valid") >= representative).alias("representative"))
    return buckets.crossJoin(F.broadcast(one)).select(*buckets.columns, F.try_divide("n", "valid").alias("ratio"), "coverage", "representative")  # one row


def deciles(ranked: DataFrame, pct: str = "pct") -> DataFrame:
    return ranked.where(F.col(pct).isNotNull()).groupBy(F.least(F.floor(F.col(pct) / 10), F.lit(9)).cast("int").alias("decile")).agg(F.count(F.lit(1)).alias("n"), F.median(pct).alias("median_pct"))


def profile(cross: DataFrame, value: str, extreme: float = 1000.0) -> DataFrame:
    """One row: counts, extremes, mean, trimmed mean, median and quantiles of the positive values."""
    v = F.col(value)
    good = F.when(v > 0, v)
    shares = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
    return cross.agg(
        F.count(F.lit(1)).alias("total"), F.count(good).alias("valid"), F.count_if(v.isNull()).alias("missing"), F.count_if(v <= 0).alias("not_positive"), F.count_if(v > extreme).alias("extreme"),
        F.min(good).alias("low"), F.max(good).alias("high"), F.avg(good).alias("mean"), F.avg(F.when(v <= extreme, good)).alias("trimmed_mean"), F.percentile(good, F.array(*map(F.lit, shares))).alias("quantiles"),
    )


def histogram(cross: DataFrame, value: str, edges=EDGES) -> DataFrame:
    """Left-open, right-closed buckets, the last open-ended; empty ones stay."""
    spark = cross.sparkSession
    names = [f"{a}-{b}" for a, b in zip(edges, edges[1:])] + [f">{edges[-1]}"]
    bucket = F.when(F.col(value) > edges[-1], len(edges) - 1)
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        bucket = bucket.when((F.col(value) > a) & (F.col(value) <= b), k)
    counts = cross.where(F.col(value) > 0).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    labels = spark.createDataFrame(list(enumerate(names)), "bucket int, label string")
    return labels.join(counts, "bucket", "left").select("bucket", "label", F.coalesce("n", F.lit(0)).alias("n"))


def by_market(cross: DataFrame, value: str, market: str = "market") -> DataFrame:
    rows = cross.where((F.trim(market) != "") & (F.col(value) > 0))
    return rows.groupBy(market).agg(F.count(F.lit(1)).alias("n"), F.median(value).alias("median"), F.min(value).alias("low"), F.max(value).alias("high"))


def stale(as_of, last, most_days: int):
    return F.datediff(as_of, last) > most_days
