"""Holdings-based exposure and attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import correlation


def sector_weights(constituents: DataFrame, mapping: DataFrame, by: list[str], level: str = "l1", weight: str = "weight") -> DataFrame:
    """Weight of each sector within the mapped part of each group, and the share of weight that is mapped.

    A stock that the mapping has twice belongs to its first sector by name.
    """
    once = mapping.groupBy("stock").agg(F.min(level).alias("sector"))  # a row per stock: Spark broadcasts it when it is small
    joined = constituents.join(once, "stock", "left")
    sums = joined.groupBy(*by, "sector").agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("stocks"))
    group = Window.partitionBy(*by)  # a row per sector; the totals are of these very sums, so a sector that stands alone weighs exactly 1
    totals = sums.withColumns({"all_w": F.sum("w").over(group), "mapped_w": F.sum(F.when(F.col("sector").isNotNull(), F.col("w"))).over(group)})
    return totals.where("sector is not null").select(*by, "sector", "stocks", F.try_divide("w", "mapped_w").alias("weight"), F.try_divide("mapped_w", "all_w").alias("coverage"))


def interval_returns(prices: DataFrame, keys: list[str], value: str = "close", day: str = "trade_date") -> DataFrame:
    """Last over first less 1, for keys of two rows or more and a positive first value."""
    rows = prices.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min_by(value, day).alias("a"), F.max_by(value, day).alias("b"))
    return rows.where((F.col("n") >= 2) & (F.col("a") > 0)).select(*keys, (F.col("b") / F.col("a") - 1).alias("ret"))


def weighted_return(rows: DataFrame, by: list[str], ret: str = "ret", weight: str = "weight") -> DataFrame:
    """Weighted average over the rows with a return; groups without positive weight go."""
    priced = rows.where(F.col(ret).isNotNull() & F.col(weight).isNotNull())
    return priced.groupBy(*by).agg(F.sum(F.col(ret) * F.col(weight)).alias("s"), F.sum(weight).alias("w")).where("w > 0").select(*by, (F.col("s") / F.col("w")).alias("ret"))


def brinson(sectors: DataFrame, by: list[str], method: str = "BF") -> DataFrame:
    """Effects of each sector from wp, wb, rp, rb; weights are brought to a sum of one, missing ones are zero.

    BF: allocation (wp-wb)(rb-RB), selection wb(rp-rb), interaction (wp-wb)(rp-rb).  HB: selection wp(rp-rb), no interaction.
    """
    zero = F.lit(0.0)
    rows = sectors.withColumns({c: F.coalesce(c, zero) for c in ("wp", "wb")})
    rows = rows.withColumn("rb", F.coalesce("rb", zero)).withColumn("rp", F.coalesce("rp", "rb"))
    sums = rows.groupBy(*by).agg(F.sum("wp").alias("sp"), F.sum("wb").alias("sb"), F.sum(F.col("wb") * F.col("rb")).alias("rbw"))
    rows = rows.join(sums, by)
    rows = rows.withColumn("wp", F.when(F.col("sp") > 0, F.col("wp") / F.col("sp")).otherwise(F.col("wp"))).withColumn("wb", F.when(F.col("sb") > 0, F.col("wb") / F.col("sb")).otherwise(F.col("wb")))
    total = F.when(F.col("sb") > 0, F.col("rbw") / F.col("sb")).otherwise(F.col("rbw"))
    tilt, skill = F.col("wp") - F.col("wb"), F.col("rp") - F.col("rb")
    selection, interaction = (F.col("wb") * skill, tilt * skill) if method == "BF" else (F.col("wp") * skill, zero)
    return rows.select(*by, "sector", "wp", "wb", "rp", "rb", (tilt * (F.col("rb") - total)).alias("allocation"), selection.alias("selection"), interaction.alias("interaction"))


def attribution_totals(effects: DataFrame, by: list[str]) -> DataFrame:
    return effects.groupBy(*by).agg(
        *(F.sum(c).alias(c) for c in ("allocation", "selection", "interaction")), F.sum(F.col("wp") * F.col("rp") - F.col("wb") * F.col("rb")).alias("excess")
    )


def compare_maps(left: DataFrame, right: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """Correlation of two maps on common keys (null below three), their number and the share of the union they cover."""
    both = left.select(*by, key, F.col(value).alias("a")).join(right.select(*by, key, F.col(value).alias("b")), [*by, key], "full")
    common = F.col("a").isNotNull() & F.col("b").isNotNull()
    out = both.groupBy(*by).agg(F.count_if(common).alias("common"), F.count(F.lit(1)).alias("keys"), correlation(F.when(common, F.col("a")), F.when(common, F.col("b"))).alias("c"))
    return out.select(*by, "common", F.when(F.col("common") >= 3, F.col("c")).alias("correlation"), (F.col("common") / F.col("keys")).alias("coverage"))


def top_differences(left: DataFrame, right: DataFrame, by: list[str], key: str, value: str, k: int = 10) -> DataFrame:
    """The k keys of each group whose values differ most (a missing one is 0), ties by key; the rank is the report's."""
    both = left.select(*by, key, F.col(value).alias("a")).join(right.select(*by, key, F.col(value).alias("b")), [*by, key], "full")
    rows = both.select(*by, key, F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b")).withColumn("difference", F.col("a") - F.col("b"))
    w = Window.partitionBy(*by).orderBy(F.desc(F.abs("difference")), key)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
