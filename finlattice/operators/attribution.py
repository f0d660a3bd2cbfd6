"""Attribution of funds from holdings, prices and sector indices, with what was left out and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import portfolio
from .lookups import between


def back_filled_returns(primary: DataFrame, backup: DataFrame, key: str, start, end, value: str = "close", day: str = "trade_date") -> DataFrame:
    """key, ret, source: interval returns of the first source, of the second one for keys that the first cannot give."""
    one = lambda df: portfolio.interval_returns(between(df, start, end, day), [key], value, day)
    first = one(primary)
    rest = one(backup.join(first.select(key), key, "left_anti"))
    return first.withColumn("source", F.lit("primary")).unionByName(rest.withColumn("source", F.lit("backup")))


def attribute(holdings: DataFrame, mapping: DataFrame, prices: DataFrame, index_returns: DataFrame, benchmark: DataFrame, as_of, days: int = 90, level: str = "l1", method: str = "BF") -> tuple[DataFrame, DataFrame]:
    """Effects (fund, sector, ...) of every fund over the days up to as_of, and notes (fund, kind, value).

    holdings: fund, report_date, stock, weight; the last report by as_of counts, or the first one after it (noted as `later_report`).
    index_returns: sector, ret over the same days; benchmark: sector, weight.  Stocks without a sector are left out and the rest
    brought to one.  A sector counts if its index has a return and, where the fund holds it, any of its stocks have: sectors the fund does not hold
    stay in, with the benchmark's return, so that what was left unbought is allocation.
    """
    end = F.lit(as_of).cast("date")
    start = F.date_sub(end, days)
    choice = holdings.groupBy("fund").agg(F.max(F.when(F.col("report_date") <= end, F.col("report_date"))).alias("_by"), F.min("report_date").alias("_first"))
    held = holdings.join(choice, "fund").where(F.col("report_date") == F.coalesce("_by", "_first"))
    sectors = mapping.where(F.col(level).isNotNull()).groupBy("stock").agg(F.min(level).alias("sector"))  # of several sectors the first by name
    held = held.join(sectors, "stock", "left")
    priced = portfolio.interval_returns(prices.where((F.col("trade_date") >= start) & (F.col("trade_date") <= end)), ["stock"])
    held = held.join(priced, "stock", "left")

    known = F.col("sector").isNotNull()
    totals = held.groupBy("fund").agg(F.sum(F.when(known, F.col("weight"))).alias("_mapped"), F.sum(F.when(~known, F.col("weight"))).alias("_unmapped"), F.max(F.col("_by").isNull()).alias("_later")).where("_mapped > 0")
    seen = F.col("ret").isNotNull()
    own = held.where(known).groupBy("fund", "sector").agg(F.sum("weight").alias("w"), F.sum(F.when(seen, F.col("ret") * F.col("weight"))).alias("rw"), F.sum(F.when(seen, F.col("weight"))).alias("pw"))
    own = own.join(totals, "fund").select("fund", "sector", (F.col("w") / F.col("_mapped")).alias("wp"), F.when(F.col("pw") > 0, F.col("rw") / F.col("pw")).alias("rp"))
    grid = totals.select("fund").crossJoin(benchmark.select("sector", F.col("weight").alias("wb")))  # the result's own size: a row per fund and benchmark sector
    rows = grid.join(own, ["fund", "sector"], "full").join(index_returns.select("sector", F.col("ret").alias("rb")), "sector", "left")
    covered = F.col("rb").isNotNull() & ~((F.coalesce("wp", F.lit(0.0)) > 0) & F.col("rp").isNull())
    effects = portfolio.brinson(rows.where(covered), ["fund"], method)

    share = lambda w, holds: F.coalesce(F.sum(F.when(holds, F.col(w))), F.lit(0.0))
    sums = rows.groupBy("fund").agg(
        share("wp", covered).alias("portfolio_coverage"), share("wb", covered).alias("benchmark_coverage"), F.count_if(~covered).cast("double").alias("sectors_left_out"),
        F.count_if(covered & (F.col("wp") > 0) & F.col("wb").isNull()).cast("double").alias("not_in_benchmark"),
    ).join(totals.select("fund", F.coalesce("_unmapped", F.lit(0.0)).alias("unmapped_weight"), F.col("_later").cast("double").alias("later_report")), "fund")
    low = F.least("portfolio_coverage", "benchmark_coverage")
    kinds = {"portfolio_coverage": F.lit(True), "benchmark_coverage": F.lit(True), "low_coverage": low < 0.5, "sectors_left_out": F.col("sectors_left_out") > 0, "not_in_benchmark": F.col("not_in_benchmark") > 0, "unmapped_weight": F.col("unmapped_weight") > 1e-6, "later_report": F.col("later_report") > 0}
    sums = sums.withColumn("low_coverage", low)
    notes = sums.select("fund", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value"), holds.alias("holds")) for k, holds in kinds.items()))).alias("n")).where("n.holds")
    return effects, notes.select("fund", "n.kind", "n.value")
