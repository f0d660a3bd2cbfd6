"""Weights of benchmarks by sector: stored ones where there are any, else made from constituents, with what to know about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import keep
from ..sources.store import SPECS, KeyedTable
from . import portfolio

_KINDS = {"benchmark_code": T.StringType(), "level": T.IntegerType(), "sector_code": T.StringType(), "weight": T.DoubleType(), "coverage": T.DoubleType(), "as_of_date": T.DateType()}
SCHEMA = T.StructType([T.StructField(c, kind) for c, kind in _KINDS.items()])
#: A snapshot older than this is stale: a remark, no refusal.
STALE_DAYS = 45


def table(spark, path: str) -> KeyedTable:
    return KeyedTable(spark, path, SCHEMA, SPECS["benchmark_weights"])


def refresh(stored: KeyedTable, codes: DataFrame, constituents: DataFrame, mapping: DataFrame, level: int) -> None:
    """Replace the weights of these benchmarks (benchmark_code) by their constituents' of the last day (benchmark_code, as_of_date, stock, weight), mapped to sectors."""
    mine = constituents.join(codes.select("benchmark_code").distinct(), "benchmark_code", "left_semi")
    last = mine.groupBy("benchmark_code").agg(F.max("as_of_date").alias("as_of_date"))
    found = portfolio.sector_weights(mine.join(last, ["benchmark_code", "as_of_date"]), mapping, ["benchmark_code", "as_of_date"], f"l{level}")
    stored.replace(keep(found.select("benchmark_code", F.lit(level).alias("level"), F.col("sector").alias("sector_code"), "weight", "coverage", "as_of_date"), "weights"), ["benchmark_code", "level"])  # few rows, which the write reads several times


def snapshot(stored: KeyedTable, codes: DataFrame, constituents: DataFrame, mapping: DataFrame, level: int, today, anew: bool = False) -> tuple[DataFrame, DataFrame]:
    """(weights, notes): stored weights of the benchmarks that have any, the others' (with `anew`, all) made now and stored.

    notes: benchmark_code, level, as_of_date, coverage, sector_count, cached, stale, reason; the reason tells why there are no weights.
    """
    codes = codes.select("benchmark_code").distinct()
    there = stored.read().where(F.col("level") == level).select("benchmark_code").distinct()
    cached = [r[0] for r in there.join(codes, "benchmark_code", "left_semi").collect()] if not anew else []  # as many as were asked for
    missing = codes.where(~F.col("benchmark_code").isin(cached)) if cached else codes
    if not missing.isEmpty():
        refresh(stored, missing, constituents, mapping, level)
    weights = stored.read().where(F.col("level") == level).join(codes, "benchmark_code", "left_semi")
    known = weights.groupBy("benchmark_code").agg(F.max("as_of_date").alias("as_of_date"), F.max("coverage").alias("coverage"), F.count(F.lit(1)).alias("sector_count"))
    any_of = constituents.groupBy("benchmark_code").agg(F.lit(True).alias("_any"))
    notes = codes.join(known, "benchmark_code", "left").join(any_of, "benchmark_code", "left")
    reason = F.when(F.col("sector_count").isNotNull(), F.lit(None)).when(F.col("_any").isNull(), "no constituents").otherwise("no constituent has a sector")
    is_cached = F.col("benchmark_code").isin(cached) if cached else F.lit(False)
    stale = F.coalesce(F.datediff(F.lit(today).cast("date"), "as_of_date") > STALE_DAYS, F.lit(True)) & is_cached
    notes = notes.select("benchmark_code", F.lit(level).alias("level"), "as_of_date", "coverage", F.coalesce("sector_count", F.lit(0)).alias("sector_count"), is_cached.alias("cached"), stale.alias("stale"), reason.alias("reason"))
    return weights, notes
