"""Reads by key, day and list, registries and stamps of what was read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Commodities (symbol, name, category, unit, source symbol, order) and benchmark indices.
COMMODITIES = (
    ("crude_oil", "原油", "能源", "元/桶", "SC0", 10),
    ("coke", "焦炭", "能源", "元/吨", "J0", 20),
    ("iron_ore", "铁矿石", "黑色系", "元/吨", "I0", 30),
    ("rebar", "螺纹钢", "黑色系", "元/吨", "RB0", 40),
    ("copper", "铜", "有色金属", "元/吨", "CU0", 50),
    ("aluminum", "铝", "有色金属", "元/吨", "AL0", 60),
    ("gold", "黄金", "贵金属", "元/克", "AU0", 70),
    ("live_hog", "生猪", "农产品", "元/吨", "LH0", 80),
    ("soybean_meal", "豆粕", "农产品", "元/吨", "M0", 90),
    ("natural_rubber", "天然橡胶", "农产品", "元/吨", "RU0", 100),
)
BENCHMARKS = (
    ("000300.SH", "沪深300"),
    ("000905.SH", "中证500"),
    ("000852.SH", "中证1000"),
    ("000906.SH", "中证800"),
    ("000985.SH", "中证全指"),
    ("399001.SZ", "深证成指"),
    ("000001.SH", "上证指数"),
    ("399106.SZ", "深证综指"),
)


def register_frame(spark: SparkSession, rows: list[tuple], schema: str, name: str) -> DataFrame:
    """Rows in memory as a view that SQL can name."""
    df = spark.createDataFrame(rows, schema)
    df.createOrReplaceTempView(name)
    return df


def commodities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COMMODITIES), "symbol string, name string, category string, unit string, source_symbol string, sort_order int").orderBy("sort_order")


def benchmarks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BENCHMARKS), "index_code string, index_name string")


def between(df: DataFrame, start=None, end=None, day: str = "trade_date") -> DataFrame:
    """Days from start to end, both included; an open end where one is None."""
    for bound, holds in ((start, F.col(day) >= F.lit(start).cast("date")), (end, F.col(day) <= F.lit(end).cast("date"))):
        df = df.where(holds) if bound is not None else df
    return df


def by_key(df: DataFrame, key: str, value, start=None, end=None, day: str = "trade_date") -> DataFrame:
    """One key's rows between two days, oldest first."""
    return between(df.where(F.col(key) == F.lit(value)), start, end, day).orderBy(day)


def on_day(df: DataFrame, value, key: str = "ts_code", day: str = "trade_date") -> DataFrame:
    return df.where(F.col(day) == F.lit(value).cast("date")).orderBy(key)


def in_keys(df: DataFrame, key: str, values: list | None, since=None, day: str = "trade_date", most_literals: int = 500) -> DataFrame:
    """Series of several keys: None is all of them, an empty list none; long lists are joined instead of spelled out."""
    if values is not None:
        wanted = list(dict.fromkeys(values))
        if len(wanted) <= most_literals:
            df = df.where(F.col(key).isin(wanted)) if wanted else df.where("1 = 0")
        else:
            keys = df.sparkSession.createDataFrame([(v,) for v in wanted], df.select(key).schema)
            df = df.join(keys, key, "left_semi")
    return between(df, since, None, day)


def bare_symbol(symbol: str) -> Column:
    """Index symbols with and without the vendor's suffix are one."""
    return F.regexp_replace(F.upper(F.trim(symbol)), r"\.SI$", "")


def by_symbols(df: DataFrame, symbol: str, wanted: list[str]) -> DataFrame:
    """Rows of symbols in any spelling; the stored spelling stays."""
    names = df.sparkSession.createDataFrame([(w,) for w in wanted], "w string").select(bare_symbol("w").alias("_bare")).distinct()
    return df.withColumn("_bare", bare_symbol(symbol)).join(F.broadcast(names), "_bare", "left_semi").drop("_bare")  # as long as the request


def find(df: DataFrame, order: list[Column] = (), **equal) -> DataFrame:
    """Rows whose columns have the given values (None is ignored), in a fixed order."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df.orderBy(*order) if order else df


def latest_effective(df: DataFrame, keys: list[str], as_of=None, day: str = "effective_date") -> DataFrame:
    """Each key's rows of its last effective day (by as_of, if given)."""
    seen = between(df, None, as_of, day)
    return seen.join(seen.groupBy(*keys).agg(F.max(day).alias(day)), [*keys, day])


def positive_histories(df: DataFrame, codes: list, indicator: str, key: str = "ts_code", day: str = "trade_date") -> DataFrame:
    return in_keys(df, key, codes, None, day).where(F.col(indicator) > 0).select(key, day, indicator)


def local_first(local: DataFrame, remote: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """What to answer with, and what to write back: remote rows count only where local has none of their keys."""
    missing = remote.join(local.select(*keys).distinct(), keys, "left_anti")
    return local.unionByName(missing), missing


def version_stamp(df: DataFrame, schema_version: int, as_of, day: str = "trade_date") -> DataFrame:
    """schema_v<n>@<last day by as_of> of a table, as one row."""
    last = F.max(F.when(F.col(day) <= F.lit(as_of).cast("date"), F.col(day)))
    return df.agg(F.concat(F.lit(f"schema_v{schema_version}@"), F.coalesce(F.date_format(last, "yyyy-MM-dd"), F.lit("none"))).alias("data_version"))


def snapshot_day(df: DataFrame, today, most_days: int = 7, day: str = "trade_date") -> DataFrame:
    """The trading day that a snapshot of today belongs to: the last stored one unless it is too old, then today."""
    today = F.lit(today).cast("date")
    last = F.max(F.when(F.col(day) <= today, F.col(day)))
    return df.agg(F.when(F.datediff(today, last) <= most_days, last).otherwise(today).alias("trade_date"))


def since_by_entity(entities: DataFrame, items: DataFrame, key: str, published: str, today, look_back: int = 30) -> DataFrame:
    """key, since, undated: each entity's last published time, or so many days back without one; how many items have no time."""
    seen = items.groupBy(key).agg(F.max(published).alias("last"), F.count_if(F.col(published).isNull()).alias("undated"))
    start = F.date_sub(F.lit(today).cast("date"), look_back).cast("timestamp")
    return entities.select(key).join(seen, key, "left").select(key, F.coalesce("last", start).alias("since"), F.coalesce("undated", F.lit(0)).alias("undated"))
