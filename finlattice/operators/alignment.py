"""Joins along time: step sums, common dates, fixed key lists, fund returns, thinning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import keep, new_folder


def step_sums(steps: DataFrame, flows: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Per step the sum of `value` in (the step before, this step]: each flow is dealt to the first step at or after its day, no range join."""
    w = Window.partitionBy(*keys).orderBy(day, "_kind").rowsBetween(0, Window.unboundedFollowing)
    both = flows.select(*keys, day, F.col(value).alias("_v"), F.lit(0).alias("_kind")).unionByName(steps.select(*keys, day, F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_kind")))
    dealt = both.withColumn("_step", F.first(F.when(F.col("_kind") == 1, F.col(day)), ignorenulls=True).over(w))
    sums = dealt.where("_step is not null").groupBy(*keys, F.col("_step").alias(day)).agg(F.sum("_v").alias(value), F.count_if(F.col("_kind") == 0).alias("n"))
    first = steps.groupBy(*keys).agg(F.min(day).alias("_first"))
    return sums.join(first, keys).where(F.col(day) > F.col("_first")).drop("_first")


def common_days(series: DataFrame, name: str, day: str, value: str, last: int | None = None) -> DataFrame:
    """Rows of the days on which every series has a value, the last `last` of them."""
    rows = series.where(F.col(value).isNotNull())
    n = rows.select(name).distinct().agg(F.count(F.lit(1)).alias("_n"))
    days = rows.groupBy(day).agg(F.countDistinct(name).alias("_k")).join(F.broadcast(n), F.col("_k") == F.col("_n")).select(day)
    if last is not None:
        days = days.orderBy(F.desc(day)).limit(last)
    return rows.join(days, day, "left_semi")


def reindex(df: DataFrame, key: str, values: list) -> DataFrame:
    """One row per listed key in the list's order (pos); keys without a row have nulls."""
    listed = df.sparkSession.createDataFrame([(k, v) for k, v in enumerate(values)], f"pos int, {key} {dict(df.dtypes)[key]}")
    return F.broadcast(listed).join(df, key, "left").orderBy("pos")


def fund_returns(nav: DataFrame, keys: list[str], day: str, official: str = "pct", accumulated: str = "acc", unit: str = "nav") -> DataFrame:
    """Daily return: the published percentage, else the change of the accumulated value over the unit value before, else that of the unit value."""
    w = Window.partitionBy(*keys).orderBy(day)
    by_acc = F.try_divide(F.col(accumulated) - F.lag(accumulated).over(w), F.lag(unit).over(w))
    return nav.withColumn("r", F.coalesce(F.col(official) / 100, by_acc, F.try_divide(F.col(unit), F.lag(unit).over(w)) - 1))


def thinned(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """All rows if they are `most` at most, else rows floor(k * n / most) in order for k from 0: exactly `most`.

    Rows are written range by range with their number in the range, so the ranges' sizes give every row's place and no task sorts everything.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, "ranged")
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    sizes = sorted(tuple(r) for r in ranged.groupBy(F.shiftright("_id", 33)).count().collect())  # a row per partition
    n, before = 0, {}
    for part, size in sizes:
        before[part], n = n, n + size
    if n <= most:
        return ranged.drop("_id")
    offset = F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair))
    at = offset[F.shiftright("_id", 33)] + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    k = F.expr(f"(_at * {most} + {n - 1}) div {n}")  # the first k that reaches this row or a later one
    return ranged.withColumn("_at", at).withColumn("_k", k).where(f"_k < {most} and (_k * {n}) div {most} = _at").drop("_id", "_at", "_k")


def scatter(frame: DataFrame, fields: list[str], order: list[str], most: int = 400, least_percent: float = 50.0) -> tuple[list[str], DataFrame | None]:
    """The two fields that are named most often (ties by name) among those of enough values, and at most `most` rows that have both.

    ([], None) where fewer than two fields qualify.
    """
    named = sorted(dict.fromkeys(f for f in fields if f in frame.columns), key=lambda f: (-fields.count(f), f))
    frame = keep(frame, "scatter")  # counted, ranged by samples and written: made once
    counts = frame.agg(F.count(F.lit(1)).alias("n"), *(F.count(f).alias(f"c{k}") for k, f in enumerate(named))).first()
    chosen = [f for k, f in enumerate(named) if counts["n"] and 100.0 * counts[f"c{k}"] / counts["n"] >= least_percent][:2]
    if len(chosen) < 2:
        return [], None
    rows = frame.where(F.col(chosen[0]).isNotNull() & F.col(chosen[1]).isNotNull())
    return chosen, thinned(rows, order, most)


def price_maps(prices: DataFrame, keys: list[str], period, value: str, day: str) -> DataFrame:
    """Per key a map from period to the last value in it."""
    last = prices.groupBy(*keys, period.alias("_p")).agg(F.max_by(value, day).alias("_v"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_p", "_v")))).alias("values"))


def with_unavailable(df: DataFrame, by: str, wanted: list[str]) -> DataFrame:
    """Rows of the wanted names; a name without any has one row of nulls."""
    names = df.sparkSession.createDataFrame([(w,) for w in wanted], f"{by} string")
    return F.broadcast(names).join(df, by, "left")


def quarter_ends(first, last):
    """Array of quarter ends between two day columns."""
    start = F.trunc(first, "quarter")
    days = F.transform(F.sequence(start, last, F.expr("interval 3 months")), lambda d: F.last_day(F.add_months(d, 2)))
    return F.filter(days, lambda d: (d >= first) & (d <= last))


def excess_over_benchmark(df: DataFrame, bench: DataFrame, keys: list[str], period: str, value: str, base: str) -> DataFrame:
    """Value and benchmark rebased to 100 at the first common period, and their difference."""
    w = Window.partitionBy(*keys).orderBy(period).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.join(bench, period).where(F.col(value).isNotNull() & F.col(base).isNotNull())
    own, other = (F.col(c) * 100 / F.first(c).over(w) for c in (value, base))
    return rows.select(*keys, period, own.alias("own"), other.alias("benchmark"), (own - other).alias("excess"))
