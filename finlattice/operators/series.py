"""Time-series operators over (key, day, value) rows; each key is one window partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by(keys: list[str], day: str = "trade_date"):
    return Window.partitionBy(*keys).orderBy(day)


def simple_return(value: str, w) -> Column:
    return F.try_divide(F.col(value), F.lag(value).over(w)) - 1


def moving_average(value: str, n: int, w) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) == n, F.avg(value).over(frame))


def drawdown(value: str, w) -> Column:
    return F.try_divide(F.col(value), F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1


def rolling_zscore(value: str, w, n: int = 20, least: int = 5, eps: float = 1e-8) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    z = (F.col(value) - F.avg(value).over(frame)) / (F.stddev_samp(value).over(frame) + eps)
    return F.when(F.count(value).over(frame) >= least, z)


def forward_fill(value: str, w) -> Column:
    return F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def rebased(value: str, w) -> Column:
    """100 at the first valid point."""
    first = F.first(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.try_divide(F.col(value) * 100, first)


def drawdown_episodes(df: DataFrame, keys: list[str], value: str, day: str = "trade_date") -> DataFrame:
    """Per key the deepest drawdown with its peak, first trough and first recovery, lengths in rows."""
    w = by(keys, day)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.where(F.col(value).isNotNull()).withColumn("pos", F.row_number().over(w)).withColumn("peak", F.max(value).over(run)).withColumn("dd", F.col(value) / F.col("peak") - 1)
    rows = rows.withColumn("peak_at", F.max(F.when(F.col(value) == F.col("peak"), F.struct("pos", F.col(day).alias("day")))).over(run))
    deepest = rows.groupBy(*keys).agg(F.min(F.struct("dd", "pos", F.col(day).alias("trough_date"), "peak", "peak_at")).alias("t"))
    after = rows.select(*keys, "pos", day, value).join(deepest, keys).where((F.col("pos") > F.col("t.pos")) & (F.col(value) >= F.col("t.peak")))
    recovery = after.groupBy(*keys).agg(F.min(F.struct("pos", F.col(day).alias("day"))).alias("r"))
    return deepest.join(recovery, keys, "left").select(
        *keys, F.col("t.dd").alias("max_drawdown"), F.col("t.peak_at.day").alias("peak_date"), "t.trough_date", F.col("r.day").alias("recovery_date"),
        (F.col("t.pos") - F.col("t.peak_at.pos")).alias("drawdown_rows"), (F.col("r.pos") - F.col("t.pos")).alias("recovery_rows"),
    )


def _series(df: DataFrame, keys: list[str], value: str, day: str) -> DataFrame:
    """Per key its whole series of values in order, as one array."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(day).alias("d"), F.col(value).cast("double").alias("v"))))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(pairs.alias("s"))


def rsi(df: DataFrame, keys: list[str], value: str = "close", n: int = 14, day: str = "trade_date") -> DataFrame:
    """Latest Wilder RSI per key over its whole series: 100 if nothing fell, 50 if nothing moved, null with n or fewer values."""
    s = _series(df, keys, value, day).where(F.size("s") > 1)
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("last"), none.alias("up"), none.alias("down"))
    smooth = lambda before, x: F.when(before.isNull(), x).otherwise(x / n + (1 - 1 / n) * before)

    def step(acc, x):
        move = x["v"] - acc["last"]
        up, down = F.greatest(move, F.lit(0.0)), F.greatest(-move, F.lit(0.0))
        first = acc["last"].isNull()
        return F.struct(x["v"].alias("last"), F.when(~first, smooth(acc["up"], up)).alias("up"), F.when(~first, smooth(acc["down"], down)).alias("down"))

    s = s.withColumn("a", F.aggregate("s", start, step))
    up, down = F.col("a.up"), F.col("a.down")
    value_ = F.when((up == 0) & (down == 0), 50.0).when(down == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(up, down)))
    return s.select(*keys, F.when(F.size("s") - 1 >= n, value_).alias("rsi"))


def macd(df: DataFrame, keys: list[str], value: str = "close", fast: int = 12, slow: int = 26, signal: int = 9, day: str = "trade_date") -> DataFrame:
    """Latest DIF, DEA and histogram per key over its whole series, by one fold that carries three averages; null with fewer than `slow` values."""
    s = _series(df, keys, value, day)
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("a"), none.alias("b"), none.alias("dea"))

    def step(acc, x):
        average = lambda before, now, span: F.when(before.isNull(), now).otherwise(now * (2 / (span + 1)) + before * (1 - 2 / (span + 1)))
        a, b = average(acc["a"], x["v"], fast), average(acc["b"], x["v"], slow)
        return F.struct(a.alias("a"), b.alias("b"), average(acc["dea"], a - b, signal).alias("dea"))

    s = s.withColumn("e", F.aggregate("s", start, step))
    long, dif, dea = F.size("s") >= slow, F.col("e.a") - F.col("e.b"), F.col("e.dea")
    return s.select(*keys, F.when(long, dif).alias("dif"), F.when(long, dea).alias("dea"), F.when(long, 2 * (dif - dea)).alias("hist"))


def momentum(df: DataFrame, keys: list[str], value: str, offsets: tuple[int, ...], day: str = "trade_date") -> DataFrame:
    """Return since so many rows before the last."""
    w = Window.partitionBy(*keys).orderBy(F.desc(day))
    rows = df.where(F.col(value).isNotNull()).withColumn("n", F.row_number().over(w)).where(F.col("n") <= max(offsets) + 1)
    at = lambda k: F.max(F.when(F.col("n") == k, F.col(value)))
    return rows.groupBy(*keys).agg(*((F.try_divide(at(1), at(k + 1)) - 1).alias(f"mom_{k}") for k in offsets))


def snapshot(df: DataFrame, keys: list[str], value: str = "close", averages: tuple[int, ...] = (5, 20, 60), offsets: tuple[int, ...] = (5, 20, 60, 120, 250), day: str = "trade_date") -> DataFrame:
    """A row per key with its last day and value, moving averages (null with fewer rows), RSI, MACD and momentum; what cannot be told is null."""
    w = Window.partitionBy(*keys).orderBy(F.desc(day))
    rows = df.where(F.col(value).isNotNull())
    recent = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max(averages))
    means = [F.when(F.count_if(F.col("n") <= k) == k, F.avg(F.when(F.col("n") <= k, F.col(value)))).alias(f"ma{k}") for k in averages]
    last = recent.groupBy(*keys).agg(F.max(day).alias("as_of"), F.max(F.when(F.col("n") == 1, F.col(value))).alias("close"), *means)
    return last.join(rsi(rows, keys, value, day=day), keys, "left").join(macd(rows, keys, value, day=day), keys, "left").join(momentum(rows, keys, value, offsets, day), keys, "left")


def month_end(df: DataFrame, keys: list[str], value: str, day: str = "trade_date") -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.last_day(day).alias("month")).agg(F.max_by(value, day).alias(value))


def changes(df: DataFrame, keys: list[str], value: str, days: tuple[int, ...] = (30, 90, 365), day: str = "trade_date") -> DataFrame:
    """Percent change of the last value against the last one at or before so many days earlier."""
    last = df.groupBy(*keys).agg(F.max(day).alias("_last"))
    rows = df.join(last, keys)
    base = {k: F.max_by(F.when(F.col(day) <= F.date_sub("_last", k), F.col(value)), F.when(F.col(day) <= F.date_sub("_last", k), F.col(day))) for k in days}
    out = rows.groupBy(*keys).agg(F.max_by(value, day).alias("last"), *(b.alias(f"_b{k}") for k, b in base.items()))
    return out.select(*keys, "last", *(F.when(F.col(f"_b{k}") > 0, (F.col("last") / F.col(f"_b{k}") - 1) * 100).alias(f"change_{k}d") for k in days))


def business_days(df: DataFrame, keys: list[str], points: list[str], value: str, day: str, end=None) -> DataFrame:
    """Linear interpolation of each series to weekdays between its first and last (or `end`) point, flat beyond the last."""
    spans = df.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    grid = spans.select(*keys, F.explode(F.sequence("_a", F.coalesce(F.lit(end).cast("date"), F.col("_b")), F.expr("interval 1 day"))).alias(day)).where(F.weekday(day) < 5)
    names = df.select(*keys, *points).distinct()
    full = grid.join(names, keys).join(df, [*keys, *points, day], "full")
    w = Window.partitionBy(*keys, *points).orderBy(day)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(day).alias("d"), F.col(value).alias("v")))
    full = full.withColumn("p", F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    share = F.try_divide(F.datediff(day, "p.d"), F.datediff("n.d", "p.d"))
    filled = F.coalesce(F.col(value), F.col("p.v") + (F.col("n.v") - F.col("p.v")) * share, F.col("p.v"))
    return full.withColumn(value, filled).where((F.weekday(day) < 5) & (F.col(value) > 1e-6)).select(*keys, *points, day, value)
