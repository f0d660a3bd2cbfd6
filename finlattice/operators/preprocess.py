"""Cross-sectional preprocessing of factor columns within groups (a date, or everything)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _per_group(df: DataFrame, by: list[str], aggs: list) -> DataFrame:
    """Group statistics joined back: aggregates are pre-summed, so a single group over all rows is no single task."""
    stats = df.groupBy(*by).agg(*aggs)
    return df.join(stats, by) if by else df.crossJoin(F.broadcast(stats))  # one row


def winsorize(df: DataFrame, columns: list[str], lower: float = 0.01, upper: float = 0.01, by: list[str] = ()) -> DataFrame:
    aggs = [F.percentile(c, F.array(F.lit(lower), F.lit(1 - upper))).alias(f"_q_{c}") for c in columns]
    out = _per_group(df, list(by), aggs)
    clipped = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(c, F.col(f"_q_{c}")[0]), F.col(f"_q_{c}")[1])) for c in columns}
    return out.withColumns(clipped).drop(*(f"_q_{c}" for c in columns))


def zscore(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Null throughout where the deviation is 0 or undefined."""
    out = _per_group(df, list(by), [x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])
    return out.withColumns({c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns}).drop(*(f"_{k}_{c}" for c in columns for k in "ms"))


def rank(df: DataFrame, column: str, by: list[str], ascending: bool = True) -> DataFrame:
    """Average rank of ties over the number of values, in 0..1, within each group."""
    w = Window.partitionBy(*by, F.col(column).isNull()).orderBy(F.col(column) if ascending else F.col(column).desc())
    ties = Window.partitionBy(*by, column)
    n = Window.partitionBy(*by)
    value = (F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2) / F.count(column).over(n)
    return df.withColumn(column, F.when(F.col(column).isNotNull(), value))


def neutralize_groups(df: DataFrame, columns: list[str], group: str, by: list[str] = ()) -> DataFrame:
    """Less the group's mean; a blank group has none, and if all are blank (over the whole table) the plan fails when it runs."""
    name = F.trim(group)
    means = df.where(name != "").groupBy(*by, name.alias("_g")).agg(*(F.avg(c).alias(f"_m_{c}") for c in columns))
    out = df.withColumn("_g", name).join(means, [*by, "_g"], "left")
    if not by:
        known = df.agg(F.count_if(name != "").alias("_k"))
        out = out.crossJoin(F.broadcast(known))  # one row
        failed = F.raise_error(F.lit(f"{group} is blank in every row")).cast("double")
        return out.withColumns({c: F.when(F.col("_k") == 0, failed).otherwise(F.col(c) - F.col(f"_m_{c}")) for c in columns}).drop("_g", "_k", *(f"_m_{c}" for c in columns))
    return out.withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).drop("_g", *(f"_m_{c}" for c in columns))


def neutralize_size(df: DataFrame, columns: list[str], size: str, by: list[str] = ()) -> DataFrame:
    """Residual of the regression on the logarithm of size.

    Below three rows or without variance of sizes there is none: within groups that is null, over the whole table the plan fails when it runs.
    """
    x = F.when(F.col(size) > 0, F.ln(size))
    aggs = [a for c in columns for a in (F.regr_slope(c, x).alias(f"_b_{c}"), F.regr_intercept(c, x).alias(f"_a_{c}"), F.regr_count(c, x).alias(f"_n_{c}"))]
    out = _per_group(df, list(by), aggs)
    failed = lambda c: F.lit(None).cast("double") if by else F.raise_error(F.concat(F.lit(f"{c}: "), F.col(f"_n_{c}").cast("string"), F.lit(f" rows with a {size}, or all of one {size}"))).cast("double")
    enough = lambda c: (F.col(f"_n_{c}") >= 3) & F.col(f"_b_{c}").isNotNull()
    fitted = {c: F.when(enough(c), F.col(c) - (F.col(f"_a_{c}") + F.col(f"_b_{c}") * x)).otherwise(failed(c)) for c in columns}
    return out.withColumns(fitted).drop(*(f"_{k}_{c}" for c in columns for k in "abn"))


def fill_missing(df: DataFrame, columns: list[str], how: str = "mean", value: float = 0.0, by: list[str] = ()) -> DataFrame:
    if how == "keep":
        return df
    if how == "drop":
        return df.na.drop(subset=columns)
    if how in ("zero", "value"):
        return df.na.fill(0.0 if how == "zero" else value, subset=columns)
    out = _per_group(df, list(by), [(F.avg if how == "mean" else F.median)(c).alias(f"_m_{c}") for c in columns])
    return out.withColumns({c: F.coalesce(c, f"_m_{c}") for c in columns}).drop(*(f"_m_{c}" for c in columns))


def rank_columns(df: DataFrame, columns: list[str], by: list[str] = (), ascending: bool = True) -> DataFrame:
    return reduce(lambda frame, c: rank(frame, c, list(by), ascending), columns, df)


STEPS = {"rank": rank_columns, "winsorize": winsorize, "zscore": zscore, "neutralize_groups": neutralize_groups, "neutralize_size": neutralize_size, "fill_missing": fill_missing}


def apply(df: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """Steps in order; columns '*' are all numeric ones."""
    numbers = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "long", "integer")]

    def one(frame: DataFrame, step: tuple[str, dict]) -> DataFrame:
        name, options = step
        if name not in STEPS:
            raise ValueError(f"no step {name!r}; there are {', '.join(STEPS)}")
        return STEPS[name](frame, **(options | {"columns": numbers if options.get("columns") == "*" else options["columns"]}))

    return reduce(one, steps, df)
