"""Table contracts and writes by key: upsert, insert-only, insert-or-reject, replace a partition, compare."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .point_in_time import latest


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in order and type; a missing one is an error, others are dropped, bad values become null."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema))


def pick(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns by name and type; absent ones are null."""
    return df.select(*((F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in columns.items()))


def first_of(df: DataFrame, candidates: list[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """target after `source`: matching rows take only the `update` columns, new rows are added."""
    s = source.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in source.columns if c not in keys), F.lit(True).alias("_there"))
    out = target.withColumn("_old", F.lit(True)).join(s, keys, "full")
    value = lambda c: (
        F.col(c) if c in keys else F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in update
        else F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_new_{c}")) if c in source.columns else F.col(c)
    )
    return out.select(*(value(c).alias(c) for c in target.columns))


def insert_new(target: DataFrame, source: DataFrame, keys: list[str], order: list[str] = ()) -> DataFrame:
    """Rows of source whose key the target lacks, one per key."""
    return latest(source, keys, list(order)).join(target.select(*keys), keys, "left_anti")


def insert_or_reject(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    if not source.join(target, keys, "left_semi").isEmpty():
        raise ValueError(f"rows with these {', '.join(keys)} exist already")
    return target.unionByName(source)


def replace_partition(source: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite only the partitions that source has rows for."""
    source.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def difference(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Keys that were added, removed or changed (null equals null, numbers within the tolerance)."""
    a = before.select(*keys, F.lit(True).alias("_a"), *(F.col(c).alias(f"a_{c}") for c in columns))
    b = after.select(*keys, F.lit(True).alias("_b"), *(F.col(c).alias(f"b_{c}") for c in columns))
    types = dict(before.dtypes)

    def differs(c: str):
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        far = F.abs(x - y) > tolerance if types[c] in ("double", "float") else x != y
        return F.coalesce(far, ~x.eqNullSafe(y))

    changed = F.array_compact(F.array(*(F.when(differs(c), c) for c in columns)))
    rows = a.join(b, keys, "full").withColumn("changed", changed)
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size("changed") > 0, "changed")
    return rows.select(*keys, kind.alias("kind"), F.when(kind == "changed", F.col("changed")).alias("columns")).where("kind is not null")


def version(spec: dict, length: int = 12) -> str:
    """Short digest of a specification, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:length]
